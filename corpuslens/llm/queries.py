"""Queries of the operators for training corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import spread, table
from .cooccurrence import tag_pairs
from .main_content import main_content, scored_lines
from .mixing import mixture, shares
from .names import resolve_names, variant_pairs
from .repeated_lines import repeated_lines, without_repeated_lines
from .residue import residue_documents, without_residue
from .survivors import merged_records, survivors
from .tokenizing import token_ids
from .truncation import truncated_fields, truncation_rates


def _documents_of_articles(spark, folder):
    return spread(table(spark, folder, "articles").select("id", "source", F.col("full_text").alias("text")))


def _texts(spark, folder):
    """The columns of articles that problems 1 and 6 read."""
    return spread(table(spark, folder, "articles").select("id", "source", "title", "full_text", "first_paragraph", "summary"))


def p1_found(spark, folder):
    """Fields whose own text was broken off."""
    return truncated_fields(_texts(spark, folder)).where("truncated").select(F.col("id").alias("article_id"), "field").distinct()


def p1_rates(spark, folder):
    """Truncated texts by source and field."""
    return truncation_rates(_texts(spark, folder))


def p2_found(spark, folder):
    """Tags that stand together at least four times as often as by chance."""
    d = tag_pairs(table(spark, folder, "article_tags"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    return d.where(wide("c") * wide("n") >= wide("a") * wide("b") * 4).select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"))


def p2_scores(spark, folder):
    """Counts, lift and conviction of all pairs with enough support."""
    d = tag_pairs(table(spark, folder, "article_tags"))
    return d.select(F.col("item_a").alias("tag_a"), F.col("item_b").alias("tag_b"), "n", "a", "b", "c", *[F.round(x, 6).alias(x) for x in ("lift", "conviction_ab", "conviction_ba")])


def p3_found(spark, folder):
    """Pairs of spellings of one person or organisation."""
    return variant_pairs(table(spark, folder, "articles"), "author").select(F.col("a").alias("author_a"), F.col("b").alias("author_b"))


def p3_entities(spark, folder):
    """Every spelling with the most frequent spelling of its entity."""
    articles = table(spark, folder, "articles")
    e = resolve_names(articles, "author").join(articles.groupBy(F.col("author").alias("spelling")).agg(F.count("*").alias("n")), "spelling")
    best = e.groupBy("entity").agg(F.min_by("spelling", F.struct(-F.col("n"), F.col("spelling"))).alias("name"))
    return e.join(best, "entity").select("spelling", "name", "n")


def p5_found(spark, folder):
    return repeated_lines(_documents_of_articles(spark, folder))


def p5_clean(spark, folder):
    """Every text without the repeated lines of its source."""
    return without_repeated_lines(_documents_of_articles(spark, folder))


def p6_found(spark, folder):
    """Numbers of the lines that are not the article's own text."""
    return scored_lines(_texts(spark, folder)).where("not own").select(F.col("key").alias("article_id"), "field", "line_no").distinct()


def p6_texts(spark, folder):
    """Each field's own text."""
    return main_content(_texts(spark, folder)).select(F.col("id").alias("article_id"), "field", "text")


def p7_found(spark, folder):
    return survivors(table(spark, folder, "articles"), table(spark, folder, "feeds"))


def p7_records(spark, folder):
    """One record a duplicate group, built field by field."""
    return merged_records(table(spark, folder, "articles"), table(spark, folder, "feeds"))


def p8_ids(spark, folder):
    return token_ids(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p9_mix(spark, folder):
    """The mix: shards of token blocks at the target shares."""
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark, folder):
    """The shares reached."""
    return shares(*mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets")))


def p10_found(spark, folder):
    return residue_documents(spread(table(spark, folder, "documents").select("doc_id", "text"))).select("doc_id")


def p10_kinds(spark, folder):
    """Documents by kind of residue."""
    d = residue_documents(spread(table(spark, folder, "documents").select("doc_id", "text")))
    return d.select("doc_id", F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_docs"))


def p10_clean(spark, folder):
    """The documents kept."""
    return without_residue(table(spark, folder, "documents")).select("doc_id", "source", "n_chars")


_TAGS = r"""
WITH t AS (SELECT DISTINCT article_id, regexp_replace(lower(tag), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS tag FROM article_tags WHERE article_id IS NOT NULL AND tag IS NOT NULL),
p AS (SELECT * FROM t WHERE tag <> ''), n AS (SELECT count(DISTINCT article_id) AS n FROM p), f AS (SELECT tag, count(*) AS k FROM p GROUP BY tag),
c AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS c FROM p x JOIN p y ON x.article_id = y.article_id AND x.tag < y.tag GROUP BY ALL),
s AS (SELECT tag_a, tag_b, n, fa.k AS a, fb.k AS b, c FROM c JOIN f fa ON fa.tag = tag_a JOIN f fb ON fb.tag = tag_b, n WHERE c >= 4 AND c * 1000 >= n)
"""
_GROUPS = """
WITH RECURSIVE l AS (SELECT DISTINCT a.id AS x, b.id AS y FROM articles a JOIN articles b ON a.duplicate_of = b.id AND a.id <> b.id), e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS id, x AS least FROM e UNION SELECT e.y, r.least FROM r JOIN e ON e.x = r.id), g AS (SELECT id, min(least) AS group_id FROM r GROUP BY id),
k AS (SELECT g.group_id, a.*, row_number() OVER (PARTITION BY group_id ORDER BY coalesce(f.priority, 0) DESC, coalesce(word_count, 0) DESC, a.id) AS rank FROM g JOIN articles a ON a.id = g.id LEFT JOIN feeds f ON f.name = a.source)
"""
_LINES = r"""
WITH x AS (SELECT DISTINCT id, source, trim(regexp_replace(l, '[\s\p{Z}\x{feff}]+', ' ', 'g'), ' ') AS line FROM (SELECT id, source, unnest(string_split(full_text, chr(10))) AS l FROM articles WHERE source IS NOT NULL AND full_text IS NOT NULL)),
n AS (SELECT source, count(*) AS n FROM articles GROUP BY source),
f AS (SELECT x.source, line FROM x JOIN n USING (source) WHERE line <> '' GROUP BY x.source, line, n.n HAVING count(*) >= 5 AND count(*) * 100 >= n.n * 5)
"""
_FIELDS = ("title", "author", "summary", "full_text", "published_date", "language")

QUERIES = {"p1_found": p1_found, "p1_rates": p1_rates, "p2_found": p2_found, "p2_scores": p2_scores, "p3_found": p3_found, "p3_entities": p3_entities, "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_texts": p6_texts, "p7_found": p7_found, "p7_records": p7_records, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_kinds": p10_kinds, "p10_clean": p10_clean}
SQL = {
    "p2_found": _TAGS + "SELECT tag_a, tag_b FROM s WHERE c * n >= 4 * a * b",
    "p2_scores": _TAGS + "SELECT tag_a, tag_b, n, a, b, c, round(c * n / (a * b), 6) AS lift, round(CASE WHEN c < a THEN (1 - b / n) / (1 - c / a) END, 6) AS conviction_ab, round(CASE WHEN c < b THEN (1 - a / n) / (1 - c / b) END, 6) AS conviction_ba FROM s",
    "p5_found": _LINES + "SELECT source, line FROM f",
    "p5_clean": _LINES
    + r""", w AS (SELECT id, source, l, i FROM (SELECT id, source, unnest(string_split(full_text, chr(10))) AS l, generate_subscripts(string_split(full_text, chr(10)), 1) AS i FROM articles WHERE full_text IS NOT NULL)),
m AS (SELECT w.*, f.line IS NOT NULL AS hit FROM w LEFT JOIN f ON f.source = w.source AND f.line = trim(regexp_replace(l, '[\s\p{Z}\x{feff}]+', ' ', 'g'), ' '))
, k AS (SELECT id, bool_or(hit) AS rebuilt, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT hit), '') AS text FROM m GROUP BY id)
SELECT a.id, a.source, k.text, coalesce(k.rebuilt, false) AS rebuilt FROM articles a LEFT JOIN k ON k.id = a.id""",
    "p7_found": _GROUPS + "SELECT group_id, id AS survivor_id FROM k WHERE rank = 1",
    "p7_records": _GROUPS + "SELECT group_id, arg_min(id, rank) AS survivor_id, count(*) AS n_members, " + ", ".join(f"arg_min({f}, rank) FILTER (trim({f}, ' ') <> '') AS {f}" for f in _FIELDS) + " FROM k GROUP BY group_id",
}
