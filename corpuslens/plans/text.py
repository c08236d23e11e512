"""Queries on text, URL and language functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import german
from ..functions import text as T
from ..session import table
from .common import ARTICLES, articles


def vocabulary(s, d):
    """Distinct title tokens with their number of articles, stem and sound code."""
    t = articles(s, d).select("id", F.explode(F.array_distinct(T.letter_tokens(F.col("title")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return t.join(german.with_codes(t), "term")


def phonetic_groups(s, d):
    """Words of one sound code."""
    v = vocabulary(s, d).where(F.length("term") >= 4)
    return v.groupBy("sound").agg(F.count("*").alias("n_words"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("term")), " ").alias("words")).where("n_words > 1")


def reading_times(s, d):
    a = articles(s, d)
    return a.select("id", F.size(T.words(F.coalesce("full_text", F.lit("")))).alias("n_words"), T.reading_minutes(F.col("word_count")).alias("minutes"))


def language_check(s, d):
    """The language found in each text against the stored one."""
    a = articles(s, d).where(F.length("full_text") >= 80).select("language", T.language_of(F.col("full_text")).alias("found"))
    return a.groupBy("language", "found").agg(F.count("*").alias("n"))


def quote_list(s, d):
    """Quotations of all texts with the article's first person, longest first."""
    from .common import entities

    q = articles(s, d).select("id", F.posexplode(T.quotes(F.col("full_text"))).alias("pos", "quote"))
    p = entities(s, d).where("entity_type = 'person'").groupBy(F.col("article_id").alias("id")).agg(F.min("entity_value").alias("person"))
    return q.join(p, "id", "left").select("id", "pos", "quote", F.length("quote").alias("size"), "person")


QUERIES = {
    "fold_titles": lambda s, d: articles(s, d).select("id", T.fold(F.col("title")).alias("folded"), T.normal_title(F.col("title")).alias("normal")),
    "token_counts": lambda s, d: articles(s, d).select(F.explode(T.ascii_tokens(F.coalesce("title", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n")),
    "occurrences": lambda s, d: articles(s, d).select("id", T.occurrences(F.coalesce("full_text", F.lit("")), "Bühne").cast("bigint").alias("n")).where("n > 0"),
    "excerpts": lambda s, d: articles(s, d).select("id", T.excerpt(F.col("full_text")).alias("excerpt"), T.first_paragraph(F.col("full_text")).alias("first")),
    "reading_times": reading_times, "sentence_counts": lambda s, d: articles(s, d).where("full_text is not null").select("id", F.size(T.sentences(F.col("full_text"))).alias("n")),
    "escaped_titles": lambda s, d: articles(s, d).select("id", T.escape_html(F.col("title")).alias("html")), "stripped_summaries": lambda s, d: articles(s, d).select("id", T.strip_html(F.concat(F.lit("<p>"), F.col("summary"), F.lit("</p><script>x</script>"))).alias("text")),
    "normal_urls": lambda s, d: articles(s, d).select("id", T.normal_url(F.col("url")).alias("url"), T.host(F.col("url")).alias("host")), "url_days": lambda s, d: articles(s, d).select("id", T.url_day(F.col("url")).alias("url_day")),
    "context_matches": lambda s, d: articles(s, d).select("id", T.near(F.coalesce("full_text", F.lit("")), "Premiere", ("Regie", "Kasse")).alias("near")).where("near"),
    "language_check": language_check, "vocabulary": vocabulary, "phonetic_groups": phonetic_groups, "quote_list": quote_list,
    "quote_coverage": lambda s, d: articles(s, d).agg(F.count("*").alias("n"), F.round(F.avg((F.size(T.quotes(F.coalesce("full_text", F.lit("")))) > 0).cast("int")), 6).alias("share")),
    "summary_overlap": lambda s, d: articles(s, d).where("summary is not null and full_text is not null").select("id", F.round(T.jaccard(F.array_distinct(T.letter_tokens(F.col("summary"))), F.array_distinct(T.letter_tokens(F.col("full_text")))), 6).alias("jaccard")),
    "title_cosine": lambda s, d: articles(s, d).where("summary is not null").select("id", F.round(T.cosine_counts(T.letter_tokens(F.col("title")), T.letter_tokens(F.col("summary"))), 6).alias("cosine")),
    "title_similarity": lambda s, d: table(s, d, "articles").alias("x").join(table(s, d, "articles").alias("y"), F.col("x.duplicate_of") == F.col("y.id")).select(F.col("x.id").alias("id"), F.round(T.similarity(*[F.regexp_replace(T.fold(F.col(c)), "[^ -~]", "") for c in ("x.title", "y.title")]), 6).alias("similarity")),
}

_A = f"WITH {ARTICLES} "
_FOLD = lambda c: "translate(" + f"replace(replace(replace(replace(lower({c}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')" + f", '{T._FROM}', '{T._TO}')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_LETTERS = lambda c: f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 3)"
_COLLAPSE = lambda c: f"trim(regexp_replace({c}, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ')"
SQL = {
    "fold_titles": _A + f"SELECT id, {_FOLD('title')} AS folded, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') AS normal FROM a",
    "token_counts": _A + f"SELECT term, count(*) AS n FROM (SELECT unnest(regexp_split_to_array({_FOLD('coalesce(title, chr(32))')}, '[^a-z0-9]+')) AS term FROM a) WHERE length(term) >= 3 AND NOT list_contains({_STOP}, term) GROUP BY term",
    "occurrences": _A + f"SELECT id, n FROM (SELECT id, CAST((length({_FOLD('full_text')}) - length(replace({_FOLD('full_text')}, 'buehne', ''))) // 6 AS BIGINT) AS n FROM a) WHERE n > 0",
    "reading_times": _A + "SELECT id, CAST(len(list_filter(regexp_split_to_array(coalesce(full_text, ''), '[\\s\\p{Z}]+'), lambda w: w <> '')) AS INTEGER) AS n_words, CAST(greatest(1, floor(word_count / 200 + 0.5)) AS INTEGER) AS minutes FROM a",
    "escaped_titles": _A + "SELECT id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM a",
    "normal_urls": _A + f""", u AS (SELECT id, lower(trim(replace(url, '&amp;', '&'), ' ')) AS s FROM a), p AS (SELECT id, s, regexp_replace(regexp_replace(regexp_replace(s, '#.*$', ''), '\\?.*$', ''), '/$', '') AS path, list_sort(list_filter(string_split(regexp_extract(regexp_replace(s, '#.*$', ''), '\\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT list_contains([{', '.join(f"'{x}'" for x in T.TRACKING)}], regexp_extract(q, '^([^=]*)', 1)))) AS kept FROM u)
 SELECT id, CASE WHEN NOT regexp_matches(s, '^https?://[^/ ]+') THEN s ELSE path || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS url, regexp_extract((SELECT lower(url) FROM a WHERE a.id = p.id), '^https?://(?:www\\.)?([^/:?#]+)', 1) AS host FROM p""",
    "summary_overlap": _A + f"SELECT id, round(len(list_intersect({_LETTERS('summary')}, {_LETTERS('full_text')})) / greatest(len(list_distinct(list_concat({_LETTERS('summary')}, {_LETTERS('full_text')}))), 1), 6) AS jaccard FROM a WHERE summary IS NOT NULL AND full_text IS NOT NULL",
    "title_similarity": f"SELECT x.id, round(1 - levenshtein(f, g) / greatest(length(f), length(g)), 6) AS similarity FROM (SELECT id, duplicate_of, regexp_replace({_FOLD('title')}, '[^ -~]', '', 'g') AS f FROM articles) x JOIN (SELECT id, regexp_replace({_FOLD('title')}, '[^ -~]', '', 'g') AS g FROM articles) y ON x.duplicate_of = y.id",
    "quote_coverage": _A + ", q AS (SELECT id, len(list_filter(list_transform(regexp_extract_all(coalesce(full_text, ''), '[„“«\"]([^„“”«»\"\\n]{8,400})[“”»\"]', 1), lambda q: trim(q, ' ')), lambda q: len(list_filter(regexp_split_to_array(q, '[\\s\\p{Z}]+'), lambda w: w <> '')) >= 3)) AS n FROM a) SELECT count(*) AS n, round(avg(if(n > 0, 1, 0)), 6) AS share FROM q",
}
SQL |= {
    "sentence_counts": _A + r"SELECT id, CAST(len(list_filter(string_split(regexp_replace(full_text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ') <> '')) AS INTEGER) AS n FROM a WHERE full_text IS NOT NULL",
    "stripped_summaries": _A + r"SELECT id, trim(regexp_replace(coalesce(summary, NULL), '[\s\p{Z}]+', ' ', 'g'), ' ') AS text FROM a",
    "url_days": _A + r", p AS (SELECT id, regexp_extract(url, '[/_-]((?:19|20)\d{2})[/_-](\d{1,2})[/_-](\d{1,2})(?:[/_.-]|$)', ['y', 'm', 'd']) AS x FROM a) SELECT id, TRY_CAST(x.y || '-' || lpad(x.m, 2, '0') || '-' || lpad(x.d, 2, '0') AS DATE) AS url_day FROM p",
}
