"""Queries of the query language and of ranked search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from ..operators.query_language import PRESETS, compile_query, parse
from ..session import scratch, table
from .common import ARTICLES, articles

STRUCTURED = '+premiere -kino ODER kritik score:>=40 words:<400 lang:de after:2025-01'
RANKED = "Premiere Publikum"


def searchable(s, d):
    """Articles with tags, bookmark and image flags."""
    t = table(s, d, "article_tags").where(F.trim("tag") != "").groupBy(F.col("article_id").alias("id")).agg(F.collect_set(F.trim(F.lower("tag"))).alias("tags"))
    b = table(s, d, "bookmarks").select(F.col("article_id").alias("id"), F.lit(True).alias("bookmarked"))
    a = articles(s, d).join(t, "id", "left").join(b, "id", "left")
    return a.withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "bookmarked": F.coalesce("bookmarked", F.lit(False)), "has_image": F.coalesce("meta.image", "meta.og_image", F.lit("")) != ""})


def _where(raw):
    return lambda s, d: searchable(s, d).where(compile_query(parse(raw))).select("id")


def presets(s, d):
    """How many articles each preset keeps, in one pass."""
    a = searchable(s, d)
    n = a.agg(*[F.count_if(compile_query(parse(q))).alias(k) for k, q in PRESETS.items()])
    return n.unpivot([], list(PRESETS), "preset", "n")


def bm25_indexed(s, d):
    """The same ranking from a postings table."""
    return S.bm25_indexed(S.index_articles(articles(s, d), scratch(s, "index")), RANKED)


def boosted_scores(s, d):
    """The same ranking with bonuses for phrases in the title and for trusted sources."""
    r = S.bm25(articles(s, d), RANKED, S.Ranking(title_bonus=0, bigram_bonus=0, proximity=False))
    return S.boosted(r.select("id", "title", "source", "score"), ["premiere"], table(s, d, "feeds")).select("id", "score")


QUERIES = {
    "structured_query": _where(STRUCTURED), "tag_any": _where("tag:form:kritik tag:form:interview"), "tag_all": _where("tag:form:kritik tag:tonalitaet:positiv tagmode:all"), "tag_none": _where("tag:form:kritik tagmode:none tagnot:tonalitaet:negativ"),
    "phrase_query": _where('"der Chor" NOT Premiere has:image'), "presets": presets, "like_search": lambda s, d: articles(s, d).where(F.col("title").ilike("%premiere%") | F.col("full_text").ilike("%premiere%") | F.col("summary").ilike("%premiere%")).select("id", "relevance_score", "day").orderBy(F.desc("relevance_score"), F.desc_nulls_last("day"), "id"),
    "bm25": lambda s, d: S.bm25(articles(s, d), RANKED, S.Ranking(title_bonus=0, bigram_bonus=0, proximity=False)).select("id", "score"),
    "bm25_boosted": lambda s, d: S.search(searchable(s, d), RANKED + " type:review", 50).select("id", "score"), "bm25_recent": lambda s, d: S.search(searchable(s, d), RANKED, 50, S.Ranking(recency="exponential"), "2026-06-30").select("id", "score"),
    "synonym_search": lambda s, d: S.search(searchable(s, d), "Rezension", 50, S.Ranking(synonyms=(("rezension", "kritik", "besprechung", "review"),))).select("id", "score"),
    "hybrid_search": lambda s, d: S.hybrid(searchable(s, d), "Premjere Publikumm", 50), "sound_alike": lambda s, d: S.sound_alike(articles(s, d), "Zweivel Puplikum"), "did_you_mean": lambda s, d: S.closest_terms(_vocabulary(s, d), "premjere publikumm kritick"),
    "suggestions": lambda s, d: S.suggestions(articles(s, d), "th"), "highlights": lambda s, d: articles(s, d).select("id", S.highlight(F.col("title"), "premiere kritik").alias("marked")), "snippets": lambda s, d: articles(s, d).where("full_text is not null").select("id", S.snippet(F.col("full_text"), RANKED).alias("snippet")),
    "top_terms": lambda s, d: S.top_terms(articles(s, d)), "bm25_indexed": bm25_indexed, "boosted_scores": boosted_scores,
}


def _vocabulary(s, d):
    return articles(s, d).select("id", F.explode(F.array_distinct(T.ascii_tokens(F.col("title")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


from .text import _FOLD, _STOP  # noqa: E402

_A = f"WITH {ARTICLES} "
_S = f"""WITH {ARTICLES}, t AS (SELECT article_id, list(DISTINCT trim(lower(tag), ' ')) AS tags FROM article_tags WHERE trim(tag, ' ') <> '' GROUP BY 1),
 x AS (SELECT a.*, coalesce(tags, []) AS tags, b.article_id IS NOT NULL AS bookmarked, coalesce(meta.image, meta.og_image, '') <> '' AS has_image, concat_ws(' ', lower(coalesce(title, '')), lower(coalesce(full_text, '')), lower(coalesce(summary, ''))) AS body FROM a LEFT JOIN t ON t.article_id = a.id LEFT JOIN bookmarks b ON b.article_id = a.id) """
_TOK = lambda c: f"list_filter(regexp_split_to_array({_FOLD(f'coalesce({c}, chr(32))')}, '[^a-z0-9]+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))"
_CNT = lambda c, w: f"len(list_filter({c}, lambda t: t = '{w}'))"
_TF = lambda w: f"4 * {_CNT('tt', w)} + {_CNT('ts', w)} + {_CNT('tb', w)}"
_PART = lambda i: f"ln((n - d{i} + 0.5) / (d{i} + 0.5) + 1) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * dl / m))"
SQL = {
    "structured_query": _S + "SELECT id FROM x WHERE NOT contains(body, 'kino') AND contains(body, 'premiere') AND relevance_score >= 40 AND word_count < 400 AND lower(language) = 'de' AND day >= DATE '2025-01-01'",
    "tag_any": _S + "SELECT id FROM x WHERE list_has_any(tags, ['form:kritik', 'form:interview'])", "tag_all": _S + "SELECT id FROM x WHERE list_has_all(tags, ['form:kritik', 'tonalitaet:positiv'])", "tag_none": _S + "SELECT id FROM x WHERE NOT list_has_any(tags, ['form:kritik']) AND NOT list_has_any(tags, ['tonalitaet:negativ'])",
    "phrase_query": _S + "SELECT id FROM x WHERE contains(body, 'der chor') AND NOT contains(body, 'premiere') AND has_image",
    "presets": _S + "SELECT unnest(['top', 'reviews', 'positive', 'negative', 'long', 'free', 'images', 'saved']) AS preset, unnest([count(*) FILTER (relevance_score >= 80), count(*) FILTER (article_type = 'review'), count(*) FILTER (sentiment = 'positiv'), count(*) FILTER (sentiment = 'negativ'), count(*) FILTER (word_count >= 400), count(*) FILTER (NOT paywall), count(*) FILTER (has_image), count(*) FILTER (bookmarked)]) AS n FROM x",
    "like_search": _A + "SELECT id, relevance_score, day FROM a WHERE title ILIKE '%premiere%' OR full_text ILIKE '%premiere%' OR summary ILIKE '%premiere%'",
    "bm25": _A + f", k AS (SELECT id, {_TOK('title')} AS tt, {_TOK('summary')} AS ts, {_TOK('full_text')} AS tb FROM a), f AS (SELECT id, 4 * len(tt) + len(ts) + len(tb) AS dl, {_TF('premiere')} AS f0, {_TF('publikum')} AS f1 FROM k), z AS (SELECT count(*) AS n, avg(dl) AS m, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM f) SELECT id, round(({_PART(0)} + {_PART(1)}) * (0.3 + 0.7 * (if(f0 > 0, 1, 0) + if(f1 > 0, 1, 0)) / 2), 6) AS score FROM f, z WHERE f0 > 0 OR f1 > 0",
    "suggestions": _A + f", w AS (SELECT source AS value, 5 AS w FROM a WHERE starts_with({_FOLD('source')}, 'th') UNION ALL SELECT value, 2 FROM (SELECT id, unnest(list_distinct({_TOK('title')})) AS value FROM a) WHERE starts_with(value, 'th')) SELECT value, CAST(sum(w) AS BIGINT) AS weight FROM w GROUP BY value ORDER BY 2 DESC, 1 LIMIT 10",
    "highlights": _A + "SELECT id, regexp_replace(title, '(?i)(premiere|kritik)', '<mark>\\1</mark>', 'g') AS marked FROM a",
    "did_you_mean": _A + f", v AS (SELECT term, count(*) AS n FROM (SELECT id, unnest(list_distinct({_TOK('title')})) AS term FROM a) GROUP BY term), j AS (SELECT q.w AS query_term, term, n, levenshtein(term, q.w) AS distance FROM v, (SELECT unnest(['premjere', 'publikumm', 'kritick']) AS w) q WHERE levenshtein(term, q.w) <= 2) SELECT query_term, term, CAST(distance AS INTEGER) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY query_term ORDER BY distance, n DESC, term) = 1",
    "top_terms": _A + f", w AS (SELECT id, unnest(list_distinct(list_filter({_TOK(chr(99) + 'oncat_ws(chr(32), title, summary)')}, lambda t: length(t) >= 4))) AS term FROM a) SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY 2 DESC, 1 LIMIT 30",
}
SQL["bm25_indexed"] = SQL["bm25"]
SQL["boosted_scores"] = f"WITH b AS ({SQL['bm25']}) SELECT b.id, round(b.score * (1 + if(contains(lower(coalesce(title, '')), 'premiere'), 0.3::DOUBLE, 0)) * CASE WHEN priority >= 95 THEN 1.1::DOUBLE WHEN priority >= 80 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END, 6) AS score FROM b JOIN articles x ON x.id = b.id LEFT JOIN (SELECT name, max(priority) AS priority FROM feeds GROUP BY 1) f ON f.name = x.source"
