"""Lookups, lists of one article, freshness, window functions and related articles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import lookups as L
from ..session import table
from .common import ARTICLES, ENTITIES, articles, entities
from .search import _TOK

NOW = "2026-06-30"


def point_lookup(s, d):
    """The article with the least normalized URL."""
    a = table(s, d, "articles")
    return L.lookup(a, "url_normalized", a.agg(F.min("url_normalized")).first()[0]).select("id", "title", "url_normalized")


def article_entities(s, d):
    """The entities of each article in order: most mentioned first."""
    e = entities(s, d).select("article_id", "entity_type", "entity_value", F.coalesce("mentions", F.lit(0)).alias("mentions"))
    return L.listed(e, "article_id", [F.desc("mentions"), F.asc("entity_type"), F.asc("entity_value")])


def article_tags(s, d):
    """The tags of each article in order of the alphabet."""
    t = table(s, d, "article_tags").where(F.trim("tag") != "").select("article_id", F.trim(F.lower("tag")).alias("tag")).distinct()
    return L.listed(t, "article_id", [F.asc("tag")])


def freshness_histogram(s, d):
    return articles(s, d).select(L.freshness(F.col("day"), F.lit(NOW)).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def breaking(s, d):
    """Breaking news as of the midnight of the newest day."""
    a = articles(s, d)
    newest = a.agg(F.max("day")).first()[0]
    return L.breaking_news(a, "day", F.lit(newest)).select("id", "relevance_score", "day")


def recency_bands(s, d):
    return articles(s, d).select(L.recency_band(F.col("day"), F.to_date(F.lit(NOW))).alias("band")).groupBy("band").agg(F.count("*").alias("n"))


def window_frames(s, d):
    """Quartile, percent rank, running mean and the second id of each source by relevance."""
    w = Window.partitionBy("source").orderBy(F.desc("relevance_score"), "id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a = articles(s, d).select("id", "source", F.col("relevance_score").cast("double").alias("r"), "relevance_score")
    return a.select("id", "source", F.ntile(4).over(w).cast("bigint").alias("quartile"), F.round(F.percent_rank().over(w), 6).alias("rank"), F.round(F.avg("r").over(w.rowsBetween(-3, 0)), 4).alias("mean4"), F.nth_value("id", 2).over(whole).alias("second"))


def third_page(s, d):
    """Rows 41 to 60 of the best articles."""
    return articles(s, d).select("id", "relevance_score").orderBy(F.desc("relevance_score"), "id").offset(40).limit(20)


def newest_first(s, d):
    """Ingest order: newest first, undated last."""
    return articles(s, d).select("id", "day").orderBy(F.desc_nulls_last("day"), "id")


def german_dates(s, d):
    return articles(s, d).select("id", F.date_format("day", "dd.MM.yyyy").alias("date"))


def split_filters(s, d):
    """Filters with several values in one text, separated by comma, semicolon or bar."""
    values = [v.strip() for v in __import__("re").split("[,;|]", "review, interview;news") if v.strip()]
    return articles(s, d).where(F.col("article_type").isin(values)).select("id", "article_type")


def related_titles(s, d):
    """For every article whose id is divisible by 50 those within fourteen days that share two words of the title."""
    a = articles(s, d)
    return L.related_by_words(a.select("id", "day", F.explode(T.ascii_tokens(F.col("title"))).alias("word")), a.where("id % 50 = 0"), 2, 14)


def related_keywords(s, d):
    """For every article whose id is divisible by 50 those that share two of their ten most frequent words of title and summary."""
    a = articles(s, d)
    words = a.select("id", F.explode(T.ascii_tokens(F.concat_ws(" ", "title", "summary"))).alias("word"))
    return L.related_by_words(L.top_words(words), a.where("id % 50 = 0"))


QUERIES = {
    "point_lookup": point_lookup, "article_entities": article_entities, "article_tags_sorted": article_tags, "freshness_histogram": freshness_histogram, "breaking_news": breaking, "recency_bands": recency_bands, "window_frames": window_frames, "third_page": third_page,
    "newest_first": newest_first, "german_dates": german_dates, "split_filters": split_filters, "related_titles": related_titles, "related_keywords": related_keywords,
}
_A = f"WITH {ARTICLES} "
_HOURS = f"datediff('hour', CAST(day AS TIMESTAMP), TIMESTAMP '{NOW}')"
SQL = {
    "point_lookup": "SELECT id, title, url_normalized FROM articles WHERE url_normalized = (SELECT min(url_normalized) FROM articles)",
    "article_entities": f"WITH {ENTITIES} SELECT article_id, entity_type, entity_value, coalesce(mentions, 0) AS mentions, CAST(row_number() OVER (PARTITION BY article_id ORDER BY coalesce(mentions, 0) DESC, entity_type, entity_value) AS INTEGER) AS position FROM e",
    "article_tags_sorted": "SELECT article_id, tag, CAST(row_number() OVER (PARTITION BY article_id ORDER BY tag) AS INTEGER) AS position FROM (SELECT DISTINCT article_id, trim(lower(tag), ' ') AS tag FROM article_tags WHERE trim(tag, ' ') <> '')",
    "freshness_histogram": _A + f"SELECT CASE WHEN day IS NULL THEN 'unknown' WHEN {_HOURS} < 1 THEN 'breaking' WHEN {_HOURS} < 6 THEN 'fresh' WHEN {_HOURS} < 24 THEN 'recent' WHEN {_HOURS} < 168 THEN 'week-old' ELSE 'stale' END AS label, count(*) AS n FROM a GROUP BY 1",
    "breaking_news": _A + "SELECT id, relevance_score, day FROM a WHERE day = (SELECT max(day) FROM a) AND relevance_score >= 5",
    "recency_bands": _A + f"SELECT CASE WHEN DATE '{NOW}' - day < 1 THEN 'day' WHEN DATE '{NOW}' - day < 7 THEN 'week' WHEN DATE '{NOW}' - day < 30 THEN 'month' WHEN day IS NOT NULL THEN 'older' END AS band, count(*) AS n FROM a GROUP BY 1",
    "window_frames": _A + "SELECT id, source, ntile(4) OVER w AS quartile, round(percent_rank() OVER w, 6) AS rank, round(avg(CAST(relevance_score AS DOUBLE)) OVER (PARTITION BY source ORDER BY relevance_score DESC, id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS mean4, nth_value(id, 2) OVER (PARTITION BY source ORDER BY relevance_score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM a WINDOW w AS (PARTITION BY source ORDER BY relevance_score DESC, id)",
    "third_page": _A + "SELECT id, relevance_score FROM a ORDER BY relevance_score DESC, id LIMIT 20 OFFSET 40",
    "newest_first": _A + "SELECT id, day FROM a",
    "german_dates": _A + "SELECT id, strftime(day, '%d.%m.%Y') AS date FROM a",
    "split_filters": _A + "SELECT id, article_type FROM a WHERE article_type IN ('review', 'interview', 'news')",
    "related_titles": _A + f", w AS (SELECT DISTINCT id, day, unnest({_TOK('title')}) AS word FROM a WHERE day IS NOT NULL) SELECT x.id, y.id AS other, count(*) AS shared FROM w x JOIN w y ON x.word = y.word AND x.id <> y.id AND x.id % 50 = 0 AND abs(x.day - y.day) <= 14 GROUP BY 1, 2 HAVING count(*) >= 2",
    "related_keywords": _A + f", w AS (SELECT id, unnest({_TOK('concat_ws(chr(32), title, summary)')}) AS word FROM a), k AS (SELECT id, word FROM (SELECT id, word, count(*) AS n FROM w GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, word) <= 10) SELECT x.id, y.id AS other, count(*) AS shared FROM k x JOIN k y ON x.word = y.word AND x.id <> y.id AND x.id % 50 = 0 GROUP BY 1, 2 HAVING count(*) >= 2",
}
