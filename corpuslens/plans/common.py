"""The canonical articles of a folder, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timestamps import MONTHS
from ..schema import canonical, with_days
from ..session import spread, table


def articles(spark, folder):
    """Canonical articles with days and defaults."""
    return with_days(spread(canonical(table(spark, folder, "articles"))), table(spark, folder, "feeds"))


def entities(spark, folder):
    """Entities, each once an article (rows repeated under a new id fall together)."""
    e = table(spark, folder, "article_entities")
    return e.groupBy("article_id", "entity_type", "entity_value").agg(F.max("mentions").alias("mentions"), F.max("in_title").alias("in_title"), F.max("confidence").alias("confidence"), F.max("created_at").alias("created_at"))


_MONTHS = "MAP {" + ", ".join(f"'{w}': {k}" for k, words in MONTHS.items() for w in dict.fromkeys(words.split())) + "}"
_CLOCK = r"\d{1,2}[:.h]\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s*[aApP]\.?[mM]\.?)?(?:\s*Uhr)?\s*(?:Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|\p{L}{2,4})?"
_YMD = lambda y, m, d: f"TRY_CAST((CASE WHEN length({y}) = 2 THEN '20' || {y} ELSE {y} END) || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"
_GET = lambda p, k: f"regexp_extract(s, '{p}', {k})"
_ISO = rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:[Tt ]\s*{_CLOCK})?\s*(?:Z|[+-]\d{{2}}:?\d{{2}}|\p{{L}}{{2,4}})?$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})T\d{4}"
_DOTS = rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}|\d{{2}})(?:,?\s+(?:um\s+)?{_CLOCK})?$"
_SLASH = rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}|\d{{2}})(?:,?\s+{_CLOCK})?$"
_DMY = rf"^(?:\p{{L}}{{2,10}}\.?,?\s+)?(\d{{1,2}})(?:\.|er)?\s+(\p{{L}}{{3,9}})\.?\s+(\d{{4}})(?:,?\s+(?:à\s+|um\s+|at\s+)?{_CLOCK})?$"
_MDY = rf"^(?:\p{{L}}{{3,9}}\.?,\s+)?(\p{{L}}{{3,9}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK})?$"
_NUMBER = "regexp_extract(s, '^(\\d{6,19})(?:\\.\\d+)?$', 1)"
_NAMED = lambda p, k: f"CAST({_MONTHS}[lower({_GET(p, k)})] AS VARCHAR)"
_DAY = f"""CASE WHEN regexp_matches(s, '{_ISO}') THEN {_YMD(_GET(_ISO, 1), _GET(_ISO, 2), _GET(_ISO, 3))} WHEN regexp_matches(s, '{_BASIC}') THEN {_YMD(_GET(_BASIC, 1), _GET(_BASIC, 2), _GET(_BASIC, 3))}
 WHEN regexp_matches(s, '{_DOTS}') THEN {_YMD(_GET(_DOTS, 3), _GET(_DOTS, 2), _GET(_DOTS, 1))}
 WHEN regexp_matches(s, '{_SLASH}') THEN CASE WHEN locale = 'en-US' THEN {_YMD(_GET(_SLASH, 3), _GET(_SLASH, 1), _GET(_SLASH, 2))} WHEN locale IS NOT NULL THEN {_YMD(_GET(_SLASH, 3), _GET(_SLASH, 2), _GET(_SLASH, 1))} END
 WHEN regexp_matches(s, '{_DMY}') THEN {_YMD(_GET(_DMY, 3), _NAMED(_DMY, 2), _GET(_DMY, 1))} WHEN regexp_matches(s, '{_MDY}') THEN {_YMD(_GET(_MDY, 3), _NAMED(_MDY, 1), _GET(_MDY, 2))}
 WHEN {_NUMBER} <> '' THEN DATE '1970-01-01' + CAST(floor(CAST({_NUMBER} AS DOUBLE) / CASE WHEN length({_NUMBER}) <= 11 THEN 1 WHEN length({_NUMBER}) <= 14 THEN 1e3 WHEN length({_NUMBER}) <= 17 THEN 1e6 ELSE 1e9 END / 86400) AS INTEGER) END"""
#: The same views in SQL; ``dated`` has all articles with the day that their date text names.
DATED = f"dated AS (SELECT * EXCLUDE (s, locale), {_DAY} AS day FROM (SELECT articles.*, locale, trim(regexp_replace(published_date, '[\\s\\p{{Z}}]+', ' ', 'g'), ' ') AS s FROM articles LEFT JOIN (SELECT name, min(locale) AS locale FROM feeds GROUP BY 1) f ON f.name = articles.source))"
ARTICLES = f"""{DATED}, a AS (SELECT * REPLACE (coalesce(sentiment, 'neutral') AS sentiment, coalesce(word_count, 0) AS word_count, coalesce(relevance_score, 0) AS relevance_score, coalesce(language, 'de') AS language, coalesce(category, 'irrelevant') AS category,
 coalesce(article_type, 'news') AS article_type, coalesce(source, 'Unbekannt') AS source, coalesce(paywall, false) AS paywall) FROM dated WHERE duplicate_of IS NULL AND deleted_at IS NULL)"""
ENTITIES = "e AS (SELECT article_id, entity_type, entity_value, max(mentions) AS mentions, max(in_title) AS in_title, max(confidence) AS confidence, max(created_at) AS created_at FROM article_entities GROUP BY ALL)"
RESONANCE = """r AS (SELECT id, source, article_type, sentiment, sentiment_score, day, CAST(floor(greatest(relevance_score, 1) * (0.5 + least(greatest(coalesce(priority, 50), 0), 100) / 100) *
 greatest(CASE article_type WHEN 'review' THEN 1.0::DOUBLE WHEN 'interview' THEN 0.9::DOUBLE WHEN 'announcement' THEN 0.6::DOUBLE ELSE 0.7::DOUBLE END + CASE WHEN word_count >= 400 THEN 0.3::DOUBLE WHEN word_count < 100 THEN -0.3::DOUBLE ELSE 0.0::DOUBLE END, 0.3::DOUBLE) + 0.5) AS BIGINT) AS resonance
 FROM a LEFT JOIN (SELECT name AS source, priority FROM feeds) f USING (source))"""
