"""Queries on the analysis of articles with the example lexicon."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import EXAMPLE as LX
from ..operators import enrich as E
from .common import ARTICLES, articles
from .text import _FOLD


def _analysed(s, d):
    return E.analyse(articles(s, d), LX)


def _col(c, name):
    return lambda s, d: E.folded(articles(s, d)).select("id", c().alias(name))


def tone_contrast(s, d):
    """Days with both critical and enthusiastic articles."""
    t = E.folded(articles(s, d)).where("day is not null").select("day", E.tone(LX).alias("tone")).groupBy("day").agg(F.count_if(F.col("tone") == "critical").alias("critical"), F.count_if(F.col("tone") == "enthusiastic").alias("enthusiastic"))
    return t.where("critical > 0 and enthusiastic > 0")


QUERIES = {
    "analysis": lambda s, d: _analysed(s, d).select("id", "reason", "kind", F.col("mood.score").alias("mood"), "tone", "depth", "score", "category"),
    "relevance_score": _col(lambda: E.relevance(LX), "score"), "prefilter": _col(lambda: E.prefilter(LX), "reason"), "article_kinds": _col(lambda: E.article_kind(LX), "kind"), "tones": _col(lambda: E.tone(LX), "tone"),
    "sentiment_words": lambda s, d: E.folded(articles(s, d)).select("id", E.sentiment(LX).alias("m")).select("id", "m.score", "m.hits", "m.label"),
    "tone_histogram": lambda s, d: E.folded(articles(s, d)).groupBy(E.tone(LX).alias("tone")).agg(F.count("*").alias("n")), "tone_contrast": tone_contrast,
    "auto_tags": lambda s, d: E.folded(articles(s, d)).select("id", F.explode(E.auto_tags(LX)).alias("tag")),
    "entities_found": lambda s, d: E.folded(articles(s, d)).select("id", F.explode(E.entity_array(LX)).alias("e")).select("id", "e.*"),
    "events_detected": lambda s, d: E.folded(articles(s, d)).select("id", F.explode(E.event_array(LX)).alias("e")).select("id", "e.*"),
    "event_counts": lambda s, d: E.folded(articles(s, d)).select("day", F.explode(E.event_array(LX)).alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"), F.round(F.avg("e.confidence"), 6).alias("confidence"), F.max("day").alias("latest")),
}

_F = f"WITH {ARTICLES}, f AS (SELECT *, {_FOLD('coalesce(title, chr(32))')} AS ft, {_FOLD('concat_ws(chr(32), full_text, summary, first_paragraph)')} AS fb FROM a) "
_q = lambda t: "'" + T._folded(t).replace("'", "''") + "'"
_any = lambda c, ts: "(" + (" OR ".join(f"contains({c}, {_q(t)})" for t in ts) or "false") + ")"
_hits = lambda c, ts: "(" + (" + ".join(f"if(contains({c}, {_q(t)}), 1, 0)" for t in ts) or "0") + ")"
_count = lambda c, ts: "(" + (" + ".join(f"(length({c}) - length(replace({c}, {_q(t)}, ''))) // {len(T._folded(t))}" for t in ts) or "0") + ")"
_best = lambda pairs, none: "CASE " + " ".join("WHEN " + " AND ".join(f"{n} >= {m}" for _, m in pairs if m != n) + f" AND {n} > 0 THEN '{k}'" for k, n in pairs) + f" ELSE '{none}' END"
_TEXT = "concat_ws(' ', ft, fb)"
_KIND = _best([(k, _hits(_TEXT, LX.kinds[k])) for k in ("review", "interview", "announcement")], "news")
_TONE = _best([(k, _count("fb", ws)) for k, ws in LX.tones.items()], "neutral_reporting")
_rule = lambda r: " AND ".join([*([f"sentiment = '{r.sentiment}'"] if r.sentiment else []), *([f"category = '{r.category}'"] if r.category else []), *([f"paywall = {str(r.paywall).lower()}"] if r.paywall is not None else []), *([_any(_TEXT, r.any_text)] if r.any_text else []), *(f"contains({_TEXT}, {_q(x)})" for x in r.all_text)])
_ENT = " UNION ALL ".join(f"SELECT id, '{k}' AS type, '{n}' AS value, CAST({_count('fb', (n,))} + if(contains(ft, {_q(n)}), 1, 0) AS INTEGER) AS mentions, contains(ft, {_q(n)}) AS in_title FROM f" for k, ns in (("person", LX.people), ("production", LX.productions), ("venue", LX.venues)) for n in ns)
_first = lambda ns: "CASE " + " ".join(f"WHEN contains({_TEXT}, {_q(n)}) THEN '{n}'" for n in ns) + " ELSE '-' END"
_EV = f"""SELECT id, day, 'premiere' AS type, 0.8::DOUBLE AS confidence, {_first(LX.productions)} AS what FROM f WHERE regexp_matches({_TEXT}, 'premiere|urauff') AND {_any(_TEXT, LX.productions)}
 UNION ALL SELECT id, day, 'casting', 0.7::DOUBLE, {_first(LX.people)} FROM f WHERE regexp_matches({_TEXT}, 'es spielen|besetzung|in der regie von|uebernimmt') AND {_any(_TEXT, LX.people)}
 UNION ALL SELECT id, day, 'festival_or_tour', 0.6::DOUBLE, '-' FROM f WHERE regexp_matches({_TEXT}, 'festival|gastspiel|tournee') UNION ALL SELECT id, day, 'milestone', 0.5::DOUBLE, '-' FROM f WHERE regexp_matches({_TEXT}, 'jubilaeum|auszeichnung|preis fuer')"""
SQL = {
    "prefilter": _F + f"SELECT id, CASE WHEN NOT ({_any('ft', LX.required)} OR {_any('fb', LX.required)} OR {_any('fb', LX.people)} OR {_any('fb', [p for p in LX.productions if len(p) >= 8])}) THEN 'no keyword' WHEN {_any('ft', LX.exclude_title)} THEN 'excluded title' ELSE '' END AS reason FROM f",
    "article_kinds": _F + f"SELECT id, {_KIND} AS kind FROM f", "tones": _F + f"SELECT id, {_TONE} AS tone FROM f", "tone_histogram": _F + f"SELECT {_TONE} AS tone, count(*) AS n FROM f GROUP BY 1",
    "tone_contrast": _F + f"SELECT day, count(*) FILTER (t = 'critical') AS critical, count(*) FILTER (t = 'enthusiastic') AS enthusiastic FROM (SELECT day, {_TONE} AS t FROM f WHERE day IS NOT NULL) GROUP BY day HAVING critical > 0 AND enthusiastic > 0",
    "auto_tags": _F + " UNION ALL ".join(f"SELECT id, '{r.tag}' AS tag FROM f WHERE {_rule(r)}" for r in LX.rules),
    "entities_found": _F + f"SELECT * FROM ({_ENT}) WHERE mentions > 0", "events_detected": _F + f"SELECT id, type, confidence, what FROM ({_EV})", "event_counts": _F + f"SELECT type, count(*) AS n, round(avg(confidence), 6) AS confidence, max(day) AS latest FROM ({_EV}) GROUP BY type",
}
