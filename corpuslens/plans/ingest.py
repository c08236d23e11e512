"""Queries of the way from feed items to analysed articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lexicon import EXAMPLE as LX
from ..operators import enrich as E
from ..operators import ingest as I
from ..session import table
from .common import ARTICLES, articles
from .enrichment import _F, _any, _count, _q
from .relational import feeds_health


def chosen_items(s, d):
    """Articles as feed items against the canonical ones of the first half of the time: what is new."""
    a = articles(s, d)
    p = table(s, d, "feeds").select(F.col("name").alias("source"), "priority")
    items = a.join(p, "source", "left").select("url", "title", "summary", "day", F.coalesce("priority", F.lit(50)).alias("priority"))
    stored = a.where("day < '2025-07-01'").select("url_normalized")
    return I.choose_items(items, stored, LX, "2025-01-01", "2026-12-31").select("url_normalized", "tier", "day")


def tiers(s, d):
    return articles(s, d).select(I.tier(LX).alias("tier")).groupBy("tier").agg(F.count("*").alias("n"))


QUERIES = {
    "chosen_items": chosen_items, "item_tiers": tiers, "auto_skip": lambda s, d: feeds_health(s, d).select("source", I.skip_feed(F.col("failures"), F.col("error")).alias("skip")),
    "retag": lambda s, d: I.retag(articles(s, d), table(s, d, "article_tags"), LX), "sentiment_arcs": lambda s, d: I.sentiment_arc(articles(s, d), LX), "query_relevance": lambda s, d: I.query_relevance(articles(s, d), ("Nachtlicht", "Premiere")),
    "reanalysis": lambda s, d: E.analyse(table(s, d, "articles").where("deleted_at is null").withColumns({"word_count": F.coalesce("word_count", F.lit(0)), "paywall": F.coalesce("paywall", F.lit(False))}), LX).groupBy("kind", "category", F.col("mood.label").alias("label")).agg(F.count("*").alias("n")),
}

from .relational import _HEALTH  # noqa: E402

_one = lambda t: f"if(contains(ft, {_q(t)}), 3.0::DOUBLE, 0) + if({_count('fb', (t,))} > 0, 1 + 0.5::DOUBLE * ({_count('fb', (t,))} - 1), 0)"
from .enrichment import _rule  # noqa: E402
from .text import _FOLD  # noqa: E402

_TIER = f"CASE WHEN {_any('x', (*LX.required, *LX.people))} THEN 2 WHEN length(coalesce(summary, '')) < 120 THEN 1 ELSE 0 END"
SQL = {
    "item_tiers": f"WITH {ARTICLES}, t AS (SELECT *, {_FOLD('concat_ws(chr(32), title, summary)')} AS x FROM a) SELECT {_TIER} AS tier, count(*) AS n FROM t GROUP BY 1",
    "auto_skip": f"WITH {_HEALTH} SELECT source, CASE WHEN error = 'forbidden' THEN false WHEN error IN ('gone', 'notfound', 'dns') THEN coalesce(failures, 0) >= 5 WHEN error IN ('timeout', 'socket') THEN coalesce(failures, 0) >= 10 ELSE coalesce(failures, 0) >= 6 END AS skip FROM k",
    "query_relevance": _F + f"SELECT id, round(({_one('Nachtlicht')} + {_one('Premiere')}) / 2, 6) AS score FROM f",
    "retag": _F + "SELECT DISTINCT article_id, trim(lower(tag), ' ') AS tag FROM article_tags WHERE trim(tag, ' ') <> '' UNION " + " UNION ".join(f"SELECT id, '{r.tag}' FROM f WHERE {_rule(r)}" for r in LX.rules),
}
