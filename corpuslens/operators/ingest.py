"""From feed items to analysed articles: choice of feeds and items, analysis, duplicates, tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import Lexicon
from . import enrich as E


def skip_feed(failures: Column, error: Column, limit: int = 6) -> Column:
    """Whether a feed has failed too often to be asked again: never for a ban, early for what is gone, late for slow ones."""
    n = F.coalesce(failures, F.lit(0))
    return F.when(error == "forbidden", False).when(error.isin("gone", "notfound", "dns"), n >= 5).when(error.isin("timeout", "socket"), n >= 10).otherwise(n >= limit)


def tier(lx: Lexicon, body: str = "summary", short: int = 120) -> Column:
    """2 for items that name a keyword, 1 for those too short to tell, 0 for the rest."""
    text = T.fold(F.concat_ws(" ", "title", body))
    return F.when(E._any(text, (*lx.required, *lx.people)), 2).when(F.length(F.coalesce(body, F.lit(""))) < short, 1).otherwise(0)


def choose_items(items: DataFrame, stored: DataFrame, lx: Lexicon, first: str, last: str, limit: int | None = None) -> DataFrame:
    """New items of a range of days, each address once, best tiers and newest first.

    Items have url, title, summary, day and priority; addresses are compared normalised; an item
    without a day is kept. ``limit`` is the size of one scan, not a cap of the data: what is left over
    is found again by the next one.
    """
    d = items.withColumn("url_normalized", T.normal_url(F.col("url"))).where(F.col("day").isNull() | F.col("day").between(first, last))
    one = Window.partitionBy("url_normalized").orderBy(F.desc("priority"), "url")
    d = d.withColumn("r", F.row_number().over(one)).where("r = 1").drop("r").join(stored.select("url_normalized"), "url_normalized", "left_anti")
    d = d.withColumn("tier", tier(lx)).where("tier > 0")
    return d if limit is None else d.orderBy(F.desc("tier"), F.desc_nulls_last("day"), F.desc("priority"), "url_normalized").limit(limit)


def retag(articles: DataFrame, tags: DataFrame, lx: Lexicon) -> DataFrame:
    """(article_id, tag): stored tags and those of the rules; nothing is taken away."""
    new = E.folded(articles).select(F.col("id").alias("article_id"), F.explode(E.auto_tags(lx)).alias("tag"))
    return tags.where(F.trim("tag") != "").select("article_id", F.trim(F.lower("tag")).alias("tag")).unionByName(new).distinct()


def sentiment_arc(articles: DataFrame, lx: Lexicon) -> DataFrame:
    """(id, n, first, last, trend) of the sentiment of each text's paragraphs: rising, falling or stable from its first to its last quarter."""
    p = articles.where("full_text is not null").select("id", F.posexplode(F.filter(F.split("full_text", r"\n+"), lambda x: F.trim(x) != "")).alias("i", "p")).withColumn("fb", T.fold("p"))
    s = p.select("id", "i", E.sentiment(lx)["score"].alias("s"))
    w = Window.partitionBy("id")
    s = s.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("i"))})
    q = F.greatest(F.floor(F.col("n") / 4), F.lit(1))
    g = s.groupBy("id", "n").agg(F.avg(F.when(F.col("k") <= q, F.col("s"))).alias("first"), F.avg(F.when(F.col("k") > F.col("n") - q, F.col("s"))).alias("last"))
    d = F.col("last") - F.col("first")
    return g.select("id", "n", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.when(d > 0.5, "rising").when(d < -0.5, "falling").otherwise("stable").alias("trend"))


def query_relevance(articles: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(id, score): for each term 3 in the title, 1 in the text and half a point for each further occurrence, by number of terms."""
    d = E.folded(articles)
    total = F.lit(0.0)
    for t in terms:
        n = E._count(F.col("fb"), (t,))
        total = total + F.when(F.col("ft").contains(T._folded(t)), 3.0).otherwise(0.0) + F.when(n > 0, 1 + 0.5 * (n - 1)).otherwise(0.0)
    return d.select("id", F.round(total / len(terms), 6).alias("score"))
