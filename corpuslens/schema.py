"""Canonical columns and adapters of the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.timestamps import add_day

#: Text that stands for a missing source in reports.
UNKNOWN = "Unbekannt"


def with_days(articles: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Articles with ``day`` (from ``published_date``, in any notation) and the usual defaults. Dates with slashes need the locale of ``feeds``."""
    if feeds is None:
        dated = add_day(articles, "published_date")
    else:
        f = feeds.where("name is not null").groupBy(F.col("name").alias("__name")).agg(F.min("locale").alias("__locale"))
        dated = add_day(articles.join(f, articles["source"] == f["__name"], "left"), "published_date", "__locale").drop("__name", "__locale")
    return dated.withColumns({
        "sentiment": F.coalesce("sentiment", F.lit("neutral")), "word_count": F.coalesce("word_count", F.lit(0)), "relevance_score": F.coalesce("relevance_score", F.lit(0)),
        "language": F.coalesce("language", F.lit("de")), "category": F.coalesce("category", F.lit("irrelevant")), "article_type": F.coalesce("article_type", F.lit("news")), "source": F.coalesce("source", F.lit(UNKNOWN)), "paywall": F.coalesce("paywall", F.lit(False)),
    })


def canonical(articles: DataFrame) -> DataFrame:
    """Rows that are neither duplicates nor deleted."""
    return articles.where("duplicate_of is null and deleted_at is null")


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounding half up toward plus infinity."""
    f = 10**digits
    return F.floor(x * f + 0.5) / f


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """part / whole, rounded; null where there is nothing to share."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)
