"""Point lookups, ranked lists, freshness and relations of single articles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Freshness labels and the age in hours each ends at.
FRESHNESS = (("breaking", 1), ("fresh", 6), ("recent", 24), ("week-old", 168))
#: Parts of a hot word in a join; results do not depend on it.
SALTS = 8


def lookup(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with one value in a column; the filter reaches the scan."""
    return df.where(F.col(column) == F.lit(value))


def listed(df: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``position``, from 1, of each row among those of its key."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def freshness(published: Column, now: Column) -> Column:
    """breaking, fresh, recent, week-old, stale or unknown by whole hours of age; what lies in the future is breaking."""
    hours = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))) / 3600)
    out = F.when(published.isNull(), "unknown")
    for label, end in FRESHNESS:
        out = out.when(hours < end, label)
    return out.otherwise("stale")


def breaking_news(a: DataFrame, published: str, now: Column, least: int = 5) -> DataFrame:
    """Articles that are breaking and of at least this relevance, newest first."""
    return a.where((freshness(F.col(published), now) == "breaking") & (F.col("relevance_score") >= least)).orderBy(F.desc(published), "id")


def recency_band(published: Column, today: Column) -> Column:
    """day, week, month or older, by days of age; null without a date."""
    age = F.datediff(today, published)
    return F.when(age < 1, "day").when(age < 7, "week").when(age < 30, "month").when(age.isNotNull(), "older")


def related_by_words(words: DataFrame, queries: DataFrame, least: int = 2, days: int | None = None) -> DataFrame:
    """(id, other, shared): for each row of ``queries`` (id) the rows that share at least ``least`` words with it, within ``days`` if given.

    ``words`` has id, word and, with ``days``, day; repeated rows count once. Joined on word and span of days; words are salted,
    as a few of them stand in a large share of all rows. No word is left out for its frequency.
    """
    span = F.floor(F.unix_date("day") / days) if days else F.lit(0)
    w = words.where("day is not null") if days else words.withColumn("day", F.lit(None).cast("date"))
    w = w.select("id", "word", "day", span.cast("int").alias("span")).distinct()
    x = w.join(queries.select("id").distinct(), "id")
    if days:
        x = x.withColumn("span", F.explode(F.sequence(F.col("span") - 1, F.col("span") + 1)))
    x = x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    y = w.select(F.col("id").alias("other"), "word", F.col("day").alias("other_day"), "span", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    j = x.join(y, ["word", "span", "salt"]).where("id <> other")
    if days:
        j = j.where(F.abs(F.datediff("day", "other_day")) <= days)
    return j.groupBy("id", "other").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def top_words(words: DataFrame, k: int = 10) -> DataFrame:
    """(id, word) of the ``k`` most frequent words of each row, ties by the word. ``words`` has a row an occurrence."""
    n = words.groupBy("id", "word").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= k).select("id", "word")
