"""Items that appear together: basket collapsing, pair counts and association scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, is_small


def clean_item(item: Column) -> Column:
    """Lower case, without white space at both ends; null if nothing is left."""
    s = F.regexp_replace(F.lower(item), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    return F.when(s != "", s)


def collapsed_baskets(pairs: DataFrame) -> DataFrame:
    """(items, weight) of distinct (basket, item) rows: identical sorted item arrays, with their number of baskets."""
    return pairs.groupBy("basket").agg(F.array_sort(F.collect_list("item")).alias("items")).groupBy("items").agg(F.count("*").alias("weight"))


def associations(df: DataFrame, basket: str, item: str, min_count: int = 4, min_share: float = 0.001) -> DataFrame:
    """(item_a, item_b, n, a, b, c, lift, conviction_ab, conviction_ba) of pairs found in at least ``min_count`` baskets and ``min_share`` of all.

    n is the number of baskets with any item, a and b those with either item, c those with both;
    item_a < item_b. Items are compared as they are; null baskets and items are skipped, repeated rows
    count once, an empty table gives no row. Conviction is null where it is infinite.

    Items below the least count can be in no pair that qualifies, so they are left out before baskets
    are built; at most ``mean basket size / min_share`` items remain, and no basket, however many
    distinct items it held, is longer than that. Identical baskets are then one row with a weight,
    and each enumerates its pairs once.
    """
    rows = df.select(F.col(basket).alias("basket"), F.col(item).alias("item")).where("basket is not null and item is not null")
    pairs = cut(rows.distinct())
    n = pairs.select(F.col("basket")).distinct().count()
    least = max(min_count, -(-n * int(round(min_share * 1_000_000)) // 1_000_000))
    freq = cut(pairs.groupBy("item").agg(F.count("*").alias("n_item")).where(F.col("n_item") >= least))
    small = is_small(freq, BROADCAST_ROWS)
    side = F.broadcast if small else lambda x: x
    baskets = collapsed_baskets(pairs.join(side(freq.select("item")), "item", "left_semi")).where(F.size("items") > 1)
    first = baskets.select("items", "weight", F.posexplode("items").alias("i", "item_a"))
    both = first.select("item_a", "weight", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))
    counts = both.groupBy("item_a", "item_b").agg(F.sum("weight").alias("c")).where(F.col("c") >= least)
    a, b = (freq.select(F.col("item").alias(f"item_{x}"), F.col("n_item").alias(x)) for x in "ab")
    d = counts.join(side(a), "item_a").join(side(b), "item_b").withColumn("n", F.lit(n).cast("bigint"))
    share = lambda x: F.col(x) / F.col("n")
    conviction = lambda x, y: F.when(F.col("c") < F.col(x), (1 - share(y)) / (1 - F.col("c") / F.col(x)))
    return d.select("item_a", "item_b", "n", "a", "b", "c", (F.col("c") * F.col("n") / (F.col("a") * F.col("b"))).alias("lift"), conviction("a", "b").alias("conviction_ab"), conviction("b", "a").alias("conviction_ba"))


def tag_pairs(article_tags: DataFrame) -> DataFrame:
    """Associations of the tags of each article, tags compared in lower case and trimmed."""
    return associations(article_tags.select("article_id", clean_item(F.col("tag")).alias("tag")), "article_id", "tag")
