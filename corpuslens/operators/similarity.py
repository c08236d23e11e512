"""Duplicates and clusters of articles: candidates by blocks, exact measures, components, winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, join_dimension
from .graph import connected_components
from .ranking import top_per_group


def exact_groups(a: DataFrame, text: str = "full_text") -> DataFrame:
    """Texts that stand more than once (white space aside): their number and first id."""
    d = a.where(F.trim(text) != "").select("id", F.sha2(T.collapse(F.col(text)), 256).alias("h"))
    return d.groupBy("h").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).where("n > 1").select("first_id", "n")


def same_title_pairs(a: DataFrame, least: float = 0.85) -> DataFrame:
    """(a, b, similarity) of articles whose titles share at least half of their words and are similar by edit distance.

    Equal titles (normalised) form a star around the least of their ids; only distinct titles are
    compared. Words are ordered by rarity and each title is filed under its rarest ones, just over half
    of them: two titles that share half of all their words meet under one of these, so nothing is lost,
    and frequent words bring only titles together that have hardly any others.
    """
    t = cut(a.select("id", T.normal_title(F.col("title")).alias("t")).where("t <> ''"))
    head = t.groupBy("t").agg(F.min("id").alias("head"))
    stars = t.join(head, "t").where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    word = head.select("head", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w"))
    rarity = word.groupBy("w").agg(F.count("*").alias("k"))
    ordered = word.join(rarity, "w").groupBy("head", "t").agg(F.array_sort(F.collect_list(F.struct("k", "w"))).alias("ws"))
    filed = cut(ordered.select("head", "t", F.transform("ws", lambda x: x["w"]).alias("ws"), F.explode(F.slice("ws", 1, F.floor(F.size("ws") / 2).cast("int") + 1)).alias("x")).select("head", "t", "ws", F.col("x.w").alias("key")))
    other = filed.select("key", F.col("head").alias("b"), F.col("t").alias("u"), F.col("ws").alias("us"))
    near = filed.join(other, "key").where((F.col("head") < F.col("b")) & (F.abs(F.length("t") - F.length("u")) <= (1 - least) * F.greatest(F.length("t"), F.length("u"))) & (T.jaccard(F.col("ws"), F.col("us")) >= 0.5))
    near = near.select(F.col("head").alias("a"), "b", "t", "u").distinct().withColumn("similarity", F.round(T.similarity(F.col("t"), F.col("u")), 6))
    return near.where(F.col("similarity") >= least).select("a", "b", "similarity").unionByName(stars)


def clusters(a: DataFrame, least: float = 0.85) -> DataFrame:
    """(cluster, id) of articles connected by similar titles; the cluster is its least id."""
    c = connected_components(same_title_pairs(a, least).select("a", "b"))
    return c.select(F.col("component").alias("cluster"), F.col("node").alias("id"))


def winners(a: DataFrame, groups: DataFrame, feeds: DataFrame) -> DataFrame:
    """Of each group the article with the highest priority, then the earliest day, then the least id."""
    p = feeds.select(F.col("name").alias("source"), "priority")
    d = groups.join(a.select("id", "source", "day"), "id").join(p, "source", "left").withColumn("priority", F.coalesce("priority", F.lit(50)))
    order = [F.desc("priority"), F.asc_nulls_last("day"), F.asc("id")]
    return top_per_group(d, ["cluster"], order, salt=["id"]).select("cluster", F.col("id").alias("winner"))


def centroids(e: DataFrame) -> DataFrame:
    """(label, n, spread): the mean vector of each label as the mean cosine of its members to it.

    Means are summed map-side, so that only labels x dimensions are shuffled; each vector then meets its label's mean as one array.
    """
    m = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("m"))
    m = m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("mean"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v)
    cos = dot(F.col("embedding"), F.col("mean")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("mean"), F.col("mean")))
    return join_dimension(e.select("label", "embedding"), m, "label", "inner").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(cos), 4).alias("spread"))
