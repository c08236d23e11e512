"""Best representative of each duplicate group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.ranking import top_per_group
from ..session import cut, join_dimension


def duplicate_groups(articles: DataFrame) -> DataFrame:
    """(article_id, group_id) of articles connected by ``duplicate_of`` in either direction, over any number of steps.

    group_id is the smallest id of the group. Links to missing rows and to the row itself join
    nothing; articles without any link are in no group. Loops, chains and stars are all one group.
    """
    ids = articles.select(F.col("id").alias("to")).where("to is not null").distinct()
    links = articles.select("id", F.col("duplicate_of").alias("to")).where("id is not null and to is not null and id <> to").distinct()
    return connected_components(links.join(ids, "to", "left_semi"), "id", "to").select(F.col("node").alias("article_id"), F.col("component").alias("group_id"))


def ranked_members(articles: DataFrame, feeds: DataFrame, columns: list[str]) -> tuple[DataFrame, list]:
    """Members of all groups with what they are ranked by, and the order: trust, completeness, id."""
    groups = cut(duplicate_groups(articles))
    trust = feeds.where("name is not null").groupBy(F.col("name").alias("source")).agg(F.max("priority").alias("priority"))
    fields = list(dict.fromkeys(["source", "word_count", *columns]))
    own = articles.select(F.col("id").alias("article_id"), *fields).join(groups, "article_id")
    own = join_dimension(own, trust, "source").withColumn("priority", F.coalesce("priority", F.lit(0)))
    return own, [F.desc("priority"), F.desc(F.coalesce("word_count", F.lit(0))), F.asc("article_id")]


def survivors(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """(group_id, survivor_id): of each group the member with the highest feed priority, then word count, then the smallest id.

    A source without a feed (or null) has priority 0, a null word count is 0. Rows repeated under one
    id count once. Groups are ranked by window in two steps, so a group may hold any share of the rows.
    """
    own, order = ranked_members(articles, feeds, [])
    return top_per_group(own, ["group_id"], order, salt=["article_id"]).select("group_id", F.col("article_id").alias("survivor_id"))


def merged_records(articles: DataFrame, feeds: DataFrame, fields: tuple[str, ...] = ("title", "author", "summary", "full_text", "published_date", "language")) -> DataFrame:
    """One record a group, built field by field: group_id, survivor_id, n_members and each field's best value.

    A field takes the value of the first member in rank order in which it is neither null nor blank;
    it is null if no member has one. Minima are aggregated map-side, no group is gathered.
    """
    own, _ = ranked_members(articles, feeds, list(fields))
    rank = F.struct(-F.col("priority"), -F.coalesce("word_count", F.lit(0)), F.col("article_id"))
    best = [F.min_by(f, F.when(F.trim(F.col(f).cast("string")) != "", rank)).alias(f) for f in fields]
    return own.groupBy("group_id").agg(F.min_by("article_id", rank).alias("survivor_id"), F.count_distinct("article_id").alias("n_members"), *best)
