"""Queries on mixed timestamp notations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.timestamps import normalise_dates
from ..session import table


def p4_found(spark, folder):
    """Every date value that names one instant, in UTC."""
    done = normalise_dates(table(spark, folder, "articles"), table(spark, folder, "feeds"))
    return done.where("utc is not null").select("article_id", "field", "utc").distinct()


def p4_report(spark, folder):
    """Values, instants and share without an instant, by source and field."""
    articles = table(spark, folder, "articles")
    done = normalise_dates(articles, table(spark, folder, "feeds"))
    by = done.join(articles.select(F.col("id").alias("article_id"), "source"), "article_id").groupBy("source", "field")
    return by.agg(F.count("*").alias("n_values"), F.count("utc").alias("n_instants")).withColumn("share_unresolved", F.round(1 - F.col("n_instants") / F.col("n_values"), 6))


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}
SQL: dict[str, str] = {}
