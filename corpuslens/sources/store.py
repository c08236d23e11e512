"""The stored tables: conflict-free inserts, upserts and marks as whole-table rewrites, and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(stored: DataFrame, new: DataFrame, key: str = "url_normalized", id_column: str = "id") -> DataFrame:
    """``new`` rows with the id they have now: that of the stored row with their key, or a fresh one; ``inserted`` tells which.

    Of new rows with one key the first by url counts. Fresh ids are hashes of the key, so that two runs agree and no counter is shared.
    """
    one = new.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("url"))).where("__r = 1").drop("__r", id_column)
    known = stored.select(key, F.col(id_column).alias("__known"))
    j = one.join(known, key, "left")
    return j.withColumns({id_column: F.coalesce("__known", F.xxhash64(key)), "inserted": F.col("__known").isNull()}).drop("__known")


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with rows of the same keys replaced; columns that the changes lack keep their values."""
    new = [c for c in changes.columns if c not in keys]
    c = changes.select(*keys, *[F.col(x).alias(f"__{x}") for x in new], F.lit(True).alias("__hit"))
    j = stored.join(c, keys, "full")
    out = [F.when(F.col("__hit"), F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in new else F.col(x) for x in stored.columns]
    return j.select(*out)


def remove(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    return stored.join(rows.select(*keys).distinct(), keys, "left_anti")


def mark_duplicates(stored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Losers point to their winner and lose ``also_on``; winners gain the losers' places, each once, in order of the losers. ``pairs`` has loser, winner."""
    p = pairs.where("loser <> winner").groupBy("loser").agg(F.min("winner").alias("winner"))
    places = stored.select(F.col("id").alias("loser"), F.concat(F.coalesce("also_on", F.array().cast("array<string>")), F.array("url")).alias("more")).join(p, "loser")
    gain = places.groupBy(F.col("winner").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("loser", "more"))), lambda x: x["more"])).alias("more"))
    j = stored.join(p.select(F.col("loser").alias("id"), F.col("winner").alias("__w")), "id", "left").join(gain, "id", "left")
    also = F.when(F.col("__w").isNotNull(), None).when(F.col("more").isNotNull(), F.array_distinct(F.concat(F.coalesce("also_on", F.array().cast("array<string>")), "more"))).otherwise(F.col("also_on"))
    return j.withColumns({"duplicate_of": F.coalesce("__w", "duplicate_of"), "also_on": also}).select(*stored.columns)


def fold_health(log: DataFrame) -> DataFrame:
    """The state of every source after a log of fetches (source, ts, ok, error, status): failures in a row, last times, last error."""
    last = F.struct("ts", "ok")
    ok_ts = F.max(F.when(F.col("ok"), F.col("ts")))
    base = log.groupBy("source").agg(ok_ts.alias("last_success"), F.max(F.when(~F.col("ok"), F.col("ts"))).alias("last_failure"), F.max_by("ok", last).alias("ok"), F.max_by(F.substring("error", 1, 500), F.when(~F.col("ok"), F.col("ts"))).alias("last_error"), F.max_by("status", last).alias("last_status"))
    after = log.join(base.select("source", "last_success"), "source").where("not ok and (last_success is null or ts > last_success)").groupBy("source").agg(F.count("*").alias("consecutive_failures"))
    j = base.join(after, "source", "left")
    return j.select("source", "last_success", "last_failure", F.coalesce("consecutive_failures", F.lit(0)).alias("consecutive_failures"), F.when(~F.col("ok"), F.col("last_error")).alias("last_error"), "last_status")


def csv_line(*columns: Column, sep: str = ";") -> Column:
    """One CSV line: line breaks as blanks, quotation marks doubled, values quoted only where they must be."""
    out = []
    for c in columns:
        s = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
        out.append(F.when(s.rlike(f'["{sep},]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s))
    return F.concat_ws(sep, *out)


def markdown_line(title: Column, url: Column, *badges: Column) -> Column:
    """A list item with a link and badges; brackets are taken out of the label."""
    label = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\[\]]", "")
    extra = F.concat_ws(" · ", *badges)
    return F.concat(F.lit("- ["), label, F.lit("]("), url, F.lit(")"), F.when(extra != "", F.concat(F.lit(" – "), extra)).otherwise(""))


def opml(feeds: DataFrame) -> DataFrame:
    """One OPML document of (name, url, category): feeds by category and name. Feeds are configuration, few by nature."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    line = F.concat(F.lit('<outline type="rss" text="'), esc("name"), F.lit('" xmlUrl="'), esc("url"), F.lit('"/>'))
    by = feeds.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))
    group = F.concat(F.lit('<outline text="'), esc("category"), F.lit('">\n'), F.col("body"), F.lit("\n</outline>"))
    return by.agg(F.concat(F.lit('<?xml version="1.0"?>\n<opml version="2.0"><body>\n'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", group.alias("g")))), lambda x: x["g"]), "\n"), F.lit("\n</body></opml>")).alias("opml"))


def html_card(title: Column, source: Column, score: Column, summary: Column) -> Column:
    from ..functions.text import escape_html as e

    return F.concat(F.lit("<article><h3>"), e(F.coalesce(title, F.lit(""))), F.lit("</h3><p>"), e(F.coalesce(source, F.lit(""))), F.lit(" · "), score.cast("string"), F.lit("</p><p>"), e(F.coalesce(summary, F.lit(""))), F.lit("</p></article>"))
