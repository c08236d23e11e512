"""Mixed timestamp notations and time zones, normalised to instants in UTC."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import add_parsed, iso_utc
from ..session import cut, is_small, join_dimension, ship


def zone_intervals(zones: DataFrame) -> DataFrame:
    """(zone, year, from_ms, to_ms, offset_ms): when each UTC offset holds, in local wall-clock time.

    ``zones`` has the columns ``zone`` and ``year`` (1 to 9999, what notations can say); each pair that
    occurs gives the intervals that touch its local year, so that an equi-join on (zone, year) finds
    them. Two intervals overlap where clocks go back and leave a gap where they go forward. The tz
    database has some 600 zones, with a few changes a year, so the table is bounded by the years that
    occur. Names that are no zone, and nulls, give no row.
    """
    ship(sys.modules[__name__])

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from datetime import UTC, datetime, timedelta
        from zoneinfo import ZoneInfo

        day, low, high = 86_400, -62_135_510_400, 253_402_214_400
        epoch = datetime(1970, 1, 1, tzinfo=UTC)
        for batch in batches:
            rows = []
            for name, year in zip(batch["zone"], batch["year"], strict=True):
                try:
                    tz = ZoneInfo(name)
                except Exception:
                    continue
                at = lambda s, tz=tz: (epoch + timedelta(seconds=s)).astimezone(tz).utcoffset() // timedelta(seconds=1)
                year_start = int((datetime(int(year), 1, 1, tzinfo=UTC) - epoch).total_seconds())
                begin, end = max(low, year_start - 2 * day), min(high, year_start + 368 * day)
                start, now, t = begin - 3 * day, at(begin), begin
                while t < end:
                    u = min(t + 5 * day, end)
                    if at(u) != now:
                        a, b = t, u
                        while b - a > 1:
                            m = (a + b) // 2
                            a, b = (m, b) if at(m) == now else (a, m)
                        rows.append((name, year, (start + now) * 1000, (b + now) * 1000, now * 1000))
                        start, now = b, at(b)
                        u = b
                    t = u
                rows.append((name, year, (start + now) * 1000, (end + now + day) * 1000, now * 1000))
            yield pd.DataFrame(rows, columns=["zone", "year", "from_ms", "to_ms", "offset_ms"])

    known = zones.where("zone is not null and year between 1 and 9999").distinct()
    return known.mapInPandas(intervals, "zone string, year int, from_ms bigint, to_ms bigint, offset_ms bigint")


def resolve_local(df: DataFrame, keys: list[str], intervals: DataFrame | None = None) -> DataFrame:
    """As-of join of wall-clock times to zone-offset intervals.

    ``df`` has ``keys``, ``zone``, ``local_ms`` and ``instant_ms``. Rows with an instant keep it; of the
    others one matching interval gives the offset, two mean that the time exists twice and none that
    it never existed (or the zone is unknown): both leave ``instant_ms`` null. Equal rows collapse.
    Without ``intervals`` those of all zones and years that occur are made.
    """
    year = F.year(F.date_from_unix_date(F.floor(F.col("local_ms") / 86_400_000).cast("int")))
    left = df.select(*keys, "instant_ms", "local_ms", F.when(F.col("instant_ms").isNull(), F.col("zone")).alias("zone"), year.alias("year"))
    if intervals is None:
        intervals = cut(zone_intervals(left.where("instant_ms is null").select("zone", "year").distinct()))
    i = intervals.withColumnsRenamed({"zone": "z", "year": "y"})
    i = F.broadcast(i) if is_small(i) else i
    on = (F.col("zone") == F.col("z")) & (F.col("year") == F.col("y")) & (F.col("local_ms") >= F.col("from_ms")) & (F.col("local_ms") < F.col("to_ms"))
    found = left.join(i, on, "left").groupBy(*keys, "instant_ms", "local_ms").agg(F.min("offset_ms").alias("least"), F.max("offset_ms").alias("most"))
    local = F.when(F.col("least") == F.col("most"), F.col("local_ms") - F.col("least"))
    return found.select(*keys, F.coalesce("instant_ms", local).alias("instant_ms"))


def normalise_dates(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """(article_id, field, raw, utc) of ``published_date`` and ``found_date`` of each article.

    utc is null for texts that name no instant. ``published_date`` without zone is local time in the
    feed's ``time_zone``; without a feed or a valid zone it names none. ``found_date`` without zone is
    UTC. Relative values count back from the instant of ``found_date`` and name none without it. Null
    dates give no row. Of several feeds of one name the smallest zone and locale count. Further
    columns are ignored; an empty table gives no row.
    """
    f = feeds.where("name is not null").groupBy(F.col("name").alias("source")).agg(F.min("time_zone").alias("zone"), F.min("locale").alias("locale"))
    a = join_dimension(articles.select(F.col("id").alias("article_id"), "source", "published_date", "found_date"), f, "source")
    a = add_parsed(add_parsed(a, "found_date", "locale", "f_"), "published_date", "locale", "p_")
    found = F.coalesce("f_instant_ms", "f_local_ms")
    none = F.lit(None).cast("bigint")
    rows = F.array(
        F.struct(F.lit("published_date").alias("field"), F.col("published_date").alias("raw"), F.col("zone"), F.coalesce("p_instant_ms", found - F.col("p_back_ms")).alias("instant_ms"), F.col("p_local_ms").alias("local_ms")),
        F.struct(F.lit("found_date").alias("field"), F.col("found_date").alias("raw"), F.lit(None).cast("string").alias("zone"), found.alias("instant_ms"), none.alias("local_ms")),
    )
    each = a.select("article_id", F.explode(rows).alias("r")).select("article_id", "r.*").where("raw is not null")
    done = resolve_local(each, ["article_id", "field", "raw"])
    return done.select("article_id", "field", "raw", iso_utc(F.col("instant_ms")).alias("utc"))
