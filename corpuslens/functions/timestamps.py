"""Date and time notations of feeds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Month names in German, English and French, with their usual short forms.
MONTHS = {
    1: "januar jänner jan january janvier janv", 2: "februar feber feb february février fevrier févr fevr",
    3: "märz maerz mär mrz march mar mars", 4: "april apr avril avr", 5: "mai may", 6: "juni jun june juin",
    7: "juli jul july juillet juil", 8: "august aug août aout", 9: "september sep sept septembre",
    10: "oktober okt october oct octobre", 11: "november nov novembre", 12: "dezember dez december dec décembre decembre déc",
}
#: Zone abbreviations that name one offset, in minutes east of Greenwich.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "mez": 60, "cet": 60, "met": 60, "mesz": 120, "cest": 120, "mest": 120, "eet": 120, "eest": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}
#: Units of relative times, in milliseconds.
UNITS = {
    1_000: "sekunde sekunden second seconds seconde secondes", 60_000: "minute minuten minutes", 3_600_000: "stunde stunden hour hours heure heures",
    86_400_000: "tag tage tagen day days jour jours", 604_800_000: "woche wochen week weeks semaine semaines",
}

_ZONE = r"\s*(Z|[+-]\d{2}:?\d{2}|[+-]\d{2}|\p{L}{2,4})?"
_CLOCK = r"(\d{1,2})[:.h](\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_HALF = r"\s*([aApP]\.?[mM]\.?)?"
#: (pattern, its groups as year|month|day|hour|minute|second|fraction|half of day|zone|order); the first that fits counts.
NOTATIONS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:(?:[Tt]|\s+)(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?" + _ZONE + "$", "$1|$2|$3|$4|$5|$6|$7||$8|"),
    (r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})(?:,?\s+(?:um\s+)?" + _CLOCK + r"(?:\s*Uhr)?" + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7||$8|"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:,?\s+" + _CLOCK + _HALF + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|slash"),
    (r"^(?:\p{L}{2,10}\.?,?\s+)?(\d{1,2})(?:\.|er)?\s+(\p{L}{3,9})\.?\s+(\d{4})(?:,?\s+(?:à\s+|um\s+|at\s+)?" + _CLOCK + _HALF + r"(?:\s*Uhr)?" + _ZONE + ")?$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|"),
    (r"^(?:\p{L}{3,9}\.?,\s+)?(\p{L}{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})(?:,?\s+(?:at\s+)?" + _CLOCK + _HALF + _ZONE + ")?$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|"),
)
_RELATIVE = r"(?i)^(?:vor\s+|il\s+y\s+a\s+)?(\d{1,5}|eine[rmns]?|ein|an?|one|une?)\s+(\p{L}+)(?:\s+ago)?$"
_IS_RELATIVE = r"(?i)^(?:(?:vor|il\s+y\s+a)\s+\S+\s+\p{L}+|\S+\s+\p{L}+\s+ago)$"
#: Words for whole days back.
DAYS_BACK = {"heute": 0, "gestern": 1, "vorgestern": 2, "today": 0, "yesterday": 1, "aujourd’hui": 0, "aujourd'hui": 0, "hier": 1, "avant-hier": 2}


def _lookup(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _words(table: dict) -> Column:
    return _lookup({w: k for k, words in table.items() for w in words.split()})


def add_parsed(df: DataFrame, raw: str, locale: str | None = None, prefix: str = "") -> DataFrame:
    """``df`` with instant_ms, local_ms and back_ms (under ``prefix``) of the date text in column ``raw``.

    At most one of the three is not null. instant_ms: the value names an instant itself (zone, offset
    or Unix time); local_ms: a wall-clock time without zone, in milliseconds as if it were UTC;
    back_ms: a time before now. All are null for null, empty and useless texts, impossible dates
    (31.02.) and clock times, and dates with slashes where column ``locale`` is null. A missing clock
    time is 00:00; digits finer than milliseconds are dropped.

    The steps are columns of their own, each used by name, so that no expression is repeated in the plan.
    """
    at = lambda n: f"__{prefix}{n}"
    c = lambda n: F.col(at(n))
    number = lambda x: F.when(x != "", x).try_cast("int")
    df = df.withColumn(at("s"), F.trim(F.regexp_replace(raw, r"[\s\p{Z}]+", " ")))
    df = df.withColumn(at("x"), F.split(F.coalesce(*[F.when(c("s").rlike(p), F.regexp_replace(c("s"), p, t)) for p, t in NOTATIONS]), r"\|"))
    us = F.col(locale) == "en-US" if locale else F.lit(False)
    slash = c("x")[9] == "slash"
    df = df.withColumns({
        at("mid"): F.lower(F.when(slash & us, c("x")[2]).otherwise(c("x")[1])), at("day"): number(F.when(slash & us, c("x")[1]).otherwise(c("x")[2])), at("year"): number(c("x")[0]) + F.when(F.length(c("x")[0]) == 2, 2000).otherwise(0),
        at("half"): F.lower(F.regexp_replace(c("x")[7], r"\.", "")), at("hour"): F.when(c("x")[3] == "", 0).otherwise(number(c("x")[3])), at("minute"): F.coalesce(number(c("x")[4]), F.lit(0)), at("second"): F.coalesce(number(c("x")[5]), F.lit(0)),
        at("ms"): F.coalesce(F.rpad(F.substring(c("x")[6], 1, 3), 3, "0").try_cast("int"), F.lit(0)), at("zone"): F.when(c("x")[8] != "", F.lower(c("x")[8])), at("lost"): slash & (F.col(locale).isNull() if locale else F.lit(True)),
        at("n"): F.regexp_extract(c("s"), r"^(\d{6,19})(?:\.\d+)?$", 1), at("fraction"): F.coalesce(F.rpad(F.substring(F.regexp_extract(c("s"), r"^\d{6,11}\.(\d+)$", 1), 1, 3), 3, "0").try_cast("int"), F.lit(0)),
        at("count"): F.regexp_extract(c("s"), _RELATIVE, 1), at("unit"): F.lower(F.regexp_extract(c("s"), _RELATIVE, 2)),
    })
    hour = F.when(c("half") == "", c("hour")).when(~c("hour").between(1, 12), None).when(c("half") == "pm", c("hour") % 12 + 12).otherwise(c("hour") % 12)
    df = df.withColumns({
        at("hour"): hour, at("month"): F.coalesce(number(c("mid")), F.try_element_at(_words(MONTHS), c("mid"))), at("digits"): F.regexp_replace(c("zone"), "[^0-9]", ""), at("value"): c("n").try_cast("bigint"),
    })
    zero = F.lit(0)
    df = df.withColumns({
        at("date"): F.unix_millis(F.try_make_timestamp(c("year"), c("month"), c("day"), zero, zero, zero.cast("decimal(16,6)"), F.lit("UTC"))),
        at("fits"): c("hour").between(0, 23) & c("minute").between(0, 59) & c("second").between(0, 59) & ~F.coalesce(c("lost"), F.lit(False)),
        at("offset"): F.when(c("zone").rlike("^[+-]"), F.when(c("zone").startswith("-"), -1).otherwise(1) * (F.substring(c("digits"), 1, 2).try_cast("int") * 60 + F.coalesce(F.substring(c("digits"), 3, 2).try_cast("int"), zero))).otherwise(F.try_element_at(_lookup(ZONES), c("zone"))),
        at("unix"): F.when(F.length(c("n")).between(6, 11), c("value") * 1000 + c("fraction")).when(F.length(c("n")).between(12, 14), c("value")).when(F.length(c("n")).between(15, 17), F.floor(c("value") / 1000)).when(F.length(c("n")).between(18, 19), F.floor(c("value") / 1_000_000)),
        at("back"): F.when(c("s").rlike(_IS_RELATIVE), F.try_element_at(_words(UNITS), c("unit")) * F.coalesce(c("count").try_cast("bigint"), F.when(c("count") != "", F.lit(1)))),
    })
    df = df.withColumn(at("wall"), F.when(c("fits"), c("date") + c("hour") * 3_600_000 + c("minute") * 60_000 + c("second") * 1000 + c("ms")).cast("bigint"))
    df = df.withColumns({
        f"{prefix}instant_ms": F.coalesce(c("unix"), F.when(c("zone").isNotNull(), c("wall") - c("offset") * 60_000)).cast("bigint"), f"{prefix}local_ms": F.when(c("zone").isNull(), c("wall")),
        f"{prefix}back_ms": F.coalesce(c("back"), F.try_element_at(_lookup(DAYS_BACK), F.lower(c("s"))) * F.lit(86_400_000)).cast("bigint"),
    })
    return df.drop(*[x for x in df.columns if x.startswith(f"__{prefix}")])


def add_day(df: DataFrame, raw: str, locale: str | None = None, name: str = "day") -> DataFrame:
    """``df`` with the calendar day that the date text in column ``raw`` names, as written, whatever its zone; Unix times count in UTC.

    Null for relative and useless values, impossible days, and dates with slashes where column ``locale`` is null.
    """
    s, x = F.col("__day_s"), F.col("__day_x")
    us, slash = (F.col(locale) == "en-US" if locale else F.lit(False)), x[9] == "slash"
    mid, day = F.lower(F.when(slash & us, x[2]).otherwise(x[1])), F.when(slash & us, x[1]).otherwise(x[2])
    month = F.coalesce(F.when(mid != "", mid).try_cast("int"), F.try_element_at(_words(MONTHS), mid))
    year = F.when(F.length(x[0]) == 2, F.concat(F.lit("20"), x[0])).otherwise(x[0])
    lost = slash & (F.col(locale).isNull() if locale else F.lit(True))
    written = F.when(~F.coalesce(lost, F.lit(False)), F.try_to_date(F.concat_ws("-", year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"))
    n = F.regexp_extract(s, r"^(\d{6,19})(?:\.\d+)?$", 1)
    value, size = F.when(n != "", n).try_cast("bigint"), F.length(n)
    seconds = F.when(size <= 11, value).when(size.between(12, 14), value / 1000).when(size.between(15, 17), value / 1_000_000).when(size >= 18, value / 1_000_000_000)
    df = df.withColumn("__day_s", F.trim(F.regexp_replace(raw, r"[\s\p{Z}]+", " ")))
    df = df.withColumn("__day_x", F.split(F.coalesce(*[F.when(s.rlike(p), F.regexp_replace(s, p, t)) for p, t in NOTATIONS]), r"\|"))
    return df.withColumn(name, F.coalesce(written, F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")))).drop("__day_s", "__day_x")


def iso_utc(ms: Column) -> Column:
    """``2026-05-01T08:03:04.123Z`` of milliseconds since 1970, whatever the session's time zone."""
    day = F.floor(ms / 86_400_000)
    rest = (ms - day * 86_400_000).cast("bigint")
    two = lambda c: F.lpad(F.floor(c).cast("string"), 2, "0")
    clock = F.concat_ws(":", two(rest / 3_600_000), two(rest % 3_600_000 / 60_000), two(rest % 60_000 / 1000))
    return F.concat(F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"), clock, F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"))
