"""Structure, readability, topics and short forms of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Topics and the folded words that speak for them.
TOPICS = {"premiere": ("premiere", "urauff"), "musik": ("musik", "orgel", "chor", "duett"), "buehne": ("buehnenbild", "kostuem", "licht"), "regie": ("regie", "inszenierung", "dramaturgie"), "publikum": ("publikum", "applaus", "bravo"), "haus": ("spielzeit", "intendanz", "sanierung")}


def metadata(a: DataFrame, text: str = "full_text") -> DataFrame:
    """(id, words, sentences, paragraphs, minutes, readability, structure, topics, preview) of every text; null texts count as empty."""
    s = F.coalesce(F.col(text), F.lit(""))
    d = a.select("id", s.alias("s"), F.coalesce("title", F.lit("")).alias("title")).withColumns({"words": F.size(T.words(F.col("s"))), "sentences": F.size(F.filter(F.split("s", "[.!?]+"), lambda x: F.trim(x) != "")), "paragraphs": F.size(F.filter(F.split("s", r"\n\s*\n"), lambda x: F.trim(x) != ""))})
    per = F.try_divide(F.col("words").cast("double"), F.col("sentences"))
    read = 10 - F.when(per > 25, 4).when(per > 18, 2).otherwise(0) - F.when(F.try_divide(F.col("words").cast("double"), F.col("paragraphs")) > 150, 1).otherwise(0)
    structure = F.when(F.col("paragraphs") >= 5, 5).when(F.col("paragraphs") >= 2, 3).otherwise(0) + F.when(F.col("title") != "", 2).otherwise(0) + F.when(F.col("s").rlike(r"(?m)^\s*[-•*\d]"), 2).otherwise(0)
    f = T.fold(F.col("s"))
    hits = [F.struct((-reduce(Column.__add__, [f.contains(w).cast("int") for w in ws])).alias("n"), F.lit(k).alias("k")) for k, ws in TOPICS.items()]
    topics = F.transform(F.filter(F.array_sort(F.array(*hits)), lambda x: x["n"] < 0), lambda x: x["k"])
    preview = F.array_join(F.slice(T.words(F.col("s")), 1, 20), " ")
    return d.select("id", "words", "sentences", "paragraphs", F.ceil(F.col("words") / 200).cast("int").alias("minutes"), F.greatest(F.lit(1), F.least(read, F.lit(10))).alias("readability"), structure.alias("structure"), F.array_join(topics, ",").alias("topics"), F.when(F.col("words") > 20, F.concat(preview, F.lit("…"))).otherwise(preview).alias("preview"))


def summary(c: Column, title: Column, n: int = 3) -> Column:
    """The ``n`` best of the first ten sentences in their order: early ones and those with words of the title score."""
    s = F.slice(T.sentences(T.collapse(c)), 1, 10)
    t = F.array_distinct(T.ascii_tokens(F.coalesce(title, F.lit(""))))
    scored = F.transform(s, lambda x, i: F.struct((-(F.when(i == 0, 3).otherwise(0) + 2 * F.size(F.array_intersect(F.array_distinct(T.ascii_tokens(x)), t)))).alias("p"), i.alias("i"), x.alias("x")))
    best = F.slice(F.array_sort(scored), 1, n)
    return F.array_join(F.transform(F.array_sort(F.transform(best, lambda b: F.struct(b["i"].alias("i"), b["x"].alias("x")))), lambda b: b["x"]), " ")


def keywords(a: DataFrame, text: str = "full_text", least: int = 5, top: int = 100) -> DataFrame:
    t = a.select(F.explode(F.filter(T.ascii_tokens(F.coalesce(F.col(text), F.lit(""))), lambda w: F.length(w) >= least)).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)
