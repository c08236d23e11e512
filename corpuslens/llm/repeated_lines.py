"""Lines repeated across one source's documents, by incremental per-source line-count tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, cut, is_small, path_exists, scratch


def clean_line(line: Column) -> Column:
    """Without outer white space, each inner run (no-break spaces too) one blank."""
    return F.trim(F.regexp_replace(line, r"[\s\p{Z}\x{feff}]+", " "))


def line_array(text: Column) -> Column:
    """The cleaned lines of a text, blank ones too; equal to ``clean_line`` of each, but in one pass over the text, in which only what has such runs is replaced."""
    runs = text.contains("  ") | text.rlike(r"[\s\p{Z}\x{feff}&&[^\n ]]")
    cleaned = F.trim(F.when(runs, F.regexp_replace(text, r"[\s\p{Z}\x{feff}&&[^\n]]+", " ")).otherwise(text))
    of = lambda s: F.when(s.contains(" \n") | s.contains("\n "), F.split(s, " ?\n ?")).otherwise(F.split(s, "\n"))
    return F.element_at(F.transform(F.array(cleaned), of), 1)


@dataclass
class LineCounts:
    """Tables of one corpus: documents by (source, line) and documents by source.

    ``lines`` has source, key (two 64-bit hashes of the line), n_docs; ``sources`` has source, n_docs.
    Both are replaced, never changed in place, by ``merge``.
    """

    lines: DataFrame
    sources: DataFrame


def _keys(docs: DataFrame) -> DataFrame:
    line = F.explode(F.array_distinct(F.filter(line_array(F.col("text")), lambda x: x != "")))
    return docs.where("source is not null and text is not null").select("source", F.xxhash64("text").alias("at"), line.alias("line")).select("source", "at", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def _added(lines: DataFrame) -> list[Column]:
    return [F.sum("n_docs").alias("n_docs"), *[F.min("at").alias("at") for c in lines.columns if c == "at"]]


def delta(docs: DataFrame, located: bool = False) -> LineCounts:
    """Counts of one partition of new documents (id, source, text); ``located``: each line also has in ``at`` the hash of a text that holds it."""
    found = [F.count("*").alias("n_docs"), *[F.min("at").alias("at")] * located]
    return LineCounts(_keys(docs).groupBy("source", "h1", "h2").agg(*found), docs.where("source is not null").groupBy("source").agg(F.count("*").alias("n_docs")))


def merge(state: LineCounts | None, new: LineCounts) -> LineCounts:
    """The state with a delta added; equal keys add up."""
    if state is None:
        return LineCounts(cut(new.lines), cut(new.sources))
    add = lambda a, b, keys: cut(a.unionByName(b).groupBy(*keys).agg(*_added(a)))
    return LineCounts(add(state.lines, new.lines, ["source", "h1", "h2"]), add(state.sources, new.sources, ["source"]))


def over_threshold(state: LineCounts, min_docs: int = 5, min_percent: int = 5) -> DataFrame:
    """(source, h1, h2, and at, if the state has it) of lines in at least ``min_docs`` documents and ``min_percent`` % of the source's documents.

    Of a source with n documents at most ``lines per document * 100 / min_percent`` lines can qualify.
    """
    n = state.sources.select("source", F.col("n_docs").alias("n_source"))
    n = F.broadcast(n) if is_small(n, BROADCAST_ROWS) else n
    often = state.lines.where(F.col("n_docs") >= min_docs).join(n, "source")
    return often.where(F.col("n_docs") * 100 >= F.col("n_source") * min_percent).select("source", "h1", "h2", *[c for c in state.lines.columns if c == "at"])


def crossings(before: DataFrame | None, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys that are newly over the threshold, and keys that no longer are (the source grew)."""
    if before is None:
        return after, after.limit(0)
    return after.join(before, ["source", "h1", "h2"], "left_anti"), before.join(after, ["source", "h1", "h2"], "left_anti")


def _lines(docs: DataFrame) -> DataFrame:
    each = docs.where("source is not null and text is not null").select("id", "source", F.posexplode(line_array(F.col("text"))).alias("i", "line")).where("line <> ''")
    return each.select("id", "source", "i", "line", F.xxhash64("line").alias("h1"), F.hash("line").alias("h2"))


def _marked(docs: DataFrame, keys: DataFrame) -> DataFrame:
    keys = F.broadcast(keys) if is_small(keys, BROADCAST_ROWS) else keys
    return _lines(docs).join(keys, ["source", "h1", "h2"], "left_semi")


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(source, line) of the keys, read back from the documents that hold them; if the keys have ``at``, from those texts only."""
    if "at" in keys.columns:
        at = keys.select("at").distinct()
        docs = docs.select("id", "source", "text").withColumn("at", F.xxhash64("text")).join(F.broadcast(at) if is_small(keys, BROADCAST_ROWS) else at, "at", "left_semi")
    return _marked(docs, keys).select("source", "line").distinct()


def _apply(over: DataFrame | None, after: DataFrame) -> DataFrame:
    """The keys over the threshold, brought up to date by the crossings."""
    new, lapsed = crossings(over, after)
    return cut(new if over is None else over.join(lapsed, ["source", "h1", "h2"], "left_anti").unionByName(new))


def by_deltas(docs: DataFrame, partitions: int = 2, min_docs: int = 5, min_percent: int = 5) -> tuple[LineCounts, DataFrame]:
    """The whole corpus merged as ``partitions`` deltas; the state, and the keys over the threshold as the crossings of each delta left them, with ``at``."""
    state, over = None, None
    for k in range(partitions):
        part = docs.where(F.pmod(F.hash("id"), F.lit(partitions)) == k) if partitions > 1 else docs
        state = merge(state, delta(part, located=True))
        over = _apply(over, over_threshold(state, min_docs, min_percent))
    return state, over


class LineState:
    """Line counts, occurrences and crossed lines of a growing corpus, kept as tables in a shared folder.

    Each ``advance`` writes a new version: ``lines`` and ``sources`` (counts), ``over`` (keys over the
    threshold), ``at`` (id, source, i, h1, h2 of the delta's own lines) and ``rebuilt``, last. A version counts
    once its last table is complete, so that a run that was broken off is done again from the one before;
    another session goes on from where this one ended.
    """

    def __init__(self, spark, folder: str, min_docs: int = 5, min_percent: int = 5):
        self.spark, self.folder, self.min_docs, self.min_percent = spark, folder.rstrip("/"), min_docs, min_percent

    def versions(self) -> int:
        """How many complete versions the folder holds."""
        n = 0
        while path_exists(self.spark, f"{self.folder}/v{n}/rebuilt/_SUCCESS"):
            n += 1
        return n

    def table(self, version: int, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{version}/{name}")

    def _put(self, version: int, name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.folder}/v{version}/{name}")
        return self.table(version, name)

    def advance(self, new_docs: DataFrame, docs: DataFrame) -> DataFrame:
        """(id, source, text, n_dropped) of the documents that ``new_docs`` makes necessary to rebuild.

        ``docs`` has all documents so far, the new ones too. Rebuilt are documents that hold a line which is newly
        over the threshold or no longer over it, and new ones that hold a line over it; no other text is read.
        """
        v = self.versions()
        keys = ["source", "h1", "h2"]
        part = delta(new_docs)
        lines, sources = part.lines, part.sources
        if v:
            add = lambda a, b, by: a.unionByName(b).groupBy(*by).agg(F.sum("n_docs").alias("n_docs"))
            lines, sources = add(self.table(v - 1, "lines"), lines, keys), add(self.table(v - 1, "sources"), sources, ["source"])
        state = LineCounts(self._put(v, "lines", lines), self._put(v, "sources", sources))
        before = self.table(v - 1, "over") if v else None
        over = self._put(v, "over", over_threshold(state, self.min_docs, self.min_percent))
        here = self._put(v, "at", _lines(new_docs).select("id", "i", *keys))
        new, lapsed = crossings(before, over)
        side = lambda d: F.broadcast(d) if is_small(d, BROADCAST_ROWS) else d
        every = here
        for k in range(v):
            every = every.unionByName(self.table(k, "at"))
        crossed = cut(new.unionByName(lapsed))
        touched = every.join(side(crossed), keys, "left_semi").select("id").unionByName(here.join(side(over), keys, "left_semi").select("id")).distinct()
        touched = cut(touched)
        drop = every.join(touched, "id", "left_semi").join(side(over), keys, "left_semi").groupBy("id").agg(F.collect_set("i").alias("drop"))
        kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("drop", i))
        text = F.when(F.col("drop").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col("text"))
        again = docs.join(touched, "id").join(drop, "id", "left")
        return self._put(v, "rebuilt", again.select("id", "source", text.alias("text"), F.coalesce(F.size("drop"), F.lit(0)).alias("n_dropped")))

    def rebuilt(self) -> DataFrame:
        """(id, text, n_dropped, times) of every document rebuilt so far, as its last version left it."""
        parts = [self.table(v, "rebuilt").withColumn("v", F.lit(v)) for v in range(self.versions())]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("id").agg(F.max_by(F.struct("text", "n_dropped"), "v").alias("r"), F.count_distinct("v").alias("times")).select("id", "r.text", "r.n_dropped", "times")


def repeated_lines(docs: DataFrame, partitions: int = 2) -> DataFrame:
    """(source, line) of lines in at least 5 documents and 5 % of all documents of their source.

    ``docs`` has id, source and text. Null sources are none; documents without text count for their
    source; a line counts once a document; blank lines never count; rows repeated under one id count
    as often as they stand. Lines are compared without outer white space and with each inner run as
    one blank. An empty table gives no row.
    """
    _, over = by_deltas(docs, partitions)
    return texts_of(docs, over)


def without_repeated_lines(docs: DataFrame, partitions: int = 3, folder: str | None = None) -> DataFrame:
    """(id, source, text, rebuilt) of every document, without the repeated lines of its source.

    The corpus comes as ``partitions`` deltas; each rebuilds only the documents its crossings touch (see
    ``LineState``). The state stays in ``folder`` or, without one, in the shared checkpoint folder.
    Documents without id or source stay as they are.
    """
    spark = docs.sparkSession
    state = LineState(spark, folder or scratch(spark, "lines"))
    part = F.pmod(F.hash("id"), F.lit(partitions))
    for k in range(partitions):
        state.advance(docs.where(part == k), docs.where(part <= k))
    new = state.rebuilt().where("n_dropped > 0").select("id", F.col("text").alias("new"))
    return docs.join(new, "id", "left").select("id", "source", F.coalesce("new", "text").alias("text"), F.col("new").isNotNull().alias("rebuilt"))
