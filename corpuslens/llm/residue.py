"""Template residue, filler, error pages and script notices: SimHash tables, components and trusted labels."""

from __future__ import annotations

import html
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut, join_dimension, ship, written
from . import residue_rules as R

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, and how many of them may differ between two lines of ``SIMILARITY``: 15 % on average, five standard deviations more at most; in the whole and in its lower half.
BITS = 128
HAMMING, HAMMING_LOW = 40, 24
#: The chance that two lines of ``SIMILARITY`` meet in a table at least; the number of tables follows from it.
RECALL = 0.95
#: Beyond so many lines of one table entry those near one of them are not compared with each other.
MANY = 100
#: The share of its shingles that a line must have in common with labelled lines to be searched for near-duplicates, and the one from which all its neighbours have that.
POOL, CLOSED = 0.4, 0.7
#: A segment recurs in so many different pages; it takes a label at this score, once no score rises by more than ``SETTLED``.
PAGES, LABELLED, SETTLED = 3, 0.35, 0.02
#: A word is filler if so many lines hold it, and this share of them is filler.
WORD_LINES, WORD_SHARE = 5, 0.8

_COMPILED: dict = {}


def _rules() -> dict:
    if not _COMPILED:
        import regex

        names = ("PLACEHOLDER", "QUOTED_PLACEHOLDER", "QUOTED", "ERROR", "SCRIPT", "REPEATED", "SELF_NAMED")
        _COMPILED.update({n: regex.compile(getattr(R, n)) for n in names})
        _COMPILED["SENTENCE"], _COMPILED["PART"] = regex.compile(r"(?<=[.!?…])\s+"), regex.compile(r"\s+[–|]\s+")
        _COMPILED["MASK"] = regex.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\d+")
        _COMPILED["PASSAGE"] = frozenset(R.PASSAGE)
    return _COMPILED


def clean_lines(text: str | None) -> list[str]:
    """The distinct non-blank lines in order: composed letters, entities resolved, white space as single blanks."""
    s = text or ""
    if "&" in s:
        s = html.unescape(s)
    s = unicodedata.normalize("NFC", s)
    return list(dict.fromkeys(y for x in s.split("\n") if (y := " ".join(x.split()))))


_DIGIT, _NUMBER, _DELIMITER = re.compile(r"\d"), re.compile("[0-9]"), re.compile(r"[{\[$#@%<_]")


def masked(s: str) -> str:
    """Lower case, numbers and hexadecimal ids as 0."""
    return _rules()["MASK"].sub("0", s.lower()) if _DIGIT.search(s) else s.lower()


def sign_of(segment: str) -> tuple[str, bool] | None:
    """(kind, whole) of a segment with a trusted sign, and whether it makes up most of it. What stands in quotation marks is spoken about and no sign."""
    c = _rules()
    if _DELIMITER.search(segment):
        found = c["PLACEHOLDER"].findall(c["QUOTED_PLACEHOLDER"].sub(" ", segment))
        if found:
            return "placeholder", 2 * sum(map(len, found)) >= len(segment)
    if c["REPEATED"].match(segment) or c["SELF_NAMED"].match(segment):
        return "filler", True
    low = segment.lower()
    if not _NUMBER.search(low) and "cript" not in low and "skript" not in low and "browser" not in low:
        return None
    bare = c["QUOTED"].sub(" Q ", segment)
    if c["ERROR"].search(bare):
        return "error", True
    if c["SCRIPT"].search(bare):
        return "script", True
    return None


class _Cache(dict):
    """``make`` of each word as it is written, made once."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        if len(self) > 500_000:
            self.clear()
        x = self[word] = self.make(word)
        return x


def word_hashes() -> _Cache:
    """The 64-bit hash of each word, numbers masked."""
    import xxhash

    return _Cache(lambda w: xxhash.xxh64_intdigest(masked(w)))


def bare_words(keep: frozenset) -> _Cache:
    """Each word in lower case and without punctuation; what is not in ``keep`` then as the empty word."""
    bare = lambda w: "".join(ch for ch in w.lower() if ch.isalnum())
    return _Cache(lambda w: b if (b := bare(w)) in keep else "")


def passage_of() -> _Cache:
    """Each word in lower case and without marks around it, if it is one of the classical filler passage; others as the empty word."""
    known = _rules()["PASSAGE"]
    return _Cache(lambda w: b if (b := w.lower().strip(".,;:!?")) in known else "")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles_of(lines: list[str], known: _Cache) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of the five-word shingles of all lines, in order and with repeats, and how many each line has; a shorter line is one shingle."""
    words = [line.split() for line in lines]
    n = np.array([len(w) for w in words], dtype=np.int64)
    h = np.array([known[w] for of in words for w in of], dtype=np.uint64)
    start, size = np.cumsum(n) - n, np.maximum(1, n - SHINGLE + 1)
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    end, h = np.repeat(start + n, size), np.append(h, np.zeros(SHINGLE, dtype=np.uint64))
    s = np.zeros(len(at), dtype=np.uint64)
    for k in range(SHINGLE):
        s = np.where(at + k < end, _mix(s + h[np.minimum(at + k, len(h) - 1)] + np.uint64(k + 1)), s)
    return s.view(np.int64), size


def shingle_hashes(lines: list[str], known: _Cache) -> list[np.ndarray]:
    """The sorted distinct shingles of each line."""
    values, size = shingles_of(lines, known)
    return [np.unique(x) for x in np.split(values, np.cumsum(size)[:-1])]


def simhashes(shingles: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each set as ``BITS`` truth values: the majority of its shingles' hashed bits."""
    values, ends = np.concatenate(shingles).view(np.uint64), np.cumsum([len(s) for s in shingles])
    raw = np.stack([_mix(values + np.uint64(0xD1B54A32D192ED03 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) for i in range(BITS // 64)], axis=1)
    votes = np.add.reduceat(np.unpackbits(raw.view(np.uint8), axis=1).astype(np.int32), np.concatenate([[0], ends[:-1]]), axis=0)
    return 2 * votes > np.diff(ends, prepend=0)[:, None]


def table_plan(n: int) -> tuple[int, int]:
    """(bits of a table's key, number of tables) for n lines.

    A key has log2(n) - 4 bits, so that chance brings some sixteen lines together at any size. Two lines of
    ``SIMILARITY`` agree in a bit with probability 1 - arccos(2 s / (1 + s)) / pi = 0.85, so the number of
    tables follows from ``RECALL``: it grows with the fourth root of n.
    """
    bits = min(BITS, max(8, math.ceil(math.log2(max(n, 2))) - 4))
    meet = (1 - math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meet))


def table_keys(prints: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key a table and fingerprint: ``bits`` pseudorandom places of it, with the table's number, as 64-bit hashes."""
    out = np.zeros((len(prints), tables), dtype=np.uint64)
    for t in range(tables):
        places = np.random.default_rng([BITS, t]).permutation(BITS)[:bits]
        packed = np.packbits(prints[:, places], axis=1).astype(np.uint64)
        h = np.full(len(prints), t + 1, dtype=np.uint64)
        for k in range(packed.shape[1]):
            h = _mix(h + packed[:, k] + np.uint64(1))
        out[:, t] = h
    return out.view(np.int64)


def fingerprints(lines: DataFrame) -> DataFrame:
    """(line_id, line, shingles, low, high) of distinct lines; digits and hexadecimal ids are masked. low and high are the halves of the fingerprint."""
    ship(sys.modules[__name__], R)

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = word_hashes()
        for batch in batches:
            if not len(batch):
                continue
            s = shingle_hashes(batch["line"].tolist(), known)
            halves = np.packbits(simhashes(s), axis=1).view(np.int64)
            yield pd.DataFrame({"line_id": batch["line_id"], "line": batch["line"], "shingles": s, "low": halves[:, 0], "high": halves[:, 1]})

    return lines.mapInPandas(prints, "line_id bigint, line string, shingles array<bigint>, low bigint, high bigint")


def _tables(sets: DataFrame) -> DataFrame:
    """(entry, line_id, low): the entries of each set in all tables. A set that differs from another is at most n / (n + 1) similar to it; shorter sets have none."""
    long = sets.where(F.size("shingles") >= SIMILARITY * (F.size("shingles") + 1) - 1e-9).select("line_id", "low", "high")
    bits, tables = table_plan(long.count())

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            halves = np.stack([batch["low"].to_numpy(), batch["high"].to_numpy()], axis=1)
            found = table_keys(np.unpackbits(halves.view(np.uint8), axis=1).astype(bool), bits, tables)
            yield pd.DataFrame({"line_id": batch["line_id"], "low": batch["low"], "entries": list(found)})

    return long.mapInPandas(keys, "line_id bigint, low bigint, entries array<bigint>").select(F.explode("entries").alias("entry"), "line_id", "low")


def _differ(x: str, y: str):
    return F.bit_count(F.col(x).bitwiseXOR(F.col(y)))


def _verified(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (a, b) within ``HAMMING`` bits and with a Jaccard similarity of at least ``SIMILARITY``."""
    bits = lambda n: prints.select(F.col("line_id").alias(n), F.struct("low", "high").alias(f"{n}_bits"))
    sets = lambda n: prints.select(F.col("line_id").alias(n), F.col("shingles").alias(f"{n}_set"))
    near = pairs.join(bits("a"), "a").join(bits("b"), "b").where(_differ("a_bits.low", "b_bits.low") + _differ("a_bits.high", "b_bits.high") <= HAMMING).select("a", "b")
    both = near.join(sets("a"), "a").join(sets("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set"))
    return both.where(common >= SIMILARITY * (F.size("a_set") + F.size("b_set") - common) - 1e-9).select("a", "b")


def near_duplicates(prints: DataFrame) -> DataFrame:
    """(a, b): links between lines whose five-word shingles have a Jaccard similarity of at least ``SIMILARITY``.

    Lines with one set of shingles form a star around the least of them, so that only distinct sets are
    searched. They meet in partitioned SimHash tables; pairs within ``HAMMING`` bits are verified on the
    shingles. Two such lines meet with a chance of ``RECALL`` or more (more, the more similar they are),
    or over others. Where more than ``MANY`` lines share an entry, those similar to the least of them
    form a star, too, and only the rest is compared with all, so that no pair is left out for its number.
    """
    of = prints.select("line_id", F.xxhash64("shingles").alias("same"))
    heads = of.groupBy("same").agg(F.min("line_id").alias("a"), F.count("*").alias("k")).where("k > 1").select("same", "a")
    stars = cut(of.join(heads, "same").where("line_id <> a").select("a", F.col("line_id").alias("b")))
    sets = join_dimension(prints.select("line_id", "shingles", "low", "high"), stars.select(F.col("b").alias("line_id")), "line_id", "left_anti")
    rows = _tables(sets)
    keys = rows.groupBy("entry").agg(F.min(F.struct("line_id", "low")).alias("p"), F.count("*").alias("k")).where("k > 1")
    rows = rows.join(keys.select("entry", F.when(F.col("k") > MANY, F.col("p")).alias("p")), "entry")
    rows = written(rows)
    hot = rows.where("p is not null and line_id <> p.line_id").where(_differ("low", "p.low") <= HAMMING_LOW)
    around = cut(_verified(hot.select(F.col("p.line_id").alias("a"), F.col("line_id").alias("b")).distinct(), prints))
    cold = rows.where("p is null").select("entry", "line_id", "low", F.lit(False).alias("near"))
    near = around.select(F.col("a").alias("pivot"), F.col("b").alias("line_id"), F.lit(True).alias("near"))
    of_pivot = rows.where("p is not null").withColumn("pivot", F.col("p.line_id")).join(near, ["pivot", "line_id"], "left")
    rows = cold.unionByName(of_pivot.select("entry", "line_id", "low", F.coalesce("near", F.col("line_id") == F.col("pivot"), F.lit(False)).alias("near")))
    x, y = rows.where("not near"), rows.select("entry", *[F.col(c).alias(f"y_{c}") for c in ("line_id", "low", "near")])
    close = x.join(y, "entry").where("line_id <> y_line_id and (y_near or line_id < y_line_id)").where(_differ("low", "y_low") <= HAMMING_LOW)
    pairs = close.select(F.least("line_id", "y_line_id").alias("a"), F.greatest("line_id", "y_line_id").alias("b")).distinct()
    return _verified(pairs, prints).unionByName(around).unionByName(stars)


def _of_texts(docs: DataFrame, text: str, rows, schema: str) -> DataFrame:
    """What ``rows(lists)``, made anew for each partition, yields of the lists of lines of up to 500 texts; null texts are left out."""
    ship(sys.modules[__name__], R)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = rows()
        for batch in batches:
            for k in range(0, len(batch), 500):
                yield of([clean_lines(t) for t in batch["text"].iloc[k : k + 500]])

    return docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInPandas(scan, schema)


def line_hash(line: str | bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(line) - 2**63


def _sentence(sentence: str, passage: _Cache) -> list[tuple]:
    """(segment, words, kind, whole, passage) of the parts of a sentence."""
    out, of = [], sign_of(sentence)
    for s in filter(None, map(str.strip, _rules()["PART"].split(sentence) if "–" in sentence or "|" in sentence else [sentence])):
        sign, m = of if s == sentence or (of and of[1]) else sign_of(s), masked(s).strip(" .!?…:;,")
        out.append((line_hash(m), len(m.split()), sign and sign[0], bool(sign and sign[1]), len({passage[w] for w in s.split()} - {""}) >= 3))
    return out


def segments_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each sentence or part of each distinct line of every document.

    page numbers the documents, text_id is a hash of a document's lines and total its words, each distinct
    segment counted once (once: where it stands first); starts: the first segment of its line. ``segment``
    is a hash of the masked text; kind and whole are its sign. sign and sign_whole are those of the line,
    of its words, passage: a segment of it has three words of the filler passage; such lines and
    those with a sign have their text in ``line``, where they start.
    """
    ship(sys.modules[__name__], R)
    kind = dict(docs.dtypes)[key]
    columns = ["key", "page", "text_id", "total", "line_id", "starts", "segment", "words", "once", "kind", "whole", "of", "sign", "sign_whole", "passage", "line"]

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sentences, passage_words, known, page = _rules()["SENTENCE"], passage_of(), {}, TaskContext.get().partitionId() << 40
        for batch in batches:
            for k in range(0, len(batch), 500):
                part, rows = batch.iloc[k : k + 500], []
                for i, t in zip(part["key"], part["text"], strict=True):
                    page, lines, seen = page + 1, [], {}
                    for line in clean_lines(t):
                        own = []
                        for sentence in sentences.split(line):
                            if (x := known.get(sentence)) is None:
                                if len(known) > 50_000:
                                    known.clear()
                                x = known[sentence] = _sentence(sentence, passage_words)
                            own += x
                        line_id = line_hash(line)
                        lines.append((line_id, line, own))
                        seen.update((x[0], x[1]) for x in own)
                    text_id = line_hash(np.sort(np.array([x[0] for x in lines], dtype=np.int64)).tobytes())
                    total, left = sum(seen.values()), set(seen)
                    for line_id, line, own in lines:
                        of, sign = sum(x[1] for x in own), min((x[2] for x in own if x[2]), default=None)
                        whole, passage = None if sign is None else 10 * sum(x[1] for x in own if x[3]) >= 9 * of, any(x[4] for x in own)
                        for j, x in enumerate(own):
                            rows.append((i, page, text_id, total, line_id, j == 0, x[0], x[1], x[0] in left, x[2], x[3], of, sign, whole, passage, line if j == 0 and (passage or sign) else None))
                            left.discard(x[0])
                yield pd.DataFrame(rows, columns=columns)

    schema = f"key {kind}, page bigint, text_id bigint, total bigint, line_id bigint, starts boolean, segment bigint, words int, once boolean, kind string, whole boolean, of int, sign string, sign_whole boolean, passage boolean, line string"
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(parts, schema)


def bitmap(values: DataFrame):
    """A broadcast bit map of a column of 64-bit hashes, by their upper bits: sixteen bits a row, 32 MB at most. What is in the column is always found, little else unless it is huge."""
    n, (v,) = values.count(), values.columns
    bits = min(28, max(16, math.ceil(math.log2(max(n, 1) * 16))))
    at = F.shiftrightunsigned(v, 64 - bits)
    words = values.select(at.alias("p")).select(F.shiftright("p", 6).alias("at"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(2 ** (bits - 6), dtype=np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return values.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def in_bitmap(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the hashes may be in the bit map."""
    p = values.view(np.uint64) >> np.uint64(64 - 6 - (len(bits).bit_length() - 1))
    return (bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)


def filler_lines(docs: DataFrame, text: str, segments: DataFrame) -> DataFrame:
    """(line_id, line, whole) of lines of mixed filler words.

    A line with three words of the classical passage in a segment is taken for filler at first. A word
    is filler if it belongs to the passage or if most lines that hold it were taken; a line is filler if
    most of its words are, five at least of three kinds, as a whole if nine in ten are. Lines are counted
    once: those that may repeat by their hash, the others, which stand in one text only, where they stand.
    """
    first = segments.where("passage and starts").select("line_id", "line").dropDuplicates(["line_id"])
    word = F.explode(F.array_distinct(F.split(F.regexp_replace(F.lower("line"), r"[^\p{L}\p{N}\s]", ""), " "))).alias("word")
    taken = first.select(word).where("word <> ''").groupBy("word").agg(F.count("*").alias("n_taken")).where(F.col("n_taken") >= WORD_LINES)
    taken = cut(taken)
    asked, known = frozenset(r[0] for r in taken.select("word").collect()) - frozenset(R.PASSAGE), frozenset(R.PASSAGE)
    if asked:
        again = bitmap(segments.where("starts").groupBy("line_id").agg(F.count("*").alias("k")).where("k > 1").select("line_id"))

        def counts():
            bare = bare_words(asked)

            def of(texts: list[list[str]]) -> pd.DataFrame:
                rows, single = [], Counter()
                lines = [x for t in texts for x in t]
                ids = np.array([line_hash(x) for x in lines], dtype=np.int64)
                for line, i, repeats in zip(lines, ids.tolist(), in_bitmap(ids, again.value).tolist(), strict=True):
                    held = {bare[w] for w in line.split()} - {""}
                    if repeats:
                        rows += [(w, i, 1) for w in held]
                    else:
                        single.update(held)
                word, line_id, n = zip(*rows, *((w, None, k) for w, k in single.items())) if rows or single else ((), (), ())
                # typed: Spark cannot convert the float column that no rows would give
                return pd.DataFrame({"word": pd.Series(word, dtype=object), "line_id": pd.array(line_id, dtype="Int64"), "n": pd.Series(n, dtype="int64")})

            return of

        n = _of_texts(docs, text, counts, "word string, line_id bigint, n bigint")
        n = n.groupBy("word", "line_id").agg(F.sum("n").alias("n")).groupBy("word").agg(F.sum(F.when(F.col("line_id").isNull(), F.col("n")).otherwise(1)).alias("n"))
        known |= {r[0] for r in n.join(taken, "word").where(F.col("n_taken") >= WORD_SHARE * F.col("n")).select("word").collect()}

    def filler():
        bare = bare_words(known)

        def of(texts: list[list[str]]) -> pd.DataFrame:
            rows = []
            for t in texts:
                for line in t:
                    held = [bare[w] for w in line.split()]
                    n = len(held)
                    k = n - held.count("")
                    if k >= 5 and 2 * k >= n and len(set(held) - {""}) >= 3:
                        rows.append((line_hash(line), line, 10 * k >= 9 * n))
            return pd.DataFrame(rows, columns=["line_id", "line", "whole"])

        return of

    return _of_texts(docs, text, filler, "line_id bigint, line string, whole boolean").dropDuplicates(["line_id"])


def reached(docs: DataFrame, text: str, labelled: DataFrame) -> DataFrame:
    """(line_id, component) of the lines in the components of near-duplicates that hold one of ``labelled`` (line_id, line); the others are never gathered.

    Of two lines of ``SIMILARITY`` s, where the first has a share x of its shingles among those of some lines, the
    second has at least s (x - (1 - s)): what shares ``POOL`` with the labelled lines is searched for near-duplicates, and
    holds all neighbours of what shares ``CLOSED``. Lines that are reached and share less begin another pass over the texts.
    """
    pool, start = labelled.select("line_id", "line", F.lit(1.0).alias("share")), labelled
    while True:
        begun = written(fingerprints(start.select("line_id", "line")))
        bits = bitmap(begun.select(F.explode("shingles").alias("shingle")).distinct())

        def sharing(bits=bits):
            known = word_hashes()

            def of(texts: list[list[str]]) -> pd.DataFrame:
                rows, lines = [], [x for t in texts for x in t]
                if lines:
                    values, size = shingles_of(lines, known)
                    hits, starts = in_bitmap(values, bits.value), np.cumsum(size) - size
                    for k in np.flatnonzero(np.add.reduceat(hits, starts, dtype=np.int64)).tolist():
                        share = in_bitmap(np.unique(values[starts[k] : starts[k] + size[k]]), bits.value).mean()
                        if share >= POOL - 1e-9:
                            rows.append((line_hash(lines[k]), lines[k], float(share)))
                return pd.DataFrame(rows, columns=["line_id", "line", "share"])

            return of

        pool = written(pool.unionByName(_of_texts(docs, text, sharing, "line_id bigint, line string, share double")).groupBy("line_id").agg(F.min("line").alias("line"), F.max("share").alias("share")))
        components = cut(connected_components(near_duplicates(written(fingerprints(pool.select("line_id", "line"))))).select(F.col("node").alias("line_id"), "component"))
        held = components.join(labelled.select("line_id"), "line_id").select("component").distinct()
        components = cut(components.join(held, "component").select("line_id", "component"))
        start = cut(pool.where(F.col("share") < CLOSED).join(components, "line_id", "left_semi").select("line_id", "line"))
        if start.isEmpty():
            return components
        pool = pool.unionByName(start.withColumn("share", F.lit(1.0)))


def spread_to_segments(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(segment, kind): ``labels`` and what they lead to over the pages they make up.

    ``pages`` has page, text_id, a hash of its text, total, its words, segment and words; pages of one text count once. A
    segment recurs if it stands in ``PAGES`` different pages. Pages of nothing but recurring segments (no
    article is made of them) link their segments, and only components that hold a label are looked at.
    There each segment's score is the mean, over all pages that hold more than itself, of the share of
    the rest that is labelled, a segment not yet labelled counting by its own score: labels count 1,
    what does not recur 0. Scores only rise; when none rises by ``SETTLED`` any more, those of
    ``LABELLED`` and above take the label.
    """
    again = pages.select("page", "text_id").distinct().groupBy("text_id").agg(F.min("page").alias("only"), F.count("*").alias("k")).where("k > 1").select("text_id", "only")
    own = join_dimension(pages, cut(again), "text_id").where("only is null or page = only").select(F.col("page").alias("key"), "segment", "words", "total")
    recurring = cut(own.groupBy("segment").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES).select("segment"))
    labels = cut(labels)
    inside = join_dimension(own, cut(recurring.unionByName(labels.select("segment")).distinct()), "segment", "inner")
    least = inside.groupBy("key").agg(F.min("segment").alias("least"), F.sum("words").alias("sum"), F.max("total").alias("total")).where("sum = total").select("key", "least")
    links = inside.join(least, "key").where("segment <> least").select(F.col("segment").alias("a"), F.col("least").alias("b")).distinct()
    components = cut(connected_components(links).select(F.col("node").alias("segment"), "component"))
    held = components.join(labels, "segment").groupBy("component").agg(F.min("kind").alias("kind"))
    candidates = cut(components.join(held, "component").select("segment", "kind").join(labels.select("segment"), "segment", "left_anti"))
    scores = cut(labels.select("segment", F.lit(1.0).alias("score"), F.lit(True).alias("fixed")).unionByName(candidates.select("segment", F.lit(0.0).alias("score"), F.lit(False).alias("fixed"))))
    near = written(join_dimension(own, scores.select("segment", "fixed"), "segment", "inner"))
    while True:
        now = near.join(scores.select("segment", "score"), "segment")
        mass = now.groupBy("key").agg(F.sum(F.col("words") * F.col("score")).alias("mass"))
        rest = now.where("not fixed and total > words").join(mass, "key").groupBy("segment").agg(F.avg((F.col("mass") - F.col("words") * F.col("score")) / (F.col("total") - F.col("words"))).alias("next"))
        new = cut(scores.join(rest, "segment", "left").select("segment", F.when(F.col("fixed"), 1.0).otherwise(F.greatest("score", F.coalesce("next", F.lit(0.0)))).alias("score"), "fixed", "score").toDF("segment", "score", "fixed", "before"))
        rise = new.agg(F.max(F.col("score") - F.col("before"))).first()[0]
        scores = new.drop("before")
        if rise is None or rise < SETTLED:
            return labels.unionByName(candidates.join(scores.where(F.col("score") >= LABELLED).select("segment"), "segment", "left_semi"))


def labelled_lines(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(key, line_id) of all lines, and (line_id, kind, by) of those that are residue; ``by`` is sign, near or page.

    A line with a trusted sign is residue. Labels of lines that are residue as a whole spread through
    their component of near-duplicates, then from segment to segment over the pages they make up.
    Placeholders stand among content and label nothing else.
    """
    segments = written(segments_of(docs, key, text))
    lines = segments.where("starts").select("key", "line_id")
    filler = written(filler_lines(docs, text, segments))
    signs = segments.where("sign is not null and starts").select("line_id", F.col("sign").alias("kind"), F.col("sign_whole").alias("whole"), "line")
    signed = written(signs.unionByName(filler.select("line_id", F.lit("filler").alias("kind"), "whole", "line")).groupBy("line_id").agg(F.min("kind").alias("kind"), F.max("whole").alias("whole"), F.min("line").alias("line")))
    components = reached(docs, text, signed.where("whole").select("line_id", "line"))
    label = signed.where("whole").join(components, "line_id").groupBy("component").agg(F.min("kind").alias("kind"))
    near = components.join(label, "component").select("line_id", "kind").join(signed.select("line_id"), "line_id", "left_anti")
    whole = cut(signed.where("whole").select("line_id", "kind").unionByName(near))
    parts = join_dimension(segments.where("2 * words >= of").select("line_id", "segment"), whole.where("kind <> 'placeholder'"), "line_id", "inner").groupBy("segment").agg(F.min("kind").alias("kind"))
    direct = segments.where("whole and kind <> 'placeholder'").groupBy("segment").agg(F.min("kind").alias("kind"))
    seeds = parts.unionByName(direct).groupBy("segment").agg(F.min("kind").alias("kind"))
    spread = cut(spread_to_segments(segments.where("once").select("page", "text_id", "total", "segment", "words"), seeds))
    over = join_dimension(segments.select("line_id", "segment"), spread, "segment", "inner").groupBy("line_id").agg(F.min("kind").alias("kind"))
    all_ = signed.select("line_id", "kind", F.lit("1 sign").alias("by")).unionByName(near.withColumn("by", F.lit("2 near"))).unionByName(over.withColumn("by", F.lit("3 page")))
    named = cut(all_.groupBy("line_id").agg(F.min_by("kind", "by").alias("kind"), F.substring(F.min("by"), 3, 9).alias("by")))
    return lines, named


def residue_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kinds, by): documents with a line of residue, the kinds found in them, sorted, and the nearest way they were found by.

    Null, empty and blank texts are none; repeated documents are all reported; further columns are ignored.
    """
    lines, named = labelled_lines(docs, key, text)
    order = F.array_position(F.array(F.lit("sign"), F.lit("near"), F.lit("page")), F.col("by"))
    return join_dimension(lines, named, "line_id", "inner").groupBy("key").agg(F.array_sort(F.collect_set("kind")).alias("kinds"), F.min_by("by", order).alias("by")).select(F.col("key").alias(key), "kinds", "by")


def without_residue(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no residue, with all their columns."""
    return docs.join(residue_documents(docs, key, text).select(key), key, "left_anti")
