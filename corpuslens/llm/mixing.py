"""Mixing sources to target weights: token blocks, drawn counts by shard, permuted indexes."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import join_dimension, ship, written
from .tokenizing import LEAF, VOCABULARY, token_ids

#: The largest population numpy draws from one by one; beyond it the normal law of the same mean and variance is drawn from, which differs by less than a part in ten thousand there.
COUNTED = 500_000_000
#: About so many tokens of a source are put in order by one task.
TOKENS_A_BUCKET = 8_000_000


@dataclass(frozen=True)
class Source:
    """What the plan says of one source: its blocks and how many slots of the mix it fills."""

    name: str
    share: float
    max_repeats: int
    tokens: int
    blocks: int
    quota: int


def quotas(shares: list[float], caps: list[float], total: float) -> list[float]:
    """Parts of ``total`` in proportion to ``shares``, none above its cap; what a capped one leaves goes to the others in proportion."""
    out, open_, left = [0.0] * len(shares), [i for i, s in enumerate(shares) if s > 0 and caps[i] > 0], total
    while open_ and left > 0:
        weight = sum(shares[i] for i in open_)
        full = [i for i in open_ if shares[i] / weight * left >= caps[i]]
        for i in full or open_:
            out[i] = caps[i] if full else shares[i] / weight * left
        left -= sum(caps[i] for i in full) if full else left
        open_ = [i for i in open_ if i not in full] if full else []
    return out


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a Feistel network with cycle walking, nothing stored."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> np.uint64(half), v & mask
        for r in range(4):
            f = (b + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, (a ^ (f >> np.uint64(33))) & mask
        return (a << np.uint64(half)) | b

    x = once(x)
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def drawn(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` slots drawn without replacement are good ones."""
    if good + bad <= COUNTED:
        return int(rng.hypergeometric(good, bad, n))
    total, share = good + bad, good / (good + bad)
    spread = math.sqrt(max(0.0, n * share * (1 - share) * ((total - n) / (total - 1))))
    return min(max(round(n * share + spread * rng.standard_normal()), n - bad, 0), good, n)


def split_counts(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """How many of ``n`` drawn slots each source gets, without replacement from ``counts``."""
    out, rest = np.zeros_like(counts), int(counts.sum())
    for i, k in enumerate(map(int, counts)):
        rest -= k
        out[i] = drawn(k, rest, n, rng)
        n -= int(out[i])
    return out


def shard_counts(quota: np.ndarray, shard: int, shards: int, slots: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first slot index, slots) of each source in one shard.

    The slots of all shards are multinomial draws given their sums: a tree over the shards is walked
    from its root, and each node draws what its left half gets. Every shard finds its own counts in
    about log2(shards) draws, and all shards together take exactly the quotas.
    """
    lo, hi, counts, start = 0, shards, quota.astype(np.int64).copy(), np.zeros(len(quota), dtype=np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        n = min((mid - lo) * slots, int(counts.sum()))
        left = split_counts(counts, n, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            hi, counts = mid, left
        else:
            lo, start, counts = mid, start + left, counts - left
    return start, counts


def token_blocks(ids: DataFrame, block: int, buckets: int | None = None, seed: int = 0) -> DataFrame:
    """(source, block_no, n_tokens, ids): the tokens of each source, packed in pseudorandom order of its documents.

    ``ids`` has source, key and ids. Every block but a source's last has ``block`` tokens. A document's
    offset is a prefix sum in two steps: over hash buckets of its source, then within its bucket, so
    that no source is summed in one task; their number follows from the tokens of the largest source.
    Documents without tokens take no place.
    """
    d = ids.where(F.size("ids") > 0).select("source", "key", "ids", F.size("ids").cast("bigint").alias("n"), F.xxhash64(F.col("key"), F.lit(seed)).alias("h"))
    d = written(d)
    if buckets is None:
        buckets = 1 + (d.groupBy("source").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) // TOKENS_A_BUCKET
    d = d.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("n").alias("size"))
    before = sums.select("source", "bucket", (F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("base"))
    inside = Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.withColumn("at", F.sum("n").over(inside) - F.col("n")).join(before, ["source", "bucket"]).withColumn("at", F.col("at") + F.col("base"))
    first, last = F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("n") - 1) / block)
    parts = placed.select("source", "ids", "at", "n", F.explode(F.sequence(first, last)).alias("block_no"))
    begin = F.greatest(F.col("at"), F.col("block_no") * block)
    end = F.least(F.col("at") + F.col("n"), (F.col("block_no") + 1) * block)
    parts = parts.select("source", "block_no", begin.alias("p"), F.slice("ids", (begin - F.col("at") + 1).cast("int"), (end - begin).cast("int")).alias("part"))
    joined = parts.groupBy("source", "block_no").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("p", "part"))), lambda x: x["part"])).alias("ids"))
    return joined.select("source", "block_no", F.size("ids").alias("n_tokens"), "ids")


def plan_mix(targets: list[tuple[str, float, int]], tokens: dict[str, int], block: int, total_tokens: int | None = None) -> list[Source]:
    """The quota of each source in blocks, worked out in tokens (a source's last block may be short).

    Without ``total_tokens`` the mix is as large as it can be with every source that has tokens at its
    target share: the source that is scarcest for its share is used up. With it, sources that cannot
    give their share give all they may, and the others share the rest in proportion.
    """
    n = {s: -(-tokens.get(s, 0) // block) for s, _, _ in targets}
    caps = [float(tokens.get(s, 0) * max(0, r)) for s, _, r in targets]
    shares = [max(0.0, w) for _, w, _ in targets]
    usable = [c / w for c, w in zip(caps, shares, strict=True) if c > 0 and w > 0]
    weight = sum(w for c, w in zip(caps, shares, strict=True) if c > 0)
    total = float(total_tokens) if total_tokens is not None else min(usable, default=0.0) * weight
    parts = quotas(shares, caps, min(total, sum(caps)))
    whole = [min(n[s] * max(0, r), int(q / (tokens[s] / n[s]) + 0.5)) if q > 0 else 0 for (s, _, r), q in zip(targets, parts, strict=True)]
    return [Source(s, w, r, tokens.get(s, 0), n[s], q) for (s, w, r), q in zip(targets, whole, strict=True)]


def mixture(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", block: int = 256, slots: int = 256, total_tokens: int | None = None, seed: int = 7, vocabulary: str = VOCABULARY, leaf: int = LEAF) -> tuple[DataFrame, list[Source]]:
    """(shard, slot, source, epoch, block_no, n_tokens, ids) of the mix, and its plan.

    Sources come from ``targets`` (source, target_share, max_repeats; one short row each, so the plan is
    made on the driver; null and repeated sources: the first share by size counts). Documents of other
    sources, without source or without tokens take no part; a wanted source without any reaches 0.
    Slots of one source count through its blocks, ``max_repeats`` times at most, each time in another
    pseudorandom order, so no block and no document is taken more often. The same input and seed give
    the same mix. Empty inputs give an empty mix.
    """
    ship(sys.modules[__name__])
    want = targets.where("source is not null").groupBy("source").agg(F.max(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    rows = sorted((r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in want.collect())
    mine = join_dimension(docs.select(F.col(key).alias("key"), "source", F.col(text).alias("text")), want.select("source"), "source", "left_semi")
    ids = token_ids(mine.select(F.struct("key", "source").alias("key"), "text"), "key", "text", vocabulary, leaf).select("key.source", "key.key", "ids")
    blocks = written(token_blocks(ids, block, seed=seed))
    tokens = {r["source"]: r["n"] for r in blocks.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = plan_mix(rows, tokens, block, total_tokens)
    names, quota = [s.name for s in plan], np.array([s.quota for s in plan], dtype=np.int64)
    sizes = [s.blocks for s in plan]
    shards = max(1, -(-int(quota.sum()) // slots))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in map(int, batch["id"]):
                start, counts = shard_counts(quota, shard, shards, slots, seed)
                s = np.repeat(np.arange(len(names)), counts)
                k = np.concatenate([np.arange(a, a + c) for a, c in zip(start, counts, strict=True)] or [np.zeros(0, dtype=np.int64)])
                no, epoch = np.zeros(len(k), dtype=np.int64), np.zeros(len(k), dtype=np.int64)
                for i in np.unique(s):
                    at = s == i
                    epoch[at] = k[at] // sizes[i]
                    for e in np.unique(epoch[at]):
                        both = at & (epoch == e)
                        no[both] = permuted(k[both] % sizes[i], sizes[i], seed * 1_000_003 + int(i) * 1009 + int(e))
                order = np.random.default_rng([seed, shard, 1]).permutation(len(k))
                yield pd.DataFrame({"shard": shard, "slot": np.arange(len(k)), "source": [names[i] for i in s[order]], "epoch": epoch[order], "block_no": no[order]})

    drawn = docs.sparkSession.range(shards).mapInPandas(draw, "shard bigint, slot int, source string, epoch int, block_no bigint") if quota.sum() else docs.sparkSession.createDataFrame([], "shard bigint, slot int, source string, epoch int, block_no bigint")
    return drawn.join(blocks, ["source", "block_no"]).select("shard", "slot", "source", "epoch", "block_no", "n_tokens", "ids"), plan


def shares(mix: DataFrame, plan: list[Source], total_name: str = "reached_share") -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, tokens, reached_share, most_repeats) by source of the plan, as found in the mix itself."""
    spark = mix.sparkSession
    p = spark.createDataFrame([(s.name, s.share, s.max_repeats, s.tokens) for s in plan], "source string, target_share double, max_repeats int, available_tokens bigint")
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), (F.max("epoch") + 1).alias("most_repeats"))
    d = p.join(got, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0).cast("bigint")), "most_repeats": F.coalesce("most_repeats", F.lit(0))})
    return d.select("source", "target_share", "max_repeats", "available_tokens", "tokens", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6).alias(total_name), "most_repeats")
