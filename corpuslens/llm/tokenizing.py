"""Encoding of a whole corpus with a public tokenizer; long texts by tree concatenation."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: The vocabulary's file (ranks of a byte-level BPE); never copied into this repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this many characters are encoded in halves, in parallel.
LEAF = 8192

_ENCODERS: dict = {}


def encoder(vocabulary: str):
    """The tokenizer of a rank file, once a process."""
    if vocabulary not in _ENCODERS:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


def encode(text: str, vocabulary: str) -> list[int]:
    return encoder(vocabulary).encode_ordinary(text)


def _can_cut(data: bytes, at: int) -> bool:
    """Whether a window may begin or end here: between characters, and not beside an apostrophe.

    The pattern looks at what stands left of a point only for contractions ('s, 't, ...).
    """
    return data[at] & 0xC0 != 0x80 and data[at : at + 1] != b"'" and data[at - 1 : at] != b"'"


def concatenate(left: str, a: list[int], right: str, b: list[int], vocabulary: str, window: int = 32) -> list[int]:
    """The ids of ``left + right`` from those of its parts.

    A window of tokens around the join is encoded anew and grows until its first two tokens are those
    of the left part and its last two those of the right part at the same places. Then every two
    neighbours of the result stand together in an encoding of the left part, the window or the right
    part. A sequence of tokens is the encoding of its bytes if each pair of neighbours is (merges are
    made by rank), and the splitting pattern meets the same runs of one kind of character, so the
    result is that of the whole text. If a side never agrees, the window takes in all of it.
    """
    enc = encoder(vocabulary)
    length = lambda t: len(enc.decode_single_token_bytes(t))
    x, y = left.encode(), right.encode()
    size = window
    while True:
        i, j = max(0, len(a) - size), min(len(b), size)
        from_, to = len(x) - sum(map(length, a[i:])), sum(map(length, b[:j]))
        while i > 0 and not _can_cut(x, from_):
            i -= 1
            from_ -= length(a[i])
        while j < len(b) and not _can_cut(y, to):
            to += length(b[j])
            j += 1
        mid = encode((x[from_:] + y[:to]).decode(), vocabulary)
        left_agrees = i == 0 or (len(mid) > 3 and mid[:2] == a[i : i + 2])
        right_agrees = j == len(b) or (len(mid) > 3 and j >= 2 and mid[-2:] == b[j - 2 : j])
        if left_agrees and right_agrees:
            return a[:i] + mid + b[j:]
        size *= 2


def encode_tree(text: str, vocabulary: str, leaf: int = LEAF) -> list[int]:
    """The ids of ``text`` by halves, in one process: what the distributed form must equal."""
    if len(text) <= leaf:
        return encode(text, vocabulary)
    m = len(text) // 2
    return concatenate(text[:m], encode_tree(text[:m], vocabulary, leaf), text[m:], encode_tree(text[m:], vocabulary, leaf), vocabulary)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(key, ids) of every row, without special tokens; their strings in a text are ordinary text.

    An empty and a null text both give an empty list; repeated rows and keys give a row each. Texts up
    to ``leaf`` characters are encoded where they are read, without a shuffle. A longer one is cut
    into parts of at most ``leaf`` characters, which are spread over the cluster and encoded in
    parallel; then neighbours are concatenated level by level of a tree, each pair in its own task. No text is shortened. Only the file path
    of the vocabulary is shipped; each worker process loads it once.
    """
    ship(sys.modules[__name__])
    d = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for batch in batches:
            for k in range(0, len(batch), 512):
                x = batch.iloc[k : k + 512]
                yield pd.DataFrame({"key": x["key"], "ids": enc.encode_ordinary_batch(x["text"].tolist(), num_threads=1)})

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(vocabulary)
        for batch in batches:
            yield batch.assign(ids=[enc.encode_ordinary(t) for t in batch["text"]])

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        row = group.sort_values("i")
        text, ids = row["text"].iloc[0], list(row["ids"].iloc[0])
        if len(row) > 1:
            ids = concatenate(text, ids, row["text"].iloc[1], list(row["ids"].iloc[1]), vocabulary)
            text += row["text"].iloc[1]
        return pd.DataFrame({"row": [row["row"].iloc[0]], "i": [int(row["i"].iloc[0]) // 2], "text": [text], "ids": [ids]})

    kind = dict(d.dtypes)["key"]
    schema = f"key {kind}, ids array<int>"
    direct = d.where(F.length("text") <= leaf).mapInPandas(short, schema)
    # Equal rows are encoded once; the number of a row depends on nothing but its content.
    long = d.where(F.length("text") > leaf).groupBy("key", "text").agg(F.count("*").alias("copies")).withColumn("row", F.concat_ws(".", F.xxhash64("key", "text"), F.hash("key", "text")))
    n = F.ceil(F.length("text") / leaf).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.substring("text", i * leaf + 1, F.lit(leaf)).alias("text")))
    most = d.agg(F.max(n)).first()[0] or 0
    nodes = long.select("row", F.explode(pieces).alias("p")).select("row", "p.*").repartition("row", "i").mapInPandas(parts, "row string, i int, text string, ids array<int>")
    while most > 1:  # one level of the tree a round: every pair of neighbours is joined in a task of its own
        nodes = nodes.groupBy("row", F.floor(F.col("i") / 2).alias("pair")).applyInPandas(joined, "row string, i int, text string, ids array<int>")
        most = -(-most // 2)
    encoded = long.select("row", "key", "copies").join(nodes.select("row", "ids"), "row").select("key", "ids", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("key", "ids")
    return direct.unionByName(encoded).select(F.col("key").alias(key), "ids")
