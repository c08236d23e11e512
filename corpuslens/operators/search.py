"""Ranked search: BM25 over boosted fields, bonuses, sound and spelling tolerance, suggestions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import german
from ..functions import text as T
from .query_language import Query, compile_query, parse


@dataclass(frozen=True)
class Ranking:
    """Parameters of the score."""

    k1: float = 1.5
    b: float = 0.75
    title: int = 4
    coverage: bool = True
    title_bonus: float = 0.15
    bigram_bonus: float = 0.5
    proximity: bool = True
    half_life: float = 30.0
    recency: str = "none"
    synonyms: tuple[tuple[str, ...], ...] = ()


def query_tokens(text: str) -> list[str]:
    """Folded tokens of a query, as ``ascii_tokens`` makes them of texts; repeated words stay."""
    import re

    return [t for t in re.split("[^a-z0-9]+", T._folded(text)) if len(t) >= 3 and t not in T.STOPWORDS]


def tokenised(a: DataFrame) -> DataFrame:
    """Articles with their token arrays and boosted length."""
    parts = {n: T.ascii_tokens(F.coalesce(F.col(c), F.lit(""))) for n, c in (("tt", "title"), ("ts", "summary"), ("tb", "full_text"))}
    return a.withColumns(parts)


def bm25(a: DataFrame, text: str, r: Ranking = Ranking(), today: str | None = None) -> DataFrame:
    """``a`` (id, title, summary, full_text, day) with ``score``; only rows with a score.

    Statistics of the corpus (size, mean length, document frequencies of the query's words) are one
    aggregate row; the score is then an expression on each row, so ranking needs no shuffle of texts
    and no postings table. ``recency`` is none, exponential or linear against ``today``.
    """
    words = query_tokens(text)
    groups = {w: g for g in r.synonyms for w in g}
    terms = list(dict.fromkeys(x for w in words for x in (w, *groups.get(w, ()))))
    if not terms:
        return a.limit(0).withColumn("score", F.lit(0.0))
    count = lambda c, w: F.size(F.filter(c, lambda x: x == w))
    d = tokenised(a)
    d = d.withColumn("dl", r.title * F.size("tt") + F.size("ts") + F.size("tb")).withColumns({f"tf{i}": r.title * count("tt", w) + count("ts", w) + count("tb", w) for i, w in enumerate(terms)})
    row = d.agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
    n, avg = row["n"], row["avg"] or 1.0
    tf = lambda i: F.col(f"tf{i}")
    idf = [float(log((n - row[f"df{i}"] + 0.5) / (row[f"df{i}"] + 0.5) + 1)) for i in range(len(terms))]
    asked = [terms.index(x) for w in words for x in (w, *(y for y in groups.get(w, ()) if y != w))]
    parts = [idf[i] * tf(i) * (r.k1 + 1) / (tf(i) + r.k1 * (1 - r.b + r.b * F.col("dl") / avg)) for i in asked]
    score = reduce(Column.__add__, parts)
    matched = reduce(Column.__add__, [(tf(i) > 0).cast("int") for i in asked])
    if r.coverage and len(asked) > 1:
        score = score * (0.3 + 0.7 * matched / len(asked))
    d = d.withColumn("s", score).where("s > 0")
    factor = F.lit(1.0)
    if r.title_bonus:
        hits = reduce(Column.__add__, [F.array_contains("tt", w).cast("int") for w in words])
        factor = factor * (1 + r.title_bonus * hits)
    if r.bigram_bonus and len(words) > 1:
        pairs = [f"{x} {y}" for x, y in zip(words, words[1:], strict=False)]
        line = F.concat(F.lit(" "), F.array_join(F.concat("tt", "ts", "tb"), " "), F.lit(" "))
        factor = factor * (1 + r.bigram_bonus * reduce(Column.__add__, [line.contains(f" {p} ").cast("int") for p in dict.fromkeys(pairs)]))
    if r.proximity and len(set(words)) > 1:
        factor = factor * (1 + proximity(words))
    if r.recency != "none" and today:
        age = F.greatest(F.datediff(F.lit(today).cast("date"), "day"), F.lit(0))
        rec = F.pow(F.lit(0.5), age / r.half_life) if r.recency == "exponential" else F.greatest(1 - age / (4 * r.half_life), F.lit(0.0))
        factor = factor * F.when(F.col("day").isNull(), 1.0).otherwise(0.5 + rec)
    out = d.withColumn("score", F.round(F.col("s") * factor, 6))
    return out.drop("s", "dl", "tt", "ts", "tb", *[f"tf{i}" for i in range(len(terms))])


@dataclass(frozen=True)
class Index:
    """Postings (term, id, tf, dl), sorted by term, and the number of documents and mean length of the corpus."""

    postings: DataFrame
    n: int
    mean: float


def index_articles(a: DataFrame, folder: str, r: Ranking = Ranking()) -> Index:
    """The postings of ``a``, written once below ``folder``: one row a term and document, with field-boosted frequency and length.

    Rows are spread by ranges of terms and sorted, so that the scan of a query skips all row groups without its words; texts
    are read when the index is made, and by no search.
    """
    weight = lambda c, k: F.transform(c, lambda x: F.struct(x.alias("term"), F.lit(k).alias("w")))
    d = tokenised(a).select("id", (r.title * F.size("tt") + F.size("ts") + F.size("tb")).alias("dl"), F.concat(weight("tt", r.title), weight("ts", 1), weight("tb", 1)).alias("x"))
    d.select("id", "dl").write.mode("overwrite").parquet(f"{folder}/lengths")
    each = d.select("id", "dl", F.explode("x").alias("x")).groupBy("x.term", "id", "dl").agg(F.sum("x.w").alias("tf"))
    each.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    return open_index(a.sparkSession, folder)


def open_index(spark, folder: str) -> Index:
    """The index that an earlier run wrote."""
    row = spark.read.parquet(f"{folder}/lengths").agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
    return Index(spark.read.parquet(f"{folder}/postings"), row["n"], row["mean"] or 1.0)


def bm25_indexed(index: Index, text: str, r: Ranking = Ranking()) -> DataFrame:
    """(id, score) as ``bm25`` scores without bonuses, from the postings of the query's words alone. A repeated word counts as often as it stands."""
    spark, words = index.postings.sparkSession, query_tokens(text)
    times = {w: words.count(w) for w in words}
    rows = index.postings.where(F.col("term").isin(*times) if times else F.lit(False))
    df = {x["term"]: x["n"] for x in rows.groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = [(w, float(k), float(k * log((index.n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5) + 1))) for w, k in times.items()]
    rows = rows.join(F.broadcast(spark.createDataFrame(weights, "term string, k double, idf double")), "term")  # a query has few words
    part = F.col("idf") * F.col("tf") * (r.k1 + 1) / (F.col("tf") + r.k1 * (1 - r.b + r.b * F.col("dl") / index.mean))
    d = rows.groupBy("id").agg(F.sum(part).alias("s"), F.sum("k").alias("matched"))
    coverage = 0.3 + 0.7 * F.col("matched") / len(words) if r.coverage and len(words) > 1 else F.lit(1.0)
    return d.select("id", F.round(F.col("s") * coverage, 6).alias("score"))


def boosted(scored: DataFrame, phrases: list[str], feeds: DataFrame) -> DataFrame:
    """``scored`` (id, title, source, score) with 0.3 more for each phrase that stands in the title, and a tenth or a twentieth more for sources of priority 95 and 80."""
    p = feeds.where("name is not null").groupBy(F.col("name").alias("source")).agg(F.max("priority").alias("__priority"))
    bonus = reduce(Column.__add__, [F.coalesce(F.lower("title").contains(x.lower()), F.lit(False)).cast("int") for x in phrases], F.lit(0)) * 0.3
    factor = F.when(F.col("__priority") >= 95, 1.1).when(F.col("__priority") >= 80, 1.05).otherwise(1.0)
    return scored.join(p, "source", "left").withColumn("score", F.round(F.col("score") * (1 + bonus) * factor, 6)).drop("__priority")


def proximity(words: list[str]) -> Column:
    """Up to 0.5 by the least gap between two different words of the query in the text."""
    at = F.filter(F.transform(F.concat("tt", "ts", "tb"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].isin(*set(words)))
    gaps = F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda a, b: F.when(a["x"] != b["x"], b["i"] - a["i"]))
    gap = F.array_min(F.filter(gaps, lambda g: g.isNotNull()))
    return F.when(gap.isNull(), 0.0).when(gap <= 1, 0.5).when(gap <= 8, 0.5 - 0.05 * (gap - 1)).when(gap <= 32, 0.15 * (32 - gap) / 24).otherwise(0.0)


def search(a: DataFrame, raw: str, limit: int = 50, ranking: Ranking = Ranking(), today: str | None = None) -> DataFrame:
    """The best articles of a query: its conditions filter first, then the rest is ranked.

    A query of conditions only returns all that fit, by relevance.
    """
    q: Query = parse(raw)
    base = a.where(compile_query(q)) if q.structured else a
    if not query_tokens(q.ranking_text()):
        return base.withColumn("score", F.col("relevance_score").cast("double")).orderBy(F.desc("score"), "id").limit(limit)
    return bm25(base, q.ranking_text(), ranking, today).orderBy(F.desc("score"), "id").limit(limit)


def closest_terms(vocabulary: DataFrame, raw: str, distance: int = 2) -> DataFrame:
    """(query_term, term, distance): known words nearest to each word of a query, by bounded edit distance on the distinct vocabulary."""
    spark = vocabulary.sparkSession
    words = spark.createDataFrame([(w,) for w in dict.fromkeys(query_tokens(raw))], "query_term string")
    v = vocabulary.select("term", "n")
    near = v.join(F.broadcast(words), F.abs(F.length("term") - F.length("query_term")) <= distance)  # a query has few words
    d = near.withColumn("distance", F.levenshtein("term", "query_term", distance)).where("distance >= 0")
    return d.groupBy("query_term").agg(F.min_by(F.struct("term", "distance"), F.struct(F.col("distance"), -F.col("n"), F.col("term"))).alias("b")).select("query_term", "b.term", "b.distance")


def hybrid(a: DataFrame, raw: str, limit: int = 50) -> DataFrame:
    """BM25 of the query and, at a third of the weight, of its words respelt by the corpus: full outer join of both rankings."""
    exact = search(a, raw, 2 * limit).select("id", F.col("score").alias("exact"))
    vocabulary = a.select("id", F.explode(F.array_distinct(T.ascii_tokens(F.col("title")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    other = " ".join(r["term"] for r in closest_terms(vocabulary, parse(raw).ranking_text()).collect())
    fuzzy = search(a, other, 2 * limit).select("id", F.col("score").alias("fuzzy"))
    both = exact.join(fuzzy, "id", "full").select("id", F.coalesce("exact", F.lit(0.0)).alias("exact"), F.coalesce("fuzzy", F.lit(0.0)).alias("fuzzy"))
    top = both.agg(F.greatest(F.max("exact"), F.lit(1.0)).alias("e"), F.greatest(F.max("fuzzy"), F.lit(1.0)).alias("f")).first()
    e, f = (top["e"] or 1.0, top["f"] or 1.0)
    return both.withColumn("score", F.round(0.65 * F.col("exact") / e + 0.35 * F.col("fuzzy") / f, 6)).orderBy(F.desc("score"), "id").limit(limit)


def sound_alike(a: DataFrame, raw: str) -> DataFrame:
    """Articles whose title has a word that sounds like one of the query's, with the number of such words."""
    codes = {german.cologne(w) for w in query_tokens(raw) if len(w) >= 4} - {""}
    terms = a.select("id", F.explode(F.array_distinct(T.letter_tokens(F.col("title"), 4))).alias("term"))
    same = german.with_codes(terms).where(F.col("sound").isin(*codes)).select("term")
    return terms.join(same, "term").groupBy("id").agg(F.count("*").alias("hits"))


def suggestions(a: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Completions of a prefix: sources weigh 5, title words 2 each article."""
    p = T._folded(prefix)
    src = a.where(T.fold(F.col("source")).startswith(p)).select(F.col("source").alias("value"), F.lit(5).alias("w"))
    word = a.select("id", F.explode(F.array_distinct(T.ascii_tokens(F.col("title")))).alias("value")).where(F.col("value").startswith(p)).select("value", F.lit(2).alias("w"))
    return src.unionByName(word).groupBy("value").agg(F.sum("w").alias("weight")).orderBy(F.desc("weight"), "value").limit(limit)


def highlight(c: Column, raw: str) -> Column:
    """The words of a query marked in a text, in any case."""
    import re

    q = parse(raw)
    words = sorted({re.escape(t.text) for t in q.must + q.should}, key=len, reverse=True)
    return F.regexp_replace(c, f"(?i)({'|'.join(words)})", "<mark>$1</mark>") if words else c


def snippet(c: Column, raw: str, size: int = 240) -> Column:
    """The sentence with most words of the query (the first of equals), at most ``size`` characters."""
    words = query_tokens(parse(raw).ranking_text())
    s = T.sentences(T.collapse(c))
    hits = lambda x: reduce(Column.__add__, [T.fold(x).contains(w).cast("int") for w in words], F.lit(0))
    best = F.array_max(F.transform(s, lambda x, i: F.struct(hits(x).alias("h"), (-i).alias("i"), x.alias("x"))))
    return F.substring(best["x"], 1, size)


def top_terms(a: DataFrame, limit: int = 30) -> DataFrame:
    t = a.select("id", F.explode(F.array_distinct(F.filter(T.ascii_tokens(F.concat_ws(" ", "title", "summary")), lambda x: F.length(x) >= 4))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(limit)
