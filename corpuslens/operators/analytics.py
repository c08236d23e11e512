"""Aggregations over articles, tags and entities. Each is one pass with map-side partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import share


def _is(column: str, value: str) -> Column:
    return F.col(column) == value


def stats_overview(a: DataFrame) -> DataFrame:
    """Totals of all rows: canonical, duplicates, sentiments, paywalled."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return a.agg(
        F.count("*").alias("total"), n(F.col("duplicate_of").isNull()).alias("canonical"), n(F.col("duplicate_of").isNotNull()).alias("duplicates"),
        *[n(_is("sentiment", s)).alias(k) for s, k in (("positiv", "positive"), ("negativ", "negative"), ("neutral", "neutral"))], n(F.col("paywall")).alias("paywalled"),
    )


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def tag_counts(tags: DataFrame) -> DataFrame:
    """Articles by tag; tags in lower case without outer blanks, each once an article."""
    t = F.trim(F.lower("tag"))
    return tags.where(t != "").select("article_id", t.alias("tag")).distinct().groupBy("tag").agg(F.count("*").alias("n"))


def tags_by_prefix(tags: DataFrame) -> DataFrame:
    """Distinct tags and uses by the part before the colon."""
    t = tags.where(F.trim("tag") != "").select(F.trim(F.lower("tag")).alias("tag"))
    return t.groupBy(F.substring_index("tag", ":", 1).alias("prefix")).agg(F.count_distinct("tag").alias("n_tags"), F.count("*").alias("n_uses"))


def entities_by_type(entities: DataFrame) -> DataFrame:
    by = entities.groupBy("entity_type", "entity_value")
    return by.agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions"), F.round(F.avg("confidence"), 6).alias("confidence"))


def top_entities(entities: DataFrame, articles: DataFrame, limit: int = 200) -> DataFrame:
    """Entities of canonical articles by distinct articles, mentions, title hits and mean confidence."""
    e = entities.join(articles.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    by = e.groupBy("entity_type", "entity_value").agg(F.count_distinct("article_id").alias("n_articles"), F.sum("mentions").alias("mentions"), F.sum("in_title").alias("title_hits"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return by.orderBy(F.desc("n_articles"), F.desc("mentions"), "entity_type", "entity_value").limit(limit)


def facets(a: DataFrame, tags: DataFrame, top: int = 25) -> DataFrame:
    """(facet, value, n) of seven scalar dimensions in one pass (an expand of grouping sets) and of tags; source and tag only their top values."""
    yes = lambda c: F.when(c, "yes").otherwise("no")
    pairs = {"source": F.col("source"), "category": F.col("category"), "sentiment": F.col("sentiment"), "type": F.col("article_type"), "language": F.col("language"), "paywall": yes(F.col("paywall")), "image": yes(F.coalesce(F.col("meta.image"), F.col("meta.og_image"), F.lit("")) != "")}
    scalar = a.select(F.explode(F.array(*[F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value")) for k, v in pairs.items()])).alias("f")).select("f.facet", "f.value")
    tagged = tags.where(F.trim("tag") != "").select("article_id", F.trim(F.lower("tag")).alias("value")).distinct().join(a.select(F.col("id").alias("article_id")), "article_id", "left_semi").select(F.lit("tag").alias("facet"), "value")
    n = scalar.unionByName(tagged).groupBy("facet", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return n.withColumn("r", rank).where(~F.col("facet").isin("source", "tag") | (F.col("r") <= top)).drop("r")


def kpis(a: DataFrame, today: str) -> DataFrame:
    """Three nested windows (1, 7, 30 days up to ``today``) in one pass, and growth against the window before."""
    d = F.lit(today).cast("date")
    out = []
    for n in (1, 7, 30):
        inside = (F.col("day") > F.date_sub(d, n)) & (F.col("day") <= d)
        earlier = (F.col("day") > F.date_sub(d, 2 * n)) & (F.col("day") <= F.date_sub(d, n))
        out.append(F.struct(F.lit(n).alias("days"), F.count_if(inside).alias("n"), F.count_if(earlier).alias("n_before"), F.round(F.avg(F.when(inside, F.col("relevance_score"))), 6).alias("relevance"), F.count_if(inside & _is("sentiment", "positiv")).alias("positive"), F.count_if(inside & _is("sentiment", "negativ")).alias("negative"), F.count_if(inside & F.col("paywall")).alias("paywalled")))
    return a.agg(F.array(*out).alias("w")).select(F.explode("w").alias("w")).select("w.*").withColumn("growth", share(F.col("n") - F.col("n_before"), F.nullif("n_before", F.lit(0))))


def sentiment_summary(a: DataFrame) -> DataFrame:
    n = counts(a, "sentiment")
    return n.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))


def filled_days(a: DataFrame) -> DataFrame:
    """Articles a day, with zeros for days without any (a spine between the first and last day)."""
    n = a.where("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    spine = n.agg(F.min("day").alias("a"), F.max("day").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(n, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))


def by_category(a: DataFrame, top: int = 5) -> DataFrame:
    """The best articles of each category."""
    w = Window.partitionBy("category").orderBy(F.desc("relevance_score"), "id")
    return a.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("category", "rank", "id", "title", "relevance_score")


def source_metrics(a: DataFrame) -> DataFrame:
    """Size, mean non-zero relevance, mean words, sentiment and paywall shares, quality and bias by source."""
    n = F.count("*")
    m = a.groupBy("source").agg(
        n.alias("n"), F.coalesce(F.avg(F.when(F.col("relevance_score") != 0, F.col("relevance_score"))), F.lit(0.0)).alias("relevance"), F.avg("word_count").alias("words"),
        *[(F.count_if(_is("sentiment", s)) / n).alias(k) for s, k in (("positiv", "positive"), ("negativ", "negative"), ("neutral", "neutral"))], (F.count_if(F.col("paywall")) / n).alias("paywalled"),
    )
    quality = F.least(F.col("relevance"), F.lit(100)) * 0.5 + F.least(F.col("words") / 10, F.lit(30)) + F.least(F.col("n"), F.lit(20)) * 1.0 - 10 * F.col("paywalled")
    bias = F.when(F.col("positive") > 0.5, "positive_bias").when(F.col("negative") > 0.5, "negative_bias").otherwise("balanced")
    six = lambda c: F.round(c, 6).alias(c)
    return m.select("source", "n", *map(six, ("relevance", "words", "positive", "negative", "neutral", "paywalled")), F.round(quality, 6).alias("quality"), bias.alias("bias"))


def source_ranking(a: DataFrame) -> DataFrame:
    """Sources in order of quality; biased ones lose 15 points of trust."""
    m = source_metrics(a)
    return m.select("source", "quality", "bias", F.row_number().over(Window.orderBy(F.desc("quality"), "source")).alias("rank"), F.round(F.col("quality") - F.when(F.col("bias") == "balanced", 0).otherwise(15), 6).alias("trust"))


def reach(priority: Column) -> Column:
    """0.5 to 1.5 by priority 0 to 100, 50 where unknown."""
    return 0.5 + F.least(F.greatest(F.coalesce(priority, F.lit(50)), F.lit(0)), F.lit(100)) / 100


def resonance(a: DataFrame, feeds: DataFrame) -> DataFrame:
    """Every article's resonance: relevance by reach and prominence of its kind and length."""
    f = feeds.select(F.col("name").alias("source"), "priority")
    kind = F.when(F.col("article_type") == "review", 1.0).when(F.col("article_type") == "interview", 0.9).when(F.col("article_type") == "announcement", 0.6).otherwise(0.7)
    prominence = F.greatest(kind + F.when(F.col("word_count") >= 400, 0.3).when(F.col("word_count") < 100, -0.3).otherwise(0.0), F.lit(0.3))
    r = F.floor(F.greatest("relevance_score", F.lit(1)) * reach(F.col("priority")) * prominence + 0.5)
    return a.join(f, "source", "left").select("id", "source", "article_type", "sentiment", "sentiment_score", "day", r.cast("bigint").alias("resonance"))


def resonance_totals(r: DataFrame) -> DataFrame:
    return r.groupBy("source").agg(F.count("*").alias("n"), F.sum("resonance").alias("resonance"), F.sum(F.when(_is("article_type", "review"), F.col("resonance")).otherwise(0)).alias("review_resonance"), F.round(F.avg("resonance"), 6).alias("mean"))


def resonance_by_entity(r: DataFrame, entities: DataFrame, kind: str) -> DataFrame:
    """Resonance, mentions, sentiment and reviews of each entity of one type."""
    e = entities.where(F.col("entity_type") == kind).groupBy("article_id", "entity_value").agg(F.max("mentions").alias("mentions"))
    j = r.join(e, r["id"] == e["article_id"])
    return j.groupBy("entity_value").agg(F.count("*").alias("n_articles"), F.sum("resonance").alias("resonance"), F.sum("mentions").alias("mentions"), F.round(F.avg(F.coalesce("sentiment_score", F.lit(0))), 6).alias("sentiment"), F.count_if(_is("article_type", "review")).alias("reviews"))


def share_of_voice(per: DataFrame, value: str = "resonance") -> DataFrame:
    """Each row's part of the sum, in percent; no row if the sum is 0."""
    total = F.sum(value).over(Window.partitionBy())
    return per.withColumn("t", total).where("t <> 0").withColumn("share", F.round(100 * F.col(value) / F.col("t"), 1)).drop("t")


def sentiment_timeline(a: DataFrame) -> DataFrame:
    six = [F.count_if(_is("sentiment", s)).alias(k) for s, k in (("positiv", "positive"), ("negativ", "negative"), ("neutral", "neutral"))]
    return a.where("day is not null").groupBy("day").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("sentiment_score", F.lit(0))), 6).alias("sentiment"), *six)


def consensus(a: DataFrame) -> DataFrame:
    """What the reviews of each source agree on: twice as many of one side make a majority."""
    r = a.where(_is("article_type", "review")).groupBy("source").agg(F.count("*").alias("reviews"), *[F.count_if(_is("sentiment", s)).alias(k) for s, k in (("positiv", "pos"), ("negativ", "neg"))])
    label = F.when((F.col("pos") > 0) & (F.col("pos") >= 2 * F.col("neg")), "mostly_positive").when((F.col("neg") > 0) & (F.col("neg") >= 2 * F.col("pos")), "mostly_negative").otherwise("divided")
    return r.withColumn("consensus", label)


def mention_trends(entities: DataFrame) -> DataFrame:
    by = entities.groupBy("entity_type", "entity_value", F.to_date("created_at").alias("day"))
    return by.agg(F.count_distinct("article_id").alias("n_articles"), F.sum("mentions").alias("mentions"))


def mention_spikes(entities: DataFrame, last: int = 3, ratio: float = 2.0) -> DataFrame:
    """Entities whose mean over their last days with mentions is more than ``ratio`` times that of all days before."""
    t = mention_trends(entities)
    r = t.withColumn("r", F.row_number().over(Window.partitionBy("entity_type", "entity_value").orderBy(F.desc("day"))))
    g = r.groupBy("entity_type", "entity_value").agg(F.avg(F.when(F.col("r") <= last, F.col("mentions"))).alias("recent"), F.avg(F.when(F.col("r") > last, F.col("mentions"))).alias("earlier"))
    return g.where((F.col("earlier") > 0) & (F.col("recent") > ratio * F.col("earlier"))).select("entity_type", "entity_value", F.round("recent", 6).alias("recent"), F.round("earlier", 6).alias("earlier"), F.round(F.col("recent") / F.col("earlier"), 6).alias("ratio"))


def entity_timeline(entities: DataFrame, a: DataFrame) -> DataFrame:
    """Articles, mentions and the prevailing sentiment of each entity and day; ties go to the latest article."""
    e = entities.select("entity_type", "entity_value", "article_id", "mentions", F.to_date("created_at").alias("day")).join(a.select(F.col("id").alias("article_id"), "sentiment"), "article_id")
    one = e.groupBy("entity_type", "entity_value", "day", "sentiment").agg(F.count("*").alias("n"), F.sum("mentions").alias("m"), F.max("article_id").alias("latest"))
    return one.groupBy("entity_type", "entity_value", "day").agg(F.sum("n").alias("n"), F.sum("m").alias("mentions"), F.max_by("sentiment", F.struct("n", "latest")).alias("sentiment"))


def score_distribution(a: DataFrame, value: str = "relevance_score") -> DataFrame:
    v = F.col(value)
    return a.agg(F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.stddev_pop(v), 6).alias("deviation"))


def source_report(a: DataFrame) -> DataFrame:
    by = a.groupBy("source").agg(F.count("*").alias("n"), F.sum("relevance_score").alias("total"), F.round(F.avg("relevance_score"), 6).alias("mean"))
    return by.withColumn("reliability", F.when(F.col("n") >= 5, "high").when(F.col("n") >= 2, "medium").otherwise("low"))


def comparative(a: DataFrame, at: str) -> DataFrame:
    """Mean relevance before and from a day on, and the change in percent."""
    before, after = F.avg(F.when(F.col("day") < at, F.col("relevance_score"))), F.avg(F.when(F.col("day") >= at, F.col("relevance_score")))
    d = a.agg(F.count_if(F.col("day") < at).alias("n_before"), F.count_if(F.col("day") >= at).alias("n_after"), before.alias("b"), after.alias("a"))
    return d.select("n_before", "n_after", F.round("b", 6).alias("mean_before"), F.round("a", 6).alias("mean_after"), F.round(F.try_divide(100 * (F.col("a") - F.col("b")), F.col("b")), 6).alias("change"))


def qa_issues(a: DataFrame) -> DataFrame:
    """(id, issue, severity): one row for each rule an article breaks."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    rules = [("missing_title", "high", blank("title")), ("missing_text", "high", blank("full_text")), ("missing_date", "medium", F.col("day").isNull()), ("short_text", "medium", F.col("word_count") < 50), ("missing_author", "low", blank("author"))]
    issues = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("issue"), F.lit(s).alias("severity"))) for n, s, c in rules]))
    return a.select("id", F.explode(issues).alias("i")).select("id", "i.*")


def qa_summary(a: DataFrame) -> DataFrame:
    rank = F.when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).otherwise(3)
    return qa_issues(a).groupBy("severity", "issue").agg(F.count("*").alias("n")).withColumn("severity_rank", rank)


def coverage_density(a: DataFrame, events: DataFrame, days: int = 30) -> DataFrame:
    """Articles within ``days`` before and after each event: a band join on day buckets, so that no pair is met outside its band.

    ``events`` has event_id and day. Gives totals, the fullest day (the first of equals) and articles per day.
    """
    width = 2 * days + 1
    e = events.select("event_id", F.col("day").alias("at")).withColumn("b", F.explode(F.sequence(F.floor((F.unix_date("at") - days) / width), F.floor((F.unix_date("at") + days) / width))))
    x = a.where("day is not null").groupBy("day").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.unix_date("day") / width))
    j = e.join(x, "b").where(F.abs(F.datediff("day", "at")) <= days)
    return j.groupBy("event_id").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("day") < F.col("at"), F.col("n")).otherwise(0)).alias("before"), F.sum(F.when(F.col("day") > F.col("at"), F.col("n")).otherwise(0)).alias("after"), F.max_by("day", F.struct("n", -F.unix_date("day"))).alias("peak"), F.round(F.sum("n") / (2 * days), 6).alias("density"))


def period_trend(a: DataFrame) -> DataFrame:
    """Mean relevance of the two halves of the time span; 10 % make a trend."""
    span = a.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select(F.expr("date_add(lo, cast(datediff(hi, lo) / 2 as int))").alias("mid")).first()
    mid = F.lit(span["mid"]).cast("date")
    d = a.where("day is not null").agg(F.avg(F.when(F.col("day") <= mid, F.col("relevance_score"))).alias("first"), F.avg(F.when(F.col("day") > mid, F.col("relevance_score"))).alias("second"))
    change = F.try_divide(F.col("second") - F.col("first"), F.col("first"))
    return d.select(F.round("first", 6).alias("first"), F.round("second", 6).alias("second"), F.when(change > 0.1, "increasing").when(change < -0.1, "decreasing").otherwise("stable").alias("trend"))


def week_key(day: Column) -> Column:
    """year-Wn with weeks of seven days from the first of January."""
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.ceil(F.dayofyear(day) / 7).cast("string"))


def sentiment_evolution(a: DataFrame) -> DataFrame:
    by = a.where("day is not null").groupBy(week_key(F.col("day")).alias("week"))
    d = by.agg(F.count("*").alias("n"), F.count_if(_is("sentiment", "positiv")).alias("pos"), F.count_if(_is("sentiment", "negativ")).alias("neg"))
    return d.withColumn("balance", F.round((F.col("pos") - F.col("neg")) / F.col("n"), 6))


def anomalies(a: DataFrame, sigma: float = 2.0) -> DataFrame:
    """Days whose article count is more than ``sigma`` deviations from the mean; needs three days."""
    n = a.where("day is not null").groupBy("day").agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    d = n.withColumns({"mean": F.avg("n").over(w), "dev": F.stddev_pop("n").over(w), "days": F.count("*").over(w)})
    return d.where((F.col("days") >= 3) & (F.abs(F.col("n") - F.col("mean")) > sigma * F.col("dev"))).select("day", "n", F.round("mean", 6).alias("mean"), F.when(F.col("n") > F.col("mean"), "spike").otherwise("drop").alias("kind"))


def timeline_summary(a: DataFrame) -> DataFrame:
    d = a.where("day is not null").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"), F.round(F.avg("relevance_score"), 6).alias("mean"))
    return d.withColumn("days", F.datediff("last", "first").cast("bigint"))


def diversity(a: DataFrame) -> DataFrame:
    return a.agg(F.count_distinct("category").alias("categories"), F.count_distinct("source").alias("sources"), F.count_distinct("author").alias("authors"))


def velocity(entities: DataFrame) -> DataFrame:
    """Entities an hour between the first and last one, by type; the count itself if there is no span."""
    d = entities.groupBy("entity_type").agg(F.count("*").alias("n"), F.min("created_at").alias("a"), F.max("created_at").alias("b"))
    hours = (F.unix_micros("b") - F.unix_micros("a")) / 3_600_000_000
    return d.select("entity_type", "n", F.round(F.when(hours > 0, F.col("n") / hours).otherwise(F.col("n")), 6).alias("per_hour"))


def running_share(n: DataFrame, key: str, value: str = "n") -> DataFrame:
    """Rows in order of size with their percentage, the percentages so far and the ratio to the largest."""
    w = Window.orderBy(F.desc(value), key)
    p = 100 * F.col(value) / F.sum(value).over(Window.partitionBy())
    return n.select(key, value, F.round(p, 6).alias("percent"), F.round(100 * F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy()), 6).alias("so_far"), F.round(F.col(value) / F.max(value).over(Window.partitionBy()), 6).alias("of_largest"))
