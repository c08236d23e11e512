"""Scans, joins, aggregations, windows and set operations over the stored tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics as A
from ..schema import with_days
from ..session import join_dimension, table
from .common import ARTICLES, DATED, ENTITIES, RESONANCE, articles, entities

FROM, TO, TODAY = "2025-03-01", "2025-12-31", "2025-12-31"
#: Parts of a hot entity in a join; results do not depend on it.
SALTS = 8


def _on(f):
    """A query that applies ``f`` to the canonical articles."""
    return lambda s, d: f(articles(s, d))


def range_scan(s, d):
    """Canonical articles of a closed range of days, best first."""
    a = articles(s, d).where(F.col("day").between(FROM, TO))
    return a.select("id", "title", "source", "relevance_score", "day").orderBy(F.desc("relevance_score"), F.desc("day"), "id")


def range_scan_all(s, d):
    """The same range with duplicates."""
    a = with_days(table(s, d, "articles"), table(s, d, "feeds")).where(F.col("day").between(FROM, TO) & F.col("deleted_at").isNull())
    return a.select("id", "title", "duplicate_of", "day").orderBy(F.desc("day"), "id")


def bookmarks_join(s, d):
    b = table(s, d, "bookmarks").select("article_id", "note", F.unix_micros("created_at").alias("bookmarked_at"))
    return table(s, d, "articles").select(F.col("id").alias("article_id"), "title").join(b, "article_id").orderBy(F.desc("bookmarked_at"))


def tags_collect(s, d):
    """Every canonical article with its sorted tags and whether it is bookmarked."""
    t = table(s, d, "article_tags").where(F.trim("tag") != "").groupBy("article_id").agg(F.array_join(F.array_sort(F.collect_set(F.trim(F.lower("tag")))), ",").alias("tags"))
    b = table(s, d, "bookmarks").select("article_id", F.lit(True).alias("bookmarked"))
    return articles(s, d).select(F.col("id").alias("article_id")).join(t, "article_id", "left").join(b, "article_id", "left").select("article_id", F.coalesce("tags", F.lit("")).alias("tags"), F.coalesce("bookmarked", F.lit(False)).alias("bookmarked"))


def feeds_health(s, d):
    """Feeds with the state of their source."""
    h = table(s, d, "source_health").groupBy("source").agg(F.max("consecutive_failures").alias("failures"), F.max("last_success").alias("last_success"), F.max_by("last_error_class", F.coalesce("consecutive_failures", F.lit(-1))).alias("error"))
    j = table(s, d, "feeds").select(F.col("name").alias("source"), "priority", "disabled").join(h, "source", "left")
    return j.withColumn("status", health_status(F.col("failures"), F.col("error"), F.col("last_success"))).drop("last_success")


def health_status(failures, error, last_success):
    """blocked, dead, degraded, ok or unknown of a source's failure count and last error class."""
    bad = F.coalesce(failures, F.lit(0))
    return F.when((bad > 0) & (error == "forbidden"), "blocked").when((bad > 0) & error.isin("gone", "notfound"), "dead").when(bad >= 4, "dead").when(bad >= 1, "degraded").when(last_success.isNotNull(), "ok").otherwise("unknown")


def new_items(s, d):
    """Items of feeds whose normalized URL is not among the bookmarked ones: an anti join."""
    known = table(s, d, "articles").join(table(s, d, "bookmarks").select(F.col("article_id").alias("id")), "id", "left_semi").select("url_normalized")
    return articles(s, d).select("id", "url_normalized").join(known, "url_normalized", "left_anti")


def trend_join(s, d):
    """Tags of the later half of all taggings against the earlier half, with their change."""
    t = table(s, d, "article_tags").where(F.trim("tag") != "").select(F.trim(F.lower("tag")).alias("tag"), F.to_date("created_at").alias("day"))
    late = t.where("day >= '2025-09-01'").groupBy("tag").agg(F.count("*").alias("n_late"))
    early = t.where("day < '2025-09-01'").groupBy("tag").agg(F.count("*").alias("n_early"))
    return late.join(early, "tag", "left").select("tag", "n_late", F.coalesce("n_early", F.lit(0)).alias("n_early"), (F.col("n_late") - F.coalesce("n_early", F.lit(0))).alias("change"))


def fused_scores(s, d):
    """Tag and entity scores of each article, from a full outer join."""
    t = table(s, d, "article_tags").where(F.trim("tag") != "").groupBy("article_id").agg(F.count_distinct(F.trim(F.lower("tag"))).alias("n_tags"))
    e = entities(s, d).groupBy("article_id").agg(F.sum("mentions").alias("mentions"))
    return t.join(e, "article_id", "full").select("article_id", F.round(0.65 * F.coalesce("n_tags", F.lit(0)) + 0.35 * F.coalesce("mentions", F.lit(0)), 6).alias("score"))


def entities_in_range(s, d):
    """Entities of canonical articles in a range of days: an inner join."""
    e = entities(s, d)
    j = e.join(articles(s, d).where(F.col("day").between(FROM, TO)).select(F.col("id").alias("article_id"), "source"), "article_id")
    return j.groupBy("source", "entity_type").agg(F.count("*").alias("n"), F.sum("mentions").alias("mentions"))


def rollup_source_type(s, d):
    a = articles(s, d)
    return a.rollup("source", "article_type").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def cube_facets(s, d):
    return articles(s, d).cube("sentiment", "category").agg(F.count("*").alias("n"), F.round(F.avg("relevance_score"), 6).alias("relevance"))


def star_join_revenue(s, d):
    """Revenue by nation and year: lineitem with orders, customer, nation and region."""
    li, o, c, n, r = (table(s, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    j = join_dimension(j, n.withColumn("c_nationkey", F.col("n_nationkey")), "c_nationkey", "inner").join(r.withColumn("n_regionkey", F.col("r_regionkey")), "n_regionkey")
    return j.groupBy("r_name", "n_name", F.year("o_orderdate").alias("year")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def topk_orders(s, d):
    """The three largest orders of each customer segment and year."""
    o = table(s, d, "orders").join(table(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    w = Window.partitionBy("c_mktsegment", F.year("o_orderdate")).orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("c_mktsegment", F.year("o_orderdate").alias("year"), "rank", "o_orderkey", "o_totalprice")


def pricing_summary(s, d):
    """The pricing summary of shipped items."""
    li = table(s, d, "lineitem").where("l_shipdate <= date '1998-09-02'")
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(price), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def set_operations(s, d):
    """Sources by where they are known: feeds, articles, documents, health (union, intersect, except)."""
    f = table(s, d, "feeds").select(F.col("name").alias("source"))
    a, c, h = (table(s, d, t).select("source").where("source is not null") for t in ("articles", "documents", "source_health"))
    tag = lambda x, n: x.select("source", F.lit(n).alias("part"))
    return tag(f.union(a).union(c).union(h).distinct(), "any").unionByName(tag(a.intersect(c), "articles_and_documents")).unionByName(tag(h.exceptAll(f).distinct(), "health_only"))


def also_on_union(s, d):
    """Ordered distinct union of a canonical row's places and those of its direct duplicates."""
    a = table(s, d, "articles")
    losers = a.where("duplicate_of is not null and duplicate_of <> id").select(F.col("duplicate_of").alias("id"), F.concat(F.coalesce("also_on", F.array().cast("array<string>")), F.array("url")).alias("more"), F.col("id").alias("loser"))
    more = losers.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("loser", "more"))), lambda x: x["more"])).alias("more"))
    j = a.select("id", "also_on").join(more, "id")
    return j.select("id", F.array_join(F.array_distinct(F.concat(F.coalesce("also_on", F.array().cast("array<string>")), "more")), " ").alias("places"))


def title_updates(s, d):
    """Consecutive articles under one normalised title: the pair, days between and whether the source changed."""
    t = F.trim(F.regexp_replace(F.lower("title"), r"[^\p{L}\p{N}]+", " "))
    a = articles(s, d).where("day is not null and title is not null").withColumn("key", t)
    w = Window.partitionBy("key").orderBy("day", "id")
    v = a.withColumns({"before": F.lag("id").over(w), "gap": F.datediff("day", F.lag("day").over(w)).cast("bigint"), "changed": F.col("source") != F.lag("source").over(w)})
    return v.where("before is not null").select("key", "before", F.col("id").alias("after"), "gap", "changed")


def failure_runs(s, d):
    """Longest and last run of errors of each user's events: gaps and islands, reset by success."""
    e = table(s, d, "events").select("user_id", "event_id", "ts", (F.col("event_type") == "error").alias("bad"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = e.withColumn("island", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = g.where("bad").groupBy("user_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"), F.max_by("n", "island").alias("latest"))


def update_tags_union(s, d):
    """Tags after adding and removing: union, distinct, anti join."""
    t = table(s, d, "article_tags").where(F.trim("tag") != "").select("article_id", F.trim(F.lower("tag")).alias("tag")).distinct()
    new = table(s, d, "article_tags").select("article_id").distinct().select("article_id", F.lit("status:geprueft").alias("tag"))
    return t.unionByName(new).distinct().join(t.where("tag like 'tonalitaet:%'"), ["article_id", "tag"], "left_anti")


def related_articles(s, d):
    """For every article whose id is divisible by 50 those that share at least two entities with it within fourteen days, however frequent the entities are.

    Joined on entity and fortnight; salted, as a few entities stand in a large share of all articles.
    """
    e = entities(s, d).select("article_id", "entity_type", "entity_value").distinct()
    a = articles(s, d).where("day is not null").select(F.col("id").alias("article_id"), "day", F.floor(F.unix_date("day") / 14).alias("fortnight"))
    y = e.join(a, "article_id").select("entity_type", "entity_value", "fortnight", F.pmod(F.xxhash64("article_id"), F.lit(SALTS)).alias("salt"), F.col("article_id").alias("other"), F.col("day").alias("other_day"))
    x = e.join(a.where("article_id % 50 = 0"), "article_id").withColumn("fortnight", F.explode(F.sequence(F.col("fortnight") - 1, F.col("fortnight") + 1)))
    x = x.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    j = x.join(y, ["entity_type", "entity_value", "fortnight", "salt"]).where((F.col("article_id") != F.col("other")) & (F.abs(F.datediff("day", "other_day")) <= 14))
    return j.groupBy("article_id", "other").agg(F.count("*").alias("shared")).where("shared >= 2")


def _density(s, d):
    ev = table(s, d, "events").where("event_type = 'signup'").groupBy(F.to_date("ts").alias("day0")).agg(F.min("event_id").alias("event_id")).select("event_id", F.date_add("day0", 400).alias("day"))
    return A.coverage_density(articles(s, d), ev)


QUERIES = {
    "range_scan": range_scan, "range_scan_all": range_scan_all, "dedup_projection": lambda s, d: articles(s, d).where(F.col("day") >= FROM).select("id", "url", "title", "source", "first_paragraph", "day"),
    "high_relevance": lambda s, d: articles(s, d).where((F.col("relevance_score") >= 80) & (F.col("day") >= FROM)).select("id", "relevance_score").orderBy(F.desc("relevance_score"), "id"),
    "retag_scan": lambda s, d: table(s, d, "articles").where("deleted_at is null").select("id", "title", "summary", "sentiment", "category", "paywall"),
    "stats_overview": lambda s, d: A.stats_overview(table(s, d, "articles")), "count_by_source": _on(lambda a: A.counts(a, "source")), "tag_counts": lambda s, d: A.tag_counts(table(s, d, "article_tags")),
    "tags_by_prefix": lambda s, d: A.tags_by_prefix(table(s, d, "article_tags")), "entities_by_type": lambda s, d: A.entities_by_type(table(s, d, "article_entities")),
    "top_entities": lambda s, d: A.top_entities(entities(s, d), articles(s, d)), "facets": lambda s, d: A.facets(articles(s, d), table(s, d, "article_tags")), "kpis": _on(lambda a: A.kpis(a, TODAY)),
    "sentiment_summary": _on(A.sentiment_summary), "filled_days": _on(A.filled_days), "by_category": _on(A.by_category), "source_metrics": _on(A.source_metrics), "source_ranking": _on(A.source_ranking),
    "resonance": lambda s, d: A.resonance(articles(s, d), table(s, d, "feeds")).select("id", "resonance"), "resonance_totals": lambda s, d: A.resonance_totals(A.resonance(articles(s, d), table(s, d, "feeds"))),
    "resonance_by_person": lambda s, d: A.resonance_by_entity(A.resonance(articles(s, d), table(s, d, "feeds")), entities(s, d), "person"),
    "share_of_voice": lambda s, d: A.share_of_voice(A.resonance_totals(A.resonance(articles(s, d), table(s, d, "feeds"))).select("source", "resonance")),
    "sentiment_timeline": _on(A.sentiment_timeline), "consensus": _on(A.consensus), "mention_trends": lambda s, d: A.mention_trends(entities(s, d)), "mention_spikes": lambda s, d: A.mention_spikes(entities(s, d)),
    "top_mentions": lambda s, d: entities(s, d).groupBy("entity_type", "entity_value").agg(F.sum("mentions").alias("mentions"), F.count("*").alias("n")).orderBy(F.desc("mentions"), F.desc("n"), "entity_type", "entity_value").limit(50),
    "entity_timeline": lambda s, d: A.entity_timeline(entities(s, d), articles(s, d)), "score_distribution": _on(A.score_distribution), "source_report": _on(A.source_report), "comparative": _on(lambda a: A.comparative(a, "2025-09-01")),
    "qa_issues": _on(A.qa_issues), "qa_summary": _on(A.qa_summary), "coverage_density": _density, "period_trend": _on(A.period_trend), "sentiment_evolution": _on(A.sentiment_evolution), "anomalies": _on(A.anomalies),
    "timeline_summary": _on(A.timeline_summary), "diversity": _on(A.diversity), "velocity": lambda s, d: A.velocity(entities(s, d)), "running_share": _on(lambda a: A.running_share(A.counts(a, "source"), "source")),
    "bookmarks_join": bookmarks_join, "tags_collect": tags_collect, "feeds_health": feeds_health, "health_histogram": lambda s, d: A.counts(feeds_health(s, d), "status"), "new_items": new_items, "trend_join": trend_join, "fused_scores": fused_scores,
    "entities_in_range": entities_in_range, "rollup_source_type": rollup_source_type, "cube_facets": cube_facets, "star_join_revenue": star_join_revenue, "topk_orders": topk_orders, "pricing_summary": pricing_summary,
    "set_operations": set_operations, "also_on_union": also_on_union, "title_updates": title_updates, "failure_runs": failure_runs, "update_tags_union": update_tags_union, "related_articles": related_articles,
}

_A, _E, _R = f"WITH {ARTICLES} ", f"WITH {ENTITIES} ", f"WITH {ARTICLES}, {RESONANCE} "
_TAG = "SELECT DISTINCT article_id, trim(lower(tag), ' ') AS tag FROM article_tags WHERE trim(tag, ' ') <> ''"
_METRICS = """m AS (SELECT source, count(*) AS n, coalesce(avg(CASE WHEN relevance_score <> 0 THEN relevance_score END), 0) AS relevance, avg(word_count) AS words, count(*) FILTER (sentiment = 'positiv') / count(*) AS positive, count(*) FILTER (sentiment = 'negativ') / count(*) AS negative,
 count(*) FILTER (sentiment = 'neutral') / count(*) AS neutral, count(*) FILTER (paywall) / count(*) AS paywalled FROM a GROUP BY source), q AS (SELECT *, least(relevance, 100) * 0.5::DOUBLE + least(words / 10, 30) + least(n, 20) - 10 * paywalled AS quality, CASE WHEN positive > 0.5 THEN 'positive_bias' WHEN negative > 0.5 THEN 'negative_bias' ELSE 'balanced' END AS bias FROM m)"""
_HEALTH = """h AS (SELECT source, max(consecutive_failures) AS failures, max(last_success) AS last_success, arg_max(last_error_class, coalesce(consecutive_failures, -1)) AS error FROM source_health GROUP BY source),
 k AS (SELECT name AS source, priority, disabled, failures, error, CASE WHEN failures > 0 AND error = 'forbidden' THEN 'blocked' WHEN failures > 0 AND error IN ('gone', 'notfound') THEN 'dead' WHEN failures >= 4 THEN 'dead' WHEN failures >= 1 THEN 'degraded' WHEN last_success IS NOT NULL THEN 'ok' ELSE 'unknown' END AS status FROM feeds LEFT JOIN h ON h.source = name)"""
SQL = {
    "range_scan": _A + f"SELECT id, title, source, relevance_score, day FROM a WHERE day BETWEEN '{FROM}' AND '{TO}' ORDER BY relevance_score DESC, day DESC, id",
    "range_scan_all": f"WITH {DATED} SELECT id, title, duplicate_of, day FROM dated WHERE day BETWEEN '{FROM}' AND '{TO}' AND deleted_at IS NULL",
    "dedup_projection": _A + f"SELECT id, url, title, source, first_paragraph, day FROM a WHERE day >= '{FROM}'", "high_relevance": _A + f"SELECT id, relevance_score FROM a WHERE relevance_score >= 80 AND day >= '{FROM}'",
    "retag_scan": "SELECT id, title, summary, sentiment, category, paywall FROM articles WHERE deleted_at IS NULL",
    "stats_overview": "SELECT count(*) AS total, count(*) FILTER (duplicate_of IS NULL) AS canonical, count(duplicate_of) AS duplicates, count(*) FILTER (sentiment = 'positiv') AS positive, count(*) FILTER (sentiment = 'negativ') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) FILTER (paywall) AS paywalled FROM articles",
    "count_by_source": _A + "SELECT source, count(*) AS n FROM a GROUP BY source", "tag_counts": f"SELECT tag, count(*) AS n FROM ({_TAG}) GROUP BY tag",
    "tags_by_prefix": "SELECT split_part(tag, ':', 1) AS prefix, count(DISTINCT tag) AS n_tags, count(*) AS n_uses FROM (SELECT trim(lower(tag), ' ') AS tag FROM article_tags WHERE trim(tag, ' ') <> '') GROUP BY 1",
    "entities_by_type": "SELECT entity_type, entity_value, count(*) AS n, CAST(sum(mentions) AS BIGINT) AS mentions, round(avg(confidence), 6) AS confidence FROM article_entities GROUP BY 1, 2",
    "top_entities": f"WITH {ARTICLES}, {ENTITIES} SELECT entity_type, entity_value, count(DISTINCT article_id) AS n_articles, CAST(sum(mentions) AS BIGINT) AS mentions, CAST(sum(in_title) AS BIGINT) AS title_hits, round(avg(confidence), 6) AS confidence FROM e WHERE article_id IN (SELECT id FROM a) GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 200",
    "facets": _A + f""", x AS (SELECT unnest([{{'facet': 'source', 'value': source}}, {{'facet': 'category', 'value': category}}, {{'facet': 'sentiment', 'value': sentiment}}, {{'facet': 'type', 'value': article_type}}, {{'facet': 'language', 'value': language}}, {{'facet': 'paywall', 'value': if(paywall, 'yes', 'no')}}, {{'facet': 'image', 'value': if(coalesce(meta.image, meta.og_image, '') <> '', 'yes', 'no')}}]) AS f FROM a),
 y AS (SELECT f.facet, f.value FROM x UNION ALL SELECT 'tag', tag FROM ({_TAG}) WHERE article_id IN (SELECT id FROM a)), z AS (SELECT facet, value, count(*) AS n FROM y GROUP BY 1, 2)
 SELECT facet, value, n FROM z QUALIFY facet NOT IN ('source', 'tag') OR row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 25""",
    "kpis": _A + ", w AS (" + " UNION ALL ".join(f"SELECT {n} AS days, count(*) FILTER (day > DATE '{TODAY}' - {n} AND day <= DATE '{TODAY}') AS n, count(*) FILTER (day > DATE '{TODAY}' - {2 * n} AND day <= DATE '{TODAY}' - {n}) AS n_before, round(avg(relevance_score) FILTER (day > DATE '{TODAY}' - {n} AND day <= DATE '{TODAY}'), 6) AS relevance, count(*) FILTER (day > DATE '{TODAY}' - {n} AND day <= DATE '{TODAY}' AND sentiment = 'positiv') AS positive, count(*) FILTER (day > DATE '{TODAY}' - {n} AND day <= DATE '{TODAY}' AND sentiment = 'negativ') AS negative, count(*) FILTER (day > DATE '{TODAY}' - {n} AND day <= DATE '{TODAY}' AND paywall) AS paywalled FROM a" for n in (1, 7, 30)) + ") SELECT *, round((n - n_before) / nullif(n_before, 0), 6) AS growth FROM w",
    "sentiment_summary": _A + "SELECT sentiment, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM a GROUP BY sentiment",
    "filled_days": _A + ", n AS (SELECT day, count(*) AS n FROM a WHERE day IS NOT NULL GROUP BY day) SELECT CAST(x.day AS DATE) AS day, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM n) x LEFT JOIN n ON n.day = CAST(x.day AS DATE)",
    "by_category": _A + "SELECT category, CAST(row_number() OVER w AS INTEGER) AS rank, id, title, relevance_score FROM a WINDOW w AS (PARTITION BY category ORDER BY relevance_score DESC, id) QUALIFY row_number() OVER w <= 5",
    "source_metrics": _A + f", {_METRICS} SELECT source, n, round(relevance, 6) AS relevance, round(words, 6) AS words, round(positive, 6) AS positive, round(negative, 6) AS negative, round(neutral, 6) AS neutral, round(paywalled, 6) AS paywalled, round(quality, 6) AS quality, bias FROM q",
    "source_ranking": _A + f", {_METRICS} SELECT source, round(quality, 6) AS quality, bias, CAST(row_number() OVER (ORDER BY round(quality, 6) DESC, source) AS INTEGER) AS rank, round(round(quality, 6) - if(bias = 'balanced', 0, 15), 6) AS trust FROM q",
    "resonance": _R + "SELECT id, resonance FROM r", "resonance_totals": _R + "SELECT source, count(*) AS n, CAST(sum(resonance) AS BIGINT) AS resonance, CAST(sum(if(article_type = 'review', resonance, 0)) AS BIGINT) AS review_resonance, round(avg(resonance), 6) AS mean FROM r GROUP BY source",
    "resonance_by_person": f"WITH {ARTICLES}, {RESONANCE}, {ENTITIES} SELECT entity_value, count(*) AS n_articles, CAST(sum(resonance) AS BIGINT) AS resonance, CAST(sum(mentions) AS BIGINT) AS mentions, round(avg(coalesce(sentiment_score, 0)), 6) AS sentiment, count(*) FILTER (article_type = 'review') AS reviews FROM r JOIN e ON e.article_id = r.id WHERE entity_type = 'person' GROUP BY 1",
    "share_of_voice": _R + "SELECT source, CAST(sum(resonance) AS BIGINT) AS resonance, round(100 * sum(resonance) / sum(sum(resonance)) OVER (), 1) AS share FROM r GROUP BY source",
    "sentiment_timeline": _A + "SELECT day, count(*) AS n, round(avg(coalesce(sentiment_score, 0)), 6) AS sentiment, count(*) FILTER (sentiment = 'positiv') AS positive, count(*) FILTER (sentiment = 'negativ') AS negative, count(*) FILTER (sentiment = 'neutral') AS neutral FROM a WHERE day IS NOT NULL GROUP BY day",
    "consensus": _A + ", r AS (SELECT source, count(*) AS reviews, count(*) FILTER (sentiment = 'positiv') AS pos, count(*) FILTER (sentiment = 'negativ') AS neg FROM a WHERE article_type = 'review' GROUP BY source) SELECT *, CASE WHEN pos > 0 AND pos >= 2 * neg THEN 'mostly_positive' WHEN neg > 0 AND neg >= 2 * pos THEN 'mostly_negative' ELSE 'divided' END AS consensus FROM r",
    "mention_trends": _E + "SELECT entity_type, entity_value, CAST(created_at AS DATE) AS day, count(DISTINCT article_id) AS n_articles, CAST(sum(mentions) AS BIGINT) AS mentions FROM e GROUP BY 1, 2, 3",
    "mention_spikes": _E + ", t AS (SELECT entity_type, entity_value, CAST(created_at AS DATE) AS day, sum(mentions) AS m FROM e GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_value ORDER BY day DESC) AS r FROM t), g AS (SELECT entity_type, entity_value, avg(m) FILTER (r <= 3) AS recent, avg(m) FILTER (r > 3) AS earlier FROM r GROUP BY 1, 2) SELECT entity_type, entity_value, round(recent, 6) AS recent, round(earlier, 6) AS earlier, round(recent / earlier, 6) AS ratio FROM g WHERE earlier > 0 AND recent > 2 * earlier",
    "top_mentions": _E + "SELECT entity_type, entity_value, CAST(sum(mentions) AS BIGINT) AS mentions, count(*) AS n FROM e GROUP BY 1, 2 ORDER BY 3 DESC, 4 DESC, 1, 2 LIMIT 50",
    "entity_timeline": f"WITH {ARTICLES}, {ENTITIES}, o AS (SELECT entity_type, entity_value, CAST(created_at AS DATE) AS day, sentiment, count(*) AS n, sum(mentions) AS m, max(article_id) AS latest FROM e JOIN a ON a.id = e.article_id GROUP BY 1, 2, 3, 4) SELECT entity_type, entity_value, day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(m) AS BIGINT) AS mentions, arg_max(sentiment, (n, latest)) AS sentiment FROM o GROUP BY 1, 2, 3",
    "score_distribution": _A + "SELECT count(relevance_score) AS n, min(relevance_score) AS least, max(relevance_score) AS most, round(avg(relevance_score), 6) AS mean, round(quantile_cont(relevance_score, 0.5), 6) AS median, round(stddev_pop(relevance_score), 6) AS deviation FROM a",
    "source_report": _A + "SELECT source, count(*) AS n, CAST(sum(relevance_score) AS BIGINT) AS total, round(avg(relevance_score), 6) AS mean, CASE WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS reliability FROM a GROUP BY source",
    "comparative": _A + ", x AS (SELECT count(*) FILTER (day < '2025-09-01') AS n_before, count(*) FILTER (day >= '2025-09-01') AS n_after, avg(relevance_score) FILTER (day < '2025-09-01') AS b, avg(relevance_score) FILTER (day >= '2025-09-01') AS c FROM a) SELECT n_before, n_after, round(b, 6) AS mean_before, round(c, 6) AS mean_after, round(100 * (c - b) / b, 6) AS change FROM x",
    "qa_issues": _A + "SELECT id, i.issue, i.severity FROM (SELECT id, unnest(list_filter([if(coalesce(trim(title, ' '), '') = '', {'issue': 'missing_title', 'severity': 'high'}, NULL), if(coalesce(trim(full_text, ' '), '') = '', {'issue': 'missing_text', 'severity': 'high'}, NULL), if(day IS NULL, {'issue': 'missing_date', 'severity': 'medium'}, NULL), if(word_count < 50, {'issue': 'short_text', 'severity': 'medium'}, NULL), if(coalesce(trim(author, ' '), '') = '', {'issue': 'missing_author', 'severity': 'low'}, NULL)], lambda x: x IS NOT NULL)) AS i FROM a)",
    "qa_summary": _A + "SELECT * FROM (SELECT 'high' AS severity, 'missing_title' AS issue, count(*) FILTER (coalesce(trim(title, ' '), '') = '') AS n, 1 AS severity_rank FROM a UNION ALL SELECT 'high', 'missing_text', count(*) FILTER (coalesce(trim(full_text, ' '), '') = ''), 1 FROM a UNION ALL SELECT 'medium', 'missing_date', count(*) FILTER (day IS NULL), 2 FROM a UNION ALL SELECT 'medium', 'short_text', count(*) FILTER (word_count < 50), 2 FROM a UNION ALL SELECT 'low', 'missing_author', count(*) FILTER (coalesce(trim(author, ' '), '') = ''), 3 FROM a) WHERE n > 0",
    "coverage_density": _A + ", v AS (SELECT min(event_id) AS event_id, CAST(ts AS DATE) + 400 AS mid FROM events WHERE event_type = 'signup' GROUP BY CAST(ts AS DATE)), n AS (SELECT day, count(*) AS n FROM a WHERE day IS NOT NULL GROUP BY day) SELECT event_id, CAST(sum(n) AS BIGINT) AS total, CAST(sum(if(day < mid, n, 0)) AS BIGINT) AS before, CAST(sum(if(day > mid, n, 0)) AS BIGINT) AS after, arg_max(day, (n, -datediff('day', DATE '1970-01-01', day))) AS peak, round(sum(n) / 60, 6) AS density FROM v JOIN n ON abs(datediff('day', mid, day)) <= 30 GROUP BY event_id",
    "period_trend": _A + ", s AS (SELECT min(day) + CAST(floor(datediff('day', min(day), max(day)) / 2) AS INTEGER) AS mid FROM a), x AS (SELECT avg(relevance_score) FILTER (day <= mid) AS f, avg(relevance_score) FILTER (day > mid) AS g FROM a, s WHERE day IS NOT NULL) SELECT round(f, 6) AS first, round(g, 6) AS second, CASE WHEN (g - f) / f > 0.1 THEN 'increasing' WHEN (g - f) / f < -0.1 THEN 'decreasing' ELSE 'stable' END AS trend FROM x",
    "sentiment_evolution": _A + "SELECT year(day) || '-W' || CAST(ceil(dayofyear(day) / 7) AS INTEGER) AS week, count(*) AS n, count(*) FILTER (sentiment = 'positiv') AS pos, count(*) FILTER (sentiment = 'negativ') AS neg, round((count(*) FILTER (sentiment = 'positiv') - count(*) FILTER (sentiment = 'negativ')) / count(*), 6) AS balance FROM a WHERE day IS NOT NULL GROUP BY 1",
    "anomalies": _A + ", n AS (SELECT day, count(*) AS n FROM a WHERE day IS NOT NULL GROUP BY day), w AS (SELECT *, avg(n) OVER () AS m, stddev_pop(n) OVER () AS s, count(*) OVER () AS k FROM n) SELECT day, n, round(m, 6) AS mean, if(n > m, 'spike', 'drop') AS kind FROM w WHERE k >= 3 AND abs(n - m) > 2 * s",
    "timeline_summary": _A + "SELECT count(*) AS n, min(day) AS first, max(day) AS last, round(avg(relevance_score), 6) AS mean, datediff('day', min(day), max(day)) AS days FROM a WHERE day IS NOT NULL",
    "diversity": _A + "SELECT count(DISTINCT category) AS categories, count(DISTINCT source) AS sources, count(DISTINCT author) AS authors FROM a",
    "velocity": _E + "SELECT entity_type, count(*) AS n, round(CASE WHEN max(created_at) > min(created_at) THEN count(*) / ((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 3600000000) ELSE count(*) END, 6) AS per_hour FROM e GROUP BY 1",
    "running_share": _A + ", n AS (SELECT source, count(*) AS n FROM a GROUP BY source) SELECT source, n, round(100 * n / sum(n) OVER (), 6) AS percent, round(100 * sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS so_far, round(n / max(n) OVER (), 6) AS of_largest FROM n",
    "bookmarks_join": "SELECT article_id, title, note, epoch_us(b.created_at) AS bookmarked_at FROM bookmarks b JOIN articles a ON a.id = b.article_id",
    "tags_collect": _A + f"SELECT a.id AS article_id, coalesce(tags, '') AS tags, b.article_id IS NOT NULL AS bookmarked FROM a LEFT JOIN (SELECT article_id, string_agg(tag, ',' ORDER BY tag) AS tags FROM ({_TAG}) GROUP BY 1) t ON t.article_id = a.id LEFT JOIN bookmarks b ON b.article_id = a.id",
    "feeds_health": f"WITH {_HEALTH} SELECT * FROM k", "health_histogram": f"WITH {_HEALTH} SELECT status, count(*) AS n FROM k GROUP BY status",
    "new_items": _A + "SELECT id, url_normalized FROM a WHERE url_normalized NOT IN (SELECT url_normalized FROM articles JOIN bookmarks ON article_id = id WHERE url_normalized IS NOT NULL)",
    "trend_join": "WITH t AS (SELECT trim(lower(tag), ' ') AS tag, CAST(created_at AS DATE) AS day FROM article_tags WHERE trim(tag, ' ') <> ''), l AS (SELECT tag, count(*) AS n FROM t WHERE day >= '2025-09-01' GROUP BY tag), e AS (SELECT tag, count(*) AS n FROM t WHERE day < '2025-09-01' GROUP BY tag) SELECT l.tag, l.n AS n_late, coalesce(e.n, 0) AS n_early, l.n - coalesce(e.n, 0) AS change FROM l LEFT JOIN e ON e.tag = l.tag",
    "fused_scores": _E + f", t AS (SELECT article_id, count(*) AS n FROM ({_TAG}) GROUP BY 1), m AS (SELECT article_id, sum(mentions) AS m FROM e GROUP BY 1) SELECT coalesce(t.article_id, m.article_id) AS article_id, round(0.65::DOUBLE * coalesce(n, 0) + 0.35::DOUBLE * coalesce(m, 0), 6) AS score FROM t FULL JOIN m ON m.article_id = t.article_id",
    "entities_in_range": f"WITH {ARTICLES}, {ENTITIES} SELECT source, entity_type, count(*) AS n, CAST(sum(mentions) AS BIGINT) AS mentions FROM e JOIN a ON a.id = e.article_id WHERE day BETWEEN '{FROM}' AND '{TO}' GROUP BY 1, 2",
    "rollup_source_type": _A + "SELECT source, article_type, count(*) AS n, grouping(source, article_type) AS level FROM a GROUP BY ROLLUP (source, article_type)",
    "cube_facets": _A + "SELECT sentiment, category, count(*) AS n, round(avg(relevance_score), 6) AS relevance FROM a GROUP BY CUBE (sentiment, category)",
    "star_join_revenue": "SELECT r_name, n_name, CAST(year(o_orderdate) AS INTEGER) AS year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3",
    "topk_orders": "SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(row_number() OVER w AS INTEGER) AS rank, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_mktsegment, year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2",
    "set_operations": "WITH f AS (SELECT name AS source FROM feeds), a AS (SELECT source FROM articles WHERE source IS NOT NULL), c AS (SELECT source FROM documents WHERE source IS NOT NULL), h AS (SELECT source FROM source_health WHERE source IS NOT NULL) SELECT source, 'any' AS part FROM (SELECT * FROM f UNION SELECT * FROM a UNION SELECT * FROM c UNION SELECT * FROM h) UNION ALL SELECT source, 'articles_and_documents' FROM (SELECT * FROM a INTERSECT SELECT * FROM c) UNION ALL SELECT source, 'health_only' FROM (SELECT * FROM h EXCEPT SELECT * FROM f)",
    "also_on_union": "WITH l AS (SELECT duplicate_of AS id, id AS loser, list_append(coalesce(also_on, []), url) AS more FROM articles WHERE duplicate_of IS NOT NULL AND duplicate_of <> id), m AS (SELECT id, flatten(list(more ORDER BY loser)) AS more FROM l GROUP BY id), u AS (SELECT a.id, unnest(list_concat(coalesce(also_on, []), more)) AS u, generate_subscripts(list_concat(coalesce(also_on, []), more), 1) AS i FROM articles a JOIN m ON m.id = a.id), f AS (SELECT id, u, min(i) AS i FROM u GROUP BY 1, 2) SELECT id, string_agg(u, ' ' ORDER BY i) AS places FROM f GROUP BY id",
    "title_updates": _A + r", k AS (SELECT *, trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'), ' ') AS key FROM a WHERE day IS NOT NULL AND title IS NOT NULL) SELECT key, lag(id) OVER w AS before, id AS after, datediff('day', lag(day) OVER w, day) AS gap, source <> lag(source) OVER w AS changed FROM k WINDOW w AS (PARTITION BY key ORDER BY day, id) QUALIFY lag(id) OVER w IS NOT NULL",
    "failure_runs": "WITH g AS (SELECT *, sum(if(event_type = 'error', 0, 1)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events), r AS (SELECT user_id, island, count(*) AS n FROM g WHERE event_type = 'error' GROUP BY 1, 2) SELECT user_id, max(n) AS longest, arg_max(n, island) AS latest FROM r GROUP BY user_id",
    "update_tags_union": f"WITH t AS ({_TAG}) SELECT article_id, tag FROM (SELECT * FROM t UNION SELECT DISTINCT article_id, 'status:geprueft' FROM article_tags) WHERE NOT (tag LIKE 'tonalitaet:%')",
    "related_articles": f"WITH {ARTICLES}, {ENTITIES}, x AS (SELECT e.article_id, entity_type, entity_value, day FROM e JOIN a ON a.id = e.article_id WHERE day IS NOT NULL) SELECT x.article_id, y.article_id AS other, count(*) AS shared FROM x JOIN x y ON x.entity_type = y.entity_type AND x.entity_value = y.entity_value AND x.article_id <> y.article_id AND x.article_id % 50 = 0 AND abs(datediff('day', x.day, y.day)) <= 14 GROUP BY 1, 2 HAVING count(*) >= 2",
}
