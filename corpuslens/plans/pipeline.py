"""Queries on sources, sinks, event time, similarity and content."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content as C
from ..operators import similarity as M
from ..session import table
from ..sources import feeds as FD
from ..sources import pages as PG
from ..sources import store as ST
from ..streaming import windows as W
from .common import ARTICLES, articles
from .text import _FOLD, _STOP


def _rss(s, d):
    """The articles as RSS documents, one a source, to read them back."""
    e = lambda c: T.escape_html(F.coalesce(F.col(c), F.lit("")))
    item = F.concat(F.lit("<item><title>"), e("title"), F.lit("</title><link>"), e("url"), F.lit("</link><description>"), e("summary"), F.lit("</description></item>"))
    return articles(s, d).groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("x")).select("source", F.concat(F.lit('<rss version="2.0"><channel>'), "x", F.lit("</channel></rss>")).alias("body"))


def feed_roundtrip(s, d):
    """Items read back from RSS documents of all articles."""
    return FD.feed_items(_rss(s, d), "source", "body").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"))


def page_roundtrip(s, d):
    """Pages made of all articles and read back: title, author, length of the body."""
    e = lambda c: T.escape_html(F.coalesce(F.col(c), F.lit("")))
    html = F.concat(F.lit('<html><head><meta property="og:title" content="'), e("title"), F.lit('"><meta name="author" content="'), e("author"), F.lit('"></head><body><nav><a href="/">Start</a></nav><article><p>'), F.replace(e("full_text"), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article></body></html>"))
    p = PG.with_body(PG.page_values(articles(s, d).where("full_text is not null").select("id", html.alias("html"))))
    return p.select("id", "title", "author", F.length("full_text").alias("size"))


def feed_errors(s, d):
    h = table(s, d, "source_health")
    return h.select(FD.error_class(F.col("last_status_code"), F.col("last_error")).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


def inserts(s, d):
    """Stored rows meet the same rows again: nothing is inserted twice."""
    a = table(s, d, "articles").select("id", "url", "url_normalized", "title")
    return ST.insert_new(a, a.withColumn("id", F.lit(None).cast("bigint"))).groupBy("inserted").agg(F.count("*").alias("n"))


def health_fold(s, d):
    """Source state folded from a log of fetches (events of users)."""
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").alias("error"), F.lit(0).alias("status"))
    return ST.fold_health(e).select("source", "consecutive_failures")


QUERIES = {
    "feed_roundtrip": feed_roundtrip, "page_roundtrip": page_roundtrip, "feed_errors": feed_errors, "inserts": inserts, "health_fold": health_fold,
    "export_csv": lambda s, d: articles(s, d).select("id", ST.csv_line(F.col("id"), F.col("title"), F.col("source"), F.col("relevance_score"), F.col("url")).alias("line")),
    "export_markdown": lambda s, d: articles(s, d).select("id", ST.markdown_line(F.col("title"), F.col("url"), F.col("source"), F.col("sentiment")).alias("line")),
    "export_opml": lambda s, d: ST.opml(table(s, d, "feeds")), "export_json": lambda s, d: articles(s, d).select("id", F.to_json(F.struct("id", "title", "source")).alias("json")),
    "report_cards": lambda s, d: articles(s, d).select("id", ST.html_card(F.col("title"), F.col("source"), F.col("relevance_score"), F.col("summary")).alias("html")),
    "tumbling_counts": lambda s, d: W.tumbling(table(s, d, "events"), ["event_type"]), "sliding_errors": lambda s, d: W.sliding(table(s, d, "events").where("event_type = 'error'"), ["user_id"], "6 hours", "2 hours", 2),
    "rate_limit": lambda s, d: W.sliding(table(s, d, "events"), ["user_id"], "60 minutes", "20 minutes", 3), "sessions": lambda s, d: W.sessions(table(s, d, "events"), "user_id", "2 hours"),
    "exact_texts": lambda s, d: M.exact_groups(table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("full_text"))), "similar_titles": lambda s, d: M.same_title_pairs(articles(s, d)), "clusters": lambda s, d: M.clusters(articles(s, d)),
    "cluster_winners": lambda s, d: M.winners(articles(s, d), M.clusters(articles(s, d)), table(s, d, "feeds")), "embedding_centroids": lambda s, d: M.centroids(table(s, d, "embeddings")),
    "content_metadata": lambda s, d: C.metadata(articles(s, d)), "summaries": lambda s, d: articles(s, d).where("full_text is not null").select("id", C.summary(F.col("full_text"), F.col("title")).alias("summary")), "keywords": lambda s, d: C.keywords(articles(s, d)),
}

_A = f"WITH {ARTICLES} "
_quoted = lambda c: f"CASE WHEN regexp_matches({c}, '[\";,]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_line = lambda c: _quoted(f"regexp_replace(coalesce(CAST({c} AS VARCHAR), ''), '[\\r\\n]+', ' ', 'g')")
SQL = {
    "feed_roundtrip": _A + "SELECT source, count(*) AS n, count(DISTINCT nullif(trim(url, ' '), '')) AS n_urls FROM a GROUP BY source",
    "feed_errors": "SELECT CASE WHEN last_status_code IN (401, 403) THEN 'forbidden' WHEN last_status_code = 404 THEN 'notfound' WHEN last_status_code = 410 THEN 'gone' WHEN last_status_code = 429 THEN 'ratelimit' WHEN last_status_code >= 500 THEN 'server' WHEN regexp_matches(lower(coalesce(last_error, '')), 'enotfound|eai_again|name or service not known') THEN 'dns' WHEN regexp_matches(lower(coalesce(last_error, '')), 'etimedout|timeout|timed out') THEN 'timeout' WHEN regexp_matches(lower(coalesce(last_error, '')), 'econnreset|econnrefused|epipe|socket') THEN 'socket' ELSE 'unknown' END AS class, count(*) AS n FROM source_health GROUP BY 1",
    "inserts": "SELECT false AS inserted, count(DISTINCT url_normalized) AS n FROM articles",
    "health_fold": "WITH l AS (SELECT user_id, max(ts) FILTER (event_type <> 'error') AS ok FROM events GROUP BY user_id) SELECT CAST(l.user_id AS VARCHAR) AS source, count(e.ts) AS consecutive_failures FROM l LEFT JOIN events e ON e.user_id = l.user_id AND e.event_type = 'error' AND (l.ok IS NULL OR e.ts > l.ok) GROUP BY l.user_id",
    "export_csv": _A + "SELECT id, " + " || ';' || ".join(_line(c) for c in ("id", "title", "source", "relevance_score", "url")) + " AS line FROM a",
    "export_markdown": _A + "SELECT id, '- [' || regexp_replace(coalesce(title, ''), '[\\[\\]]', '', 'g') || '](' || url || ') – ' || source || ' · ' || sentiment AS line FROM a",
    "tumbling_counts": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "sliding_errors": "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 2 HOUR, ts), time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 2 HOUR, time_bucket(INTERVAL 2 HOUR, ts) - INTERVAL 4 HOUR]) AS w FROM events WHERE event_type = 'error') GROUP BY w, user_id HAVING count(*) >= 2",
    "rate_limit": "SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, user_id, count(*) AS n FROM (SELECT user_id, unnest([time_bucket(INTERVAL 20 MINUTE, ts), time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 20 MINUTE, time_bucket(INTERVAL 20 MINUTE, ts) - INTERVAL 40 MINUTE]) AS w FROM events) GROUP BY w, user_id HAVING count(*) >= 3",
    "sessions": "WITH g AS (SELECT user_id, ts, if(ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR, 0, 1) AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS end, count(*) AS n FROM s GROUP BY user_id, k",
    "exact_texts": "SELECT min(doc_id) AS first_id, count(*) AS n FROM documents WHERE trim(text, ' ') <> '' GROUP BY trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), ' ') HAVING count(*) > 1",
    "embedding_centroids": "WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(v) AS m FROM x GROUP BY 1, 2), j AS (SELECT x.label, vec_id, sum(v * m) / sqrt(sum(v * v) * sum(m * m)) AS cos FROM x JOIN c ON c.label = x.label AND c.i = x.i GROUP BY 1, 2) SELECT label, count(*) AS n, round(avg(cos), 4) AS spread FROM j GROUP BY label",
    "keywords": _A + f", w AS (SELECT unnest(list_filter(regexp_split_to_array({_FOLD('coalesce(full_text, chr(32))')}, '[^a-z0-9]+'), lambda t: length(t) >= 5 AND NOT list_contains({_STOP}, t))) AS term FROM a) SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY 2 DESC, 1 LIMIT 100",
}
_esc = lambda c: f"replace(replace(replace(replace(replace(coalesce({c}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"
SQL |= {
    "export_json": _A + "SELECT id, CAST(json_object('id', id, 'title', title, 'source', source) AS VARCHAR) AS json FROM a",
    "report_cards": _A + f"SELECT id, '<article><h3>' || {_esc('title')} || '</h3><p>' || {_esc('source')} || ' · ' || relevance_score || '</p><p>' || {_esc('summary')} || '</p></article>' AS html FROM a",
}
