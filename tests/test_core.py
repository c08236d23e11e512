"""Core operators on small tables, against brute force and known values."""

import random
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import german
from corpuslens.functions import text as T
from corpuslens.operators import similarity
from corpuslens.operators.graph import connected_components
from corpuslens.operators.query_language import compile_query, parse
from corpuslens.operators.ranking import top_per_group
from corpuslens.operators.timestamps import normalise_dates
from corpuslens.sources import feeds, pages, store
from corpuslens.streaming import windows


def rows(df):
    return {tuple(r) for r in df.collect()}


FEEDS = [("B", "Europe/Berlin", "de-DE"), ("N", "America/New_York", "en-US"), ("L", "Europe/London", "en-GB"), ("P", "Europe/Paris", "fr-FR"), ("X", "Nowhere/City", "de-DE")]
DATES = [
    ("B", "2025-06-10T03:58:13.787Z", "2025-06-10T03:58:13.787Z"), ("B", "Sun, 20 Apr 2025 16:35:12 GMT", "2025-04-20T16:35:12.000Z"), ("B", "2026-03-29 02:15:00", None), ("B", "2025-10-26 02:30:00", None), ("B", "2025-10-26 03:30:00", "2025-10-26T02:30:00.000Z"), ("B", "1729953072397", "2024-10-26T14:31:12.397Z"),
    ("B", "1737964318", "2025-01-27T07:51:58.000Z"), ("B", "20251026T052549Z", "2025-10-26T05:25:49.000Z"), ("B", "2025-04-07T11:09:48+02:00", "2025-04-07T09:09:48.000Z"), ("B", "12.05.2025, 16.00 Uhr", "2025-05-12T14:00:00.000Z"), ("B", "2024-10-15T20:16:39.785281Z", "2024-10-15T20:16:39.785Z"),
    ("B", "31.05.2026 17:13:13 CEST", "2026-05-31T15:13:13.000Z"), ("B", "31.05.2026 17:13 MEZ", "2026-05-31T16:13:00.000Z"), ("B", "13. Juni 2025, 11:22 Uhr", "2025-06-13T09:22:00.000Z"), ("B", "01.03.2026", "2026-02-28T23:00:00.000Z"), ("B", "vor 13 Stunden", "2025-12-31T23:00:00.000Z"), ("B", "31.02.2026 10:00", None), ("B", "22.5.26, 06:10", "2026-05-22T04:10:00.000Z"),
    ("L", "25/08/2025 13:30", "2025-08-25T12:30:00.000Z"), ("N", "7/23/2025 6:11 AM", "2025-07-23T10:11:00.000Z"), ("N", "12/1/2025 12:05 AM", "2025-12-01T05:05:00.000Z"), ("P", "20 avril 2025 à 02h48", "2025-04-20T00:48:00.000Z"), ("N", "May 18, 2025 6:08 p.m. EDT", "2025-05-18T22:08:00.000Z"), ("L", "19 March 2026 07:50", "2026-03-19T07:50:00.000Z"),
    ("B", "unbekannt", None), ("B", "", None), ("B", "2025-13-05T08:00:00Z", None), (None, "2025-05-05 10:00:00", None), (None, "2025-05-05T10:00:00Z", "2025-05-05T10:00:00.000Z"), ("X", "2025-05-05 10:00:00", None), (None, "01/02/2025 10:00", None), ("B", "2025-05-22T21:37:03.071+0200", "2025-05-22T19:37:03.071Z"),
]


def test_date_notations(spark):
    f = spark.createDataFrame(FEEDS, "name string, time_zone string, locale string")
    a = spark.createDataFrame([(i, s, raw, "2026-01-01 12:00:00") for i, (s, raw, _) in enumerate(DATES)], "id bigint, source string, published_date string, found_date string").withColumn("zone", F.lit("clash"))
    got = {r["article_id"]: r["utc"] for r in normalise_dates(a, f).where("field = 'published_date'").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(DATES)}
    found = {r["utc"] for r in normalise_dates(a, f).where("field = 'found_date'").collect()}
    assert found == {"2026-01-01T12:00:00.000Z"}
    assert normalise_dates(a.limit(0), f).count() == 0


def test_local_times_equal_zoneinfo(spark):
    from zoneinfo import ZoneInfo

    r, zones = random.Random(4), ["Europe/Berlin", "America/New_York", "Europe/London"]
    given = [(i, z, f"2025-{r.choice([3, 10, 11]):02d}-{r.choice([2, 9, 26, 30]):02d} {r.randrange(5):02d}:{r.randrange(60):02d}:00") for i in range(200) for z in [r.choice(zones)]]
    f = spark.createDataFrame([(z, z, "de-DE") for z in zones], "name string, time_zone string, locale string")
    a = spark.createDataFrame([(i, z, t, None) for i, z, t in given], "id bigint, source string, published_date string, found_date string")
    got = {x["article_id"]: x["utc"] for x in normalise_dates(a, f).collect()}
    for i, z, t in given:
        n = datetime.strptime(t, "%Y-%m-%d %H:%M:%S")
        fits = {u for fold in (0, 1) if (u := n.replace(tzinfo=ZoneInfo(z), fold=fold).astimezone(UTC)).astimezone(ZoneInfo(z)).replace(tzinfo=None) == n}
        want = fits.pop().strftime("%Y-%m-%dT%H:%M:%S.000Z") if len(fits) == 1 else None
        assert got[i] == want, (z, t)


def brute_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            up[b] = a
    return {(x, find(x)) for x in up}


@pytest.mark.parametrize("kind", ["random", "chain", "star", "loop", "empty"])
def test_components(spark, kind):
    r = random.Random(7)
    edges = {"random": [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(None, 1), (3, None)], "chain": [(i, i + 1) for i in range(40)], "star": [(5, i) for i in range(60)], "loop": [(1, 2), (2, 3), (3, 1), (7, 7)], "empty": []}[kind]
    assert rows(connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))) == brute_components(edges)


def test_top_rows_of_a_hot_group(spark):
    d = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"), (F.col("id") % 7).alias("v"))
    got = rows(top_per_group(d, ["g"], [F.desc("v"), F.asc("id")], 2).where("g = 'hot'").select("id"))
    want = sorted((i for i in range(5000) if i % 3 == 0), key=lambda i: (-(i % 7), i))[:2]
    assert got == {(i,) for i in want}


def test_german_words():
    assert german.cologne("Müller") == german.cologne("Mueller") and german.cologne("Maier") == german.cologne("Meyer") and german.cologne("Tschaikowsky") == german.cologne("Tschaikowski") and german.cologne("") == ""
    assert german.cologne("Wikipedia") == "3412" and german.cologne("Breschnew") == "17863"
    vocabulary = frozenset(("oper", "premiere", "inszenierung"))
    assert german.compound("opernpremiere", vocabulary) == ["oper", "premiere"] and german.compound("inszenierungspremiere", vocabulary) == ["inszenierung", "premiere"] and german.compound("hamlet", vocabulary) == []
    assert german.stem("Premieren").startswith("premier")


def test_text_functions(spark):
    cases = [
        (T.fold(F.lit("Müller über Lärm Straße")), "mueller ueber laerm strasse"), (T.reading_minutes(F.lit(200)), 1), (T.reading_minutes(F.lit(0)), 1), (F.size(T.sentences(F.lit("Erster Satz. Zweiter Satz! Dritter Satz?"))), 3), (T.normal_url(F.lit("https://X.de/a/?b=2&utm_source=q&a=1#z")), "https://x.de/a?a=1&b=2"),
        (T.normal_url(F.lit("not-a-url")), "not-a-url"), (T.host(F.lit("https://www.x.de:80/a")), "x.de"), (T.url_day(F.lit("https://x.de/2025/03/07/a")).cast("string"), "2025-03-07"), (T.strip_html(F.lit("<p>A &amp; B</p><script>x</script>")), "A & B"), (T.similarity(F.lit("abc"), F.lit("")), 0.0), (T.similarity(F.lit("an"), F.lit("AN")), 1.0),
        (T.excerpt(F.lit("Ein Satz. " * 60), 50), "Ein Satz. Ein Satz. Ein Satz. Ein Satz. Ein Satz."), (F.size(T.ascii_tokens(F.lit("die der das und in mit"))), 0), (F.size(T.quotes(F.lit("Er sagt „das ist ein Satz“ und „ja“."))), 1), (T.language_of(F.lit("the cat and the dog of the house is in the garden for that with it " * 2)), "en"),
    ]
    got = spark.range(1).select(*[e.alias(f"x{i}") for i, (e, _) in enumerate(cases)]).first()
    assert list(got) == [want for _, want in cases]


def test_query_language(spark):
    q = parse('hamlet -kino "zweiter akt" +premiere ODER kritik src:bote score:>50 NOT tag:form:x has:image foo:bar "offen')
    assert [t.text for t in q.must] == ["hamlet", "zweiter akt", "premiere", "foo:bar", "offen"] and [t.text for t in q.should] == ["kritik"] and [t.text for t in q.must_not] == ["kino"]
    assert q.fields == {"source": ["bote"], "score": [">50"], "tagnot": ["form:x"], "image": ["yes"]} and q.structured and not parse("hamlet").structured
    schema = "id int, title string, summary string, full_text string, source string, author string, category string, sentiment string, article_type string, tags array<string>, word_count int, relevance_score int, language string, has_image boolean, bookmarked boolean, paywall boolean, day date"
    day = datetime(2025, 5, 1).date()
    d = spark.createDataFrame([(1, "Hamlet", None, "zweiter Akt", "Bote", None, None, "positiv", "review", ["form:kritik"], 600, 80, "de", True, False, False, day), (2, "Wallenstein", "Premiere", None, None, None, None, None, "news", [], 80, 10, None, False, False, True, None)], schema)
    ids = lambda text: {r["id"] for r in d.where(compile_query(parse(text))).select("id").collect()}
    assert ids("hamlet") == {1} and ids("-hamlet") == {2} and ids('"zweiter akt"') == {1} and ids("ODER hamlet OR premiere") == {1, 2} and ids("words:>500") == {1} and ids("words:<=100") == {2} and ids("words:x") == {1, 2} and ids("lang:de") == {1, 2}
    assert ids("tag:form:kritik") == {1} and ids("tag:form:kritik tagmode:none") == {2} and ids("after:2025-05") == {1} and ids("bis:2025-04-30") == set() and ids("paywall:ja") == {2} and ids("reading:<=1") == {2} and ids("") == {1, 2}


RSS = '<?xml version="1.0"?><rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>A</title><link>http://x/1</link><pubDate>Mon, 01 Jun 2026 10:00:00 GMT</pubDate><dc:creator>Z</dc:creator><content:encoded>C</content:encoded><category>k</category><category>l</category></item><item><title>B</title><guid>http://x/2</guid></item></channel></rss>'
ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="http://s"/><link rel="alternate" href="http://x/1"/><updated>2026-06-01</updated><author><name>Z</name></author></entry></feed>'
RDF = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/"><item rdf:about="http://x/1"><title>A</title></item></rdf:RDF>'
JSON = '{"version": "https://jsonfeed.org/version/1.1", "items": [{"id": 7, "url": "http://x/1", "title": "A", "authors": [{"name": "Z"}], "tags": ["k"]}]}'
SITEMAP = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9"><url><loc>http://x/1</loc><news:news><news:publication><news:language>de</news:language></news:publication><news:publication_date>2026-06-01</news:publication_date><news:title>A</news:title></news:news></url><url><loc>http://x/2</loc><lastmod>2026-06-02</lastmod></url></urlset>'


def test_feed_formats(spark):
    d = spark.createDataFrame([("rss", RSS), ("atom", ATOM), ("rdf", RDF), ("json", JSON), ("sitemap", SITEMAP), ("html", "<!DOCTYPE html><html></html>"), ("unknown", "{broken"), ("unknown", None)], "feed string, body string")
    kinds = d.where("body is not null").select("feed", feeds.sniff(F.col("body")).alias("k")).collect()
    assert all(r["feed"] == r["k"] for r in kinds)
    got = {(r["feed"], r["pos"]): r for r in feeds.feed_items(d).collect()}
    assert got["rss", 0]["categories"] == ["k", "l"] and got["rss", 0]["author"] == "Z" and got["rss", 0]["content"] == "C" and got["rss", 1]["url"] == "http://x/2" and got["atom", 0]["url"] == "http://x/1" and got["rdf", 0]["url"] == "http://x/1" and got["json", 0]["author"] == "Z"
    assert got["sitemap", 0]["published"] == "2026-06-01" and got["sitemap", 0]["language"] == "de" and got["sitemap", 1]["published"] == "2026-06-02" and len(got) == 7


def test_opml_and_errors_and_charsets(spark):
    body = store.opml(spark.createDataFrame([("A & B", "http://a", "k"), ("C", "http://c", "k")], "name string, url string, category string")).first()["opml"]
    assert rows(feeds.opml_feeds(spark.createDataFrame([(body,)], "body string"))) == {("A & B", "http://a", "k"), ("C", "http://c", "k")}
    d = spark.createDataFrame([(403, None), (404, None), (410, None), (500, None), (429, None), (None, "ENOTFOUND"), (None, "ETIMEDOUT"), (None, "ECONNRESET"), (None, None)], "c int, m string")
    assert [r[0] for r in d.select(feeds.error_class(F.col("c"), F.col("m"))).collect()] == ["forbidden", "notfound", "gone", "server", "ratelimit", "dns", "timeout", "socket", "unknown"]
    b = spark.createDataFrame([("text/html; charset=ISO-8859-1", bytearray("Bühne".encode("latin-1"))), (None, bytearray("Bühne".encode())), (None, bytearray('<?xml version="1.0" encoding="iso-8859-1"?>ü'.encode("latin-1")))], "t string, b binary")
    assert [r[0] for r in b.select(feeds.decoded(F.col("t"), F.col("b"))).collect()] == ["Bühne", "Bühne", '<?xml version="1.0" encoding="iso-8859-1"?>ü']


def test_pages(spark):
    html = '<html><head><meta property="og:title" content="T"><meta content="Z" name="author"><link rel="canonical" href="http://x"><script type="application/ld+json">{"datePublished": "2026-01-02"}</script></head><body><nav><a>Start</a></nav><article><p>Ein langer Absatz, mit Komma, der zählt und zählt.</p><p>Noch ein langer Absatz, der ebenfalls zählt.</p></article><footer>Impressum und noch viel mehr Text hier unten</footer></body></html>'
    r = pages.with_body(pages.page_values(spark.createDataFrame([(1, html), (2, None), (3, "<p")], "id int, html string"))).orderBy("id").collect()
    assert (r[0]["title"], r[0]["author"], r[0]["canonical"], r[0]["date_text"], r[0]["paywall"]) == ("T", "Z", "http://x", "2026-01-02", False)
    assert r[0]["full_text"].count("\n\n") == 1 and "Impressum" not in r[0]["full_text"] and r[1]["full_text"] in (None, "") and r[2]["full_text"] == ""


def test_store(spark):
    old = spark.createDataFrame([(1, "u1", "http://1", None, ["p"]), (2, "u2", "http://2", None, None)], "id bigint, url_normalized string, url string, duplicate_of bigint, also_on array<string>")
    new = spark.createDataFrame([("u2", "http://2"), ("u3", "http://3"), ("u3", "http://3b")], "url_normalized string, url string")
    got = {r["url_normalized"]: (r["inserted"], r["url"]) for r in store.insert_new(old, new.withColumn("id", F.lit(None).cast("bigint"))).collect()}
    assert got == {"u2": (False, "http://2"), "u3": (True, "http://3")}
    m = {r["id"]: (r["duplicate_of"], r["also_on"]) for r in store.mark_duplicates(old, spark.createDataFrame([(2, 1)], "loser bigint, winner bigint")).collect()}
    assert m == {1: (None, ["p", "http://2"]), 2: (1, None)}
    assert rows(store.upsert(old.select("id", "url"), spark.createDataFrame([(2, "x"), (9, "y")], "id bigint, url string"), ["id"])) == {(1, "http://1"), (2, "x"), (9, "y")}
    line = spark.createDataFrame([('a;b"c\nd', None)], "x string, y string").select(store.csv_line(F.col("x"), F.col("y"), F.lit("z"))).first()[0]
    assert line == '"a;b""c d";;z'


def test_streams_equal_tables(spark, tmp_path):
    e = spark.createDataFrame([(1, "a", datetime(2025, 1, 1, 10, m), m % 2 == 0) for m in range(0, 50, 7)] + [(2, "b", datetime(2025, 1, 2, 9, 0), False)], "id int, source string, ts timestamp, ok boolean")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = windows.tumbling(stream, ["source"], "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("tumbled")) == rows(windows.tumbling(e, ["source"], "1 hour"))
    f = stream.select("source", F.unix_timestamp("ts").alias("ts"), "ok")
    q = windows.failure_streaks(f, "source", 2, 100_000, 300).writeStream.outputMode("update").format("memory").queryName("streaks").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["consecutive"]) for r in spark.table("streaks").collect() if r["consecutive"]}
    assert got == {(r["source"], r["consecutive"]) for r in windows.streaks_of(e.select("source", "ts", "ok")).collect()}


def test_similar_titles(spark):
    d = spark.createDataFrame([(1, "Die Salzgräfin in Mirlau"), (2, "Die Salzgräfin in Mirlauu"), (3, "die salzgräfin, in Mirlau"), (4, "Ganz anderes Stück"), (5, None)], "id bigint, title string")
    assert rows(similarity.clusters(d)) == {(1, 1), (1, 2), (1, 3)}


def test_every_query_has_a_callable_and_sql_has_a_query():
    from corpuslens import plans

    assert set(plans.oracle_sql()) <= set(plans.queries()) and len(plans.queries()) > 100


def test_similar_titles_equal_brute_force(spark):
    r = random.Random(6)
    words = ["kritik", "zu", "salzgräfin", "nachtlicht", "premiere", "am", "freitag", "abend", "haus"]
    titles = [" ".join(r.choice(words) for _ in range(r.randrange(2, 6))) for _ in range(70)] + ["kritik zu nachtlichtt", "kritik zu nachtlicht"]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = _step(row, i, x, b)
        return row[-1]

    def _step(row, i, x, b):
        out = [i]
        for j, y in enumerate(b, 1):
            out.append(min(out[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        return out

    heads = {}
    for i, t in enumerate(titles):
        heads.setdefault(t, i)
    want = {(heads[t], i) for i, t in enumerate(titles) if heads[t] != i}
    for a, x in heads.items():
        for b, y in heads.items():
            s, u = set(a.split()), set(b.split())
            if x < y and 2 * len(s & u) >= len(s | u) and 1 - lev(a, b) / max(len(a), len(b)) >= 0.85:
                want.add((x, y))
    got = rows(similarity.same_title_pairs(spark.createDataFrame(list(enumerate(titles)), "id bigint, title string")).select("a", "b"))
    assert got == want


def test_functions_by_name_in_sql(spark):
    from corpuslens.functions.register import register

    register(spark)
    assert spark.sql("SELECT cologne_code('Müller') = cologne_code('Mueller') AS x").first()["x"]
    assert [tuple(r) for r in spark.sql("SELECT * FROM split_quotes('Er sagt „das ist es wohl“ und „noch ein Satz“.')").collect()] == [(0, "das ist es wohl"), (1, "noch ein Satz")]


def test_lexicon_of_a_folder(spark, tmp_path):
    import json

    from corpuslens.lexicon import Lexicon
    from corpuslens.operators import enrich

    (tmp_path / "keywords.json").write_text(json.dumps({"required": ["Lindenhof"], "thresholds": {"very_relevant": 100}, "scoring_weights": {"title_exact_match": 200}}))
    (tmp_path / "tags.json").write_text(json.dumps({"rules": [{"tag": "a:b", "match_text": ["Lindenhof"], "min_required": ["Bühne"]}, {"tag": "c:d", "if_sentiment": "negativ"}]}))
    (tmp_path / "sentiment.json").write_text(json.dumps({"positive": ["gut"], "negative": ["flach"], "negations": ["nicht"], "intensifiers": ["sehr"]}))
    lx = Lexicon.from_folder(str(tmp_path))
    d = spark.createDataFrame([(1, "Lindenhof", "Die Bühne ist nicht gut. Am Ende war das alles sehr flach.", None, None, 500, False, None)], "id int, title string, full_text string, summary string, first_paragraph string, word_count int, paywall boolean, sentiment string")
    r = enrich.analyse(d, lx).first()
    assert r["mood"]["score"] == -3 and r["sentiment"] == "negativ" and r["tags"] == ["a:b", "c:d"] and r["score"] >= 200 and r["category"] == "sehr_relevant" and r["reason"] == ""


def test_related_articles_equal_brute_force_with_frequent_entities(spark):
    from corpuslens.plans import common, relational

    folder = "/root/testdata/sf0.01"
    days = {r["id"]: r["day"] for r in common.articles(spark, folder).where("day is not null").collect()}
    of = {}
    for r in common.entities(spark, folder).where("entity_type is not null and entity_value is not null").collect():
        of.setdefault(r["article_id"], set()).add((r["entity_type"], r["entity_value"]))
    known = [i for i in of if i in days]
    want = {(i, j, len(of[i] & of[j])) for i in known if i % 50 == 0 for j in known if i != j and abs((days[i] - days[j]).days) <= 14 and len(of[i] & of[j]) >= 2}
    assert want and {tuple(r) for r in relational.related_articles(spark, folder).collect()} == want


@pytest.mark.parametrize(
    ("raw", "locale", "day"),
    [
        ("2025-03-01", None, "2025-03-01"), ("2025-03-01T23:30:00-05:00", None, "2025-03-01"), ("Sat, 01 Mar 2025 10:00:00 GMT", None, "2025-03-01"), ("1. März 2025, 10.30 Uhr", None, "2025-03-01"), ("01.03.25", None, "2025-03-01"),
        ("March 1, 2025", None, "2025-03-01"), ("03/01/2025", "en-US", "2025-03-01"), ("01/03/2025", "en-GB", "2025-03-01"), ("01/03/2025", None, None), ("1740823200", None, "2025-03-01"), ("1740823200123", None, "2025-03-01"), ("31.02.2025", None, None), ("vor 3 Tagen", None, None),
        ("2150-06-01 12:00", None, "2150-06-01"), ("", None, None), (None, None, None), ("k. A.", None, None),
    ],
)
def test_days_of_all_notations(spark, raw, locale, day):
    from corpuslens.functions.timestamps import add_day

    d = add_day(spark.createDataFrame([(raw, locale, 1)], "raw string, locale string, line int"), "raw", "locale")
    assert str(d.first()["day"]) == str(day) and d.columns == ["raw", "locale", "line", "day"]


def test_local_times_of_any_year(spark):
    rows = [(1, "Bote", "2150-07-01 12:00", None), (2, "Bote", "1893-04-01 12:00", None), (3, "Bote", "9999-12-31 12:00", None), (4, "Bote", "0001-01-01 12:00", None), (5, "Bote", "2025-03-30 02:30", None), (6, "Bote", "2025-10-26 02:30", None), (7, None, "2025-06-01 12:00", None)]
    a = spark.createDataFrame(rows, "id bigint, source string, published_date string, found_date string")
    f = spark.createDataFrame([("Bote", "Europe/Berlin", "de-DE")], "name string, time_zone string, locale string")
    got = {r["article_id"]: r["utc"] for r in normalise_dates(a, f).collect()}
    assert got[1] == "2150-07-01T10:00:00.000Z" and got[2].startswith("1893-04-01T1") and got[3] == "9999-12-31T11:00:00.000Z" and got[4].startswith("0001-01-01T11")
    assert got[5] is None and got[6] is None and got[7] is None


def test_windows_1252_is_decoded(spark):
    text = "„Nachtlicht“ – für 5 €"
    d = spark.createDataFrame([("text/html; charset=windows-1252", bytearray(text.encode("cp1252"))), ("text/html", bytearray(text.encode())), ("text/html; charset=gibberish", bytearray(text.encode("cp1252")))], "t string, b binary")
    assert [r[0] for r in d.select(feeds.decoded(F.col("t"), F.col("b"))).collect()] == [text] * 3


def test_merge_sink_keeps_history_over_missing_epochs(spark, tmp_path):
    write = windows.merge_into(f"file://{tmp_path}/state", ["k"], "ts")
    batch = lambda *rows: spark.createDataFrame(rows, "k string, ts int, v int")
    write(batch(("a", 1, 1), ("b", 1, 1)), 0)
    write(batch(("a", 2, 2)), 3)
    write(batch(("a", 2, 2)), 3)
    assert {tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/state/epoch=3").collect()} == {("a", 2, 2), ("b", 1, 1)}
    assert windows.committed_epochs(spark, f"file://{tmp_path}/state") == [0, 3]


def test_related_by_words_equals_brute_force(spark):
    from datetime import date, timedelta

    from corpuslens.operators import lookups

    r = random.Random(3)
    rows = [(i, r.choice("abcdefg") if j else "hot", date(2025, 1, 1) + timedelta(days=i % 60)) for i in range(120) for j in range(4)]
    words = spark.createDataFrame(rows + [(500, None, None)], "id bigint, word string, day date")
    of, day = {}, {}
    for i, w, d in rows:
        of.setdefault(i, set()).add(w)
        day[i] = d
    want = {(i, j, len(of[i] & of[j])) for i in range(0, 120, 50) for j in of if i != j and abs((day[i] - day[j]).days) <= 14 and len(of[i] & of[j]) >= 2}
    got = {tuple(x) for x in lookups.related_by_words(words, words.where("id % 50 = 0"), 2, 14).collect()}
    assert got == want


def test_freshness_labels(spark):
    from corpuslens.operators import lookups

    now = "2025-06-10 12:00:00"
    times = {"2025-06-10 11:30:00": "breaking", "2025-06-10 07:00:00": "fresh", "2025-06-09 13:00:00": "recent", "2025-06-04 12:00:01": "week-old", "2025-06-03 12:00:00": "stale", None: "unknown", "2025-06-11 00:00:00": "breaking"}
    d = spark.createDataFrame([(t,) for t in times], "t string")
    assert [x[0] for x in d.select(lookups.freshness(F.col("t"), F.lit(now))).collect()] == list(times.values())
