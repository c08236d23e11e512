"""Feed documents as items: RSS, Atom, RDF, JSON Feed, news sitemaps and OPML, one document a row."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

ITEM = "title string, url string, guid string, published string, summary string, content string, author string, categories array<string>, language string"
_FIELDS = [x.split()[0] for x in ITEM.split(", ")]


def sniff(c: Column) -> Column:
    """json, sitemap, opml, rdf, atom, rss, html or unknown by the head of a document."""
    head = F.lower(F.substring(F.ltrim(F.regexp_replace(c, "^\\x{feff}", "")), 1, 2000))
    return (
        F.when(head.startswith("{") & head.contains("jsonfeed.org"), "json").when(head.contains("<urlset"), "sitemap").when(head.contains("<opml"), "opml").when(head.contains("<rdf:rdf"), "rdf")
        .when(head.rlike(r"<(?:\w+:)?feed[\s>]"), "atom").when(head.contains("<rss") | head.contains("<channel"), "rss").when(head.rlike("<!doctype html|<html"), "html").when(head.startswith("{") & head.contains('"items"'), "json").otherwise("unknown")
    )


def charset(content_type: Column, body: Column) -> Column:
    """The character set of a response: header, byte order mark, XML declaration, meta tag, utf-8."""
    head = F.decode(F.substring(body, 1, 1024), "ISO-8859-1")
    some = lambda c, p: F.nullif(F.lower(F.regexp_extract(c, p, 1)), F.lit(""))
    bom = F.when(F.hex(F.substring(body, 1, 3)) == "EFBBBF", "utf-8").when(F.hex(F.substring(body, 1, 2)) == "FFFE", "utf-16le").when(F.hex(F.substring(body, 1, 2)) == "FEFF", "utf-16be")
    return F.coalesce(some(F.coalesce(content_type, F.lit("")), r"(?i)charset=[\"']?([\w-]+)"), bom, some(head, r"(?i)<\?xml[^>]+encoding=[\"']([\w-]+)"), some(head, r"(?i)<meta[^>]+charset=[\"']?([\w-]+)"), F.lit("utf-8"))


#: What windows-1252 has where ISO-8859-1 has control characters (0x80 to 0x9F); five places stay as they are.
_LATIN = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0))


def decoded(content_type: Column, body: Column) -> Column:
    """The text of a response; windows-1252 and the character sets the JVM always has are decoded as such, others as utf-8, and what is no utf-8 as windows-1252."""
    c = charset(content_type, body)
    known = {"iso-8859-1": "ISO-8859-1", "latin1": "ISO-8859-1", "us-ascii": "US-ASCII", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-16": "UTF-16"}
    out = F.try_validate_utf8(body.cast("string"))
    for name, java in known.items():
        out = F.when(c == name, F.decode(body, java)).otherwise(out)
    windows = F.translate(F.decode(body, "ISO-8859-1"), _LATIN, _WINDOWS)
    return F.coalesce(F.when(c.isin("windows-1252", "cp1252", "x-cp1252"), windows).otherwise(out), windows)


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _text(e) -> str | None:
    return ("".join(e.itertext()).strip() or None) if e is not None else None


def _named(e, *names: str):
    """The first child with text of the first of these local names that has one."""
    for n in names:
        for x in e:
            if _local(x.tag) == n and _text(x):
                return _text(x)
    return None


def _all(e, name: str) -> list[str]:
    return [t for x in e if _local(x.tag) == name and (t := _text(x) or x.get("term"))]


def items_of(document: str | None) -> list[dict]:
    """The items of one document in any of the formats; none if it is broken or no feed."""
    s = (document or "").lstrip("﻿ \n\r\t")
    try:
        if s.startswith("{"):
            return [_json_item(x) for x in json.loads(s).get("items", []) if isinstance(x, dict)]
        root = ElementTree.fromstring(s)
    except (ValueError, ElementTree.ParseError, AttributeError):
        return []
    kind = _local(root.tag)
    if kind == "feed":
        return [_entry(e) for e in root if _local(e.tag) == "entry"]
    if kind == "urlset":
        return [_news(e) for e in root if _local(e.tag) == "url"]
    if kind in ("rss", "rdf"):
        return [_item(e) for e in root.iter() if _local(e.tag) == "item"]
    return []


def _item(e) -> dict:
    about = next((v for k, v in e.attrib.items() if _local(k) == "about"), None)
    return {"title": _named(e, "title"), "url": _named(e, "link") or _named(e, "guid") or about, "guid": _named(e, "guid") or about, "published": _named(e, "pubdate", "date"), "summary": _named(e, "description"), "content": _named(e, "encoded"), "author": _named(e, "creator", "author"), "categories": _all(e, "category") + _all(e, "subject"), "language": None}


def _entry(e) -> dict:
    links = [x for x in e if _local(x.tag) == "link" and x.get("href")]
    best = next((x for x in links if x.get("rel") == "alternate"), next((x for x in links if not x.get("rel")), links[0] if links else None))
    author = next((_named(x, "name") for x in e if _local(x.tag) == "author"), None)
    return {"title": _named(e, "title"), "url": best.get("href") if best is not None else None, "guid": _named(e, "id"), "published": _named(e, "published", "updated"), "summary": _named(e, "summary"), "content": _named(e, "content"), "author": author, "categories": [x.get("term") for x in e if _local(x.tag) == "category" and x.get("term")], "language": None}


def _news(e) -> dict:
    news = next((x for x in e if _local(x.tag) == "news"), None)
    publication = next((x for x in news if _local(x.tag) == "publication"), None) if news is not None else None
    return {"title": _named(news, "title") if news is not None else None, "url": _named(e, "loc"), "guid": _named(e, "loc"), "published": (_named(news, "publication_date") if news is not None else None) or _named(e, "lastmod"), "summary": None, "content": None, "author": None, "categories": [], "language": _named(publication, "language") if publication is not None else None}


def _json_item(x: dict) -> dict:
    authors = x.get("authors") or ([x["author"]] if isinstance(x.get("author"), dict) else [])
    return {"title": x.get("title"), "url": x.get("url") or x.get("id"), "guid": str(x["id"]) if x.get("id") is not None else None, "published": x.get("date_published"), "summary": x.get("summary"), "content": x.get("content_text") or x.get("content_html"), "author": next((a.get("name") for a in authors if isinstance(a, dict)), None), "categories": [str(t) for t in x.get("tags") or []], "language": x.get("language")}


def feed_items(documents: DataFrame, key: str = "feed", body: str = "body") -> DataFrame:
    """(key, pos, items...) of every document: one row an item. Broken documents and other formats give none."""
    ship(sys.modules[__name__])
    kind = dict(documents.dtypes)[key]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *(x[f] for f in _FIELDS)) for k, b in zip(batch["key"], batch["body"], strict=True) for i, x in enumerate(items_of(b))]
            yield pd.DataFrame(rows, columns=["key", "pos", *_FIELDS])

    return documents.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInPandas(parse, f"key {kind}, pos int, {ITEM}").withColumnRenamed("key", key)


def opml_feeds(documents: DataFrame, body: str = "body") -> DataFrame:
    """(name, url, category) of the outlines of OPML documents, at any depth, each URL once."""
    ship(sys.modules[__name__])

    def walk(e, category: str | None) -> Iterator[tuple]:
        for x in e:
            if _local(x.tag) == "outline":
                name = x.get("title") or x.get("text")
                if x.get("xmlUrl"):
                    yield name, x.get("xmlUrl"), category
                yield from walk(x, category if x.get("xmlUrl") else name)
            elif _local(x.tag) == "body":
                yield from walk(x, category)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for b in batch["body"]:
                try:
                    rows += walk(ElementTree.fromstring(b or ""), None)
                except ElementTree.ParseError:
                    continue
            yield pd.DataFrame(rows, columns=["name", "url", "category"])

    return documents.select(F.col(body).alias("body")).mapInPandas(parse, "name string, url string, category string").dropDuplicates(["url"])


def error_class(code: Column, message: Column) -> Column:
    """forbidden, notfound, gone, server, ratelimit, dns, timeout, socket or unknown of a failed fetch."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(code.isin(401, 403), "forbidden").when(code == 404, "notfound").when(code == 410, "gone").when(code == 429, "ratelimit").when(code >= 500, "server")
        .when(m.rlike("enotfound|eai_again|name or service not known"), "dns").when(m.rlike("etimedout|timeout|timed out"), "timeout").when(m.rlike("econnreset|econnrefused|epipe|socket"), "socket").otherwise("unknown")
    )


def expanded_queries(terms: DataFrame, suffix: str, limit: int = 24) -> DataFrame:
    """Search queries of terms of three letters and more, each once in any case, the first ``limit`` in order."""
    q = terms.where(F.length("term") >= 3).groupBy(F.lower("term").alias("k")).agg(F.min_by("term", "ord").alias("term"), F.min("ord").alias("ord"))
    return q.orderBy("ord").limit(limit).select(F.concat(F.lit('"'), "term", F.lit(f'" {suffix}')).alias("query"))


def split_aggregator_title(c: Column) -> tuple[Column, Column]:
    """(title, source) of ``Title - Source``."""
    return F.regexp_replace(c, r"\s+[-–]\s+[^-–]+$", ""), F.nullif(F.regexp_extract(c, r"\s+[-–]\s+([^-–]+)$", 1), F.lit(""))
