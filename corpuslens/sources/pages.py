"""Web pages as articles: regular expressions in the JVM for single values, html.parser in Arrow batches for the body."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Signs of a paywall, looked for in lower-case HTML.
PAYWALL = ("paywall", "nur für abonnenten", "jetzt abonnieren", "weiterlesen mit", "premium-inhalt", "plus-artikel", "subscriber-only", "subscribe to read", "réservé aux abonnés", '"isaccessibleforfree":false', '"isaccessibleforfree": false')
_SKIP = {"script", "style", "noscript", "nav", "aside", "footer", "header", "form", "template", "svg", "button", "iframe"}
_BLOCK = {"p", "div", "article", "section", "main", "td", "li", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "br"}
_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track"}


def meta(c: Column, *names: str) -> Column:
    """The content of the first meta tag of these names or properties."""
    out = []
    for n in names:
        n = re.escape(n)
        out += [F.regexp_extract(c, rf"(?is)<meta[^>]+(?:name|property|itemprop)=[\"']{n}[\"'][^>]*?content=[\"']([^\"']*)[\"']", 1), F.regexp_extract(c, rf"(?is)<meta[^>]+content=[\"']([^\"']*)[\"'][^>]*?(?:name|property|itemprop)=[\"']{n}[\"']", 1)]
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in out])


def json_ld(c: Column, key: str) -> Column:
    """The first value of a key in the page's JSON-LD blocks."""
    block = F.regexp_extract_all(c, F.lit(r"(?is)<script[^>]+application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))
    value = F.array_compact(F.transform(block, lambda b: F.coalesce(F.get_json_object(b, f"$.{key}"), F.get_json_object(b, f"$[0].{key}"), F.get_json_object(b, f"$['@graph'][0].{key}"))))
    return F.try_element_at(value, F.lit(1))


def page_values(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with title, author, description, image, canonical and amp address, date text and paywall flag."""
    c = F.col(html)
    link = lambda rel: F.nullif(F.regexp_extract(c, rf"(?is)<link[^>]+rel=[\"']{rel}[\"'][^>]*?href=[\"']([^\"']+)", 1), F.lit(""))
    low = F.lower(c)
    paid = F.lit(False)
    for x in PAYWALL:
        paid = paid | low.contains(x)
    tag = lambda p: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, p, 1), "<[^>]+>", " ")), F.lit(""))
    return pages.withColumns({
        "title": F.coalesce(meta(c, "og:title"), tag(r"(?is)<h1[^>]*>(.*?)</h1>"), tag(r"(?is)<title[^>]*>(.*?)</title>")), "author": F.coalesce(meta(c, "author", "article:author"), json_ld(c, "author.name")), "description": meta(c, "description", "og:description"), "image": meta(c, "og:image", "twitter:image"),
        "canonical": F.coalesce(link("canonical"), meta(c, "og:url")), "amp": link("amphtml"), "date_text": F.coalesce(meta(c, "article:published_time", "datePublished", "date", "dc.date", "pubdate"), json_ld(c, "datePublished"), F.nullif(F.regexp_extract(c, r"(?is)<time[^>]+datetime=[\"']([^\"']+)", 1), F.lit("")), F.nullif(F.regexp_extract(c, r"\b(\d{1,2}\. ?(?:\d{1,2}\.|\p{Lu}\p{L}+) ?\d{4})\b", 1), F.lit(""))),
        "paywall": F.coalesce(paid, F.lit(False)),
    })


class _Tree(HTMLParser):
    """Blocks of text of a page with their container and the share of linked characters."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.path: list[tuple[str, int]] = []
        self.count, self.skip, self.link = 0, 0, 0
        self.blocks: list[list] = []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in _VOID:
            if tag == "br":
                self.blocks.append([None, "", 0])
            return
        self.count += 1
        self.path.append((tag, self.count))
        self.skip += tag in _SKIP
        self.link += tag == "a"
        if tag in _BLOCK:
            self.blocks.append([tuple(n for _, n in self.path[:-1]), "", 0])

    def handle_endtag(self, tag) -> None:
        if not any(t == tag for t, _ in self.path):
            return
        while self.path:
            t, _ = self.path.pop()
            self.skip -= t in _SKIP
            self.link -= t == "a"
            if t == tag:
                break
        if tag in _BLOCK:
            self.blocks.append([tuple(n for _, n in self.path), "", 0])

    def handle_data(self, data) -> None:
        if self.skip:
            return
        if not self.blocks:
            self.blocks.append([(), "", 0])
        self.blocks[-1][1] += data
        self.blocks[-1][2] += len(data.strip()) if self.link else 0


def body_text(html: str | None, least: int = 25) -> str:
    """The paragraphs of the densest container of a page, parted by blank lines; '' if it has none."""
    p = _Tree()
    try:
        p.feed(html or "")
    except Exception:  # a page that cannot be parsed has no body
        return ""
    blocks = [(path or (), " ".join(t.split()), linked) for path, t, linked in p.blocks]
    blocks = [(path, t, linked / max(1, len(t))) for path, t, linked in blocks if len(t) >= least]
    points: dict[int, float] = {}
    for path, t, density in blocks:
        score = (1 + t.count(",") + min(3.0, len(t) / 100)) * (1 - min(1.0, density))
        for k, node in enumerate(reversed(path[-3:])):
            points[node] = points.get(node, 0.0) + score / (k + 1)
    if not points:
        return "\n\n".join(t for _, t, d in blocks if d < 0.5)
    best = max(points, key=lambda n: (points[n], -n))
    return "\n\n".join(t for path, t, d in blocks if best in path and d < 0.5)


def with_body(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages with ``full_text``, parsed in Arrow batches."""
    ship(sys.modules[__name__])

    @F.pandas_udf("string")
    def body(s: pd.Series) -> pd.Series:
        return s.map(body_text)

    return pages.withColumn("full_text", body(F.col(html)))


__all__ = ["Iterator", "body_text", "json_ld", "meta", "page_values", "with_body"]
