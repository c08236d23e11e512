"""The structured query language: words, phrases, signs, operators and fields, compiled to one Column.

    hamlet -kino "zweiter akt" +premiere ODER kritik source:bote score:>50 tag:form:kritik after:2025-03
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of fields, and what ``has:`` may ask for.
ALIASES = {"t": "title", "src": "source", "s": "source", "site": "source", "a": "author", "cat": "category", "sent": "sentiment", "language": "lang", "word_count": "words", "wordcount": "words", "readingtime": "reading", "datum": "after", "bis": "before"}
FIELDS = frozenset("title text source author category sentiment type tag tagnot tagmode words score reading lang image bookmark paywall after before".split())
HAS = {"image": "image", "bild": "image", "paywall": "paywall", "bookmark": "bookmark", "lesezeichen": "bookmark"}
AND, OR, NOT = frozenset(("AND", "UND")), frozenset(("OR", "ODER")), frozenset(("NOT", "NICHT"))
YES = frozenset(("yes", "true", "1", "ja"))

_TOKEN = re.compile(r'(?P<sign>[+-])?(?:(?P<field>[A-Za-z_]+):(?:"(?P<fq>[^"]*)"?|(?P<fv>[^\s"]+))|"(?P<phrase>[^"]*)"?|(?P<word>[^\s"]+))')


@dataclass(frozen=True)
class Term:
    text: str
    phrase: bool = False


@dataclass
class Query:
    """What must, may and must not stand in an article, and its fields; structured if it is more than bare words."""

    raw: str
    must: list[Term] = field(default_factory=list)
    should: list[Term] = field(default_factory=list)
    must_not: list[Term] = field(default_factory=list)
    fields: dict[str, list[str]] = field(default_factory=dict)
    structured: bool = False

    def ranking_text(self) -> str:
        """The words that rank: must, should, and the title and text fields; phrases in quotation marks."""
        parts = [f'"{t.text}"' if t.phrase else t.text for t in (*self.must, *self.should)]
        return " ".join(parts + self.fields.get("title", []) + self.fields.get("text", []))


def parse(raw: str | None) -> Query:
    """The query of a text. A quotation mark that is never closed ends with the text; unknown fields are plain words.

    OR moves the word after it to those that may stand, NOT excludes whatever comes next, + makes a word
    as strict as a phrase.
    """
    q, mode = Query(raw or ""), ""
    for m in _TOKEN.finditer(q.raw):
        word = m["word"]
        if word in AND:
            continue
        if word in OR or word in NOT:
            mode, q.structured = ("should" if word in OR else "not"), True
            continue
        name = (m["field"] or "").lower()
        name = ALIASES.get(name, name)
        value = m["fq"] if m["fq"] is not None else m["fv"]
        if name == "has" and value is not None:
            if value.lower() in HAS:
                q.fields.setdefault(HAS[value.lower()], []).append("yes")
                q.structured = True
        elif name in FIELDS and value:
            q.fields.setdefault("tagnot" if name == "tag" and (m["sign"] == "-" or mode == "not") else name, []).append(value.lower())
            q.structured = True
        else:
            text = m["phrase"] if m["phrase"] is not None else word if word is not None else f"{m['field']}:{value or ''}"
            if text.strip():
                term = Term(text.lower(), m["phrase"] is not None or m["sign"] == "+")
                if m["sign"] == "-" or mode == "not":
                    q.must_not.append(term)
                elif mode == "should":
                    q.should.append(term)
                else:
                    q.must.append(term)
                q.structured |= bool(m["sign"]) or term.phrase
        mode = ""
    return q


def _number(c: Column, conditions: list[str]) -> Column:
    out = F.lit(True)
    for x in conditions:
        if m := re.fullmatch(r"([<>]=?|=)?\s*(\d+)", x):
            n, op = int(m[2]), m[1] or ">="
            out = out & {"<": c < n, "<=": c <= n, ">": c > n, ">=": c >= n, "=": c == n}[op]
    return out


def _day(x: str) -> str | None:
    return x + {4: "-01-01", 7: "-01", 10: ""}[len(x)] if re.fullmatch(r"\d{4}(?:-\d{2}(?:-\d{2})?)?", x) else None


def compile_query(q: Query) -> Column:
    """One predicate over title, summary, full_text, source, author, category, sentiment, article_type, tags, word_count, relevance_score, language, has_image, bookmarked, paywall and day.

    Built-in expressions only, so that Catalyst can push parts of it into the scan. Bare words are strict
    only where nothing may stand instead; values of one field are alternatives, numbers and days all
    hold; a null day fails every day condition.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    text = F.concat_ws(" ", low("title"), low("full_text"), low("summary"))
    where = F.lit(True)
    for t in q.must_not:
        where = where & ~text.contains(t.text)
    for t in q.must:
        if t.phrase or not q.should:
            where = where & text.contains(t.text)
    if q.should and not q.must:
        any_ = F.lit(False)
        for t in q.should:
            any_ = any_ | text.contains(t.text)
        where = where & any_
    columns = {"title": low("title"), "source": low("source"), "author": low("author"), "text": text, "category": low("category"), "sentiment": low("sentiment"), "type": low("article_type")}
    for name, c in columns.items():
        if values := q.fields.get(name):
            any_ = F.lit(False)
            for v in values:
                any_ = any_ | c.contains(v)
            where = where & any_
    if tags := q.fields.get("tag"):
        want = F.array(*map(F.lit, tags))
        every = q.fields.get("tagmode", ["any"])[0] == "all"
        none = q.fields.get("tagmode", ["any"])[0] == "none"
        hit = F.arrays_overlap("tags", want)
        where = where & (F.size(F.array_except(want, "tags")) == 0 if every else ~hit if none else hit)
    if tags := q.fields.get("tagnot"):
        where = where & ~F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    for name, c in {"words": F.col("word_count"), "score": F.col("relevance_score"), "reading": F.greatest(F.lit(1), F.floor(F.col("word_count") / 200 + 0.5))}.items():
        where = where & _number(c, q.fields.get(name, []))
    if values := q.fields.get("lang"):
        where = where & F.lower(F.coalesce("language", F.lit("de"))).isin(*values)
    for name, c in {"image": "has_image", "bookmark": "bookmarked", "paywall": "paywall"}.items():
        if values := q.fields.get(name):
            where = where & (F.col(c) == (values[0] in YES))
    if (values := q.fields.get("after")) and (d := _day(values[0])):
        where = where & F.coalesce(F.col("day") >= F.lit(d).cast("date"), F.lit(False))
    if (values := q.fields.get("before")) and (d := _day(values[0])):
        where = where & F.coalesce(F.col("day") <= F.lit(d).cast("date"), F.lit(False))
    return where


#: Named bundles of conditions.
PRESETS = {"top": "score:>=80", "reviews": "type:review", "positive": "sentiment:positiv", "negative": "sentiment:negativ", "long": "words:>=400", "free": "paywall:no", "images": "has:image", "saved": "has:bookmark"}
