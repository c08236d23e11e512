"""Analysis of single articles against a lexicon: relevance, kind, sentiment, tone, tags, entities, events. All Columns, all JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import Lexicon

#: Points of the relevance score where a lexicon gives none.
WEIGHTS = {
    "title_exact_match": 110, "required_keyword": 18, "production_in_title": 70, "production_match": 40, "multiple_productions_bonus": 60, "title_with_production": 130, "people_in_title": 55, "people_match": 28, "multiple_people_bonus": 35,
    "venue_match": 18, "theater_context_bonus": 15, "review": 50, "interview": 40, "announcement": 30, "premiere_bonus": 35, "very_short_article_penalty": -35, "short_article_penalty": -12,
}


def _any(c: Column, terms) -> Column:
    return reduce(Column.__or__, [c.contains(T._folded(t)) for t in terms], F.lit(False))


def _hits(c: Column, terms) -> Column:
    return reduce(Column.__add__, [c.contains(t).cast("int") for t in dict.fromkeys(T._folded(t) for t in terms)], F.lit(0))


def _count(c: Column, terms) -> Column:
    """Occurrences of all terms, each counted for itself."""
    return reduce(Column.__add__, [F.floor((F.length(c) - F.length(F.replace(c, F.lit(t), F.lit("")))) / len(t)) for t in dict.fromkeys(T._folded(t) for t in terms)], F.lit(0))


def folded(a: DataFrame) -> DataFrame:
    """Articles with their folded title and body, computed once for all rules."""
    return a.withColumns({"ft": T.fold(F.coalesce("title", F.lit(""))), "fb": T.fold(F.concat_ws(" ", "full_text", "summary", "first_paragraph"))})


def prefilter(lx: Lexicon) -> Column:
    """'' for an article to keep, else the first reason against it; needs ``folded``."""
    named = _any(F.col("ft"), lx.required) | _any(F.col("fb"), lx.required) | _any(F.col("fb"), [p for p in lx.people if len(p) >= 6]) | _any(F.col("fb"), [p for p in lx.productions if len(p) >= 8])
    return F.coalesce(F.when(~named, "no keyword"), F.when(_any(F.col("ft"), lx.exclude_title), "excluded title"), F.lit(""))


def article_kind(lx: Lexicon) -> Column:
    """The kind with most indicators; equal ones in the order review, interview, announcement; news without any."""
    text = F.concat_ws(" ", "ft", "fb")
    n = [F.struct(_hits(text, lx.kinds.get(k, ())).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(("review", "interview", "announcement"))]
    best = F.array_max(F.array(*n))
    return F.when(best["n"] > 0, best["k"]).otherwise("news")


def sentiment(lx: Lexicon) -> Column:
    """struct(score, hits, label): polar words, doubled by intensifiers and turned by negations among the three tokens before."""
    fold = lambda ws: [T._folded(w) for w in ws]
    tokens = F.split(F.col("fb"), "[^a-z0-9]+")
    inside = lambda w, ws: F.array_contains(F.array(*map(F.lit, ws)), w) if ws else F.lit(False)

    def value(w: Column, i: Column) -> Column:
        before = F.slice(tokens, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3)))
        some = lambda ws: F.exists(before, lambda b: inside(b, ws))
        sign = F.when(inside(w, fold(lx.positive)), 1).when(inside(w, fold(lx.negative)), -1).otherwise(0)
        return F.when(sign == 0, 0).otherwise(sign * F.when(some(fold(lx.intensifiers)), 2).otherwise(1) * F.when(some(fold(lx.negations)), -1).otherwise(1))

    values = F.filter(F.transform(tokens, value), lambda v: v != 0)
    score = F.aggregate(values, F.lit(0), lambda s, v: s + v)
    return F.struct(score.alias("score"), F.size(values).alias("hits"), F.when(score >= 2, "positiv").when(score <= -2, "negativ").otherwise("neutral").alias("label"))


def tone(lx: Lexicon) -> Column:
    """The prevailing tone by words of each list; the first of equals; neutral_reporting without any."""
    if not lx.tones:
        return F.lit("neutral_reporting")
    n = [F.struct(_count(F.col("fb"), ws).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, ws) in enumerate(lx.tones.items())]
    best = F.array_max(F.array(*n))
    return F.when(best["n"] > 0, best["k"]).otherwise("neutral_reporting")


def depth(lx: Lexicon) -> Column:
    """0 to 5 points for words, sentences, paragraphs, quotations and people."""
    text = F.coalesce("full_text", F.lit(""))
    points = [F.col("word_count") >= 300, F.size(T.sentences(text)) >= 10, F.size(F.split(text, r"\n\s*\n")) >= 3, text.rlike("[„“«\"]"), _hits(F.col("fb"), lx.people) >= 2]
    return reduce(Column.__add__, [p.cast("int") for p in points])


def relevance(lx: Lexicon) -> Column:
    """The score of an article: what its title and text name, its kind, depth and length. Never below 0; needs ``folded``."""
    w = WEIGHTS | lx.weights
    t, b = F.col("ft"), F.col("fb")
    on = lambda c, k: F.when(c, w[k]).otherwise(0)
    context = _hits(b, lx.context)
    kind = article_kind(lx)
    parts = [
        on(_any(t, lx.required), "title_exact_match"), w["required_keyword"] * F.least(_count(b, lx.required), F.lit(5)), on(_any(t, lx.productions), "production_in_title"),
        F.when(context >= 2, w["production_match"]).otherwise(w["production_match"] // 2) * F.least(_hits(b, lx.productions), F.lit(3)), on(_hits(b, lx.productions) > 1, "multiple_productions_bonus"), on(_any(t, lx.required) & _any(t, lx.productions), "title_with_production"),
        on(_any(t, lx.people), "people_in_title"), w["people_match"] * _hits(b, lx.people), on(_hits(b, lx.people) > 1, "multiple_people_bonus"), w["venue_match"] * _hits(b, lx.venues), on(context >= 2, "theater_context_bonus"),
        F.when(kind == "review", w["review"]).when(kind == "interview", w["interview"]).when(kind == "announcement", w["announcement"]).otherwise(0), on(t.contains("premiere"), "premiere_bonus"),
        F.when(F.col("word_count") < 50, w["very_short_article_penalty"]).when(F.col("word_count") < 100, w["short_article_penalty"]).when(F.col("word_count") > 600, 15).when(F.col("word_count") > 300, 8).otherwise(0), F.when(depth(lx) >= 4, 10).when(depth(lx) >= 3, 5).otherwise(0), F.when(F.col("paywall"), -10).otherwise(0),
    ]
    return F.greatest(reduce(Column.__add__, parts), F.lit(0)).cast("int")


def category(score: Column, lx: Lexicon) -> Column:
    a, b, c = lx.thresholds
    return F.when(score >= a, "sehr_relevant").when(score >= b, "relevant").when(score >= c, "moeglich_relevant").otherwise("irrelevant")


def auto_tags(lx: Lexicon) -> Column:
    """Tags of all rules that hold, in rule order; texts are compared folded."""
    text = F.concat_ws(" ", "ft", "fb")

    def holds(r) -> Column:
        out = F.lit(True)
        if r.sentiment:
            out = out & (F.col("sentiment") == r.sentiment)
        if r.category:
            out = out & (F.col("category") == r.category)
        if r.paywall is not None:
            out = out & (F.col("paywall") == r.paywall)
        if r.any_text:
            out = out & _any(text, r.any_text)
        for x in r.all_text:
            out = out & text.contains(T._folded(x))
        return out

    return F.array_distinct(F.array_compact(F.array(*[F.when(holds(r), r.tag) for r in lx.rules]).cast("array<string>")))


def entity_array(lx: Lexicon) -> Column:
    """array<struct(type, value, mentions, in_title)> of the lexicon's names found; title and text hits add up."""
    found = []
    for kind, names in (("person", lx.people), ("production", lx.productions), ("venue", lx.venues)):
        for n in names:
            inside, title = _count(F.col("fb"), (n,)), F.col("ft").contains(T._folded(n))
            m = inside + title.cast("int")
            found.append(F.when(m > 0, F.struct(F.lit(kind).alias("type"), F.lit(n).alias("value"), m.cast("int").alias("mentions"), title.alias("in_title"))))
    return F.array_compact(F.array(*found).cast("array<struct<type:string,value:string,mentions:int,in_title:boolean>>"))


def event_array(lx: Lexicon) -> Column:
    """array<struct(type, confidence, what)>: premieres with a production, castings with a person, festivals, milestones."""
    text = F.concat_ws(" ", "ft", "fb")
    first = lambda names: F.element_at(F.array_compact(F.array(*[F.when(text.contains(T._folded(n)), n) for n in names], F.lit("-"))), 1)
    p, q = first(lx.productions), first(lx.people)
    e = lambda k, conf, what: F.struct(F.lit(k).alias("type"), F.lit(conf).alias("confidence"), what.alias("what"))
    return F.array_compact(F.array(
        F.when(text.rlike(r"premiere|urauff") & (p != "-"), e("premiere", 0.8, p)), F.when(text.rlike(r"es spielen|besetzung|in der regie von|uebernimmt") & (q != "-"), e("casting", 0.7, q)),
        F.when(text.rlike(r"festival|gastspiel|tournee"), e("festival_or_tour", 0.6, F.lit("-"))), F.when(text.rlike(r"jubilaeum|auszeichnung|preis fuer"), e("milestone", 0.5, F.lit("-"))),
    ))


def analyse(a: DataFrame, lx: Lexicon) -> DataFrame:
    """Articles with everything this module finds: reason, kind, sentiment, tone, depth, relevance, category, tags, entities, events."""
    d = folded(a).withColumns({"reason": prefilter(lx), "kind": article_kind(lx), "mood": sentiment(lx), "tone": tone(lx), "depth": depth(lx), "score": relevance(lx)})
    d = d.withColumns({"category": category(F.col("score"), lx), "sentiment": F.col("mood.label")})
    return d.withColumns({"tags": auto_tags(lx), "entities": entity_array(lx), "events": event_array(lx)})
