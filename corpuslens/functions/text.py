"""Text functions as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded to ASCII one to one (after umlauts and ß became two letters).
_FROM, _TO = "áàâãåéèêëíìîïóòôõúùûñçłøý", "aaaaaeeeeiiiioooouuuncloy"
#: Frequent German function words, left out of search.
STOPWORDS = tuple("aber alle als also am an auch auf aus bei bin bis da dann das dass dem den der des die dies diese dieser dieses doch dort du durch ein eine einem einen einer eines er es euch fuer hat hatte hier hin ich ihm ihn ihr ihre im in ist ja jede jeder kann kein keine man mehr mein mit nach nicht noch nun nur ob oder ohne sehr sein seine sich sie sind so ueber um und uns unter vom von vor war was weil wenn wer wie wieder wir wird wo zu zum zur zwischen".split())
#: Words that tell languages apart.
LANGUAGE_WORDS = {"de": "der die das und ist nicht mit von ein eine den auf für", "en": "the and of to is in that it with for was as on", "fr": "le la les et des un une du que dans est pour pas"}


def collapse(c: Column) -> Column:
    """Inner white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))


def fold(c: Column) -> Column:
    """Lower case ASCII: ä to ae, ß to ss, accents dropped."""
    s = F.lower(c)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.translate(s, _FROM, _TO)


def words(c: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(c, r"[\s\p{Z}]+"), lambda w: w != "")


def ascii_tokens(c: Column, least: int = 3) -> Column:
    """Folded tokens of at least ``least`` letters or digits, without stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda t: (F.length(t) >= least) & ~F.array_contains(stop, t))


def letter_tokens(c: Column, least: int = 3) -> Column:
    """Lower-case tokens of letters and digits of any script."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= least)


def occurrences(text: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term, both folded."""
    t = fold(text)
    return F.floor((F.length(t) - F.length(F.replace(t, F.lit(_folded(term)), F.lit("")))) / len(_folded(term)))


def _folded(s: str) -> str:
    s = s.lower()
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = s.replace(a, b)
    return s.translate(str.maketrans(_FROM, _TO))


def normal_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def sentences(c: Column) -> Column:
    """Sentences, cut after . ! ? before white space."""
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def excerpt(c: Column, size: int = 320) -> Column:
    """At most ``size`` characters: to the last sentence end in the second half, else to the last blank with an ellipsis."""
    s = collapse(c)
    head = F.substring(s, 1, size)
    whole = F.regexp_extract(head, r"^(.*[.!?])", 1)
    return F.when(F.length(s) <= size, s).when(F.length(whole) >= size // 2, whole).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))


def first_paragraph(c: Column, size: int = 800) -> Column:
    return F.substring(F.trim(F.element_at(F.split(F.trim(c), r"\n\s*\n"), 1)), 1, size)


def reading_minutes(n_words: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_words / 200 + 0.5)).cast("int")


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def strip_html(c: Column) -> Column:
    """Text of HTML: no scripts, styles and comments, tags as blanks, the usual entities resolved."""
    s = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->|<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&auml;", "ä"), ("&ouml;", "ö"), ("&uuml;", "ü"), ("&Auml;", "Ä"), ("&Ouml;", "Ö"), ("&Uuml;", "Ü"), ("&szlig;", "ß"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return collapse(s)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of the lower-cased texts; 0 if one is empty."""
    x, y = F.lower(F.coalesce(a, F.lit(""))), F.lower(F.coalesce(b, F.lit("")))
    n = F.greatest(F.length(x), F.length(y))
    return F.when((x == "") | (y == ""), 0.0).otherwise(1 - F.levenshtein(x, y) / n)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token arrays; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def cosine_counts(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two token arrays; 0 if one is empty."""
    count = lambda t, w: F.size(F.filter(t, lambda x: x == w))
    total = lambda t, f: F.aggregate(F.array_distinct(t), F.lit(0.0), lambda s, w: s + f(w))
    dot = total(a, lambda w: (count(a, w) * count(b, w)).cast("double"))
    norm = lambda t: F.sqrt(total(t, lambda w: F.pow(count(t, w), F.lit(2.0))))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))


def language_of(c: Column, fallback: str = "de") -> Column:
    """The language most of whose function words stand in the text; ``fallback`` for short texts and ties of none."""
    t = letter_tokens(c, 2)
    among = lambda ws: lambda w: w.isin(*ws.split())
    votes = [F.struct(F.size(F.filter(t, among(ws))).alias("n"), F.lit(-k).alias("k"), F.lit(lang).alias("lang")) for k, (lang, ws) in enumerate(LANGUAGE_WORDS.items())]
    best = F.array_max(F.array(*votes))
    return F.when((F.length(c) < 80) | (best["n"] == 0), fallback).otherwise(F.coalesce(best["lang"], F.lit(fallback)))


def quotes(c: Column) -> Column:
    """Quotations of 8 to 400 characters and at least three words, in order, each once."""
    found = F.regexp_extract_all(c, F.lit(r"[„“«\"]([^„“”«»\"\n]{8,400})[“”»\"]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, F.trim), lambda q: F.size(words(q)) >= 3))


def near(text: Column, term: str, context: tuple[str, ...], reach: int = 200) -> Column:
    """Whether a context word stands within ``reach`` characters of the first occurrence of the term."""
    t = fold(text)
    at = F.locate(_folded(term), t)
    window = F.substring(t, F.greatest(at - reach, F.lit(1)), F.least(at, F.lit(reach + 1)) + reach + len(_folded(term)) - 1)
    hit = F.lit(False)
    for w in context:
        hit = hit | window.contains(_folded(w))
    return (at > 0) & hit


def stem_match(token: Column, stem: str) -> Column:
    """The token is the stem, or begins with it and has at most four letters more (stems of four letters and more)."""
    return (token == stem) | (F.lit(len(stem) >= 4) & token.startswith(stem) & (F.length(token) <= len(stem) + 4))


#: Parameters that only track.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "igshid", "ref", "ref_src", "source", "wt_mc", "xing_share", "at_medium", "at_campaign", "yclid", "_ga", "cmp", "share")


def normal_url(c: Column, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Lower case, no fragment, no tracking parameters, the others in order, no slash at the end. Texts that are no URL are only trimmed."""
    s = F.lower(F.trim(F.replace(c, F.lit("&amp;"), F.lit("&"))))
    bare = F.regexp_replace(s, "#.*$", "")
    path = F.regexp_replace(F.regexp_replace(bare, r"\?.*$", ""), "/$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(F.array(*map(F.lit, tracking)), F.regexp_extract(p, "^([^=]*)", 1))))
    return F.when(~s.rlike("^https?://[^/ ]+"), s).otherwise(F.concat(path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def host(c: Column) -> Column:
    return F.regexp_extract(F.lower(c), r"^https?://(?:www\.)?([^/:?#]+)", 1)


def url_day(c: Column) -> Column:
    """A day in the path (2025/03/07, 2025-03-07), if there is one and it exists."""
    p = r"[/_-]((?:19|20)\d{2})[/_-](\d{1,2})[/_-](\d{1,2})(?:[/_.-]|$)"
    n = lambda k: F.regexp_extract(c, p, k).try_cast("int")
    return F.when(c.rlike(p), F.to_date(F.try_make_timestamp(n(1), n(2), n(3), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))))
