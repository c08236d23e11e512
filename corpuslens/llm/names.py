"""Variant spellings of names: merge-and-rematch resolution."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut, ship

#: German short forms of given names; one short form may stand for several names.
SHORT_FORMS = {
    "alexander": "alex lex sascha", "andreas": "andi andy andré", "barbara": "babsi bärbel babs", "benjamin": "ben benni benny", "bettina": "betti tina betty", "birgit": "biggi gitte birgitt",
    "carsten": "carsti", "charlotte": "lotte charly lotti charlie", "christoph": "chris stoffel christof", "cosima": "cosi", "detlef": "detti", "dietrich": "dieter dietz", "dominik": "domi nick nik",
    "dorothea": "dodo thea dorle doro", "edeltraud": "edel traudl traudel", "eleonore": "nora lore elli ella norle", "elisabeth": "lisa lisbeth elli sissi betty elsbeth ella liesl else", "ferdinand": "ferdi ferdl nandl",
    "florian": "flo flori", "franziska": "franzi fanny sissi", "friedrich": "fritz friedel fred", "gabriele": "gabi gaby", "gertrud": "traudl trude gerti gerda trudi", "heinrich": "heiner heinz hein heini",
    "hildegard": "hilde hilda hildi", "hubertus": "hubert hubsi berti", "ingeborg": "inge", "irmgard": "irmi irma", "isabella": "isa bella isi", "jakob": "jaki jockel", "joachim": "achim jo jochen jochim",
    "johannes": "hannes hans jo hansi johann", "jürgen": "jörg jürg", "katharina": "kathi käthe kati trine katja", "kilian": "kili", "klaus": "klausi", "kunigunde": "kuni gundi gunda", "leopold": "poldi leo",
    "lieselotte": "lilo liesel lotte lise lotti", "lukas": "luki luk", "magdalena": "lena magda leni", "marianne": "nanni janne anni", "matthias": "matze hias matti matz", "maximilian": "max maxi", "michael": "michi michel micha mike",
    "nikolaus": "nick niko nik", "norbert": "nobbi norbi bert", "oskar": "ossi", "ottilie": "otti tilly tilli", "pauline": "paula pauli", "petra": "peti", "philipp": "phil", "renate": "reni nate rena", "roswitha": "rosi rosl",
    "rüdiger": "rudi rüdi", "sabine": "bine sabi", "sebastian": "basti wastl bastian", "siegfried": "siggi sigi", "stefan": "steffen steff", "tabea": "tabi bea", "theresa": "resi thesi resl tess", "thomas": "tom tommy", "tobias": "tobi",
    "ulrike": "uli rike ulla", "ulrich": "uli ulli", "ursula": "uschi ulla ursel", "valentin": "valli vali veit", "veronika": "vroni vera ronni", "viktoria": "vicky viki vicki", "walburga": "burgl wally burga", "walter": "walti",
    "werner": "wern", "wilhelmine": "minna mina helma minchen", "wilhelm": "willi willy helm", "wolfgang": "wolfi wolf", "xaver": "xaverl", "yannick": "yanni yann",
}
#: What may stand before or after a name, and names of desks instead of people.
LEADING = r"^(?:(?:von|by|par|text|bericht|autor|autorin|interview|kritik|gastbeitrag|aufgezeichnet von)(?:\s*:\s*|\s+))+"
TITLES = r"\b(?:dr|prof|dipl|mag|ing|dram|med|phil|habil|h\.\s*c|b\.\s*a|m\.\s*a)\.(?:-(?=\w))?\s*|\b(?:dr|prof)\s+"
LEGAL = r"(?:,?\s+(?:gmbh|mbh|kg|ohg|ug|ltd|inc|llc|e\.?\s?v\.?|gbr))+\s*$"
DESK = r"(?:die\s+)?\w*-?redaktion(?:\s+\w+)?|(?:la\s+)?r[ée]daction(?:\s+\w+)?|leserbriefe?|newsroom|editorial(?:\s+staff)?|staff(?:\s+writer)?|editors?|unbekannt|anonym|admin"
JOINT = r"\s*(?:&|/|;|\+|\bund\b|\band\b|\bet\b|\bmit\b)\s*"

def fold(s: str) -> str:
    """Lower case; umlauts and their two-letter spellings are one letter."""
    s = s.lower().replace("ß", "ss")
    for a, b in (("ae", "ä"), ("oe", "ö"), ("ue", "ü")):
        s = s.replace(a, b)
    return s


_CANON: dict[str, list[str]] = {}
for _full, _shorts in SHORT_FORMS.items():
    for _s in _shorts.split():
        _CANON.setdefault(fold(_s), []).append(fold(_full))
_FULL = {fold(x) for x in SHORT_FORMS}


def parse_name(raw: str | None) -> dict | None:
    """words (each a list of its hyphen parts), short (initials and abbreviations), code; None for no single name."""
    s = re.sub(r"[\s ]+", " ", raw or "").strip()
    s = re.sub(r"&amp;", "&", s)
    low = s.lower()
    while (t := re.sub(LEADING, "", low)) != low:
        s, low = s[len(s) - len(t) :], t
    code = ""
    if m := re.search(r"\s*\((\w{2,4})\)$", s):
        code, s = fold(m[1]), s[: m.start()]
    s = re.sub(LEGAL, "", s, flags=re.I)
    s = re.sub(TITLES, "", s, flags=re.I).strip(" ,")
    if not s or re.fullmatch(DESK, s, re.I):
        return None
    proper = lambda x: len([w for w in re.findall(r"[^\W\d_]+", x) if len(w) > 1])
    parts = [p for p in re.split(JOINT, s, flags=re.I) if p]
    if len(parts) > 1 and all(proper(p) >= 1 for p in parts) and (proper(parts[-1]) >= 2 or len(parts) > 2):
        return None
    sides = s.split(",")
    if len(sides) > 2 or len(sides) == 2 and all(proper(x) >= 2 for x in sides):
        return None
    if len(sides) == 2:
        s = f"{sides[1]} {sides[0]}"
    shout = s == s.upper()
    words, short = [], []
    for w in re.findall(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*\.?", s.replace("(", " ").replace(")", " ")):
        bare = w.rstrip(".")
        dotted = w.endswith(".") and not re.match(r"[^\W\d_]{5}", w)
        if len(bare) == 1 or (dotted and len(bare) <= 4 and s.count(w) and re.search(re.escape(w) + r"(?:\s|$)", s)):
            short.append(fold(bare))
        elif len(bare) <= 4 and bare.isupper() and (not shout or not re.search("[AEIOUÄÖÜY]", bare) or bare == s.strip(" .")):
            code = code or fold(bare)
        else:
            words.append([fold(p) for p in re.split("[-’']", bare)])
    joined = ["".join(p) for p in words]
    keep = [k for k, w in enumerate(joined) if not any(v != w and v.endswith(w) and len(w) > 3 for v in joined)]
    if not keep and not code:
        return None
    return {"words": [words[k] for k in keep], "short": short, "code": code}


def spread(s: str) -> str:
    """Umlauts as two letters, so that a wrong letter beside a vowel is not taken for one."""
    return s.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")


def keys_of(p: dict) -> list[tuple[str, str, str]]:
    """(kind, key, rest) of a parsed name.

    same: spellings with this key are one name. near: they are, if their ``rest`` differs by one typing
    error. full / part: an abbreviated name leads to the one full name that has its key.
    """
    words = ["".join(w) for w in p["words"]]
    out = []
    if len(words) >= 2:
        out.append(("same", " ".join(sorted(words)), ""))
        out.append(("same", "=" + "".join(words), ""))
        for k, w in enumerate(words):
            rest = " ".join(sorted(words[:k] + words[k + 1 :]))
            longer = _CANON.get(w, [])
            out += [("same" if len(longer) == 1 else "part", ("" if len(longer) == 1 else "nick:") + " ".join(sorted([full, *words[:k], *words[k + 1 :]])), "") for full in longer]
            if w in _FULL:
                out.append(("full", "nick:" + " ".join(sorted(words)), ""))
            if len(w) >= 5:
                for r, v in ((rest, w), (spread(rest), spread(w))):
                    out += [("near", f"{r}|{v[:i]}{v[i + 1 :]}", v) for i in range(len(v))] + [("near", f"{r}|{v}", v)]
            if len(p["words"][k]) > 1 and len(words) == 2:
                out.append(("full", f"double:{rest} {p['words'][k][0]}", ""))
            out += [("full", f"short:{rest}|{w[:n]}", "") for n in (1, 2, 3, 4)]
        if len(words) == 2 and all(len(w) == 1 for w in p["words"]):
            out.append(("part", "double:" + words[0] + " " + words[1], ""))
        flat = [x for w in p["words"] for x in w]
        for n in range(2, len(flat) + 1):
            acronym, tail = "".join(x[0] for x in flat[:n]), " ".join(flat[n:])
            if tail or n >= 3:
                out.append(("full", f"code:{acronym}|{tail}", ""))
    elif len(words) == 1 and p["short"]:
        out += [("part", f"short:{words[0]}|{s}", "") for s in p["short"][:1]]
    elif len(words) == 1 and not p["code"]:
        out.append(("same", "=" + words[0], ""))
    if p["code"] and len(words) >= 2 and len(p["code"]) >= 3:
        out.append(("full", f"code:{p['code']}|", ""))
    elif p["code"] and len(words) <= 1 and (words or len(p["code"]) >= 3):
        out.append(("part", f"code:{p['code']}|{' '.join(words)}", ""))
    return list(dict.fromkeys(out))


def name_keys(names: DataFrame) -> DataFrame:
    """(spelling, kind, key, rest) of distinct spellings; those that name no single person or organisation have no row."""
    ship(sys.modules[__name__])

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(s, *k) for s in batch["spelling"] if (p := parse_name(s)) for k in keys_of(p)]
            yield pd.DataFrame(rows, columns=["spelling", "kind", "key", "rest"])

    return names.mapInPandas(keys, "spelling string, kind string, key string, rest string")


def _one_error(a: str, b: str):
    """At most one letter too many, missing, wrong or two neighbours swapped (both share a deletion)."""
    x, y = F.col(a), F.col(b)
    letters = lambda c: F.array_sort(F.split(c, ""))
    return (F.levenshtein(x, y, 1) >= 0) | ((F.length(x) == F.length(y)) & (F.levenshtein(x, y, 2) == 2) & (letters(x) == letters(y)))


def _links(profiles: DataFrame) -> DataFrame:
    """(a, b): entities to merge in this round. Equal keys form a star around their least entity; only near keys are paired."""
    same = profiles.where("kind = 'same'").select("key", "entity").distinct()
    star = same.join(same.groupBy("key").agg(F.min("entity").alias("least")), "key").where("entity <> least").select(F.col("least").alias("a"), F.col("entity").alias("b"))
    near = profiles.where("kind = 'near'").select("key", "rest", "entity").distinct()
    other = near.select("key", F.col("rest").alias("rest2"), F.col("entity").alias("b"))
    typos = near.join(other, "key").where((F.col("entity") < F.col("b")) & _one_error("rest", "rest2")).select(F.col("entity").alias("a"), "b")
    full = profiles.where("kind = 'full'").groupBy("key").agg(F.min("entity").alias("a"), F.max("entity").alias("most")).where("a = most").select("key", "a")
    part = profiles.where("kind = 'part'").select("key", F.col("entity").alias("b")).distinct()
    return star.unionByName(typos).unionByName(part.join(full, "key").where("a <> b").select("a", "b")).distinct()


def resolve_names(df: DataFrame, column: str) -> DataFrame:
    """(spelling, entity): every distinct value of ``column`` that names one person or organisation, with its entity.

    Each round merges entities whose profiles match; a merged profile has all spellings, short forms,
    initials and codes of its members and enters blocking again, until no merge occurs; every round
    leaves fewer entities, so that it ends. Abbreviated
    names (initials, abbreviations, acronyms, half of a double name) merge only with the one entity
    that fits; if several do they wait, and stay alone if merges never leave just one.

    Null, blank and joint bylines and desk names have no row. Values are kept exactly as they stand.
    The work is on distinct values; the entity is the least hash of its spellings.
    """
    names = cut(df.select(F.col(column).alias("spelling")).where("spelling is not null").distinct())
    keys = cut(name_keys(names).withColumn("entity", F.xxhash64("spelling")))
    current = keys.select("spelling", "entity").distinct()
    while not (links := cut(_links(keys))).isEmpty():
        merged = connected_components(links).where("node <> component")
        keys = cut(keys.join(merged, keys["entity"] == merged["node"], "left").select("spelling", "kind", "key", "rest", F.coalesce("component", "entity").alias("entity")))
        current = keys.select("spelling", "entity").distinct()
    return current


def variant_pairs(df: DataFrame, column: str) -> DataFrame:
    """(a, b) of two different spellings of one entity, a < b by code points.

    The spellings of one entity are few (what people make of one name), so they are paired by a join.
    """
    e = cut(resolve_names(df, column))
    other = e.select("entity", F.col("spelling").alias("b"))
    return e.join(other, "entity").where("spelling < b").select(F.col("spelling").alias("a"), "b")
