"""German stems, sound codes and compounds: pure functions and Arrow UDFs over distinct words."""

from __future__ import annotations

import re
import sys

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def stem(word: str) -> str:
    """The CISTEM stem (Weissweiler and Fraser 2017) of a word."""
    w = word.lower().replace("ü", "u").replace("ö", "o").replace("ä", "a").replace("ß", "ss")
    w = re.sub(r"^ge(.{4,})", r"\1", w)
    w = w.replace("sch", "$").replace("ei", "%").replace("ie", "&")
    w = re.sub(r"(.)\1", r"\1*", w)
    upper = word[:1].isupper()
    while len(w) > 3:
        if len(w) > 5 and re.search(r"e[mr]$|nd$", w):
            w = w[:-2]
        elif (not upper or len(w) > 3) and re.search(r"t$", w) and not upper or re.search(r"[esn]$", w):
            w = w[:-1]
        else:
            break
    return re.sub(r"(.)\*", r"\1\1", w).replace("$", "sch").replace("%", "ei").replace("&", "ie")


def cologne(word: str) -> str:
    """The Cologne phonetic code (Postel 1969): runs of one digit fall together, zeros only count at the start."""
    s = re.sub("[^a-z]", "", word.lower().translate(str.maketrans("äöüéèêàâç", "aoueeeaac")).replace("ß", "ss"))
    out = []
    for i, c in enumerate(s):
        before, after = s[i - 1 : i], s[i + 1 : i + 2]
        if c in "aeijouy":
            code = "0"
        elif c == "h":
            code = ""
        elif c == "b" or c == "p" and after != "h":
            code = "1"
        elif c in "dt":
            code = "8" if after and after in "csz" else "2"
        elif c in "fvwp":
            code = "3"
        elif c in "gkq":
            code = "4"
        elif c == "c":
            first = i == 0 and after and after in "ahkloqrux"
            code = "4" if first or (i > 0 and before not in "sz" and after and after in "ahkoqux") else "8"
        elif c == "x":
            code = "8" if before and before in "ckq" else "48"
        elif c == "l":
            code = "5"
        elif c in "mn":
            code = "6"
        elif c == "r":
            code = "7"
        else:
            code = "8"
        out.append(code)
    digits = re.sub(r"(.)\1+", r"\1", "".join(out))
    return digits[:1] + digits[1:].replace("0", "")


def compound(word: str, vocabulary: frozenset[str]) -> list[str]:
    """Two known words (of four letters at least) that make up the word, perhaps with a linking sound; [] if there are none."""
    best: list[str] = []
    for i in range(4, len(word) - 3):
        right = word[i:]
        if right in vocabulary:
            for link in ("", "s", "es", "n", "en", "er", "e"):
                left = word[: i - len(link)] if link else word[:i]
                if word[:i].endswith(link) and len(left) >= 4 and left in vocabulary and (not best or len(right) > len(best[1])):
                    best = [left, right]
    return best


def _udf(f, kind: str):
    ship(sys.modules[__name__])

    @F.pandas_udf(kind)
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda w: None if w is None else f(w))

    return apply


def with_codes(vocabulary: DataFrame, word: str = "term") -> DataFrame:
    """Distinct words with ``stem`` and ``sound``; run on a vocabulary, never on every token."""
    return vocabulary.select(word).distinct().select(word, _udf(stem, "string")(F.col(word)).alias("stem"), _udf(cologne, "string")(F.col(word)).alias("sound"))
