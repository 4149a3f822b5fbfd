"""English stemming by the public Porter2 rules, and the analyzer of searched text."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens of this many bytes or more are dropped.
LONGEST = 40

# Fixed values of the public Porter2 rules.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_SAME = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}
_STOP_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate",
    "alism": "al", "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_V = "aeiouy"
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_PREFIX = re.compile(r"gener|commun|arsen")


def _regions(w: str) -> tuple[int, int]:
    m = _PREFIX.match(w) or _REGION.search(w)
    r1 = m.end() if m else len(w)
    m = _REGION.search(w, r1)
    return r1, m.end() if m else len(w)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V + "wxY" and w[-2] in _V and w[-3] not in _V


@functools.lru_cache(200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'")
    if w in _SPECIAL:
        return _SPECIAL[w]
    if w in _SAME:
        return w
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    r1, r2 = _regions(w)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _V for c in w[:-2]):
        w = w[:-1]
    if w in _STOP_1A:
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + "ee"
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                if any(c in _V for c in w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
                        w = w[:-1]
                    elif r1 >= len(w) and _short_end(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for end, new in _STEP_2.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ogi"):
            w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end, new in _STEP_3.items():
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + new
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP_4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
            w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("l") and len(w) - 1 >= r2 and w[-2] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def analyze(text: str) -> list[str]:
    """Stems of a text's runs of letters and digits."""
    out, run = [], []
    for c in text + " ":
        if c.isalnum():
            run.append(c)
        elif run:
            token = "".join(run)
            run = []
            if len(token.encode()) < LONGEST:
                out.append(stem(token.lower()))
    return out


def tokens_column(text: Column) -> Column:
    """Lower-case tokens, not stemmed: JVM only."""
    found = F.regexp_extract_all(text, F.lit(r"([\p{IsAlphabetic}\p{N}]+)"), F.lit(1))
    return F.transform(F.filter(found, lambda x: F.octet_length(x) < LONGEST), F.lower)


def stem_column(token) -> Column:
    @F.pandas_udf("string")
    def stems(x: pd.Series) -> pd.Series:
        return x.map(stem, na_action="ignore")

    return stems(token)
