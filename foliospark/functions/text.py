"""Text functions that Spark has no equal of: simple case folding, heading slugs, sizes, escapes. Plain Python and columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SLUG = r"[a-z0-9]+(?:-[a-z0-9]+)*"


def _fold(c: str) -> str:
    folded = c.casefold()
    if len(folded) == 1:
        return folded
    low = c.lower()
    return low if len(low) == 1 else c


def simple_fold(text: str) -> str:
    """Unicode simple case folding: a character for each character, no normalisation."""
    return text.lower() if text.isascii() else "".join(map(_fold, text))


def heading_slug(text: str) -> str:
    """The heading's slug, empty if nothing of it is left."""
    if text.isascii():
        return re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")
    out, due = [], False
    for c in "".join(x.lower() for x in unicodedata.normalize("NFKD", text)):
        if c.isascii() and c.isalnum():
            out.append("-" + c if due and out else c)
            due = False
        elif unicodedata.category(c)[0] != "M":
            due = True
    return "".join(out)


def fold_column(text: Column) -> Column:
    """Simple case folding; text of ASCII alone stays in the JVM's lower."""

    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(simple_fold, na_action="ignore")

    return F.when(text.rlike(r"\A[\x00-\x7f]*\z"), F.lower(text)).otherwise(fold(text))


def slug_column(text: Column) -> Column:
    """Slugs of headings; those of ASCII alone stay in the JVM."""

    @F.pandas_udf("string")
    def slug(x: pd.Series) -> pd.Series:
        return x.map(heading_slug, na_action="ignore")

    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(text.rlike(r"\A[\x00-\x7f]*\z"), plain).otherwise(slug(text))


def numbered_tail(slug: Column) -> Column:
    """A slug without its leading numbers: 2-1-setup gives setup."""
    return F.regexp_replace(slug, "^([0-9]+-)+", "")


def typo_limit(slug: Column) -> Column:
    """How many edits still count as a typing error: a third of the length, 1 to 3."""
    return F.least(F.lit(3), F.greatest(F.lit(1), F.ceil(F.length(slug) / 3))).cast("int")


def size_text(n: int) -> str:
    """Decimal size: 999B, 1.5kB, 2.0MB."""
    if n < 1000:
        return f"{n}B"
    unit, name = (1000, "kB") if n < 1_000_000 else (1_000_000, "MB")
    tenths = (n + unit // 20) // (unit // 10)
    return f"{tenths // 10}.{tenths % 10}{name}"


def size_column(n: Column) -> Column:
    def scaled(unit: int, name: str) -> Column:
        tenths = F.floor((n + unit // 20) / (unit // 10))
        return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(name))

    return F.when(n < 1000, F.concat(n.cast("string"), F.lit("B"))).when(n < 1_000_000, scaled(1000, "kB")).otherwise(scaled(1_000_000, "MB"))


_SHORT = {"\\": "\\\\", "\t": "\\t", "\n": "\\n"}


def escape_compact(text: str) -> str:
    """For a field of a tab-separated record."""
    return "".join(_SHORT.get(c) or (f"\\u{{{ord(c):x}}}" if unicodedata.category(c) == "Cc" else c) for c in text)


_HUMAN = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\x1b": "\\x1b"}


def escape_human(text: str) -> str:
    """For a terminal: control and direction characters are spelled out."""
    odd = lambda c: unicodedata.category(c) == "Cc" or c in "؜‎‏" or " " <= c <= "‮" or "⁦" <= c <= "⁯"
    return "".join(_HUMAN.get(c) or (f"\\u{{{ord(c):x}}}" if odd(c) else c) for c in text)


def preview(text: str, most: int = 60) -> str:
    """The first line, at most that many characters of it."""
    line = re.split(r"\r?\n", text, maxsplit=1)[0]
    return line[:most] + "…" if len(line) > most else line


def preview_column(text: Column, most: int = 60) -> Column:
    line = F.regexp_extract(text, r"\A([^\r\n]*)", 1)
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def file_stem(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[0] if "." in name[1:] else name
