"""Typed values: int, bool, date, semver, dotted and text, as Python keys and as Spark columns that compare alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("int", "bool", "date", "semver", "dotted", "text")
#: The kind that a frontmatter value must have for a type; the others need a string.
KINDS = {"int": "integer", "bool": "boolean"}
_NUMBER = r"(?:0|[1-9][0-9]*)"
_PRE = r"(?:0|[1-9][0-9]*|[0-9]*[A-Za-z-][0-9A-Za-z-]*)"
SEMVER = rf"({_NUMBER})\.({_NUMBER})\.({_NUMBER})(?:-({_PRE}(?:\.{_PRE})*))?"
_SEMVER = re.compile(SEMVER)


class Invalid(ValueError):
    """Why a text is not a value of the type."""


def _days(year: int, month: int) -> int:
    if month == 2:
        return 29 if year % 4 == 0 and (year % 100 or year % 400 == 0) else 28
    return 30 if month in (4, 6, 9, 11) else 31


def parse(kind: str, text: str):
    """A key that sorts as values of the type do; raises Invalid."""
    if kind == "text":
        return text
    if kind == "int":
        if not re.fullmatch(r"-?[0-9]+", text):
            raise Invalid("not an integer")
        digits = text.lstrip("-").lstrip("0")
        n = int(digits or 0) * (-1 if text[0] == "-" else 1) if len(digits) < 20 else 1 << 64
        if not -(1 << 63) <= n < 1 << 63:
            raise Invalid("out of the range of 64 bits")
        return n
    if kind == "bool":
        if text not in ("true", "false"):
            raise Invalid("neither true nor false")
        return text == "true"
    if kind == "date":
        m = re.fullmatch(r"([0-9]{4})-([0-9]{2})-([0-9]{2})", text)
        if not m:
            raise Invalid("not of the form YYYY-MM-DD")
        y, mo, d = map(int, m.groups())
        if not 1 <= mo <= 12 or not 1 <= d <= _days(y, mo):
            raise Invalid("no day of the calendar")
        return y * 10000 + mo * 100 + d
    if kind == "dotted":
        if not re.fullmatch(r"[0-9]+(?:\.[0-9]+)*", text):
            raise Invalid("not numbers parted by dots")
        parts = [x.lstrip("0") or "0" for x in text.split(".")]
        if any(len(x) > 10 or int(x) >= 1 << 32 for x in parts):
            raise Invalid("a part needs more than 32 bits")
        return [int(x) for x in parts]
    if kind == "semver":
        m = _SEMVER.fullmatch(text)
        if not m:
            if "+" in text and _SEMVER.fullmatch(text.split("+", 1)[0]):
                raise Invalid("build metadata after + is not allowed")
            raise Invalid("not a semantic version")
        pre = m[4].split(".") if m[4] else []
        if any(len(x) > 20 or int(x) >= 1 << 64 for x in [*m.groups()[:3], *(p for p in pre if p.isdigit())]):
            raise Invalid("a number needs more than 64 bits")
        return [int(x) for x in m.groups()[:3]], not pre, [(0, int(p), "") if p.isdigit() else (1, 0, p) for p in pre]
    raise KeyError(kind)


def canonical(kind: str, text: str) -> str:
    """The value's plain spelling."""
    key = parse(kind, text)
    return str(key) if kind == "int" else ".".join(map(str, key)) if kind == "dotted" else text


def column(kind: str, text: Column) -> Column:
    """The key of each text as a column that sorts alike; null where the text is no value of the type. JVM only."""
    if kind == "text":
        return text
    if kind == "int":
        return F.when(text.rlike(r"\A-?[0-9]+\z"), text.try_cast("bigint"))
    if kind == "bool":
        return F.when(text == "true", True).when(text == "false", False)
    if kind == "date":
        y, m, d = (F.substring(text, a, n).try_cast("int") for a, n in ((1, 4), (6, 2), (9, 2)))
        leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
        last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        ok = text.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & m.between(1, 12) & d.between(1, last)
        return F.when(ok, y * 10000 + m * 100 + d)
    if kind == "dotted":
        parts = F.transform(F.split(text, r"\."), lambda x: x.try_cast("decimal(38,0)"))
        ok = text.rlike(r"\A[0-9]+(?:\.[0-9]+)*\z") & F.forall(parts, lambda x: x.isNotNull() & (x < 1 << 32))
        return F.when(ok, F.transform(parts, lambda x: x.cast("bigint")))
    if kind == "semver":
        wide = lambda x: x.try_cast("decimal(38,0)")
        small = lambda x: x.isNotNull() & (x < F.lit(str(1 << 64)).cast("decimal(38,0)"))
        core = [wide(F.regexp_extract(text, rf"\A{SEMVER}\z", i)) for i in (1, 2, 3)]
        names = F.filter(F.split(F.regexp_extract(text, rf"\A{SEMVER}\z", 4), r"\."), lambda x: x != "")
        numeric = lambda x: x.rlike(r"\A[0-9]+\z")
        pre = F.transform(names, lambda x: F.struct((~numeric(x)).cast("int").alias("word"), F.when(numeric(x), wide(x)).otherwise(F.lit(0).cast("decimal(38,0)")).alias("number"), F.when(numeric(x), "").otherwise(x).alias("name")))
        ok = text.rlike(rf"\A{SEMVER}\z") & small(core[0]) & small(core[1]) & small(core[2]) & F.forall(names, lambda x: ~numeric(x) | small(wide(x)))
        return F.when(ok, F.struct(core[0].alias("major"), core[1].alias("minor"), core[2].alias("patch"), (F.size(names) == 0).cast("int").alias("release"), pre.alias("pre")))
    raise KeyError(kind)
