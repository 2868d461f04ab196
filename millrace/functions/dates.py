"""Dates from text: an ordered list of formats, each strict and null on failure."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean

# Strptime directives that have a counterpart.
DIRECTIVES = {"%Y": "yyyy", "%m": "M", "%d": "d", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "D", "%H": "H", "%M": "m", "%S": "s", "%p": "a", "%I": "h", "%%": "%"}
#: Formats tried without a stated list, month before day.
PIPELINE = ["yyyy-MM-dd", "yyyyMMdd", "M/d/yyyy", "yyyy/M/d", "M-d-yyyy", "d-MMM-yyyy"]
FREE = ["yyyy-MM-dd", "yyyy-M-d", "M/d/yyyy", "yyyy/M/d", "M-d-yyyy", "d-MMM-yyyy", "MMM d yyyy", "yyyyMMdd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS", "d/M/yyyy"]


def spark_format(directive: str) -> str:
    """A strptime format as a Spark pattern; ValueError for directives without a counterpart."""
    out, i = "", 0
    while i < len(directive):
        if directive[i] == "%":
            if directive[i : i + 2] not in DIRECTIVES:
                raise ValueError(f"Unsupported date directive {directive[i : i + 2]}.")
            out += DIRECTIVES[directive[i : i + 2]]
            i += 2
        else:
            out += f"'{directive[i]}'" if directive[i].isalpha() else directive[i]
            i += 1
    return out


def shape(pattern: str) -> str:
    """What a text of the pattern looks like. A failed parse costs an exception for each value, a failed look nothing."""
    runs = [m.group(0) for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", pattern)]
    known = {"yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "[A-Za-z]{3}", "MMMM": "[A-Za-z]+", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "D": r"\d{1,3}", "a": "[A-Za-z]{2}"}
    return "^" + "".join(known.get(r) or (r"\d{1,2}" if r in "MdHhms" else re.escape(r.strip("'"))) for r in runs) + "$"


#: Digits as 9 and ASCII letters as a: what a text looks like.
_LETTERS = "".join(chr(c + k) for c in (65, 97) for k in range(26))
_SIGNS, _KINDS = "0123456789" + _LETTERS, "9" * 10 + "a" * 52


def looks(pattern: str) -> set[str] | None:
    """All the ways a text of the pattern can look; None for patterns with words of any length."""
    out = {""}
    for run in (m.group(0) for m in re.finditer(r"'[^']*'|([A-Za-z])\1*|.", pattern)):
        lengths = {"yyyy": (4,), "yy": (2,), "MM": (2,), "dd": (2,), "HH": (2,), "mm": (2,), "ss": (2,), "D": (1, 2, 3), "S" * 9: tuple(range(1, 10))}.get(run) or ((1, 2) if run in "MdHhms" else None)
        if run == "MMMM" or (lengths is None and run.isalpha() and run not in ("MMM", "a")):
            return None
        ends = ["9" * n for n in lengths] if lengths else ["aaa"] if run == "MMM" else ["aa"] if run == "a" else [run.strip("'").translate(str.maketrans(_SIGNS, _KINDS))]
        out = {x + e for x in out for e in ends}
    return out


def _parsed(text: Column, pattern: str) -> Column:
    d = F.try_to_date(text, pattern)
    if "yy" in pattern and "yyyy" not in pattern:  # years 69 to 99 belong to the last century
        d = F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d)
    return d


def parse(c: Column, patterns: list[str]) -> Column:
    """The first of the patterns that fits, else null. A value is looked at once, and only patterns of its look are tried: a failed parse costs an exception."""
    known = {p: found for p in patterns if (found := looks(p)) is not None}
    ways: dict[tuple[str, ...], list[str]] = {}
    for look in sorted(set().union(*known.values())):
        ways.setdefault(tuple(p for p in patterns if look in known.get(p, ())), []).append(look)

    def of(v: Column) -> Column:
        look = F.translate(v, _SIGNS, _KINDS)
        out = None
        for tried, looked in ways.items():
            parsed = F.coalesce(*[_parsed(v, p) for p in tried])
            out = F.when(look.isin(*looked), parsed) if out is None else out.when(look.isin(*looked), parsed)
        rest = [F.when(v.rlike(shape(p)), _parsed(v, p)) for p in patterns if p not in known]
        if not rest:
            return out
        # A pattern with words of any length has its place among the others: letters keep their looks apart, so it can't fit where another does.
        return F.coalesce(*([out] if out is not None else []), *rest)

    return of(clean(c))


def free(c: Column) -> Column:
    """The first format of FREE that fits, else null."""
    return parse(c, FREE)


def age(born: Column, asof: Column) -> Column:
    """Whole years, counted by calendar day."""
    early = (F.month(asof) < F.month(born)) | ((F.month(asof) == F.month(born)) & (F.dayofmonth(asof) < F.dayofmonth(born)))
    return F.year(asof) - F.year(born) - early.cast("int")
