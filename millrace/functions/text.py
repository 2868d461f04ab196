"""Text expressions of the onboarding engine. All are built-in expressions; none raises on user data."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space at the ends of a text.
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c.cast("string"), F.lit(SPACE))


def blank(c: Column) -> Column:
    """Null, or nothing but white space. Never null itself."""
    return c.isNull() | (strip(c) == "")


def clean(c: Column) -> Column:
    """Stripped text, null where blank."""
    return F.when(~blank(c), strip(c))


def digits(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"\D", "")


def token(c: Column) -> Column:
    """Lower-case words: _ - / . count as spaces, other ASCII punctuation goes, runs of spaces collapse."""
    t = F.translate(F.lower(strip(c)), "_-/.", "    ")
    t = F.regexp_replace(t, r"""[!"#$%&'()*+,:;<=>?@\[\\\]^`{|}~]""", "")
    return strip(F.regexp_replace(t, r"(?U)\s+", " "))


def title_case(c: Column) -> Column:
    """A capital after every character that isn't a letter, all other letters small."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, F.lit(2), F.length(r)))), "")


def phone(c: Column) -> Column:
    """ddd-ddd-dddd, or null: ten digits, a leading 1 of eleven goes."""
    d = digits(c)
    d = F.when((F.length(d) == 11) & F.startswith(d, F.lit("1")), F.substring(d, 2, 10)).otherwise(d)
    return F.when(F.length(d) == 10, F.concat_ws("-", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4)))


def email(c: Column) -> Column:
    low = F.lower(clean(c))
    return F.when(low.rlike(EMAIL), low)


def number(c: Column) -> Column:
    """double, or null. Infinity and NaN are no numbers here."""
    t = clean(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def boolean(c: Column) -> Column:
    t = F.lower(clean(c))
    return F.when(t.isin("true", "t", "yes", "y", "1"), F.lit(True)).when(t.isin("false", "f", "no", "n", "0"), F.lit(False))


def lookup(c: Column, pairs: Mapping[str, str]) -> Column:
    """The value of a small constant map, null where the key isn't in it."""
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), c)


def java_replacement(text: str) -> str:
    r"""A replacement in Python's notation (\1, \g<1>, \g<name>) as Java reads it."""
    text = text.replace("$", r"\$")
    text = re.sub(r"\\g<(\d+)>", r"${\1}", text)
    text = re.sub(r"\\g<([A-Za-z]\w*)>", r"${\1}", text)
    text = re.sub(r"\$\{(\d+)\}", r"$\1", text)
    return re.sub(r"\\(\d{1,2})", r"$\1", text)


def java_pattern(text: str) -> str:
    r"""A pattern in Python's notation as Java reads it; what has no counterpart raises ValueError.

    Classes (\w, \d, \s, \b) and case are those of Unicode, unless the pattern starts with the flag a.
    """
    if re.search(r"\(\?\(|\(\?P>", text):
        raise ValueError("Conditional patterns are not supported.")
    flags = re.match(r"\(\?([aiLmsux]+)\)", text)
    given = flags[1] if flags else ""
    if "L" in given:
        raise ValueError("Patterns of a locale are not supported.")
    text = re.sub(r"\(\?P<", "(?<", text[flags.end() :] if flags else text)
    text = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", text)
    kept = "".join(f for f in "imsx" if f in given)
    if "a" in given:
        return (f"(?{kept})" if kept else "") + text.replace(r"\Z", r"\z")
    return f"(?U{kept})" + _unicode_words(text)


def _unicode_words(text: str) -> str:
    r"""\w as letters, numbers and the underscore: Java's own has combining marks as well. \Z as \z."""
    out, inside, k = [], False, 0
    while k < len(text):
        two = text[k : k + 2]
        if two[0] == "\\" and len(two) == 2:
            out.append({r"\w": r"\p{L}\p{N}_" if inside else r"[\p{L}\p{N}_]", r"\W": r"[^\p{L}\p{N}_]", r"\Z": r"\z"}.get(two, two))
            k += 2
            continue
        if inside and two[0] == "[":
            out.append("\\")  # a bracket in a class is itself
        if two[0] == "[" and not inside:
            inside = True
            head = re.match(r"\[\^?\]?", text[k:])[0]
            out.append(head[:-1] + "\\]" if head.endswith("]") else head)
            k += len(head)
            continue
        inside = inside and two[0] != "]"
        out.append(two[0])
        k += 1
    return "".join(out)
