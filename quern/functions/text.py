"""Whitespace, first lines and truncation as expressions; and the same for Python parsers."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_TRIM, _BLANKS = "[ \\t\\n\\r\\x00\\x0B]", " \t\n\r\x00\x0b"
#: Where none of this stands, the last three beside a newline, normalise_whitespace() has nothing to do but trim.
_UNEVEN, _NEWLINES = ("\r", "\x00", "\t", "\u00a0", "  "), ("\n ", "\n\n\n", " \n")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def trim(text: Column) -> Column:
    """btrim() notes the place of each character, so only texts go to it of which something is trimmed."""
    edge = lambda t: reduce(Column.__or__, [x for c in _BLANKS for x in (t.startswith(F.lit(c)), t.endswith(F.lit(c)))])
    return let(text, lambda t: F.when(edge(t), F.btrim(t, F.lit(_BLANKS))).otherwise(t))


def normalise_whitespace(text: Column) -> Column:
    """CR and CRLF to LF, NUL out, blanks to one, none about a newline, two newlines in a row at most."""
    t = F.replace(F.regexp_replace(text, "\\r\\n?", "\n"), F.lit("\x00"), F.lit(""))
    t = F.regexp_replace(F.regexp_replace(t, "[ \\t\\u00a0]+", " "), " *\\n *", "\n")
    has = lambda *parts: reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in parts])
    uneven = has(*_UNEVEN) | (has("\n") & has(*_NEWLINES))  # far cheaper than one regular expression
    return trim(F.when(uneven, F.regexp_replace(t, "\\n{3,}", "\n\n")).otherwise(text))


def first_line(text: Column) -> Column:
    """Of a trimmed text: its first line is not blank then."""
    return F.coalesce(trim(F.substring_index(text, "\n", 1)), F.lit(""))


def without_first_line(text: Column) -> Column:
    at = F.instr(text, "\n")
    return F.when(at > 0, trim(F.substring(text, at + 1, F.length(text)))).otherwise("")


def truncate(text: Column, length: int) -> Column:
    """Cut to a length, at the last blank if that is past half."""

    def short(text: Column, head: Column) -> Column:
        at = length - F.instr(F.reverse(head), " ")  # characters before the last blank
        cut = F.when((F.instr(head, " ") > 0) & (at > length / 2), F.substring(head, F.lit(1), at)).otherwise(head)
        return F.when(F.char_length(text) <= length, text).otherwise(F.regexp_replace(cut, f"{_TRIM}+$", ""))

    return let(text, lambda t: let(F.substring(t, 1, length), lambda head: short(t, head)))


def py_normalise(text: str) -> str:
    text = re.sub("\r\n?", "\n", text).replace("\0", "")
    text = re.sub(" *\n *", "\n", re.sub("[ \t ]+", " ", text))
    return re.sub("\n{3,}", "\n\n", text).strip(" \t\n\r\0\x0b")


def py_first_line(text: str) -> str:
    return next((x for x in (y.strip() for y in text.split("\n")) if x), "")


def py_truncate(text: str, length: int) -> str:
    if len(text) <= length:
        return text
    head = text[:length]
    at = head.rfind(" ")
    return (head[:at] if at > length / 2 else head).rstrip()
