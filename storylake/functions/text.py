"""Text functions with the same result on any Unicode input.

Spark's ``trim`` strips U+0020 only and Java's ``\\s`` is ASCII; these helpers
treat every Unicode white-space character alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as JavaScript and Python see it.
WHITE = r"\s\u0085\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
WHITE_CHARS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
SENTENCE = r"[^.!?]+(?:[.!?]+[\"')\]]*|$)"
XML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it.

    Spark shares equal subexpressions, but not inside functions over arrays.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_white(text: Column) -> Column:
    """``text`` without white space at its ends; only the ends are looked at."""
    return F.trim(text, F.lit(WHITE_CHARS))


def single_spaced(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip_white(F.regexp_replace(text, f"[{WHITE}&&[^ ]][{WHITE}]*| [{WHITE}]+", " "))


def sentences(text: Column) -> Column:
    """Sentences of a normalised text: up to terminators with closing quotes; the whole text if there are none."""

    def cut(t):
        found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(SENTENCE), F.lit(0)), strip_white), lambda s: s != "")
        return bound(found, lambda f: F.when(t == "", F.array().cast("array<string>")).when(F.size(f) > 0, f).otherwise(F.array(t)))

    return bound(text, cut)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, as JavaScript counts."""
    wide = (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")
    return F.when(F.octet_length(text) == F.char_length(text), F.char_length(text)).otherwise(wide)


def xml_escaped(text: Column) -> Column:
    """The five XML entities; the ampersand first."""
    for plain, entity in XML_ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def paragraphs(text: Column) -> Column:
    """Stripped lines without the empty ones."""
    return F.filter(F.transform(F.split(text, "\n"), strip_white), lambda p: p != "")


def code_point_tokens(text: Column) -> Column:
    """Token estimate from characters: a quarter, rounded down."""
    return F.floor(F.length(text) / 4).cast("long")


def byte_tokens(text: Column) -> Column:
    """Token estimate from UTF-8 bytes: a quarter, rounded down."""
    return F.floor(F.octet_length(text) / 4).cast("long")
