"""Scalar rules as native column expressions, for hot paths without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hunkwise.functions import chunks as ch
from hunkwise.functions import plans


def indent_columns(body: Column) -> Column:
    """Width of the leading blanks with tab stops every eight columns."""
    chars = F.split(F.regexp_extract(body, r"\A([ \t]*)", 1), "")
    return F.aggregate(chars, F.lit(0), lambda n, c: F.when(c == "\t", n + 8 - n % 8).when(c == " ", n + 1).otherwise(n))


def normalised(body: Column) -> Column:
    """A row without the blanks around it."""
    return F.regexp_replace(body, r"\A[ \t]+|[ \t]+\z", "")


def substantive(body: Column) -> Column:
    return body.rlike(r"[\p{L}\p{N}]")


def nonspace_bytes(body: Column) -> Column:
    return F.octet_length(F.regexp_replace(body, r"(?U)\s", ""))


def is_elision(old: Column, new: Column) -> Column:
    """Whether ``new`` is ``old`` with spans of at least one character replaced by ``...`` or ``…``."""
    quoted = F.regexp_replace(new, r"([\\\[\](){}.*+?^$|])", r"\\$1")
    pattern = F.regexp_replace(quoted, r"…|\\\.\\\.\\\.", ".+")
    runs = new.rlike(r"\.{4}|…(…|\.{3})|\.{3}…")
    return new.rlike(r"…|\.{3}") & ~runs & F.rlike(old, F.concat(F.lit(r"(?d)\A"), pattern, F.lit(r"\z")))


def occurs_once(text: Column, part: Column) -> Column:
    """Whether ``text`` holds ``part`` once; overlaps count."""
    first = F.position(part, text)
    return (first > 0) & (F.position(part, text, first + 1) == 0)


def mentions(text: Column, name: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), name, F.lit(r"\E(?![A-Za-z0-9_])")))


def pressure(raw_changed: Column, visible: Column) -> Column:
    """Whether a reading diff keeps so much that a second look pays."""
    much = (visible >= plans.PRESSURE_HIGH) | (visible * 100 >= raw_changed * plans.PRESSURE_PERCENT)
    return (raw_changed >= plans.PRESSURE_RAW) & (visible >= plans.PRESSURE_VISIBLE) & much


def numbered_size(text_bytes: Column, rows: Column) -> Column:
    return F.when(rows == 0, 0).otherwise(text_bytes + rows * (F.length(rows.cast("string")) + 2))


def fits(raw_bytes: Column, text_bytes: Column, rows: Column, budget: int = ch.RUN_BYTES) -> Column:
    return (raw_bytes <= budget) & (numbered_size(text_bytes, rows) <= budget)


def cache_key(protocol: Column, model: Column, diff: Column) -> Column:
    return F.sha2(F.concat(protocol, F.lit("\0"), model, F.lit("\0"), diff).cast("binary"), 256)


def range_text(a: Column, b: Column) -> Column:
    return F.when(a == b, F.concat(F.lit("line "), a)).otherwise(F.concat(F.lit("lines "), a, F.lit("-"), b))
