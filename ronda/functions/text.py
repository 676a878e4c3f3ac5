"""Text clean-up and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ronda import fixed_values as fv


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(text, F.lit(fv.WHITE_SPACE))


def filled(text: Column) -> Column:
    """True for text that is neither null nor empty; never null."""
    return text.isNotNull() & (text != "")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def last_part(text: Column, separator: str = fv.RELIEF_SEPARATOR) -> Column:
    return strip(F.split_part(text, F.lit(separator), F.lit(-1)))


def service_type(*candidates: Column) -> Column:
    """First filled candidate, else the default service."""
    return F.coalesce(*[none_if_empty(c) for c in candidates], F.lit(fv.DEFAULT_SERVICE))


def clipped(text: Column) -> Column:
    """Notification body."""
    head = F.substring(text, 1, fv.PUSH_BODY_CHARS)
    tail = F.lit(fv.PUSH_BODY_TAIL)
    return F.when(F.length(text) > fv.PUSH_BODY_CHARS, F.concat(head, tail)).otherwise(text)


def row_id(*parts: Column) -> Column:
    """Repeatable id: a task that is run again writes the same one.  A missing
    part is marked, so that it does not give the id of a shorter key."""
    marked = [F.coalesce(p.cast("string"), F.lit("\0")) for p in parts]
    return F.sha2(F.concat_ws("|", *marked), 256)
