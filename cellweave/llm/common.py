"""What the operators share: written intermediate tables and text expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.sources.shared import discard, materialize, shared_path

__all__ = ["UPPER", "WORD", "ascii_lower", "discard", "materialize", "n_words", "shared_path", "unused"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: no space, tab, line feed, vertical tab, form feed or carriage return in it.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unused(columns: Sequence[str], *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes that none is one of the columns, whatever the case."""
    taken = {c.lower() for c in columns}
    before = "__"
    while any(f"{before}{n}".lower() in taken for n in names):
        before += "_"
    return [before + n for n in names]
