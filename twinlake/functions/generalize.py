"""Generalisation of values: ranges, dates, seasons, code prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twinlake.functions.rand import as_column

# Age bands used by the anonymisation recipes.
AGE_EDGES = [-1, 14, 29, 44, 59, 74, 101]
AGE_LABELS = ["<15", "15-29", "30-44", "45-59", "60-74", ">74"]

# Season names by month.
SEASONS = {
    "Winter": (12, 1, 2),
    "Frühling": (3, 4, 5),
    "Sommer": (6, 7, 8),
    "Herbst": (9, 10, 11),
}

# Digits of a four-digit postcode that survive, by first digit.
POSTCODE_KEEP = {"1": 1, "2": 1, "3": 1, "4": 1, "5": 1, "6": 2, "7": 1, "8": 1, "9": 2}


def bin_numeric(col, edges, labels=None, right: bool = True) -> Column:
    """Label of the range a number falls in, NULL outside all ranges.

    Ranges are ``(lo, hi]`` (``[lo, hi)`` with ``right=False``). Without labels
    the result is the 1-based rank of the range, which keeps the order.
    """
    c = as_column(col)
    labels = list(range(1, len(edges))) if labels is None else list(labels)
    if len(labels) != len(edges) - 1 or list(edges) != sorted(set(edges)):
        raise ValueError("need strictly increasing edges and one label per range")
    out = F.when(c <= edges[0] if right else c < edges[0], None)
    for hi, label in zip(edges[1:], labels):
        out = out.when(c <= hi if right else c < hi, F.lit(label))
    return out


def age_from_birthdate(col, ref_year: int) -> Column:
    return F.lit(ref_year) - F.year(as_column(col))


_DATE_LEVELS = {"day": "yyyy-MM-dd", "month_year": "MMMM yyyy", "month": "MM", "year": "yyyy"}


def generalize_date(col, level: str) -> Column:
    """Text of a date at a coarser level: day, month_year, month or year."""
    return F.date_format(as_column(col), _DATE_LEVELS[level])


def season(col, labels=None) -> Column:
    """Season name of a date or of a month number."""
    c = as_column(col)
    out = None
    for name, months in (labels or SEASONS).items():
        hit = c.isin(*months)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def generalize_prefix(col, keep: dict[str, int] | None = None, width: int = 4) -> Column:
    """Shorten all-digit codes of ``width`` to a prefix whose length depends on the first digit.

    Other codes and first digits without a rule stay as they are.
    """
    c = as_column(col).cast("string")
    keep = POSTCODE_KEEP if keep is None else keep
    by_length: dict[int, list[str]] = {}
    for first, n in keep.items():
        by_length.setdefault(n, []).append(first)
    whole = c.rlike(f"^[0-9]{{{width}}}$")
    out = F.when(~whole, c)
    for n, firsts in sorted(by_length.items()):
        out = out.when(F.substring(c, 1, 1).isin(*firsts), F.substring(c, 1, n))
    return out.otherwise(c)
