"""Parsing, splitting and re-assembling dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.functions.rand import as_column

PARTS = ("year", "month", "day", "hour", "minute", "second")

_PART_OF = {
    "year": F.year,
    "month": F.month,
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
    "second": F.second,
}

_DERIVED = {
    "month": "MMMM",
    "weekday": "EEEE",
    "date": "dd.MM.yyyy",
}


def parse_date(col, fmt: str, strict: bool = False, time: bool = False) -> Column:
    """Text to date or timestamp; bad text is NULL, or an error when strict."""
    c = as_column(col)
    if strict:
        return F.to_timestamp(c, fmt) if time else F.to_date(c, fmt)
    ts = F.try_to_timestamp(c, F.lit(fmt))
    return ts if time else ts.cast("date")


def parse_dates(df: DataFrame, formats: dict[str, str], strict: bool = False) -> DataFrame:
    """Parse each named text column by its format; formats with an hour give timestamps."""
    return df.withColumns(
        {c: parse_date(c, f, strict, time="H" in f or "h" in f) for c, f in formats.items()}
    )


def derive_date_parts(df: DataFrame, spec: dict[str, list[str]]) -> DataFrame:
    """Add ``<col>_month``, ``_weekday``, ``_year`` and ``_date`` columns as the spec lists them."""
    out = {}
    for c, parts in spec.items():
        for part in parts:
            out[f"{c}_{part}"] = (
                F.year(c) if part == "year" else F.date_format(c, _DERIVED[part])
            )
    return df.withColumns(out)


def split_date(df: DataFrame, col: str, parts=("day", "month", "year"), drop: bool = True) -> DataFrame:
    out = df.withColumns({f"{col}_{p}": _PART_OF[p](col) for p in parts})
    return out.drop(col) if drop else out


def assemble_date(
    df: DataFrame,
    col: str,
    with_time: bool = False,
    ignore_seconds: bool = False,
    fmt: str | None = None,
    drop: bool = True,
) -> DataFrame:
    """Build formatted text from ``<col>_day`` … parts; impossible dates give NULL."""
    used = list(PARTS[:3])
    if with_time:
        used += ["hour", "minute"] if ignore_seconds else ["hour", "minute", "second"]
    if fmt is None:
        fmt = "dd.MM.yyyy"
        if with_time:
            fmt += " HH:mm" if ignore_seconds else " HH:mm:ss"
    values = {p: F.col(f"{col}_{p}").cast("int") for p in used}
    args = [values.get(p, F.lit(0)) for p in PARTS]
    stamp = F.try_make_timestamp(*args)
    valid = values["year"].between(1000, 9999)
    out = df.withColumn(col, F.when(valid, F.date_format(stamp, fmt)))
    return out.drop(*[f"{col}_{p}" for p in used]) if drop else out
