"""One text per value, whatever numeric or date type a table happens to hold it in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATING = (T.DoubleType, T.FloatType)
#: A number as text: sign, digits with at most one point, exponent.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]{1,4})?\s*$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that it uses more than once but that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shifted(parts: Column) -> Column:
    """Digits with the point moved by the exponent; ``parts`` has whole, digits and exponent."""
    point, digits, zeros = F.length(parts["whole"]) + parts["exponent"], parts["digits"], F.lit("0")
    return (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(zeros, -point), digits))
        .when(point >= F.length(digits), F.rpad(digits, point, zeros))
        .otherwise(F.concat(F.left(digits, point), F.lit("."), F.substr(digits, point + 1)))
    )


def decimal_text(c: Column) -> Column:
    """Number text, with or without an exponent, as its shortest decimal digits: 2.50000005E7 is 25000000.5.

    Only text is handled, so no digit is lost at any size: the point moves by the exponent, then zeros that say
    nothing go, as does the sign of zero.
    """

    def moved(p: Column) -> Column:
        mantissa = F.regexp_replace(p[0], "^[+-]", "")
        parts = F.struct(
            F.substring_index(mantissa, ".", 1).alias("whole"),
            F.replace(mantissa, F.lit("."), F.lit("")).alias("digits"),
            p[1].cast("int").alias("exponent"),
        )
        return F.concat(F.when(F.startswith(p[0], F.lit("-")), "-").otherwise(""), _let(parts, _shifted))

    bare = F.lower(F.trim(c))
    plain = F.when(F.contains(bare, F.lit("e")), _let(F.split(bare, "e"), moved)).otherwise(bare)
    for rule, to in ((r"(\.[0-9]*?)0+$", "$1"), (r"\.$", ""), (r"^([+-]?)0+(?=[0-9])", "$1"), (r"^\+|^-(?=0?$)", ""), (r"^(-?)(?=\.|$)", "$10")):
        plain = F.regexp_replace(plain, rule, to)
    return plain


def value_text(df: DataFrame, name: str, numeric: bool = False) -> Column:
    """The column as text that is equal for equal values of the types two files may be read with.

    34, 34.0 and the decimal 34.00 are all ``34``; 2.50000005E7 is ``25000000.5``; -0.0 is ``0``; whole numbers of any
    length keep all digits; a timestamp at midnight is its date. Text stays as it is, unless the column is compared
    with a number (``numeric``): then text that is a number is written like one.
    """
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, _FLOATING):
        text = c.cast("string")
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), text).otherwise(decimal_text(text))
    if isinstance(kind, T.DecimalType) and kind.scale:
        return decimal_text(c.cast("string"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.when(c == F.date_trunc("DAY", c), c.cast("date").cast("string")).otherwise(c.cast("string"))
    if numeric and isinstance(kind, T.StringType):
        return F.when(F.rlike(c, F.lit(_NUMBER)), decimal_text(c)).otherwise(c)
    return c.cast("string")


def meets_number(df: DataFrame, other: DataFrame, name: str) -> bool:
    """Whether text in column ``name`` of ``df`` is compared with numbers of ``other``."""
    if name not in other.columns:
        return False
    return isinstance(df.schema[name].dataType, T.StringType) and isinstance(other.schema[name].dataType, T.NumericType)


def texts_of(df: DataFrame, other: DataFrame, cols: list[str]) -> dict[str, Column]:
    """``value_text`` of columns that are compared with the columns of the same names in ``other``."""
    return {c: value_text(df, c, meets_number(df, other, c)) for c in cols}
