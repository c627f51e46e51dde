"""Constraints on rows: predicates, all-or-nothing sub-records, observed combinations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlake.operators.joins import mark_exists


@dataclass
class RowConstraint:
    """A predicate every row must fulfil, as a Column or SQL text; NULL counts as a violation."""

    expr: object
    name: str = "row"

    def valid(self) -> Column:
        e = F.expr(self.expr) if isinstance(self.expr, str) else self.expr
        return F.coalesce(e, F.lit(False))


def outcome_constraint(status: str, value: str, own_date: str, other_date: str, name: str = "outcome") -> RowConstraint:
    """Rows with the status have no ``other_date``; all others have no ``own_date``."""
    is_value = F.col(status).eqNullSafe(F.lit(value))
    ok = (is_value & F.col(other_date).isNull()) | (~is_value & F.col(own_date).isNull())
    return RowConstraint(ok, name)


@dataclass
class SubRecordConstraint:
    """Fields are all NULL when the flag is off and all filled when it is on; optionally a date order."""

    flag: str
    cols: list[str]
    before: tuple[str, str] | None = None
    name: str = "sub_record"

    def valid(self) -> Column:
        on = F.coalesce(F.col(f"`{self.flag}`").cast("boolean"), F.lit(False))
        filled = [F.col(f"`{c}`").isNotNull() for c in self.cols]
        full = reduce(Column.__and__, filled)
        if self.before:
            a, b = (F.col(f"`{c}`") for c in self.before)
            full = full & F.coalesce(a < b, F.lit(False))
        empty = reduce(Column.__and__, [~f for f in filled])
        return (on & full) | (~on & empty)


@dataclass
class FixedCombinations:
    """The listed columns may only hold tuples that occur in ``observed``."""

    cols: list[str]
    observed: DataFrame
    name: str = "combination"


def needed_columns(rule, empty: DataFrame) -> list[str]:
    """The columns of ``empty`` that a constraint uses."""
    if isinstance(rule, FixedCombinations):
        return list(rule.cols)

    def resolves(df: DataFrame) -> bool:
        try:
            return bool(df.select(rule.valid().alias("__ok")).columns)
        except AnalysisException:
            return False

    if not resolves(empty):
        raise ValueError(f"{rule.name} uses columns that there are not: {empty.columns}")
    return [c for c in empty.columns if not resolves(empty.drop(c))]


def keep_valid(df: DataFrame, constraints) -> DataFrame:
    """Rows that fulfil every constraint."""
    for c in constraints:
        if isinstance(c, FixedCombinations):
            df = mark_exists(df, c.observed, c.cols, "__ok").filter("__ok").drop("__ok")
        else:
            df = df.filter(c.valid())
    return df


def validate_constraints(df: DataFrame, constraints) -> DataFrame:
    """Rows and violations per constraint; all row predicates share one pass."""
    per_row = [c for c in constraints if not isinstance(c, FixedCombinations)]
    parts = []
    if per_row:
        sums = [
            F.struct(
                F.lit(c.name).alias("constraint"),
                F.count(F.lit(1)).alias("rows"),
                F.sum((~c.valid()).cast("long")).alias("violations"),
            )
            for c in per_row
        ]
        parts.append(df.agg(F.array(*sums).alias("__s")).select(F.inline("__s")))
    for c in constraints:
        if isinstance(c, FixedCombinations):
            # count tuples first, so a common tuple meets the observed ones once
            tuples = df.groupBy(*c.cols).agg(F.count(F.lit(1)).alias("__n"))
            marked = mark_exists(tuples, c.observed, c.cols, "__ok")
            parts.append(
                marked.agg(
                    F.sum("__n").alias("rows"), F.sum(F.when(~F.col("__ok"), F.col("__n")).otherwise(0)).alias("violations")
                ).select(F.lit(c.name).alias("constraint"), "rows", "violations")
            )
    return reduce(DataFrame.unionByName, parts)
