"""Column roles of a table, loaded from metadata JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Strftime codes and their Spark pattern letters.
_FORMAT_CODES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%B": "MMMM", "%A": "EEEE",
}

# Metadata kinds that hold personal data.
PII_KINDS = {
    "first_name", "last_name", "street_address", "address", "phone_number", "free_email", "email",
}


def spark_format(fmt: str) -> str:
    for code, letters in _FORMAT_CODES.items():
        fmt = fmt.replace(code, letters)
    return fmt


@dataclass
class Roles:
    datetime: list[str] = field(default_factory=list)
    continuous: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    boolean: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    formats: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)
    pii: dict[str, str] = field(default_factory=dict)
    integers: list[str] = field(default_factory=list)

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> "Roles":
        """Read a metadata file; it has one entry per column, so it fits the driver."""
        rows = spark.read.text(path, wholetext=True).take(2)
        if len(rows) != 1:
            raise ValueError(f"need exactly one metadata file at {path}")
        return cls.from_dict(json.loads(rows[0][0].lstrip("\ufeff")))

    @classmethod
    def from_dict(cls, meta: dict) -> "Roles":
        columns = meta.get("columns")
        if not columns:
            raise ValueError("metadata lists no columns")
        out = cls()
        for name, spec in columns.items():
            kind = spec.get("sdtype")
            if spec.get("pii") or kind in PII_KINDS:
                out.pii[name] = kind
                out.ignore.append(name)
            elif kind == "numerical":
                out.continuous.append(name)
                if spec.get("computer_representation", "").startswith("Int"):
                    out.integers.append(name)
            elif kind == "categorical":
                out.categorical.append(name)
            elif kind == "boolean":
                out.boolean.append(name)
            elif kind == "datetime":
                out.datetime.append(name)
                if spec.get("datetime_format"):
                    out.formats[name] = spark_format(spec["datetime_format"])
            elif kind == "id":
                out.ignore.append(name)
                if spec.get("regex_format"):
                    out.patterns[name] = spec["regex_format"]
            else:
                raise ValueError(f"column {name}: unknown kind {kind!r}")
        return out

    @property
    def columns(self) -> list[str]:
        return [*self.datetime, *self.continuous, *self.categorical, *self.boolean, *self.ignore]

    def typed_schema(self, order: list[str]) -> T.StructType:
        kinds: dict[str, T.DataType] = {c: T.TimestampType() for c in self.datetime}
        kinds |= {c: T.LongType() if c in self.integers else T.DoubleType() for c in self.continuous}
        kinds |= {c: T.BooleanType() for c in self.boolean}
        return T.StructType([T.StructField(c, kinds.get(c, T.StringType())) for c in order])


def check_roles(df: DataFrame, roles: Roles) -> DataFrame:
    """Values per column that break their type, date format or id pattern, in one pass over text columns."""
    missing = [c for c in roles.columns if c not in df.columns]
    if missing:
        raise ValueError(f"metadata names columns the table lacks: {missing}")
    tests = {}
    for c in roles.columns:
        text = F.col(f"`{c}`").cast("string")
        if c in roles.continuous:
            ok = F.regexp_replace(text, ",", ".").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
        elif c in roles.boolean:
            ok = text.try_cast("boolean").isNotNull()
        elif c in roles.formats:
            ok = F.try_to_timestamp(text, F.lit(roles.formats[c])).isNotNull()
        elif c in roles.patterns:
            ok = text.rlike(f"^(?:{roles.patterns[c]})$")
        else:
            ok = F.lit(True)
        tests[c] = text.isNotNull() & ~ok
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.sum(F.coalesce(bad, F.lit(False)).cast("long")).alias("invalid"),
            F.count(F.col(f"`{c}`")).alias("filled"),
        )
        for c, bad in tests.items()
    ]
    return df.agg(F.array(*parts).alias("__s")).select(F.inline("__s"))
