"""Rule-based artificial tables: every column is a draw described by data.

A table is generated over the rows of a key column (``spark.range(n)`` or the
keys of another table). Columns are added in the order of the spec, so a draw
may depend on the columns before it. All draws but those from dimension tables
are plain expressions of one projection.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions.rand import as_column, below, uniform, weighted
from twinlake.operators.pseudonym import dictionary_draw, fake_value
from twinlake.operators.rank import global_rank
from twinlake.sources.scratch import materialize


@dataclass
class Context:
    seed: object
    key: str

    def u(self, stream: str) -> Column:
        return uniform(self.seed, stream, self.key)


class Draw:
    """One generated column. Most kinds only need ``column``."""

    def column(self, name: str, ctx: Context) -> Column:
        raise NotImplementedError

    def add(self, df: DataFrame, name: str, ctx: Context) -> DataFrame:
        return df.withColumn(name, self.column(name, ctx))


@dataclass
class Weighted(Draw):
    """A value with probability proportional to its weight; weights need not sum to 1."""

    values: dict

    def column(self, name, ctx):
        return weighted(ctx.u(name), self.values)


@dataclass
class Conditional(Draw):
    """A draw chosen by the value of an earlier column; other values use ``default`` or NULL."""

    on: str
    cases: dict
    default: Draw | None = None

    def column(self, name, ctx):
        out = None
        for value, draw in self.cases.items():
            draw = Weighted(draw) if isinstance(draw, dict) else draw
            hit, drawn = F.col(self.on) == F.lit(value), draw.column(name, ctx)
            out = F.when(hit, drawn) if out is None else out.when(hit, drawn)
        return out if self.default is None else out.otherwise(self.default.column(name, ctx))


@dataclass
class UniformInt(Draw):
    """An integer between two bounds, both included; bounds are numbers or columns."""

    lo: object
    hi: object

    def column(self, name, ctx):
        lo, hi = (F.lit(x) if isinstance(x, int) else as_column(x) for x in (self.lo, self.hi))
        return (lo + below(ctx.u(name), hi - lo + 1)).cast("int")


@dataclass
class InBand(Draw):
    """An integer inside a drawn band such as ``15-29``."""

    band: str

    def column(self, name, ctx):
        ends = F.split(F.col(self.band), "-")
        lo, hi = (F.element_at(ends, i).cast("int") for i in (1, 2))
        return UniformInt(lo, hi).column(name, ctx)


@dataclass
class Bernoulli(Draw):
    """1 with the given probability, else 0."""

    p: object

    def column(self, name, ctx):
        p = F.lit(self.p) if isinstance(self.p, (int, float)) else as_column(self.p)
        return (ctx.u(name) < p).cast("int")


def by_bracket(group: str, value: str, table: dict[str, list[tuple]], factor: float = 1.0) -> Column:
    """A percentage from (upper bound, percent) brackets per group, as a probability.

    An upper bound of None is the last, open bracket.
    """
    out = None
    for g, brackets in table.items():
        arms = None
        for upper, pct in brackets:
            p = F.lit(pct * factor / 100)
            if upper is None:
                arms = p if arms is None else arms.otherwise(p)
            else:
                hit = F.col(value) <= upper
                arms = F.when(hit, p) if arms is None else arms.when(hit, p)
        out = F.when(F.col(group) == g, arms) if out is None else out.when(F.col(group) == g, arms)
    return out


@dataclass
class DateBetween(Draw):
    """A date between two dates, both included."""

    lo: object
    hi: object

    def column(self, name, ctx):
        lo, hi = (F.lit(x).cast("date") if isinstance(x, str) else x for x in (self.lo, self.hi))
        return F.date_add(lo, below(ctx.u(name), F.datediff(hi, lo) + 1).cast("int"))


@dataclass
class Expr(Draw):
    """Any expression of the columns so far, as SQL text, a Column, or a function of the context."""

    expr: object

    def column(self, name, ctx):
        if callable(self.expr):
            return self.expr(ctx, name)
        return F.expr(self.expr) if isinstance(self.expr, str) else self.expr


@dataclass
class Words(Draw):
    """A word of a short dictionary."""

    words: list[str]

    def column(self, name, ctx):
        return dictionary_draw(self.words, ctx.u(name))


@dataclass
class Fake(Draw):
    """Fake personal data of a kind (street, phone, email or a dictionary name)."""

    kind: str
    dictionaries: dict | None = None

    def column(self, name, ctx):
        return fake_value(self.kind, ctx.seed, name, ctx.key, self.dictionaries)


@dataclass
class Lookup(Draw):
    """The value a functional dependency assigns to an earlier column."""

    on: str
    mapping: dict

    def column(self, name, ctx):
        out = None
        for k, v in self.mapping.items():
            hit = F.col(self.on) == F.lit(k)
            out = F.when(hit, F.lit(v)) if out is None else out.when(hit, F.lit(v))
        return out


@dataclass
class DrawFrom(Draw):
    """A uniform row of a dimension table, within the parent an earlier column holds.

    The dimension rows are numbered by (parent, order), so a draw is one
    equality join on that number: a popular parent spreads over its rows.
    ``take`` maps new columns to dimension columns.
    """

    dim: DataFrame
    on: dict[str, str] = field(default_factory=dict)
    take: dict[str, str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)

    def add(self, df, name, ctx):
        parents = list(self.on.values())
        take = self.take or {name: name}
        cols = list(dict.fromkeys([*parents, *self.order, *take.values()]))
        ranked, n = global_rank(self.dim.select(*cols), *parents, *(self.order or take.values()), name="__rank")
        ranked = materialize(ranked)
        pick = ranked.select("__rank", *[F.col(c).alias(new) for new, c in take.items()])
        if not parents:
            return df.withColumn("__rank", below(ctx.u(name), n) + 1).join(pick, "__rank").drop("__rank")
        spans = materialize(
            ranked.groupBy(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parents)]).agg(
                F.min("__rank").alias("__first"), F.count(F.lit(1)).alias("__n")
            )
        )
        on = None
        for i, c in enumerate(self.on):
            one = df[c] == spans[f"__p{i}"]
            on = one if on is None else on & one
        placed = df.join(spans, on, "left").drop(*[f"__p{i}" for i in range(len(parents))])
        placed = placed.withColumn("__rank", F.col("__first") + below(ctx.u(name), F.col("__n")))
        return placed.join(pick, "__rank", "left").drop("__rank", "__first", "__n")


@dataclass
class SubRecord(Draw):
    """A flag and its fields: copied from another sub-record, drawn, or all NULL.

    If the record named ``copy_from`` is given, so is this one, with the same
    values. Otherwise the flag is 1 with probability ``p`` and the fields are
    drawn when it is. Fields are functions of the name a column of this record has.
    """

    p: object
    fields: dict[str, object]
    flag: str = "given"
    copy_from: str | None = None

    def add(self, df, name, ctx):
        flag = f"{name} {self.flag}"
        own = Bernoulli(self.p).column(flag, ctx)
        if self.copy_from:
            copied = F.col(f"`{self.copy_from} {self.flag}`") == 1
            own = F.when(copied, 1).otherwise(own)
        df = df.withColumn(flag, own)
        for f, make in self.fields.items():
            full = f"{name} {f}"
            draw = make(name) if callable(make) else make
            value = F.when(F.col(f"`{flag}`") == 1, draw.column(full, ctx))
            if self.copy_from:
                value = F.when(copied, F.col(f"`{self.copy_from} {f}`")).otherwise(value)
            df = df.withColumn(full, value)
        return df


def generate(base, spec: dict[str, Draw], seed, key: str = "id", keep_key: bool = True) -> DataFrame:
    """Add the columns of ``spec`` to the rows of ``base`` (a DataFrame with the key column)."""
    ctx = Context(seed, key)
    df = base
    for name, draw in spec.items():
        df = draw.add(df, name, ctx)
    return df if keep_key else df.drop(key)


def rows(spark: SparkSession, n: int, key: str = "id") -> DataFrame:
    return spark.range(n).withColumnRenamed("id", key)


def generate_purchases(
    base: DataFrame,
    members: DataFrame,
    products: DataFrame,
    seed,
    member: str,
    product: list[str],
    price: str,
    key: str = "id",
    max_quantity: int = 5,
    points=None,
    order: list[str] | None = None,
) -> DataFrame:
    """One purchase per base row: a member, a product row, a quantity and the total price.

    Products are drawn by row, not by name, because a product name may repeat.
    ``points`` maps the total to loyalty points; without it there is no such column.
    """
    spec: dict[str, Draw] = {
        "member": DrawFrom(members.select(member).distinct(), take={"member": member}),
        "product": DrawFrom(
            products, take={**{c: c for c in product}, "unit_price": price}, order=order or [*product, price]
        ),
        "quantity": UniformInt(1, max_quantity),
        "total": Expr("round(unit_price * quantity, 2)"),
    }
    if points is not None:
        spec["points"] = Expr(lambda ctx, name: points(F.col("total")))
    return generate(base, spec, seed, key)
