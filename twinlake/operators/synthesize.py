"""Fit a table, then sample look-alike rows.

A model is a handful of count tables (one per column) and, for numbers, a grid
of quantiles. ``marginal`` draws every column on its own; ``tree`` links each
column to the one it shares most information with (Chow and Liu, 1968).
"""

from __future__ import annotations

from functools import reduce

import json
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.functions.rand import step_lookup, uniform
from twinlake.operators.aggregate import melt
from twinlake.operators.association import _with_marginals, joint_counts
from twinlake.operators.constraints import keep_valid, needed_columns
from twinlake.operators.draw import draw_weighted, value_counts
from twinlake.operators.fidelity import as_number
from twinlake.operators.joins import attach, null_safe
from twinlake.operators.rank import exact_quantiles, global_rank
from twinlake.sources.scratch import materialize


#: Combinations of fitted values that a rule may be looked up in.
MAX_CELLS = 10_000_000


@dataclass
class Node:
    """One fitted column or fixed combination of columns."""

    name: str
    kind: str  # categorical, numeric, combo, or joint: nodes (``columns``) that are drawn together
    columns: list[str]
    dtype: str = ""
    parent: str | None = None
    grid: list[float] = field(default_factory=list)
    given: bool = False  # drawn by a joint node


@dataclass
class Model:
    nodes: list[Node]
    cells: dict[str, DataFrame]
    combos: dict[str, DataFrame]
    columns: list[str]
    rows: int

    def sample(self, base: DataFrame, seed, key: str = "id") -> DataFrame:
        """One synthetic row per base row; the key column is kept."""
        df = base.select(key)
        for node in self.nodes:
            if node.given:
                continue
            by = [] if node.parent is None else [f"__d_{node.parent}"]
            u = uniform(seed, node.name, key)
            df = draw_weighted(df, self.cells[node.name], by, f"__d_{node.name}", u, f"__d_{node.name}")
            if node.kind == "joint":
                df = df.join(self.combos[node.name].withColumnRenamed("__idx", f"__d_{node.name}"), f"__d_{node.name}", "left")
        for node in self.nodes:
            if node.kind == "numeric":
                inside = uniform(seed, f"{node.name}/in", key)
                df = df.withColumn(node.name, _inside_bin(F.col(f"`__d_{node.name}`"), node, inside))
            else:
                df = self._decoded(df, node)
        return df.select(key, *[c for c in self.columns])

    def _decoded(self, df: DataFrame, node: Node) -> DataFrame:
        """``df`` with the columns of a node that holds no numbers, from its code."""
        if node.kind == "categorical":
            return df.withColumn(node.name, F.col(f"`__d_{node.name}`"))
        if node.kind == "combo":
            return df.join(self.combos[node.name].withColumnRenamed("__idx", f"__d_{node.name}"), f"__d_{node.name}", "left")
        return df

    def conditioned(self, constraints, max_cells: int = MAX_CELLS) -> tuple["Model", list]:
        """The model under the condition that rules hold, and the constraints that could not be worked in.

        Rules over columns without numbers are applied to the fitted cells: the cells of the columns of a rule, and
        in a tree of all their ancestors, become one joint table, the combinations that break the rule leave, and
        draws are made from the rest in proportion. So draws have the model's distribution given the rules, and a
        rule of one in ten million costs no more draws than any other. A rule over numbers within a bin, or one whose
        joint table would exceed ``max_cells``, is returned for rejection. A rule that no cell fulfils is an error.
        """
        owner = {c: n for n in self.nodes if n.kind in ("categorical", "combo") and not n.given for c in n.columns}
        linked, groups, left = any(n.parent is not None for n in self.nodes), [], []
        for rule in constraints:
            cols = needed_columns(rule, self._empty())
            if not cols or any(c not in owner for c in cols):
                left.append(rule)
                continue
            names, rules = self._with_ancestors({owner[c].name for c in cols}), [(rule, cols)]
            if names is None:
                left.append(rule)
                continue
            for other in [g for g in groups if linked or g[0] & names]:
                groups.remove(other)
                names, rules = names | other[0], other[1] + rules
            groups.append((names, rules))
        model = self
        for names, rules in groups:
            joint = model._joined(names, rules, max_cells)
            if joint is None:
                left += [r for r, _ in rules]
            else:
                model = joint
        return model, left

    def _empty(self) -> DataFrame:
        frames = [*self.cells.values(), *self.combos.values()]
        types = {n.name: n.dtype for n in self.nodes if n.dtype}
        for n in self.nodes:
            if n.kind == "combo":
                types |= {f.name: f.dataType.simpleString() for f in self.combos[n.name].schema if f.name in n.columns}
        return frames[0].sparkSession.createDataFrame([], ", ".join(f"`{c}` {types[c]}" for c in self.columns))

    def _with_ancestors(self, names: set[str]) -> set[str] | None:
        """``names`` and all nodes above them; None if a numeric column or a joint node is among them."""
        by_name, out, todo = {n.name: n for n in self.nodes}, set(), list(names)
        while todo:
            node = by_name[todo.pop()]
            if node.kind not in ("categorical", "combo") or node.given:
                return None
            out.add(node.name)
            if node.parent is not None and node.parent not in out:
                todo.append(node.parent)
        return out

    def _joined(self, names: set[str], rules: list, max_cells: int) -> "Model | None":
        members = [n for n in self.nodes if n.name in names]
        joint, size, exact, done = None, 1, True, []
        for node in members:
            code, cells = f"__d_{node.name}", self.cells[node.name]
            if node.parent is None:
                mine = cells.select(code, F.col("__n").cast("double").alias("__w"))
                levels = mine.count()
                if size * levels > max_cells:
                    return None
                joint = mine if joint is None else _with_each(joint, mine.withColumnRenamed("__w", "__w2"), size < levels)
            else:
                exact, up = False, f"__d_{node.parent}"
                total = cells.groupBy(up).agg(F.sum("__n").alias("__all"))
                mine = attach(cells, total, [up]).select(F.col(up).alias("__up"), code, (F.col("__n") / F.col("__all")).alias("__w2"))
                joint = joint.join(mine, joint[up].eqNullSafe(mine["__up"])).drop("__up")
            if "__w2" in joint.columns:
                joint = joint.withColumn("__w", F.col("__w") * F.col("__w2")).drop("__w2")
            joint = self._decoded(joint, node)
            ready = [(r, cols) for r, cols in rules if r not in done and set(cols) <= set(joint.columns)]
            if ready:
                joint = keep_valid(joint, [r for r, _ in ready])
                done += [r for r, _ in ready]
            joint = materialize(joint)
            size = joint.count()
            if size > max_cells:
                return None
        total = joint.agg(F.sum("__w")).first()[0]
        if not total:
            raise ValueError("no combination of the fitted values fulfils: " + ", ".join(r.name for r, _ in rules))
        # products of counts are whole numbers while a double holds them exactly, else shares of 2^50
        weight = F.col("__w") if exact and total < 2.0**52 else F.greatest(F.lit(1.0), F.round(F.col("__w") / total * 2.0**50))
        codes = [f"__d_{n.name}" for n in members]
        ranked, _ = global_rank(joint.select(*codes, weight.cast("long").alias("__n")), *[F.col(c).asc_nulls_first() for c in codes], name="__idx")
        ranked = materialize(ranked)
        # a joint node of one column is not that column's own node
        name = "&".join(n.name for n in members) if len(members) > 1 else f"&{members[0].name}"
        node = Node(name, "joint", [n.name for n in members])
        nodes = [node, *[replace(n, given=True, parent=None) if n.name in names else n for n in self.nodes]]
        cells = {**self.cells, name: materialize(ranked.select(F.col("__idx").alias(f"__d_{name}"), "__n"))}
        combos = {**self.combos, name: materialize(ranked.select("__idx", *codes))}
        return Model(nodes, cells, combos, self.columns, self.rows)

    def synthesize(self, spark: SparkSession, seed, n: int | None = None, key: str = "id") -> DataFrame:
        """``n`` rows, by default as many as the fitted table had."""
        return self.sample(spark.range(self.rows if n is None else n).withColumnRenamed("id", key), seed, key)

    def save(self, path: str) -> None:
        """Write the model as small tables: settings, cells and combinations."""
        spark = next(iter(self.cells.values())).sparkSession
        meta = {"nodes": [asdict(n) for n in self.nodes], "columns": self.columns, "rows": self.rows}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/meta")
        for i, node in enumerate(self.nodes):
            self.cells[node.name].write.parquet(f"{path}/cells_{i}")
            if node.kind in ("combo", "joint"):
                self.combos[node.name].write.parquet(f"{path}/combos_{i}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Model":
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        nodes = [Node(**n) for n in meta["nodes"]]
        cells = {n.name: spark.read.parquet(f"{path}/cells_{i}") for i, n in enumerate(nodes)}
        combos = {
            n.name: spark.read.parquet(f"{path}/combos_{i}") for i, n in enumerate(nodes) if n.kind in ("combo", "joint")
        }
        return cls(nodes, cells, combos, meta["columns"], meta["rows"])


def _with_each(a: DataFrame, b: DataFrame, a_is_smaller: bool) -> DataFrame:
    """Rows of ``a`` with each row of ``b``; the smaller side goes as one list, of at most the root of all combinations."""
    few, many = (a, b) if a_is_smaller else (b, a)
    listed = few.agg(F.collect_list(F.struct(*few.columns)).alias("__list")).withColumn("__one", F.lit(1))
    return many.withColumn("__one", F.lit(1)).join(listed, "__one").select(*many.columns, F.inline("__list"))


def _inside_bin(bin_no: Column, node: Node, u: Column) -> Column:
    """A uniform value inside a quantile bin, in the column's own type."""
    edges = F.array(*[F.lit(float(x)) for x in node.grid])
    lo, hi = F.element_at(edges, bin_no + 1), F.element_at(edges, bin_no + 2)
    value = lo + (hi - lo) * u
    if node.dtype.startswith("timestamp"):
        return F.timestamp_micros(value.cast("long")).cast(node.dtype)
    if node.dtype == "date":
        return F.date_from_unix_date(F.floor(value / 86_400_000_000).cast("int"))
    if node.dtype in ("tinyint", "smallint", "int", "bigint"):
        return F.round(value).cast(node.dtype)
    return value.cast(node.dtype)


def _bin_of(value: Column, grid: list[float]) -> Column:
    """0-based bin of a number; the inner edges belong to the bin below."""
    inner = grid[1:-1]
    if not inner:
        return F.when(value.isNotNull(), F.lit(0))
    bins = [F.lit(i) for i in range(len(inner) + 1)]
    return F.when(value.isNotNull(), step_lookup(value, [float(x) for x in inner], bins, closed=True))


def _grids(df: DataFrame, numeric: list[str], bins: int) -> dict[str, list[float]]:
    """Quantile edges per numeric column; repeated edges are merged."""
    nums = df.select(*[as_number(df, c).alias(c) for c in numeric])
    probs = [i / bins for i in range(bins + 1)]
    found = exact_quantiles(melt(nums, numeric, "double"), ["column"], "value", probs)
    rows = found.collect()  # bins + 1 rows per column
    out = {c: sorted({r["quantile"] for r in rows if r["column"] == c}) for c in numeric}
    return {c: g if len(g) > 1 else [*(g or [0.0]), *(g or [0.0])] for c, g in out.items()}


def fit(
    df: DataFrame,
    categorical: list[str],
    numeric: list[str] = (),
    fixed: list[list[str]] = (),
    method: str = "marginal",
    bins: int = 20,
) -> Model:
    """Fit the named columns. ``fixed`` lists combinations that may only appear as observed."""
    if method not in ("marginal", "tree"):
        raise ValueError("method is 'marginal' or 'tree'")
    in_combo = {c for cols in fixed for c in cols}
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    nodes, combos = [], {}
    coded = df
    for cols in fixed:
        name = "+".join(cols)
        tuples = df.select(*cols).distinct()
        ranked, _ = global_rank(tuples, *cols, name="__idx")
        combos[name] = materialize(ranked)
        right = combos[name].select(*[F.col(c).alias(f"__c_{c}") for c in cols], F.col("__idx").alias(f"__d_{name}"))
        on = null_safe(coded, right, [(c, f"__c_{c}") for c in cols])
        coded = coded.join(right, on, "left").drop(*[f"__c_{c}" for c in cols])
        nodes.append(Node(name, "combo", list(cols)))
    plain = [c for c in categorical if c not in in_combo]
    nodes += [Node(c, "categorical", [c], types[c]) for c in plain]
    coded = coded.withColumns({f"__d_{c}": F.col(c) for c in plain})
    numbers = [c for c in numeric if c not in in_combo]
    if numbers:
        grids = _grids(df, numbers, bins)
        nodes += [Node(c, "numeric", [c], types[c], grid=grids[c]) for c in numbers]
        coded = coded.withColumns({f"__d_{c}": _bin_of(as_number(df, c), grids[c]) for c in numbers})
    coded = coded.select(*[f"__d_{n.name}" for n in nodes])
    coded = coded.persist() if method == "tree" else coded
    try:
        if method == "tree":
            nodes = _tree(coded, nodes)
        cells = {}
        for n in nodes:
            by = [] if n.parent is None else [f"__d_{n.parent}"]
            cells[n.name] = materialize(value_counts(coded, by, f"__d_{n.name}"))
    finally:
        coded.unpersist()
    first = cells[nodes[0].name].agg(F.sum("__n")).first()[0] or 0
    order = [c for c in df.columns if c in in_combo or c in plain or c in numbers]
    return Model(nodes, cells, combos, order, first)


def mutual_information(coded: DataFrame, names: list[str]) -> DataFrame:
    """Mutual information of every pair of coded columns: ``x, y, mi``."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    cells = materialize(joint_counts(coded, pairs))
    total = cells.groupBy("x", "y").agg(F.sum("n").alias("t"))
    marked = _with_marginals(cells).join(total, ["x", "y"])
    share = F.col("n") / F.col("t")
    gain = F.log(F.col("n").cast("double") * F.col("t") / F.col("r") / F.col("c"))
    return marked.groupBy("x", "y").agg(F.sum(share * gain).alias("mi"))


def _tree(coded: DataFrame, nodes: list[Node]) -> list[Node]:
    """Link the columns by a maximum spanning tree of mutual information, root first.

    One row per pair of columns reaches the driver.
    """
    by_name = {n.name: n for n in nodes}
    if len(nodes) < 2:
        return nodes
    found = mutual_information(coded, [f"__d_{n.name}" for n in nodes]).collect()
    weight = {frozenset((r["x"][4:], r["y"][4:])): r["mi"] for r in found}
    linked, rest = [nodes[0].name], [n.name for n in nodes[1:]]
    ordered = [nodes[0]]
    while rest:
        parent, child = max(
            ((p, c) for p in linked for c in rest), key=lambda e: (weight.get(frozenset(e), 0.0), e)
        )
        by_name[child].parent = parent
        ordered.append(by_name[child])
        linked.append(child)
        rest.remove(child)
    return ordered


def sample_valid(
    model: Model, spark: SparkSession, n: int, constraints, seed, key: str = "id", max_draws: int = 100_000_000
) -> DataFrame:
    """The first ``n`` sampled rows, by draw number, that fulfil the constraints.

    Rules that can be are worked into the model first (``Model.conditioned``), so that only the others reject draws.
    Draws go on, each round with new draw numbers and as many as the rate so far asks for, until ``n`` rows are
    valid. Rules that the model cannot fulfil end in an error after ``max_draws`` draws.
    """
    model, constraints = model.conditioned(constraints)
    if not constraints:
        return model.synthesize(spark, seed, n, key)
    kept, have, drawn, size = [], 0, 0, max(n, 1000)
    while have < n:
        if drawn >= max_draws:
            raise ValueError(f"{have} of {n} rows fulfil the constraints after {drawn} draws")
        base = spark.range(drawn, min(drawn + size, max_draws)).withColumnRenamed("id", key)
        kept.append(materialize(keep_valid(model.sample(base, seed, key), constraints)))
        have += kept[-1].count()
        drawn = min(drawn + size, max_draws)
        size = int((n - have) * drawn / have * 1.1) + 1000 if have else 4 * drawn
    if not kept:
        return keep_valid(model.sample(spark.range(0).withColumnRenamed("id", key), seed, key), constraints)
    ranked, _ = global_rank(reduce(DataFrame.unionByName, kept), key, name="__rank")
    return ranked.filter(F.col("__rank") <= n).drop("__rank")
