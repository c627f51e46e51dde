"""Anonymisation recipes: a list of plain-data steps applied as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions import generalize as g
from twinlake.functions.dates import parse_date
from twinlake.operators import anonymity, clean
from twinlake.operators.pseudonym import pseudonymize, substitute_pii


def _age(df, col, ref_year, fmt=None):
    born = parse_date(col, fmt) if fmt else F.col(col)
    return df.withColumn(col, g.age_from_birthdate(born, ref_year))


def _bin(df, col, edges, labels, name=None, pos=None, drop=False):
    name = name or col
    out = df.withColumn(name, g.bin_numeric(col, edges, labels))
    if pos is not None:
        out = clean.move_column(out, name, pos)
    return out.drop(col) if drop and name != col else out


def _date(df, cols, level, fmt=None):
    return df.withColumns(
        {c: g.generalize_date(parse_date(c, fmt, time="H" in fmt) if fmt else c, level) for c in cols}
    )


def _season(df, cols, fmt=None):
    return df.withColumns({c: g.season(F.month(parse_date(c, fmt) if fmt else F.col(c))) for c in cols})


STEPS: dict[str, Callable[..., DataFrame]] = {
    "drop": lambda df, cols: clean.drop_identifiers(df, cols),
    "age": _age,
    "bin": _bin,
    "date": _date,
    "season": _season,
    "prefix": lambda df, col, keep=None: df.withColumn(col, g.generalize_prefix(col, keep)),
    "recode": clean.recode,
    "suppress_patterns": clean.suppress_patterns,
    "suppress_small_groups": anonymity.suppress_small_groups,
    "suppress_min_distinct": anonymity.suppress_min_distinct,
}
SEEDED: dict[str, Callable[..., DataFrame]] = {
    "pseudonymize": lambda df, seed, **kw: pseudonymize(df, seed=seed, **kw),
    "substitute": lambda df, seed, **kw: substitute_pii(df, seed=seed, **kw),
}


@dataclass
class Recipe:
    """Steps plus the columns to measure afterwards."""

    steps: list[dict]
    qi: list[str]
    sa: dict[str, str] = field(default_factory=dict)
    member: str | None = None

    def apply(self, df: DataFrame, seed) -> DataFrame:
        for step in self.steps:
            args = dict(step)
            op = args.pop("op")
            if op in SEEDED:
                df = SEEDED[op](df, seed, **args)
            elif op in STEPS:
                df = STEPS[op](df, **args)
            else:
                raise ValueError(f"unknown step {op!r}")
        return df

    def measure(self, df: DataFrame, order=None) -> DataFrame:
        """Long table (scope, measure, attribute, value) over rows and, with a member, over members.

        The rows are what gets published; counting each member once by its
        first row shows how many people stand behind a class.
        """
        out = _measures(df, self.qi, self.sa, "rows")
        if self.member is not None:
            if order is None:
                raise ValueError("first rows per member need an order")
            members = clean.first_per_key(df, self.member, order)
            out = out.unionByName(_measures(members, self.qi, {}, "members"))
        return out


def _measures(df: DataFrame, qi: list[str], sa: dict[str, str], scope: str) -> DataFrame:
    def named(measure, one, attribute=None):
        return one.select(
            F.lit(scope).alias("scope"),
            F.lit(measure).alias("measure"),
            (F.lit(attribute).cast("string") if attribute is None else F.col(attribute)).alias("attribute"),
            F.col(one.columns[-1]).cast("double").alias("value"),
        )

    out = named("k", anonymity.k_anonymity(df, qi).select("k"))
    if sa:
        out = out.unionByName(named("l", anonymity.l_diversity(df, qi, list(sa))))
        out = out.unionByName(named("t", anonymity.t_closeness(df, qi, sa), "attribute"))
    return out


_VACCINES = ["Tetanus und Diphterie", "Polio", "FSME", "Covid"]
_MONTHS = ["date_announced"]
_REGION = "Central Visayas (Region VII)"
_PENDING = {"date_announced": "May 2020", "status": "For validation"}

# The column names, thresholds and patterns below are fixed values of the four example datasets.
PRESETS: dict[str, Recipe] = {
    "loyalty": Recipe(
        steps=[
            {"op": "drop", "cols": ["Vorname", "Nachname", "Straße", "Telefonnummer", "E-Mailadresse", "Postleitzahl"]},
            {"op": "age", "col": "Geburtsdatum", "ref_year": 2023, "fmt": "yyyy-MM-dd"},
            {"op": "bin", "col": "Geburtsdatum", "edges": g.AGE_EDGES, "labels": g.AGE_LABELS,
             "name": "Geburtsdatum_Kategorie", "drop": True},
            {"op": "date", "cols": ["Kaufdatum"], "level": "day", "fmt": "yyyy-MM-dd HH:mm:ss"},
            {"op": "suppress_small_groups", "qi": ["Geschlecht", "Geburtsdatum_Kategorie", "Kaufdatum"],
             "min_size": 400},
            {"op": "pseudonymize", "col": "Mitgliedsnummer"},
        ],
        qi=["Geschlecht", "Geburtsdatum_Kategorie", "Kaufdatum"],
        sa={"Gesamtpreis": "ordered"},
        member="Mitgliedsnummer",
    ),
    "register": Recipe(
        steps=[
            {"op": "drop", "cols": ["Vorname", "Nachname", "Sozialversicherungsnummer", "Ort", "Straße",
                                    "Postleitzahl", *[f"{v} Impfdatum" for v in _VACCINES]]},
            {"op": "age", "col": "Geburtsdatum", "ref_year": 2023, "fmt": "yyyy-MM-dd"},
            {"op": "bin", "col": "Geburtsdatum", "edges": g.AGE_EDGES, "labels": g.AGE_LABELS,
             "name": "Geburtsdatum_Kategorie", "pos": 1, "drop": True},
            {"op": "suppress_small_groups", "qi": ["Geschlecht", "Geburtsdatum_Kategorie", "Bundesland"],
             "min_size": 15},
        ],
        qi=["Geschlecht", "Geburtsdatum_Kategorie", "Bundesland"],
        sa={
            **{f"{v} Impfung": "ordered" for v in _VACCINES},
            **{f"{v} Impfstoffhersteller": "categorical" for v in _VACCINES},
            **{f"{v} Impfstoff": "categorical" for v in _VACCINES},
        },
    ),
    "retail": Recipe(
        steps=[
            {"op": "pseudonymize", "col": "CustomerID"},
            {"op": "suppress_small_groups", "qi": ["Country"], "min_size": 5},
            {"op": "date", "cols": ["InvoiceDate"], "level": "month_year", "fmt": "dd.MM.yyyy HH:mm"},
            {"op": "suppress_small_groups", "qi": ["Country", "InvoiceDate"], "min_size": 15},
            {"op": "suppress_min_distinct", "group": "Country", "member": "CustomerID",
             "order": ["InvoiceNo", "StockCode"], "n": 11},
        ],
        qi=["Country", "InvoiceDate"],
        member="CustomerID",
    ),
    "cases": Recipe(
        steps=[
            {"op": "bin", "col": "age", "edges": g.AGE_EDGES, "labels": g.AGE_LABELS,
             "name": "age_category", "pos": 1, "drop": True},
            {"op": "date", "cols": _MONTHS, "level": "month_year", "fmt": "dd.MM.yyyy"},
            {"op": "suppress_patterns", "patterns": [
                {"age_category": "<15", "sex": "Female", "region": _REGION, **_PENDING},
                {"age_category": "15-29", "sex": "Male", "region": "CALABARZON (Region IV-A)", **_PENDING},
                {"age_category": "15-29", "region": _REGION, **_PENDING},
                {"age_category": "45-59", "sex": "Female", "region": _REGION, **_PENDING},
                {"age_category": "60-74", "region": _REGION, **_PENDING},
            ]},
            {"op": "drop", "cols": ["date_recovered", "date_of_death", "date_announced_as_removed", "province",
                                    "muni_city", "health_status", "home_quarantined",
                                    "date_of_onset_of_symptoms", "pregnant"]},
            {"op": "suppress_small_groups", "qi": ["age_category", "sex", "date_announced", "region"],
             "min_size": 15},
        ],
        qi=["age_category", "sex", "date_announced", "region"],
        sa={"status": "categorical"},
    ),
}
