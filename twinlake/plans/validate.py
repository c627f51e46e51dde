"""Validate a synthetic table against its original in five phases.

structure: single-column metrics; bivariate: crosstabs; whole: association and
mixture likelihood; applicability: predictive utility and rules; privacy: reuse
of personal data and quasi-identifiers. Each phase is one DataFrame.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.functions import dates
from twinlake.functions import generalize as g
from twinlake.operators import association, basket, clean, crosstab, fidelity, leakage, utility
from twinlake.sources.report import write_report
from twinlake.sources.roles import Roles

PHASES = ("structure", "bivariate", "whole", "applicability", "privacy")

# Age bands of the crosstabs, with a band for unknown birth years.
BAND_EDGES = [-1, 14, 29, 44, 59, 74, 150, 3000]
BAND_LABELS = ["<15", "15-29", "30-44", "45-59", "60-74", ">74", "NA"]

_FLAG = {"Yes": "True", "No": "False", "1": "True", "0": "False", "true": "True", "false": "False",
         "True": "True", "False": "False"}


@dataclass
class Validation:
    roles: Roles
    crosstabs: list[tuple[str, list[str]]] = field(default_factory=list)
    derived: dict[str, list[str]] = field(default_factory=dict)
    age: tuple[str, str] | None = None  # (name of the band column, age or birth-year column)
    birth_year: bool = False
    prefix_flags: dict[str, tuple[str, str]] = field(default_factory=dict)
    sentinels: dict[str, list] = field(default_factory=dict)
    features: list[str] = field(default_factory=list)
    targets: list[str] = field(default_factory=list)
    models: tuple[str, ...] = utility.MODELS
    target_values: list | None = None
    basket: tuple[str, str, str] | None = None
    min_support: float = 0.02
    min_lift: float = 0.8
    min_support_other: float | None = None  # of the other side's rules; None: the same
    features_other: list[str] | None = None  # the other side's features where they were renamed or coarsened
    pii: list[list[str]] = field(default_factory=list)
    quasi: list[list[str]] = field(default_factory=list)

    def prepare(self, df: DataFrame) -> DataFrame:
        """Restore masks, unify flags, parse dates and add the derived columns: one projection."""
        if self.sentinels:
            df = clean.null_if(df, self.sentinels)
        for c in self.roles.boolean:
            df = df.withColumn(c, clean.recode_column(F.col(f"`{c}`").cast("string"), _FLAG))
        texts = {c: f for c, f in self.roles.formats.items() if dict(df.dtypes)[c] == "string"}
        df = dates.parse_dates(df, texts) if texts else df
        df = dates.derive_date_parts(df, self.derived)
        for name, (col, prefix) in self.prefix_flags.items():
            df = df.withColumn(name, clean.has_prefix(col, prefix))
        if self.age:
            name, col = self.age
            # an unknown birth year counts as year 0, which is the band for unknown
            years = F.lit(2023) - F.coalesce(F.col(col), F.lit(0)) if self.birth_year else F.col(col)
            df = df.withColumn(name, g.bin_numeric(years, BAND_EDGES, BAND_LABELS))
        return df

    def nominal(self) -> list[str]:
        parts = [f"{c}_{p}" for c, ps in self.derived.items() for p in ps if p != "date"]
        return [*self.roles.categorical, *self.roles.boolean, *parts]


def structure(o: DataFrame, s: DataFrame, spec: Validation, dataset: str, method: str) -> DataFrame:
    return fidelity.structural_report(o, s, spec.roles, dataset, method)


def bivariate(o: DataFrame, s: DataFrame, spec: Validation) -> DataFrame | None:
    """All crosstabs of both sides as one long table of text cells."""
    parts = []
    for row, cols in spec.crosstabs:
        cells = crosstab.compare_crosstab(o, s, row, cols)
        parts.append(
            cells.select(
                F.lit(f"{row} x {','.join(cols)}").alias("crosstab"),
                F.col(f"`{row}`").cast("string").alias("row"),
                F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in cols]).alias("cell"),
                "n_original",
                "n_synthetic",
                "share_original",
                "share_synthetic",
            )
        )
    return reduce(DataFrame.unionByName, parts) if parts else None


def whole(o: DataFrame, s: DataFrame, spec: Validation, mixture: bool = True, seed: int = 1) -> DataFrame:
    """Association by both nominal measures, their differences, and the mixture likelihood."""
    numeric = spec.roles.continuous
    parts = []
    for measure in ("cramer", "theil"):
        got = association.association_difference(o, s, spec.nominal(), numeric, measure)
        parts.append(got.select(F.lit(measure).alias("measure"), "x", "y", "original", "synthetic", "difference"))
    if mixture and numeric:
        none = F.lit(None).cast("string")
        ll = fidelity.mixture_loglik(o, s, numeric, seed=seed).select(
            F.lit("mixture_log_likelihood").alias("measure"),
            none.alias("x"),
            none.alias("y"),
            F.lit(None).cast("double").alias("original"),
            F.col("mean_log_likelihood").alias("synthetic"),
            F.lit(None).cast("double").alias("difference"),
        )
        parts.append(ll)
    return reduce(DataFrame.unionByName, parts)


def applicability(
    o: DataFrame, s: DataFrame, spec: Validation, order: list[str], seed: int = 1, share_codes: bool = True
) -> DataFrame | None:
    """Utility of each target, or the share of association rules that survive."""
    if spec.basket:
        other = spec.min_support if spec.min_support_other is None else spec.min_support_other
        supports = (spec.min_support, other)
        sides = [basket.mine_rules(df, *spec.basket, least, spec.min_lift) for df, least in zip((o, s), supports)]
        kept = basket.rule_retention(*sides)
        return kept.select(
            F.lit("rules").alias("target"),
            F.lit("association").alias("model"),
            F.lit("other").alias("side"),
            F.lit("retention").alias("metric"),
            F.col("retention").alias("value"),
        )
    if not spec.targets:
        return None
    used = dict.fromkeys([*spec.features, *(spec.features_other or [])])
    categorical = [c for c in used if c in spec.nominal() and c not in spec.roles.continuous]
    return utility.utility_report(
        o, s, spec.targets, spec.features, categorical, order,
        features_other=spec.features_other, target_values=spec.target_values, share_codes=share_codes,
        models=spec.models, seed=seed,
    )


def privacy(o: DataFrame, s: DataFrame, spec: Validation) -> DataFrame | None:
    checks = [*spec.pii, *spec.quasi]
    return leakage.leak_report(o, s, checks) if checks else None


def validate(
    o: DataFrame,
    s: DataFrame,
    spec: Validation,
    dataset: str,
    method: str,
    order: list[str],
    phases=PHASES,
    path: str | None = None,
    mixture: bool = True,
    share_codes: bool = True,
) -> dict[str, DataFrame]:
    """The chosen phases by name; with ``path`` each is also written as a report section.

    Without ``share_codes`` each side's categories get codes of their own, as for an anonymised table.
    """
    o, s = spec.prepare(o), spec.prepare(s)
    made = {
        "structure": lambda: structure(o, s, spec, dataset, method),
        "bivariate": lambda: bivariate(o, s, spec),
        "whole": lambda: whole(o, s, spec, mixture),
        "applicability": lambda: applicability(o, s, spec, order, share_codes=share_codes),
        "privacy": lambda: privacy(o, s, spec),
    }
    out = {p: df for p in phases if (df := made[p]()) is not None}
    if path is not None:
        for p, df in out.items():
            keyed = df.withColumns({"dataset": F.lit(dataset), "method": F.lit(method)})
            write_report(keyed, f"{path}/{p}", f"{method}_{dataset}")
    return out


def measures(got: dict[str, DataFrame]) -> DataFrame:
    """All phases as one table: phase, item, metric, value.

    Crosstabs count half the summed difference of their cell shares, associations the difference of both sides.
    """
    shown = {
        "structure": lambda df: df.select(F.col("column").alias("item"), "metric", "value"),
        "bivariate": lambda df: df.groupBy(F.col("crosstab").alias("item")).agg(
            F.lit("tv_distance").alias("metric"),
            (F.sum(F.abs(F.col("share_original") - F.col("share_synthetic"))) / 2).alias("value"),
        ),
        "whole": lambda df: df.select(
            F.concat_ws(" x ", "x", "y").alias("item"), F.col("measure").alias("metric"), F.coalesce("difference", "synthetic").alias("value")
        ),
        "applicability": lambda df: df.select(
            F.col("target").alias("item"), F.concat_ws("/", "model", "side", "metric").alias("metric"), "value"
        ),
        "privacy": lambda df: df.select(F.col("check").alias("item"), F.lit("share").alias("metric"), F.col("share").alias("value")),
    }
    parts = [shown[p](df).select(F.lit(p).alias("phase"), "item", "metric", F.col("value").cast("double")) for p, df in got.items()]
    return reduce(DataFrame.unionByName, parts)


_VACCINES = ["Tetanus und Diphterie", "Polio", "FSME", "Covid"]
_DATE, _STAMP = "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"
_CASE_DATES = ["date_announced", "date_recovered", "date_of_death", "date_announced_as_removed",
               "date_of_onset_of_symptoms"]

# Roles, crosstabs, targets and checks of the four example datasets.
PRESETS: dict[str, Validation] = {
    "cases": Validation(
        roles=Roles(
            datetime=_CASE_DATES,
            continuous=["age"],
            categorical=["sex", "status", "province", "muni_city", "health_status", "region"],
            boolean=["home_quarantined", "pregnant"],
            ignore=["case_id"],
            formats={c: "dd.MM.yyyy" for c in _CASE_DATES},
        ),
        derived={c: ["month"] for c in _CASE_DATES},
        age=("Alter_Kategorie", "age"),
        crosstabs=[("Alter_Kategorie", ["health_status"]), ("region", ["status", "sex"])],
        features=["age", "sex", "pregnant", "region"],
        targets=["status"],
        target_values=["Recovered", "Died"],
        quasi=[
            ["age", "sex", "pregnant", "province", "muni_city", "region"],
            ["age", "sex", "muni_city", "pregnant"],
            ["age", "sex", "muni_city"],
        ],
    ),
    "loyalty": Validation(
        roles=Roles(
            datetime=["Kaufdatum", "Geburtsdatum"],
            continuous=["Preis in € je Stk", "Anzahl", "Gesamtpreis", "Gesammelte Ös"],
            categorical=["Produktname", "Kategorie", "Verbrauchausgaben-Kategorie", "Bezahlart", "Geschlecht",
                         "Postleitzahl", "Ort"],
            ignore=["Mitgliedsnummer", "Vorname", "Nachname", "Straße", "Telefonnummer", "E-Mailadresse"],
            formats={"Kaufdatum": _STAMP, "Geburtsdatum": _DATE},
        ),
        derived={"Kaufdatum": ["weekday"], "Geburtsdatum": ["year"]},
        age=("Alter_Kategorie", "Geburtsdatum_year"),
        birth_year=True,
        crosstabs=[("Alter_Kategorie", ["Produktname"]), ("Alter_Kategorie", ["Kategorie"])],
        basket=("Mitgliedsnummer", "Produktname", "Anzahl"),
        min_support=0.01,
        pii=[["Mitgliedsnummer"], ["Vorname", "Nachname"], ["Straße"], ["Telefonnummer"], ["E-Mailadresse"]],
        quasi=[
            ["Vorname", "Nachname", "Straße", "Geschlecht", "Geburtsdatum_year", "Postleitzahl"],
            ["Vorname", "Nachname", "Straße"],
            ["Vorname", "Nachname", "Geschlecht", "Geburtsdatum_year", "Postleitzahl"],
            ["Vorname", "Nachname", "Geburtsdatum_year", "Postleitzahl"],
            ["Vorname", "Nachname", "Geburtsdatum_year"],
        ],
    ),
    "retail": Validation(
        roles=Roles(
            datetime=["InvoiceDate"],
            continuous=["Quantity", "UnitPrice", "CustomerID"],
            categorical=["StockCode", "Description", "Country"],
            ignore=["InvoiceNo"],
            formats={"InvoiceDate": "dd.MM.yyyy HH:mm"},
        ),
        derived={"InvoiceDate": ["month", "date"]},
        prefix_flags={"Canceled_order": ("InvoiceNo", "C")},
        crosstabs=[("Description", ["Country"]), ("Description", ["Canceled_order"]),
                   ("Description", ["InvoiceDate_month"])],
        basket=("InvoiceNo", "Description", "Quantity"),
        pii=[["CustomerID"]],
        quasi=[["CustomerID", "Country", "InvoiceDate_date"], ["CustomerID", "InvoiceDate_date"],
               ["Country", "InvoiceDate_date"]],
    ),
    "register": Validation(
        roles=Roles(
            datetime=["Geburtsdatum", *[f"{v} {d}" for v in _VACCINES for d in ("Impfdatum", "Ablaufdatum des Impfstoffs")]],
            categorical=["Geschlecht", "Bundesland", "Postleitzahl", "Ort",
                         *[f"{v} {d}" for v in _VACCINES for d in ("Impfstoff", "Impfstoffhersteller")]],
            boolean=[f"{v} Impfung" for v in _VACCINES],
            ignore=["Vorname", "Nachname", "Sozialversicherungsnummer", "Straße"],
            formats={
                "Geburtsdatum": _DATE,
                **{f"{v} {d}": _DATE for v in _VACCINES for d in ("Impfdatum", "Ablaufdatum des Impfstoffs")},
            },
        ),
        derived={
            "Geburtsdatum": ["year"],
            **{f"{v} Impfdatum": ["month"] for v in _VACCINES},
            **{f"{v} Ablaufdatum des Impfstoffs": ["year"] for v in _VACCINES},
        },
        age=("Alter_Kategorie", "Geburtsdatum_year"),
        birth_year=True,
        crosstabs=[
            *[("Alter_Kategorie", [f"{v} Impfung"]) for v in _VACCINES],
            *[("Geschlecht", [f"{v} Impfung"]) for v in _VACCINES],
        ],
        features=["Geschlecht", "Geburtsdatum_year"],
        targets=[f"{v} Impfung" for v in _VACCINES],
        pii=[["Vorname", "Nachname"], ["Sozialversicherungsnummer"], ["Ort", "Straße"], ["Postleitzahl", "Straße"]],
        quasi=[
            ["Vorname", "Nachname", "Straße", "Ort", "Geschlecht", "Geburtsdatum_year", "Postleitzahl"],
            ["Vorname", "Nachname", "Straße", "Ort"],
            ["Vorname", "Nachname", "Geschlecht", "Geburtsdatum_year", "Postleitzahl"],
            ["Vorname", "Nachname", "Geburtsdatum_year", "Postleitzahl"],
            ["Vorname", "Nachname", "Geburtsdatum_year"],
        ],
    ),
}
