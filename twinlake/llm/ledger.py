"""Secret scans over a ledger of blobs.

Every historical version of a text is a blob, named by its SHA-256. The ledger is a table (blob, rules, spans) of
what has been scanned under which version of the rules. A scan digests all rows, takes the blobs that the ledger
does not have under the current rules, scans one copy of each, appends the findings, and joins the findings of all
blobs back to all rows (paths). Scanning the same texts again reads no text beyond its digest.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinlake.sources.scratch import materialize

from .common import located, salted_left_join, within, without

RULES = "2"
SPAN = "array<struct<kind: string, start: int, end: int>>"
LEDGER = f"blob binary, rules string, spans {SPAN}"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "jwt", "pem", "github")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# only maximal runs of 24 and more count
_HEX = re.compile(r"[0-9a-f]{24,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")
_GITHUB = re.compile(r"(?<![A-Za-z0-9_])gh[pousr]_[A-Za-z0-9]{36,}")


def find(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings in one text in code points, by start, then kind."""
    text = text or ""
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for mark, kind, rule in (("eyJ", "jwt", _JWT), ("-----BEGIN", "pem", _PEM), ("gh", "github", _GITHUB)):
        if mark in text:
            out += [(kind, *m.span()) for m in rule.finditer(text)]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


@F.pandas_udf(
    T.ArrayType(
        T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    )
)
def _find_all(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find(t)] for t in text])


@F.pandas_udf(T.BinaryType())
def _blob(text: pd.Series) -> pd.Series:
    return pd.Series([hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest() for t in text])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: str = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings, added): one row (id, blob, spans, fresh) per row of ``docs``, and the rows to append to the ledger.

    NULL counts as the empty text. Rows that repeat an id are rows of their own; rows with equal texts share a blob
    and are scanned once. ``fresh`` says whether this call scanned the blob. Other columns are ignored.
    """
    placed = located(docs, "__row")
    rows = materialize(placed.select("__row", F.col(id_col).alias("__id"), _blob(text_col).alias("blob")))
    known = ledger.where(F.col("rules") == rules).select("blob").distinct()
    # one row of each unseen blob is scanned where it is
    unseen = rows.groupBy("blob").agg(F.min("__row").alias("__row")).join(known, "blob", "left_anti")
    unseen = materialize(unseen.select("__row"))
    texts = placed.select("__row", F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    if 2 * unseen.count() <= rows.count():
        texts = within(texts, unseen, "__row")
    else:
        texts = without(texts, materialize(rows.select("__row").join(unseen, "__row", "left_anti")), "__row")
    scanned = texts.select(_blob("__text").alias("blob"), F.lit(rules).alias("rules"), _find_all("__text").alias("spans"))
    added = materialize(scanned)
    old = ledger.where(F.col("rules") == rules).join(rows.select("blob").distinct(), "blob", "left_semi")
    facts = added.select("blob", "spans", F.lit(True).alias("fresh")).unionByName(
        old.select("blob", "spans", F.lit(False).alias("fresh")).dropDuplicates(["blob"])
    )
    # clean blobs need no row in the join
    facts = materialize(facts.where("size(spans) > 0 OR NOT fresh"))
    out = salted_left_join(rows, facts, "blob", F.col("__row"))
    none = F.from_json(F.lit("[]"), SPAN)
    return (
        out.select(
            F.col("__id").alias(id_col), "blob", F.coalesce("spans", none).alias("spans"), F.coalesce("fresh", F.lit(True)).alias("fresh")
        ),
        added,
    )
