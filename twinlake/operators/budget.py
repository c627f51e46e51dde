"""A written ledger of the privacy budget that releases of one data set have spent."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = "claim string, at long, position int, release string, epsilon double, delta double, refused boolean"


class BudgetExceeded(Exception):
    """A release that would spend more than is left."""


class Budget:
    """The total (epsilon, delta) of a data set and the releases made from it, under simple composition.

    The ledger is a folder of Parquet files that only grows. A release first writes its claim and then reads the
    ledger: it counts if all earlier claims and its own fit the total, else a refusal is written and
    ``BudgetExceeded`` raised. So of releases made at the same time the earlier ones win and none is overlooked.
    A claim stays spent if its job fails afterwards, as noise may already have been seen.
    """

    def __init__(self, spark: SparkSession, path: str, epsilon: float, delta: float = 0.0):
        if epsilon <= 0 or delta < 0:
            raise ValueError("the total needs a positive epsilon and no negative delta")
        self.spark, self.path, self.epsilon, self.delta = spark, path, float(epsilon), float(delta)
        self._write([])

    def _write(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, _FIELDS).coalesce(1).write.mode("append").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(_FIELDS).parquet(self.path)

    def ledger(self) -> DataFrame:
        """Releases that count, in order: release, epsilon, delta, spent (epsilon so far)."""
        spent, out = 0.0, []
        for _, rows in self._claims():
            for r in rows:
                spent += r["epsilon"]
                out.append((r["release"], r["epsilon"], r["delta"], spent))
        return self.spark.createDataFrame(out, "release string, epsilon double, delta double, spent double")

    def _claims(self) -> list[tuple[str, list]]:
        """Claims that are not refused, by time; a ledger has a few rows a release."""
        rows = self._rows().orderBy("at", "claim", "position").collect()
        refused = {r["claim"] for r in rows if r["refused"]}
        claims: dict[str, list] = {}
        for r in rows:
            if r["claim"] not in refused:
                claims.setdefault(r["claim"], []).append(r)
        return list(claims.items())

    def spend(self, releases: dict[str, float], delta: float = 0.0) -> list[tuple[str, float, float]]:
        """Enter ``releases`` (name, epsilon), each with ``delta``; returns (name, epsilon, spent with it)."""
        if not releases or min(releases.values()) <= 0 or delta < 0:
            raise ValueError("every release needs a positive epsilon and no negative delta")
        claim, at = uuid.uuid4().hex, time.time_ns()
        self._write([(claim, at, k, n, float(e), float(delta), False) for k, (n, e) in enumerate(releases.items())])
        spent, spent_delta, out = 0.0, 0.0, []
        for name, rows in self._claims():
            for r in rows:
                spent += r["epsilon"]
                spent_delta += r["delta"]
                if name == claim:
                    out.append((r["release"], r["epsilon"], spent))
            if name == claim:
                break
        slack = 1e-9
        if spent > self.epsilon * (1 + slack) or spent_delta > self.delta * (1 + slack):
            self._write([(claim, at, len(releases), "", 0.0, 0.0, True)])
            raise BudgetExceeded(f"epsilon {spent:g} of {self.epsilon:g}, delta {spent_delta:g} of {self.delta:g}")
        return out

    def left(self) -> float:
        """Epsilon that can still be spent."""
        return self.epsilon - (self.ledger().agg(F.sum("epsilon")).first()[0] or 0.0)
