"""A whole analysis of a table: profile, findings, task, advice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.patterns import detect_all, ordered
from tablelens.operators.profile import profile
from tablelens.plans.readiness import advise, facts_of, task_of
from tablelens.sources.scratch import written

#: The advice family of each task.
FAMILY = {"regression": "regression", "binary_classification": "classification", "multiclass_classification": "classification", "text_classification": "text", "clustering": "clustering"}


@dataclass
class Analysis:
    profile: DataFrame
    findings: DataFrame
    task: str
    advice: DataFrame


def analyze(frame: DataFrame, target: str | None = None, name: str = "table") -> Analysis:
    """Without a target the task is clustering if any column is a number. Advice on forecasting joins it where a series
    could be forecast, and on anomalies, reduction and association where there is no target."""
    columns = written(profile(frame), "profile")
    found = ordered(written(detect_all(frame, columns, target), "findings"))
    if target:
        task = task_of(columns).filter(F.col("column") == target).first()["task"]
    else:
        task = "clustering" if columns.filter(F.col("kind").isin("integer", "real")).count() else "none"
    facts = facts_of(found, columns)
    row = facts.first()
    families = [FAMILY[task]] if task in FAMILY else []
    if row["span_days"] >= 60 and (row["seasonal"] or row["trending"] and not target):
        families.append("forecasting")
    if not target:
        families += ["anomaly", "reduction", "association"]
    rows = facts.withColumn("table", F.lit(name)).withColumn("task", F.explode(F.array(*[F.lit(f) for f in families or ["none"]])))
    return Analysis(columns, found, task, advise(rows))
