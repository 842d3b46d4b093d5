"""Policy packs: committed programs whose rows are findings."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.functions.scalars import severity
from factlens.plans.prefix import engine, promote

#: The columns a policy must give.
REQUIRED = ("severity", "code", "path", "message")


@dataclass
class PolicyResult:
    """What one policy gave: findings, or an error."""

    name: str
    findings: DataFrame | None = None
    error: str | None = None
    rows: list = field(default_factory=list)


def evaluate(spark: SparkSession, name: str, program: str, tables: dict[str, DataFrame]) -> PolicyResult:
    """One policy over freshly bound tables; a failure is kept in its result."""
    try:
        df = promote(spark, engine(spark, tables).run(program))
        missing = [c for c in REQUIRED if c not in df.columns]
        if missing:
            return PolicyResult(name, error=f"missing columns: {', '.join(missing)}")
        found = df.select(severity(F.col("severity")).alias("severity"), *[F.col(c).cast("string").alias(c) for c in REQUIRED[1:]])
        found.schema  # noqa: B018  analysed here, so that a bad plan is this policy's error
        return PolicyResult(name, found)
    except Exception as e:  # noqa: BLE001
        return PolicyResult(name, error=str(e).split("\n")[0])


def evaluate_all(spark: SparkSession, folder: str, tables: dict[str, DataFrame]) -> list[PolicyResult]:
    """Every program of a folder, by path; a missing folder has none."""
    where = Path(folder)
    return [evaluate(spark, p.name, p.read_text(), tables) for p in sorted(where.glob("*.rfl"))] if where.is_dir() else []


def exit_code(results: list[PolicyResult]) -> int:
    """1 if a policy failed, else 2 if a finding is an error, else 0."""
    if any(r.error for r in results):
        return 1
    return 2 if any(r.findings is not None and not r.findings.where("severity = 'error'").isEmpty() for r in results) else 0
