"""Metrics over the commit log: commits (commit_id, author, ts seconds, subject) and commit_files (commit_id, path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlens.functions import scalars as S

#: Files of a commit above which it makes no pairs, fewest shared commits of a pair, share of commits a bus factor covers.
PAIR_FILES, SHARED, COVER = 50, 3, 0.8


def file_commits(commit_files: DataFrame) -> DataFrame:
    """(path, commits)."""
    return commit_files.select("commit_id", "path").distinct().groupBy("path").agg(F.count("*").alias("commits"))


def changed_files(commit_files: DataFrame, n: int = 10) -> DataFrame:
    """The n files of most commits."""
    return file_commits(commit_files).orderBy(F.desc("commits"), "path").limit(n)


def top_authors(commits: DataFrame, n: int = 10) -> DataFrame:
    """The n authors of most commits."""
    return commits.groupBy("author").agg(F.count("*").alias("commits")).orderBy(F.desc("commits"), "author").limit(n)


def bus_factors(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """(path, top_author, top_author_commits, total_commits, author_count, bus_factor) of every file.

    The bus factor is the fewest authors, most active first (names on ties), that cover four fifths of the commits.
    """
    by = commit_files.select("commit_id", "path").distinct().join(commits.select("commit_id", "author"), "commit_id").groupBy("path", "author").agg(F.count("*").alias("n"))
    order = Window.partitionBy("path").orderBy(F.desc("n"), "author")
    ranked = by.select("path", "author", "n", F.row_number().over(order).alias("r"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("held"), F.sum("n").over(Window.partitionBy("path")).alias("total"))
    enough = F.col("held") >= F.ceil(F.col("total") * F.lit(COVER))
    return ranked.groupBy("path").agg(
        F.min_by("author", "r").alias("top_author"), F.max("n").alias("top_author_commits"), F.max("total").alias("total_commits"), F.count("*").alias("author_count"), F.min(F.when(enough, F.col("r"))).alias("bus_factor")
    )


def file_ownership(commits: DataFrame, commit_files: DataFrame, n: int = 20) -> DataFrame:
    """The n files of least bus factor, then most commits."""
    return bus_factors(commits, commit_files).orderBy("bus_factor", F.desc("total_commits"), "path").limit(n)


def file_ages(commits: DataFrame, commit_files: DataFrame, now: int, n: int = 20) -> DataFrame:
    """(path, first_commit_unix, last_commit_unix, age_days, last_changed_days) of the n oldest files; commits at or before 0 do not count, nor files first seen after `now`."""
    w = commit_files.join(commits.where("ts > 0").select("commit_id", "ts"), "commit_id").groupBy("path").agg(F.min("ts").alias("first_commit_unix"), F.max("ts").alias("last_commit_unix"))
    days = lambda c: F.expr(f"({int(now)} - {c}) div 86400")
    out = w.where(F.col("first_commit_unix") <= now).withColumn("age_days", days("first_commit_unix")).withColumn("last_changed_days", F.greatest(days("last_commit_unix"), F.lit(0).cast("long")))
    return out.orderBy(F.desc("age_days"), F.desc("last_changed_days"), "path").limit(n)


def bug_prone(commits: DataFrame, commit_files: DataFrame, fix: Column | None = None, n: int = 20) -> DataFrame:
    """(path, bug_fix_commits, total_commits, ratio) of the n files of most fixes; `fix` says which commits are, by default by subject."""
    c = commits.select("commit_id", (S.is_bug_fix(F.col("subject")) if fix is None else fix).alias("fix"))
    f = commit_files.select("commit_id", "path").distinct().join(c, "commit_id").groupBy("path").agg(F.count_if("fix").alias("bug_fix_commits"), F.count("*").alias("total_commits"))
    return f.where("bug_fix_commits > 0").withColumn("ratio", S.ratio(F.col("bug_fix_commits"), F.col("total_commits"))).orderBy(F.desc("bug_fix_commits"), F.desc("ratio"), "path").limit(n)


def change_coupling(commit_files: DataFrame, n: int = 20) -> DataFrame:
    """(left, right, co_commits, coupling_strength) of the n pairs that change together most (Jaccard), from SHARED shared commits.

    Commits of more than PAIR_FILES files make no pairs, so a commit never makes more than 1,225; they still count as commits.
    """
    cf = commit_files.select("commit_id", "path").distinct()
    small = cf.withColumn("n", F.count("*").over(Window.partitionBy("commit_id"))).where(F.col("n") <= PAIR_FILES).select("commit_id", "path")
    pairs = small.select("commit_id", F.col("path").alias("left")).join(small.select("commit_id", F.col("path").alias("right")), "commit_id").where("left < right").groupBy("left", "right").agg(F.count("*").alias("co_commits")).where(F.col("co_commits") >= SHARED)
    total = file_commits(commit_files)
    j = pairs.join(total.select(F.col("path").alias("left"), F.col("commits").alias("cl")), "left").join(total.select(F.col("path").alias("right"), F.col("commits").alias("cr")), "right")
    out = j.select("left", "right", "co_commits", S.ratio(F.col("co_commits"), F.col("cl") + F.col("cr") - F.col("co_commits")).alias("coupling_strength"))
    return out.orderBy(F.desc("coupling_strength"), F.desc("co_commits"), "left", "right").limit(n)


def temporal_hotspots(commit_files: DataFrame, complexity: DataFrame, n: int = 10) -> DataFrame:
    """(path, commits, max_complexity, risk_score) of the n files of greatest commits times greatest complexity. `complexity`: path, value."""
    worst = complexity.groupBy("path").agg(F.max("value").alias("max_complexity"))
    out = file_commits(commit_files).join(worst, "path").withColumn("risk_score", F.col("commits") * F.col("max_complexity")).where("risk_score > 0")
    return out.select("path", "commits", "max_complexity", "risk_score").orderBy(F.desc("risk_score"), F.desc("commits"), "path").limit(n)


def edit_risk(commit_files: DataFrame, complexity: DataFrame, ownership: DataFrame, gaps: DataFrame, n: int = 20) -> DataFrame:
    """(path, commits, max_complexity, bus_factor, has_test_gap, risk_score) of the n riskiest files.

    Risk is commits * complexity * (1 + 1 / bus factor), half more in a test gap. `ownership` is the list of `file_ownership`
    (a file that is not on it counts as 1), `gaps` has the paths of the first hundred test gaps.
    """
    worst = complexity.groupBy("path").agg(F.max("value").alias("max_complexity"))
    j = file_commits(commit_files).join(worst, "path").join(F.broadcast(ownership.select("path", "bus_factor")), "path", "left").join(F.broadcast(gaps.select("path").orderBy("path").limit(100).withColumn("gap", F.lit(True))), "path", "left")
    bus, gap = F.greatest(F.coalesce("bus_factor", F.lit(1)), F.lit(1)), F.coalesce("gap", F.lit(False))
    risk = F.col("commits") * F.col("max_complexity") * (1 + 1.0 / bus) * F.when(gap, 1.5).otherwise(1.0)
    out = j.select("path", "commits", "max_complexity", bus.alias("bus_factor"), gap.alias("has_test_gap"), F.round(risk, 0).cast("long").alias("risk_score")).where("risk_score > 0")
    return out.orderBy(F.desc("risk_score"), F.desc("commits"), "path").limit(n)
