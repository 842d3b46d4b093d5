"""Commit logs as text: header lines `commit:hash|author|time|subject`, each followed by the paths it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse(lines: DataFrame, order: str, text: str = "value", log: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of log lines in the order of a column; `log` names a column that tells several logs apart.

    A subject may hold bars; a header without four parts, and paths before any header, are dropped. The header is carried
    forward by a window per log, so give `log` where there are many.
    """
    is_head = F.col(text).startswith("commit:")
    w = Window.partitionBy(*([log] if log else [F.lit(0)])).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = F.split(F.substring(F.col(text), 8, 1 << 20), r"\|", 4)
    head = F.when(is_head & (F.size(parts) == 4), F.struct(F.element_at(parts, 1).alias("commit_id"), F.element_at(parts, 2).alias("author"), F.element_at(parts, 3).try_cast("long").alias("ts"), F.element_at(parts, 4).alias("subject")))
    rows = lines.withColumn("_head", head).withColumn("_at", F.last("_head", ignorenulls=True).over(w))
    commits = rows.where("_head is not null").select("_head.*")
    files = rows.where(~is_head & (F.trim(text) != "") & F.col("_at").isNotNull()).select("_at.commit_id", F.trim(text).alias("path"))
    return commits, files


def relative(files: DataFrame, prefix: str) -> DataFrame:
    """Paths under a folder, relative to it."""
    p = prefix.strip("/")
    if not p:
        return files
    return files.where(F.col("path").startswith(p + "/")).withColumn("path", F.substring(F.col("path"), len(p) + 2, 1 << 20))


def latest(commits: DataFrame, files: DataFrame, n: int = 500) -> tuple[DataFrame, DataFrame]:
    """The n newest commits, by time and id, with their files: the window that the commit metrics look at."""
    kept = commits.orderBy(F.desc("ts"), "commit_id").limit(n)
    return kept, files.join(F.broadcast(kept.select("commit_id")), "commit_id", "left_semi")


def read(spark: SparkSession, path: str, prefix: str = "", n: int | None = 500) -> tuple[DataFrame, DataFrame]:
    """(commits, commit_files) of exported logs (a file or a folder of files), paths relative to a folder, the n newest commits or all."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    commits, files = parse(raw, "at", log="log")
    files = relative(files, prefix)
    return (commits, files) if n is None else latest(commits, files, n)
