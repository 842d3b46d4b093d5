"""The current files of a catalogue with their current texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean_path(path: str):
    """A path with `/` between its parts and without a leading `./`."""
    return F.regexp_replace(F.regexp_replace(F.col(path), r"\\", "/"), r"^(\./)+", "")


def extension(path: str):
    """The lower-case last extension of a path's file name, empty if it has none."""
    name = F.element_at(F.split(F.col(path), r"[/\\]"), -1)
    return F.when(F.instr(name, ".") > 0, F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def current_sources(files: DataFrame, texts: DataFrame, columns: list[str]) -> DataFrame:
    """(file_id, columns of `files`, content) of files with a row in `files` and a current text that is not null.

    Of a file's rows the one with the latest scanned_at counts, of its texts the one with the latest fetched_at; of
    several latest rows that differ, the greatest, so the result never depends on row order. Rows without file_id are left out. The texts
    are shuffled once, by file_id, for both the choice and the join.
    """
    f = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("scanned_at", *columns)).alias("f"))
    t = texts.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("fetched_at", "content")).alias("t"))
    joined = t.where("t.content is not null").join(f, "file_id")
    return joined.select("file_id", *[F.col(f"f.{c}").alias(c) for c in columns], F.col("t.content").alias("content"))
