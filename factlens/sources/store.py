"""The table store: a folder of Parquet tables with a meta row, trend tables that grow, and a manifest."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the saved schemas.
SCHEMA_VERSION = 8
TREND_TABLES = ("trend_health", "trend_hotspots", "trend_violations")


class StoreError(ValueError):
    """A bad table name, a missing table or another schema version."""


def check_name(name: str) -> str:
    """A table name, if it is one."""
    if not name or name.startswith(".") or re.search(r"[/\\]|\.\.", name):
        raise StoreError(f"bad table name {name!r}")
    return name


def column_digest(tables: dict[str, list[str]]) -> str:
    """SHA-256 over `table:col,col,;` in table order, meta left out."""
    text = "".join(f"{t}:{''.join(c + ',' for c in cols)};" for t, cols in sorted(tables.items()) if t != "meta")
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Store:
    """A folder of tables, on any file system Spark reaches."""

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm

    def names(self) -> list[str]:
        """Tables, sorted."""
        fs, root, _ = self._fs()
        if not fs.exists(root):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and not s.getPath().getName().startswith((".", "_")))

    def read(self, name: str) -> DataFrame:
        """A table, after a check of the schema version (`meta` is always readable)."""
        if check_name(name) not in self.names():
            raise StoreError(f"no table {name}")
        if name != "meta":
            self.verify()
        return self.spark.read.parquet(f"{self.path}/{name}")

    def owned(self, name: str) -> DataFrame:
        """A table that can be overwritten while it is read: cut from its files by a checkpoint."""
        from factlens.session import checkpointed

        return checkpointed(self.read(name))

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces a table: written aside first, the old one is set aside before the new one takes its place, and put back if that fails."""
        fs, _, jvm = self._fs()
        aside = f"{self.path}/.{check_name(name)}-{uuid.uuid4().hex}"
        df.write.parquet(aside)
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        old = jvm.org.apache.hadoop.fs.Path(f"{self.path}/.old-{name}-{uuid.uuid4().hex}")
        had = fs.exists(place) and fs.rename(place, old)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(aside), place):
            if had:
                fs.rename(old, place)
            raise StoreError(f"{name} could not be put in place")
        if had:
            fs.delete(old, True)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table, which it creates."""
        df.write.mode("append").parquet(f"{self.path}/{check_name(name)}")

    def import_csv(self, name: str, csv: str, schema: str | None = None) -> DataFrame:
        """A CSV file with a header as a table; types are inferred unless given."""
        reader = self.spark.read.option("header", True)
        self.write(name, (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(csv))
        return self.read(name)

    def summary(self) -> DataFrame:
        """(table, rows, columns) of every table."""
        rows = []
        for n in self.names():
            df = self.spark.read.parquet(f"{self.path}/{n}")
            rows.append((n, df.count(), len(df.columns)))
        return self.spark.createDataFrame(rows, "table string, rows long, columns int")

    def verify(self) -> None:
        """Raises unless the meta table is absent or names this schema version."""
        if "meta" not in self.names():
            return
        row = self.spark.read.parquet(f"{self.path}/meta").select("schema_version").first()
        if row is None or row[0] != SCHEMA_VERSION:
            raise StoreError(f"schema version {None if row is None else row[0]}, {SCHEMA_VERSION} wanted")

    def save(self, tables: dict[str, DataFrame], snapshot_id: str, scan_unix: int, repo_sha: str = "", manifest: dict | None = None, trend: dict[str, DataFrame] | None = None) -> None:
        """A baseline: trend rows are appended first, then the tables written, then meta, then the manifest; other tables stay."""
        for n, df in (trend or {}).items():
            self.append(n, df)
        for n, df in tables.items():
            self.write(n, df)
        digest = column_digest({n: df.columns for n, df in tables.items()})
        meta = self.spark.createDataFrame([(SCHEMA_VERSION, repo_sha, snapshot_id, scan_unix, digest)], "schema_version long, repo_sha string, snapshot_id string, scan_unix long, column_digest string")
        self.write("meta", meta)
        if manifest is not None:
            fs, _, jvm = self._fs()
            out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest.json"), True)
            out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
            out.close()

    def manifest(self) -> dict:
        """The manifest of the last save."""
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.path}/manifest.json", wholetext=True).collect()))

    def trend(self) -> DataFrame:
        """One row per health sample with its hotspots and rule counts as arrays; missing trend tables count as empty."""
        have = set(self.names())
        if "trend_health" not in have:
            raise StoreError("no table trend_health")
        out = self.read("trend_health")
        for name, alias in (("trend_hotspots", "hotspots"), ("trend_violations", "violations")):
            if name in have:
                t = self.read(name)
                out = out.join(t.groupBy("snapshot_id").agg(F.collect_list(F.struct(*[c for c in t.columns if c not in ("snapshot_id", "timestamp")])).alias(alias)), "snapshot_id", "left")
        return out


def saved(facts_table: str, df: DataFrame) -> DataFrame:
    """A fact relation as it is saved: sentinels for nulls, booleans as numbers, no bodies."""
    if facts_table == "imports":
        return df.withColumn("resolved_file", F.coalesce("resolved_file", F.lit(-1).cast("long"))).withColumn("alias", F.coalesce("alias", F.lit("")))
    if facts_table == "calls":
        return df.withColumn("caller_function", F.coalesce("caller_function", F.lit(-1).cast("long")))
    if facts_table == "types":
        return df.withColumn("is_abstract", F.col("is_abstract").cast("long")).drop("bases")
    if facts_table == "functions":
        return df.drop("body")
    return df.drop("comment_lines") if facts_table == "files" else df


def inheritance(types: DataFrame) -> DataFrame:
    """(type_id, name, base) per base of a type."""
    return types.select("type_id", "name", F.explode("bases").alias("base"))
