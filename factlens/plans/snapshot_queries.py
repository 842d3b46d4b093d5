"""Registered queries on full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.operators.snapshot_diff import series_pairs, snapshot_changes
from factlens.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module edges added, removed or changed against the preceding snapshot of the same root."""
    pairs = series_pairs(table(spark, sf_dir, "snapshots"), "root", "snapshot_id", "taken_at")
    edges = table(spark, sf_dir, "module_edges")
    out = snapshot_changes(pairs, edges, "snapshot_id", ["from_module", "to_module"], ["edges"], "ingested_at")
    return out.select(F.col("series").alias("root"), F.col("later").alias("snapshot_id"), "from_module", "to_module", "change")


QUERIES = {"p4_found": p4_found}

ORACLE = {
    "p4_found": """
with once as (
  select root, snapshot_id, max(taken_at) as taken_at from snapshots
  where root is not null and snapshot_id is not null and taken_at is not null group by 1, 2
), pairs as (
  select root, snapshot_id, lag(snapshot_id) over (partition by root order by taken_at, snapshot_id) as earlier from once
), last as (
  select snapshot_id, from_module, to_module, edges from module_edges
  qualify row_number() over (partition by snapshot_id, from_module, to_module order by ingested_at desc nulls last) = 1
), a as (
  select p.root, p.snapshot_id, l.from_module, l.to_module, l.edges from pairs p join last l on l.snapshot_id = p.snapshot_id
  where p.earlier is not null
), b as (
  select p.root, p.snapshot_id, l.from_module, l.to_module, l.edges from pairs p join last l on l.snapshot_id = p.earlier
  where p.earlier is not null
)
select coalesce(a.root, b.root) as root, coalesce(a.snapshot_id, b.snapshot_id) as snapshot_id,
       coalesce(a.from_module, b.from_module) as from_module, coalesce(a.to_module, b.to_module) as to_module,
       case when b.root is null then 'added' when a.root is null then 'removed' else 'changed' end as change
from a full join b on a.root = b.root and a.snapshot_id = b.snapshot_id
  and a.from_module is not distinct from b.from_module and a.to_module is not distinct from b.to_module
where b.root is null or a.root is null or a.edges is distinct from b.edges
"""
}
