"""Registered queries of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import handwritten, knn, leakage, parsing, quality, quantiles, tokenize, topn
from factlens.llm.sources import current_sources
from factlens.session import table


def checked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file_id, path, repo, language_name, language, valid) of every current file with a text."""
    return parsing.checked(current_sources(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_texts"), ["path", "repo", "language_name"]))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose current text does not parse."""
    return checked_files(spark, sf_dir).where("not valid").select("file_id")


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of such files per repository and language."""
    return parsing.rates(checked_files(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a re-parameterised item: its template with other names, values and units, consistently renamed."""
    found = leakage.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"), renamed=True)
    return found.where("kind = 'renamed'").select("doc_id", "item_id", F.col("words").alias("slots")).distinct()


def p9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text statistics and the learned type of every document."""
    return quality.quality(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are for the most part no natural prose."""
    return p9_quality(spark, sf_dir).where("kind = 'no prose'").select("doc_id")


#: Rank error of the percentiles, as a share of a group's values.
EPS = 0.005


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, day, lines), one row per file: of its rows the one with the latest scanned_at counts."""
    files = table(spark, sf_dir, "files").where("file_id is not null")
    last = files.groupBy("file_id").agg(F.max(F.struct("scanned_at", "lines", "module")).alias("f"))
    return last.select("f.module", F.to_date("f.scanned_at").alias("day"), "f.lines")


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of lines per module, merged from one digest per module and scan day."""
    days = quantiles.digests(latest_lines(spark, sf_dir), ["module", "day"], "lines", EPS)
    whole = quantiles.merged(days, ["module"], EPS)
    return quantiles.percentiles(whole, ["module"], SHARES, EPS)


def p2_day_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest rows of each module and scan day, which later runs can merge."""
    return quantiles.digests(latest_lines(spark, sf_dir), ["module", "day"], "lines", EPS)


SHARES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def p2_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(known, name, n, enough, close) of percentiles over two large groups, whose digests are compressed: whether the promise of `percentiles` holds.

    `enough`: at least ceil(share * n) values are no greater. `close`: of the values below the code of the result at most
    rank_error lie beyond that rank.
    """
    rows = table(spark, sf_dir, "trend_hotspots").where("risk_score >= 0").select(F.col("snapshot_id").isNotNull().alias("known"), "risk_score")
    found = quantiles.percentiles(quantiles.digests(rows, ["known"], "risk_score", EPS), ["known"], SHARES, EPS)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(v).alias("share"), F.col(k).alias("value")) for k, v in SHARES.items()])).alias("e")
    asked = found.select("known", "n", "rank_error", each).select("known", "n", "rank_error", "e.*")
    shift = F.greatest(F.length(F.bin("value")) - (quantiles.BITS + 1), F.lit(0))
    asked = asked.withColumn("low", F.call_function("shiftleft", F.call_function("shiftright", F.col("value"), shift), shift))
    # Two groups with five percentiles each.
    both = rows.join(F.broadcast(asked), "known").groupBy("known", "name", "share", "n", "rank_error").agg(F.count_if(F.col("risk_score") <= F.col("value")).alias("up"), F.count_if(F.col("risk_score") < F.col("low")).alias("below"))
    wanted = F.ceil(F.col("share") * F.col("n"))
    return both.select("known", "name", "n", (F.col("up") >= wanted).alias("enough"), (F.col("below") < wanted + F.col("rank_error")).alias("close"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that were not written by hand for their repository."""
    sources = current_sources(table(spark, sf_dir, "files"), table(spark, sf_dir, "file_texts"), ["path", "repo"])
    return handwritten.not_handwritten(sources, table(spark, sf_dir, "scan_config")).select("file_id")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


#: Calibrated share of the true neighbours.
RECALL = 0.999


def nearest_files(spark: SparkSession, sf_dir: str, recall: float) -> DataFrame:
    """Pairs of files of which one is among the five nearest of the other."""
    wide = table(spark, sf_dir, "file_embeddings")
    pairs = knn.neighbour_pairs(knn.neighbours(knn.pack(wide, "file_id", [f"e{i}" for i in range(64)]), k=5, recall=recall))
    return pairs.select(F.col("a").alias("file_id_a"), F.col("b").alias("file_id_b"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest files at calibrated recall: linear in the files."""
    return nearest_files(spark, sf_dir, RECALL)


def p3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest files by the exact bounds of the tree."""
    return nearest_files(spark, sf_dir, 1.0)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten riskiest paths of every snapshot."""
    samples = table(spark, sf_dir, "trend_hotspots").where("snapshot_id is not null and risk_score is not null")
    best = topn.best_rows(samples, "snapshot_id", "path", ["risk_score", "commits"])
    order = [F.col("risk_score").desc(), F.col("commits").desc_nulls_last(), F.col("path").asc_nulls_last()]
    return topn.top_n(best, "snapshot_id", order, 10).select("snapshot_id", "path")


QUERIES = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p2_percentiles": p2_percentiles, "p2_day_digests": p2_day_digests, "p2_bound": p2_bound, "p3_found": p3_found, "p3_exact": p3_exact, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_renamed": p8_renamed, "p9_found": p9_found, "p9_quality": p9_quality}

ORACLE = {
    "p3_found": """
with v as (
  select file_id, [%s]::double[] as v from file_embeddings
), u as (
  select file_id, max(v) as v from v
  where file_id is not null and len(list_filter(v, lambda x: x is not null and isfinite(x))) = 64 and len(list_filter(v, lambda x: x <> 0)) > 0
  group by file_id
), n as (
  select a.file_id as a, b.file_id as b, row_number() over (
    partition by a.file_id order by round(list_cosine_similarity(a.v, b.v), 6) desc, b.file_id) as n
  from u a join u b on a.file_id <> b.file_id
)
select distinct least(a, b) as file_id_a, greatest(a, b) as file_id_b from n where n <= 5
"""
    % ", ".join(f"e{i}" for i in range(64)),
    "p5_found": """
select snapshot_id, path from (
  select snapshot_id, path, row_number() over (partition by snapshot_id order by risk_score desc, commits desc nulls last, path nulls last) as n
  from (
    select snapshot_id, path, risk_score, commits from trend_hotspots where snapshot_id is not null and risk_score is not null
    qualify row_number() over (partition by snapshot_id, path order by risk_score desc, commits desc nulls last) = 1
  )
) where n <= 10
""",
}
ORACLE["p3_exact"] = ORACLE["p3_found"]
ORACLE["p2_bound"] = "select snapshot_id is not null as known, name, count(*) as n, true as enough, true as close from trend_hotspots, (values ('p25'), ('p50'), ('p75'), ('p90'), ('p99')) s(name) where risk_score >= 0 group by 1, 2"
