"""Reports: SARIF, JSON, text rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SARIF levels by severity.
LEVELS = {"error": "error", "warning": "warning", "info": "note"}


def sarif(findings: DataFrame, tool: str = "factlens", root: str = "", properties: dict | None = None) -> str:
    """A SARIF 2.1.0 document: one rule per code with its first message, in the order of the findings, and one result per finding, paths relative to the root.

    `properties` are those of the run (snapshot, scores). The document is a driver-side string by nature; findings are bounded by the rules' own limits.
    """
    prefix = root.replace("\\", "/").rstrip("/")
    first: dict[str, tuple[str, str]] = {}
    results = []
    for r in findings.select("severity", "code", "path", "message").toLocalIterator():
        level, path = LEVELS.get(r["severity"], "note"), r["path"].replace("\\", "/")
        first.setdefault(r["code"], (level, r["message"]))
        inside = path == prefix or path.startswith(prefix + "/")
        uri = (path[len(prefix) :].lstrip("/") if prefix and inside else path) or "."
        place = {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": 1}}}
        results.append({"ruleId": r["code"], "level": level, "message": {"text": r["message"]}, "locations": [place]})
    rules = [{"id": c, "name": c, "shortDescription": {"text": c}, "fullDescription": {"text": m}, "defaultConfiguration": {"level": level}} for c, (level, m) in first.items()]
    run = {"tool": {"driver": {"name": tool, "rules": rules}}, "properties": properties or {}, "results": results}
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [run]})


def health_text(row: dict) -> str:
    """The health row as lines `name: value`, grades last."""
    return "".join(f"{k}: {v}\n" for k, v in sorted(row.items(), key=lambda kv: kv[0].startswith("grade")))


def tsv(df: DataFrame) -> DataFrame:
    """Rows as tab-separated text, nulls empty."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON texts."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
