"""The fact relations of a scan, as DataFrames with fixed schemas."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "files": "file_id long, path string, language string, module string, lines long, bytes long, content_hash string, comment_lines long",
    "functions": "function_id long, file_id long, name string, start_line long, end_line long, visibility string, body string",
    "entry_points": "entry_id long, file_id long, kind string, symbol string",
    "imports": "import_id long, from_file long, target string, kind string, resolution string, resolved_file long, alias string",
    "calls": "call_id long, file_id long, caller_function long, target string, line long",
    "call_edges": "edge_id long, call_id long, caller_function long, callee_function long",
    "types": "type_id long, file_id long, name string, is_abstract boolean, line long, visibility string, bases array<string>",
    "trait_impls": "impl_id long, file_id long, type_name string, trait_name string, line long",
    "commits": "commit_id string, author string, ts long, subject string",
    "commit_files": "commit_id string, path string",
}


@dataclass
class Facts:
    """A bundle of fact relations; ids are keys, never positions."""

    files: DataFrame
    functions: DataFrame
    entry_points: DataFrame
    imports: DataFrame
    calls: DataFrame
    call_edges: DataFrame
    types: DataFrame
    trait_impls: DataFrame
    commits: DataFrame
    commit_files: DataFrame

    def replaced(self, **tables: DataFrame) -> Facts:
        """The bundle with some relations replaced."""
        return Facts(**{f.name: tables.get(f.name, getattr(self, f.name)) for f in fields(self)})


def of(spark: SparkSession, **rows: list | DataFrame) -> Facts:
    """A bundle from rows or DataFrames by relation; the others are empty."""
    return Facts(**{n: rows[n] if isinstance(rows.get(n), DataFrame) else spark.createDataFrame(rows.get(n, []), s) for n, s in SCHEMAS.items()})
