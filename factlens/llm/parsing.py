"""Source files that do not parse in the language of their extension.

The parser is in `syntax`: generalised LL with a graph-structured stack, the start rules of a language's dialects tried on
one shared store of parsed structures. A file is flagged when every dialect rejects it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlens.llm.sources import extension
from factlens.llm.syntax.languages import LANGUAGE_OF, parses


def checked(sources: DataFrame) -> DataFrame:
    """`sources` without content, plus `language` (of the extension) and `valid`.

    `sources` has path and content. A path without an extension of a supported language gives null in both; an empty text
    and one of comments only are valid; a null text gives null. Texts of any length are parsed whole.
    """
    kept = [c for c in sources.columns if c != "content"]

    def op(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ends = b.column("content"), b.column("_ext")
            valid = [None if t is None or e is None else parses(t, e) for t, e in zip((x.as_py() for x in texts), ends.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in kept], pa.array([LANGUAGE_OF.get(e) for e in ends.to_pylist()], pa.string()), pa.array(valid, pa.bool_())],
                names=[*kept, "language", "valid"],
            )

    kinds = dict(sources.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", language string, valid boolean"
    return sources.select(*kept, "content", extension("path").alias("_ext")).mapInArrow(op, schema)


#: Other spellings of language names, in lower case.
SPELLINGS = {"c++": "cpp", "cxx": "cpp", "c#": "csharp", "py": "python", "python3": "python", "rb": "ruby", "rs": "rust", "js": "typescript", "javascript": "typescript", "ts": "typescript", "jsx": "typescript", "tsx": "typescript", "kt": "kotlin", "rfl": "rayfall"}


def language_name(name: str) -> Column:
    """One spelling of a language name: lower case, without outer blanks, short forms written out; null if it is null, blank or `unknown`."""
    plain = F.lower(F.trim(F.col(name)))
    known = F.create_map(*[F.lit(x) for kv in SPELLINGS.items() for x in kv])
    return F.when(~plain.isin("", "unknown"), F.coalesce(known[plain], plain))


def rates(flags: DataFrame) -> DataFrame:
    """(repo, language_name, files, broken, rate) over the files of a supported language; null repos are a group.

    The name is that of the column `language_name` in one spelling where `flags` has it and it is known, else the language of the extension.
    """
    name = F.coalesce(language_name("language_name"), "language") if "language_name" in flags.columns else F.col("language")
    return (
        flags.where("valid is not null")
        .groupBy("repo", name.alias("language_name"))
        .agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("broken"))
        .withColumn("rate", F.col("broken") / F.col("files"))
    )
