"""The driver-side fixpoint loop shared by closure, search and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from factlens.session import checkpointed


def grow(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """The least set that holds `start` and every row `step(newest, round)` derives, told apart by `keys`; within `rounds` where given.

    Semi-naive: each round joins only the rows the round before added. Every round's rows are checkpointed, so the
    plan never grows with the number of rounds and a lost executor costs one round.
    """
    seen = checkpointed(start.dropDuplicates(keys))
    newest, n = seen, 0
    while (rounds is None or n < rounds) and not newest.isEmpty():
        n += 1
        newest = checkpointed(step(newest, n).select(seen.columns).dropDuplicates(keys).join(seen.select(keys), keys, "left_anti").select(seen.columns))
        if newest.isEmpty():
            break
        seen = checkpointed(seen.unionByName(newest)) if n % 4 == 0 else seen.unionByName(newest)
    return seen
