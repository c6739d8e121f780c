"""An outcome ledger kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..session import ship_package


def first_outcomes(stream: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a stream whose key has not come in an earlier batch; of several in one batch, the one of least ``order`` (nulls last).

    A key's state is one flag in the state store, so a batch costs what its own keys cost. The store keeps each key for good: a duplicate is one however late it comes.
    """
    ship_package(stream.sparkSession)
    columns = stream.columns

    def first(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: pd.DataFrame | None = None
        for part in parts:
            if not state.exists and len(part):
                least = part.sort_values(order, kind="stable", na_position="last").head(1)
                ahead = best is None or pd.isna(best[order].iloc[0]) and not pd.isna(least[order].iloc[0]) or best[order].iloc[0] > least[order].iloc[0]
                best = least if ahead else best
        if best is not None:
            state.update((True,))
            yield best[columns]

    return stream.groupBy(key).applyInPandasWithState(first, StructType(stream.schema.fields), "seen boolean", "append", GroupStateTimeout.NoTimeout)


def outcome_ledger(stream: DataFrame, path: str, checkpoint: str, key: str, order: str, available_now: bool = True) -> StreamingQuery:
    """Append each key's first outcome to a Parquet ledger. The checkpoint holds the keys that have come and the sink's log what is committed, so a batch that is run
    again after a failure adds nothing. The ledger itself is never read."""
    writer = first_outcomes(stream, key, order).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
