"""Streaming forms: monthly citation shares with late data, orphan counts folded from a stream of deltas, per-trace reuse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexweave.operators.orphans import Ledger


def windowed_shares(events: DataFrame, at: str, kind: str, late: str = "7 days", size: str = "30 days") -> DataFrame:
    """(window, kind, n): counts per event-time window and kind; rows later than ``late`` are dropped and their state freed."""
    return events.withWatermark(at, late).groupBy(F.window(at, size).alias("window"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def maintain_orphans(changes: DataFrame, ledger: Ledger, checkpoint: str) -> StreamingQuery:
    """Folds a stream of changes into ``ledger``, batch by batch.

    ``changes`` has (tbl, rec_id, ref_key, at, sign, status): rows with a ``tbl`` hold (sign > 0) or retract a reference, the
    others are deliveries of the record ``ref_key``. A batch that is run again after a failure counts once.
    """

    def fold(batch: DataFrame, number: int) -> None:
        refs = batch.where("tbl is not null").select("tbl", "rec_id", "ref_key", F.col("at").alias("ref_at"), "sign")
        ledger.apply(refs, batch.where("tbl is null").select("ref_key", "at", "status"), number)

    return changes.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).start()


def stateful_reuse(requests: DataFrame) -> DataFrame:
    """(trace, tokens, reused) from a stream of (trace, key, size): the keys a trace has seen are its state."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, reused, seen = state.get if state.exists else (0, 0, [])
        known = set(seen)
        for b in batches:
            for k, s in zip(b["key"], b["size"]):
                tokens += int(s)
                if k in known:
                    reused += int(s)
                known.add(k)
        state.update((tokens, reused, sorted(known)))
        yield pd.DataFrame({"trace": [key[0]], "tokens": [tokens], "reused": [reused]})

    return requests.groupBy("trace").applyInPandasWithState(
        step, "trace string, tokens long, reused long", "tokens long, reused long, seen array<string>", "update", GroupStateTimeout.NoTimeout
    )
