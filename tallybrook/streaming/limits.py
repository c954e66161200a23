"""Streaming forms of the overload rules, re-batching and replay."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(stream: DataFrame, key: str, ts: str, priority: str, limit: int, floor: int, window_ns: int = 10**9) -> DataFrame:
    """(key, ts, priority, decision) for each batch of a stream.

    A window starts with the first batch that comes ``window_ns`` or more after the last start. Its first ``limit`` batches are
    accepted, later ones bypass from priority ``floor`` on (they use no quota) or are rejected. State is two numbers per key.
    """

    def decide(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        out = []
        for t, p in zip(rows["ts"], rows["priority"], strict=True):
            if start is None or t - start >= window_ns:
                start, used = int(t), 0
            if limit == 0 or used < limit:
                used, decision = used + 1, "accepted"
            else:
                decision = "bypass" if p >= floor else "rejected"
            out.append((k[0], t, p, decision))
        state.update((start, used))
        yield pd.DataFrame(out, columns=["key", "ts", "priority", "decision"])

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("long").alias("ts"), F.col(priority).cast("int").alias("priority"))
    return rows.groupBy("key").applyInPandasWithState(decide, "key string, ts long, priority int, decision string", "start long, used int", "append", GroupStateTimeout.NoTimeout)


def ring(stream: DataFrame, key: str, seq: str, keep_first: int, keep_last: int) -> DataFrame:
    """After each trigger, what each key's ring buffer holds: its first ``keep_first`` numbers, and the newest of the others."""

    def hold(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        head, tail = map(list, state.get) if state.exists else ([], [])
        for s in sorted(int(x) for b in batches for x in b["seq"]):
            if len(head) < keep_first:
                head.append(s)
            else:
                tail = [*tail, s][-keep_last:] if keep_last else []
        state.update((head, tail))
        yield pd.DataFrame({"key": k[0], "held": [head + tail]})

    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"))
    return rows.groupBy("key").applyInPandasWithState(hold, "key string, held array<long>", "head array<long>, tail array<long>", "update", GroupStateTimeout.NoTimeout)


def fan_out(*sinks: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that gives every micro-batch to every sink; one failure fails the batch, which is then replayed."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for sink in sinks:
                sink(batch, number)
        finally:
            batch.unpersist()

    return run


def rebatched(batch: DataFrame, resource: str, scope: str, position: str, size: int = 50) -> DataFrame:
    """A micro-batch as export batches: runs of ``size`` records per resource and scope, in order."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(resource, scope).orderBy(position)) - 1
    rows = batch.withColumn("part", F.floor(n / size).cast("long"))
    return rows.groupBy(resource, scope, "part").agg(F.min(position).alias("first_pos"), F.array_sort(F.collect_list(position)).alias("members"))
