"""Snapshots of declared tools that arrive in parts, kept in state until they are whole.

A capture names its snapshot and how many tools it has. Its rows may come in several micro-batches, late or more than once; state
is kept for each (target, snapshot) and holds hashes only. A timer in event time ends what never becomes whole, and forgets
what did, so state is bounded by the snapshots of the last ``wait``.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from toolsentry.operators.drift import drift

#: What a stream of captures has to have; a capture without tools is one row whose ``tool`` is null.
CAPTURES = "target STRING, snapshot STRING, n_tools BIGINT, tool STRING, def_hash STRING, captured_at TIMESTAMP"
#: ``whole``: one row for each tool and one without a tool; ``expired``: one row, with how many tools came.
WHOLE = "target STRING, snapshot STRING, status STRING, tool STRING, def_hash STRING, n_tools BIGINT, seen BIGINT"


class WholeSnapshots(StatefulProcessor):
    """Collects the tools of a snapshot; gives them out once, when all are there."""

    def __init__(self, wait: timedelta) -> None:
        self.wait_ms = int(wait.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tools = handle.getMapState("tools", "tool STRING", "def_hash STRING")
        self.head = handle.getValueState("head", "n_tools BIGINT, seen BIGINT, given BOOLEAN")

    def _rows(self, key: tuple, status: str, tools: list[tuple[str | None, str | None]], n_tools: int, seen: int) -> Iterator[Row]:
        for tool, def_hash in tools:
            yield Row(target=key[0], snapshot=key[1], status=status, tool=tool, def_hash=def_hash, n_tools=n_tools, seen=seen)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.head.get() if self.head.exists() else None
        n_tools, seen, given = known or (0, 0, False)
        latest = 0
        for row in rows:
            if row.captured_at is not None:
                latest = max(latest, int(row.captured_at.timestamp() * 1000))
            n_tools = max(n_tools, row.n_tools or 0)
            if given or row.tool is None:
                continue
            own = (row.tool,)
            if not self.tools.containsKey(own):
                seen += 1
                self.tools.updateValue(own, (row.def_hash or "",))
            elif self.tools.getValue(own)[0] < (row.def_hash or ""):
                # of two definitions in one capture the larger hash counts, in whatever order they come
                self.tools.updateValue(own, (row.def_hash,))
        if known is None:
            self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
        if not given and seen >= n_tools:
            found = [(k[0], v[0]) for k, v in self.tools.iterator()]
            yield from self._rows(key, "whole", [(None, None), *found], n_tools, seen)
            # rows that are repeated later find that the snapshot was given out
            self.tools.clear()
            given = True
        self.head.update((n_tools, seen, given))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n_tools, seen, given = self.head.get()
        self.tools.clear()
        self.head.clear()
        if not given:
            yield from self._rows(key, "expired", [(None, None)], n_tools, seen)

    def close(self) -> None:
        pass


def whole_snapshots(captures: DataFrame, wait: timedelta = timedelta(hours=1)) -> DataFrame:
    """Streams the tools of each snapshot once it is whole, and a row for each that did not become whole in time.

    ``captures`` has the columns of ``CAPTURES``. ``wait`` is how far captures may be out of order, and how long state is kept.
    Rows without a target or snapshot belong to none and are left out.
    """
    keyed = captures.filter("target is not null and snapshot is not null").withWatermark("captured_at", f"{int(wait.total_seconds())} seconds")
    return keyed.groupBy("target", "snapshot").transformWithState(
        statefulProcessor=WholeSnapshots(wait), outputStructType=WHOLE, outputMode="Append", timeMode="EventTime")


def snapshot_changes(whole: DataFrame, baselines: DataFrame) -> DataFrame:
    """``(target, snapshot, tool, change, old_hash, new_hash)`` of whole snapshots against one baseline, REMOVED included."""
    # a snapshot is a target of its own in the comparison; its name can hold any character, so the key is a JSON list
    key = F.to_json(F.array("target", "snapshot")).alias("target")
    heads = whole.filter((F.col("status") == "whole") & F.col("tool").isNull()).select("target", "snapshot")
    tools = whole.filter((F.col("status") == "whole") & F.col("tool").isNotNull()).select(key, "tool", "def_hash")
    asked = heads.join(baselines.select("target", "tool", "def_hash"), "target").select(key, "tool", "def_hash")
    names = F.from_json("target", "array<string>")
    return drift(tools, asked).select(
        names[0].alias("target"), names[1].alias("snapshot"), "tool", "change", "old_hash", "new_hash")


def snapshot_drift(captures: DataFrame, baselines: DataFrame, path: str, checkpoint: str, wait: timedelta = timedelta(hours=1)) -> StreamingQuery:
    """Write the drift of each whole snapshot below ``{path}/drift`` and the snapshots that never became whole below ``{path}/expired``.

    ``baselines`` is one snapshot, as ``read_baseline`` gives it. A micro-batch compares the snapshots that became whole in
    it and reads no earlier batch; a batch that is run again after a failure replaces its own output. A capture that was cut in two
    never shows tools as REMOVED, and one without tools shows all of them.
    """

    def compare(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        snapshot_changes(batch, baselines).write.mode("overwrite").parquet(f"{path}/drift/batch={batch_id}")
        expired = batch.filter("status = 'expired'").select("target", "snapshot", "n_tools", "seen")
        expired.write.mode("overwrite").parquet(f"{path}/expired/batch={batch_id}")
        batch.unpersist()

    return (
        whole_snapshots(captures, wait).writeStream.foreachBatch(compare)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
