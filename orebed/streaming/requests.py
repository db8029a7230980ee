"""Idempotent requests: one log of claims, whose entries are forgotten after a time, as a stream and over a whole table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a row asks for; of rows at one time, in this order.
KINDS = ["begin", "complete", "release"]
OUTCOME = "outcome string, replayed string"

Entry = tuple[str, str, str | None, int]


def step(entry: Entry | None, kind: str, request: str | None, response: str | None, at: int, ttl: int) -> tuple[Entry | None, str, str | None]:
    """(entry, outcome, replayed response) after a row; an entry is (request, status, response, time), times are microseconds.

    An entry that is older than the time to live is forgotten. begin claims a
    free key (started), waits (in_progress), gets the response (completed), or
    asks something else under the same key (conflict). complete and release
    count only for the claim of the same request, else they are lost; a
    completed claim is not released.
    """
    if entry and entry[3] < at - ttl:
        entry = None
    mine = entry is not None and entry[0] == (request or "")
    if kind == "begin":
        if entry is None:
            return (request or "", "in_progress", None, at), "started", None
        return entry, entry[1] if mine else "conflict", entry[2] if mine else None
    if kind == "complete" and mine:
        return (entry[0], "completed", response, at), "stored", None
    if kind == "release" and mine and entry[1] == "in_progress":
        return None, "released", None
    return entry, "lost", None


def _read(kind: str, request: str, response: str, time: str) -> list[Column]:
    """What the step reads: the place of the kind in the order, request, response and time."""
    return [F.array_position(F.lit(KINDS), F.col(kind)).alias("row_kind"), F.col(request).cast("string").alias("row_request"), F.col(response).cast("string").alias("row_response"), F.unix_micros(time).alias("row_at")]


def request_outcomes(events: DataFrame, keys: list[str], kind: str, request: str, response: str, time: str, row: str, ttl_seconds: int) -> DataFrame:
    """(row, outcome, replayed) of every row of a table, in the order of time, kind and row.

    Keys are dealt and sorted by Spark; a task reads its keys one after the
    other and keeps one entry, however many rows a key has. Rows of another
    kind, without a time, or with a null in their key are "invalid".
    """
    rows = events.select(F.col(row).alias("_row"), *[F.col(k).cast("string").alias(f"_k{i}") for i, k in enumerate(keys)], *_read(kind, request, response, time))
    names = [f"_k{i}" for i in range(len(keys))]
    good = F.coalesce((F.col("row_kind") > 0) & F.col("row_at").isNotNull(), F.lit(False))
    for k in names:
        good &= F.col(k).isNotNull()
    width = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at_key, entry = None, None
        for batch in batches:
            out = []
            for x in batch.itertuples(index=False):
                key = x[1 : 1 + width]
                if key != at_key:
                    at_key, entry = key, None
                entry, outcome, replayed = step(entry, KINDS[x[1 + width] - 1], x[2 + width], x[3 + width], x[4 + width], ttl_seconds * 1_000_000)
                out.append((x[0], outcome, replayed))
            yield pd.DataFrame(out, columns=["_row", "outcome", "replayed"])

    schema = f"_row {rows.schema['_row'].dataType.simpleString()}, {OUTCOME}"
    told = rows.where(good).repartition(*names).sortWithinPartitions(*names, "row_at", "row_kind", "_row").mapInPandas(run, schema)
    invalid = rows.where(~good).select("_row", F.lit("invalid").alias("outcome"), F.lit(None).cast("string").alias("replayed"))
    return told.unionByName(invalid).withColumnRenamed("_row", row)


class RequestLog(StatefulProcessor):
    """One claim a key, kept between batches and restarts; a timer clears it when its time to live has passed in event time."""

    def __init__(self, keys: list[str], ttl_seconds: int):
        self.keys, self.ttl = keys, ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "request string, status string, response string, at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        entry = tuple(self.entry.get()) if self.entry.exists() else None
        batch = pd.concat(list(rows)).sort_values(["row_at", "row_kind"], kind="stable")
        out = []
        for kind, request, response, at in zip(*(batch[c].tolist() for c in ("row_kind", "row_request", "row_response", "row_at")), strict=True):
            entry, outcome, replayed = step(entry, KINDS[kind - 1], request, response, at, self.ttl)
            out.append((*key, at, KINDS[kind - 1], outcome, replayed))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update(entry)
            self.handle.registerTimer((entry[3] + self.ttl) // 1000 + 1)
        yield pd.DataFrame(out, columns=[*self.keys, "at", "kind", "outcome", "replayed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def request_stream(events: DataFrame, keys: list[str], kind: str, request: str, response: str, time: str, late: str, ttl_seconds: int) -> DataFrame:
    """(keys…, at, kind, outcome, replayed) of the rows of a stream; at is the time in microseconds.

    Rows later than `late` behind the latest are left out by the watermark.
    The state of a key lives in the state store: it survives a restart from
    the query's checkpoint, and is cleared by its timer, so that the store
    holds no more than the claims of one time to live. Needs the RocksDB state
    store (spark.sql.streaming.stateStore.providerClass).
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    rows = events.withWatermark(time, late).select(*keys, time, *_read(kind, request, response, time)).where("row_kind > 0")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "at long, kind string", OUTCOME])
    return rows.groupBy(*keys).transformWithStateInPandas(RequestLog(keys, ttl_seconds), schema, "Append", "EventTime")
