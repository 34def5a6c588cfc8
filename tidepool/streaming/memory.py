"""Conversation memory as streaming state: of each conversation the latest turns that fit a token limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidepool.functions.text import words

_TURN = "turn long, role string, text string, tokens long"


class TurnMemory(StatefulProcessor):
    """Holds turns in a list bounded by their tokens, and the number of the last turn that fell out.

    A turn falls out once it and those behind it have more tokens than the limit.
    No later turn can bring it back, and one that arrives late and stands before it
    falls out with it, so what is held doesn't depend on the order of arrival.
    """

    def __init__(self, limit: int, ttl_ms: int | None):
        self.limit, self.ttl = limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", _TURN, self.ttl)
        self.fallen = handle.getValueState("fallen", "turn long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        fallen = self.fallen.get()[0] if self.fallen.exists() else None
        turns = [tuple(t) for t in self.held.get()]
        for b in rows:
            turns += [(int(t), r, x, int(n)) for t, r, x, n in zip(b["turn"], b["role"], b["text"], b["tokens"], strict=True)]
        total, kept = 0, []
        for turn in sorted(turns, key=lambda t: t[0], reverse=True):
            total += turn[3]
            if total > self.limit or (fallen is not None and turn[0] <= fallen):
                fallen = turn[0] if fallen is None else max(fallen, turn[0])
                break
            kept.append((*turn, total))
        self.held.put([t[:4] for t in kept]) if kept else self.held.clear()
        if fallen is not None:
            self.fallen.update((fallen,))
        # a conversation that holds nothing any more says so by a row without a turn
        out = pd.DataFrame(kept or [(None,) * 5], columns=["turn", "role", "text", "tokens", "held"], dtype=object)
        out.insert(0, "conv_id", key[0])
        yield out

    def close(self) -> None:
        pass


def remember(turns: DataFrame, limit: int = 800, ttl_ms: int | None = None) -> DataFrame:
    """conv_id, turn, role, text, tokens, held: after each micro-batch, all turns held of the conversations in it, or a row without a turn.

    turns: a stream of conv_id, turn, role, text. A conversation that is silent for
    ``ttl_ms`` is forgotten. The session's state store must be RocksDB.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    sized = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", F.size(words(F.col("text"))).cast("long").alias("tokens"))
    return sized.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=TurnMemory(limit, ttl_ms),
        outputStructType=f"conv_id {kind}, turn long, role string, text string, tokens long, held long",
        outputMode="Update",
        timeMode="None" if ttl_ms is None else "ProcessingTime",
    )


def remember_into(turns: DataFrame, folder: str, limit: int = 800, ttl_ms: int | None = None):
    """Runs over what has arrived and writes each batch's turns to folder; started again, it goes on from its checkpoint there."""
    conf, provider = turns.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    was = conf.get(provider)
    conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            remember(turns, limit, ttl_ms)
            .writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/turns/batch={n}"))
            .outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(provider, was)
    query.awaitTermination()
    return query


def remembered(spark, folder: str) -> DataFrame:
    """conv_id, turn, role, text, tokens, held as of each conversation's last batch."""
    rows = spark.read.parquet(f"{folder}/turns")
    last = rows.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["conv_id", "batch"]).where("turn is not null").drop("batch")
