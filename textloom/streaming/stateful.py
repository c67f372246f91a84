"""Structured Streaming forms of the corpus operators."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.dedup import minhash
from ..operators.hashing import content_hash
from ..session import shared_dir


def drain(stream: DataFrame, name: str, mode: str = "append", trigger: dict | None = None) -> DataFrame:
    """Run a stream over what is there now into parquet in the shared folder, and read that."""
    folder = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .option("path", f"{folder}/rows").trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_all(stream: DataFrame, name: str) -> DataFrame:
    """As ``drain``, for sources that cannot tell in advance what is available."""
    folder = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/rows").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_complete(stream: DataFrame, name: str) -> DataFrame:
    """Final state of an aggregation that has no watermark; each micro-batch overwrites the last."""
    folder = f"{shared_dir(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"

    def write(frame: DataFrame, _: int) -> None:
        frame.write.mode("overwrite").parquet(f"{folder}/rows")

    query = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def exact_dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """First delivery of every distinct text.  State is one hash a distinct text."""
    return stream.where(F.col(text).isNotNull()).withColumn("content_hash", content_hash(text)).dropDuplicates(["content_hash"])


def exact_dedup_within(stream: DataFrame, time_column: str, delay: str, text: str = "text") -> DataFrame:
    """As ``exact_dedup``, with state given up ``delay`` after the event time."""
    marked = stream.where(F.col(text).isNotNull()).withColumn("content_hash", content_hash(text))
    return marked.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(["content_hash"])


def running_counters(stream: DataFrame, by: str, text: str = "text") -> DataFrame:
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length(text)).alias("n_tokens"))


def windowed_counts(stream: DataFrame, time_column: str, width: str, by: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts under a watermark."""
    at = F.window(time_column, width, slide) if slide else F.window(time_column, width)
    return stream.withWatermark(time_column, late).groupBy(at.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n"
    )


class NearWindow(StatefulProcessor):
    """Keeps the last ``window`` kept signatures of a group and drops rows near one of them."""

    def __init__(self, need: int, window: int):
        self.need, self.window = need, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "sig array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        # rows of a matrix twice the window, the kept ones at its end
        old = [x[0] for x in self.kept.get()]
        first = np.array(old, dtype=np.int64) if old else None
        ring, n, out = None, 0, []
        for batch in rows:
            for ident, sig in sorted(zip(batch["doc_id"], batch["sig"]), key=lambda x: x[0]):
                sig = np.asarray(sig, dtype=np.int64)
                if ring is None:
                    ring = np.zeros((2 * self.window + 1, len(sig)), dtype=np.int64)
                    if first is not None:
                        ring[: len(first)] = first
                        n = len(first)
                near = bool(n and ((ring[max(0, n - self.window): n] == sig).sum(axis=1) >= self.need).any())
                out.append((ident, "near_duplicate" if near else "unique"))
                if not near:
                    if n == len(ring):
                        ring[: self.window] = ring[n - self.window: n]
                        n = self.window
                    ring[n] = sig
                    n += 1
        if ring is not None and n:
            self.kept.put([(r.tolist(),) for r in ring[max(0, n - self.window): n]])
        yield pd.DataFrame(out, columns=["doc_id", "reason"])

    def close(self) -> None:
        pass


def near_dedup_window(stream: DataFrame, by: str, permutations: int = 64, threshold: float = 0.8, window: int = 500, id_type: str = "bigint") -> DataFrame:
    """Greedy near-dedup against the last ``window`` kept texts of each ``by`` group.

    The history is bounded, so a hot group costs time in its own task but no memory.
    """
    import math

    signed = stream.where(F.col("text").isNotNull()).select(by, "doc_id", minhash("text", permutations).alias("sig"))
    return signed.groupBy(by).transformWithStateInPandas(
        statefulProcessor=NearWindow(math.ceil(threshold * permutations - 1e-9), window),
        outputStructType=f"doc_id {id_type}, reason string", outputMode="Append", timeMode="None",
    )


def packed_stream(stream: DataFrame, pack_batch: Callable[[DataFrame, int], int], checkpoint: str):
    """Pack every micro-batch after the tokens already placed; the carried offset is kept beside the checkpoint.

    ``pack_batch(frame, offset)`` writes rows for one batch and gives the next offset.
    """
    spark: SparkSession = stream.sparkSession

    def one(frame: DataFrame, batch_id: int) -> None:
        done = f"{checkpoint}/offsets"
        try:
            last = spark.read.parquet(done).where(F.col("batch_id") < batch_id).orderBy(F.desc("batch_id")).first()
        except Exception as e:  # no batch has ended yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        end = pack_batch(frame, last["offset"] if last else 0)
        spark.createDataFrame([(batch_id, end, time.time())], "batch_id bigint, offset bigint, at double").coalesce(1).write.mode("append").parquet(done)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{checkpoint}/state").trigger(availableNow=True).start()
