"""The sticky trigger over a stream of turns: a place in the conversation, one flag, and the turns that came too early."""

from __future__ import annotations

import contextlib
import json
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from behaviorframe.functions import text as X
from behaviorframe.params import TriggerSpec
from behaviorframe.sources.shared import keep

_OUT = "conv_id long, turn long, hit boolean, sticky boolean"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sticky(StatefulProcessor):
    """Turns of a conversation leave in their order, each with whether the phrase was in it or before.

    State of a conversation: the next turn, whether the phrase was seen, how many turns wait and when it
    is idle; and the turns that came before their predecessors. Each look at the state is a message between
    two processes, so turns that come in order never touch the waiting ones. A conversation that is idle for ``idle_ms`` lets go what
    still waits (its gaps are turns that never came) and leaves the state. A turn that is
    already out and comes again gets the present flag.
    """

    def __init__(self, first: int, idle_ms: int) -> None:
        self.first, self.idle_ms = first, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, seen boolean, held int, due long")
        self.waiting = handle.getMapState("waiting", "turn long", "hits int, misses int")

    def _rows(self, key: tuple, rows: list[tuple[int, bool, bool]]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame({"conv_id": [key[0]] * len(rows), "turn": [r[0] for r in rows], "hit": [r[1] for r in rows], "sticky": [r[2] for r in rows]})

    @staticmethod
    def _let_go(out: list, turn: int, hits: int, misses: int, seen: bool) -> bool:
        seen = seen or hits > 0
        out += [(turn, True, seen)] * hits + [(turn, False, seen)] * misses
        return seen

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, seen, held, due = self.place.get() if self.place.exists() else (self.first, False, 0, -1)
        out: list = []
        came: dict[int, tuple[int, int]] = {}
        for b in rows:
            for turn, hit in zip(b["turn"].tolist(), b["hit"].tolist()):
                if turn < following:
                    out.append((turn, hit, seen or hit))
                    continue
                hits, misses = came.get(turn, (0, 0))
                came[turn] = (hits + hit, misses + (not hit))
        while True:
            hits, misses = came.pop(following, (0, 0))
            if held and self.waiting.containsKey((following,)):
                before = self.waiting.getValue((following,))
                hits, misses, held = hits + before[0], misses + before[1], held - 1
                self.waiting.removeKey((following,))
            if not hits + misses:
                break
            seen = self._let_go(out, following, hits, misses, seen)
            following += 1
        for turn, (hits, misses) in came.items():
            before = self.waiting.getValue((turn,)) if held and self.waiting.containsKey((turn,)) else None
            held += before is None
            self.waiting.updateValue((turn,), (hits + before[0], misses + before[1]) if before else (hits, misses))
        if due >= 0:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(due)
        self.place.update((following, seen, held, due))
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = self.place.get()[1] if self.place.exists() else False
        out: list = []
        for (turn,), (hits, misses) in sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator()):
            seen = self._let_go(out, turn, hits, misses, seen)
        self.waiting.clear()
        self.place.clear()
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state with timers needs, for the queries started meanwhile."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def sticky_turns(turns: DataFrame, spec: TriggerSpec, first: int = 0, idle_ms: int = 600_000) -> DataFrame:
    """(conv_id, turn, hit, sticky) of streamed turns, in whatever order they come. Start it within state_store()."""
    hits = turns.select("conv_id", "turn", X.contains_phrase(F.col("text"), spec.phrase).alias("hit"))
    return hits.groupBy("conv_id").transformWithStateInPandas(Sticky(first, idle_ms), _OUT, "Append", "ProcessingTime")


def _is_file(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()


def _stream(spark: SparkSession, path: str, files_per_batch: int) -> DataFrame:
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if _is_file(spark, path):  # a stream reads folders
        folder, _, file = path.rpartition("/")
        return reader.option("pathGlobFilter", file).parquet(folder)
    return reader.parquet(path)


def state_rows(query: StreamingQuery) -> int:
    """Rows that the query's state holds after its last batch; -1 before the first."""
    progress = query.lastProgress
    return sum(x["numRowsTotal"] for x in progress["stateOperators"]) if progress else -1


def read_batches(query: StreamingQuery) -> int:
    """How many batches of files the query has read and committed."""
    progress = query.lastProgress
    offset = json.loads(progress.json)["sources"][0]["endOffset"] if progress else None
    return offset["logOffset"] + 1 if isinstance(offset, dict) else 0


def start(spark: SparkSession, path: str, spec: TriggerSpec, out: str, files_per_batch: int = 1, first: int = 0, idle_ms: int = 600_000) -> StreamingQuery:
    """The stream of ``path`` (a folder or one file) into Parquet files under ``out``/turns, with its state under ``out``/state; it runs until it is stopped."""
    with state_store(spark):
        turns = sticky_turns(_stream(spark, path, files_per_batch), spec, first, idle_ms)
        writer = turns.writeStream.format("parquet").option("path", f"{out}/turns").outputMode("append").option("checkpointLocation", f"{out}/state")
        return writer.trigger(processingTime="0 seconds").start()


def still_waiting(spark: SparkSession, out: str) -> DataFrame:
    """(conv_id, turn, hit, sticky) of the turns that a stopped stream's state still holds because turns before them never came: judged by what is there."""
    with state_store(spark):
        state = lambda name: spark.read.format("statestore").option("path", f"{out}/state").option("stateVarName", name).load()
        held = state("waiting").select("key.conv_id", F.col("user_map_key.turn").alias("turn"), "user_map_value.hits", "user_map_value.misses")
        place = state("place").select("key.conv_id", "value.seen")
        copies = F.concat(F.array_repeat(F.lit(True), F.col("hits")), F.array_repeat(F.lit(False), F.col("misses")))
        so_far = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, 0)
        every = held.join(place, "conv_id").select("conv_id", "turn", "seen", F.explode(copies).alias("hit"))
        return keep(every.select("conv_id", "turn", "hit", (F.max("hit").over(so_far) | F.col("seen")).alias("sticky")), "waiting")


def run_available(spark: SparkSession, path: str, spec: TriggerSpec, out: str, files_per_batch: int | None = None, first: int = 0, patience_s: float = 300) -> DataFrame:
    """All there is now under ``path``, through the stream, each row once; (conv_id, turn, hit, sticky).

    The query is stopped when it has committed the last file. With timers it would go on for
    ever, and waiting for them would make a replay as slow as life; turns behind a gap are read
    from its state instead. A batch takes a file for each core, unless told otherwise; ``patience_s`` without a
    finished batch ends the wait.
    """
    files_per_batch = files_per_batch or max(1, spark.sparkContext.defaultParallelism)
    files = 1 if _is_file(spark, path) else len(spark.read.parquet(path).inputFiles())
    q = start(spark, path, spec, out, files_per_batch, first)
    done, until = 0, time.time() + patience_s
    try:
        while q.isActive and (now := read_batches(q)) < -(-files // files_per_batch):
            if now > done:
                done, until = now, time.time() + patience_s
            if time.time() > until:
                raise TimeoutError(f"no batch was finished in {patience_s} s, after {done} of {-(-files // files_per_batch)}")
            time.sleep(0.1)
        if q.exception():
            raise q.exception()
    finally:
        q.stop()
    turns = spark.read.schema(_OUT).parquet(f"{out}/turns")
    return turns.unionByName(still_waiting(spark, out)) if files else turns


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """An extension: tumbling counts by event type with a watermark; works on batch and stream tables."""
    kept = events.withWatermark("ts", late) if events.isStreaming else events
    return kept.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
