"""Append-only event processing with Structured Streaming. Each function drains what is available and
returns a batch view of its sink. Checkpoint and sink live below ``place``, a folder named by the caller: a
rerun with the same one goes on where the last stopped. Without a name each call starts anew."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..sources.files import shared_folder

STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which state variables need."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STORE, before)


def commit(batch: DataFrame, path: str) -> None:
    """Write a batch to a folder of its own. One that has been committed stays as it is; the batch still runs, as
    its state must be written again."""
    at = batch.sparkSession._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if at.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).exists(at):
        batch.write.format("noop").mode("overwrite").save()
    else:
        batch.write.mode("overwrite").parquet(path)


def source(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table's files as a stream; NTZ timestamps become timestamps, as watermarks need."""
    path = f"{d}/{name}.parquet"
    batch = spark.read.parquet(path)
    # a pattern, as a table may be one file or a folder of files
    rows = spark.readStream.schema(batch.schema).parquet(f"{d}/{name}.parq*et")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in batch.dtypes if t == "timestamp_ntz"})


def _place(rows: DataFrame, place: str | None) -> str:
    return place or shared_folder(rows.sparkSession, "stream")


def _drained(rows: DataFrame, place: str) -> DataFrame:
    rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start(f"{place}/out").awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{place}/out")


def resume(rows: DataFrame, saved: DataFrame, key: str, place: str | None = None, time: str | None = None, within: str = "1 day") -> DataFrame:
    """Rows without a saved result, each once. Keys already passed on are kept as state, so the work of a batch
    follows the batch, never the sink: with ``time`` a key is forgotten ``within`` after it came (repeats come
    no later, and rows older than that are too late to be taken), without it keys stay for good. Each batch has
    a folder of its own; one that was committed is not written again, so a repeated batch changes nothing."""
    place, spark = _place(rows, place), rows.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        commit(batch, f"{place}/out/batch={number}")

    left = rows.join(saved, key, "left_anti")
    once = left.withWatermark(time, within).dropDuplicatesWithinWatermark([key]) if time else left.dropDuplicates([key])
    with rocksdb(spark):
        once.writeStream.option("checkpointLocation", f"{place}/checkpoint").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).option("basePath", f"{place}/out").parquet(f"{place}/out").drop("batch")


def progress(rows: DataFrame, by: str, expected: DataFrame | None = None, place: str | None = None) -> DataFrame:
    """Counts per condition, kept as versions of a running aggregation: each batch commits a folder of its own
    and none is written over, so a reader always finds the last committed one. With ``expected(by, expected)``
    joined to the grid: saved, expected and whether the condition is complete."""
    place, spark = _place(rows, place), rows.sparkSession

    def snapshot(batch: DataFrame, number: int) -> None:
        commit(batch, f"{place}/version={number:012d}")

    counts = rows.groupBy(by).agg(F.count("*").alias("saved"))
    counts.writeStream.outputMode("complete").option("checkpointLocation", f"{place}/checkpoint").foreachBatch(snapshot).trigger(availableNow=True).start().awaitTermination()
    now = newest(spark, place, counts.schema)
    if expected is None:
        return now
    return expected.join(now, by, "left").withColumn("saved", F.coalesce("saved", F.lit(0))).withColumn("complete", F.col("saved") == F.col("expected"))


def newest(spark: SparkSession, place: str, schema) -> DataFrame:
    """The last committed version below ``place``; no rows where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/version=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    paths = sorted(f.getPath().getParent().toString() for f in found or [])
    return spark.read.schema(schema).parquet(paths[-1]) if paths else spark.createDataFrame([], schema)


def halts(rows: DataFrame, by: str, order: str, kind: str, bad: str, streak: int = 3, stop: str | None = None, place: str | None = None) -> DataFrame:
    """Per group, the first row that ends ``streak`` bad rows in a row, or is of kind ``stop`` (a billing error): keyed
    state holds the current run of bad rows and whether the group has stopped; rows of a micro-batch are
    taken in ``order``."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, batches, state):
        import pandas as pd

        run, stopped = state.get if state.exists else (0, False)
        pdf = pd.concat(list(batches)).sort_values(order)
        found = []
        for at, what in zip(pdf[order], pdf[kind], strict=True):
            run = run + 1 if what == bad else 0
            if (run >= streak or (stop is not None and what == stop)) and not stopped:
                stopped = True
                found.append(at)
        state.update((run, stopped))
        yield pd.DataFrame({by: [key[0]] * len(found), "halted_at": found})

    out = rows.select(by, order, kind).groupBy(by).applyInPandasWithState(step, f"{by} long, halted_at long", "run int, stopped boolean", "append", GroupStateTimeout.NoTimeout)
    return _drained(out, _place(rows, place))


class Ledger(StatefulProcessor):
    """One ledger's events in order of their ``seq`` (1, 2, ...). State: a head of fixed size, open reservations in
    buckets of ``BUCKET`` neighbouring ids at most, and events that came before their turn in blocks of as many
    neighbouring numbers. A call to the state costs far more than an event, so events are put in order as arrays, ``HELD`` at
    a time, and a bucket is read once and written once while it is among the ``HELD`` reservations kept; what a batch reads
    and writes is the buckets its events name, however many there are."""

    HEAD = "balance long, next long, halted boolean, stopped boolean, waiting long"
    PACKED = "packed binary"
    OUT = "ledger_id long, seq long, status string, balance_nano long, halted boolean"
    COLUMNS = ("seq", "kind", "reservation_id", "reserved_nano", "charged_nano")
    #: Kinds of events, others being answers; what stands for a missing amount, and for a missing id.
    RESERVE, SETTLE, NO_AMOUNT, NO_ID = 0, 1, -1, -(1 << 63)
    BUCKET, HELD, TOLD = 1 << 10, 1 << 19, 1 << 16

    def __init__(self, cap_nano: int, stop_at_cap: bool):
        self.cap, self.stop_at_cap = cap_nano, stop_at_cap

    def init(self, handle) -> None:
        self.head = handle.getValueState("head", self.HEAD)
        self.open = handle.getMapState("open", "bucket long", self.PACKED)
        self.early = handle.getMapState("early", "block long", self.PACKED)

    def handleInputRows(self, key, rows, timers):
        import numpy as np
        import pandas as pd

        self.balance, self.turn, self.halted, self.stopped, self.waiting = self.head.get() if self.head.exists() else (0, 1, False, False, 0)
        self.buckets, self.kept, self.changed = {}, 0, set()
        held, n = [], 0

        def told(out):
            for at in range(0, len(out), self.TOLD):
                yield pd.DataFrame([(key[0], *x) for x in out[at : at + self.TOLD]], columns=["ledger_id", "seq", "status", "balance_nano", "halted"])

        for pdf in rows:
            held.append(pdf[list(self.COLUMNS)].to_numpy(np.int64))
            n += len(pdf)
            if n >= self.HELD:
                out, left = self.take(np.concatenate(held))
                yield from told(out)
                if len(left) >= self.HELD // 2:
                    yield from told(self.wait(left))
                    left = left[:0]
                held, n = [left], len(left)
        out, left = self.take(np.concatenate(held))
        yield from told(out + self.wait(left))
        self.write()
        self.head.update((self.balance, self.turn, self.halted, self.stopped, self.waiting))

    def take(self, events) -> tuple[list, object]:
        """Events of ``events`` and of the state that have their turn: what is told of them, and events that have not."""
        import numpy as np

        out: list = []
        events = events[np.argsort(events[:, 0], kind="stable")]
        while True:
            own, rest, block = events, events[:0], self.turn // self.BUCKET
            if waiting := self.waiting:
                # block by block; what came in an earlier call goes before what came now
                end = int(np.searchsorted(events[:, 0], (block + 1) * self.BUCKET))
                own, rest = events[:end], events[end:]
                before = self.unpacked(self.early, block, len(self.COLUMNS))
                if len(before):
                    self.early.removeKey((block,))
                    self.waiting -= len(before)
                    own = np.concatenate([before, own])
                    own = own[np.argsort(own[:, 0], kind="stable")]
            seq = own[:, 0]
            again = seq < self.turn
            again[1:] |= seq[1:] == seq[:-1]
            out += [(x, "repeated", self.balance, self.halted) for x in seq[again].tolist()]
            own = own[~again]
            n = int(np.argmin(np.append(own[:, 0] == self.turn + np.arange(len(own)), False)))
            for x, *event in own[:n].tolist():
                out.append((x, self.step(*event), self.balance, self.halted))
            self.turn += n
            if not waiting or self.turn // self.BUCKET == block:
                return out, np.concatenate([own[n:], rest])
            events = rest

    def wait(self, events) -> list:
        """Puts events into the state until their turn; what is told of those whose number waits there already."""
        import numpy as np

        out: list = []
        at = np.concatenate([[0], np.flatnonzero(np.diff(events[:, 0] // self.BUCKET)) + 1, [len(events)]])
        for first, end in zip(at[:-1], at[1:], strict=True):
            if end > first:
                own, block = events[first:end], int(events[first, 0] // self.BUCKET)
                before = self.unpacked(self.early, block, len(self.COLUMNS))
                again = np.isin(own[:, 0], before[:, 0])
                out += [(x, "repeated", self.balance, self.halted) for x in own[again, 0].tolist()]
                own = own[~again]
                self.early.updateValue((block,), (np.concatenate([before, own]).tobytes(),))
                self.waiting += len(own)
        return out

    @staticmethod
    def unpacked(state, at: int, width: int):
        import numpy as np

        packed = bytes(state.getValue((at,))[0]) if state.containsKey((at,)) else b""
        return np.frombuffer(packed, np.int64).reshape(-1, width)

    def bucket(self, reservation_id: int) -> dict[int, int]:
        """The open reservations near an id."""
        at = reservation_id // self.BUCKET
        if at not in self.buckets:
            if self.kept >= self.HELD:
                self.write()
            self.buckets[at] = dict(self.unpacked(self.open, at, 2).tolist())
            self.kept += 1 + len(self.buckets[at])
        return self.buckets[at]

    def write(self) -> None:
        """Writes the buckets that changed and forgets all."""
        import numpy as np

        for at in self.changed:
            if self.buckets[at]:
                self.open.updateValue((at,), (np.array(list(self.buckets[at].items()), np.int64).tobytes(),))
            elif self.open.containsKey((at,)):
                self.open.removeKey((at,))
        self.buckets, self.kept, self.changed = {}, 0, set()

    def step(self, kind: int, reservation_id: int, reserved_nano: int, charged_nano: int) -> str:
        """Status of an event; balance, halts and open reservations follow it."""
        bucket = self.bucket(reservation_id)
        held = bucket.get(reservation_id)
        if kind == self.RESERVE:
            # a request that costs nothing is a reservation like others
            if held is not None or reserved_nano < 0 or reservation_id == self.NO_ID:
                return "violation"
            if self.halted or self.stopped or self.balance + reserved_nano > self.cap:
                self.stopped = self.stopped or (self.stop_at_cap and not self.halted)
                return "refused"
            bucket[reservation_id] = reserved_nano
            self.kept += 1
            self.changed.add(reservation_id // self.BUCKET)
            self.balance += reserved_nano
            return "admitted"
        if held is None:
            return "violation"
        if kind != self.SETTLE:
            return "answered"
        if charged_nano < 0:
            return "violation"
        if charged_nano > held:
            # more was used than reserved: what is held stays, and nothing new is admitted
            self.halted = True
            return "violation"
        self.balance += charged_nano - held
        del bucket[reservation_id]
        self.changed.add(reservation_id // self.BUCKET)
        return "settled"

    def close(self) -> None:
        pass


def ledger_machine(rows: DataFrame, cap_nano: int, place: str | None = None, stop_at_cap: bool = False) -> DataFrame:
    """(ledger_id, seq, status, balance_nano, halted) per event, in order of ``seq`` from 1 on: reserves are admitted or
    refused against the cap (a refused one holds nothing; with ``stop_at_cap`` the first refusal refuses all that
    follow), results and settlements of reservations that are not open are violations, a settlement gives back
    what it did not charge, one above its reservation halts the ledger. An event that comes before its turn waits
    in the state for those before it; one that has had its turn is reported as repeated and changes nothing."""
    kind = F.when(F.col("type") == "reserve", Ledger.RESERVE).when(F.col("type") == "settle", Ledger.SETTLE).otherwise(2)
    amounts = [F.coalesce(c, F.lit(Ledger.NO_AMOUNT)).alias(c) for c in ("reserved_nano", "charged_nano")]
    events = rows.select("ledger_id", "seq", kind.alias("kind"), F.coalesce("reservation_id", F.lit(Ledger.NO_ID)).alias("reservation_id"), *amounts)
    out = events.groupBy("ledger_id").transformWithStateInPandas(Ledger(cap_nano, stop_at_cap), Ledger.OUT, "Append", "None")
    with rocksdb(rows.sparkSession):
        return _drained(out, _place(rows, place))


def open_reservations(reserves: DataFrame, results: DataFrame, key: str, time: str, within: str = "1 hour", late: str = "10 minutes", place: str | None = None) -> DataFrame:
    """Reserves without a result within the time bound: a left outer join of two streams, whose state is dropped
    as the watermarks pass. Rows of the last ``within`` + ``late`` are undecided until later events come."""
    a = reserves.select(F.col(key).alias("k"), F.col(time).alias("reserved_at")).withWatermark("reserved_at", late)
    b = results.select(F.col(key).alias("rk"), F.col(time).alias("result_at")).withWatermark("result_at", late)
    on = (F.col("k") == F.col("rk")) & (F.col("result_at") >= F.col("reserved_at")) & (F.col("result_at") <= F.col("reserved_at") + F.expr(f"interval {within}"))
    joined = a.join(b, on, "left_outer")
    return _drained(joined, _place(reserves, place)).where("rk is null").select(F.col("k").alias(key), "reserved_at")


def unreconciled(reserves: DataFrame, results: DataFrame, predictions: DataFrame, key: str, time: str, within: str = "1 hour", late: str = "10 minutes", place: str | None = None) -> DataFrame:
    """(key, reserved_at, status) per reserve: no_result, no_prediction (a result, but no saved prediction) or
    answered. One query with two stateful joins, each an outer join of streams within a time bound of the reserve:
    the second one's state is dropped as the watermark that the first one hands on passes. Rows of the last
    ``within`` + ``late`` are undecided until later events come."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col(key).alias(f"{name}_key"), F.col(time).alias(f"{name}_at")).withWatermark(f"{name}_at", late)

    a, b, c = side(reserves, "reserved"), side(results, "result"), side(predictions, "saved")

    def near(name: str):
        end = F.col("reserved_at") + F.expr(f"interval {within}")
        return (F.col("reserved_key") == F.col(f"{name}_key")) & (F.col(f"{name}_at") >= F.col("reserved_at")) & (F.col(f"{name}_at") <= end)

    joined = a.join(b, near("result"), "left_outer").join(c, near("saved"), "left_outer")
    status = F.when(F.col("result_key").isNull(), "no_result").when(F.col("saved_key").isNull(), "no_prediction").otherwise("answered")
    return _drained(joined.select(F.col("reserved_key").alias(key), "reserved_at", status.alias("status")), _place(reserves, place))
