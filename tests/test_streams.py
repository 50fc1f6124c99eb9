"""Streams: state that follows events one by one, replays, and equality with the batch operators."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from gradeloom.operators import events
from gradeloom.streaming import streams

SCHEMA = "ledger_id long, seq long, type string, reservation_id long, reserved_nano long, charged_nano long"


def simulated(rows, cap, stop_at_cap):
    """The rules, event by event, in plain Python."""
    out, state = {}, {}
    for ledger, seq, kind, name, reserved, charged in sorted(rows):
        s = state.setdefault(ledger, {"balance": 0, "open": {}, "halted": False, "stopped": False})
        held = s["open"].get(name)
        if kind == "reserve":
            if held is not None:
                status = "violation"
            elif s["halted"] or s["stopped"] or s["balance"] + reserved > cap:
                status = "refused"
                s["stopped"] |= stop_at_cap and not s["halted"]
            else:
                status, s["open"][name] = "admitted", reserved
        elif held is None:
            status = "violation"
        elif kind == "result":
            status = "answered"
        elif charged > held:
            status, s["halted"] = "violation", True
        else:
            status = "settled"
            del s["open"][name]
            s["charged"] = s.get("charged", 0) + charged
        s["balance"] = sum(s["open"].values()) + s.get("charged", 0)
        out[ledger, seq] = (status, s["balance"], s["halted"])
    return out


def test_ledgers_in_any_order_and_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for ledger in (1, 2, 3):
        for seq in range(1, 60):
            name, kind = rng.randrange(14), rng.choice(["reserve", "reserve", "result", "settle"])
            rows.append((ledger, seq, kind, name, rng.randrange(1, 40) if kind == "reserve" else None, rng.randrange(0, 44) if kind == "settle" else None))
    for stop in (False, True):
        place, shuffled = tmp_path / str(stop), rng.sample(rows, len(rows))
        got = {}
        for k in range(3):  # each run goes on where the last one stopped
            spark.createDataFrame(shuffled[k::3], SCHEMA).coalesce(1).write.parquet(f"{place}/in/{k}")
            source = spark.readStream.schema(SCHEMA).parquet(f"{place}/in/*")
            got = {(r.ledger_id, r.seq): (r.status, r.balance_nano, r.halted) for r in streams.ledger_machine(source, 90, f"{place}/run", stop).collect()}
        want = simulated(rows, 90, stop)
        assert got == want
        kinds = {s for s, _, _ in got.values()}
        assert kinds == {"admitted", "refused", "violation", "answered", "settled"} and any(h for _, _, h in got.values())


def test_an_event_has_one_turn(spark, tmp_path):
    rows = [(1, 1, "reserve", 5, 10, None), (1, 1, "reserve", 6, 10, None), (1, 3, "settle", 5, None, 4)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    source = lambda: spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*")
    got = [(r.seq, r.status) for r in streams.ledger_machine(source(), 100, f"{tmp_path}/run").collect()]
    assert sorted(got) == [(1, "admitted"), (1, "repeated")]  # 3 waits for 2
    spark.createDataFrame([(1, 2, "result", 5, None, None)], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    got = {(r.seq, r.status): r.balance_nano for r in streams.ledger_machine(source(), 100, f"{tmp_path}/run").collect()}
    assert got[3, "settled"] == 4 and len(got) == 4


def resumed(spark, tmp_path, time):
    rows = lambda: spark.readStream.schema("k long, ts timestamp").parquet(f"{tmp_path}/in/*")
    saved = spark.createDataFrame([(2,), (7,)], "k long")
    return streams.resume(rows(), saved, "k", f"{tmp_path}/run", time=time)


def add(spark, tmp_path, name, keys):
    spark.createDataFrame([(k,) for k in keys], "k long").withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, k)")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")


def test_resume_takes_each_row_once_and_survives_a_replay(spark, tmp_path):
    for time in (None, "ts"):
        place = tmp_path / str(time)
        add(spark, place, "a", [1, 2, 3, 3, 4])
        assert sorted(r.k for r in resumed(spark, place, time).collect()) == [1, 3, 4]
        add(spark, place, "b", [4, 5, 7, 1])
        assert sorted(r.k for r in resumed(spark, place, time).collect()) == [1, 3, 4, 5]
        # without its commit the last batch comes again
        files = sorted((place / "run" / "checkpoint" / "commits").glob("[0-9]*"))
        before = sorted(map(str, (place / "run" / "out").rglob("*.parquet")))
        files[-1].unlink()
        (files[-1].parent / f".{files[-1].name}.crc").unlink(missing_ok=True)
        assert sorted(r.k for r in resumed(spark, place, time).collect()) == [1, 3, 4, 5]
        assert before == sorted(map(str, (place / "run" / "out").rglob("*.parquet")))


def test_progress_keeps_versions(spark, tmp_path):
    rows = lambda: spark.readStream.schema("k long").parquet(f"{tmp_path}/in/*")
    assert streams.newest(spark, f"{tmp_path}/run", "k long, saved long").count() == 0
    for name, k in (("a", 1), ("b", 2)):
        spark.range(k, k + 2).select(F.col("id").alias("k")).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        now = {r.k: r.saved for r in streams.progress(rows(), "k", place=f"{tmp_path}/run").collect()}
    assert now == {1: 1, 2: 2, 3: 1} and len(list(Path(tmp_path / "run").glob("version=*"))) >= 2
    # a version that was not committed is not read
    (tmp_path / "run" / "version=999999999999").mkdir()
    assert streams.newest(spark, f"{tmp_path}/run", "k long, saved long").count() == 3


def test_unreconciled_equals_the_batch_reconciliation(spark, tmp_path):
    rng = random.Random(9)
    start = "timestamp'2024-01-01 00:00:00'"
    kind = {k: rng.choice(["no_result", "no_prediction", "answered"]) for k in range(300)}
    rows = spark.createDataFrame([(k, rng.randrange(100_000), v) for k, v in kind.items()] + [(-1, 10_000_000, "answered"), (-2, 20_000_000, "answered")], "event_id long, s int, kind string")
    rows = rows.withColumn("ts", F.expr(f"{start} + make_interval(0, 0, 0, 0, 0, 0, s)"))
    for name, some in (("a", "event_id >= 0"), ("b", "event_id = -1"), ("c", "event_id = -2")):
        rows.where(some).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    read = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in/*")
    later = F.col("ts") + F.expr("interval 5 minutes")
    results, predictions = read().where("kind <> 'no_result'").withColumn("ts", later), read().where("kind = 'answered'").withColumn("ts", later)
    got = {r.event_id: r.status for r in streams.unreconciled(read(), results, predictions, "event_id", "ts").collect() if r.event_id >= 0}
    assert got == kind
    ledger = spark.createDataFrame([(1, k, t, 9 if t == "reserve" else None, None, None if t == "reserve" else "returned") for k, v in kind.items() for t in (["reserve"] if v == "no_result" else ["reserve", "result"])], "ledger_id long, reservation_id long, type string, reserved_nano long, charged_nano long, outcome string")
    answers = spark.createDataFrame([(1, k, None) for k, v in kind.items() if v == "answered"], "ledger_id long, reservation_id long, told_nano long")
    batch = {r.reservation_id: r.status for r in events.reconcile(ledger, answers).collect()}
    assert {k: v for k, v in batch.items() if v.startswith("no_")} == {k: v for k, v in got.items() if v.startswith("no_")}


def test_billing_stops_at_once(spark, tmp_path):
    rows = [(1, 1, "ok"), (1, 2, "error"), (1, 3, "billing"), (1, 4, "billing"), (2, 1, "error"), (2, 2, "error"), (2, 3, "ok"), (3, 5, "error"), (3, 6, "error"), (3, 7, "error")]
    spark.createDataFrame(rows, "g long, k long, kind string").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("g long, k long, kind string").parquet(f"{tmp_path}/in")
    assert {r.g: r.halted_at for r in streams.halts(source, "g", "k", "kind", "error", stop="billing").collect()} == {1: 3, 3: 7}


def test_a_reservation_that_costs_nothing_is_one(spark, tmp_path):
    rows = [(1, 1, "reserve", 5, 0, None), (1, 2, "result", 5, None, None), (1, 3, "settle", 5, None, 0), (1, 4, "reserve", 6, -1, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    got = streams.ledger_machine(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in/*"), 100, f"{tmp_path}/run").collect()
    assert {r.seq: r.status for r in got} == {1: "admitted", 2: "answered", 3: "settled", 4: "violation"}


def test_ledger_calls_to_the_state_follow_buckets_not_events(monkeypatch):
    """Events in any order, repeated ones among them, in calls and pieces of any size, against the rules one by one; the state
    is called a few times a bucket."""
    import pandas as pd

    class Store(dict):
        calls = 0

        def __getattr__(self, name):
            Store.calls += 1
            acts = {"exists": lambda: bool(self), "get": lambda: self[0], "update": lambda v: self.__setitem__(0, v), "containsKey": lambda k: k in self, "getValue": lambda k: self[k]}
            return (acts | {"updateValue": self.__setitem__, "removeKey": self.__delitem__})[name]

        get = update = property(lambda self: (lambda *v: self.__setitem__(0, v[0]) if v else self[0]))

    class Handle:
        def getValueState(self, *a):
            return Store()

        getMapState = getValueState

    rng = random.Random(9)
    n, rows, pool = 6_000, [], []
    for seq in range(1, n + 1):
        kind = rng.choice(["reserve", "reserve", "reserve", "settle", "result"])
        name = len(rows) if kind == "reserve" or not pool else rng.choice(pool)
        pool = [*pool[-50:], name] if kind == "reserve" else pool
        rows.append((7, seq, kind, name, rng.randrange(0, 40) if kind == "reserve" else None, rng.randrange(0, 41) if kind == "settle" else None))
    want = simulated([(*r[:4], r[4], 0 if r[5] is not None and r[2] != "settle" else r[5]) for r in rows], 10**6, False)
    code = {"reserve": 0, "settle": 1, "result": 2}
    for held, calls in ((1 << 19, 1), (500, 4)):
        monkeypatch.setattr(streams.Ledger, "HELD", held)
        machine, Store.calls = streams.Ledger(10**6, False), 0
        machine.init(Handle())
        mixed = rng.sample(rows, n)
        got, repeated = {}, 0
        for k in range(calls):
            part = mixed[k::calls]
            part += part[:20]
            frames = [pd.DataFrame([(s, code[t], i, -1 if r is None else r, -1 if c is None else c) for _, s, t, i, r, c in part[at : at + 100]], columns=list(streams.Ledger.COLUMNS)) for at in range(0, len(part), 100)]
            for out in machine.handleInputRows((7,), iter(frames), None):
                for r in out.itertuples(index=False):
                    if r.status == "repeated":
                        repeated += 1
                    else:
                        assert (7, r.seq) not in got
                        got[7, r.seq] = (r.status, r.balance_nano, r.halted)
        assert got == want and repeated == 20 * calls
        assert held == 500 or Store.calls < 60
