"""Streams over several files against their batch forms."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from foliant.operators import edits, fields
from foliant.plans import inputs
from foliant.streaming import logs, streams


@pytest.fixture(scope="module")
def events(spark, sf_dir, tmp_path_factory):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    path = str(tmp_path_factory.mktemp("events") / "all")
    table.repartition(3).write.parquet(path)  # files out of the order of time
    return table, lambda: streams.field_events_stream(spark, path, table.schema, files_per_batch=1)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_field_state(spark, events, tmp_path):
    table, stream = events
    found = streams.run_to_end(streams.stream_field_state(inputs.as_field_events(stream())), str(tmp_path / "s"))
    assert rows(found) == rows(fields.last_field_values(inputs.as_field_events(table)))


def test_letter_preview(spark, events, tmp_path):
    table, stream = events
    preview = streams.stream_letter_preview(inputs.as_field_events(stream()), fields.TEMPLATE)
    found = streams.run_to_end(preview, str(tmp_path / "s"))
    slots = fields.field_slots(fields.last_field_values(inputs.as_field_events(table)))
    assert rows(found) == rows(slots.select("session", fields.fill(F.lit(fields.TEMPLATE), F.col("slots")).alias("letter")))


def test_replayed_markers(spark, events, sf_dir, tmp_path):
    table, stream = events
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    live = streams.stream_insert_markers(inputs.as_drops(stream()), docs)
    found = streams.run_to_end(live, str(tmp_path / "s"), mode="update", keys=("doc_id",))
    drops = inputs.drops(table)
    assert rows(found) == rows(edits.insert_markers(docs, drops).join(drops.select("doc_id").distinct(), "doc_id"))


def test_replayed_moves(spark, events, tmp_path):
    table, stream = events
    slots = fields.field_slots(fields.last_field_values(inputs.as_field_events(table)))
    live = streams.stream_move_fields(inputs.as_moves(stream()), slots)
    found = streams.run_to_end(live, str(tmp_path / "s"), mode="update", keys=("session",))
    assert rows(found) == rows(edits.move_fields(slots, inputs.moves(table)))


@pytest.mark.parametrize(("mode", "text"), [("replay", "}}y{{}}x{{ab"), ("arrival", "}}x{{}}y{{ab")])
def test_edits_out_of_order(spark, tmp_path, mode, text):
    schema = "doc_id long, ts timestamp, event_id long, offset int, value string"
    late = [(1, "2024-01-01 00:00:02", 2, 0, "y"), (1, "2024-01-01 00:00:01", 1, 0, "x")]
    for i, row in enumerate(late):
        one = spark.createDataFrame([row], "doc_id long, ts string, event_id long, offset int, value string")
        one.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{i}"))
    docs = spark.createDataFrame([(1, "ab")], "doc_id long, text string")
    out = str(tmp_path / "s")
    for i in range(2):  # one run after the other, with the state of the first
        source = streams.field_events_stream(spark, str(tmp_path / "in[0-9]" if i else tmp_path / "in0"), spark.read.parquet(str(tmp_path / "in0")).schema, files_per_batch=1)
        if i == 0:
            continue
        found = streams.run_to_end(streams.stream_insert_markers(source, docs, mode=mode), out, mode="update", keys=("doc_id",))
    # Files are taken in order of their time of writing.
    assert found.first()["text"] == text


class Value:
    """Keyed state in memory, for one key."""

    def __init__(self):
        self.row, self.reads = None, 0

    def exists(self):
        return self.row is not None

    def get(self):
        self.reads += 1
        return self.row

    def update(self, row):
        self.row = row


class Rows(Value):
    def __init__(self):
        self.rows, self.reads = [], 0

    def get(self):
        self.reads += 1
        return iter(list(self.rows))

    def put(self, rows):
        self.rows = list(rows)

    def appendList(self, rows):
        self.rows += rows

    def clear(self):
        self.rows = []


class Handle:
    def __init__(self):
        self.state, self.timers = defaultdict(Value), []

    def getValueState(self, name, schema):
        return self.state[name]

    def getListState(self, name, schema):
        return self.state.setdefault(name, Rows())

    def registerTimer(self, at):
        self.timers.append(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def batch(base, rows):
    columns = ["ts", "event_id", "first", "second"]
    return iter([pd.DataFrame(rows, columns=columns).assign(base=base)])


def fold(base, rows):
    for edit in sorted(rows, key=logs._order):
        base = logs.insert_one(base, edit)
    return base


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("compact", [False, True])
def test_a_log_in_any_order_of_arrival(seed, compact):
    """Against a fold of all edits in order; with a watermark, edits come at most 20 ms late and state keeps no more."""
    rng = random.Random(seed)
    edits_in_time = [(t * 1000, i, rng.choice([None, *range(30)]), rng.choice([None, "", "x", "yz"])) for i, t in enumerate(sorted(rng.choices(range(400), k=120)))]
    lateness = 20_000 if compact else 10**9
    arrival = sorted(edits_in_time, key=lambda e: e[0] + rng.randint(0, min(lateness, 400_000)))
    log, handle = logs.Log(logs.insert_one, compact=compact, snapshot=8), Handle()
    log.init(handle)
    seen, at = [], 0
    while arrival:
        n = rng.randint(1, 9)
        new, arrival = arrival[:n], arrival[n:]
        seen += new
        got = pd.concat(log.handleInputRows((1,), batch("abc", new), Clock(at)))
        assert got["result"].tolist() == [fold("abc", seen)]
        if compact:
            at = max(e[0] for e in seen) // 1000 - 20
            if any(t <= at for t in handle.timers):
                handle.timers = [t for t in handle.timers if t > at]
                assert list(log.handleExpiredTimer((1,), Clock(at), None)) == []
                left = handle.state["tail"].rows + handle.state["past"].rows
                assert all(e[0] > at * 1000 for e in left)
                assert handle.state["now"].row[0] == fold("abc", seen)
    if not compact:
        assert len(handle.state["tail"].rows) + len(handle.state["past"].rows) == len(seen)


def test_edits_in_order_read_no_log():
    log, handle = logs.Log(logs.insert_one, snapshot=50), Handle()
    log.init(handle)
    for i in range(320):
        list(log.handleInputRows((1,), batch("abc", [(i, i, 0, "x")]), Clock(0)))
    assert handle.state["past"].reads == 0
    assert handle.state["tail"].reads == 300 // 50
    list(log.handleInputRows((1,), batch("abc", [(310, 999, 0, "y")]), Clock(0)))  # late by some edits
    assert handle.state["past"].reads == 0
    list(log.handleInputRows((1,), batch("abc", [(1, 999, 0, "y")]), Clock(0)))
    assert handle.state["past"].reads == 1


@pytest.mark.parametrize("horizon", [None, "10 seconds"])
def test_state_behind_the_watermark_is_folded(spark, tmp_path, horizon):
    """Six files of edits, a minute apart; with a horizon, state ends with what the last minute left."""
    rows = [(key, f"2024-01-01 00:{minute:02}:{i % 60:02}", minute * 100 + i, i % 5, f"{minute}") for minute in range(6) for i in range(20) for key in (1, 2)]
    schema = "doc_id long, ts string, event_id long, offset int, value string"
    drops = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    for minute in range(6):
        part = drops.where(F.minute("ts") == minute)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    docs = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ef")], "doc_id long, text string")
    source = streams.field_events_stream(spark, str(tmp_path / "in"), drops.schema, files_per_batch=1)
    live = streams.stream_insert_markers(source, docs, horizon=horizon)
    found = {}

    def keep(batch, number):
        found.update({r["doc_id"]: r["text"] for r in batch.collect()})

    writer = live.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(keep)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    wanted = edits.insert_markers(docs, drops.withColumn("seq", F.struct("ts", "event_id")))
    assert found == {r["doc_id"]: r["text"] for r in wanted.collect() if r["doc_id"] < 3}
    # A row for each edit that the state lists hold.
    held = 0
    for name in ("tail", "past"):
        state = spark.read.format("statestore").option("stateVarName", name).option("flattenCollectionTypes", True)
        held += state.load(str(tmp_path / "c")).count()
    assert held <= 2 * 20 if horizon else held == 2 * 120  # of each key the edits of the last minute, or all


def test_moves_that_do_nothing(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", i, a, b) for i, (a, b) in enumerate([(5, 0), (0, 5), (None, 1), (1, None), (-1, 0), (0, 1)])]
    moves = spark.createDataFrame(rows, "session long, ts string, event_id long, from int, to int").withColumn("ts", F.col("ts").cast("timestamp"))
    moves.write.parquet(str(tmp_path / "in"))
    slots = spark.createDataFrame([(1, ["a", "b"])], "session long, slots array<string>")
    for mode in streams.MODES:
        source = streams.field_events_stream(spark, str(tmp_path / "in"), moves.schema)
        live = streams.stream_move_fields(source, slots, mode=mode)
        found = streams.run_to_end(live, str(tmp_path / mode), mode="update", keys=("session",))
        assert found.first()["slots"] == ["b", "a"]
    batch = edits.move_fields(slots, moves.withColumn("seq", F.struct("ts", "event_id")))
    assert batch.first()["slots"] == ["b", "a"]
