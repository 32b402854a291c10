import datetime as dt

from pyspark.sql import functions as F

from barloom.streaming.alerts import ROCKSDB, StateTable, stream_edges, watch, watch_rest
from barloom.streaming.bars import newest_bars, stream_bars, upsert_bars

T0 = dt.datetime(2024, 1, 1)


def feed(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def test_late_ticks_are_dropped(spark, tmp_path):
    schema = "symbol string, ts timestamp, seq long, price double, qty double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        ticks = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        q = stream_bars(ticks).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()

    feed(spark, src, "a", [("A", T0, 1, 10.0, 1.0), ("A", T0 + dt.timedelta(minutes=5), 2, 12.0, 1.0), ("A", T0 + dt.timedelta(hours=6), 3, 9.0, 1.0)], schema)
    run()
    feed(spark, src, "b", [("A", T0 + dt.timedelta(minutes=6), 4, 99.0, 1.0), ("A", T0 + dt.timedelta(hours=12), 5, 8.0, 1.0)], schema)
    run()
    bars = {r.ts: r for r in spark.read.parquet(out).collect()}
    assert bars[T0].open == 10.0 and bars[T0].close == 12.0 and bars[T0].high == 12.0
    assert T0 + dt.timedelta(hours=6) in bars


def test_open_bars_are_written_and_changed_later(spark, tmp_path):
    schema = "symbol string, ts timestamp, seq long, price double, qty double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        ticks = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        upsert_bars(stream_bars(ticks), out, str(tmp_path / "log")).awaitTermination()
        return {r.ts: r for r in newest_bars(spark, out).collect()}

    feed(spark, src, "a", [("A", T0, 1, 10.0, 1.0), ("A", T0 + dt.timedelta(hours=1), 2, 12.0, 1.0)], schema)
    first = run()
    assert first[T0 + dt.timedelta(hours=1)].close == 12.0 and len(first) == 2
    feed(spark, src, "b", [("A", T0 + dt.timedelta(hours=1, minutes=9), 3, 15.0, 2.0)], schema)
    then = run()
    assert then[T0 + dt.timedelta(hours=1)].close == 15.0 and then[T0 + dt.timedelta(hours=1)].volume == 3.0 and then[T0].close == 10.0


def evaluations(spark, src):
    return spark.readStream.schema("rule_id string, ts timestamp, is_met boolean").option("recursiveFileLookup", "true").parquet(src)


def test_edges_fire_once_and_survive_a_failed_delivery(spark, tmp_path):
    schema = "rule_id string, ts timestamp, is_met boolean"
    src, sent, fail = str(tmp_path / "in"), [], [True]

    def deliver(fired, batch_id):
        rows = fired.collect()
        if fail[0]:
            fail[0] = False
            raise RuntimeError("delivery failed")
        sent.extend((r.rule_id, r.ts) for r in rows)

    def run():
        watch(evaluations(spark, src), str(tmp_path / "state"), deliver, str(tmp_path / "log")).awaitTermination()

    at = lambda i: T0 + dt.timedelta(minutes=i)
    feed(spark, src, "a", [("r1", at(0), True), ("r2", at(0), False)], schema)
    try:
        run()
    except Exception:
        pass
    assert sent == []
    run()  # the same batch again
    assert sent == [("r1", at(0))]
    feed(spark, src, "b", [("r1", at(1), True), ("r2", at(1), True), ("r2", at(2), True)], schema)
    run()
    assert sent == [("r1", at(0)), ("r2", at(1))]
    feed(spark, src, "c", [("r1", at(3), False), ("r1", at(4), True)], schema)
    run()
    assert sent[2:] == [("r1", at(4))]


def test_keyed_state_gives_the_same_edges(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    schema = "rule_id string, ts timestamp, is_met boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, met in enumerate([True, True, False, True]):
        feed(spark, src, f"b{i}", [("r", T0 + dt.timedelta(minutes=i), met)], schema)
        q = stream_edges(evaluations(spark, src)).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(r.ts.minute for r in spark.read.parquet(out).select(F.col("ts")).collect())
    assert got == [0, 3]


def test_late_rows_in_any_order_deleted_rules_and_expiry(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "rule_id string, ts timestamp, is_met boolean"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    at = lambda i: T0 + dt.timedelta(minutes=i)
    batches = [
        [("r", at(2), True), ("r", at(0), True), ("r", at(1), False), ("gone", at(0), True)],  # out of order: edges at 0 and 2
        [("gone", at(3), None)],  # deleted
        [("gone", at(4), True), ("r", at(4), True)]]  # a new rule of the old name fires again, r goes on
    for i, rows in enumerate(batches):
        feed(spark, src, f"b{i}", rows, schema)
        stream_edges(evaluations(spark, src), ttl_ms=86_400_000).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "log")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.rule_id, r.ts) for r in spark.read.parquet(out).collect()) == [("gone", at(0)), ("gone", at(4)), ("r", at(0)), ("r", at(2))]
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def test_state_stays_small_and_forgets_deleted_rules(spark, tmp_path):
    schema = "rule_id string, ts timestamp, is_met boolean"
    src, state, sent, existing = str(tmp_path / "in"), str(tmp_path / "state"), [], ["a", "b"]
    at = lambda i: T0 + dt.timedelta(minutes=i)

    def run(dry=False, log="log"):
        rules = lambda: spark.createDataFrame([(r,) for r in existing], "rule_id string")
        deliver = lambda fired, _: sent.extend((r.rule_id, r.ts) for r in fired.collect())
        watch(evaluations(spark, src), state, deliver, str(tmp_path / log), rules, dry).awaitTermination()

    known = lambda: {r.rule_id: r.was_active for r in StateTable(spark, state).before(10**6).collect()}
    for i in range(5):
        feed(spark, src, f"b{i}", [("a", at(i), True), ("b", at(i), i % 2 == 1)], schema)
        run()
    assert sent == [("a", at(0)), ("b", at(1)), ("b", at(3))] and known() == {"a": True, "b": False}
    assert len([p for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")]) == 2
    existing.remove("a")
    feed(spark, src, "b5", [("b", at(5), False)], schema)
    run()
    assert known() == {"b": False}
    # a dry run evaluates everything against the stored state, and changes nothing
    sent.clear()
    feed(spark, src, "b6", [("b", at(6), True)], schema)
    run(dry=True, log="dry")
    assert sorted(sent) == [("a", at(0)), ("b", at(6))]  # the deleted rule's rows are still in the input
    assert known() == {"b": False}


def test_rest_is_evaluated_once(spark, tmp_path):
    schema, sent = "rule_id string, ts timestamp, is_met boolean", []
    at = lambda i: T0 + dt.timedelta(minutes=i)
    deliver = lambda fired, _: sent.extend((r.rule_id, r.ts) for r in fired.collect())
    feed(spark, str(tmp_path / "in"), "a", [("r", at(0), False), ("r", at(1), True)], schema)
    watch(evaluations(spark, str(tmp_path / "in")), str(tmp_path / "state"), deliver, str(tmp_path / "log")).awaitTermination()
    rows = spark.createDataFrame([("r", at(0), False), ("r", at(1), True), ("r", at(2), False), ("r", at(3), True), ("s", at(1), True)], schema)
    watch_rest(rows, str(tmp_path / "state"), deliver)
    watch_rest(rows, str(tmp_path / "state"), deliver)
    assert sorted(sent) == [("r", at(1)), ("r", at(3)), ("s", at(1))]


def test_written_bars_are_compacted(spark, tmp_path):
    schema = "symbol string, ts timestamp, seq long, price double, qty double"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i in range(6):
        feed(spark, src, f"f{i}", [("A", T0 + dt.timedelta(hours=i), i, 10.0 + i, 1.0), ("A", T0 + dt.timedelta(hours=max(i - 1, 0), minutes=9), 100 + i, 50.0 + i, 1.0)], schema)
        ticks = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(src)
        upsert_bars(stream_bars(ticks), out, str(tmp_path / "log"), compact_every=2).awaitTermination()
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("batch=")]) <= 3
    bars = {r.ts: r for r in newest_bars(spark, out).collect()}
    assert len(bars) == 6 and bars[T0 + dt.timedelta(hours=2)].close == 53.0 and bars[T0 + dt.timedelta(hours=5)].close == 15.0
