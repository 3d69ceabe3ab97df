"""Streams whose parts are late, repeated, or nothing."""

from pyspark.sql import functions as F

from postflow.streaming import events

EVENT = "event_id bigint, ts timestamp, user_id bigint, event_type string"


def at(day, hour=0):
    import datetime as dt

    return dt.datetime(2024, 1, day, hour)


def test_state_lasts_over_parts_and_late_rows_are_dropped(spark):
    part = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    parts = [part((1, at(1), 7, "x")), part((2, at(1, 20), 7, "x"), (3, at(4), 7, "x")), part((4, at(1, 1), 7, "x"), (5, at(4, 3), 7, "x")), part((-1, at(28), -1, "end")), part((-1, at(29), -1, "end"))]
    daily = lambda df: events.late_by(df).groupBy(F.window("ts", "1 day").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.dayofmonth("w.start").alias("day"), "n")
    got = sorted((r["day"], r["n"]) for r in events.drained(parts, daily, "user_id >= 0").collect())
    assert got == [(1, 2), (4, 2)]


def test_a_pass_without_rows(spark):
    df = spark.createDataFrame([], "page_id bigint")
    assert events.in_passes(df, "page_id", lambda s: s).count() == 0


def test_counters(spark):
    seen = spark.createDataFrame([(1, 5, 1), (1, 5, 2), (1, 5, 9), (2, 5, 4), (1, 6, 9)], "key bigint, item bigint, at bigint")
    assert sorted(tuple(r) for r in events.missed_runs(seen).collect()) == [(1, 5, 1, -1), (1, 5, 2, 0), (1, 5, 9, 6), (1, 6, 9, -1), (2, 5, 4, -1)]


def test_a_truncated_run_retires_nothing(spark):
    rows = [(0, 1, 10, False), (0, 1, 11, False), (1, 1, 10, True), (2, 1, 10, False), (3, 2, 20, False), (4, 1, 10, False), (5, 1, 11, False)]
    got = {(r["board"], r["item"]): (r["missed"], r["is_active"]) for r in events.synced(spark.createDataFrame(rows[:6], "run bigint, board bigint, item bigint, truncated boolean")).collect()}
    assert got == {(1, 10): (0, True), (1, 11): (2, False), (2, 20): (0, True)}
    back = {(r["board"], r["item"]): (r["missed"], r["is_active"]) for r in events.synced(spark.createDataFrame(rows, "run bigint, board bigint, item bigint, truncated boolean")).collect()}
    assert back[(1, 11)] == (0, True) and back[(1, 10)] == (1, True)


SEEN = [(1, 5, 1), (1, 5, 2), (1, 5, 9), (2, 6, 9), (3, 7, 1), (3, 7, 5), (4, 8, 7)]


def test_items_are_retired_by_timers(spark):
    seen = spark.createDataFrame(SEEN, "key bigint, item bigint, at bigint")
    want = [(1, 5, 4), (3, 7, 3), (3, 7, 7), (4, 8, 9)]
    for parts in (1, 4):  # rows settle what was due before them, in whatever batch they come
        assert sorted(tuple(r) for r in events.retirements(seen, parts=parts).collect()) == want
    assert sorted(tuple(r) for r in events.missed_runs(seen, forget=4).collect() if r["at"] > 2) == [(1, 5, 9, -1), (2, 6, 9, -1), (3, 7, 5, 3), (4, 8, 7, -1)]


def test_state_of_forgotten_items_goes(spark, tmp_path):
    from postflow.streaming.states import Absences, keyed_state, processed

    left = []
    for at, keys in ((1, range(20)), (2, range(3)), (9, [50]), (10, [50])):
        spark.createDataFrame([(k, k, at) for k in keys], "key bigint, item bigint, at bigint").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows = spark.readStream.schema("key bigint, item bigint, at bigint").parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("at") * 86_400)).withWatermark("ts", "0 seconds")
        with keyed_state(spark):
            query = processed(rows, ["key", "item"], Absences(forget=4)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        left.append(query.lastProgress["stateOperators"][0]["customMetrics"].get("numValueStateVars") and query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert left[0] > left[-1] > 0


def test_cooldowns_end(spark, monkeypatch):
    from postflow.streaming.states import Breakers

    rows = [(1, at(1), 7, "error"), (2, at(1, 1), 7, "view"), (3, at(2), 7, "error"), (4, at(2), 7, "error"), (5, at(2), 8, "view"), (6, at(3), 8, "error")]
    whole = spark.createDataFrame(rows, EVENT)
    end = spark.createDataFrame([(-1, at(28), -1, "end")], EVENT)
    for parts in (1, 3):
        monkeypatch.setattr(events, "event_parts", lambda *_, n=parts: events.arrivals(whole, "ts", n, end))
        got = sorted((r["event_id"], r["kind"], r["streak"], r["cooldown"], r["at"].strftime("%d %H:%M")) for r in events.breaker_rows(spark, "", Breakers()).collect())
        assert got == [(1, "refused", 1, 60, "01 00:00"), (1, "released", 1, 60, "01 00:01"), (3, "refused", 1, 60, "02 00:00"), (4, "refused", 2, 120, "02 00:00"), (4, "released", 2, 120, "02 00:02"), (6, "refused", 1, 60, "03 00:00"), (6, "released", 1, 60, "03 00:01")]


def test_a_refusal_long_after_the_last(spark, monkeypatch):
    rows = [(1, at(1), 7, "error"), (2, at(20), 7, "error"), (3, at(1), 8, "view")]
    end = spark.createDataFrame([(-1, at(28), -1, "end")], EVENT)
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        monkeypatch.setattr(events, "event_parts", lambda *_: events.arrivals(spark.createDataFrame(rows, EVENT), "ts", 4, end))
        got = sorted((r["event_id"], r["streak"]) for r in events.breakers(spark, "").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [(1, 1), (2, 2)]


def test_runs_go_on_missing_a_retired_posting(spark):
    rows = [(0, 1, 10, False), *((k, 1, 11, False) for k in range(5))]
    got = {r["item"]: (r["missed"], r["is_active"]) for r in events.synced(spark.createDataFrame(rows, "run bigint, board bigint, item bigint, truncated boolean")).collect()}
    assert got == {10: (4, False), 11: (0, True)}


def test_items_of_a_range_are_one_state_and_one_timer():
    from pyspark.sql import Row

    from postflow.streaming.states import DAY_MS, Absences

    class Store:
        value, timers, calls = None, set(), 0

        def getValueState(self, *_):
            return self

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def clear(self):
            self.update(None)

        def registerTimer(self, at):
            self.calls += 1
            self.timers = self.timers | {at}

        def deleteTimer(self, at):
            self.timers = self.timers - {at}

    store, absences = Store(), Absences(forget=4)
    absences.init(store)
    seen = list(absences.handleInputRows((7, 0), iter([Row(item=i, at=1 + i % 2) for i in range(100)]), None))
    assert sorted((r["item"], r["at"], r["missed"]) for r in seen) == [(i, 1 + i % 2, -1) for i in range(100)]
    assert store.calls <= 3 and store.timers == {3 * DAY_MS}
    passed = Row(getCurrentWatermarkInMs=lambda: 3 * DAY_MS, getExpiryTimeInMs=lambda: 3 * DAY_MS)
    assert sorted(r["item"] for r in absences.handleExpiredTimer((7, 0), passed, passed)) == list(range(0, 100, 2))
    assert 4 * DAY_MS in store.timers and len(store.value[1]) == 100
