"""Envelopes and the event log as data sources, and the sync that takes them run by run."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from postflow.sources import logs
from postflow.sources.adapters import ADAPTERS
from postflow.sources.envelopes import write_envelopes
from postflow.streaming.sync import Sync


def envelope(run, token, jobs, cut=False, source="greenhouse"):
    return (run, source, source, token, "global", None, None, json.dumps({"jobs": [{"id": i, "title": t, "company_name": c} for i, t, c in jobs]}), cut, False)


def sent(spark, folder, *rows):
    write_envelopes(spark.createDataFrame(list(rows), logs.ENVELOPE), folder)


def test_filters_choose_folders_and_broken_lines_are_dropped(spark, tmp_path):
    raw = str(tmp_path / "raw")
    sent(spark, raw, *[envelope(r, f"b{i}", [], source=s) for r in ("r1", "r2", "r3") for s in ("lever", "ashby") for i in range(2)])
    (tmp_path / "raw/source=lever/run_key=r1/broken.json").write_text('{"token": "half\n[]\n7\n{"token": 5, "board_id": "x", "truncated": "yes", "extra": 1}')
    one = logs.envelopes_at(spark, raw, F.col("run_key").isin("r2", "r3") & (F.col("source") == "ashby") & (F.col("token") != "b0"))
    assert sorted((r["run_key"], r["source"], r["token"]) for r in one.collect()) == [("r2", "ashby", "b1"), ("r3", "ashby", "b1")]
    whole, part = logs.envelopes_at(spark, raw), logs.envelopes_at(spark, raw, F.col("source") == "lever")
    assert whole.rdd.getNumPartitions() > part.rdd.getNumPartitions() > one.rdd.getNumPartitions() >= 1
    odd = part.where("token = '5'").collect()
    assert len(odd) == 1 and odd[0]["board_id"] is None and odd[0]["truncated"] is None and part.count() == 7
    assert logs.envelopes_at(spark, str(tmp_path / "none")).count() == 0


def test_a_log_reader_stops_and_resumes(spark, tmp_path):
    log, out = str(tmp_path / "log"), []

    def drain():
        got = []
        stream = logs.event_stream(spark, log, "seq bigint, kind string", cap=12).writeStream.option("checkpointLocation", str(tmp_path / "state"))
        stream.trigger(availableNow=True).foreachBatch(lambda df, _: got.extend(r["seq"] for r in df.collect())).start().awaitTermination()
        out.append(sorted(got))

    for low, high in ((1, 26), (26, 29), (29, 29), (29, 60)):
        logs.append_events(spark.range(low, high).select(F.col("id").alias("seq"), F.lit("e").alias("kind")), log, 10)
        drain()
    assert out == [list(range(14, 26)), [26, 27, 28], [], list(range(48, 60))]  # what is older than the newest twelve is gone
    tail = spark.read.format("eventlog").schema("seq bigint, kind string").option("since", 55).load(log)
    assert sorted(r["seq"] for r in tail.collect()) == [56, 57, 58, 59]


def stored(sync):
    return {r["id"].split("|")[-1]: (r["title"], r["first_run"], r["last_run"], r["missed_runs"], r["is_active"], r["repost_count"], r["head"] & 0xFFFF) for r in sync.stored().collect()}


def versions(folder):
    return sorted((int(p.parent.name.split("=")[1]), int(p.name.split("=")[1])) for p in Path(folder).glob("postings/batch=*/bucket=*"))


def test_sync_run_by_run(spark, tmp_path):
    raw, folder = str(tmp_path / "raw"), str(tmp_path / "store")
    sync = Sync(spark, folder, ADAPTERS["greenhouse"], number=F.col("external_id").cast("bigint"))
    boards = [envelope("r1", f"b{k}", [(100 + k, f"T{k}", "C")]) for k in range(12)]
    sent(spark, raw, envelope("r1", "a", [(1, "Dev", "Acme"), (2, "Ops", "Acme"), (3, "dev ", "ACME")]), *boards)
    sync.drain(raw)
    got = stored(sync)
    assert got["1"] == ("Dev", "r1", "r1", 0, True, 0, 1) and got["3"][-1] == 1 and got["2"][-1] == 2 and len(got) == 15
    first = versions(folder)

    sent(spark, raw, envelope("r2", "a", [(1, "Dev", "Acme")], cut=True))
    sent(spark, raw, envelope("r3", "a", [(1, "Dev", "Acme"), (4, "Ops", "Acme")]))
    sync.drain(raw)  # two runs in one batch; the first was cut short
    got = stored(sync)
    assert got["2"][3:5] == (1, True) and got["4"] == ("Ops", "r3", "r3", 0, True, 0, 2) and got["1"][2] == "r3" and len(got) == 16
    wrote = [v for v in versions(folder) if v not in first]
    assert len(wrote) == 1  # one board, one bucket

    sent(spark, raw, envelope("r4", "a", [(1, "Lead", "Acme")]))
    sync.drain(raw)
    got = stored(sync)
    assert got["2"][3:5] == (2, False) and got["3"][3:5] == (2, False) and got["4"][3:5] == (1, True)
    assert got["1"][0] == "Lead" and got["1"][-1] == 1 and got["3"][-1] == 3  # it left its block, whose next record is a head now

    last = spark.read.schema(logs.ENVELOPE).json(f"{raw}/source=greenhouse/run_key=r4").withColumns({"source": F.lit("greenhouse"), "run_key": F.lit("r4")}).select(*[c.split()[0] for c in logs.ENVELOPE.split(", ")])
    before = versions(folder)
    sync.take(last, max(k for k, _ in before))  # the batch is played again
    assert stored(sync) == got and versions(folder) == before

    sent(spark, raw, envelope("r5", "a", [(2, "Ops", "Acme")]))
    sync.drain(raw)
    assert stored(sync)["2"][3:6] == (0, True, 1)  # back after it was retired
