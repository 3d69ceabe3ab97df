"""What a sync leaves on disk, and the numbers that it gives by itself."""

from pathlib import Path

from pyspark.sql import functions as F

from postflow.operators.lifecycle import upserted
from postflow.operators.storage import SHUFFLES_GO, scratch, shared_folder
from postflow.sources import logs
from postflow.streaming import events
from postflow.streaming.sync import STORED, Sync


def test_a_sync_leaves_its_runs_and_its_store(spark):
    """Items far apart share an envelope; tables that a batch needs for a while are empty afterwards, the session's setting is back."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    rows = lambda: {p.parent for p in folder.rglob("*.parquet") if "/store-" not in str(p) and spark.read.parquet(str(p)).count()}
    before, runs, set_before = rows(), set(folder.glob("runs-*")), spark.conf.get(SHUFFLES_GO, None)
    seen = spark.range(40).select(F.lit(0).cast("bigint").alias("run"), (F.col("id") % 2).alias("board"), (F.col("id") * 1_000_000).alias("item"), F.lit(False).alias("truncated"))
    assert events.synced(seen, page=15).count() == 40
    (raw,) = set(folder.glob("runs-*")) - runs
    sent = logs.envelopes_at(spark, str(raw)).select("token", F.size(F.from_json("payload", "array<string>")).alias("n")).collect()
    assert sorted(tuple(r) for r in sent) == [("0", 5), ("0", 15), ("1", 5), ("1", 15)]
    assert rows() == before and spark.conf.get(SHUFFLES_GO, None) == set_before


def test_numbers_of_a_run_are_its_own(spark, tmp_path):
    """Without a number of their own, postings of a run get different keys, the same when they are played again; equal titles of many boards are one cluster."""
    listed = lambda df: events.listed_items(df).withColumns({"title": F.concat(F.lit("T"), F.col("external_id"))})
    sync = Sync(spark, str(tmp_path / "store"), listed)
    envelopes = spark.createDataFrame([("r1", "items", "items", f"b{k}", "global", None, None, str(list(range(k + 1))), False, False) for k in range(30)], logs.ENVELOPE)
    got = []
    for _ in range(2):
        sync.take(envelopes, 0)
        got.append(sorted((r["id"], r["key"], r["head"]) for r in sync.stored().collect()))
    assert got[0] == got[1] and len({k for _, k, _ in got[0]}) == len(got[0]) == 30 * 31 // 2
    heads = {}
    for i, _, head in got[0]:
        heads.setdefault(i.split("|")[-1], set()).add(head)
    assert all(len(h) == 1 for h in heads.values()) and "content_hash" not in STORED


def test_outcomes_without_stored_hashes(spark):
    fields = "id string, title string, location_raw string, description_html string, description_text string, description_md string, description_lang string, jd_completeness string, jd_source string, jd_extracted_at string, description_hash string, salary_min double, salary_max double, salary_currency string, salary_period string, salary_is_stated boolean, poster_name string, poster_profile_url string"
    row = lambda i, title: (i, title, None, *[None] * 8, *[None] * 4, False, None, None)
    stored = spark.createDataFrame([row("a", "Dev"), row("b", "Dev"), row("c", "Dev"), row("d", None)], fields).withColumns({"repost_count": F.lit(0), "missed_runs": F.lit(0), "is_active": F.lit(True)})
    listed = spark.createDataFrame([row("a", "Dev"), row("b", " dev"), row("e", "Dev"), row("c", "Lead"), row("d", "")], fields)
    got = {r["id"]: r["outcome"] for r in upserted(stored, listed).collect()}
    assert got == {"a": "unchanged", "b": "unchanged", "c": "updated", "d": "unchanged", "e": "new"}


def test_scratch_tables_go(spark):
    with scratch(spark) as tables:
        kept, freed = tables.saved(spark.range(5)), tables.saved(spark.range(7))
        tables.free(freed, spark.range(3))
        assert kept.count() == 5 and len(tables.paths) == 1
    assert not tables.paths
