"""Phrase tables and stored sketches."""

import random
import re

from pyspark.sql import functions as F

from postflow.operators import phrases, sketches


def test_five_thousand_phrases_in_one_plan(spark):
    r = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("", "x", "é", "_1")]
    told = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 4))).title()) for i in range(5000)]
    texts = [(i, "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "-", "/"]) for _ in range(60))) for i in range(30)] + [(30, None), (31, ""), (32, "ax")]
    table = spark.createDataFrame([*told, (9000, None), (9001, " ?! ")], "phrase_id bigint, phrase string")
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    want = {}
    for doc_id, text in texts:
        own = words(text)
        grams = [tuple(own[i : i + k]) for k in (1, 2, 3) for i in range(len(own) - k + 1)]
        for phrase_id, phrase in told:
            n = grams.count(tuple(words(phrase)))
            if n:
                want[doc_id, phrase_id] = n
    for limit in (phrases.CHUNK, 20_000):
        found = phrases.found_in(docs, table, "doc_id", "text", limit)
        assert {(r["doc_id"], r["phrase_id"]): r["times"] for r in found.collect()} == want
    plan = phrases.found_in(docs, table, "doc_id", "text")._jdf.queryExecution().toString()
    assert len(plan) < 20_000 and phrases.found_in(docs, table.limit(0), "doc_id", "text").count() == 0


def test_sketches_of_runs_add_up(spark, tmp_path):
    folder = str(tmp_path / "sketches")
    rows = lambda low, high: spark.range(low, high).select((F.col("id") % 2).alias("g"), F.col("id").alias("item"))
    sketches.add_run(rows(0, 30_000), folder, "1", ["g"], "item")
    sketches.add_run(rows(20_000, 50_000), folder, "2", ["g"], "item")
    sketches.add_run(rows(20_000, 50_000), folder, "2", ["g"], "item")  # a run that is written again replaces itself
    total, first = sketches.totals(spark, folder, ["g"]), sketches.totals(spark, folder, ["g"], F.col("run") == 1)
    for r in total.select("g", sketches.estimate("sketch").alias("n")).collect():
        assert abs(r["n"] - 25_000) < 3 * 25_000 / 64
    for r in sketches.gained(total, first, ["g"]).collect():
        assert abs(r["gained"] - 10_000) < 3 * 25_000 / 64
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in plan and "= 1)]" in plan  # other runs are not read
    small = rows(0, 100)
    sketches.add_run(small, str(tmp_path / "small"), "1", ["g"], "item")
    assert [r[0] for r in sketches.totals(spark, str(tmp_path / "small"), ["g"]).select(sketches.estimate("sketch")).collect()] == [50, 50]
