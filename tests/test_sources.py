"""Adapters, envelopes, ledger and answers on rows that the tables do not hold: malformed, empty, null."""

import json

from pyspark.sql import functions as F

from postflow.operators import extraction
from postflow.sources import adapters, envelopes, ledger


def sent(spark, source, payload, token="acme"):
    return spark.createDataFrame([("r1", source, token, "global", "2020-01-10T00:00:00", payload)], "run_key string, source string, token string, market string, fetched_at string, payload string")


def read(spark, source, payload):
    return adapters.ADAPTERS[source](sent(spark, source, payload if isinstance(payload, str) or payload is None else json.dumps(payload))).collect()


def test_payloads_of_other_shapes_give_nothing(spark):
    rows = [(s, p) for s in adapters.ADAPTERS for p in (None, "", "[]", "{}", "7", "<x", '{"jobs": 3, "data": {}, "pages": [4], "offers": null}')]
    df = spark.createDataFrame([("r1", s, "acme", "global", None, p) for s, p in rows], "run_key string, source string, token string, market string, fetched_at string, payload string")
    assert adapters.normalized(df).count() == 0


def test_a_bad_element_costs_only_itself(spark):
    jobs = [7, None, "x", [], {"id": 1}, {"title": "No id"}, {"id": 2, "title": "Good", "metadata": "none", "departments": 3}, {"id": 3, "title": " Also "}]
    assert [(r["external_id"], r["title"], r["company_name"]) for r in read(spark, "greenhouse", {"jobs": jobs})] == [("2", "Good", "acme"), ("3", "Also", "acme")]


def test_ashby_pay(spark):
    part = lambda **k: {"compensationType": "Salary"} | k
    tiers = [{"components": [part(minValue=90, currencyCode="EUR"), {"compensationType": "Equity", "minValue": 1}]}, {"components": [part(maxValue=120, interval="1 YEAR"), part(minValue=80, maxValue=100)]}, {}]
    row = read(spark, "ashby", {"jobs": [{"id": "a", "title": "T", "compensation": {"compensationTiers": tiers}}, {"id": "b", "title": "T", "isListed": False}]})[0]
    assert (row["salary_min"], row["salary_max"], row["salary_currency"], row["salary_period"], row["salary_is_stated"]) == (80.0, 120.0, "EUR", "annual", True)


def test_lever_body_falls_back(spark):
    row = read(spark, "lever", [{"id": "a", "text": "T", "description": "<p>All</p>", "createdAt": 1577836800000}])[0]
    assert (row["description_text"], str(row["posted_at"]), row["jd_completeness"]) == ("All", "2020-01-01 00:00:00", "snippet")


def test_html_cards(spark):
    page = '<div class="base-card" data-entity-urn="urn:x:9"><h3 class="base-search-card__title">Dev</h3></div><div class="base-card"></div>'
    row = read(spark, "linkedin", {"cards": [page, "<<<"], "details": {"9": "<div class='description__text'>Do<br>it</div>"}})
    assert [(r["external_id"], r["company_name"], r["description_text"], r["apply_url"]) for r in row] == [("9", "unknown", "Do\nit", "https://www.linkedin.com/jobs/view/9")]


def test_ledger_keeps_what_the_reader_wrote(spark, tmp_path):
    cards = spark.createDataFrame([(1, 0.5, "New", None), (3, None, "Third", None)], "job_id bigint, score double, title string, company string")
    for c in ("location", "work_model", "employment_type", "salary", "url", "source"):
        cards = cards.withColumn(c, F.lit(None).cast("string"))
    old = ledger.fresh_rows(cards.where("job_id = 1").withColumn("title", F.lit('Old, "quoted"')), "2020-01-01").withColumn("applied", F.lit("TRUE"))
    folder = str(tmp_path / "ledger")
    ledger.replace(old, folder)
    assert ledger.read(spark, folder).first()["title"] == 'Old, "quoted"'
    ledger.replace(ledger.upserted(ledger.read(spark, folder), ledger.fresh_rows(cards, "2020-02-02")), folder)
    rows = {r["job_id"]: r for r in ledger.read(spark, folder).collect()}
    assert (rows["1"]["title"], rows["1"]["applied"], rows["1"]["first_seen"], rows["1"]["last_seen"], rows["3"]["fit"]) == ("New", "TRUE", "2020-01-01", "2020-02-02", "")
    marked, missing = ledger.marked(ledger.read(spark, folder), spark.createDataFrame([("3",), ("8",)], "job_id string"))
    assert {r["job_id"]: r["applied"] for r in marked.collect()} == {"1": "TRUE", "3": "TRUE"} and [r[0] for r in missing.collect()] == ["8"]


def test_answers(spark):
    texts = [None, "", "no array", "[1, 2", '[{"job_id": 1, "score": 0.5}]', 'Sure: [{"job_id": "2", "score": 2}] bye', '{"result": "[{\\"job_id\\": 3, \\"score\\": 1}]"}', '{"batches": [{"jobs": [{"job_id": 4, "score": 0}]}]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    printed = envelopes.valid_verdicts(envelopes.printed_items(df, "t"))
    shaped = envelopes.valid_verdicts(envelopes.verdict_items(df, "t"))
    assert sorted(r["job_id"] for r in printed.collect()) == [1, 3]
    assert sorted(r["job_id"] for r in shaped.collect()) == [1, 4]


def test_extraction_without_pages(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "stub", "<html></html>", " by hand ")], "id int, description_text string, html string, pasted string")
    assert [(r["rung"], r["body"]) for r in extraction.filled(df).orderBy("id").collect()] == [(None, None), ("manual_paste", "by hand")]


def test_an_answer_is_parsed_once(spark):
    texts = ['{"verdicts": {"a": 1}, "jobs": [{"job_id": 1, "score": 0.5}, [], "x", null, 7]}', '{"batches": [7, null, {"scores": [{"job_id": 2, "score": 1e0}]}, [{"job_id": "3", "score": "0.25"}]]}', '{"jobs": [{"job_id": 4}', "null", "[[]]", '{"batches": "none"}', '[{"job_id": 5, "score": 0.1, "reasoning": " why ", "red_flags": ["a", "b"]}]']
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(1)
    items = envelopes.verdict_items(df, "t")
    got = sorted((r["job_id"], r["score"], r["reasoning"], r["red_flags"]) for r in envelopes.valid_verdicts(items).collect())
    assert got == [(1, 0.5, "", None), (2, 1.0, "", None), (3, 0.25, "", None), (5, 0.1, "why", ["a", "b"])]
    plan = items._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson(") == 1


def plan_of(spark, df):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", 1000)
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


def test_texts_are_made_of_postings_that_stay(spark):
    sent = spark.range(2).select(*(F.concat(F.lit(c), "id").alias(c) for c in ("run_key", "source", "token", "market", "fetched_at", "payload")))
    for name in ("workable_search", "techcareer", "careerjet"):
        below = plan_of(spark, adapters.ADAPTERS[name](sent).select("description_text")).split("Window [")[-1]
        assert "from_json" in below and "<[^>]*>" not in below


def test_rows_for_python_are_sent_in_batches_bounded_by_bytes(spark):
    from postflow.operators.storage import BATCH_BYTES, saved_in_small_batches

    size = F.pandas_udf(lambda batch: batch.map(lambda _: len(batch)), "long")
    before = spark.conf.get(BATCH_BYTES)
    rows = spark.range(0, 300, 1, 1).select(size(F.repeat(F.lit("x"), 100_000 + F.col("id").cast("int"))).alias("n"))
    found = saved_in_small_batches(rows, "2m").agg(F.max("n"), F.count("n")).first()
    assert found[0] <= 25 and found[1] == 300 and spark.conf.get(BATCH_BYTES) == before


def test_texts_and_pages_go_through_python_once_and_in_small_batches(spark):
    from postflow.queries import QUERIES

    for name in ("n08_hamming", "n12_html_markdown"):
        assert "ArrowEvalPython" not in plan_of(spark, QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_an_element_is_read_once(spark):
    """Filters on what an element says do not read it again."""
    plan = adapters.ADAPTERS["workable_search"](sent(spark, "workable_search", "{}"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 2
