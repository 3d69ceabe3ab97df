"""Aggregations and per-key ordered operators of the posting pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from postflow.operators import sketches
from postflow.operators.storage import saved, shared_folder
from postflow.queries.registry import Family
from postflow.queries.relational import TOKENS_SQL, WANTED_SQL, active_canonical, cluster, relevant, scored, tokens
from postflow.sources.bindings import applications, boards, companies, jobs, listings, table, titles

family = Family()
QUERIES, ORACLE, add = family.QUERIES, family.ORACLE, family.add


@add(
    "a01_counts",
    "SELECT count(*) AS jobs, count(*) FILTER (WHERE is_active) AS active, count(*) FILTER (WHERE is_active AND canonical_id = id) AS canonical, count(DISTINCT company_id) AS companies, count(*) FILTER (WHERE is_active) - count(*) FILTER (WHERE is_active AND canonical_id = id) AS clustered_away FROM jobs",
)
def a01(spark, d):
    active, canonical = F.count_if("is_active"), F.count_if(active_canonical())
    return jobs(spark, d).agg(F.count("*").alias("jobs"), active.alias("active"), canonical.alias("canonical"), F.count_distinct("company_id").alias("companies"), (active - canonical).alias("clustered_away"))


@add("a02_by_market", "SELECT market, count(*) AS n FROM jobs WHERE is_active GROUP BY 1")
def a02(spark, d):
    return jobs(spark, d).where("is_active").groupBy("market").agg(F.count("*").alias("n"))


@add("a03_boards", "SELECT provider, status, tier, count(*) AS n FROM boards GROUP BY 1, 2, 3")
def a03(spark, d):
    return boards(spark, d).groupBy("provider", "status", "tier").agg(F.count("*").alias("n"))


@add("a04_by_source", "SELECT source, count(*) AS n FROM jobs WHERE is_active GROUP BY 1")
def a04(spark, d):
    return jobs(spark, d).where("is_active").groupBy("source").agg(F.count("*").alias("n"))


RESPONDED = ("screening", "interview", "offer", "rejected")


@add(
    "a05_response_rate",
    "SELECT market, count(*) AS applied, count(*) FILTER (WHERE status IN ('screening','interview','offer','rejected')) AS responded, round(count(*) FILTER (WHERE status IN ('screening','interview','offer','rejected')) / count(*), 6) AS rate FROM applications JOIN jobs ON job_id = id WHERE status <> 'skipped' GROUP BY 1",
)
def a05(spark, d):
    df = applications(spark, d).where("status <> 'skipped'").join(jobs(spark, d).withColumnRenamed("id", "job_id"), "job_id")
    responded = F.count_if(F.col("status").isin(*RESPONDED))
    return df.groupBy("market").agg(F.count("*").alias("applied"), responded.alias("responded"), F.round(F.try_divide(responded, F.count("*")), 6).alias("rate"))


@add("a06_applied_by_market", "SELECT market, count(*) AS n FROM applications JOIN jobs ON job_id = id WHERE status <> 'skipped' GROUP BY 1")
def a06(spark, d):
    df = applications(spark, d).where("status <> 'skipped'").join(jobs(spark, d).withColumnRenamed("id", "job_id"), "job_id")
    return df.groupBy("market").agg(F.count("*").alias("n"))


@add(
    "a07_applied_by_week",
    "SELECT year, week, count(*) AS n FROM (SELECT isoyear(applied_at) AS year, week(applied_at) AS week FROM (SELECT * FROM applications ORDER BY applied_at DESC, job_id DESC LIMIT 200)) GROUP BY 1, 2 ORDER BY year DESC, week DESC LIMIT 6",
)
def a07(spark, d):
    last = applications(spark, d).orderBy(F.desc("applied_at"), F.desc("job_id")).limit(200)
    weeks = last.groupBy(F.extract(F.lit("yearofweek"), "applied_at").cast("bigint").alias("year"), F.weekofyear("applied_at").cast("bigint").alias("week"))
    return weeks.agg(F.count("*").alias("n")).orderBy(F.desc("year"), F.desc("week")).limit(6)


SUGGESTIONS = ("ring", "plate", "bolt", "widget", "gear")


@add("a08_suggestion_sums", "SELECT s AS suggestion, count(*) FILTER (WHERE contains(lower(title), s)) AS n FROM titles, (SELECT unnest(['ring','plate','bolt','widget','gear']) AS s) GROUP BY 1")
def a08(spark, d):
    """All counts in one pass, then turned to rows."""
    one = titles(spark, d).agg(*[F.count_if(F.lower("title").contains(s)).alias(s) for s in SUGGESTIONS])
    return one.unpivot([], list(SUGGESTIONS), "suggestion", "n")


@add(
    "a09_country_rollup",
    "+ c AS (SELECT country, region, count(*) AS n FROM jobs JOIN companies USING (company_id) GROUP BY 1, 2) SELECT country AS place, n FROM c UNION ALL SELECT r_name, CAST(sum(n) AS BIGINT) FROM c JOIN region ON region = r_regionkey GROUP BY 1",
)
def a09(spark, d):
    counts = jobs(spark, d).join(companies(spark, d), "company_id").groupBy("country", "region").agg(F.count("*").alias("n"))
    regions = counts.join(table(spark, d, "region").withColumnRenamed("r_regionkey", "region"), "region")
    return counts.select(F.col("country").alias("place"), "n").unionByName(regions.groupBy(F.col("r_name").alias("place")).agg(F.sum("n").alias("n")))


@add("a10_generation", "SELECT max(id) AS last_id, count(*) FILTER (WHERE is_active) AS active FROM jobs")
def a10(spark, d):
    return jobs(spark, d).agg(F.max("id").alias("last_id"), F.count_if("is_active").alias("active"))


@add("a13_outcomes", "SELECT CASE WHEN id % 4 = 0 THEN 'new' WHEN id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS outcome, count(*) AS n FROM jobs GROUP BY 1")
def a13(spark, d):
    outcome = F.when(F.col("id") % 4 == 0, "new").when(F.col("id") % 5 == 0, "updated").otherwise("unchanged")
    return jobs(spark, d).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@add("a14_run_status", "SELECT provider, ['ok','degraded','failed'][max(errors) + 1] AS status FROM boards GROUP BY 1")
def a14(spark, d):
    worst = F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("failed")), F.max("errors") + 1)
    return boards(spark, d).groupBy("provider").agg(worst.alias("status"))


@add("a15_cluster_sizes", "SELECT coalesce(canonical_id, id) AS cluster, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS also_on FROM jobs GROUP BY 1 HAVING count(*) > 1")
def a15(spark, d):
    df = jobs(spark, d).groupBy(cluster().alias("cluster")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("also_on"))
    return df.where("n > 1")


@add(
    "a16_component_bounds",
    "SELECT id, list_min(v) AS low, list_max(v) AS high FROM (SELECT id, list_filter([salary_max, CASE WHEN id % 3 = 0 THEN salary_max * 0.5::DOUBLE END, CASE WHEN id % 4 = 0 THEN 0::DOUBLE END], lambda x: x > 0) AS v FROM jobs)",
)
def a16(spark, d):
    pay = F.col("salary_max")
    parts = F.array(pay, F.when(F.col("id") % 3 == 0, pay * 0.5), F.when(F.col("id") % 4 == 0, F.lit(0.0)))
    known = F.filter(parts, lambda x: x > 0)
    return jobs(spark, d).select("id", F.array_min(known).alias("low"), F.array_max(known).alias("high"))


@add("a17_first_known", "SELECT company_id, arg_min(salary_currency, id) FILTER (WHERE salary_currency IS NOT NULL) AS currency FROM jobs GROUP BY 1")
def a17(spark, d):
    known = F.when(F.col("salary_currency").isNotNull(), F.col("id"))
    return jobs(spark, d).groupBy("company_id").agg(F.min_by("salary_currency", known).alias("currency"))


@add("a18_new_by_provider", "SELECT provider, count(*) AS n FROM boards WHERE board_id NOT IN (SELECT board_id FROM listings WHERE run < DATE '1994-01-01') GROUP BY 1")
def a18(spark, d):
    known = listings(spark, d).where("run < date'1994-01-01'").select("board_id").distinct()
    return boards(spark, d).join(known, "board_id", "left_anti").groupBy("provider").agg(F.count("*").alias("n"))


@add("a19_word_bag", f"SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS word FROM documents) GROUP BY 1 HAVING count(*) >= 20")
def a19(spark, d):
    return table(spark, d, "documents").select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n >= 20")


@add(
    "a20_budgets",
    "SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS today, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS week, count(*) AS lifetime FROM events WHERE event_type IN ('click','signup') GROUP BY 1",
)
def a20(spark, d):
    df = table(spark, d, "events").where(F.col("event_type").isin("click", "signup"))
    since = lambda day: F.count_if(F.col("ts") >= F.lit(day).cast("timestamp_ntz"))
    return df.groupBy("user_id").agg(since("2024-01-30").alias("today"), since("2024-01-24").alias("week"), F.count("*").alias("lifetime"))


@add("a21_last_send", "SELECT user_id, event_type, max(ts) AS last_ts FROM events GROUP BY 1, 2")
def a21(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("last_ts"))


@add(
    "a22_relevant_delta",
    f"SELECT provider, count(*) AS n FROM boards WHERE board_id IN (SELECT board_id FROM listings WHERE job_id IN (SELECT id FROM titles WHERE {WANTED_SQL})) AND board_id NOT IN (SELECT board_id FROM listings WHERE job_id IN (SELECT id FROM titles WHERE title = 'red ring') AND run < DATE '1996-01-01') GROUP BY 1",
)
def a22(spark, d):
    before = listings(spark, d).where("run < date'1996-01-01'").join(titles(spark, d).where("title = 'red ring'").select(F.col("id").alias("job_id")), "job_id", "left_semi")
    gained = relevant(spark, d).join(before.select("board_id").distinct(), "board_id", "left_anti")
    return boards(spark, d).join(gained, "board_id", "left_semi").groupBy("provider").agg(F.count("*").alias("n"))


@add(
    "a23_distinct_tokens",
    "SELECT tld, count(DISTINCT host) AS hosts FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+[.]([a-z]+)/', 1) AS tld FROM pages) GROUP BY 1",
)
def a23(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), F.regexp_extract("url", "://[^/]+[.]([a-z]+)/", 1).alias("tld"))
    return pages.groupBy("tld").agg(F.count_distinct("host").alias("hosts"))


@add(
    "a23_sketched_totals",
    "+ y AS (SELECT provider, job_id, year(run) AS y FROM listings JOIN boards USING (board_id)), b AS (SELECT provider, count(DISTINCT job_id) AS n, count(DISTINCT job_id) FILTER (WHERE y < 1997) AS o FROM y GROUP BY 1) SELECT provider, n AS postings, n - o AS gained, true AS total_near, true AS gain_near FROM b",
)
def a23_sketched_totals(spark, d):
    """Distinct postings of each provider and those gained since 1997, exactly and by sketches of each year; whether the sketches' answers are within their bounds (three standard errors)."""
    seen = saved(listings(spark, d).join(boards(spark, d).select("board_id", "provider"), "board_id").select("provider", "job_id", F.year("run").alias("year")))
    folder = f"{shared_folder(spark)}/sketches-{uuid.uuid4().hex}"
    for (year,) in seen.select("year").distinct().collect():
        sketches.add_run(seen.where(F.col("year") == year), folder, str(year), ["provider"], "job_id")
    total = sketches.totals(spark, folder, ["provider"])
    gain = sketches.gained(total, sketches.totals(spark, folder, ["provider"], F.col("run") < 1997), ["provider"])
    exact = seen.groupBy("provider").agg(F.count_distinct("job_id").alias("postings"), F.count_distinct(F.when(F.col("year") < 1997, F.col("job_id"))).alias("old"))
    bound = 3 * F.col("postings") / F.sqrt(F.lit(float(1 << sketches.LG)))
    df = exact.join(total.select("provider", sketches.estimate("sketch").alias("about")), "provider").join(gain.withColumnRenamed("gained", "about_gained"), "provider")
    own = F.col("postings") - F.col("old")
    return df.select("provider", "postings", own.alias("gained"), (F.abs(F.col("about") - F.col("postings")) <= bound).alias("total_near"), (F.abs(F.col("about_gained") - own) <= bound).alias("gain_near"))


@add("a24_gate_population", "SELECT lang, count(*) FILTER (WHERE length(trim(text)) >= 400) AS long_enough, count(*) AS n FROM documents GROUP BY 1")
def a24(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count_if(F.length(F.trim("text")) >= 400).alias("long_enough"), F.count("*").alias("n"))


@add("a25_bar_counts", "SELECT market, count(*) FILTER (WHERE llm_score >= 0.65) AS above, count(*) FILTER (WHERE llm_score < 0.65) AS near_miss FROM jobs JOIN scores ON id = job_id AND profile = market GROUP BY 1")
def a25(spark, d):
    return scored(spark, d).groupBy("market").agg(F.count_if(F.col("llm_score") >= 0.65).alias("above"), F.count_if(F.col("llm_score") < 0.65).alias("near_miss"))


# ordered operators


@add(
    "w01_latest_run",
    "SELECT source, arg_max(id, id) AS id, max(first_seen_at) FILTER (WHERE true) AS at FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY id DESC) AS rn FROM (SELECT * FROM jobs ORDER BY id DESC LIMIT 200)) WHERE rn = 1 GROUP BY 1",
)
def w01(spark, d):
    last = jobs(spark, d).orderBy(F.desc("id")).limit(200)
    return last.groupBy("source").agg(F.max("id").alias("id"), F.max_by("first_seen_at", "id").alias("at"))


@add(
    "w02_company_cap",
    """+ pre AS (SELECT id, coalesce(company_id, -id) AS k, llm_score FROM jobs JOIN scores ON id = job_id AND profile = market WHERE passed ORDER BY llm_score DESC NULLS LAST, id DESC LIMIT 400),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY llm_score DESC NULLS LAST, id DESC) AS rn FROM pre),
    c AS (SELECT *, coalesce(sum(CASE WHEN rn <= 3 THEN 1 ELSE 0 END) OVER (ORDER BY llm_score DESC NULLS LAST, id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r)
    SELECT id, CASE WHEN rn <= 3 THEN 'chosen' ELSE 'held' END AS fate FROM c WHERE before < 50""",
)
def w02(spark, d, limit=50, per_company=3):
    """At most three of a company, until the limit; the list is fetched eight times over, so the windows run on a bounded list."""
    order = [F.desc_nulls_last("llm_score"), F.desc("id")]
    pre = scored(spark, d).where("passed").select("id", F.coalesce("company_id", -F.col("id")).alias("k"), "llm_score").orderBy(*order).limit(limit * 8)
    ranked = pre.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)))
    taken = F.coalesce(F.sum(F.when(F.col("rn") <= per_company, 1).otherwise(0)).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranked.withColumn("before", taken).where(F.col("before") < limit).select("id", F.when(F.col("rn") <= per_company, "chosen").otherwise("held").alias("fate"))


@add("w03_cluster_head", "SELECT coalesce(canonical_id, id) AS cluster, arg_min(id, first_seen_at::VARCHAR || lpad(id::VARCHAR, 12, '0')) AS head FROM jobs GROUP BY 1")
def w03(spark, d):
    return jobs(spark, d).groupBy(cluster().alias("cluster")).agg(F.min_by("id", F.struct("first_seen_at", "id")).alias("head"))


@add("w04_first_spelling", "SELECT lower(market || segment) AS key, arg_min(market || segment, id) AS spelling FROM jobs JOIN companies USING (company_id) GROUP BY 1")
def w04(spark, d):
    df = jobs(spark, d).join(companies(spark, d), "company_id").withColumn("x", F.concat("market", "segment"))
    return df.groupBy(F.lower("x").alias("key")).agg(F.min_by("x", "id").alias("spelling"))


@add(
    "w05_ordered_distinct",
    "SELECT id, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ', ') AS place FROM (SELECT id, [coalesce(country, '?'), coalesce(segment, '?'), coalesce(country, '?')] AS p FROM jobs LEFT JOIN companies USING (company_id))",
)
def w05(spark, d):
    df = jobs(spark, d).join(companies(spark, d), "company_id", "left")
    known = lambda c: F.coalesce(c, F.lit("?"))
    return df.select("id", F.array_join(F.array_distinct(F.array(known("country"), known("segment"), known("country"))), ", ").alias("place"))


@add("w06_page_drift", "SELECT job_id, board_id, run FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY run, board_id) AS rn FROM listings) WHERE rn = 1")
def w06(spark, d):
    first = F.min(F.struct("run", "board_id")).alias("x")
    return listings(spark, d).groupBy("job_id").agg(first).select("job_id", "x.board_id", "x.run")


def run_numbers(spark, d):
    """(run, nth): all runs in their order."""
    return listings(spark, d).select("run").distinct().withColumn("nth", F.row_number().over(Window.orderBy("run")))


def numbered(spark, d):
    """(board_id, job_id, run, nth): listings with the number of their run among all runs, whoever was listed in them."""
    return listings(spark, d).distinct().join(F.broadcast(run_numbers(spark, d)), "run")


RUNS_SQL = "runs AS (SELECT run, row_number() OVER (ORDER BY run) AS nth FROM (SELECT DISTINCT run FROM listings)), seen AS (SELECT DISTINCT board_id, job_id, run, nth FROM listings JOIN runs USING (run))"


@add(
    "w07_missed_runs",
    f"+ {RUNS_SQL}, g AS (SELECT *, coalesce(lead(nth) OVER w, (SELECT max(nth) FROM runs) + 1) - nth - 1 AS missed, lag(nth) OVER w AS before FROM seen WINDOW w AS (PARTITION BY board_id, job_id ORDER BY nth)) SELECT board_id, job_id, run, missed, missed < 2 AS stayed, coalesce(nth - before > 2, false) AS reposted FROM g",
)
def w07(spark, d, grace=2):
    """For each time that a board listed a posting: the runs in a row that missed it afterwards, whether it stayed active, and whether this listing brought it back."""
    seen = numbered(spark, d)
    by = Window.partitionBy("board_id", "job_id").orderBy("nth")
    last = seen.agg(F.max("nth")).first()[0] or 0
    df = seen.withColumns({"missed": F.coalesce(F.lead("nth").over(by), F.lit(last + 1)) - F.col("nth") - 1, "before": F.lag("nth").over(by)})
    return df.select("board_id", "job_id", "run", F.col("missed").cast("bigint").alias("missed"), (F.col("missed") < grace).alias("stayed"), F.coalesce(F.col("nth") - F.col("before") > grace, F.lit(False)).alias("reposted"))


@add(
    "w08_error_streak",
    f"+ {RUNS_SQL}, good AS (SELECT board_id, nth FROM (SELECT board_id, nth, count(*) AS n FROM seen GROUP BY 1, 2) WHERE n >= 5), e AS (SELECT board_id, nth FROM good UNION ALL SELECT board_id, x FROM boards, (SELECT unnest([0, (SELECT max(nth) FROM runs) + 1]) AS x)),"
    " g AS (SELECT board_id, lead(nth) OVER (PARTITION BY board_id ORDER BY nth) - nth - 1 AS streak FROM e), m AS (SELECT board_id, max(streak) AS worst FROM g GROUP BY 1) SELECT board_id, worst, worst >= CASE WHEN status = 'candidate' THEN 1 ELSE 3 END AS died FROM m JOIN boards USING (board_id)",
)
def w08(spark, d, dead_at=3, least=5):
    """The longest row of failed runs of each board. A run fails that lists fewer than `least` postings there, or none at all; a candidate dies at the first."""
    seen = numbered(spark, d)
    good = seen.groupBy("board_id", "nth").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("board_id", "nth")
    last = seen.agg(F.max("nth")).first()[0] or 0
    ends = boards(spark, d).select("board_id", F.explode(F.array(F.lit(0), F.lit(last + 1))).alias("nth"))
    by = Window.partitionBy("board_id").orderBy("nth")
    gaps = good.unionByName(ends).select("board_id", (F.lead("nth").over(by) - F.col("nth") - 1).cast("bigint").alias("streak"))
    worst = gaps.groupBy("board_id").agg(F.max("streak").alias("worst"))
    limit = F.when(F.col("status") == "candidate", 1).otherwise(dead_at)
    return worst.join(boards(spark, d).select("board_id", "status"), "board_id").select("board_id", "worst", (F.col("worst") >= limit).alias("died"))


@add(
    "w09_relevant_prefix",
    """+ s AS (SELECT conv_id, turn, len(text) AS n FROM conversations WHERE contains(text, 'e')), r AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM s)
    SELECT conv_id, count(*) AS lines, CAST(max(upto) AS BIGINT) AS chars FROM r WHERE upto <= 1200 GROUP BY 1""",
)
def w09(spark, d, limit=1200):
    df = table(spark, d, "conversations").where(F.col("text").contains("e"))
    upto = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn("upto", upto).where(F.col("upto") <= limit).groupBy("conv_id").agg(F.count("*").alias("lines"), F.max("upto").alias("chars"))


@add(
    "w10_line_budget",
    """+ l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    r AS (SELECT doc_id, pos, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l) SELECT doc_id, count(*) AS lines FROM r WHERE upto <= 600 GROUP BY 1""",
)
def w10(spark, d, budget=600):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    upto = F.sum(F.length("line") + 1).over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("upto", upto).where(F.col("upto") <= budget).groupBy("doc_id").agg(F.count("*").alias("lines"))


#: Seconds that rolling counts look back.
FRAMES = {"last_minute": 60, "last_ten_minutes": 600, "last_day": 86400, "last_week": 604800}


@add(
    "w11_rolling_counts",
    "SELECT event_id, " + ", ".join(f"count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN {n} PRECEDING AND CURRENT ROW) AS {name}" for name, n in FRAMES.items()) + " FROM events",
)
def w11(spark, d):
    df = table(spark, d, "events").withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    back = lambda s: F.count("*").over(Window.partitionBy("user_id").orderBy("s").rangeBetween(-s, 0))
    return df.select("event_id", *(back(n).alias(name) for name, n in FRAMES.items()))


@add(
    "w12_spacing",
    "SELECT event_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap FROM events",
)
def w12(spark, d):
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", (s - F.lag(s).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))).alias("gap"))


@add("w13_bounded_tail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def w13(spark, d, keep=5):
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, d, "events").withColumn("rn", rn).where(F.col("rn") <= keep).select("user_id", "event_id")


@add(
    "w14_cooldown",
    """+ i AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    s AS (SELECT event_id, event_type, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i)
    SELECT event_id, CAST(least(60 * pow(2, streak - 1), 3600) AS DOUBLE) AS cooldown FROM s WHERE event_type = 'error'""",
)
def w14(spark, d):
    order = ("ts", "event_id")
    failed = F.col("event_type") == "error"
    df = table(spark, d, "events").withColumn("island", F.sum(F.when(failed, 0).otherwise(1)).over(Window.partitionBy("user_id").orderBy(*order)))
    streak = F.count_if(failed).over(Window.partitionBy("user_id", "island").orderBy(*order))
    return df.withColumn("streak", streak).where(failed).select("event_id", F.least(60 * F.pow(F.lit(2.0), F.col("streak") - 1), F.lit(3600.0)).alias("cooldown"))


