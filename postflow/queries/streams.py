"""Streaming queries, each with a batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from postflow.functions.urls import board_hits
from postflow.queries.posting import BANK, HARVEST_SQL
from postflow.queries.registry import Family
from postflow.queries.summaries import RUNS_SQL, numbered, run_numbers
from postflow.operators.storage import saved
from postflow.sources.adapters import ADAPTERS
from postflow.sources.bindings import companies, jobs, pick, table
from postflow.sources.envelopes import write_envelopes
from postflow.streaming import events
from postflow.streaming.sync import RUN_BITS, Sync

family = Family()
QUERIES, ORACLE, add = family.QUERIES, family.ORACLE, family.add


@add("ts1_harvest_passes", f"SELECT page_id, token, CASE WHEN page_id <= (SELECT max(page_id) FROM pages) // 2 THEN 1 ELSE 2 END AS pass FROM ({HARVEST_SQL}) WHERE token NOT IN ('', 'www', 'blog')")
def ts1(spark, d):
    """Pages harvested in two passes; the checkpoint is the watermark of what was read."""
    pages = table(spark, d, "pages").select("page_id", "url")
    found = events.in_passes(pages, "page_id", lambda df: df.select("page_id", F.explode(board_hits(F.col("url"), BANK)).alias("hit")).select("page_id", "hit.token"))
    return found.select("page_id", "token", "pass")


RUN_COUNT = 4


def arriving(spark, d):
    """Four runs: each lists the line items of a supplier but for every fourth order; in run 2 every seventh supplier's listing is cut short."""
    k = F.col("l_orderkey")
    items = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("board"), k.alias("item")).repartition("board").distinct()
    spread = items.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(RUN_COUNT - 1)))).where((F.col("item") % 4 != F.col("run")) & ((F.col("item") % 5 != 0) | (F.col("run") < 2)))
    cut = (F.col("run") == 2) & (F.col("board") % 7 == 0)
    return spread.select(F.col("run").cast("bigint").alias("run"), "board", "item", cut.alias("truncated"))


SYNC_SQL = f"""i AS (SELECT DISTINCT l_suppkey AS board, l_orderkey AS item FROM lineitem), n AS (SELECT CAST(unnest(range({RUN_COUNT})) AS BIGINT) AS run),
    l AS (SELECT board, item, run FROM i, n WHERE item % 4 <> run AND (item % 5 <> 0 OR run < 2)), b AS (SELECT DISTINCT board, run, run = 2 AND board % 7 = 0 AS truncated FROM l),
    f AS (SELECT board, item, min(run) AS first_run, max(run) AS last_run FROM l GROUP BY 1, 2),
    m AS (SELECT f.*, count(*) FILTER (WHERE b.run > last_run AND NOT truncated) AS missed FROM f JOIN b USING (board) GROUP BY ALL)""".replace("GROUP BY ALL", "GROUP BY f.board, f.item, f.first_run, f.last_run")


@add("ts2_incremental_sync", f"+ {SYNC_SQL} SELECT board, item, first_run, last_run, missed, missed < 2 AS is_active FROM m")
def ts2(spark, d):
    return events.synced(arriving(spark, d))


@add("ts13_truncated_listings", f"+ {SYNC_SQL} SELECT board, count(*) FILTER (WHERE missed >= 2) AS retired, count(*) AS stored FROM m WHERE board % 7 = 0 GROUP BY 1")
def ts13(spark, d):
    """Boards whose listing was once cut short: that run retires nothing."""
    found = events.synced(arriving(spark, d)).where("board % 7 = 0")
    return found.groupBy("board").agg(F.count_if(~F.col("is_active")).alias("retired"), F.count("*").alias("stored"))


SYNC_TITLES = ("Data Engineer", "data engineer ", "Analyst", "Platform Lead")
SYNC_LISTED = "(id % 4 <> run) AND (id % 3 <> 0 OR run <> 1)"


def crawled(spark, d, source="greenhouse"):
    """Raw envelopes of three runs over the boards of a feed: each leaves out a fourth of the postings, the second another third; in the third run every fifth board's listing was cut short."""
    df = jobs(spark, d).join(companies(spark, d).select("company_id", "name"), "company_id").select("id", "company_id", "name", F.floor(F.col("id") / 40).alias("page"))
    title = F.when((F.col("id") % 9 == 0) & (F.col("run") == 2), "Renamed").otherwise(pick(F.col("id"), SYNC_TITLES))
    item = F.struct(F.col("id").cast("string").alias("id"), title.alias("title"), F.col("name").alias("company_name"), F.lit("https://jobs.example.com/").alias("absolute_url"))
    spread = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(SYNC_LISTED)
    pages = spread.groupBy("run", "page").agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("jobs"))).alias("payload"))
    none = F.lit(None).cast("string")
    return pages.select("run", F.concat(F.lit("2001-08-0"), F.col("run") + 1).alias("run_key"), F.lit(source).alias("source"), F.lit(source).alias("provider"), F.concat(F.lit("board-"), "page").alias("token"), F.lit("global").alias("market"), none.cast("bigint").alias("board_id"), none.alias("fetched_at"), "payload", ((F.col("run") == 2) & (F.col("page") % 5 == 0)).alias("truncated"), F.lit(False).alias("refused"))


@add(
    "sync_composed",
    f"""+ b AS (SELECT id, name, 'board-' || (id // 40) AS board, id // 40 AS page FROM jobs JOIN companies USING (company_id)), l AS (SELECT b.*, run FROM b, (SELECT unnest(range(3)) AS run) WHERE {SYNC_LISTED}),
    w AS (SELECT page, run, run = 2 AND page % 5 = 0 AS cut FROM l GROUP BY page, run),
    f AS (SELECT id, name, board, page, min(run) AS first_run, max(run) AS last_run, max(CASE WHEN id % 9 = 0 AND run = 2 THEN 1 ELSE 0 END) = 1 AS renamed FROM l GROUP BY id, name, board, page),
    s AS (SELECT f.id, f.name, f.board, first_run, last_run, CASE WHEN renamed THEN 'Renamed' ELSE trim({['Data Engineer', 'data engineer ', 'Analyst', 'Platform Lead']}[f.id % 4 + 1]) END AS title, count(*) FILTER (WHERE w.run > last_run AND NOT cut) AS missed FROM f JOIN w USING (page) GROUP BY f.id, f.name, f.board, first_run, last_run, renamed)
    SELECT id, board, title, '2001-08-0' || (first_run + 1) AS first_run, '2001-08-0' || (last_run + 1) AS last_run, least(missed, 2) AS missed, missed < 2 AS is_active, first_value(id) OVER (PARTITION BY lower(name), lower(title) ORDER BY first_run, id) AS head FROM s""",
)
def sync_composed(spark, d, source="greenhouse"):
    """Raw runs replayed through adapter, upsert, retirement and scoped clustering, two runs first and the third later, from where the first pass stopped."""
    folder, store = events.fresh(spark, "raw"), events.fresh(spark, "store")
    sent = saved(crawled(spark, d, source))
    sync = Sync(spark, store, ADAPTERS[source], number=F.col("external_id").cast("bigint"))
    for rows in (sent.where("run < 2"), sent.where("run = 2")):
        write_envelopes(rows.drop("run"), folder)
        sync.drain(folder, source)
    number = F.substring_index("id", "|", -1).cast("bigint")
    head = F.col("head").bitwiseAND(F.lit((1 << RUN_BITS) - 1)).alias("head")
    return sync.stored().select(number.alias("id"), "board", "title", "first_run", "last_run", F.col("missed_runs").cast("bigint").alias("missed"), "is_active", head)


@add("ts3_missed_runs", f"+ {RUNS_SQL} SELECT board_id, job_id, run, coalesce(nth - lag(nth) OVER (PARTITION BY board_id, job_id ORDER BY nth) - 1, -1) AS missed FROM seen")
def ts3(spark, d):
    """How many runs a posting was missed for when its board lists it again; -1 for its first."""
    seen = numbered(spark, d)
    found = events.missed_runs(seen.select(F.col("board_id").alias("key"), F.col("job_id").alias("item"), F.col("nth").alias("at")))
    runs = run_numbers(spark, d).select("run", F.col("nth").cast("bigint").alias("at"))
    return found.join(F.broadcast(runs), "at").select(F.col("key").alias("board_id"), F.col("item").alias("job_id"), "run", "missed")


@add(
    "ts3_retirements",
    f"+ {RUNS_SQL}, g AS (SELECT board_id, job_id, nth, coalesce(lead(nth) OVER (PARTITION BY board_id, job_id ORDER BY nth), (SELECT max(nth) FROM runs) + 1) - nth - 1 AS missed FROM seen) SELECT board_id, job_id, nth + 2 AS retired_in FROM g WHERE missed >= 2",
)
def ts3_retirements(spark, d):
    """Each time that two runs in a row missed a posting, the second of them; timers retire what is never listed again."""
    seen = numbered(spark, d)
    found = events.retirements(seen.select(F.col("board_id").alias("key"), F.col("job_id").alias("item"), F.col("nth").alias("at")))
    return found.select(F.col("key").alias("board_id"), F.col("item").alias("job_id"), F.col("at").alias("retired_in"))


@add("ts4_error_streaks", f"+ {RUNS_SQL}, good AS (SELECT board_id, nth FROM seen GROUP BY 1, 2 HAVING count(*) >= 5) SELECT board_id, nth, coalesce(nth - lag(nth) OVER (PARTITION BY board_id ORDER BY nth) - 1, -1) AS failed FROM good")
def ts4(spark, d):
    """Failed runs in a row before each good run of a board; -1 before its first."""
    good = numbered(spark, d).groupBy("board_id", "nth").agg(F.count("*").alias("n")).where("n >= 5")
    found = events.missed_runs(good.select(F.col("board_id").alias("key"), F.col("board_id").alias("item"), F.col("nth").alias("at")))
    return found.select(F.col("key").alias("board_id"), F.col("at").alias("nth"), F.col("missed").alias("failed"))


@add(
    "ts4_dead_boards",
    f"+ {RUNS_SQL}, good AS (SELECT board_id, nth FROM seen GROUP BY 1, 2 HAVING count(*) >= 5), g AS (SELECT board_id, nth, coalesce(lead(nth) OVER (PARTITION BY board_id ORDER BY nth), (SELECT max(nth) FROM good) + 1) - nth - 1 AS failed FROM good) SELECT board_id, nth + 3 AS died_in FROM g WHERE failed >= 3",
)
def ts4_dead_boards(spark, d):
    """The run in which a board failed for the third time in a row; a run fails that lists fewer than five postings there."""
    good = numbered(spark, d).groupBy("board_id", "nth").agg(F.count("*").alias("n")).where("n >= 5")
    found = events.retirements(good.select(F.col("board_id").alias("key"), F.col("board_id").alias("item"), F.col("nth").alias("at")), grace=3)
    return found.select(F.col("key").alias("board_id"), F.col("at").alias("died_in"))


@add("ts5_daily_budgets", "SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def ts5(spark, d):
    return events.daily_budgets(spark, d).withColumn("day", F.col("day").cast("timestamp_ntz"))


@add(
    "ts6_weekly_caps",
    "SELECT event_type, date_trunc('day', ts) - to_days(k) AS since, count(*) AS n FROM events, (SELECT CAST(unnest(range(7)) AS INTEGER) AS k) GROUP BY 1, 2",
)
def ts6(spark, d):
    return events.weekly_caps(spark, d).withColumn("since", F.col("since").cast("timestamp_ntz"))


@add(
    "ts7_queue_outcomes",
    "SELECT i.event_id, min(a.ts) AS released_at FROM events i LEFT JOIN events a ON a.event_type = 'purchase' AND a.user_id = i.user_id AND a.ts > i.ts AND a.ts <= i.ts + INTERVAL 3 DAY WHERE i.event_type = 'signup' GROUP BY 1",
)
def ts7(spark, d):
    """Sign-ups wait for a purchase by the same user for three days."""
    return events.queue_outcomes(spark, d, 3).withColumn("released_at", F.col("released_at").cast("timestamp_ntz"))


@add(
    "ts8_breaker",
    """+ e AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    s AS (SELECT event_id, event_type, count(*) FILTER (WHERE event_type = 'error') OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM e)
    SELECT event_id, streak, CAST(least(60 * pow(2, streak - 1), 3600) AS BIGINT) AS cooldown, streak >= 3 AS tripped FROM s WHERE event_type = 'error'""",
)
def ts8(spark, d):
    """Errors stand for refusals: a pause after each, and a breaker after three in a row."""
    return events.breakers(spark, d)


@add(
    "ts8_releases",
    """+ e AS (SELECT *, count(*) FILTER (WHERE event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    s AS (SELECT event_id, user_id, ts, count(*) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS again FROM e WHERE event_type = 'error'),
    u AS (SELECT event_id, user_id, again, ts + to_seconds(CAST(least(60 * pow(2, streak - 1), 3600) AS BIGINT)) AS released_at FROM s)
    SELECT event_id, user_id, released_at FROM u WHERE again IS NULL OR again >= released_at""",
)
def ts8_releases(spark, d):
    """When requests are let through again after a refusal."""
    return events.releases(spark, d).withColumn("released_at", F.col("released_at").cast("timestamp_ntz"))


@add("ts10_resume", "SELECT event_id, ts, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) WHERE event_id > (SELECT max(event_id) FROM events) - 300")
def ts10(spark, d, keep=500, behind=300):
    """A reader of the event log stops and resumes after the last event it saw; the log answers for its newest 500."""
    log = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    found = events.resumed(log, F.col("seq") <= (log.agg(F.max("seq")).first()[0] or 0) - behind, keep)
    return found.select(F.col("seq").alias("event_id"), F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"), "event_type")


@add(
    "ts11_sessions",
    """+ g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, k""",
)
def ts11(spark, d):
    return events.sessions(spark, d).withColumn("began", F.col("began").cast("timestamp_ntz"))


@add("ts12_seen_keys", "SELECT event_id, user_id FROM events")
def ts12(spark, d):
    return events.seen_keys(spark, d)
