"""Filters, joins, set operations, sorts and top-k of the posting pipeline."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from postflow.functions.text import normalize_company_name, safe_key
from postflow.operators.storage import saved
from postflow.operators.companies import resolved
from postflow.queries.registry import Family
from postflow.sources.bindings import applications, boards, companies, jobs, listings, now, scores, table, titles

family = Family()
QUERIES, ORACLE, add = family.QUERIES, family.ORACLE, family.add
#: Sources that are searched anew each run, so that a missed run says nothing. Fixed values of the bindings.
SEARCHES = ("1-URGENT", "2-HIGH")


def active_canonical() -> Column:
    return F.col("is_active") & (F.col("canonical_id").isNull() | (F.col("canonical_id") == F.col("id")))


def cluster() -> Column:
    return F.coalesce("canonical_id", "id")


def fresh() -> Column:
    """Seen in the last run of its board, or, for a search, within two weeks. Unknown sources count as boards' never."""
    return (~F.col("source").isin(*SEARCHES) & (F.col("missed_runs") == 0)) | (F.col("source").isin(*SEARCHES) & (F.col("last_seen_at") >= now() - F.expr("interval 14 days")))


@add("f01_active_canonical", "SELECT id, market FROM jobs WHERE is_active AND (canonical_id IS NULL OR canonical_id = id)")
def f01(spark, d):
    return jobs(spark, d).where(active_canonical()).select("id", "market")


@add("f02_market_source", "SELECT id, company_id FROM jobs WHERE market = 'F' AND source = '2-HIGH'")
def f02(spark, d, market="F", source="2-HIGH"):
    df = jobs(spark, d)
    for name, value in (("market", market), ("source", source)):
        df = df if value is None else df.where(F.col(name) == value)
    return df.select("id", "company_id")


@add(
    "f03_freshness",
    "SELECT id, source FROM jobs WHERE (source NOT IN ('1-URGENT','2-HIGH') AND missed_runs = 0) OR (source IN ('1-URGENT','2-HIGH') AND last_seen_at >= TIMESTAMP '2001-07-19')",
)
def f03(spark, d):
    return jobs(spark, d).where(fresh()).select("id", "source")


@add("f04_since_days", "SELECT id, first_seen_at FROM jobs WHERE first_seen_at >= TIMESTAMP '2001-07-03'")
def f04(spark, d):
    return jobs(spark, d).where(F.col("first_seen_at") >= now() - F.expr("interval 30 days")).select("id", "first_seen_at")


@add("f05_gate_backlog", "SELECT job_id, profile FROM scores WHERE passed AND (llm_score IS NULL OR (NOT auth_checked AND llm_score >= 0.5))")
def f05(spark, d):
    return scores(spark, d).where(F.col("passed") & (F.col("llm_score").isNull() | (~F.col("auth_checked") & (F.col("llm_score") >= 0.5)))).select("job_id", "profile")


def due() -> Column:
    return F.when(F.col("status") == "candidate", F.col("next_fetch_at").isNull()).otherwise(F.col("next_fetch_at") <= now())


@add(
    "f06_due_boards",
    "SELECT board_id, status FROM boards WHERE status <> 'dead' AND CASE WHEN status = 'candidate' THEN next_fetch_at IS NULL ELSE next_fetch_at <= TIMESTAMP '2001-08-02' END",
)
def f06(spark, d):
    return boards(spark, d).where((F.col("status") != "dead") & due()).select("board_id", "status")


@add("f07_liveness_targets", "SELECT id FROM jobs WHERE is_active AND last_seen_at < TIMESTAMP '2001-08-01' AND salary_currency IS NOT NULL")
def f07(spark, d):
    return jobs(spark, d).where(F.col("is_active") & (F.col("last_seen_at") < now() - F.expr("interval 24 hours")) & F.col("salary_currency").isNotNull()).select("id")


def wanted(title: Column, required: tuple[str, ...] = ("ring", "plate"), excluded: tuple[str, ...] = ("^red",)) -> Column:
    """Any required pattern (none: all) and no excluded one; an unknown title is the empty string."""
    text = F.coalesce(title, F.lit(""))
    ok = F.lit(True)
    if required:
        ok = F.lit(False)
        for p in required:
            ok = ok | text.rlike(f"(?i){p}")
    for p in excluded:
        ok = ok & ~text.rlike(f"(?i){p}")
    return ok


WANTED_SQL = "regexp_matches(coalesce(title, ''), '(?i)ring|plate') AND NOT regexp_matches(coalesce(title, ''), '(?i)^red')"


@add("f08_title_filter", f"SELECT id, title FROM titles WHERE {WANTED_SQL}")
def f08(spark, d):
    return titles(spark, d).where(wanted(F.col("title"))).select("id", "title")


def relevant(spark, d):
    return listings(spark, d).join(titles(spark, d).where(wanted(F.col("title"))).select(F.col("id").alias("job_id")), "job_id", "left_semi").select("board_id").distinct()


RELEVANT_SQL = f"relevant AS (SELECT DISTINCT board_id FROM listings WHERE job_id IN (SELECT id FROM titles WHERE {WANTED_SQL}))"


@add("f09_relevant_boards", f"+ {RELEVANT_SQL} SELECT board_id FROM relevant")
def f09(spark, d):
    return relevant(spark, d)


@add(
    "f10_board_partition",
    f"+ {RELEVANT_SQL} SELECT board_id, provider, provider = 'feed' OR board_id IN (SELECT board_id FROM relevant) AS is_relevant FROM boards WHERE status <> 'dead'",
)
def f10(spark, d):
    marked = boards(spark, d).where("status <> 'dead'").join(relevant(spark, d).withColumn("hit", F.lit(True)), "board_id", "left")
    return marked.select("board_id", "provider", ((F.col("provider") == "feed") | F.coalesce("hit", F.lit(False))).alias("is_relevant"))


@add("f11_title_impact", f"SELECT count(*) FILTER (WHERE {WANTED_SQL}) AS matching, count(*) AS total FROM titles")
def f11(spark, d):
    return titles(spark, d).agg(F.count_if(wanted(F.col("title"))).alias("matching"), F.count("*").alias("total"))


@add("f12_bulk_lookup", "SELECT id, market FROM jobs WHERE id IN (SELECT job_id FROM applications WHERE status = 'offer')")
def f12(spark, d):
    wanted_ids = applications(spark, d).where("status = 'offer'").select(F.col("job_id").alias("id"))
    return jobs(spark, d).join(wanted_ids, "id", "left_semi").select("id", "market")


@add(
    "f13_card",
    "SELECT id, coalesce(nullif(title, ''), '?') AS title, coalesce(nullif(country, ''), nullif(name, ''), '?') AS place FROM jobs LEFT JOIN titles USING (id) LEFT JOIN companies USING (company_id)",
)
def f13(spark, d):
    df = jobs(spark, d).join(titles(spark, d), "id", "left").join(companies(spark, d), "company_id", "left")
    known = lambda *cols: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit("?"))
    return df.select("id", known("title").alias("title"), known("country", "name").alias("place"))


@add("f14_gate_record", "SELECT doc_id, substring(text, 1, 6000) AS body, length(text) > 6000 AS truncated FROM documents")
def f14(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 6000).alias("body"), (F.length("text") > 6000).alias("truncated"))


def salary_text(low: Column, high: Column, currency: Column, period: Column) -> Column:
    """"{low}-{high} CUR/period", figures cut to whole numbers."""
    figure = lambda c: F.format_number(F.floor(c), 0)
    return F.concat(figure(low), F.lit("-"), figure(high), F.lit(" "), F.coalesce(currency, F.lit("?")), F.lit("/"), F.coalesce(period, F.lit("?")))


@add(
    "f15_salary_text",
    "SELECT id, format('{:,}', CAST(floor(salary_max * 0.8) AS BIGINT)) || '-' || format('{:,}', CAST(floor(salary_max) AS BIGINT)) || ' ' || coalesce(salary_currency, '?') || '/' || coalesce(salary_period, '?') AS salary FROM jobs",
)
def f15(spark, d):
    return jobs(spark, d).select("id", salary_text(F.col("salary_max") * F.lit(0.8), F.col("salary_max"), F.col("salary_currency"), F.col("salary_period")).alias("salary"))


def age_days(ts: Column) -> Column:
    """Whole days elapsed, as Python counts them: rounded down."""
    return F.floor((F.unix_timestamp(now().cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 86400)


@add(
    "f16_age_text",
    "SELECT id, CASE WHEN posted_at IS NULL THEN 'posted ?' WHEN posted_at > TIMESTAMP '2001-08-01' THEN 'posted today' ELSE 'posted ' || date_diff('day', posted_at, TIMESTAMP '2001-08-02') || 'd ago' END AS age FROM jobs",
)
def f16(spark, d):
    days = F.greatest(F.lit(0), age_days(F.col("posted_at")))
    return jobs(spark, d).select("id", F.when(F.col("posted_at").isNull(), "posted ?").when(days == 0, "posted today").otherwise(F.concat(F.lit("posted "), days.cast("string"), F.lit("d ago"))).alias("age"))


#: How far along an event is. Fixed values of the bindings.
RANKS = ("view", "click", "signup", "purchase")
RANK_SQL = "list_position(['view','click','signup','purchase'], event_type)"


@add("f17_best_state", f"SELECT user_id, arg_max(event_type, {RANK_SQL}) AS best FROM events WHERE event_type <> 'error' GROUP BY 1")
def f17(spark, d):
    rank = F.array_position(F.array(*map(F.lit, RANKS)), F.col("event_type"))
    return table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_type", rank).alias("best"))


@add("f18_list_view", "SELECT id, substring(coalesce(title, '?'), 1, 7) AS title, coalesce(country, '?') AS location FROM jobs LEFT JOIN titles USING (id) LEFT JOIN companies USING (company_id) WHERE is_active")
def f18(spark, d):
    df = jobs(spark, d).where("is_active").join(titles(spark, d), "id", "left").join(companies(spark, d), "company_id", "left")
    return df.select("id", F.substring(F.coalesce("title", F.lit("?")), 1, 7).alias("title"), F.coalesce("country", F.lit("?")).alias("location"))


# joins


@add("j01_jobs_companies", "SELECT id, name, segment FROM jobs LEFT JOIN companies USING (company_id)")
def j01(spark, d):
    return jobs(spark, d).join(companies(spark, d), "company_id", "left").select("id", "name", "segment")


def scored(spark, d):
    """Jobs with the scores of the market that they are in now."""
    own = scores(spark, d).withColumnsRenamed({"job_id": "id", "profile": "market"})
    return jobs(spark, d).join(own, ["id", "market"])


@add("j02_jobs_scores", "SELECT id, market, llm_score FROM jobs JOIN scores ON id = job_id AND profile = market")
def j02(spark, d):
    return scored(spark, d).select("id", "market", "llm_score")


@add("j03_three_way", "SELECT id, llm_score, name FROM jobs JOIN scores ON id = job_id AND profile = market LEFT JOIN companies USING (company_id) WHERE llm_score >= 0.9")
def j03(spark, d):
    return scored(spark, d).where("llm_score >= 0.9").join(companies(spark, d), "company_id", "left").select("id", "llm_score", "name")


@add("j04_applications_jobs", "SELECT job_id, status, market FROM applications JOIN jobs ON job_id = id")
def j04(spark, d):
    return applications(spark, d).join(jobs(spark, d).withColumnRenamed("id", "job_id"), "job_id").select("job_id", "status", "market")


@add("j05_boards_companies", "SELECT board_id, token, name FROM boards LEFT JOIN companies USING (company_id)")
def j05(spark, d):
    return boards(spark, d).join(companies(spark, d), "company_id", "left").select("board_id", "token", "name")


@add("j06_company_name", "SELECT id, name FROM jobs LEFT JOIN companies USING (company_id) WHERE lower(name) = 'customer#000000012'")
def j06(spark, d):
    return jobs(spark, d).join(companies(spark, d), "company_id", "left").where(F.lower("name") == "customer#000000012").select("id", "name")


def acted_on(spark, d, known=None):
    """The clusters with an application beyond interest; known: the jobs, if they are built already."""
    return applications(spark, d).where("status <> 'interested'").join((jobs(spark, d) if known is None else known).withColumnRenamed("id", "job_id"), "job_id").select(F.coalesce("canonical_id", "job_id").alias("cluster")).distinct()


ACTED_SQL = "acted AS (SELECT DISTINCT coalesce(canonical_id, id) AS cluster FROM applications JOIN jobs ON job_id = id WHERE status <> 'interested')"


@add("j07_not_acted_on", f"+ {ACTED_SQL} SELECT id FROM jobs WHERE coalesce(canonical_id, id) NOT IN (SELECT cluster FROM acted)")
def j07(spark, d):
    return jobs(spark, d).withColumn("cluster", cluster()).join(acted_on(spark, d), "cluster", "left_anti").select("id")


def also_on(spark, d):
    """The sources of each cluster, in order."""
    return jobs(spark, d).groupBy(cluster().alias("cluster")).agg(F.array_sort(F.collect_set("source")).alias("sources"))


@add(
    "j08_also_on",
    "+ s AS (SELECT coalesce(canonical_id, id) AS cluster, list_sort(list_distinct(list(source))) AS sources FROM jobs GROUP BY 1) SELECT id, array_to_string(list_filter(sources, lambda x: x <> source), ',') AS also_on FROM jobs JOIN s ON cluster = coalesce(canonical_id, id)",
)
def j08(spark, d):
    df = jobs(spark, d).withColumn("cluster", cluster()).join(also_on(spark, d), "cluster")
    return df.select("id", F.array_join(F.array_remove("sources", F.col("source")), ",").alias("also_on"))


@add(
    "j09_cluster_application",
    "SELECT cluster, arg_min(status, job_id) AS status, min(job_id) AS job_id FROM (SELECT coalesce(canonical_id, id) AS cluster, job_id, status FROM applications JOIN jobs ON job_id = id) GROUP BY 1",
)
def j09(spark, d):
    df = applications(spark, d).join(jobs(spark, d).withColumnRenamed("id", "job_id"), "job_id").withColumn("cluster", F.coalesce("canonical_id", "job_id"))
    return df.groupBy("cluster").agg(F.min_by("status", "job_id").alias("status"), F.min("job_id").alias("job_id"))


@add(
    "j10_unknown_keys",
    "SELECT host, min(page_id) AS page_id FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages) WHERE host NOT IN (SELECT regexp_extract(url, '://([^/]+)', 1) FROM pages WHERE page_id % 10 = 0) GROUP BY 1",
)
def j10(spark, d):
    found = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("host"))
    known = found.where(F.col("page_id") % 10 == 0).select("host").distinct()
    return found.join(known, "host", "left_anti").groupBy("host").agg(F.min("page_id").alias("page_id"))


LAST_RUN_SQL = "last_run AS (SELECT board_id, max(run) AS run FROM listings GROUP BY 1)"


@add(
    "j11_missing_from_listing",
    f"+ {LAST_RUN_SQL} SELECT DISTINCT l.board_id, l.job_id FROM listings l WHERE NOT EXISTS (SELECT 1 FROM listings s JOIN last_run r ON s.board_id = r.board_id AND s.run = r.run WHERE s.board_id = l.board_id AND s.job_id = l.job_id)",
)
def j11(spark, d):
    rows = listings(spark, d)
    seen = rows.join(rows.groupBy("board_id").agg(F.max("run").alias("run")), ["board_id", "run"]).select("board_id", "job_id")
    return rows.select("board_id", "job_id").distinct().join(seen, ["board_id", "job_id"], "left_anti")


@add(
    "j12_upsert_match",
    "SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'absent' ELSE 'known' END AS outcome FROM (SELECT id FROM jobs WHERE id % 4 <> 0) o FULL JOIN (SELECT id FROM jobs WHERE id % 3 <> 0) n ON o.id = n.id",
)
def j12(spark, d):
    df = jobs(spark, d).select("id")
    old, new = df.where("id % 4 <> 0").withColumn("old", F.lit(True)), df.where("id % 3 <> 0").withColumn("new", F.lit(True))
    return old.join(new, "id", "full").select("id", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "absent").otherwise("known").alias("outcome"))


J13_SQL = """f AS (SELECT company_id, CASE WHEN company_id % 3 = 0 THEN NULL ELSE 'c' || (company_id % 40) || '.example' END AS domain, 'Acme ' || (company_id % 50) || [' Inc.', ' GmbH', ''][company_id % 3 + 1] AS name FROM companies),
    g AS (SELECT *, 'acme ' || (company_id % 50) AS plain FROM f)"""


@add(
    "j13_company_resolve",
    f"+ {J13_SQL}, k AS (SELECT * FROM g WHERE company_id % 2 = 0), d AS (SELECT domain, min(company_id) AS by_domain FROM k WHERE domain IS NOT NULL GROUP BY 1), n AS (SELECT plain, min(company_id) AS by_name FROM k GROUP BY 1) SELECT g.company_id, coalesce(by_domain, by_name) AS resolved FROM g LEFT JOIN d USING (domain) LEFT JOIN n USING (plain)",
)
def j13(spark, d):
    """Companies found among the known ones by domain, else by their normalised name; of several the first."""
    k = F.col("company_id")
    name = F.concat(F.lit("Acme "), k % 50, F.element_at(F.array(F.lit(" Inc."), F.lit(" GmbH"), F.lit("")), (k % 3 + 1).cast("int")))
    df = companies(spark, d).select("company_id", F.when(k % 3 != 0, F.concat(F.lit("c"), k % 40, F.lit(".example"))).alias("domain"), normalize_company_name(name).alias("plain"))
    known = df.where(k % 2 == 0)
    by = lambda c, to: known.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("company_id").alias(to))
    return df.join(by("domain", "by_domain"), "domain", "left").join(by("plain", "by_name"), "plain", "left").select("company_id", F.coalesce("by_domain", "by_name").alias("resolved"))


@add("j13_companies_created")
def j13_companies_created(spark, d):
    """Companies of all customers in order, every fifth known already: what a customer creates, later ones find by domain or name."""
    k = F.col("company_id")
    part = F.pmod(F.xxhash64("name", "segment"), F.lit(97))
    name = F.concat(F.lit("Acme "), part, F.element_at(F.array(F.lit(" Inc."), F.lit(" GmbH"), F.lit("")), (k % 3 + 1).cast("int")))
    domain = F.when(k % 3 != 0, F.concat(F.lit("c"), F.pmod(F.xxhash64("country", "batch", "segment"), F.lit(211)), F.lit(".example")))
    df = companies(spark, d).select(k.alias("at"), domain.alias("domain"), normalize_company_name(name).alias("name"))
    known = df.where("at % 5 = 0").select(F.col("at").alias("company"), "domain", "name")
    return resolved(df.where("at % 5 <> 0"), known).select(F.col("at").alias("company_id"), "company", "created")


@add(
    "j15_unambiguous_match",
    """+ j AS (SELECT id, title, name, regexp_replace(lower(name || '-' || title), '[^a-z0-9._-]+', '-', 'g') AS folder FROM jobs JOIN titles USING (id) JOIN companies USING (company_id)),
    f AS (SELECT folder, min(id) AS by_folder FROM j WHERE id % 3 <> 0 GROUP BY 1 HAVING count(*) = 1), t AS (SELECT lower(title) AS lt, lower(name) AS ln, min(id) AS by_title FROM j GROUP BY 1, 2 HAVING count(*) = 1)
    SELECT id AS application, coalesce(by_folder, by_title) AS job_id FROM j LEFT JOIN f ON j.folder = f.folder LEFT JOIN t ON lower(title) = lt AND lower(name) = ln WHERE id % 11 = 0""",
)
def j15(spark, d):
    """Applications find their posting by folder, else by title and company whatever their case; two that fit are none. Every third posting has no folder."""
    df = jobs(spark, d).join(titles(spark, d), "id").join(companies(spark, d), "company_id")
    df = df.select("id", F.lower("title").alias("lt"), F.lower("name").alias("ln"), safe_key(F.concat_ws("-", "name", "title")).alias("folder"))
    one = lambda rows, to, *keys: rows.groupBy(*keys).agg(F.min("id").alias(to), F.count("*").alias("n")).where("n = 1").drop("n")
    wanted = df.where("id % 11 = 0")
    found = wanted.join(one(df.where("id % 3 <> 0"), "by_folder", "folder"), "folder", "left").join(one(df, "by_title", "lt", "ln"), ["lt", "ln"], "left")
    return found.select(F.col("id").alias("application"), F.coalesce("by_folder", "by_title").alias("job_id"))


@add("j16_verdicts_batch", "SELECT l.doc_id, quality, d.source FROM labels l LEFT JOIN documents d ON l.doc_id = d.doc_id")
def j16(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    return table(spark, d, "labels").join(docs, "doc_id", "left").select("doc_id", "quality", "source")


@add("j17_region_lookup", "SELECT name, r_name AS region_name FROM companies LEFT JOIN region ON region = r_regionkey")
def j17(spark, d):
    regions = table(spark, d, "region").withColumnRenamed("r_regionkey", "region")
    return companies(spark, d).join(regions, "region", "left").select("name", F.col("r_name").alias("region_name"))


@add("j18_existing_flag", "SELECT user_id, user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS existing FROM (SELECT DISTINCT user_id FROM events)")
def j18(spark, d):
    events = table(spark, d, "events")
    buyers = events.where("event_type = 'purchase'").select("user_id").distinct().withColumn("hit", F.lit(True))
    return events.select("user_id").distinct().join(buyers, "user_id", "left").select("user_id", F.col("hit").isNotNull().alias("existing"))


@add(
    "j19_source_registry",
    "+ n AS (SELECT source, count(*) AS active FROM jobs WHERE is_active GROUP BY 1), r AS (SELECT source, max(first_seen_at) AS latest FROM jobs GROUP BY 1) SELECT s.source, coalesce(active, 0) AS active, latest FROM (SELECT DISTINCT source FROM documents UNION SELECT DISTINCT source FROM jobs) s LEFT JOIN n USING (source) LEFT JOIN r USING (source)",
)
def j19(spark, d):
    df = jobs(spark, d)
    registry = table(spark, d, "documents").select("source").union(df.select("source")).distinct()
    active = df.where("is_active").groupBy("source").agg(F.count("*").alias("active"))
    latest = df.groupBy("source").agg(F.max("first_seen_at").alias("latest"))
    return registry.join(active, "source", "left").join(latest, "source", "left").select("source", F.coalesce("active", F.lit(0)).alias("active"), "latest")


@add("j20_contacts_of_job", "SELECT job_id, token, provider FROM listings JOIN boards USING (board_id)")
def j20(spark, d):
    return listings(spark, d).join(boards(spark, d), "board_id").select("job_id", "token", "provider")


# sorts and top-k


@add("l01_newest", "SELECT id, first_seen_at FROM jobs ORDER BY first_seen_at DESC, id DESC LIMIT 50")
def l01(spark, d):
    return jobs(spark, d).orderBy(F.desc("first_seen_at"), F.desc("id")).limit(50).select("id", "first_seen_at")


@add("l02_best_scored", "SELECT job_id, llm_score FROM scores WHERE passed ORDER BY llm_score DESC NULLS LAST, job_id DESC LIMIT 100")
def l02(spark, d):
    return scores(spark, d).where("passed").orderBy(F.desc_nulls_last("llm_score"), F.desc("job_id")).limit(100).select("job_id", "llm_score")


def boost() -> Column:
    return F.when(F.col("segment") == "MACHINERY", 1.2).otherwise(1.0)


@add(
    "l03_shortlist_order",
    "SELECT id, round(coalesce(llm_score, 0) * CASE WHEN segment = 'MACHINERY' THEN CAST(1.2 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 6) AS rank_key FROM jobs JOIN scores ON id = job_id AND profile = market LEFT JOIN companies USING (company_id) ORDER BY rank_key DESC, id DESC LIMIT 30",
)
def l03(spark, d):
    df = scored(spark, d).join(companies(spark, d), "company_id", "left")
    return df.select("id", F.round(F.coalesce("llm_score", F.lit(0.0)) * boost(), 6).alias("rank_key")).orderBy(F.desc("rank_key"), F.desc("id")).limit(30)


@add(
    "l04_due_budget",
    "+ due AS (SELECT board_id, status, provider, next_fetch_at FROM boards WHERE status <> 'dead'), a AS (SELECT board_id, 'validated' AS budget FROM due WHERE status <> 'candidate' AND next_fetch_at <= TIMESTAMP '2001-08-02' ORDER BY provider = 'feed' DESC, next_fetch_at, board_id LIMIT 20), b AS (SELECT board_id, 'candidate' AS budget FROM due WHERE status = 'candidate' AND next_fetch_at IS NULL ORDER BY board_id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b",
)
def l04(spark, d):
    df = boards(spark, d).where((F.col("status") != "dead") & due())
    first = df.where("status <> 'candidate'").orderBy(F.desc(F.col("provider") == "feed"), "next_fetch_at", "board_id").limit(20)
    return first.select("board_id", F.lit("validated").alias("budget")).unionByName(df.where("status = 'candidate'").orderBy("board_id").limit(5).select("board_id", F.lit("candidate").alias("budget")))


@add("l05_feeds_first", "SELECT board_id FROM boards ORDER BY provider = 'feed' DESC, board_id LIMIT 25")
def l05(spark, d):
    return boards(spark, d).orderBy(F.desc(F.col("provider") == "feed"), "board_id").limit(25).select("board_id")


@add(
    "l06_export_order",
    "SELECT id, row_number() OVER (PARTITION BY market ORDER BY applied, llm_score DESC NULLS LAST, id DESC) AS place FROM (SELECT id, market, llm_score, id % 11 = 0 AS applied FROM jobs JOIN scores ON id = job_id AND profile = market)",
)
def l06(spark, d):
    """Places inside a market. Rows are dealt by range; a row's place is its place in its range and the rows of the market's earlier ranges, so no task sorts a market."""
    rows = scored(spark, d).select("id", "market", (F.col("id") % 11 == 0).alias("applied"), (-F.coalesce("llm_score", F.lit(-1.0))).alias("score"), (-F.col("id")).alias("number"))
    order = ["market", "applied", "score", "number"]
    dealt = saved(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("market", "part").agg(F.count("*").alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("market").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("market", "part").orderBy(*order[1:]))
    placed = dealt.withColumn("own", own).join(saved(counts.select("market", "part", earlier.alias("base"))), ["market", "part"])
    return placed.select("id", (F.col("base") + F.col("own")).cast("bigint").alias("place"))


@add(
    "l07_contact_ranking",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY contains(lower(text), 'the') DESC, role = 'user' DESC, turn) AS rank FROM conversations",
)
def l07(spark, d):
    """Ranks within each conversation; nobody is dropped."""
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.lower("text").contains("the")), F.desc(F.col("role") == "user"), "turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(order).cast("bigint").alias("rank")).orderBy("conv_id", "rank")


@add("l08_suggestions", "SELECT title, count(*) AS n FROM titles GROUP BY 1")
def l08(spark, d):
    return titles(spark, d).groupBy("title").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "title")


@add("l09_near_miss", "SELECT id, llm_score FROM jobs JOIN scores ON id = job_id AND profile = market WHERE llm_score < 0.65 ORDER BY llm_score DESC, id DESC LIMIT 6")
def l09(spark, d):
    return scored(spark, d).where("llm_score < 0.65").orderBy(F.desc("llm_score"), F.desc("id")).limit(6).select("id", "llm_score")


@add("l10_open_refill", "SELECT id, llm_score FROM jobs JOIN scores ON id = job_id AND profile = market WHERE is_active AND llm_score IS NOT NULL ORDER BY llm_score DESC, id DESC LIMIT 15")
def l10(spark, d):
    """Closed postings are hidden before the cut, so that the list is full whenever enough are open."""
    return scored(spark, d).where("is_active and llm_score is not null").orderBy(F.desc("llm_score"), F.desc("id")).limit(15).select("id", "llm_score")


@add(
    "l11_extraction_queue",
    "SELECT id, llm_score FROM jobs JOIN scores ON id = job_id AND profile = market WHERE passed AND salary_period IS NULL ORDER BY llm_score DESC NULLS LAST, id DESC LIMIT 20",
)
def l11(spark, d):
    return scored(spark, d).where("passed and salary_period is null").orderBy(F.desc_nulls_last("llm_score"), F.desc("id")).limit(20).select("id", "llm_score")


# set operations


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9À-ɏ]+"), 0)


TOKENS_SQL = "regexp_extract_all(lower(text), '[a-z0-9À-ɏ]+')"


@add("o01_union_hits", "SELECT host FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS host FROM pages) UNION SELECT regexp_extract(url, '://[^/]+/([a-z]+)', 1) FROM pages")
def o01(spark, d):
    pages = table(spark, d, "pages")
    return pages.select(F.regexp_extract("url", "://([^/]+)", 1).alias("host")).union(pages.select(F.regexp_extract("url", "://[^/]+/([a-z]+)", 1))).distinct()


@add(
    "o02_merge_codes",
    "SELECT company_id, array_to_string(list_sort(list_distinct(list_concat(list_distinct(list(market)), list_distinct(list(source))))), ',') AS codes FROM jobs GROUP BY 1",
)
def o02(spark, d):
    return jobs(spark, d).groupBy("company_id").agg(F.array_join(F.array_sort(F.array_union(F.collect_set("market"), F.collect_set("source"))), ",").alias("codes"))


@add("o03_overlap", "SELECT company_id, list_has_any(list(market), ['P']) AS overlaps FROM jobs GROUP BY 1")
def o03(spark, d):
    return jobs(spark, d).groupBy("company_id").agg(F.arrays_overlap(F.collect_set("market"), F.array(F.lit("P"))).alias("overlaps"))


@add("o04_became_relevant", "SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-03' EXCEPT SELECT user_id FROM events WHERE ts < TIMESTAMP '2024-01-03' AND event_type = 'click'")
def o04(spark, d):
    events = table(spark, d, "events")
    before = events.where("ts < timestamp_ntz'2024-01-03' and event_type = 'click'").select("user_id")
    return events.where("ts >= timestamp_ntz'2024-01-03'").select("user_id").subtract(before)


@add(
    "o05_bag_difference",
    f"+ a AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS word FROM benchmark) GROUP BY 1), b AS (SELECT word, count(*) AS n FROM (SELECT unnest({TOKENS_SQL}) AS word FROM conversations) GROUP BY 1) SELECT coalesce(a.word, b.word) AS word, greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) AS missing, greatest(coalesce(b.n, 0) - coalesce(a.n, 0), 0) AS added FROM a FULL JOIN b ON a.word = b.word WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
)
def o05(spark, d):
    bag = lambda t, n: table(spark, d, t).select(F.explode(tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias(n))
    df = bag("benchmark", "a").join(bag("conversations", "b"), "word", "full").fillna(0, ["a", "b"]).where("a <> b")
    return df.select("word", F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("missing"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("added"))


@add("o06_containment", "SELECT company_id, len(list_filter(list_distinct(list(market)), lambda x: NOT list_contains(['F', 'O'], x))) = 0 AS contained FROM jobs GROUP BY 1")
def o06(spark, d):
    return jobs(spark, d).groupBy("company_id").agg((F.size(F.array_except(F.collect_set("market"), F.array(F.lit("F"), F.lit("O")))) == 0).alias("contained"))


@add("o07_concatenation", "SELECT id, 'active' AS budget FROM jobs WHERE is_active UNION ALL SELECT id, 'market F' FROM jobs WHERE market = 'F'")
def o07(spark, d):
    df = jobs(spark, d)
    return df.where("is_active").select("id", F.lit("active").alias("budget")).unionByName(df.where("market = 'F'").select("id", F.lit("market F").alias("budget")))
