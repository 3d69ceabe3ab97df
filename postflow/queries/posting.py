"""Rules, clustering, upserts, lifecycles, gates and the shortlist of the posting pipeline."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from postflow.functions import density
from postflow.functions import text as T
from postflow.functions.authorization import decision, stated
from postflow.functions.html import job_posting, main_block
from postflow.functions.page_tables import links as page_links
from postflow.functions.page_tables import told as told_rows
from postflow.functions.places import literal_map
from postflow.functions.quality import assess
from postflow.functions.urls import board_hits, customer, domain_hints, registrable
from postflow.operators import extraction as X
from postflow.operators import outreach as O
from postflow.operators import preferences as P
from postflow.operators import rules as R
from postflow.operators.dedupe import city_conflict, clustered, linked, pairs
from postflow.operators.lifecycle import harvested, last_standing, upserted
from postflow.operators.phrases import found_in
from postflow.operators.storage import saved
from postflow.queries.authorisation import CODES, listed, told
from postflow.queries.registry import Family
from postflow.queries.relational import ACTED_SQL, acted_on, active_canonical, age_days, cluster, scored
from postflow.queries.scalars import PLACE_CODES, SIMHASH_SQL, TITLE_TAILS, html_sql, quoted
from postflow.sources.bindings import applications, boards, companies, jobs, listings, now, pick, scores, table, titles

family = Family()
QUERIES, ORACLE, add = family.QUERIES, family.ORACLE, family.add

# rules

RULES = R.Rules(
    retired_sources=("5-LOW",),
    max_age_days=365,
    blocked_companies=("Customer#000000012", "customer 000000017, Inc."),
    excluded_titles=("^red", "ring$"),
    required_titles=("ring", "plate", "bolt"),
    profile_titles={"O": ("gear", "plate")},
    allowed={"market": ("P", "F"), "country": ("GB", "DE", "TR", "US", "IN", "JP", "NZ")},
    min_level="mid",
    max_level="staff",
    min_annual=60000.0,
    currency="EUR",
    rates={"USD": 1.0, "EUR": 0.9, "TRY": 32.5},
    min_overlap=4.0,
    boosts={"machinery": 1.2, "big": 1.1},
)
LEVEL_NAMES = ("intern", "junior", "mid", "senior", "staff", None)
LOCATIONS = ("Office", "Remote, anywhere", None, "City centre")


def postings(spark, d, known=None):
    """Jobs with all that the rules look at."""
    df = (jobs(spark, d) if known is None else known).join(titles(spark, d), "id", "left").join(companies(spark, d), "company_id", "left")
    return df.withColumns({"level": pick(F.col("id"), LEVEL_NAMES), "place": pick(F.col("id"), PLACE_CODES), "location": pick(F.col("id"), LOCATIONS), "days": age_days(F.col("posted_at"))})


POSTINGS_SQL = f"postings AS (SELECT j.*, title, name, segment, {quoted(('intern', 'junior', 'mid', 'senior', 'staff'))}[id % 6 + 1] AS level, {quoted(PLACE_CODES)}[id % 9 + 1] AS place, id % 4 = 1 AS worldwide, date_diff('day', posted_at, TIMESTAMP '2001-08-02') AS days FROM jobs j LEFT JOIN titles USING (id) LEFT JOIN companies USING (company_id))"
TOP_SQL = "CASE WHEN salary_currency IS NULL OR salary_currency = 'EUR' THEN 1.0::DOUBLE WHEN salary_currency = 'USD' THEN 0.9::DOUBLE ELSE 0.9::DOUBLE / 32.5::DOUBLE END * salary_max * CASE coalesce(salary_period, 'annual') WHEN 'annual' THEN 1 WHEN 'monthly' THEN 12 ELSE 52 END"
HOURS_SQL = "CASE place WHEN 'GB' THEN 6 WHEN 'DE' THEN 7 WHEN 'TR' THEN 9 WHEN 'IN' THEN 6.5 WHEN 'US' THEN 0 WHEN 'JP' THEN 3 WHEN 'NZ' THEN 0 WHEN 'BR' THEN 3 END"
CONDITIONS = {
    "source_excluded": "source = '5-LOW'",
    "age": "days > 365",
    "company_blocked": "lower(name) = 'customer#000000012' OR trim(regexp_replace(lower(name), '[^a-z0-9_]+', ' ', 'g')) IN ('customer 000000012', 'customer 000000017')",
    "title_excluded": "regexp_matches(title, '(?i)^red')",
    "title_excluded_2": "regexp_matches(title, '(?i)ring$')",
    "title_unmatched": "NOT CASE WHEN market = 'O' THEN regexp_matches(coalesce(title, ''), '(?i)gear|plate') ELSE regexp_matches(coalesce(title, ''), '(?i)ring|plate|bolt') END",
    "field_mismatch": "market NOT IN ('P', 'F')",
    "field_mismatch_2": "place <> '' AND place NOT IN ('GB', 'DE', 'TR', 'US', 'IN', 'JP', 'NZ') AND NOT worldwide",
    "seniority_low": "level IN ('intern', 'junior')",
    "salary_below": f"{TOP_SQL} < 60000",
    "tz_overlap": f"CASE WHEN worldwide THEN 9 ELSE {HOURS_SQL} END < 4",
}
CODES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{k.removesuffix('_2')}' END" for k, c in CONDITIONS.items()) + "], lambda x: x IS NOT NULL)"


def reasons(rules: R.Rules = RULES):
    c = F.col
    return [
        *R.source_excluded(c("source"), rules),
        *R.age(c("days"), rules),
        *R.company_blocked(c("name"), rules),
        *R.title_excluded(c("title"), rules),
        *R.title_unmatched(c("title"), rules, c("market")),
        *R.field_mismatch({"market": c("market"), "country": c("place")}, rules, c("location")),
        *R.seniority(c("level"), rules),
        *R.salary(c("salary_max"), c("salary_period"), c("salary_currency"), rules),
        *R.time_zone(c("place"), c("location"), rules),
    ]


def verdicts(spark, d, known=None):
    signs = {"machinery": F.col("segment") == "MACHINERY", "big": F.col("salary_max") > 300000}
    return R.judged(postings(spark, d, known), reasons(), R.boost(RULES, signs))


@add(
    "r14_verdicts",
    f"+ {POSTINGS_SQL}, v AS (SELECT *, {CODES_SQL} AS codes FROM postings) SELECT id, len(codes) = 0 AS passed, array_to_string(codes, ',') AS codes, round(CASE WHEN segment = 'MACHINERY' THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN salary_max > 300000 THEN 1.1::DOUBLE ELSE 1 END, 3) AS boost FROM v",
)
def r14(spark, d):
    return verdicts(spark, d).select("id", "verdict.passed", F.array_join("verdict.codes", ",").alias("codes"), "verdict.boost")


def _single(name: str, code: str, build):
    condition = " OR ".join(c for k, c in CONDITIONS.items() if k.removesuffix("_2") == code)

    @add(name, f"+ {POSTINGS_SQL} SELECT id FROM postings WHERE {condition}")
    def query(spark, d):
        codes = build(RULES)
        return postings(spark, d).where(F.coalesce(*codes) == code).select("id")

    return query


r01 = _single("r01_source_excluded", "source_excluded", lambda r: R.source_excluded(F.col("source"), r))
r02 = _single("r02_age", "age", lambda r: R.age(F.col("days"), r))
r03 = _single("r03_company_blocked", "company_blocked", lambda r: R.company_blocked(F.col("name"), r))
r04 = _single("r04_title_excluded", "title_excluded", lambda r: R.title_excluded(F.col("title"), r))
r05 = _single("r05_title_unmatched", "title_unmatched", lambda r: R.title_unmatched(F.col("title"), r, F.col("market")))
r06 = _single("r06_field_mismatch", "field_mismatch", lambda r: R.field_mismatch({"market": F.col("market"), "country": F.col("place")}, r, F.col("location")))
r08 = _single("r08_seniority", "seniority_low", lambda r: R.seniority(F.col("level"), r))
r09 = _single("r09_salary", "salary_below", lambda r: R.salary(F.col("salary_max"), F.col("salary_period"), F.col("salary_currency"), r))
r12 = _single("r12_tz_overlap", "tz_overlap", lambda r: R.time_zone(F.col("place"), F.col("location"), r))


@add("r07_phrases", "SELECT doc_id FROM documents WHERE regexp_matches(lower(source || chr(10) || lang || chr(10) || text[1:4000]), '(^|[^0-9a-z_])mit license($|[^0-9a-z_])')")
def r07(spark, d):
    """Source and language stand for title and location."""
    rule = R.phrase_excluded(R.haystack(F.col("source"), F.col("lang"), F.col("text")), R.Rules(excluded_phrases=("MIT License",)))
    return table(spark, d, "documents").where(F.coalesce(*rule).isNotNull()).select("doc_id")


@add(
    "r07_phrase_table",
    r"""+ w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM benchmark), p AS (SELECT item_id, k, ' ' || array_to_string(t[k:k + 3], ' ') || ' ' AS phrase FROM (SELECT item_id, t, unnest(range(1, len(t) - 2)) AS k FROM w)),
    d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g')) || ' ' AS t FROM documents), g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(x) - 2), lambda i: ' ' || array_to_string(x[i:i + 3], ' ') || ' '))) AS phrase FROM (SELECT doc_id, string_split(trim(t), ' ') AS x FROM d))
    SELECT doc_id, count(*) AS phrases, count(DISTINCT item_id) AS items FROM g JOIN p USING (phrase) GROUP BY 1""",
)
def r07_phrase_table(spark, d, size=4):
    """Every run of four words of every benchmark item is an excluded phrase: how many of them, and of how many items, each document has."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda x: x != "")
    items = table(spark, d, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= size)
    runs = items.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - size + 1)).alias("k"))
    phrases = saved(runs.select("item_id", F.array_join(F.slice("w", F.col("k"), F.lit(size)), " ").alias("phrase")).withColumn("phrase_id", F.monotonically_increasing_id()))
    found = found_in(table(spark, d, "documents"), phrases, "doc_id", "text")
    return found.join(phrases.select("phrase_id", "item_id"), "phrase_id").groupBy("doc_id").agg(F.count("*").alias("phrases"), F.count_distinct("item_id").alias("items"))


@add(
    "t25_main_content",
    rf"""+ h AS (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<(script|style|noscript|template|head)\b.*?</(script|style|noscript|template|head)>', ' ', 'g') AS html FROM pages),
    c AS (SELECT page_id, string_split(regexp_replace(html, '(?i)(</?({"|".join(density.BLOCKS)})[\s/>])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM h),
    u AS (SELECT page_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM c),
    x AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(part, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text, trim(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(part, '(?is)<a\s[^>]*>(.*?)</a>', 1), ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS links FROM u),
    s AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k, text, length(text) - {density.LINK} * length(links) - {density.COST} AS score FROM x WHERE text <> ''),
    p AS (SELECT page_id, 0 AS k, 0 AS upto FROM pages UNION ALL SELECT page_id, k, sum(score) OVER (PARTITION BY page_id ORDER BY k) FROM s), w AS (SELECT *, min(upto) OVER (PARTITION BY page_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS low FROM p),
    e AS (SELECT page_id, k AS last, upto - low AS best, low FROM w WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY upto - low DESC, k) = 1 AND upto > low),
    b AS (SELECT e.page_id, best, last, min(p.k) + 1 AS first FROM e JOIN p ON p.page_id = e.page_id AND p.k < last AND p.upto = low GROUP BY ALL)
    SELECT n.page_id, n.segments, b.first, b.last, CAST(b.best AS BIGINT) AS score, md5(t.text) AS text_md5 FROM (SELECT page_id, count(text) AS segments FROM pages LEFT JOIN s USING (page_id) GROUP BY 1) n LEFT JOIN b USING (page_id) LEFT JOIN (SELECT s.page_id, string_agg(text, chr(10) ORDER BY k) AS text FROM s JOIN b ON b.page_id = s.page_id AND k BETWEEN first AND last GROUP BY 1) t USING (page_id)""".replace("GROUP BY ALL)", "GROUP BY e.page_id, best, last)"),
)
def t25_main_content(spark, d):
    """The main content of the pages as they are, by density."""
    df = table(spark, d, "pages").select("page_id", density.segments(F.col("html")).alias("found")).withColumn("best", density.best_run(F.col("found")))
    return df.select("page_id", F.size("found").cast("bigint").alias("segments"), F.col("best.first").cast("bigint").alias("first"), F.col("best.last").cast("bigint").alias("last"), F.col("best.score").cast("bigint").alias("score"), F.md5(density.content(F.col("found"), F.col("best"))).alias("text_md5"))


@add("r10_rate_convert", f"SELECT id, round({TOP_SQL}, 3) AS top FROM jobs")
def r10(spark, d):
    from postflow.functions.values import annual, convert

    top = annual(F.col("salary_max"), F.col("salary_period"))
    known = F.col("salary_currency").isNull() | (F.col("salary_currency") == "EUR")
    return jobs(spark, d).select("id", F.round(F.when(known, top).otherwise(convert(top, F.col("salary_currency"), F.lit("EUR"), RULES.rates)), 3).alias("top"))


BOOSTS = R.Rules(boosts={"founding_engineer": 1.3, "tag_ai": 1.2, "recent_batch": 1.1})


@add(
    "r13_boosts",
    f"+ t AS (SELECT id, lower(title || ' ' || {quoted(TITLE_TAILS)}[id % {len(TITLE_TAILS)} + 1]) AS t, batch FROM jobs LEFT JOIN titles USING (id) LEFT JOIN companies USING (company_id)) SELECT id, round(CASE WHEN contains(t, 'founding') THEN 1.3::DOUBLE ELSE 1 END * CASE WHEN regexp_matches(t, '{T.ROLE_FAMILIES[0][1]}') THEN 1.2::DOUBLE ELSE 1 END * CASE WHEN 97 - CAST(batch[2:3] AS INTEGER) <= 2 THEN 1.1::DOUBLE ELSE 1 END, 3) AS boost FROM t",
)
def r13(spark, d):
    """Boosts for founding roles, work on AI and companies of a recent batch (seen from 2097, as the batches are of the nineties); what is unknown boosts nothing."""
    df = jobs(spark, d).join(titles(spark, d), "id", "left").join(companies(spark, d), "company_id", "left")
    title = F.concat("title", F.lit(" "), pick(F.col("id"), TITLE_TAILS))
    return df.select("id", F.round(R.boost(BOOSTS, R.signs(title, F.col("batch"), 2097)), 3).alias("boost"))


@add("a11_reason_histogram", f"+ {POSTINGS_SQL} SELECT code, count(*) AS n FROM (SELECT unnest({CODES_SQL}) AS code FROM postings) GROUP BY 1")
def a11(spark, d):
    """Every rule's code or null becomes a row: an array that is built there needs no filter of its own, so codes are in the plan once."""
    codes = postings(spark, d).select(F.explode(F.array(*reasons())).alias("code"))
    return codes.where("code is not null").groupBy("code").agg(F.count("*").alias("n"))


@add("a12_market_pass_counts", f"+ {POSTINGS_SQL} SELECT market, count(*) FILTER (WHERE len(codes) = 0) AS passed, count(*) FILTER (WHERE len(codes) > 0) AS failed FROM (SELECT market, {CODES_SQL} AS codes FROM postings) GROUP BY 1")
def a12(spark, d):
    return verdicts(spark, d).groupBy("market").agg(F.count_if("verdict.passed").alias("passed"), F.count_if(~F.col("verdict.passed")).alias("failed"))


# clustering


COUNTRIES = ("US", None, "US", "GB", None, "US")
CITIES = ("New York", "New York City", "", None, "Boston", "new york", "New York")
LEVELS = ("senior", None, "senior", "junior", "senior")


def records(spark, d):
    """Documents as postings: the language and the first three words stand for company and title; every 19th has no description yet."""
    key = F.col("doc_id")
    docs = table(spark, d, "documents").select(
        key.alias("key"),
        F.concat_ws("|", F.col("lang"), F.array_join(F.slice(T.tokens(F.col("text")), 1, 3), " ")).alias("block"),
        pick(key, COUNTRIES).alias("country"),
        pick(key, CITIES).alias("city"),
        pick(key, LEVELS).alias("seniority"),
        F.when(key % 19 != 0, T.simhash_md5(F.col("text"))).alias("h"),
    )
    return saved(docs.select("key", "block", "h.hi", "h.lo", "country", "city", "seniority"))


def _list_sql(values):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


RECORDS_SQL = f"""{SIMHASH_SQL}, r AS MATERIALIZED (SELECT d.doc_id, concat_ws('|', d.lang, array_to_string(list_slice(w.w, 1, 3), ' ')) AS block, CASE WHEN d.doc_id % 19 <> 0 THEN hi END AS hi, CASE WHEN d.doc_id % 19 <> 0 THEN lo END AS lo,
    {_list_sql(COUNTRIES)}[d.doc_id % 6 + 1] AS country, {_list_sql(CITIES)}[d.doc_id % 7 + 1] AS city, {_list_sql(LEVELS)}[d.doc_id % 5 + 1] AS seniority FROM documents d JOIN w USING (doc_id) LEFT JOIN simhash USING (doc_id)),
    t AS (SELECT *, regexp_extract_all(lower(coalesce(city, '')), '[a-z0-9]+') AS words FROM r)"""
SAME_SQL = """a.block = b.block AND a.doc_id < b.doc_id AND (a.hi IS NULL OR b.hi IS NULL OR bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 12)
    AND (a.country IS NULL OR b.country IS NULL OR a.country = b.country) AND (a.seniority IS NULL OR b.seniority IS NULL OR a.seniority = b.seniority)
    AND (len(a.words) = 0 OR len(b.words) = 0 OR list_has_all(a.words, b.words) OR list_has_all(b.words, a.words))"""
EDGES_SQL = f"{RECORDS_SQL}, edges AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM t a JOIN t b ON {SAME_SQL})"


@add("j14_near_pairs", f"+ {EDGES_SQL} SELECT u, v FROM edges")
def j14(spark, d):
    """Every two records that are adjacent."""
    return pairs(records(spark, d))


@add(
    "j14_link_counts",
    f"+ {EDGES_SQL}, e AS (SELECT u AS k FROM edges UNION ALL SELECT v FROM edges), c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY block, hi, lo, country, city, seniority) AS rep FROM r) SELECT doc_id, rep, coalesce(n, 0) AS links FROM c LEFT JOIN (SELECT k, count(*) AS n FROM e GROUP BY 1) ON k = doc_id",
)
def j14_link_counts(spark, d):
    """Each record with the earliest of those that agree with it in all that is compared, and the number of records that it is adjacent to."""
    return linked(records(spark, d)).select(F.col("key").alias("doc_id"), "rep", "links")


#: Rounds until no record is open: one with an earlier adjacent head is none, one whose earlier adjacent records are none is a head.
STATES_SQL = """states AS MATERIALIZED (WITH RECURSIVE s AS (SELECT 0 AS n, doc_id AS k, CASE WHEN doc_id IN (SELECT v FROM edges) THEN NULL ELSE true END AS h FROM r
    UNION ALL SELECT s.n + 1, s.k, coalesce(s.h, x.h) FROM s LEFT JOIN (SELECT v, CASE WHEN bool_or(coalesce(p.h, false)) THEN false WHEN bool_and(coalesce(NOT p.h, false)) THEN true END AS h FROM edges JOIN s p ON p.k = u GROUP BY 1) x ON x.v = s.k
    WHERE (SELECT bool_or(h IS NULL) FROM s)) SELECT k, h FROM s WHERE n = (SELECT max(n) FROM s))"""
HEADS_SQL = f"{EDGES_SQL}, {STATES_SQL}, heads AS (SELECT s.k AS doc_id, CASE WHEN s.h THEN s.k ELSE x.head END AS head FROM states s LEFT JOIN (SELECT v, min(u) AS head FROM edges JOIN states p ON p.k = u AND p.h GROUP BY 1) x ON x.v = s.k)"


@add("g01_greedy_clusters", f"+ {HEADS_SQL} SELECT doc_id, head FROM heads")
def g01(spark, d):
    return clustered(records(spark, d)).select(F.col("key").alias("doc_id"), "head")


@add("g02_scoped_clusters", f"+ {HEADS_SQL} SELECT h.doc_id, head FROM heads h JOIN r USING (doc_id) WHERE block IN (SELECT block FROM r WHERE doc_id % 100 = 1)")
def g02(spark, d):
    """Only the blocks that new records touch are clustered again."""
    df = records(spark, d)
    touched = df.where("key % 100 = 1").select("block").distinct()
    return clustered(df.join(touched, "block", "left_semi")).select(F.col("key").alias("doc_id"), "head")


@add("g03_changed_heads", f"+ {HEADS_SQL} SELECT count(*) AS changed FROM heads WHERE head IS DISTINCT FROM (CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE head END)")
def g03(spark, d):
    found = g01(spark, d).withColumn("stored", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("head")))
    return found.where(~F.col("head").eqNullSafe(F.col("stored"))).agg(F.count("*").alias("changed"))


CITY_TAILS = ("", " City", " metal", "!", None)


@add(
    "g04_city_conflict",
    f"SELECT p_partkey, coalesce(len(a) > 0 AND len(b) > 0 AND NOT (list_has_all(a, b) OR list_has_all(b, a)), false) AS conflict FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS a, regexp_extract_all(lower(split_part(p_name, ' ', 1) || {_list_sql(CITY_TAILS)}[p_partkey % 5 + 1]), '[a-z0-9]+') AS b FROM part)",
)
def g04(spark, d):
    other = F.concat(F.substring_index("p_name", " ", 1), pick(F.col("p_partkey"), CITY_TAILS))
    return table(spark, d, "part").select("p_partkey", city_conflict(F.col("p_name"), other).alias("conflict"))


# upsert and lifecycle


def stored_and_listed(spark, d):
    """What is stored (without every fourth posting) and what a run lists (without every third): bodies shorter or missing, pay and posters lost."""
    k, none = F.col("id"), F.lit(None).cast("string")
    df = jobs(spark, d)

    def row(title, text, full, pay, poster):
        body = {"description_html": none, "description_text": text, "description_md": none, "description_lang": F.when(text.isNotNull(), "en"), "jd_completeness": F.when(text.isNull(), "none").when(full, "full").otherwise("snippet"), "jd_source": F.when(text.isNotNull(), "api"), "jd_extracted_at": none, "description_hash": F.md5(text)}
        money = {"salary_min": none.cast("double"), "salary_max": F.when(pay, F.col("salary_max")), "salary_currency": F.when(pay, "EUR"), "salary_period": F.when(pay, "annual"), "salary_is_stated": pay}
        return {"title": title, "location_raw": none} | body | money | {"poster_name": poster, "poster_profile_url": F.when(poster.isNotNull(), F.concat(F.lit("u/"), poster))}

    def made(rows, fields):
        return rows.select("id", "is_active", "missed_runs", "salary_max").select("id", F.col("is_active").alias("active"), F.col("missed_runs").alias("missed"), *(c.alias(n) for n, c in fields.items()))

    old = row(F.lit("role"), F.concat(F.lit("Old body "), k), k % 2 == 0, k % 2 == 1, F.when(k % 3 == 1, "Ann"))
    new = row(F.when(k % 5 == 0, "changed").otherwise("role"), F.when(k % 6 != 0, F.when(k % 10 == 1, "New  body").otherwise(F.concat(F.lit("old BODY "), k))), k % 4 == 1, k % 7 != 0, F.when(k % 7 == 0, "Bob"))
    stored = made(df.where(k % 4 != 0), old).withColumns({"content_hash": T.content_hash(F.col("title"), F.col("location_raw"), F.col("description_text")), "repost_count": F.lit(0), "missed_runs": F.col("missed"), "is_active": F.col("active")})
    return stored.drop("active", "missed"), made(df.where(k % 3 != 0), new).drop("active", "missed")


@add(
    "g05_upsert",
    """+ o AS (SELECT id, 'role' AS title, 'Old body ' || id AS text, id % 2 = 0 AS whole, CASE WHEN id % 2 = 1 THEN salary_max END AS pay, CASE WHEN id % 3 = 1 THEN 'Ann' END AS poster, is_active, missed_runs FROM jobs WHERE id % 4 <> 0),
    n AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE 'role' END AS title, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 10 = 1 THEN 'New  body' ELSE 'old BODY ' || id END AS text, id % 4 = 1 AS whole, CASE WHEN id % 7 <> 0 THEN salary_max END AS pay, CASE WHEN id % 7 = 0 THEN 'Bob' END AS poster FROM jobs WHERE id % 3 <> 0),
    b AS (SELECT coalesce(o.id, n.id) AS id, o.id IS NULL AS is_new, n.id IS NULL AS absent, coalesce(n.title, o.title) AS title, o.title AS old_title, o.text AS old_text, o.id IS NOT NULL AND (n.id IS NULL OR n.text IS NULL OR (o.whole AND NOT n.whole)) AS keep,
        o.text AS o_text, n.text AS n_text, o.whole AS o_whole, n.whole AS n_whole, o.pay AS o_pay, n.pay AS n_pay, coalesce(n.poster, o.poster) AS poster, coalesce(o.is_active, true) AS was_active, coalesce(missed_runs, 0) AS missed FROM o FULL JOIN n ON o.id = n.id),
    c AS (SELECT *, CASE WHEN keep THEN o_text ELSE n_text END AS text, CASE WHEN keep THEN o_whole ELSE n_whole END AS whole, CASE WHEN absent OR (o_pay IS NOT NULL AND n_pay IS NULL) THEN o_pay ELSE n_pay END AS pay FROM b)
    SELECT id, title, text, CASE WHEN text IS NULL THEN 'none' WHEN whole THEN 'full' ELSE 'snippet' END AS jd_completeness, md5(text) AS description_hash, pay AS salary_max, poster AS poster_name,
    CASE WHEN is_new THEN 'new' WHEN absent THEN 'absent' WHEN title = old_title AND lower(regexp_replace(text, '\\s+', ' ', 'g')) = lower(old_text) THEN 'unchanged' ELSE 'updated' END AS outcome,
    CASE WHEN NOT is_new AND NOT absent AND NOT was_active THEN 1 ELSE 0 END AS repost_count, CASE WHEN absent THEN missed ELSE 0 END AS missed_runs, CASE WHEN absent THEN was_active ELSE true END AS is_active FROM c""",
)
def g05(spark, d):
    found = upserted(*stored_and_listed(spark, d))
    return found.select("id", "title", F.col("description_text").alias("text"), "jd_completeness", "description_hash", "salary_max", "poster_name", "outcome", "repost_count", "missed_runs", "is_active")


@add("g06_row_derivation", "SELECT page_id, length(body) AS chars, CASE WHEN length(body) >= 400 THEN 'full' WHEN length(body) = 0 THEN 'none' ELSE 'snippet' END AS completeness, md5(body) AS hash FROM (SELECT page_id, " + html_sql("html") + " AS body FROM pages)")
def g06(spark, d):
    df = table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("body"))
    return df.select("page_id", F.length("body").cast("bigint").alias("chars"), T.completeness(F.col("body")).alias("completeness"), F.md5("body").alias("hash"))


def latest_run(spark, d, cut_at=12):
    """(board_id, job_id, listed, cut): each posting of a board and whether the latest run listed it. A listing of cut_at postings or more came cut short."""
    seen = listings(spark, d).groupBy("board_id", "job_id").agg(F.max("run").alias("run"))
    last = seen.groupBy("board_id").agg(F.max("run").alias("last"))
    seen = seen.join(last, "board_id").withColumn("listed", F.col("run") == F.col("last"))
    size = seen.where("listed").groupBy("board_id").agg((F.count("*") >= cut_at).alias("cut"))
    return seen.join(size, "board_id").select("board_id", "job_id", "listed", "cut")


LATEST_SQL = "seen AS (SELECT board_id, job_id, max(run) AS run FROM listings GROUP BY 1, 2), latest AS (SELECT *, run = max(run) OVER (PARTITION BY board_id) AS listed FROM seen), sized AS (SELECT *, count(*) FILTER (WHERE listed) OVER (PARTITION BY board_id) >= 12 AS cut FROM latest)"


@add(
    "g07_deactivate_missing",
    f"+ {LATEST_SQL} SELECT s.board_id, id, CASE WHEN cut AND NOT listed THEN missed_runs WHEN listed THEN 0 ELSE missed_runs + 1 END AS missed_runs, CASE WHEN listed THEN true WHEN cut THEN is_active ELSE is_active AND missed_runs + 1 < 2 END AS is_active FROM jobs JOIN sized s ON id = job_id",
)
def g07(spark, d, grace=2):
    """A posting that its board's latest run lists is active; else it has missed one more run. A listing that was cut short retires nothing."""
    df = jobs(spark, d).join(latest_run(spark, d).withColumnRenamed("job_id", "id"), "id")
    listed, cut = F.col("listed"), F.col("cut")
    missed = F.when(listed, 0).when(cut, F.col("missed_runs")).otherwise(F.col("missed_runs") + 1)
    active = F.when(listed, True).when(cut, F.col("is_active")).otherwise(F.col("is_active") & (F.col("missed_runs") + 1 < grace))
    return df.select("board_id", "id", missed.alias("missed_runs"), active.alias("is_active"))


COUNT_SQL = "o AS (SELECT b.*, coalesce(n, 0) AS n FROM boards b LEFT JOIN (SELECT board_id, count(DISTINCT job_id) AS n FROM listings WHERE run = (SELECT max(run) FROM listings) GROUP BY 1) USING (board_id))"


def outcomes(spark, d):
    """Boards with the number of postings that the latest run of all found there."""
    run = listings(spark, d)
    last = run.agg(F.max("run").alias("run"))
    found = run.join(F.broadcast(last), "run").groupBy("board_id").agg(F.count_distinct("job_id").alias("n"))
    return boards(spark, d).join(found, "board_id", "left").fillna(0, ["n"])


@add(
    "g08_board_outcome",
    f"+ {COUNT_SQL} SELECT board_id, n, CASE WHEN n > 0 THEN 'validated' ELSE 'empty' END AS status, CASE WHEN n > 0 THEN 'warm' ELSE 'cold' END AS tier, CASE WHEN n = 0 THEN TIMESTAMP '2001-09-01' WHEN provider = 'feed' THEN TIMESTAMP '2001-08-03' ELSE TIMESTAMP '2001-08-09' END AS next_fetch_at FROM o",
)
def g08(spark, d):
    """After a good fetch: postings make a board validated and warm (again in a week, a feed in a day), none make it empty and cold (in thirty days)."""
    some = F.col("n") > 0
    wait = F.when(~some, 30).when(F.col("provider") == "feed", 1).otherwise(7)
    return outcomes(spark, d).select("board_id", "n", F.when(some, "validated").otherwise("empty").alias("status"), F.when(some, "warm").otherwise("cold").alias("tier"), (now() + F.make_dt_interval(wait)).alias("next_fetch_at"))


@add(
    "g09_failure_ageing",
    f"+ {COUNT_SQL} SELECT board_id, CASE WHEN n = 0 THEN errors + 1 ELSE 0 END AS errors, n = 0 AND (status = 'candidate' OR errors + 1 >= 3) AS died, CASE WHEN n = 0 AND (status = 'candidate' OR errors + 1 >= 3) THEN 'dead' ELSE status END AS status, CASE WHEN n > 0 THEN next_fetch_at WHEN status = 'candidate' OR errors + 1 >= 3 THEN NULL ELSE TIMESTAMP '2001-08-03' END AS next_fetch_at FROM o",
)
def g09(spark, d, dead_at=3):
    """A board that the latest run could not list ages: a candidate dies at once, others at the third failure in a row, else the next try is in a day."""
    failed = F.col("n") == 0
    errors = F.when(failed, F.col("errors") + 1).otherwise(0)
    dies = failed & ((F.col("status") == "candidate") | (errors >= dead_at))
    due = F.when(~failed, F.col("next_fetch_at")).when(~dies, now() + F.make_dt_interval(F.lit(1)))
    return outcomes(spark, d).select("board_id", errors.alias("errors"), dies.alias("died"), F.when(dies, "dead").otherwise(F.col("status")).alias("status"), due.alias("next_fetch_at"))


@add("g10_incremental", "SELECT id FROM jobs WHERE id NOT IN (SELECT job_id FROM scores WHERE job_id % 4 <> 1)")
def g10(spark, d):
    """Postings that no verdict under the current rules covers; every fourth verdict is from older rules."""
    mark = R.fingerprint(RULES)
    done = scores(spark, d).withColumn("rules", F.when(F.col("job_id") % 4 == 1, "older").otherwise(F.lit(mark))).where(F.col("rules") == mark)
    return jobs(spark, d).join(done.select(F.col("job_id").alias("id")), "id", "left_anti").select("id")


@add(
    "g11_verdict_intake",
    """+ r AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'x' || doc_id ELSE CAST(doc_id * 2 AS VARCHAR) END AS id, CASE WHEN doc_id % 9 = 0 THEN 1.5 ELSE quality END AS score FROM labels),
    c AS (SELECT TRY_CAST(id AS BIGINT) AS doc_id, score FROM r)
    SELECT count(*) AS read, count(*) FILTER (WHERE c.doc_id IS NULL OR score NOT BETWEEN 0 AND 1) AS invalid, count(*) FILTER (WHERE c.doc_id IS NOT NULL AND score BETWEEN 0 AND 1 AND d.doc_id IS NULL) AS unknown, count(*) FILTER (WHERE score BETWEEN 0 AND 1 AND d.doc_id IS NOT NULL) AS written
    FROM c LEFT JOIN documents d USING (doc_id)""",
)
def g11(spark, d):
    raw = table(spark, d, "labels").select(F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("x"), "doc_id")).otherwise((F.col("doc_id") * 2).cast("string")).alias("id"), F.when(F.col("doc_id") % 9 == 0, 1.5).otherwise(F.col("quality")).alias("score"))
    known = table(spark, d, "documents").select("doc_id", F.lit(True).alias("known"))
    df = raw.withColumn("doc_id", F.col("id").try_cast("bigint")).join(known, "doc_id", "left")
    valid = F.col("doc_id").isNotNull() & F.col("score").between(0, 1)
    return df.agg(F.count("*").alias("read"), F.count_if(~valid).alias("invalid"), F.count_if(valid & F.col("known").isNull()).alias("unknown"), F.count_if(valid & F.col("known").isNotNull()).alias("written"))


GATE_SQL = f"g AS (SELECT p.*, {CODES_SQL} AS codes, CASE WHEN doc_id IS NULL OR doc_id % 8 = 5 THEN NULL WHEN {listed(CODES)}[doc_id % 8 + 1] NOT IN ('', 'DE', 'FR') THEN 'auth_required' WHEN doc_id % 8 = 4 AND place NOT IN ('', 'DE', 'FR') THEN 'no_sponsorship' END AS late FROM postings p LEFT JOIN (SELECT doc_id FROM documents) ON doc_id = id)"


@add("g12_gate_writeback", f"+ {POSTINGS_SQL}, {GATE_SQL} SELECT id, array_to_string(CASE WHEN late IS NULL OR list_contains(codes, late) THEN codes ELSE list_append(codes, late) END, ',') AS codes, len(codes) = 0 AND late IS NULL AS passed FROM g")
def g12(spark, d):
    """What the reader of a posting's text found on authorisation can fail a posting that had passed; its code joins the others."""
    read = told(spark, d).select(F.col("doc_id").alias("id"), stated(F.col("text")).alias("said")).select("id", "said.required", "said.sponsorship")
    df = verdicts(spark, d).join(read, "id", "left")
    late = decision(F.coalesce("required", F.array().cast("array<string>")), F.col("sponsorship"), F.nullif("place", F.lit("")), ("DE", "FR"), True)
    codes = F.when(late.isNull() | F.array_contains("verdict.codes", late), F.col("verdict.codes")).otherwise(F.array_append("verdict.codes", late))
    return df.select("id", F.array_join(codes, ",").alias("codes"), (F.col("verdict.passed") & late.isNull()).alias("passed"))


@add("g13_red_flags", f"+ {POSTINGS_SQL} SELECT id, array_to_string(list_slice(codes, 1, 3), '; ') AS flags FROM (SELECT id, {CODES_SQL} AS codes FROM postings)")
def g13(spark, d, most=3):
    return verdicts(spark, d).select("id", F.array_join(F.slice("verdict.codes", 1, most), "; ").alias("flags"))


THRESHOLDS = {"P": 0.65, "F": 0.7, "O": 0.6}


def candidates(spark, d, known):
    """Scored, passing, fresh postings of clusters not acted on, with their rank. known: the jobs, built once."""
    keep = verdicts(spark, d, known).where(F.col("days") <= 365).where(active_canonical()).where((F.col("salary_max") >= 50000) & (F.col("segment") != "HOUSEHOLD"))
    own = scores(spark, d).withColumnsRenamed({"job_id": "id", "profile": "market"}).select("id", "market", "llm_score")
    df = keep.join(own, ["id", "market"]).withColumn("cluster", cluster()).join(acted_on(spark, d, known), "cluster", "left_anti")
    bar = F.create_map(*[F.lit(x) for kv in THRESHOLDS.items() for x in kv])[F.col("market")]
    rank = F.round(F.coalesce("llm_score", F.lit(0.0)) * F.when(F.col("segment") == "MACHINERY", 1.2).otherwise(1.0), 6)
    return df.withColumns({"bar": bar, "rank_key": rank})


def first_of(spark, d, above, limit):
    """The first candidates above their bar, or below it, and the jobs."""
    known = saved(jobs(spark, d))
    bar = (F.col("llm_score") >= F.col("bar")) == F.lit(above)
    return candidates(spark, d, known).where(bar).orderBy(F.desc("rank_key"), F.desc("id")).limit(limit), known


CANDIDATES_SQL = f"""{ACTED_SQL}, {POSTINGS_SQL}, al AS (SELECT coalesce(canonical_id, id) AS cluster, list_sort(list_distinct(list(source))) AS sources FROM jobs GROUP BY 1),
    cand AS (SELECT p.*, llm_score, CASE market WHEN 'P' THEN 0.65 WHEN 'F' THEN 0.7 ELSE 0.6 END AS bar, round(coalesce(llm_score, 0) * CASE WHEN segment = 'MACHINERY' THEN 1.2::DOUBLE ELSE 1 END, 6) AS rank_key,
    array_to_string(list_filter(sources, lambda x: x <> source), ',') AS also_on FROM postings p JOIN scores ON id = job_id AND profile = market JOIN al ON al.cluster = coalesce(canonical_id, id)
    WHERE days <= 365 AND is_active AND (canonical_id IS NULL OR canonical_id = id) AND salary_max >= 50000 AND segment <> 'HOUSEHOLD' AND coalesce(canonical_id, id) NOT IN (SELECT cluster FROM acted))"""


@add("g14_shortlist", f"+ {CANDIDATES_SQL} SELECT id AS job_id, name AS company, market, source, llm_score AS score, rank_key, salary_max AS salary, days AS age_days, also_on FROM cand WHERE llm_score >= bar ORDER BY rank_key DESC, id DESC LIMIT 15")
def g14(spark, d, limit=15):
    """The other sources of a cluster are looked up for the listed clusters only."""
    top, known = first_of(spark, d, True, limit)
    top = saved(top)
    sources = known.withColumn("cluster", cluster()).join(F.broadcast(top.select("cluster")), "cluster", "left_semi").groupBy("cluster").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    df = top.join(sources, "cluster").withColumn("others", F.array_join(F.array_remove("sources", F.col("source")), ","))
    return df.select(F.col("id").alias("job_id"), F.col("name").alias("company"), "market", "source", F.col("llm_score").alias("score"), "rank_key", F.col("salary_max").alias("salary"), F.col("days").alias("age_days"), F.col("others").alias("also_on"))


@add("g14_near_misses", f"+ {CANDIDATES_SQL} SELECT id AS job_id, market, llm_score AS score FROM cand WHERE llm_score < bar ORDER BY rank_key DESC, id DESC LIMIT 6")
def g14b(spark, d):
    return first_of(spark, d, False, 6)[0].select(F.col("id").alias("job_id"), "market", F.col("llm_score").alias("score"))


#: Which states an application may go to from each. Fixed values.
TRANSITIONS = {
    "new": ("surfaced", "interested", "tailored", "applied", "skipped"),
    "surfaced": ("interested", "tailored", "applied", "skipped"),
    "interested": ("tailored", "applied", "skipped"),
    "tailored": ("applied", "skipped", "interested"),
    "applied": ("screening", "interview", "rejected", "ghosted", "offer"),
    "screening": ("interview", "rejected", "ghosted", "offer"),
    "interview": ("offer", "rejected", "ghosted"),
    "offer": ("rejected",),
    "rejected": (),
    "ghosted": ("screening", "interview", "rejected"),
    "skipped": (),
}
EDGE_SQL = "[" + ",".join(f"'{a}>{b}'" for a, bs in TRANSITIONS.items() for b in bs) + "]"
STATES = tuple(TRANSITIONS)


@add("g15_state_machine", f"SELECT id, before, after, list_contains({EDGE_SQL}, before || '>' || after) AS allowed FROM (SELECT id, {quoted(STATES)}[id % 11 + 1] AS before, {quoted(STATES)}[id // 11 % 11 + 1] AS after FROM jobs)")
def g15(spark, d):
    """Every posting asks for one of the 121 steps between the eleven states."""
    steps = F.array(*[F.lit(f"{a}>{b}") for a, bs in TRANSITIONS.items() for b in bs])
    df = jobs(spark, d).select("id", pick(F.col("id"), STATES).alias("before"), pick(F.floor(F.col("id") / len(STATES)), STATES).alias("after"))
    return df.withColumn("allowed", F.array_contains(steps, F.concat("before", F.lit(">"), "after")))


@add("g16_ghosted", "SELECT job_id, CASE WHEN status = 'applied' AND applied_at < TIMESTAMP '2001-07-03' THEN 'ghosted' ELSE status END AS status FROM applications")
def g16(spark, d):
    stale = (F.col("status") == "applied") & (F.col("applied_at") < now() - F.expr("interval 30 days"))
    return applications(spark, d).select("job_id", F.when(stale, "ghosted").otherwise(F.col("status")).alias("status"))


ACTIONS = {"signup": "applied", "purchase": "screening", "click": "skipped", "error": "undo"}


@add(
    "g17_cluster_latest",
    "+ l AS (SELECT user_id AS cluster, ts, event_id, CASE event_type WHEN 'signup' THEN 'applied' WHEN 'purchase' THEN 'screening' WHEN 'click' THEN 'skipped' WHEN 'error' THEN 'undo' END AS status FROM events WHERE event_type <> 'view'), n AS (SELECT *, lead(status) OVER (PARTITION BY cluster ORDER BY ts, event_id) AS after FROM l) SELECT cluster, arg_max(status, (ts, event_id)) AS status FROM n WHERE status <> 'undo' AND after IS DISTINCT FROM 'undo' GROUP BY 1",
)
def g17(spark, d):
    """The log of a cluster (here: a user's events) comes down to the last action that was not undone."""
    log = table(spark, d, "events").where("event_type <> 'view'").select(F.col("user_id").alias("cluster"), "ts", "event_id", literal_map(ACTIONS)[F.col("event_type")].alias("status"))
    return last_standing(log, "cluster", ["ts", "event_id"])


BANK = (("site", "host", r"([a-z0-9-]+)\.example\.(?:com|net|org)"),)
HARVEST_SQL = "SELECT page_id, lower(regexp_extract(url, '(?i)([a-z0-9-]+)\\.example\\.(?:com|net|org)', 1)) AS token FROM pages"


@add("t20_url_scan", f"SELECT page_id, 'site' AS provider, token FROM ({HARVEST_SQL}) WHERE token NOT IN ('', 'www', 'blog')")
def t20(spark, d):
    found = table(spark, d, "pages").select("page_id", F.inline(board_hits(F.col("url"), BANK)))
    return found.select("page_id", "provider", "token")


#: Links to boards of every platform, with {} for the customer. Fixed values of the bindings.
LINKS = (
    ("recruitee", "https://{}.recruitee.com/o/x"),
    ("personio", "https://{}.jobs.personio.de/job/1"),
    ("teamtailor", "https://{}.teamtailor.com/jobs"),
    ("workable", "https://{}.workable.com/j/AB"),
    ("ashby", "https://jobs.ashbyhq.com/{}/1"),
    ("ashby", "https://embed.ashbyhq.com/{}"),
    ("ashby", "https://api.ashbyhq.com/posting-api/job-board/{}?x"),
    ("greenhouse", "https://boards.greenhouse.io/embed/job_board?x=1&amp;for={}"),
    ("greenhouse", "https:\\/\\/job-boards.greenhouse.io\\/{}\\/jobs"),
    ("greenhouse", "https://boards-api.greenhouse.io/v1/boards/{}/jobs"),
    ("lever", "https://jobs.eu.lever.co/{}/1"),
    ("lever", "https://api.lever.co/v0/postings/{}"),
    ("workable", "https://apply.workable.com/{}/j/AB/"),
    ("smartrecruiters", "https://careers.smartrecruiters.com/{}"),
    ("smartrecruiters", "https://api.smartrecruiters.com/v1/companies/{}/postings"),
    ("workday", "https://{}.wd5.myworkdayjobs.com/en-US/Careers"),
    (None, "https://jobs.lever.co/12345 https://{}.example.org/careers"),
)


@add("t20_platform_boards", f"SELECT page_id, {listed(tuple(p for p, _ in LINKS))}[page_id % {len(LINKS)} + 1] AS provider, 'acme' || page_id || CASE WHEN page_id % {len(LINKS)} = {len(LINKS) - 2} THEN '/wd5/Careers' ELSE '' END AS token FROM pages WHERE page_id % {len(LINKS)} < {len(LINKS) - 1}")
def t20_platforms(spark, d):
    """A link of every kind inside a text, some of them escaped; what names no customer is no board."""
    link = F.replace(pick(F.col("page_id"), tuple(x for _, x in LINKS)), F.lit("{}"), F.concat(F.lit("acme"), "page_id"))
    found = table(spark, d, "pages").select("page_id", F.inline(board_hits(F.concat(F.lit("see "), link, F.lit(" now")))))
    return found.select("page_id", "provider", "token")


@add("t21_clean_token", "SELECT page_id, CASE WHEN NOT regexp_matches(t, '^[0-9]+$') AND NOT regexp_matches(lower(t), '\\.html$') THEN t END AS token FROM (SELECT page_id, regexp_extract(url, '([^/?#]+)/?([?#].*)?$', 1) AS t FROM pages)")
def t21(spark, d):
    return table(spark, d, "pages").select("page_id", customer(F.regexp_extract("url", "([^/?#]+)/?([?#].*)?$", 1)).alias("token"))


@add("t22_registrable", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages")
def t22(spark, d):
    return table(spark, d, "pages").select("page_id", registrable(F.col("url")).alias("domain"))


@add("t22_domain_hints", "SELECT page_id, 'feed' AS provider, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', '') AS domain FROM pages WHERE contains(url, 'utm_source=')")
def t22b(spark, d):
    return table(spark, d, "pages").select("page_id", F.inline(domain_hints(F.col("url"), (("feed", r"[?&]utm_source="),))))


@add(
    "g18_harvest",
    f"""+ t AS ({HARVEST_SQL}), s AS (SELECT token, page_id, page_id % 7 AS company FROM t WHERE token NOT IN ('', 'www', 'blog')), w AS (SELECT max(page_id) // 2 AS w FROM pages),
    h AS (SELECT token, page_id, company FROM s, w WHERE page_id > w UNION ALL SELECT 'seen' || (page_id % 9), page_id, NULL FROM pages, w WHERE page_id > w),
    k AS (SELECT DISTINCT token, CASE WHEN length(token) % 2 = 0 THEN 99 END AS own FROM s, w WHERE page_id <= w)
    SELECT h.token, coalesce(max(own), arg_min(company, page_id) FILTER (WHERE company IS NOT NULL)) AS company_id, CASE WHEN max(k.token) IS NULL THEN 'new' WHEN max(own) IS NULL AND count(company) > 0 THEN 'linked' ELSE 'known' END AS outcome FROM h LEFT JOIN k ON h.token = k.token GROUP BY 1""",
)
def g18(spark, d):
    """Pages past the watermark: links in their address name a company's board, links in their body a board of anyone. Boards seen before it are known, half of them without a company."""
    pages = table(spark, d, "pages")
    watermark = (pages.agg(F.max("page_id")).first()[0] or 0) // 2
    found = lambda text: pages.select("page_id", F.inline(board_hits(text, BANK)))
    own = found(F.col("url"))
    body = found(F.concat(F.lit("see https://seen"), F.col("page_id") % 9, F.lit(".example.com/jobs")))
    past = F.col("page_id") > watermark
    hit = lambda df, company: df.where(past).select("provider", "token", F.col("page_id").alias("at"), company.alias("company_id"))
    hits = hit(own, F.col("page_id") % 7).unionByName(hit(body, F.lit(None).cast("bigint")))
    known = own.where(~past).select("provider", "token").distinct().withColumn("company_id", F.when(F.length("token") % 2 == 0, 99).cast("bigint"))
    return harvested(hits, known).select("token", "company_id", "outcome")


@add("g19_renormalise", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) <> text AS changed FROM documents")
def g19(spark, d):
    return table(spark, d, "documents").select("doc_id", (T.squeezed(F.col("text")) != F.col("text")).alias("changed"))


@add(
    "g20_routing",
    "SELECT company_id, CASE WHEN company_id % 4 = 0 THEN 'dm' WHEN company_id % 5 = 0 THEN 'free_inmail' END AS route, CASE WHEN company_id % 4 = 0 THEN 'dm' WHEN company_id % 5 = 0 THEN 'free_inmail' WHEN balance > 0 THEN 'invite_note,invite_then_dm,paid_inmail' ELSE 'invite_note,invite_then_dm' END AS allowed FROM companies",
)
def g20(spark, d):
    """A contact at each company: connected, open to messages, or neither; a positive balance stands for credits."""
    k = F.col("company_id")
    ways = O.allowed(k % 4 == 0, k % 5 == 0, F.col("balance"))
    return companies(spark, d).select("company_id", O.route(k % 4 == 0, k % 5 == 0).alias("route"), F.array_join(ways, ",").alias("allowed"))


@add("g21_outreach_states", "SELECT user_id, event_type, prev, prev IS NULL OR (prev, event_type) IN (('view','click'),('click','signup'),('signup','purchase')) AS allowed FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)")
def g21(spark, d):
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    df = table(spark, d, "events").select("user_id", "event_type", prev.alias("prev"))
    step = F.concat("prev", F.lit(">"), "event_type").isin("view>click", "click>signup", "signup>purchase")
    return df.withColumn("allowed", F.col("prev").isNull() | step)


@add(
    "g22_cap_check",
    "SELECT user_id, CASE WHEN day > 2 THEN 'daily' WHEN week > 8 THEN 'weekly' WHEN gap < 3600 THEN 'spacing' END AS refusal FROM (SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS day, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS week, date_diff('second', max(ts), TIMESTAMP '2024-01-31') AS gap FROM events WHERE event_type = 'click' GROUP BY 1)",
)
def g22(spark, d):
    """The first refusal: daily cap, weekly cap, then spacing."""
    since = lambda t: F.count_if(F.col("ts") >= F.lit(t).cast("timestamp_ntz"))
    gap = F.unix_seconds(F.lit("2024-01-31").cast("timestamp")) - F.unix_seconds(F.max("ts").cast("timestamp"))
    refusal = F.when(since("2024-01-30") > 2, "daily").when(since("2024-01-24") > 8, "weekly").when(gap < 3600, "spacing")
    return table(spark, d, "events").where("event_type = 'click'").groupBy("user_id").agg(refusal.alias("refusal"))


@add(
    "g23_message",
    "+ m AS (SELECT company_id, company_id % 2 = 0 AS short, CASE WHEN company_id % 3 = 0 THEN 'there' ELSE 'Ann' || company_id END AS who, CASE WHEN company_id % 5 = 0 THEN repeat('long ', 60) ELSE segment END AS title, CASE WHEN company_id % 7 = 0 THEN 'your team' ELSE name END AS place FROM companies),"
    " t AS (SELECT company_id, short, CASE WHEN short THEN 'Hello ' || who || ', your opening for ' || title || ' at ' || place || ' is close to what I do. May I connect?' ELSE 'Hello ' || who || ',' || chr(10) || chr(10) || 'I read about the ' || title || ' position at ' || place || ' and have applied for it. I would be glad to tell you more about my work.' || chr(10) || chr(10) || 'Kind regards' END AS message FROM m) SELECT company_id, message, length(message) > CASE WHEN short THEN 300 ELSE 1900 END AS over FROM t",
)
def g23(spark, d):
    """A note for every second company, a longer message for the others; some lack a name, some titles are too long for a note."""
    k = F.col("company_id")
    way = F.when(k % 2 == 0, O.INVITE_NOTE).otherwise(O.DM)
    name = F.when(k % 3 != 0, F.concat(F.lit("Ann"), k, F.lit(" Lee")))
    title = F.when(k % 5 == 0, F.repeat(F.lit("long "), 60)).otherwise(F.col("segment"))
    df = companies(spark, d).withColumn("way", way)
    df = df.withColumn("message", O.message(F.col("way"), name, title, F.when(k % 7 != 0, F.col("name"))))
    return df.select("company_id", "message", O.over_limit(F.col("message"), F.col("way")).alias("over"))


@add("g24_search_cache", "SELECT user_id, arg_max(event_id, ts) AS event_id FROM events WHERE ts > TIMESTAMP '2024-01-30' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1")
def g24(spark, d):
    at = F.lit("2024-01-30").cast("timestamp_ntz")
    recent = table(spark, d, "events").where((F.col("ts") > at - F.expr("interval 24 hours")) & (F.col("ts") <= at))
    return recent.groupBy("user_id").agg(F.max_by("event_id", "ts").alias("event_id"))


@add("g25_vocabulary", "SELECT 'title' AS kind, title AS word, count(*) AS n FROM titles GROUP BY 2 UNION ALL SELECT 'place', country, count(*) FROM companies GROUP BY 2")
def g25(spark, d):
    words = titles(spark, d).select(F.lit("title").alias("kind"), F.col("title").alias("word")).unionByName(companies(spark, d).select(F.lit("place").alias("kind"), F.col("country").alias("word")))
    return words.groupBy("kind", "word").agg(F.count("*").alias("n"))


@add("g26_title_groups", "SELECT lower(title) AS key, arg_max(CASE WHEN id % 2 = 0 THEN upper(title) ELSE title END, id) AS spelling FROM titles GROUP BY 1")
def g26(spark, d):
    return titles(spark, d).groupBy(F.lower("title").alias("key")).agg(F.max_by(F.when(F.col("id") % 2 == 0, F.upper("title")).otherwise(F.col("title")), "id").alias("spelling"))


@add("g27_rename_plan", "SELECT page_id, target, count(*) OVER (PARTITION BY target) > 1 AS refused FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS target FROM pages)")
def g27(spark, d):
    df = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("target"))
    taken = df.groupBy("target").agg((F.count("*") > 1).alias("refused"))
    return df.join(taken, "target")


@add("g28_contacts", "SELECT min(page_id) AS page_id, url FROM (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS url FROM pages WHERE page_id % 5 <> 0) GROUP BY 2 UNION ALL SELECT page_id, NULL FROM pages WHERE page_id % 5 = 0")
def g28(spark, d):
    """One contact for each address; contacts without one are never merged."""
    df = table(spark, d, "pages").select("page_id", F.when(F.col("page_id") % 5 != 0, F.regexp_extract("url", "://([^/]+)", 1)).alias("url"))
    return df.where("url is not null").groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id", "url").unionByName(df.where("url is null"))


@add("g29_enrichment", "SELECT company_id, coalesce(nullif(CASE WHEN company_id % 3 = 0 THEN '' ELSE upper(segment) || '!' END, ''), segment) AS segment FROM companies")
def g29(spark, d):
    fresh = F.when(F.col("company_id") % 3 == 0, "").otherwise(F.concat(F.upper("segment"), F.lit("!")))
    return companies(spark, d).select("company_id", F.coalesce(F.nullif(fresh, F.lit("")), F.col("segment")).alias("segment"))


# the quality gate

GATE_SQL = """g AS (SELECT doc_id, body, length(body) AS n, len(list_filter(regexp_split_to_array(body, '[.!?\\n]+'), lambda s: length(regexp_replace(s, '^\\s+|\\s+$', '', 'g')) > 20)) AS sentences,
    list_sum(list_transform(list_filter(string_split(body, chr(10)), lambda p: regexp_matches(p, '(?i)licen[cs]e')), lambda p: length(p))) AS spent,
    regexp_matches(regexp_replace(substr(body, greatest(length(body) - 59, 1)), '^\\s+|\\s+$', '', 'g'), '(\\.\\.\\.|…)$') AS cut FROM (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents))"""


@add(
    "t26_quality_gate",
    f"+ {GATE_SQL} SELECT doc_id, CAST(n AS BIGINT) AS chars, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, 1::DOUBLE - (CASE WHEN n < 400 THEN 0.45::DOUBLE ELSE 0 END + CASE WHEN sentences < 5 AND NOT contains(lower(body), 'licensed') THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN coalesce(spent, 0) / greatest(n, 1) > 0.6 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN cut THEN 0.25::DOUBLE ELSE 0 END)) END, 3) AS score FROM g",
)
def t26(spark, d):
    got = assess(F.col("text"), sections=("licensed",), boilerplate="licen[cs]e", paragraph="\n")
    return table(spark, d, "documents").select("doc_id", got.alias("q")).select("doc_id", F.col("q.chars").cast("bigint").alias("chars"), "q.score")


@add("t28_page_fill", "SELECT page_id, CASE WHEN length(body) >= 400 THEN md5(body) END AS filled FROM (SELECT page_id, " + html_sql("html") + " AS body FROM pages)")
def t28(spark, d):
    df = table(spark, d, "pages").select("page_id", T.html_to_text(F.col("html")).alias("body"))
    return df.select("page_id", F.when(T.completeness(F.col("body")) == "full", F.md5("body")).alias("filled"))


# preferences compiled to rules

PREFS = P.updated(
    P.Preferences(),
    {"titles": "hot rod, Red Plate", "locations": "Germany, Benelux, US", "experience": "mid+", "experience_max": "staff", "min_salary": "60k", "currency": "eur", "max_age_days": "3000", "work_authorization": "germany", "sponsorship_required": "yes"},
)
COMPILED = P.compiled(PREFS, ("global_remote", "tr_local"))


@add(
    "r16_compiled_rules",
    f"+ {POSTINGS_SQL} SELECT id, array_to_string(list_filter([CASE WHEN days > 3000 THEN 'age' END, CASE WHEN NOT regexp_matches(coalesce(title, ''), '(?i)(^|[^a-z0-9_])(hot rod|red plate)') THEN 'title_unmatched' END, CASE WHEN place <> '' AND place NOT IN ('DE', 'NL', 'BE', 'LU', 'US') AND NOT worldwide THEN 'field_mismatch' END,"
    f" CASE WHEN level IN ('intern', 'junior') THEN 'seniority_low' END, CASE WHEN {TOP_SQL} < 60000 THEN 'salary_below' END], lambda x: x IS NOT NULL), ',') AS codes FROM postings",
)
def r16(spark, d):
    """Postings judged by rules that were compiled from what a reader typed."""
    c, rules = F.col, P.rules_for(COMPILED, "global_remote", rates=RULES.rates)
    found = [*R.age(c("days"), rules), *R.title_unmatched(c("title"), rules), *R.field_mismatch({"country": c("place")}, rules, c("location")), *R.seniority(c("level"), rules), *R.salary(c("salary_max"), c("salary_period"), c("salary_currency"), rules)]
    return R.judged(postings(spark, d), found).select("id", F.array_join("verdict.codes", ",").alias("codes"))


@add("r15_fingerprint", "SELECT p_partkey, true AS same_with_other_rates, p_size = 30 AS same_with_other_age FROM part")
def r15(spark, d):
    """The mark of the rules changes with an age limit (here: each part's size) and not with exchange rates."""
    ages = sorted(r[0] for r in table(spark, d, "part").select("p_size").distinct().collect())
    own = P.rules_for(COMPILED | {"global": COMPILED["global"] | {"max_age_days": 30}}, "global_remote")
    mark = R.fingerprint(own)
    marks = {a: R.fingerprint(R.Rules(**{**vars(own), "max_age_days": a, "rates": {"USD": float(a)}})) == mark for a in ages}
    free = all(R.fingerprint(R.Rules(**{**vars(own), "rates": {"USD": float(a)}})) == mark for a in ages)
    return table(spark, d, "part").select("p_partkey", F.lit(free).alias("same_with_other_rates"), literal_map(marks)[F.col("p_size")].alias("same_with_other_age"))


TITLE_CASES = ("Backend Intern", "International Tax Lead", "Software Engineering Manager", "Hot-rod Internship", "intern, rod shop", "Shot rod seller")
TYPED = P.Preferences(titles=["Software Engineer", "hot rod"], experience_max="mid")


@add("r17_title_pattern", "SELECT id, regexp_matches(t, '(?i)(^|[^a-z0-9_])(software engineer|hot rod)') AS hit FROM (SELECT id, title || ' / ' || " + quoted(TITLE_CASES) + "[id % 6 + 1] AS t FROM titles)")
def r17(spark, d):
    """Titles as typed, whatever their case; not inside a longer word at the left, open at the right."""
    text = F.concat_ws(" / ", "title", pick(F.col("id"), TITLE_CASES))
    return titles(spark, d).select("id", text.rlike("(?i)" + P.title_pattern(TYPED.titles)).alias("hit"))


@add(
    "r18_level_titles",
    "SELECT id, regexp_matches(t, '(?i)(^|[^a-z0-9_])(software engineer|hot rod)') OR (regexp_matches(t, '(?i)(^|[^a-z0-9_])(intern|interns|internship|internships|working student|werkstudent|trainee|stajyer|junior|graduate|grad|new grad|entry level|entry-level)($|[^a-z0-9_])') AND regexp_matches(t, '(?i)(^|[^a-z0-9_])(software|hot|rod)($|[^a-z0-9_])')) AS hit FROM (SELECT id, "
    + quoted(TITLE_CASES) + "[id % 6 + 1] AS t FROM titles)",
)
def r18(spark, d):
    """Also postings of the lowest levels that name the level and a telling word of the titles."""
    return titles(spark, d).select("id", P.fits_titles(pick(F.col("id"), TITLE_CASES), TYPED).alias("hit"))


WANTED = ("Germany", "benelux", "US", "worldwide")


@add("r19_read_settings", f"SELECT r_regionkey, r_regionkey * 1000.0::DOUBLE AS min_salary, {quoted(WANTED)}[r_regionkey % 4 + 1] AS location, r_regionkey % 2 = 1 AS refused FROM region")
def r19(spark, d):
    """Settings read for each region: an amount such as "$12k", a place by name; a level that there is none of is refused."""
    out = []
    for (k,) in table(spark, d, "region").select("r_regionkey").collect():
        typed = {"min_salary": f"${k}k", "locations": WANTED[k % 4]}
        try:
            P.updated(P.Preferences(), typed | {"experience": "wizard" if k % 2 else "Senior+"})
            refused = False
        except P.PreferenceError:
            refused = True
        prefs = P.updated(P.Preferences(), typed)
        out.append((k, prefs.min_salary, prefs.locations[0], refused))
    return spark.createDataFrame(out, "r_regionkey int, min_salary double, location string, refused boolean")


@add("r20_merged_document", "SELECT n_nationkey, n_name AS hand_written, true AS read_back FROM nation")
def r20(spark, d):
    """Preferences saved into documents that hold other keys: those stay, and what was saved is read back."""
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    out = []
    for k, name in rows:
        prefs = P.updated(PREFS, {"max_age_days": str(k + 1)})
        document = json.loads(P.to_text(P.merged({"profiles": {"yc": {"prompt": name, "seniority_min": "lead"}}, "global": {"note": name}}, prefs)))
        out.append((k, document["profiles"]["yc"]["prompt"] if document["global"]["note"] == name else None, P.from_document(document) == prefs))
    return spark.createDataFrame(out, "n_nationkey int, hand_written string, read_back boolean")


# extraction from pages


def sent_pages(spark, d):
    """The pages with structured data put before them: whole, broken (a comma too many), nested, of another type, or none."""
    k = F.col("page_id")
    body = F.concat(F.lit("<p>"), F.repeat(F.lit("You will build things with us. "), (k % 30).cast("int")), F.lit("</p>"))
    address = F.struct(F.lit("Germany").alias("addressCountry"), F.lit("Berlin").alias("addressLocality"))
    pay = F.struct(F.lit("EUR").alias("currency"), F.struct((k * 10).alias("minValue"), (k * 20).alias("maxValue"), F.lit("YEAR").alias("unitText")).alias("value"))
    node = F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.concat(F.lit("Job "), k).alias("title"), body.alias("description"), F.struct(F.lit("Acme").alias("name"), F.lit("https://www.acme.dev/x").alias("sameAs")).alias("hiringOrganization"), F.struct(address.alias("address")).alias("jobLocation"), pay.alias("baseSalary"), F.array(F.lit("FULL_TIME")).alias("employmentType")))
    df = table(spark, d, "pages").select("page_id", "html", node.alias("n"))
    data = F.when(k % 5 == 0, F.col("n")).when(k % 5 == 1, F.concat(F.expr("left(n, length(n) - 1)"), F.lit(", }"))).when(k % 5 == 2, F.concat(F.lit('{"@graph": [{"@type": "WebSite"}, {"mainEntity": '), "n", F.lit("}]}"))).when(k % 5 == 3, F.replace("n", F.lit("JobPosting"), F.lit("Recipe")))
    script = F.when(data.isNotNull(), F.concat(F.lit('<script type="application/ld+json">'), data, F.lit("</script>"))).otherwise("")
    return df.select("page_id", F.concat(script, "html").alias("html"))


@add("t23_structured_data", "SELECT page_id, CASE WHEN page_id % 5 < 3 THEN 'Job ' || page_id END AS title FROM pages")
def t23(spark, d):
    """The first JobPosting of a page: at the top, after one repair, or nested; other types are none."""
    return sent_pages(spark, d).select("page_id", F.get_json_object(job_posting(F.col("html")), "$.title").alias("title"))


@add(
    "t23_page_links",
    r"""SELECT page_id, len(regexp_extract_all(html, '<a\s')) AS links, len(regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a\s')) AS in_nav, len(regexp_extract_all(regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1), '<a\s')) AS in_footer,
    len(regexp_extract_all(html, '<a\s')) - len(regexp_extract_all(html, '<a\s[^>]*href="[^"]')) AS bad, false AS lost FROM pages""",
)
def t23_page_links(spark, d):
    """The links of each page by a table function: how many, how many in its navigation and footer, how many without an address, and whether the page could not be read."""
    rows = told_rows(table(spark, d, "pages").select("page_id", "html"), "html", page_links)
    place = lambda p: F.count_if(F.col("place") == p)
    return rows.groupBy("page_id").agg(F.count("n").alias("links"), place("nav").alias("in_nav"), place("footer").alias("in_footer"), F.count_if(F.col("n").isNotNull() & F.col("error").isNotNull()).alias("bad"), F.bool_or(F.col("n").isNull() & F.col("error").isNotNull()).alias("lost"))


@add("t24_posting_fields", "SELECT page_id, 'Acme' AS company, 'acme.dev' AS company_domain, 'DE' AS country, 'Berlin' AS city, 'FULL_TIME' AS employment_type, (page_id * 10) || '-' || (page_id * 20) || ' EUR YEAR' AS salary_text FROM pages WHERE page_id % 5 < 3")
def t24(spark, d):
    df = X.with_posting(sent_pages(spark, d)).where("posting is not null")
    return df.select("page_id", *(f"posting.{c}" for c in ("company", "company_domain", "country", "city", "employment_type", "salary_text")))


MAIN_SQL = html_sql("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")


@add("t25_main_block", f"SELECT page_id, md5({MAIN_SQL}) AS hash FROM pages")
def t25(spark, d):
    """The article of a page, its navigation and footer left out."""
    return sent_pages(spark, d).select("page_id", F.md5(T.html_to_text(main_block(F.col("html")))).alias("hash"))


@add(
    "t27_extraction_ladder",
    f"+ l AS (SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 1 ELSE 0 END AS api, CASE WHEN page_id % 5 < 3 AND page_id % 30 * 31 - 1 >= 400 THEN 1 ELSE 0 END AS jsonld, CASE WHEN length({MAIN_SQL}) >= 400 THEN 1 ELSE 0 END AS block FROM pages) SELECT page_id, CASE WHEN page_id % 50 = 7 THEN 'manual_paste' WHEN api = 1 THEN 'api' WHEN jsonld = 1 THEN 'jsonld' WHEN block = 1 THEN 'readability' END AS rung FROM l",
)
def t27(spark, d):
    """Every tenth posting has a full text from its listing, the others a stub; every fiftieth or so was pasted by hand."""
    k = F.col("page_id")
    df = sent_pages(spark, d).withColumns({"description_text": F.when(k % 10 == 0, F.repeat(F.lit("You will do good work with all of us here. "), 12)).otherwise("stub"), "pasted": F.when(k % 50 == 7, "Pasted text.")})
    return X.filled(df).select("page_id", "rung")
