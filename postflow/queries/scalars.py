"""Scalar functions of the posting pipeline, applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from postflow.functions import places, text, values
from postflow.operators.storage import saved_in_small_batches
from postflow.queries.registry import Family
from postflow.queries.relational import TOKENS_SQL
from postflow.sources.bindings import companies, jobs, now, pick, table, titles

family = Family()
QUERIES, ORACLE, add = family.QUERIES, family.ORACLE, family.add

#: What is put after titles and companies' names, or stands for places, ages and pay, by a row's key: the tables' own words match few of
#: the patterns. Fixed values of the bindings.
TITLE_TAILS = ("Senior Backend Engineer (Remote)", "Staff Machine Learning Engineer", "Junior Data Analyst", "Head of Platform", "Product Manager, Hybrid", "Front-end Developer - Remote", "Founding Engineer", "DevOps Intern", "Full-Stack Developer", "Sr. Data Scientist (m/f/d)", "Clerk")
NAME_TAILS = ("Inc.", "Labs Ltd", "GmbH & Co", "Holding Company", "Group", "Söğüt A.S", "株式会社テスト", "Яндекс ООО", "Škoda a.s.", "")
PLACES = ("Berlin, Germany (Hybrid)", "Remote (United States)", "Istanbul", "Austin, TX", "Remote - California", "London / Paris, France", "Anywhere", "Toronto, Canada", "US Remote National", "Saint-Denis", "Worldwide", "")
PAY = ("$120k - 150k", "80,000 EUR", "€70k", "from 500", "£45,500.50 - £60k", "competitive")
KINDS = ("FullTime", "Part-time", "Contractor", "Internship, full time", "seasonal", "other")


def quoted(items: tuple[str, ...]) -> str:
    return "[" + ",".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


TITLED_SQL = f"t AS (SELECT id, level, title || ' ' || {quoted(TITLE_TAILS)}[id % 11 + 1] AS title FROM titles)"


def titled(spark, d):
    return titles(spark, d).select("id", "level", F.concat_ws(" ", "title", pick(F.col("id"), TITLE_TAILS)).alias("title"))


SUFFIX = "|".join(text.LEGAL_SUFFIXES)


@add(
    "n01_company_name",
    f"+ b AS (SELECT company_id, trim(regexp_replace(regexp_replace(strip_accents(lower(name || ' ' || {quoted(NAME_TAILS)}[company_id % {len(NAME_TAILS)} + 1])), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS bare FROM companies) SELECT company_id, CASE WHEN regexp_replace(bare, '(^|\\s)({SUFFIX})(\\s({SUFFIX}))*$', '') = '' THEN bare ELSE regexp_replace(bare, '(^|\\s)({SUFFIX})(\\s({SUFFIX}))*$', '') END AS name FROM b",
)
def n01(spark, d):
    return companies(spark, d).select("company_id", text.normalize_company_name(F.concat_ws(" ", "name", pick(F.col("company_id"), NAME_TAILS))).alias("name"))


@add("n02_domain", "SELECT page_id, nullif(regexp_replace(lower(regexp_extract(trim(url), '(?i)^https?://([^/?#:]+)', 1)), '^www\\.', ''), '') AS domain FROM pages")
def n02(spark, d):
    return table(spark, d, "pages").select("page_id", text.domain_from_url(F.col("url")).alias("domain"))


def case_sql(col: str, labels: tuple[tuple[str, str], ...], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i){p}') THEN '{k}'" for k, p in labels) + f" ELSE {default} END"


@add("n03_seniority", f"+ {TITLED_SQL} SELECT id, {case_sql('title', text.SENIORITY)} AS seniority FROM t")
def n03(spark, d):
    return titled(spark, d).select("id", text.detect_seniority(F.col("title")).alias("seniority"))


@add("n04_role_family", f"+ {TITLED_SQL} SELECT id, {case_sql('title', text.ROLE_FAMILIES, chr(39) + 'other' + chr(39))} AS family FROM t")
def n04(spark, d):
    return titled(spark, d).select("id", text.detect_role_family(F.col("title")).alias("family"))


@add(
    "n05_title",
    f"+ {TITLED_SQL} SELECT id, trim(regexp_replace(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(title, '(?i){text.TITLE_NOTE}', ' ', 'g'), '(?i){text.TITLE_TAIL}', '', 'g'), '(?i){text.TITLE_LEVEL}', ' ', 'g')), '[^\\pL\\pN_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title FROM t",
)
def n05(spark, d):
    return titled(spark, d).select("id", text.normalize_title(F.col("title")).alias("title"))


@add(
    "n06_shingles",
    f"+ w AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents) SELECT doc_id, len(w) AS n_tokens, greatest(len(w) - 1, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) AS n_shingles, CASE WHEN len(w) > 1 THEN w[1] || ' ' || w[2] ELSE w[1] END AS first_shingle FROM w",
)
def n06(spark, d):
    df = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("w")).withColumn("s", text.shingles(F.col("w")))
    return df.select("doc_id", F.size("w").cast("bigint").alias("n_tokens"), F.size("s").cast("bigint").alias("n_shingles"), F.try_element_at("s", F.lit(1)).alias("first_shingle"))


BITS = ", ".join(f"sum(({h} >> {i}) & 1) * 2 > count(*) AS {h}{i}" for h in ("hi", "lo") for i in range(32))
WORD = lambda h: " + ".join(f"CASE WHEN {h}{i} THEN {1 << i} ELSE 0 END" for i in range(32))
SIMHASH_SQL = f"""w AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents), s AS (SELECT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] ELSE [] END) AS x FROM w),
    g AS (SELECT doc_id, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(x), 9, 8) AS BIGINT) AS lo FROM s), v AS (SELECT doc_id, {BITS} FROM g GROUP BY 1),
    simhash AS MATERIALIZED (SELECT doc_id, CAST({WORD('hi')} AS BIGINT) AS hi, CAST({WORD('lo')} AS BIGINT) AS lo FROM v)"""


def hashes(spark, d):
    df = table(spark, d, "documents").select("doc_id", text.simhash_md5(F.col("text")).alias("h"))
    return saved_in_small_batches(df.where("h is not null").select("doc_id", "h.hi", "h.lo"))


@add("n07_simhash", f"+ {SIMHASH_SQL} SELECT * FROM simhash")
def n07(spark, d):
    return hashes(spark, d)


@add("n07_simhash_blake2b")
def n07b(spark, d):
    return saved_in_small_batches(table(spark, d, "documents").select("doc_id", text.simhash_blake2b(F.col("text")).alias("simhash")))


@add("n08_hamming", f"+ {SIMHASH_SQL} SELECT a.doc_id, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM simhash a JOIN simhash b ON b.doc_id = a.doc_id + 1")
def n08(spark, d):
    a = hashes(spark, d)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"))
    return a.join(b, "doc_id").select("doc_id", text.hamming(F.col("hi"), F.col("lo"), F.col("hi_b"), F.col("lo_b")).cast("bigint").alias("distance"))


@add("n09_content_hash", "SELECT doc_id, sha256(lower(source) || chr(0) || lower(lang) || chr(0) || trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))) AS hash FROM documents")
def n09(spark, d):
    return table(spark, d, "documents").select("doc_id", text.content_hash(F.col("source"), F.col("lang"), F.col("text")).alias("hash"))


@add("n10_completeness", "SELECT doc_id, CASE WHEN length(text) = 0 THEN 'none' WHEN length(text) >= 400 THEN 'full' ELSE 'snippet' END AS completeness FROM documents")
def n10(spark, d):
    return table(spark, d, "documents").select("doc_id", text.completeness(F.col("text")).alias("completeness"))


def html_sql(col: str) -> str:
    x = col
    for tag in text.DROPPED_TAGS:
        x = f"regexp_replace({x}, '<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    x = f"regexp_replace({x}, '<br\\s*/?>', chr(10), 'gi')"
    x = f"regexp_replace({x}, '</(?:{'|'.join(text.BLOCK_TAGS)})>|<hr\\s*/?>', chr(10) || chr(10), 'gi')"
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for entity, char in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {char})"
    x = f"regexp_replace({x}, '[ \\t\\r\\f]+', ' ', 'g')"
    x = f"regexp_replace({x}, ' ?\\n ?', chr(10), 'g')"
    return f"regexp_replace(regexp_replace({x}, '\\n{{2,}}', chr(10) || chr(10), 'g'), '^[\\s]+|[\\s]+$', '', 'g')"


@add("n11_html_text", f"SELECT page_id, {html_sql('html')} AS body FROM pages")
def n11(spark, d):
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@add("n12_html_markdown")
def n12(spark, d):
    return saved_in_small_batches(table(spark, d, "pages").select("page_id", text.html_to_markdown(F.col("html")).alias("markdown")))


@add("n13_unescape", "SELECT page_id, md5(html) AS hash FROM pages")
def n13(spark, d):
    """Every third page arrives escaped (ampersands first, as a feed sends it) and is unescaped once; a page with tags of its own is left alone."""
    escaped = F.col("html")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    sent = F.when((F.col("page_id") % 3 == 0) & F.col("html").contains("<"), escaped).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.md5(text.unescape_if_escaped(sent)).alias("hash"))


@add("n14_employment", f"SELECT id, {case_sql(quoted(KINDS) + '[id % 6 + 1]', text.EMPLOYMENT)} AS employment FROM jobs")
def n14(spark, d):
    return jobs(spark, d).select("id", text.employment_type(pick(F.col("id"), KINDS)).alias("employment"))


@add("n15_turkish_fold", "SELECT doc_id, md5(lower(trim(translate(text, 'ıİşŞğĞüÜöÖçÇ', 'iIsSgGuUoOcC')))) AS folded FROM documents")
def n15(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.turkish_fold(F.col("text"))).alias("folded"))


@add(
    "n16_profile_url",
    "+ r AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(url), '(?i)^(https?:)?//(www\\.)?', ''), '[?#].*$', ''), '/+$', '') AS rest FROM pages) SELECT page_id, 'https://' || lower(split_part(rest, '/', 1)) || regexp_extract(rest, '^[^/]*(.*)$', 1) AS url FROM r",
)
def n16(spark, d):
    return table(spark, d, "pages").select("page_id", text.profile_url(F.col("url")).alias("url"))


@add("n17_safe_key", "SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS key FROM pages")
def n17(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_key(F.col("url")).alias("key"))


@add(
    "n18_salary_range",
    f"+ p AS (SELECT id, {quoted(PAY)}[id % 6 + 1] AS pay FROM jobs), f AS (SELECT id, pay, list_filter(list_transform(regexp_extract_all(replace(pay, ',', ''), '(\\d+(?:\\.\\d+)?)\\s*([kK]?)'), lambda x: CAST(regexp_extract(x, '[\\d.]+') AS DOUBLE) * CASE WHEN x LIKE '%k' THEN 1000 ELSE 1 END), lambda x: x >= 1000) AS v FROM p) SELECT id, list_min(v) AS low, list_max(v) AS high, CASE WHEN len(v) = 0 THEN NULL WHEN contains(pay, '$') THEN 'USD' WHEN contains(pay, '€') THEN 'EUR' WHEN contains(pay, '£') THEN 'GBP' END AS currency FROM f",
)
def n18(spark, d):
    return jobs(spark, d).select("id", text.salary_range(pick(F.col("id"), PAY)).alias("r")).select("id", "r.*")


MODES = {"urgent": "remote", "high": "hybrid", "medium": "onsite", "low": "onsite"}


@add("n19_value_map", "SELECT id, CASE regexp_replace(lower(source), '[^a-z]', '', 'g') WHEN 'urgent' THEN 'remote' WHEN 'high' THEN 'hybrid' WHEN 'medium' THEN 'onsite' WHEN 'low' THEN 'onsite' END AS mode FROM jobs")
def n19(spark, d):
    return jobs(spark, d).select("id", text.mapped(F.col("source"), MODES).alias("mode"))


@add("n20_title_split", "SELECT id, trim(split_part(x, ':', 1)) AS company, trim(substr(x, instr(x, ':') + 1)) AS title FROM (SELECT id, level || ': ' || title AS x FROM titles)")
def n20(spark, d):
    return titles(spark, d).select("id", text.split_title(F.concat("level", F.lit(": "), "title")).alias("s")).select("id", "s.*")


@add("n21_latex_prose")
def n21(spark, d):
    source = F.concat(F.lit("\\documentclass{a}\\begin{document}\\section{"), "lang", F.lit("} % note\n\\textbf{"), F.substring("text", 1, 20), F.lit("} me@example.org "), "text", F.lit("\\end{document}"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.latex_to_prose(source)).alias("prose"))


@add("n22_compare_words", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-zà-ɏ]+'), lambda w: length(w) > 1)) AS n FROM documents")
def n22(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(text.compare_words(F.col("text"))).cast("bigint").alias("n"))


NUMBERS = ("80,000", "80k", "$95K", "€1.5k", "none", "12")


@add(
    "n23_number",
    f"+ b AS (SELECT id, lower(regexp_replace({quoted(NUMBERS)}[id % 6 + 1], '[,$€£\\s]', '', 'g')) AS x FROM jobs) SELECT id, CASE WHEN x LIKE '%k' THEN TRY_CAST(regexp_replace(x, 'k$', '') AS DOUBLE) * 1000 ELSE TRY_CAST(x AS DOUBLE) END AS amount FROM b",
)
def n23(spark, d):
    return jobs(spark, d).select("id", text.parsed_number(pick(F.col("id"), NUMBERS)).alias("amount"))


NOTICES = tuple(p[:1].upper() + p[1:] for p in text.CLOSED) + ("The office is no longer open on Sundays.", "This job has closed its books.", "")


@add("n24_says_closed", f"SELECT page_id, page_id % 13 < 10 OR regexp_matches(lower(regexp_replace(html, '<[^>]*>', ' ', 'g')), '{'|'.join(text.CLOSED)}') AS closed FROM pages")
def n24(spark, d):
    """Each page ends in one of the ten closing phrases, or in a phrase that is none."""
    body = F.concat_ws(" ", text.html_to_text(F.col("html")), pick(F.col("page_id"), NOTICES))
    return table(spark, d, "pages").select("page_id", text.says_closed(body).alias("closed"))


@add("n25_call_to_action", f"SELECT page_id, NOT contains(html, 'apply-button') AND (contains(html, '<footer') OR page_id % 13 < 10) AS closed FROM pages")
def n25(spark, d):
    """Closed: a page without a way to apply that is whole (its footer came) or says so."""
    body = F.concat_ws(" ", text.html_to_text(F.col("html")), pick(F.col("page_id"), NOTICES))
    return table(spark, d, "pages").select("page_id", text.lost_call_to_action(F.col("html"), body, "apply-button", "<footer").alias("closed"))


@add("n26_left_posting", "SELECT page_id, regexp_extract(u, '[?&]error=([^&#]*)', 1) = 'true' OR NOT contains(u, CAST(page_id AS VARCHAR)) AS gone FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url || '?error=true' ELSE url END AS u FROM pages)")
def n26(spark, d):
    url = F.when(F.col("page_id") % 7 == 0, F.concat("url", F.lit("?error=true"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", text.left_posting(url, F.col("page_id").cast("string")).alias("gone"))


LINE_PLACES = ("Berlin, Germany", "We have been hiring people in Turkey since the year in which the first of our offices opened its doors", "", "Remote, India", "germany is a country")
LINES_SQL = f"l AS (SELECT conv_id, turn, {quoted(LINE_PLACES)}[(conv_id + turn) % 5 + 1] || CASE WHEN turn % 4 = 0 THEN '' ELSE chr(10) || text END AS text FROM conversations)"


@add(
    "n27_candidate_place",
    f"""+ {LINES_SQL}, s AS (SELECT conv_id, turn, i, string_split(text, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM l)),
    n AS (SELECT *, regexp_extract(lower(line), '(^|[^a-z])(germany|india|turkey)([^a-z]|$)', 2) AS named FROM s)
    SELECT conv_id, arg_min(CASE WHEN length(line) <= 60 THEN line ELSE named END, turn * 100000 + i) AS place FROM n WHERE named <> '' GROUP BY 1""",
)
def n27(spark, d):
    """The first line of a conversation that names a country; a short line is kept as it is, of a long one the country."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.concat(pick(F.col("conv_id") + F.col("turn"), LINE_PLACES), F.when(F.col("turn") % 4 == 0, "").otherwise(F.concat(F.lit("\n"), "text"))).alias("text"))
    found = lines.select("conv_id", "turn", text.candidate_place(F.col("text"), ("germany", "india", "turkey")).alias("place"))
    return found.where("place is not null").groupBy("conv_id").agg(F.min_by("place", "turn").alias("place"))


# places, times, money


#: What the places mean, in their order.
PLACE_PARTS = {
    "country": ("DE", "US", "TR", "US", "US", "FR", None, "CA", "US", None, None, None),
    "city": ("Berlin", None, "Istanbul", "Austin", "California", "London", None, "Toronto", "US Remote National", "Saint-Denis", "Worldwide", None),
    "remote_type": ("hybrid", "remote", "unknown", "unknown", "remote", "unknown", "remote", "unknown", "remote", "unknown", "unknown", "unknown"),
}


@add("u01_parse_location", "SELECT id, " + ", ".join(f"[{', '.join('NULL' if v is None else repr(v) for v in values_)}][id % 12 + 1] AS {name}" for name, values_ in PLACE_PARTS.items()) + " FROM jobs")
def u01(spark, d):
    return jobs(spark, d).select("id", places.parse_location(pick(F.col("id"), PLACES)).alias("p")).select("id", "p.*")


def map_sql(col: str, values_: dict, cast: str = "") -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {repr(v)}{cast}" for k, v in values_.items()) + " END"


CODES = ("germany", "USA", "tr", "xx", "Atlantis", "u.k", "", "Brazil")


@add("u02_country_code", f"SELECT id, coalesce({map_sql('lower(trim(c))', places.COUNTRIES)}, CASE WHEN length(trim(c)) = 2 THEN upper(trim(c)) END) AS code FROM (SELECT id, {quoted(CODES)}[id % 8 + 1] AS c FROM jobs)")
def u02(spark, d):
    return jobs(spark, d).select("id", places.country_code(pick(F.col("id"), CODES)).alias("code"))


@add("u03_parse_datetime", "SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE posted_at END AS at FROM jobs")
def u03(spark, d):
    """The order date written as seconds, milliseconds or ISO text, or as no date at all, and read back."""
    seconds = F.unix_seconds(F.col("posted_at").cast("timestamp"))
    k = F.col("id") % 4
    told = F.when(k == 0, seconds.cast("string")).when(k == 1, (seconds * 1000).cast("string")).when(k == 2, F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return jobs(spark, d).select("id", values.parse_datetime(told).alias("at"))


AGES = ("3 gün önce", "2 hafta önce", "5 hours ago", "1 month ago", "today")


@add("u04_relative_age", "SELECT id, TIMESTAMP '2001-08-02' - CASE id % 5 WHEN 0 THEN INTERVAL 3 DAY WHEN 1 THEN INTERVAL 14 DAY WHEN 2 THEN INTERVAL 5 HOUR WHEN 3 THEN INTERVAL 30 DAY END AS at FROM jobs")
def u04(spark, d):
    return jobs(spark, d).select("id", values.relative_age(pick(F.col("id"), AGES), now()).alias("at"))


PLACE_CODES = ("GB", "DE", "TR", "IN", "US", "JP", "NZ", "BR", "??")
OVERLAP_SQL = "greatest(0, least(18 - o - 24, 15) - greatest(9 - o - 24, 6), least(18 - o, 15) - greatest(9 - o, 6), least(18 - o + 24, 15) - greatest(9 - o + 24, 6))"


@add("u05_overlap_hours", f"SELECT id, CASE WHEN o IS NOT NULL THEN CAST({OVERLAP_SQL} AS DOUBLE) END AS hours FROM (SELECT id, CAST({map_sql(quoted(PLACE_CODES) + '[id % 9 + 1]', {k: float(v) for k, v in places.OFFSETS.items()})} AS DOUBLE) AS o FROM jobs)")
def u05(spark, d):
    return jobs(spark, d).select("id", places.overlap_hours(places.offset_of(pick(F.col("id"), PLACE_CODES)), F.lit(3.0)).alias("hours"))


@add("u06_worldwide", f"SELECT id, p IN ('Anywhere', 'Worldwide') AS worldwide FROM (SELECT id, {quoted(PLACES)}[id % 12 + 1] AS p FROM jobs)")
def u06(spark, d):
    return jobs(spark, d).select("id", places.is_worldwide(pick(F.col("id"), PLACES)).alias("worldwide"))


ZONES = ("Europe/London", "america/new_york", "Mars/Base", "UTC")


@add("u07_base_offset", f"SELECT id, CAST(coalesce({map_sql('lower(z)', places.ZONES)}, 3) AS DOUBLE) AS hours FROM (SELECT id, {quoted(ZONES)}[id % 4 + 1] AS z FROM jobs)")
def u07(spark, d):
    return jobs(spark, d).select("id", places.base_offset(pick(F.col("id"), ZONES)).alias("hours"))


@add(
    "u08_regions",
    "SELECT id, CASE id % 4 WHEN 0 THEN 'AT,CH,DE' WHEN 1 THEN 'DK,FI,IS,NO,SE' WHEN 2 THEN 'FR,GB' ELSE '' END AS codes, id % 4 = 3 AS worldwide FROM jobs",
)
def u08(spark, d):
    sets = [("dach", "Germany"), ("Nordics", "nowhere"), ("uk", "fr"), ("Anywhere", "")]
    names = F.element_at(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in sets]), (F.col("id") % 4 + 1).cast("int"))
    return jobs(spark, d).select("id", places.resolve_regions(names).alias("r")).select("id", F.array_join("r.codes", ",").alias("codes"), "r.worldwide")


@add("u09_country_name", "SELECT id, CASE id % 4 WHEN 0 THEN 'Germany' WHEN 1 THEN 'United States' WHEN 2 THEN 'Turkey' END AS name FROM jobs")
def u09(spark, d):
    return jobs(spark, d).select("id", places.country_name(pick(F.col("id"), ("de", "US", "tr ", "Q"))).alias("name"))


@add("u10_recent_batch", "SELECT company_id, 2026 - (CAST(batch[2:3] AS INTEGER) + 2000) <= -67 AS recent FROM companies")
def u10(spark, d):
    return companies(spark, d).select("company_id", values.is_recent_batch(F.col("batch"), 2026, -67).alias("recent"))


RATES = {"USD": 1.0, "EUR": 0.9, "TRY": 32.5}


@add("u11_convert", "SELECT id, round(salary_max / CASE salary_currency WHEN 'USD' THEN 1.0::DOUBLE WHEN 'EUR' THEN 0.9::DOUBLE WHEN 'TRY' THEN 32.5::DOUBLE END * 0.9::DOUBLE, 4) AS euros FROM jobs")
def u11(spark, d):
    return jobs(spark, d).select("id", F.round(values.convert(F.col("salary_max"), F.col("salary_currency"), F.lit("EUR"), RATES), 4).alias("euros"))


@add("u12_guess_token", "SELECT page_id, string_split(h, '.')[-2] AS token FROM (SELECT page_id, lower(regexp_extract(url, '://([^/:]+)', 1)) AS h FROM pages)")
def u12(spark, d):
    return table(spark, d, "pages").select("page_id", values.guess_token(F.regexp_extract("url", "://([^/:]+)", 1)).alias("token"))


@add("r21_age_limit", "SELECT id, CAST(ceil((id % 10 + 1) * CASE id % 4 WHEN 0 THEN 1.0::DOUBLE / 24 WHEN 1 THEN 1 WHEN 2 THEN 7 ELSE 30 END) AS BIGINT) AS days FROM jobs")
def r21(spark, d):
    return jobs(spark, d).select("id", values.days_from((F.col("id") % 10 + 1).cast("double"), pick(F.col("id"), ("hours", "days", "weeks", "months"))).alias("days"))
