"""Feeds of boards and aggregators over payloads made of the tables: every source's payload is built, then read by its adapter, and must give the table's own values."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.functions.places import literal_map
from postflow.operators.storage import saved, shared_folder
from postflow.queries.posting import BANK
from postflow.queries.registry import Family
from postflow.queries.relational import scored
from postflow.sources import ledger
from postflow.sources.adapters import ADAPTERS, clean_profile_url, clean_url
from postflow.sources.bindings import boards, companies, jobs, listings, now, pick, table, titles
from postflow.sources.envelopes import crawl_hits, guessed_boards, is_truncated, newest, printed_items, rates_in_use, read_through, scan_envelopes, search_refs, seeded, valid_verdicts, verdict_items, write_envelopes
from postflow.sources.logs import envelopes_at

family = Family()
QUERIES, ORACLE, add = family.QUERIES, family.ORACLE, family.add

#: Places given to postings, what they mean, and kinds of employment as feeds write them. Fixed values of the bindings.
PLACES = ("Berlin, Germany", "Remote - United States", "Istanbul, Turkey (Hybrid)", "Anywhere", None)
COUNTRIES = ("DE", "US", "TR", None, None)
CITIES = ("Berlin", None, "Istanbul", None, None)
MODES = ("unknown", "remote", "hybrid", "remote", "unknown")
KINDS = ("Full-time", "Contract", "Internship")
CURRENCIES = ("USD", "EUR", None)
PAGE = 40  # postings of a payload
RUN, FETCHED = "2001-08-02T0600", "2001-08-02T06:00:00"


def listed(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def feed(spark, d) -> DataFrame:
    """Postings with all that payloads are made of; those without a title are no postings to an adapter."""
    key, title = F.col("id"), F.col("title")
    rest = F.when(key % PAGE == 0, "").otherwise(F.concat(F.lit("<p>"), F.repeat(F.lit("We build things. "), (key % PAGE).cast("int")), F.lit("</p>")))
    role = F.concat(F.lit("<p>Role: "), title, F.lit("</p>"))
    high = F.floor("salary_max").cast("double")
    df = jobs(spark, d).join(titles(spark, d), "id", "left").join(companies(spark, d).select("company_id", "name"), "company_id", "left")
    return df.select(
        key, title, F.col("name").alias("company"), pick(key, PLACES).alias("place"), role.alias("role"), rest.alias("rest"), F.concat(role, rest).alias("body"),
        high.alias("high"), F.floor(high / 2).cast("double").alias("low"), pick(key, CURRENCIES).alias("currency"), pick(key, KINDS).alias("kind"),
        F.date_format("posted_at", "yyyy-MM-dd'T'HH:mm:ss").alias("posted"), F.unix_seconds(F.col("posted_at").cast("timestamp")).alias("epoch"), F.floor(key / PAGE).alias("page"),
        F.concat(F.lit("https://jobs.example.com/"), key).alias("url"),
    )


P_SQL = f"""p AS (SELECT id, title, name AS company, {listed(PLACES)}[id % 5 + 1] AS place, {listed(COUNTRIES)}[id % 5 + 1] AS country, {listed(CITIES)}[id % 5 + 1] AS city, {listed(MODES)}[id % 5 + 1] AS mode,
    floor(salary_max)::DOUBLE AS high, floor(floor(salary_max) / 2)::DOUBLE AS low, {listed(CURRENCIES)}[id % 3 + 1] AS currency, ['full_time', 'contract', 'internship'][id % 3 + 1] AS kind, posted_at, 'board-' || (id // {PAGE}) AS token,
    length('Role: ' || title) + CASE WHEN id % {PAGE} = 0 THEN 0 ELSE 2 + 17 * (id % {PAGE}) - 1 END AS n FROM jobs LEFT JOIN titles USING (id) LEFT JOIN companies USING (company_id))"""
#: What a posting should be, unless a source says otherwise.
WANT = {
    "external_id": "CAST(id AS VARCHAR)", "title": "title", "company_name": "company", "location_raw": "place", "country": "country", "city": "city", "remote_type": "mode", "employment_type": "kind",
    "salary_min": "low", "salary_max": "high", "salary_currency": "currency", "salary_period": "'annual'", "n_text": "n", "jd_completeness": "CASE WHEN n >= 400 THEN 'full' ELSE 'snippet' END",
    "posted_at": "posted_at", "apply_url": "'https://jobs.example.com/' || id", "departments": "'Eng'",
}
NO_PAY = {"salary_min": "NULL::DOUBLE", "salary_max": "NULL::DOUBLE", "salary_currency": "NULL::VARCHAR", "salary_period": "NULL::VARCHAR"}


def enveloped(df: DataFrame, source: str, item: Column, wrap: Callable[[Column], Column]) -> DataFrame:
    """An envelope for every page of postings; items come in the order of their ids."""
    pages = df.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", item.alias("item")))).alias("pairs"))
    items = F.transform("pairs", lambda p: p["item"])
    return pages.select(F.lit(RUN).alias("run_key"), F.lit(source).alias("source"), F.lit(source).alias("provider"), F.concat(F.lit("board-"), "page").alias("token"), F.lit("global").alias("market"), F.lit(FETCHED).alias("fetched_at"), wrap(items).alias("payload"))


def under(name: str) -> Callable[[Column], Column]:
    return lambda items: F.to_json(F.struct(items.alias(name)))


def paged(items: Column) -> Column:
    """Two pages, the second with the first's items again."""
    page = F.struct(F.lit("JOBS").alias("type"), items.alias("jobs"))
    return F.to_json(F.struct(F.array(page, page).alias("pages")))


def source(op: str, name: str, item: Callable[[], Column], wrap: Callable[[Column], Column], where: str = "true", **want: str):
    expressions = ", ".join(f"{sql} AS {column}" for column, sql in (WANT | want).items())

    @add(f"{op}_{name}", f"+ {P_SQL} SELECT {expressions} FROM p WHERE title IS NOT NULL AND {where}")
    def query(spark, d):
        found = ADAPTERS[name](enveloped(feed(spark, d), name, item(), wrap))
        out = found.withColumns({"n_text": F.length("description_text").cast("bigint"), "departments": F.nullif(F.array_join("departments", ","), F.lit(""))})
        return out.select(*WANT)

    return query


def s(**columns: Column | str) -> Column:
    return F.struct(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


key = lambda: F.col("id")
every = lambda n, then, other=None: F.when(key() % n == 0, then).otherwise(other)
lit = F.lit


def escaped() -> Column:
    return F.replace(F.replace("body", lit("<"), lit("&lt;")), lit(">"), lit("&gt;"))


source(
    "s04", "greenhouse",
    lambda: s(id="id", title="title", content=escaped(), absolute_url="url", company_name="company", location=s(name=F.when((key() % 4 == 0) & F.col("place").isNotNull(), "Remote").otherwise(F.col("place"))), metadata=every(4, F.array(s(name=lit("Team"), value=lit("x")), s(name=lit("Job Posting Location"), value="place"))), updated_at="posted", departments=F.array(s(name=lit("Eng")))),
    under("jobs"), employment_type="NULL::VARCHAR", **NO_PAY,
)
source(
    "s05", "ashby",
    lambda: s(id="id", title="title", isListed=key() % 7 != 0, descriptionHtml="body", location="place", workplaceType=pick(key(), ("Remote", None, "OnSite")), employmentType="kind", address=s(postalAddress=F.when(F.col("place").isNull(), s(addressCountry=lit("Germany"), addressLocality=lit("Munich")))),
              compensation=s(compensationTiers=F.array(s(components=F.array(s(compensationType=lit("Salary"), minValue="low", maxValue=lit(None).cast("double"), currencyCode="currency", interval=lit("1 YEAR")), s(compensationType=lit("EquityPercentage"), minValue=lit(0.1), maxValue=lit(9e9), currencyCode=lit(None).cast("string"), interval=lit(None).cast("string")))), s(components=F.array(s(compensationType=lit("Salary"), minValue=lit(None).cast("double"), maxValue="high", currencyCode="currency", interval=lit("1 YEAR")))))),
              publishedAt="posted", jobUrl="url", department=lit("Eng")),
    under("jobs"), "id % 7 <> 0", company_name="token", country="CASE WHEN place IS NULL THEN 'DE' ELSE country END", city="CASE WHEN place IS NULL THEN 'Munich' ELSE city END", remote_type="CASE id % 3 WHEN 0 THEN 'remote' WHEN 2 THEN 'onsite' ELSE mode END",
)
source(
    "s06", "lever",
    lambda: s(id="id", text="title", opening="role", descriptionBody="rest", lists=F.array(s(text=lit("Must"), content=lit("<li>x</li>"))), additional=lit("<p>Bye</p>"), categories=s(location="place", commitment="kind", department=lit("Eng"), team=lit("Core")), country=every(4, "us"), salaryRange=s(min="low", max="high", currency="currency", interval=lit("per-year-salary")), createdAt=F.col("epoch") * 1000, hostedUrl="url"),
    F.to_json, company_name="token", country="CASE WHEN id % 4 = 0 THEN 'US' ELSE country END", n_text="n + 14", jd_completeness="CASE WHEN n + 14 >= 400 THEN 'full' ELSE 'snippet' END", departments="'Eng,Core'",
)
source(
    "s07", "recruitee",
    lambda: s(id="id", title="title", status=every(6, "draft", "published"), description="role", requirements="rest", remote=key() % 4 == 0, hybrid=key() % 4 == 1, on_site=key() % 4 == 2, salary=s(min=F.col("low").cast("string"), max=F.col("high").cast("string"), currency="currency", period=lit("year")), careers_url="url", company_name="company", location="place", city=lit("Utrecht"), country_code=lit("nl"), employment_type_code="kind", published_at="posted", department=lit("Eng")),
    under("offers"), "id % 6 <> 0", location_raw="coalesce(place, 'Utrecht')", country="'NL'", city="'Utrecht'", remote_type="['remote', 'hybrid', 'onsite', 'unknown'][id % 4 + 1]",
)
source(
    "s08", "smartrecruiters",
    lambda: s(id="id", name="title", company=s(identifier=lit("acme"), name="company"), releasedDate="posted", location=s(city=lit("Utrecht"), country=lit("nl"), remote=key() % 2 == 0), department=s(label=lit("Eng")), typeOfEmployment=s(label="kind"), visibility=every(6, "INTERNAL", "PUBLIC"), ref="url"),
    under("content"), "id % 6 <> 0", location_raw="'Utrecht, nl'", country="'NL'", city="'Utrecht'", remote_type="CASE WHEN id % 2 = 0 THEN 'remote' ELSE 'onsite' END", n_text="NULL::BIGINT", jd_completeness="'none'", apply_url="'https://jobs.smartrecruiters.com/acme/' || id", **NO_PAY,
)


def element(tag: str, c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), F.concat(lit(f"<{tag}>"), c, lit(f"</{tag}>"))).otherwise("")


def cdata(c: Column | str) -> Column:
    return F.concat(lit("<![CDATA["), F.col(c) if isinstance(c, str) else c, lit("]]>"))


source(
    "s09", "personio",
    lambda: element("position", F.concat(element("id", key().cast("string")), element("subcompany", "company"), element("office", "place"), element("department", lit("Eng")), element("name", "title"), element("jobDescriptions", element("jobDescription", F.concat(element("name", lit("Role")), element("value", cdata("body"))))), element("employmentType", lit("permanent")), element("schedule", lit("full-time")), element("createdAt", "posted"))),
    lambda items: F.concat(lit("<workzag-jobs>"), F.array_join(items, ""), lit("</workzag-jobs>")), city="coalesce(city, place)", employment_type="'full_time'", n_text="n + 6", jd_completeness="CASE WHEN n + 6 >= 400 THEN 'full' ELSE 'snippet' END", apply_url="'https://' || token || '.jobs.personio.de/job/' || id", **NO_PAY,
)
source(
    "s10", "workable",
    lambda: s(shortcode=F.concat(lit("J"), "id"), title="title", employment_type="kind", telecommuting=key() % 3 == 0, department=lit("Eng"), url="url", published_on="posted", country=lit("Netherlands"), city=lit("Utrecht"), locations=every(2, F.array(s(countryCode=lit(None).cast("string")), s(countryCode=lit("be")))), description="body"),
    lambda items: F.to_json(F.struct(lit("Acme").alias("name"), items.alias("jobs"))), external_id="'J' || id", company_name="'Acme'", location_raw="'Utrecht, Netherlands'", country="CASE WHEN id % 2 = 0 THEN 'BE' ELSE 'NL' END", city="'Utrecht'", remote_type="CASE WHEN id % 3 = 0 THEN 'remote' ELSE 'onsite' END", **NO_PAY,
)
source(
    "s11", "workable_search",
    lambda: s(id="id", title="title", state=every(6, "archived", "published"), description="body", requirementsSection=lit("<p>Req</p>"), company=s(title="company"), location=s(city=lit("Utrecht"), countryName=lit("Netherlands")), locations=F.array(lit("Utrecht, NL"), lit("TELECOMMUTE")), workplace=lit("on_site"), employmentType="kind", created="posted", url="url", department=lit("Eng")),
    paged, "id % 6 <> 0", location_raw="'Utrecht, NL'", country="'NL'", city="'Utrecht'", remote_type="'onsite'", n_text="n + 19", jd_completeness="CASE WHEN n + 19 >= 400 THEN 'full' ELSE 'snippet' END", **NO_PAY,
)
source(
    "s12", "remotive",
    lambda: s(id="id", title="title", description="body", candidate_required_location="place", salary=pick(key(), ("$50k - 90K a year, 3 weeks off", "€70,000", "competitive")), company_name="company", job_type="kind", publication_date="posted", url="url", category=lit("Eng")),
    under("jobs"), remote_type="'remote'", salary_min="[50000.0, 70000.0, NULL][id % 3 + 1]::DOUBLE", salary_max="[90000.0, NULL, NULL][id % 3 + 1]::DOUBLE", salary_currency="['USD', 'EUR', NULL][id % 3 + 1]", salary_period="CASE WHEN id % 3 < 2 THEN 'annual' END",
)
PAID = {"salary_min": "CASE WHEN id % 4 <> 0 THEN low END", "salary_max": "CASE WHEN id % 4 <> 0 THEN high END"}
source(
    "s13", "remoteok",
    lambda: s(id="id", epoch="epoch", company="company", position="title", tags=F.array(*map(lit, "abcd")), description="body", location=F.concat("place", lit(", ")), salary_min=every(4, 0.0, F.col("low")), salary_max=every(4, 0.0, F.col("high")), url="url"),
    lambda items: F.concat(lit('[{"legal": "terms"}, 7, '), F.substring(F.to_json(items), 2, 2**31 - 1)), remote_type="'remote'", employment_type="NULL::VARCHAR", departments="'a,b,c'", salary_currency="CASE WHEN id % 4 <> 0 THEN 'USD' END", salary_period="CASE WHEN id % 4 <> 0 THEN 'annual' END", **PAID,
)
source(
    "s14", "arbeitnow",
    lambda: s(slug="id", company_name="company", title="title", description=escaped(), remote=key() % 2 == 0, url="url", tags=F.array(lit("Eng")), job_types=F.array("kind"), location="place", created_at="epoch"),
    under("data"), remote_type="CASE WHEN id % 2 = 0 THEN 'remote' ELSE mode END", **NO_PAY,
)
source(
    "s15", "jobicy",
    lambda: s(id="id", jobTitle="title", jobDescription="body", jobGeo="place", salaryMin=every(4, "0", F.col("low").cast("string")), salaryMax=every(4, "", F.col("high").cast("string")), salaryCurrency=lit("USD"), salaryPeriod=lit("yearly"), companyName="company", jobType=F.array("kind"), jobIndustry=F.array(lit("Eng")), pubDate="posted", url="url"),
    under("jobs"), remote_type="'remote'", salary_currency="'USD'", **PAID,
)
SEAT = "<p><strong>Headquarters:</strong> Ankara, Turkey; Berlin</p>"
source(
    "s16", "wwr",
    lambda: element("item", F.concat(element("title", every(5, F.col("title"), F.concat("company", lit(": "), "title"))), element("region", "place"), element("type", "kind"), element("category", lit("Eng")), element("description", cdata(F.concat(every(4, SEAT, ""), F.col("body")))), element("pubDate", F.date_format(F.timestamp_seconds("epoch"), "EEE, dd MMM yyyy HH:mm:ss Z")), element("link", "url"))),
    lambda items: F.concat(lit("<rss><channel>"), F.array_join(items, ""), lit("</channel></rss>")), external_id="'https://jobs.example.com/' || id", company_name="CASE WHEN id % 5 = 0 THEN 'unknown' ELSE company END", location_raw="CASE WHEN id % 4 = 0 THEN 'Ankara, Turkey' ELSE place END", country="CASE WHEN id % 4 = 0 THEN 'TR' ELSE country END",
    city="CASE WHEN id % 4 = 0 THEN 'Ankara' ELSE city END", remote_type="CASE WHEN id % 4 <> 0 AND mode = 'hybrid' THEN 'hybrid' ELSE 'remote' END", n_text="n + CASE WHEN id % 4 = 0 THEN 38 ELSE 0 END", jd_completeness="CASE WHEN n + CASE WHEN id % 4 = 0 THEN 38 ELSE 0 END >= 400 THEN 'full' ELSE 'snippet' END", **NO_PAY,
)
source(
    "s17", "techcareer",
    lambda: s(jobId="id", title="title", slug=F.concat(lit("s"), "id"), isDisabledJob=key() % 9 == 0, jobStatus=every(6, "Draft", "Published"), description="body", jobDepartmentName=lit("Eng"), workPlaces=every(2, F.array(s(workPlaceName=lit("İş Yerinde")), s(workPlaceName=lit("Hibrit"))), F.array(s(workPlaceName=lit("Uzaktan")))), location=s(locationName=lit("Ankara / Turkey")), otherLocations=F.array(s(locationName=lit("Izmir"))), company=every(5, None, s(companyProfileName="company"))),
    paged, "id % 9 <> 0 AND id % 6 <> 0", company_name="CASE WHEN id % 5 = 0 THEN 'Gizli Firma' ELSE company END", location_raw="'Ankara / Turkey; Izmir'", country="'TR'", city="'Ankara'", remote_type="CASE WHEN id % 2 = 0 THEN 'hybrid' ELSE 'remote' END", employment_type="NULL::VARCHAR", posted_at="NULL::TIMESTAMP", apply_url="'https://www.techcareer.net/jobs/detail/s' || id", **NO_PAY,
)
source(
    "s18", "careerjet",
    lambda: s(title=F.concat_ws(" ", F.when(F.col("title").isNotNull(), F.concat(F.col("title"), lit(" "), key()))), company="company", locations=lit("Yenimahalle, Ankara"), description="body", salary_min=every(4, "0", F.col("low").cast("string")), salary_max=every(4, None, F.col("high").cast("string")), salary_currency_code=lit("TRY"), salary_type=lit("Y"), date="posted", url="url"),
    paged, external_id="substr(sha1(lower(title || ' ' || id || '|' || company || '|yenimahalle, ankara')), 1, 20)", title="title || ' ' || id", location_raw="'Yenimahalle, Ankara'", country="'TR'", city="'Ankara'", remote_type="'unknown'", employment_type="NULL::VARCHAR", jd_completeness="'snippet'", departments="NULL::VARCHAR",
    salary_currency="CASE WHEN id % 4 <> 0 THEN 'TRY' END", salary_period="CASE WHEN id % 4 <> 0 THEN 'annual' END", **PAID,
)


def tagged(tag: str, attrs: str, inside: Column | str) -> Column:
    return F.concat(lit(f"<{tag} {attrs}>"), F.coalesce(F.col(inside) if isinstance(inside, str) else inside, lit("")), lit(f"</{tag}>"))


def carded(field: str, detail: Column) -> Callable[[Column], Column]:
    """A payload of one result page, and the detail pages of postings with an even id."""
    even = lambda items: F.filter(items, lambda i: i["id"] % 2 == 0)
    details = lambda items: F.map_from_arrays(F.transform(even(items), lambda i: i["id"].cast("string")), F.transform(even(items), lambda i: i["detail"]))
    return lambda items: F.to_json(F.struct(F.array(F.concat(lit("<html><body>"), F.array_join(F.transform(items, lambda i: i["card"]), "\n"), lit("</body></html>"))).alias(field), details(items).alias("details")))


source(
    "s19", "kariyer_net",
    lambda: s(id="id", card=tagged("div", 'data-test="ad-card"', F.concat(F.concat(lit('<a data-test="ad-card-item" href="/is-ilani/x-'), key(), lit('?a=1">')), tagged("span", 'data-test="ad-card-title"', "title"), lit("</a>"), tagged("span", 'data-test="subtitle"', "company"), tagged("span", 'data-test="location"', lit("İstanbul(Avr.) +2 il daha")), tagged("span", 'data-test="work-model"', lit("Uzaktan / Remote")), tagged("span", 'data-test="mapped-badges"', lit("Tam zamanlı")), tagged("span", 'data-test="ad-date"', F.concat((key() % 5).cast("string"), lit(" gün önce"))))),
              detail=F.concat(lit("<html>"), tagged("div", 'data-test="qualifications-and-job-description"', "body"), lit("</html>"))),
    carded("pages", None), location_raw="'İstanbul(Avr.) +2 il daha'", country="'TR'", city="'İstanbul'", remote_type="'remote'", employment_type="'full_time'", n_text="CASE WHEN id % 2 = 0 THEN n END", jd_completeness="CASE WHEN id % 2 = 1 THEN 'none' WHEN n >= 400 THEN 'full' ELSE 'snippet' END",
    posted_at="TIMESTAMP '2001-08-02 06:00:00' - to_days(CAST(id % 5 AS INTEGER))", apply_url="'https://www.kariyer.net/is-ilani/x-' || id", departments="NULL::VARCHAR", **NO_PAY,
)
source(
    "s20", "linkedin",
    lambda: s(id="id", card=F.concat(lit('<div class="base-card job" data-entity-urn="urn:li:jobPosting:'), key(), lit('">'), F.concat(lit('<a class="base-card__full-link" href="https://de.linkedin.com/jobs/view/'), key(), lit('/?ref=1"></a>')), tagged("h3", 'class="base-search-card__title"', "title"), tagged("h4", 'class="base-search-card__subtitle"', tagged("a", 'href="#"', "company")), tagged("span", 'class="job-search-card__location"', "place"), F.concat(lit('<time class="job-search-card__listdate" datetime="'), "posted", lit('"></time></div>'))),
              detail=F.concat(lit('<div class="description__text">'), "body", lit('<button class="show-more-less-html__button">Show more</button></div><div class="message-the-recruiter"><a href="/in/ann-lee?x">Ann Lee</a></div>'))),
    carded("cards", None), remote_type="'unknown'", employment_type="NULL::VARCHAR", n_text="CASE WHEN id % 2 = 0 THEN n END", jd_completeness="CASE WHEN id % 2 = 0 THEN 'full' ELSE 'none' END", apply_url="'https://de.linkedin.com/jobs/view/' || id", departments="NULL::VARCHAR", **NO_PAY,
)


def all_envelopes(spark, d) -> DataFrame:
    """Envelopes of two sources; every seventh board's listing came cut short, told by the envelope or, on older ones of one source, inside the payload."""
    df = feed(spark, d)
    plain = enveloped(df, "remotive", s(id="id", title="title"), under("jobs")).withColumn("truncated", F.substring_index("token", "-", -1).cast("bigint") % 7 == 0)
    old = F.concat(lit('{"truncated": '), (F.substring_index("token", "-", -1).cast("bigint") % 7 == 0).cast("string"), lit(', "cards": []}'))
    legacy = plain.withColumns({"source": lit("linkedin"), "payload": old, "truncated": lit(None).cast("boolean")})
    return plain.unionByName(legacy).withColumns({"board_id": lit(None).cast("bigint"), "refused": lit(False)})


TOKENS_SQL = f"t AS (SELECT DISTINCT 'board-' || (id // {PAGE}) AS token, id // {PAGE} AS page FROM jobs)"


@add("s01_envelope_write", f"+ {TOKENS_SQL} SELECT token, source, page % 7 = 0 AND source = 'remotive' AS truncated FROM t, (SELECT unnest(['remotive', 'linkedin']) AS source)")
def s01(spark, d):
    """Envelopes written as JSON, a folder for each source and run, and read back."""
    folder = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    write_envelopes(all_envelopes(spark, d), folder)
    back = [scan_envelopes(spark, folder, x, RUN) for x in ("remotive", "linkedin")]
    return back[0].unionByName(back[1]).select("token", "source", F.coalesce("truncated", lit(False)).alias("truncated"))


@add("s02_envelope_replay", f"SELECT 'board-' || (id // {PAGE}) AS token, count(title) AS postings FROM jobs LEFT JOIN titles USING (id) GROUP BY 1 HAVING count(title) > 0")
def s02(spark, d):
    """One run replayed from its envelopes, without fetching: postings of each board."""
    folder = f"{shared_folder(spark)}/raw-{uuid.uuid4().hex}"
    write_envelopes(all_envelopes(spark, d), folder)
    found = ADAPTERS["remotive"](envelopes_at(spark, folder, (F.col("source") == "remotive") & (F.col("run_key") == RUN)))
    return found.groupBy("token").agg(F.count("*").alias("postings"))


@add("s03_truncated", f"+ {TOKENS_SQL} SELECT token, source, page % 7 = 0 AS truncated FROM t, (SELECT unnest(['remotive', 'linkedin']) AS source)")
def s03(spark, d):
    return all_envelopes(spark, d).select("token", "source", is_truncated(F.col("truncated"), F.col("source"), F.col("payload")).alias("truncated"))


HREF_SQL = "CASE page_id % 4 WHEN 0 THEN '/in/p' || page_id || '/?a=1#b' WHEN 1 THEN '//uk.linkedin.com/in/p' || page_id WHEN 2 THEN url || '/#top' ELSE ' ' END"


@add(
    "s21_clean_url",
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://www.linkedin.com/in/p' || page_id WHEN 1 THEN 'https://uk.linkedin.com/in/p' || page_id WHEN 2 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') END AS plain,"
    " CASE WHEN page_id % 4 < 2 THEN 'https://www.linkedin.com/in/p' || page_id WHEN page_id % 4 = 2 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') END AS profile FROM pages",
)
def s21(spark, d):
    k = F.col("page_id")
    href = F.when(k % 4 == 0, F.concat(lit("/in/p"), k, lit("/?a=1#b"))).when(k % 4 == 1, F.concat(lit("//uk.linkedin.com/in/p"), k)).when(k % 4 == 2, F.concat("url", lit("/#top"))).otherwise(" ")
    return table(spark, d, "pages").select("page_id", clean_url(href).alias("plain"), clean_profile_url(href).alias("profile"))


CITIES_WANTED = ("Berlin", "Istanbul", "Worldwide")


@add("s22_search_refs", f"SELECT DISTINCT title || '|' || place AS token FROM titles, (SELECT unnest({listed(CITIES_WANTED)}) AS place)")
def s22(spark, d):
    return search_refs(titles(spark, d).select("title"), CITIES_WANTED)


#: Codes of a search form. Fixed values.
GEO = {"worldwide": "92000000", "european union": "91000000", "europe": "100506914", "germany": "101282230", "netherlands": "102890719", "united kingdom": "101165590", "turkey": "102105699", "türkiye": "102105699", "united states": "103644278"}


@add("s23_search_params", f"SELECT n_nationkey, CASE lower(n_name) {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}geoId={v}{chr(39)}' for k, v in GEO.items())} ELSE 'location=' || n_name END || CASE n_nationkey % 3 WHEN 0 THEN '' ELSE '&f_TPR=r' || (n_nationkey % 3 * 86400) END AS params FROM nation")
def s23(spark, d):
    """Places known to the form are sent by code, others by name; an age limit only if there is one."""
    code = F.try_element_at(literal_map(GEO), F.lower(F.trim("n_name")))
    place = F.when(code.isNotNull(), F.concat(lit("geoId="), code)).otherwise(F.concat(lit("location="), "n_name"))
    days = F.col("n_nationkey") % 3
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws("&", place, F.when(days > 0, F.concat(lit("f_TPR=r"), days * 86400))).alias("params"))


@add("s24_crawl_index", "SELECT 'site' AS provider, token, count(*) AS records FROM (SELECT lower(regexp_extract(url, '(?i)([a-z0-9-]+)\\.example\\.(?:com|net|org)', 1)) AS token FROM pages WHERE page_id % 10 <> 0) WHERE token NOT IN ('', 'www', 'blog') GROUP BY 1, 2")
def s24(spark, d):
    """An index of URLs as JSON lines; every tenth line is broken."""
    line = F.to_json(F.struct("url", lit("200").alias("status")))
    lines = table(spark, d, "pages").select(F.when(F.col("page_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    return crawl_hits(lines, BANK)


BOARD_SQL = "b AS (SELECT *, CASE WHEN board_id % 2 = 0 THEN 'global' ELSE 'local' END AS market, CASE WHEN board_id % 4 < 2 THEN 'list' ELSE 'crawl' END AS via FROM boards)"


def filed(spark, d) -> DataFrame:
    k = F.col("board_id")
    return boards(spark, d).withColumns({"market": F.when(k % 2 == 0, "global").otherwise("local"), "via": F.when(k % 4 < 2, "list").otherwise("crawl")})


@add(
    "s25_company_list",
    "+ c AS (SELECT 'Supplier#' || name[10:] AS token, min(company_id) AS company_id FROM companies WHERE company_id % 3 <> 0 GROUP BY 1) SELECT token, provider, company_id FROM c, (SELECT unnest(['greenhouse', 'lever']) AS provider) x WHERE (provider, token) NOT IN (SELECT (provider, token) FROM boards)",
)
def s25(spark, d):
    """Companies give a token to try at each provider, but for boards that are known; a company without an address gives none."""
    own = companies(spark, d).select("company_id", F.when(F.col("company_id") % 3 != 0, F.concat(lit("Supplier#"), F.substring("name", 10, 100))).alias("token"))
    return guessed_boards(own, boards(spark, d), ("greenhouse", "lever")).select("token", "provider", "company_id")


@add(
    "s26_seed_lists",
    f"+ {BOARD_SQL}, s AS (SELECT DISTINCT provider, CASE WHEN board_id % 3 = 0 THEN token || '-x' ELSE token END AS token FROM boards WHERE board_id % 5 < 3)"
    " SELECT coalesce(b.provider, s.provider) AS provider, coalesce(b.token, s.token) AS token, CASE WHEN s.token IS NULL THEN market ELSE 'local' END AS market, CASE WHEN s.token IS NULL THEN via ELSE 'list' END AS via,"
    " CASE WHEN s.token IS NULL THEN 'untouched' WHEN b.token IS NULL THEN 'new' WHEN market = 'local' AND via = 'list' THEN 'known' ELSE 'moved' END AS outcome FROM b FULL JOIN s ON b.provider = s.provider AND b.token = s.token",
)
def s26(spark, d):
    """A hand-made list of boards, some of them new, registered over the boards that are there."""
    k = F.col("board_id")
    seeds = boards(spark, d).where(k % 5 < 3).select("provider", F.when(k % 3 == 0, F.concat("token", lit("-x"))).otherwise(F.col("token")).alias("token"))
    return seeded(seeds, filed(spark, d), "local", "list")


@add("s27_page_cache", "SELECT d.doc_id AS job_id, CASE WHEN page_id IS NULL THEN 'miss' ELSE 'cache' END AS origin, length(html) AS chars FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id AND page_id % 2 = 0")
def s27(spark, d):
    cache = table(spark, d, "pages").where("page_id % 2 = 0").select(lit("web").alias("source"), F.col("page_id").alias("job_id"), "html")
    wanted = table(spark, d, "documents").select(lit("web").alias("source"), F.col("doc_id").alias("job_id"))
    return read_through(wanted, cache).select("job_id", "origin", F.length("html").cast("bigint").alias("chars"))


CARDS_SQL = "c AS (SELECT id, title, market, source, llm_score FROM jobs JOIN titles USING (id) JOIN scores ON job_id = id AND profile = market)"


def cards(spark, d) -> DataFrame:
    none = lit(None).cast("string")
    df = scored(spark, d).join(titles(spark, d), "id")
    return df.select(F.col("id").alias("job_id"), F.col("llm_score").alias("score"), "title", none.alias("company"), F.col("market").alias("location"), none.alias("work_model"), none.alias("employment_type"), none.alias("salary"), none.alias("url"), "source")


def kept_rows(spark, d) -> DataFrame:
    """The ledger as the last export left it: postings with an id that 3 does not divide, some applied to since."""
    old = ledger.fresh_rows(cards(spark, d).where("job_id % 3 <> 0").withColumn("title", lit("old")), "2001-07-01")
    number = F.col("job_id").cast("bigint")
    return old.withColumns({"applied": F.when(number % 4 == 0, "TRUE").otherwise("FALSE"), "cv_status": F.when(number % 8 == 0, "sent").otherwise("")})


LEDGER_SQL = "SELECT CAST(id AS VARCHAR) AS job_id, CASE WHEN llm_score IS NULL THEN '' ELSE printf('%.2f', llm_score) END AS fit, CASE WHEN id % 2 = 0 THEN title ELSE 'old' END AS title, market AS location, CASE WHEN id % 3 <> 0 AND id % 4 = 0 THEN 'TRUE' ELSE 'FALSE' END AS applied, CASE WHEN id % 3 <> 0 AND id % 8 = 0 THEN 'sent' ELSE '' END AS cv_status, CASE WHEN id % 3 <> 0 THEN '2001-07-01' ELSE '2001-08-02' END AS first_seen, CASE WHEN id % 2 = 0 THEN '2001-08-02' ELSE '2001-07-01' END AS last_seen FROM c WHERE id % 3 <> 0 OR id % 2 = 0"
SHOWN = ("job_id", "fit", "title", "location", "applied", "cv_status", "first_seen", "last_seen")


@add("s28_ledger_upsert", f"+ {CARDS_SQL} {LEDGER_SQL}")
def s28(spark, d):
    """Half of the cards come again: their rows are refreshed, what the reader noted stays; the ledger is written, replaced and read."""
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    ledger.replace(kept_rows(spark, d), folder)
    fresh = ledger.fresh_rows(cards(spark, d).where("job_id % 2 = 0"), "2001-08-02")
    ledger.replace(ledger.upserted(ledger.read(spark, folder), fresh), folder)
    return ledger.read(spark, folder).select(*SHOWN)


@add("s29_ledger_marks", f"+ {CARDS_SQL}, l AS ({LEDGER_SQL}), k AS (SELECT *, CAST(job_id AS BIGINT) % 3 <> 0 AS there FROM l WHERE CAST(job_id AS BIGINT) % 3 <> 0) SELECT o_orderkey AS job_id, CASE WHEN job_id IS NULL THEN 'missing' ELSE 'TRUE/ready' END AS state FROM orders LEFT JOIN k ON CAST(o_orderkey AS VARCHAR) = job_id WHERE o_orderkey % 10 = 1 UNION ALL SELECT CAST(job_id AS BIGINT), applied || '/' || cv_status FROM k WHERE CAST(job_id AS BIGINT) % 10 <> 1")
def s29(spark, d):
    """A reader marks postings as applied to; those that the ledger lacks are told."""
    wanted = table(spark, d, "orders").where("o_orderkey % 10 = 1").select(F.col("o_orderkey").cast("string").alias("job_id"))
    rows, missing = ledger.marked(saved(kept_rows(spark, d)), wanted, cv_status="ready")
    told = rows.select(F.col("job_id").cast("bigint").alias("job_id"), F.concat_ws("/", "applied", "cv_status").alias("state"))
    return told.unionByName(missing.select(F.col("job_id").cast("bigint").alias("job_id"), lit("missing").alias("state")))


@add("s30_gate_batches", f"SELECT market, id // 500 AS batch, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM jobs JOIN scores ON job_id = id AND profile = market WHERE passed GROUP BY 1, 2")
def s30(spark, d):
    """Postings for the reader as JSON documents, one for each market and 500 numbers, so that none grows with the table; read again."""
    batch = F.floor(F.col("id") / 500)
    item = F.struct(F.col("id").alias("job_id"), F.col("llm_score").alias("score"))
    sent = scored(spark, d).where("passed").groupBy("market", batch.alias("batch")).agg(F.to_json(F.struct(F.first("market").alias("market"), F.collect_list(item).alias("jobs"))).alias("payload"))
    back = sent.select("batch", F.from_json("payload", "market string, jobs array<struct<job_id bigint, score double>>").alias("p"))
    return back.select("p.market", "batch", F.size("p.jobs").cast("bigint").alias("n"), F.aggregate("p.jobs", lit(0).cast("bigint"), lambda acc, j: acc + j["job_id"]).alias("ids"))


def answers(spark, d, shapes: Callable[[Column, Column], Column]) -> DataFrame:
    """Labels as answers of 20 verdicts each, in a shape that the number of the answer picks; some verdicts name no job or score out of range."""
    k = F.col("doc_id")
    verdict = F.struct(F.when(k % 7 == 0, "none").otherwise(k.cast("string")).alias("job_id"), F.when(k % 5 == 0, 1.5).otherwise(F.col("quality").cast("double")).alias("score"))
    grouped = table(spark, d, "labels").groupBy(F.floor(k / 20).alias("n")).agg(F.collect_list(verdict).alias("vs"))
    return grouped.select("n", shapes(F.col("n"), F.col("vs")).alias("text"))


VALID_SQL = "SELECT doc_id AS job_id, CAST(quality AS DOUBLE) AS score FROM labels WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0"


@add("s31_verdict_shapes", VALID_SQL)
def s31(spark, d):
    """Verdicts as a bare array, under one of four names, or in batches."""
    def shape(n, vs):
        out = F.concat(lit('{"batches": [{"results": '), F.to_json(vs), lit('}, 7, {"jobs": []}]}'))
        for i, name in enumerate(("verdicts", "results", "jobs", "scores")):
            out = F.when(n % 6 == i, F.to_json(F.struct(vs.alias(name)))).otherwise(out)
        return F.when(n % 6 == 5, F.to_json(vs)).otherwise(out)

    return valid_verdicts(verdict_items(answers(spark, d, shape), "text")).select("job_id", "score")


@add("s32_printed_verdicts", VALID_SQL.replace("WHERE", "WHERE doc_id // 20 % 4 <> 3 AND"))
def s32(spark, d):
    """Verdicts as a program prints them: bare, in an envelope, amid prose; every fourth output is broken and gives none."""
    def shape(n, vs):
        bare = F.to_json(vs)
        return F.when(n % 4 == 0, bare).when(n % 4 == 1, F.to_json(F.struct(lit("success").alias("kind"), bare.alias("result")))).when(n % 4 == 2, F.concat(lit("Here you are:\n"), bare, lit("\nAnything else?"))).otherwise(F.concat(lit("Sorry, "), F.substring(bare, 1, 15)))

    return valid_verdicts(printed_items(answers(spark, d, shape), "text")).select("job_id", "score")


@add("s33_run_history", "SELECT CAST(run AS VARCHAR) AS run_id, count(*) AS postings FROM listings GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
def s33(spark, d):
    """A snapshot of each run; the history keeps the newest five."""
    runs = listings(spark, d).groupBy(F.col("run").cast("string").alias("run_id")).agg(F.count("*").alias("n"))
    kept = newest(runs.select("run_id", F.to_json(F.struct(F.col("n").alias("jobs_total"))).alias("payload")))
    return kept.select("run_id", F.get_json_object("payload", "$.jobs_total").cast("bigint").alias("postings"))


@add(
    "s34_rates",
    "+ s AS (SELECT n_nationkey, TIMESTAMP '2001-08-02' - to_hours(CAST(30 + n_nationkey AS INTEGER)) AS fetched, n_nationkey % 4 = 1 AS live FROM nation WHERE n_nationkey % 6 <> 1), b AS (SELECT n_nationkey FROM s ORDER BY CASE WHEN live THEN 1 ELSE 2 END, fetched DESC LIMIT 1) SELECT currency, rate + n_nationkey / 100.0::DOUBLE AS rate, 'live' AS source FROM b, (SELECT unnest(['USD', 'EUR']) AS currency, unnest([1.0::DOUBLE, 0.9::DOUBLE]) AS rate)",
)
def s34(spark, d):
    """Snapshots of rates, all cached ones over a day old and some broken: the newest live one counts."""
    k = F.col("n_nationkey")
    text = F.to_json(F.struct(F.create_map(lit("USD"), 1.0 + k / 100.0, lit("EUR"), 0.9 + k / 100.0).alias("rates")))
    at = (now() - F.make_dt_interval(lit(0), (30 + k).cast("int"))).cast("timestamp")
    rows = table(spark, d, "nation").select(at.alias("fetched_at"), F.when(k % 6 == 1, F.substring(text, 1, 9)).otherwise(text).alias("payload"), (k % 4 == 1).alias("live"))
    return rates_in_use(rows, now().cast("timestamp"))


@add("s35_run_rows", "SELECT run, count(*) AS listed, count(DISTINCT board_id) AS boards FROM listings GROUP BY 1")
def s35(spark, d):
    """A row for each run, appended to the table of runs in two writes and read again."""
    path = f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
    rows = saved(listings(spark, d).groupBy("run").agg(F.count("*").alias("listed"), F.count_distinct("board_id").alias("boards")))
    for part in ("year(run) < 1995", "year(run) >= 1995"):
        rows.where(part).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
