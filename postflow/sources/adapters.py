"""Payloads of job boards and aggregators as postings: each adapter declares a payload's shape and projects its elements.

An adapter takes envelopes (run_key, source, token, market, payload, fetched_at; payload is text, read here and never transformed before)
and gives one row of POSTING for each element that has an id and a title. A payload of another shape gives none; an element that is no
object, or lacks what a posting needs, is dropped alone. Missing values stay null.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.functions import html as H
from postflow.functions.places import country_code, literal_map, parse_location
from postflow.functions.text import completeness, domain_from_url, employment_type, html_to_markdown, html_to_text, turkish_fold, unescape_if_escaped
from postflow.functions.values import parse_datetime, relative_age
from postflow.operators.storage import saved_in_small_batches

ENVELOPE = "run_key string, source string, provider string, token string, market string, board_id bigint, fetched_at string, payload string, truncated boolean, refused boolean"
#: The columns of a posting that an adapter may state, and their types.
FIELDS = {
    "external_id": "string", "title": "string", "company_name": "string", "company_domain": "string", "location_raw": "string", "country": "string", "city": "string",
    "remote_type": "string", "employment_type": "string", "salary_min": "double", "salary_max": "double", "salary_currency": "string", "salary_period": "string",
    "description_html": "string", "description_text": "string", "description_md": "string", "description_lang": "string", "jd_completeness": "string", "jd_source": "string",
    "posted_at": "timestamp_ntz", "apply_url": "string", "source_url": "string", "departments": "array<string>", "poster_name": "string", "poster_profile_url": "string",
}
#: Words of the feeds and what they mean. Fixed values.
WORKPLACES = {"onsite": "onsite", "on_site": "onsite", "on-site": "onsite", "remote": "remote", "hybrid": "hybrid"}
PERIODS = {"year": "annual", "annual": "annual", "month": "monthly", "week": "weekly", "day": "daily", "hour": "hourly"}
PERIOD_LETTERS = {"Y": "annual", "M": "monthly", "W": "weekly", "D": "daily", "H": "hourly"}
LOCATION_NOTES = ("job posting location", "location", "office location", "city")
MONEY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₺": "TRY"}
TURKISH_PLACES = (("Uzaktan", "remote"), ("Hibrit", "hybrid"), ("İş Yerinde", "onsite"))
TURKISH_MODELS = {"is yerinde": "onsite", "uzaktan / remote": "remote", "hibrit": "hybrid"}
TURKISH_TYPES = {"tam zamanli": "full_time", "yari zamanli": "part_time", "donemsel": "contract", "serbest zamanli": "contract"}
COUNTRY_WORDS = ("turkey", "turkiye", "tr")
HIDDEN_COMPANY = "Gizli Firma"
HEADQUARTERS = r"(?i)<strong>\s*Headquarters:\s*</strong>\s*([^<\n]+)"
ID, TEXT, LIST = "id string, ", " string, ", "array<string>"

ABOUT = ("run_key", "source", "token", "market", "fetched_at")

Adapter = Callable[[DataFrame], DataFrame]


def clean(c: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


def first(*cs: Column) -> Column:
    return F.coalesce(*[clean(c) for c in cs])


def looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(table), key)


def period_of(c: Column) -> Column:
    """annual, monthly, ... from year, yearly, per-year-salary, 1 YEAR and the like."""
    unit = F.regexp_extract(F.lower(c), "(year|annual|month|week|hour|daily|day)", 1)
    return looked_up(PERIODS | {"daily": "daily"}, unit)


def some(*cs: Column) -> Column:
    """The texts that are there."""
    return F.filter(F.array(*cs), lambda x: x.isNotNull() & (x != ""))


def elements(envelopes: DataFrame, shape: str, at: Callable[[Column], Column], element: str) -> DataFrame:
    """Envelope columns, the place of each element of the array that `at` finds in a payload of this shape, and the element as x.

    Elements are first taken as text, so that one with a wrong type loses only its own field.
    """
    items = at(F.from_json("payload", shape))
    read = F.transform(items, lambda raw: F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, element)))  # before rows are made, or every filter on x would read it again
    return envelopes.select("run_key", "source", "token", "market", "fetched_at", F.posexplode(read).alias("place", "x")).where("x is not null")


def postings(rows: DataFrame, told_by: str = "api", excerpts: bool = False, **given: Column) -> DataFrame:
    """Postings of rows (envelope columns and whatever `given` refers to). Text and Markdown come from the HTML, completeness from the text; excerpts are never whole."""
    body = given.get("description_html", F.lit(None).cast("string"))
    rows = rows.withColumns({f"own_{k}": v for k, v in given.items()} | {"own_description_html": body})
    text = F.col("own_description_text") if "description_text" in given else F.nullif(html_to_text(F.col("own_description_html")), F.lit(""))
    rows = rows.withColumn("own_description_text", text)
    made = {
        "description_md": F.when(F.col("own_description_html") != "", html_to_markdown(F.col("own_description_html"))),
        "jd_completeness": F.when(F.col("own_description_text").isNotNull(), "snippet").otherwise("none") if excerpts else completeness(F.col("own_description_text")),
        "jd_source": F.when(F.col("own_description_text") != "", told_by),
        "remote_type": F.lit("unknown"),
        "departments": F.array().cast(LIST),
    }
    column = lambda k: F.col(f"own_{k}") if k in given or k.startswith(("description_html", "description_text")) else made.get(k, F.lit(None))
    out = rows.select("run_key", "source", "token", "market", "place", *(column(k).cast(kind).alias(k) for k, kind in FIELDS.items()))
    out = out.withColumns({"remote_type": F.coalesce("remote_type", F.lit("unknown")), "salary_is_stated": F.col("salary_min").isNotNull() | F.col("salary_max").isNotNull()})
    return out.where((F.col("external_id") != "") & (F.col("title") != ""))


def once(rows: DataFrame, external_id: Column, title: Column) -> DataFrame:
    """The first of the rows with one id in a run of a board, before anything is made of them: order shifts between two pages of one search."""
    by = Window.partitionBy("run_key", "source", "token", "own_id").orderBy("place")
    found = rows.withColumn("own_id", external_id).where((F.col("own_id") != "") & (title != ""))
    return found.withColumn("nth", F.row_number().over(by)).where("nth = 1").drop("nth", "own_id")


def placed(rows: DataFrame, raw: Column) -> DataFrame:
    """Adds `where`: struct(country, city, remote_type) of a place as it is written."""
    return rows.withColumn("where", parse_location(raw))


def greenhouse(envelopes: DataFrame) -> DataFrame:
    """The body is escaped; a location among the notes beats the location's name."""
    rows = elements(envelopes, "jobs array<string>", lambda p: p["jobs"], f"{ID}title string, content string, absolute_url string, company_name string, location struct<name string>, metadata array<struct<name string, value string>>, first_published string, updated_at string, departments array<struct<name string>>")
    x = F.col("x")
    value = lambda m: clean(F.when(m["value"].startswith("["), F.array_join(F.from_json(m["value"], LIST), ", ")).otherwise(m["value"]))
    noted = F.filter(x["metadata"], lambda m: F.lower(F.trim(m["name"])).isin(*LOCATION_NOTES) & value(m).isNotNull())
    location = F.coalesce(value(F.try_element_at(noted, F.lit(1))), clean(x["location"]["name"]))
    rows = placed(rows.withColumn("location", location), F.col("location"))
    return postings(
        rows, external_id=x["id"], title=F.trim(x["title"]), company_name=first(x["company_name"], F.col("token")), company_domain=domain_from_url(x["absolute_url"]), location_raw=F.col("location"), country=F.col("where.country"), city=F.col("where.city"),
        remote_type=F.col("where.remote_type"), description_html=unescape_if_escaped(x["content"]), posted_at=parse_datetime(F.coalesce(x["first_published"], x["updated_at"])), apply_url=x["absolute_url"], source_url=x["absolute_url"],
        departments=F.filter(F.transform(x["departments"], lambda d: d["name"]), lambda d: d != ""),
    )


def ashby(envelopes: DataFrame) -> DataFrame:
    """Unlisted postings are dropped, the postal address beats the location, and only salary components of the tiers count."""
    component = "struct<compensationType string, minValue double, maxValue double, currencyCode string, interval string>"
    rows = elements(envelopes, "jobs array<string>", lambda p: p["jobs"], f"{ID}title string, isListed boolean, descriptionHtml string, descriptionPlain string, location string, workplaceType string, employmentType string, address struct<postalAddress struct<addressCountry string, addressLocality string>>, compensation struct<compensationTiers array<struct<components array<{component}>>>>, publishedAt string, applyUrl string, jobUrl string, department string, team string")
    x = F.col("x")
    rows = placed(rows.where(F.coalesce(x["isListed"], F.lit(True))), x["location"])
    pay = F.filter(F.flatten(F.transform(x["compensation"]["compensationTiers"], lambda t: F.coalesce(t["components"], F.array().cast(f"array<{component}>")))), lambda c: (c["compensationType"] == "Salary") & (c["minValue"].isNotNull() | c["maxValue"].isNotNull()))
    rows = rows.withColumn("pay", pay)
    each = lambda f: F.transform("pay", f)
    stated = lambda f: F.try_element_at(F.filter(each(f), lambda v: v.isNotNull()), F.lit(1))
    post = x["address"]["postalAddress"]
    return postings(
        rows, external_id=x["id"], title=F.trim(x["title"]), company_name=F.col("token"), location_raw=clean(x["location"]), country=F.coalesce(country_code(clean(post["addressCountry"])), F.col("where.country")), city=F.coalesce(clean(post["addressLocality"]), F.col("where.city")),
        remote_type=F.coalesce(looked_up(WORKPLACES, F.lower(F.trim(x["workplaceType"]))), F.col("where.remote_type")), employment_type=employment_type(x["employmentType"]), salary_min=F.array_min(each(lambda c: c["minValue"])), salary_max=F.array_max(each(lambda c: c["maxValue"])),
        salary_currency=stated(lambda c: c["currencyCode"]), salary_period=stated(lambda c: period_of(c["interval"])), description_html=F.coalesce(x["descriptionHtml"], F.lit("")), description_text=F.coalesce(clean(x["descriptionPlain"]), F.nullif(html_to_text(x["descriptionHtml"]), F.lit(""))),
        posted_at=parse_datetime(x["publishedAt"]), apply_url=first(x["applyUrl"], x["jobUrl"]), source_url=x["jobUrl"], departments=some(x["department"], x["team"]),
    )


def lever(envelopes: DataFrame) -> DataFrame:
    """A bare array. The body is in parts: opening and main part (or, on older boards, both in one), headed lists, and a closing."""
    rows = elements(envelopes, LIST, lambda p: p, f"{ID}text string, opening string, descriptionBody string, description string, lists array<struct<text string, content string>>, additional string, categories struct<location string, commitment string, department string, team string>, country string, workplaceType string, salaryRange struct<min double, max double, currency string, interval string>, createdAt string, applyUrl string, hostedUrl string")
    x = F.col("x")
    opening = some(clean(x["opening"]), clean(x["descriptionBody"]))
    lists = F.flatten(F.transform(F.coalesce(x["lists"], F.array().cast("array<struct<text string, content string>>")), lambda b: some(F.when(clean(b["text"]).isNotNull(), F.concat(F.lit("<h3>"), F.trim(b["text"]), F.lit("</h3>"))), clean(b["content"]))))
    body = F.array_join(F.concat(F.when(F.size(opening) > 0, opening).otherwise(some(clean(x["description"]))), lists, some(clean(x["additional"]))), "\n")
    rows = placed(rows, x["categories"]["location"])
    return postings(
        rows, external_id=x["id"], title=F.trim(x["text"]), company_name=F.col("token"), location_raw=clean(x["categories"]["location"]), country=F.coalesce(F.substring(F.upper(clean(x["country"])), 1, 2), F.col("where.country")), city=F.col("where.city"),
        remote_type=F.coalesce(looked_up(WORKPLACES, F.lower(F.trim(x["workplaceType"]))), F.col("where.remote_type")), employment_type=employment_type(x["categories"]["commitment"]), salary_min=x["salaryRange"]["min"], salary_max=x["salaryRange"]["max"],
        salary_currency=clean(x["salaryRange"]["currency"]), salary_period=period_of(x["salaryRange"]["interval"]), description_html=body, posted_at=parse_datetime(x["createdAt"]), apply_url=first(x["applyUrl"], x["hostedUrl"]), source_url=x["hostedUrl"],
        departments=some(x["categories"]["department"], x["categories"]["team"]),
    )


def recruitee(envelopes: DataFrame) -> DataFrame:
    """Published offers only; three booleans tell the work mode, and pay comes as text."""
    rows = elements(envelopes, "offers array<string>", lambda p: p["offers"], f"{ID}title string, position string, status string, description string, requirements string, remote boolean, hybrid boolean, on_site boolean, salary struct<min string, max string, currency string, period string>, careers_url string, careers_apply_url string, company_name string, location string, city string, country_code string, employment_type_code string, published_at string, created_at string, department string")
    x = F.col("x")
    rows = rows.where(F.coalesce(clean(x["status"]), F.lit("published")) == "published")
    mode = F.when(x["remote"], "remote").when(x["hybrid"], "hybrid").when(x["on_site"], "onsite")
    return postings(
        rows, external_id=x["id"], title=first(x["title"], x["position"]), company_name=first(x["company_name"], F.col("token")), company_domain=domain_from_url(x["careers_url"]), location_raw=first(x["location"], x["city"]), country=F.substring(F.upper(clean(x["country_code"])), 1, 2),
        city=clean(x["city"]), remote_type=mode, employment_type=employment_type(x["employment_type_code"]), salary_min=x["salary"]["min"].try_cast("double"), salary_max=x["salary"]["max"].try_cast("double"), salary_currency=clean(x["salary"]["currency"]),
        salary_period=period_of(x["salary"]["period"]), description_html=F.array_join(some(x["description"], x["requirements"]), "\n"), posted_at=parse_datetime(first(x["published_at"], x["created_at"])), apply_url=first(x["careers_apply_url"], x["careers_url"]),
        source_url=x["careers_url"], departments=some(x["department"]),
    )


def smartrecruiters(envelopes: DataFrame) -> DataFrame:
    """Public postings only; the list has no bodies, so completeness is none."""
    rows = elements(envelopes, "content array<string>", lambda p: p["content"], f"{ID}name string, company struct<identifier string, name string>, releasedDate string, location struct<city string, region string, country string, remote boolean, hybrid boolean>, department struct<label string>, `function` struct<label string>, typeOfEmployment struct<label string>, visibility string, ref string")
    x = F.col("x")
    where, city = x["location"], clean(x["location"]["city"])
    rows = rows.where(F.upper(F.coalesce(clean(x["visibility"]), F.lit("PUBLIC"))) == "PUBLIC")
    mode = F.when(where["remote"], "remote").when(where["hybrid"], "hybrid").when(city.isNotNull(), "onsite")
    return postings(
        rows, external_id=x["id"], title=F.trim(x["name"]), company_name=first(x["company"]["name"], F.col("token")), location_raw=clean(F.array_join(some(city, where["region"], where["country"]), ", ")), country=F.substring(F.upper(clean(where["country"])), 1, 2), city=city, remote_type=mode,
        employment_type=employment_type(x["typeOfEmployment"]["label"]), posted_at=parse_datetime(x["releasedDate"]), apply_url=F.concat(F.lit("https://jobs.smartrecruiters.com/"), first(x["company"]["identifier"], F.col("token")), F.lit("/"), x["id"]), source_url=x["ref"],
        departments=some(x["department"]["label"], x["function"]["label"]),
    )


def personio(envelopes: DataFrame) -> DataFrame:
    """An XML feed. Schedule and employment type together tell the kind; the first office places the posting, all are listed."""
    block = "struct<name string, value string>"
    position = f"struct<{ID}subcompany string, office string, additionalOffices struct<office {LIST}>, department string, recruitingCategory string, name string, jobDescriptions struct<jobDescription array<{block}>>, employmentType string, seniority string, schedule string, createdAt string>"
    rows = envelopes.select("run_key", "source", "token", "market", "fetched_at", F.posexplode(F.from_xml("payload", f"position array<{position}>", {"mode": "PERMISSIVE"})["position"]).alias("place", "x"))
    x, office = F.col("x"), clean(F.col("x.office"))
    body = F.flatten(F.transform(F.coalesce(x["jobDescriptions"]["jobDescription"], F.array().cast(f"array<{block}>")), lambda b: some(F.when(clean(b["name"]).isNotNull(), F.concat(F.lit("<h3>"), F.trim(b["name"]), F.lit("</h3>"))), clean(b["value"]))))
    offices = F.array_distinct(F.filter(F.concat(F.array(office), F.transform(F.coalesce(x["additionalOffices"]["office"], F.array().cast(LIST)), clean)), lambda o: o.isNotNull()))
    url = F.concat(F.lit("https://"), F.col("token"), F.lit(".jobs.personio.de/job/"), F.trim(x["id"]))
    rows = placed(rows, office)
    return postings(
        rows, external_id=F.trim(x["id"]), title=F.trim(x["name"]), company_name=first(x["subcompany"], F.col("token")), location_raw=clean(F.array_join(offices, ", ")), country=F.col("where.country"), city=F.coalesce(F.col("where.city"), office),
        remote_type=F.coalesce(looked_up(WORKPLACES, F.lower(F.trim(x["schedule"]))), F.col("where.remote_type")), employment_type=employment_type(x["schedule"], x["employmentType"]), description_html=F.array_join(body, "\n"), posted_at=parse_datetime(F.trim(x["createdAt"])), apply_url=url, source_url=url,
        departments=some(clean(x["department"]), clean(x["recruitingCategory"])),
    )


def workable(envelopes: DataFrame) -> DataFrame:
    """The first ISO code among the locations beats the country's name."""
    named = envelopes.withColumn("account", F.from_json("payload", "name string")["name"])
    rows = elements(named.withColumn("token", F.coalesce(clean(F.col("account")), F.col("token"))), "jobs array<string>", lambda p: p["jobs"], "shortcode string, title string, employment_type string, telecommuting boolean, department string, url string, shortlink string, application_url string, published_on string, created_at string, country string, city string, state string, `function` string, locations array<struct<countryCode string>>, description string")
    x, city = F.col("x"), clean(F.col("x.city"))
    codes = F.filter(F.transform(x["locations"], lambda p: clean(p["countryCode"])), lambda c: c.isNotNull())
    return postings(
        rows, external_id=x["shortcode"], title=F.trim(x["title"]), company_name=F.col("token"), location_raw=clean(F.array_join(some(city, x["state"], clean(x["country"])), ", ")), country=F.coalesce(F.substring(F.upper(F.try_element_at(codes, F.lit(1))), 1, 2), country_code(clean(x["country"]))), city=city,
        remote_type=F.when(x["telecommuting"], "remote").when(city.isNotNull(), "onsite"), employment_type=employment_type(x["employment_type"]), description_html=x["description"], posted_at=parse_datetime(first(x["published_on"], x["created_at"])),
        apply_url=first(x["application_url"], x["url"]), source_url=first(x["url"], x["shortlink"]), departments=some(x["department"], x["function"]),
    )


def paged(field: str = "jobs") -> Callable[[Column], Column]:
    return lambda p: F.flatten(F.transform(p["pages"], lambda g: F.coalesce(g[field], F.array().cast(LIST))))


def workable_search(envelopes: DataFrame) -> DataFrame:
    """Pages of a search over all companies; the body's three sections are joined, and an id that comes again is dropped."""
    rows = elements(envelopes, "pages array<struct<jobs array<string>>>", paged(), f"{ID}title string, state string, description string, requirementsSection string, benefitsSection string, company struct<title string>, location struct<city string, countryName string>, locations array<string>, workplace string, employmentType string, language string, created string, url string, linkoutUrl string, department string")
    x = F.col("x")
    rows = rows.where((F.coalesce(x["state"], F.lit("published")) == "published") & clean(x["company"]["title"]).isNotNull())
    rows = once(rows, x["id"], F.trim(x["title"]))
    section = lambda head, c: F.when(clean(c).isNotNull(), F.concat(F.lit(f"<h3>{head}</h3>"), c)).otherwise("")
    body = clean(F.concat(F.coalesce(x["description"], F.lit("")), section("Requirements", x["requirementsSection"]), section("Benefits", x["benefitsSection"])))
    places = F.filter(x["locations"], lambda p: p != "TELECOMMUTE")
    return postings(
        rows, external_id=x["id"], title=F.trim(x["title"]), company_name=F.trim(x["company"]["title"]), location_raw=first(F.array_join(places, "; "), x["location"]["countryName"]), country=country_code(clean(x["location"]["countryName"])), city=clean(x["location"]["city"]),
        remote_type=looked_up(WORKPLACES, x["workplace"]), employment_type=employment_type(x["employmentType"]), description_html=body, description_lang=clean(x["language"]), posted_at=parse_datetime(x["created"]), apply_url=first(x["linkoutUrl"], x["url"]), source_url=clean(x["url"]),
        departments=some(x["department"]),
    )


def remotive(envelopes: DataFrame) -> DataFrame:
    """Remote by definition; pay is free text: amounts of a thousand or more, the lowest and, if there are several, the highest."""
    rows = elements(envelopes, "jobs array<string>", lambda p: p["jobs"], f"{ID}title string, description string, candidate_required_location string, salary string, company_name string, job_type string, publication_date string, url string, category string")
    x = F.col("x")
    told = F.transform(F.regexp_extract_all(F.lower(x["salary"]), F.lit(r"\d[\d,.]*\s*k?"), 0), lambda m: F.regexp_replace(m, r"[,\s]", ""))
    amounts = F.filter(F.transform(told, lambda m: F.regexp_replace(m, "k$", "").try_cast("double") * F.when(m.endswith("k"), 1000).otherwise(1)), lambda a: a >= 1000)
    rows = placed(rows.withColumn("amounts", amounts), x["candidate_required_location"])
    sign = reduce(lambda found, kv: F.when(x["salary"].contains(kv[0]), kv[1]).otherwise(found), reversed(MONEY_SIGNS.items()), F.lit(None).cast("string"))
    return postings(
        rows, external_id=x["id"], title=F.trim(x["title"]), company_name=first(x["company_name"], F.lit("unknown")), location_raw=clean(x["candidate_required_location"]), country=F.col("where.country"), city=F.col("where.city"), remote_type=F.lit("remote"), employment_type=employment_type(x["job_type"]),
        salary_min=F.array_min("amounts"), salary_max=F.when(F.size("amounts") > 1, F.array_max("amounts")), salary_currency=sign, salary_period=F.when(F.size("amounts") > 0, "annual"), description_html=x["description"], posted_at=parse_datetime(x["publication_date"]), apply_url=x["url"], source_url=x["url"],
        departments=some(x["category"]),
    )


def remoteok(envelopes: DataFrame) -> DataFrame:
    """A bare array with a legal notice, told by its shape; a salary of 0 is unstated."""
    rows = elements(envelopes, LIST, lambda p: p, f"{ID}slug string, legal string, epoch string, `date` string, company string, position string, tags array<string>, description string, location string, apply_url string, salary_min double, salary_max double, url string")
    x, zero = F.col("x"), F.lit(0.0)
    rows = rows.where(clean(x["legal"]).isNull() & clean(x["position"]).isNotNull())
    rows = placed(rows.withColumn("location", F.nullif(F.trim(x["location"], F.lit(" ,")), F.lit(""))), F.col("location"))
    low, high = F.nullif(x["salary_min"], zero), F.nullif(x["salary_max"], zero)
    stated = low.isNotNull() | high.isNotNull()
    return postings(
        rows, external_id=first(x["id"], x["slug"]), title=F.trim(x["position"]), company_name=first(x["company"], F.lit("unknown")), location_raw=F.col("location"), country=F.col("where.country"), city=F.col("where.city"), remote_type=F.lit("remote"), salary_min=low, salary_max=high,
        salary_currency=F.when(stated, "USD"), salary_period=F.when(stated, "annual"), description_html=x["description"], posted_at=parse_datetime(first(x["epoch"], x["date"])), apply_url=first(x["apply_url"], x["url"]), source_url=x["url"], departments=F.slice(x["tags"], 1, 3),
    )


def arbeitnow(envelopes: DataFrame) -> DataFrame:
    """The slug is the id and the body is escaped; followed pages are one payload."""
    rows = elements(envelopes, "data array<string>", lambda p: p["data"], "slug string, company_name string, title string, description string, remote boolean, url string, tags array<string>, job_types array<string>, location string, created_at string")
    x = F.col("x")
    rows = placed(rows, x["location"])
    return postings(
        rows, external_id=x["slug"], title=F.trim(x["title"]), company_name=first(x["company_name"], F.lit("unknown")), location_raw=clean(x["location"]), country=F.col("where.country"), city=F.col("where.city"), remote_type=F.when(x["remote"], "remote").otherwise(F.col("where.remote_type")),
        employment_type=employment_type(x["job_types"]), description_html=unescape_if_escaped(x["description"]), posted_at=parse_datetime(x["created_at"]), apply_url=x["url"], source_url=x["url"], departments=F.slice(x["tags"], 1, 3),
    )


def jobicy(envelopes: DataFrame) -> DataFrame:
    """Remote by definition; pay that is 0 or blank is unstated."""
    rows = elements(envelopes, "jobs array<string>", lambda p: p["jobs"], f"{ID}jobTitle string, jobDescription string, jobGeo string, salaryMin string, salaryMax string, salaryCurrency string, salaryPeriod string, companyName string, jobType array<string>, jobIndustry array<string>, pubDate string, url string")
    x = F.col("x")
    rows = placed(rows, x["jobGeo"])
    amount = lambda c: F.nullif(c.try_cast("double"), F.lit(0.0))
    return postings(
        rows, external_id=x["id"], title=F.trim(x["jobTitle"]), company_name=first(x["companyName"], F.lit("unknown")), location_raw=clean(x["jobGeo"]), country=F.col("where.country"), city=F.col("where.city"), remote_type=F.lit("remote"), employment_type=employment_type(x["jobType"]), salary_min=amount(x["salaryMin"]),
        salary_max=amount(x["salaryMax"]), salary_currency=clean(x["salaryCurrency"]), salary_period=period_of(x["salaryPeriod"]), description_html=x["jobDescription"], posted_at=parse_datetime(x["pubDate"]), apply_url=x["url"], source_url=x["url"], departments=F.slice(x["jobIndustry"], 1, 3),
    )


def wwr(envelopes: DataFrame) -> DataFrame:
    """An RSS feed: "Company: Role" titles; a headquarters line in the body beats the country, which beats the region."""
    item = "struct<title string, region string, country string, state string, type string, category string, description string, pubDate string, guid string, link string>"
    rows = envelopes.select("run_key", "source", "token", "market", "fetched_at", F.posexplode(F.from_xml("payload", f"channel struct<item array<{item}>>", {"mode": "PERMISSIVE"})["channel"]["item"]).alias("place", "x"))
    x, title = F.col("x"), F.trim(F.col("x.title"))
    company, role = F.trim(F.substring_index(title, ":", 1)), F.trim(F.regexp_extract(title, "(?s)^[^:]*:(.*)$", 1))
    split = title.contains(":") & (company != "") & (role != "")
    seat = clean(F.substring_index(F.regexp_extract(x["description"], HEADQUARTERS, 1), ";", 1))
    rows = placed(rows.withColumn("seat", seat), F.coalesce(F.col("seat"), clean(x["country"]), clean(x["region"])))
    link = first(x["link"], x["guid"])
    return postings(
        rows, "rss", external_id=link, title=F.when(split, role).otherwise(title), company_name=F.when(split, company).otherwise("unknown"), location_raw=F.coalesce(F.col("seat"), clean(x["region"])), country=F.col("where.country"), city=F.coalesce(F.col("where.city"), clean(x["state"])),
        remote_type=F.when(F.col("where.remote_type") == "unknown", "remote").otherwise(F.col("where.remote_type")), employment_type=employment_type(x["type"]), description_html=x["description"], posted_at=parse_datetime(F.trim(x["pubDate"])), apply_url=link, source_url=link, departments=some(clean(x["category"])),
    )


def techcareer(envelopes: DataFrame) -> DataFrame:
    """Pages of a list; disabled and unpublished jobs are dropped, places are joined and the first decides, a hidden employer has a label."""
    rows = elements(envelopes, "pages array<struct<jobs array<string>>>", paged(), "jobId string, title string, slug string, isDisabledJob boolean, jobStatus string, description string, jobDepartmentName string, workPlaces array<struct<workPlaceName string>>, location struct<locationName string>, otherLocations array<struct<locationName string>>, company struct<companyProfileName string>, secretCompanyInfo struct<secretCompanyDescription string>, applyLink string")
    x = F.col("x")
    rows = rows.where(clean(x["slug"]).isNotNull() & ~F.coalesce(x["isDisabledJob"], F.lit(False)) & (F.coalesce(x["jobStatus"], F.lit("Published")) == "Published"))
    rows = once(rows, x["jobId"], F.trim(x["title"]))
    others = F.transform(F.coalesce(x["otherLocations"], F.array().cast("array<struct<locationName string>>")), lambda p: clean(p["locationName"]))
    places = F.filter(F.concat(F.array(clean(x["location"]["locationName"])), others), lambda p: p.isNotNull())
    rows = placed(rows.withColumn("places", places), F.try_element_at(places, F.lit(1)))
    names = F.transform(x["workPlaces"], lambda w: F.trim(w["workPlaceName"]))
    mode = reduce(lambda found, kv: F.when(F.array_contains(names, kv[0]), kv[1]).otherwise(found), reversed(TURKISH_PLACES), F.lit(None).cast("string"))
    url = F.concat(F.lit("https://www.techcareer.net/jobs/detail/"), F.trim(x["slug"]))
    return postings(
        rows, external_id=x["jobId"], title=F.trim(x["title"]), company_name=first(x["company"]["companyProfileName"], x["secretCompanyInfo"]["secretCompanyDescription"], F.lit(HIDDEN_COMPANY)), location_raw=clean(F.array_join("places", "; ")), country=F.col("where.country"), city=F.col("where.city"),
        remote_type=mode, description_html=clean(x["description"]), apply_url=first(x["applyLink"], url), source_url=url, departments=some(clean(x["jobDepartmentName"])),
    )


def careerjet(envelopes: DataFrame) -> DataFrame:
    """Search pages of type JOBS. There is no id: title, company and place, folded, are hashed. Bodies are excerpts; the country is the search's."""
    of_type = lambda p: F.flatten(F.transform(F.filter(p["pages"], lambda g: g["type"] == "JOBS"), lambda g: F.coalesce(g["jobs"], F.array().cast(LIST))))
    rows = elements(envelopes, "pages array<struct<type string, jobs array<string>>>", of_type, "title string, company string, locations string, description string, salary_min string, salary_max string, salary_currency_code string, salary_type string, `date` string, url string")
    x = F.col("x")
    key = F.concat_ws("|", *(turkish_fold(F.coalesce(x[c], F.lit(""))) for c in ("title", "company", "locations")))
    external_id = F.substring(F.sha1(key), 1, 20)
    rows = once(rows.where(clean(x["company"]).isNotNull()), external_id, F.trim(x["title"]))
    places = F.filter(F.transform(F.split(x["locations"], ","), lambda p: F.trim(p)), lambda p: (p != "") & ~turkish_fold(p).isin(*COUNTRY_WORDS))
    signal = F.concat_ws(" ", x["title"], x["locations"])
    amount = lambda c: F.when(c.try_cast("double") > 0, c.try_cast("double"))
    low, high = amount(x["salary_min"]), amount(x["salary_max"])
    stated = low.isNotNull() | high.isNotNull()
    return postings(
        rows, excerpts=True, external_id=external_id, title=F.trim(x["title"]), company_name=F.trim(x["company"]), location_raw=clean(x["locations"]), country=F.lit("TR"), city=F.try_element_at(places, F.lit(-1)),
        remote_type=F.when(signal.rlike(r"(?i)\b(hibrit|hybrid)\b"), "hybrid").when(signal.rlike(r"(?i)\b(uzaktan|remote|evden)\b"), "remote"), salary_min=low, salary_max=high, salary_currency=F.when(stated, clean(x["salary_currency_code"])), salary_period=F.when(stated, looked_up(PERIOD_LETTERS, x["salary_type"])),
        description_html=clean(x["description"]), posted_at=parse_datetime(x["date"]), apply_url=clean(x["url"]), source_url=clean(x["url"]),
    )


def cards_of(envelopes: DataFrame, field: str, read: Callable[[Column], Column], detail: Callable[[Column], Column]) -> DataFrame:
    """Cards of the result pages in a payload of HTML texts, in order, each with what its detail page says (if that was fetched).

    A payload may hold many cards, so batches sent to Python are bounded by bytes.
    """
    shape = F.from_json("payload", f"{field} array<string>, details map<string, string>, fetched_at string")
    rows = envelopes.withColumn("p", shape).select("run_key", "source", "token", "market", F.coalesce("p.fetched_at", "fetched_at").alias("fetched_at"), F.col("p.details").alias("details"), F.posexplode(F.col(f"p.{field}")).alias("page", "html"))
    with_detail = F.transform("cards", lambda c: F.struct(c.alias("x"), F.try_element_at("details", c["id"]).alias("page_html")))  # so that no card carries the pages of others
    pairs = rows.withColumn("cards", read(F.col("html"))).select(*ABOUT, "page", F.posexplode(with_detail).alias("nth", "pair"))
    cards = pairs.select(*ABOUT, (F.col("page") * 10000 + F.col("nth")).alias("place"), "pair.x", detail(F.col("pair.page_html")).alias("d"))
    return saved_in_small_batches(cards)


def kariyer(envelopes: DataFrame) -> DataFrame:
    """HTML cards; ages such as "3 gün önce" count back from the fetch."""
    rows = cards_of(envelopes, "pages", H.board_cards, H.board_detail)
    x = F.col("x")
    company = first(x["company"], F.col("d.company"))
    city = clean(F.regexp_replace(x["location"], r"\s*(\(.*?\))?\s*(\+\s*\d+\s*il daha)?\s*$", ""))
    kind = turkish_fold(x["work_type"])
    url = F.concat(F.lit("https://www.kariyer.net"), x["path"])
    return postings(
        once(rows.where(company.isNotNull()), x["id"], F.trim(x["title"])), "html", external_id=x["id"], title=F.trim(x["title"]), company_name=company, location_raw=clean(x["location"]), country=F.lit("TR"), city=city, remote_type=looked_up(TURKISH_MODELS, turkish_fold(x["work_model"])),
        employment_type=F.coalesce(looked_up(TURKISH_TYPES, kind), employment_type(kind)), description_html=clean(F.col("d.body")), posted_at=relative_age(x["age"], parse_datetime(F.col("fetched_at"))), apply_url=url, source_url=url,
    )


def clean_url(href: Column, base: str = "https://www.linkedin.com") -> Column:
    """Absolute, without query, fragment and closing slash; the host stays as it is."""
    bare = F.trim(F.substring_index(F.substring_index(href, "?", 1), "#", 1))
    whole = F.when(bare.startswith("//"), F.concat(F.lit("https:"), bare)).when(bare.startswith("/"), F.concat(F.lit(base), bare)).when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit(f"{base}/"), bare))
    return F.when(bare != "", F.nullif(F.regexp_replace(whole, "/+$", ""), F.lit("")))


def clean_profile_url(href: Column) -> Column:
    """As clean_url, and regional hosts of the network become its main one, so that a person has one address."""
    return F.regexp_replace(clean_url(href), r"(?i)^(https?://)(?:[^/]*\.)?linkedin\.com(?=/|$)", "$1www.linkedin.com")


def linkedin(envelopes: DataFrame) -> DataFrame:
    """HTML cards; the address of a posting is made from its number, the body and the poster come from the detail page."""
    rows = placed(cards_of(envelopes, "cards", H.profile_cards, H.profile_detail), F.col("x.location"))
    x = F.col("x")
    source_url = F.concat(F.lit("https://www.linkedin.com/jobs/view/"), x["id"])
    body = clean(F.col("d.body"))
    return postings(
        rows, "html", external_id=x["id"], title=F.trim(x["title"]), company_name=first(x["company"], F.lit("unknown")), location_raw=clean(x["location"]), country=F.col("where.country"), city=F.col("where.city"), description_html=body, jd_completeness=F.when(body.isNotNull(), "full").otherwise("none"),
        posted_at=parse_datetime(x["listed"]), apply_url=F.coalesce(clean_url(x["href"]), source_url), source_url=source_url, poster_name=F.col("d.poster"), poster_profile_url=clean_profile_url(F.col("d.profile")),
    )


ADAPTERS: dict[str, Adapter] = {
    "greenhouse": greenhouse, "ashby": ashby, "lever": lever, "recruitee": recruitee, "smartrecruiters": smartrecruiters, "personio": personio, "workable": workable, "workable_search": workable_search, "remotive": remotive,
    "remoteok": remoteok, "arbeitnow": arbeitnow, "jobicy": jobicy, "wwr": wwr, "techcareer": techcareer, "careerjet": careerjet, "kariyer_net": kariyer, "linkedin": linkedin,
}


def normalized(envelopes: DataFrame, sources: tuple[str, ...] = tuple(ADAPTERS)) -> DataFrame:
    """The postings of all envelopes, each by its source's adapter; envelopes of other sources give none."""
    return reduce(DataFrame.unionByName, [ADAPTERS[s](envelopes.where(F.col("source") == s)) for s in sources])


__all__ = ["ADAPTERS", "ENVELOPE", "FIELDS", "clean_profile_url", "clean_url", "normalized"]
