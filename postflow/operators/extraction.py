"""Bodies of postings from their pages: structured data first, then the main block; the first that passes the quality gate counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.functions.html import job_posting, main_block
from postflow.functions.places import country_code
from postflow.functions.quality import assess
from postflow.functions.text import domain_from_url, html_to_text, unescape_if_escaped

LIST = "array<string>"


def first_of(node: Column) -> Column:
    """A JSON text, or the first element if it is a list."""
    return F.when(F.ltrim(node).startswith("["), F.try_element_at(F.from_json(node, LIST), F.lit(1))).otherwise(node)


def of(node: Column, *keys: str) -> Column:
    return F.get_json_object(node, "$" + "".join(f"['{k}']" for k in keys))


def named(node: Column) -> Column:
    """A name given as text or as an object with a name."""
    return F.when(F.ltrim(node).startswith("{"), of(node, "name")).otherwise(node)


def with_posting(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds posting: a struct of what the page's JobPosting says (null if it has none): title, body, employer, place, kind, dates, pay as text."""
    node, pay, value = F.col("_node"), F.col("_pay"), F.col("_value")
    df = pages.withColumn("_node", job_posting(F.col(html)))
    df = df.withColumns({"_body": of(node, "description"), "_employer": of(node, "hiringOrganization"), "_address": first_of(of(first_of(of(node, "jobLocation")), "address")), "_pay": of(node, "baseSalary")})
    df = df.withColumns({"_value": of(pay, "value"), "_country": of(F.col("_address"), "addressCountry"), "_city": of(F.col("_address"), "addressLocality"), "_body": F.when(F.ltrim("_body").startswith("{"), of(F.col("_body"), "@value")).otherwise(F.col("_body"))})
    nested = F.ltrim("_value").startswith("{")
    df = df.withColumns({"_low": of(value, "minValue"), "_high": of(value, "maxValue"), "_unit": F.when(nested, of(value, "unitText")), "_single": F.when(nested, of(value, "value")).otherwise(value)})
    band = F.concat(F.coalesce("_low", "_high"), F.lit("-"), F.coalesce("_high", "_low"))
    amount = F.coalesce(band, F.col("_single"))
    employer = F.col("_employer")
    fields = F.struct(
        of(node, "title").alias("title"),
        F.nullif(unescape_if_escaped(F.col("_body")), F.lit("")).alias("description_html"),
        named(employer).alias("company"),
        F.when(F.ltrim(employer).startswith("{"), domain_from_url(F.coalesce(of(employer, "sameAs"), of(employer, "url")))).alias("company_domain"),
        country_code(named(F.col("_country"))).alias("country"),
        F.trim(named(F.col("_city"))).alias("city"),
        first_of(of(node, "employmentType")).alias("employment_type"),
        first_of(of(node, "datePosted")).alias("posted_at"),
        first_of(of(node, "validThrough")).alias("valid_through"),
        F.when(amount.isNotNull(), F.concat_ws(" ", amount, F.coalesce(of(pay, "currency"), of(pay, "salaryCurrency")), F.nullif("_unit", F.lit("")))).alias("salary_text"),
    )
    return df.withColumn("posting", F.when(node.isNotNull(), fields)).select(*pages.columns, "posting")


def filled(postings: DataFrame, least: int = 400) -> DataFrame:
    """Adds body, rung and score to postings (description_text: what the listing gave; html: the page, null if it was not fetched; pasted).

    What a person pasted counts in any case. Else the rungs are tried in order and the first that passes the gate counts; none does: the
    listing's text stays, rung is null.
    """
    data = with_posting(postings)
    rungs = {"api": F.col("description_text"), "jsonld": F.nullif(html_to_text(F.col("posting.description_html")), F.lit("")), "readability": F.nullif(html_to_text(main_block(F.col("html"))), F.lit(""))}
    data = data.withColumns({f"text_{k}": c for k, c in rungs.items()}).withColumns({f"gate_{k}": assess(F.col(f"text_{k}"), least=least) for k in rungs})
    passed = lambda k: F.col(f"gate_{k}.passed")
    pasted = F.nullif(F.trim("pasted"), F.lit(""))
    choice = F.when(pasted.isNotNull(), "manual_paste")
    for k in rungs:
        choice = choice.when(passed(k), k)
    body, score = F.when(pasted.isNotNull(), pasted), F.when(pasted.isNotNull(), assess(pasted, least=least)["score"])
    for k in rungs:
        body, score = body.when(passed(k), F.col(f"text_{k}")), score.when(passed(k), F.col(f"gate_{k}.score"))
    out = data.withColumns({"rung": choice, "body": body.otherwise(F.col("description_text")), "score": score.otherwise(F.col("gate_api.score"))})
    return out.drop("posting", *(f"text_{k}" for k in rungs), *(f"gate_{k}" for k in rungs))
