"""Work authorisation over the documents: each is given a sentence by its id, so that the patterns have something to find."""

from __future__ import annotations

from pyspark.sql import functions as F

from postflow.functions import authorization as A
from postflow.functions.places import bound
from postflow.operators import rules as R
from postflow.queries.registry import Family
from postflow.sources.bindings import pick, table

family = Family()
QUERIES, ORACLE, add = family.QUERIES, family.ORACLE, family.add

#: Sentences given to documents, and what they mean. Fixed values of the bindings.
SENTENCES = (
    "You must be authorized to work in the United States.",
    "A valid work permit for Germany, please.",
    "US work authorization required.",
    "Open to British citizens only.",
    "No visa sponsorship.",
    "Visa sponsorship is available.",
    "Relocation and visa support, but we cannot sponsor.",
    "Nothing to say.",
)
CODES = ("US", "DE", "US", "GB", "", "", "", "")
SPONSORED = (None, None, None, None, "refused", "offered", None, None)


def told(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.concat_ws("\n", pick(F.col("doc_id"), SENTENCES), "text").alias("text"))


def listed(values) -> str:
    return "[" + ",".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@add("x01_required_codes", f"SELECT doc_id, {listed(CODES)}[doc_id % 8 + 1] AS codes FROM documents")
def x01(spark, d):
    return told(spark, d).select("doc_id", F.array_join(A.required_codes(F.col("text")), ",").alias("codes"))


PLACES = ("this role is us", "the netherlands", "it", "the nordics", "our country", "green card")


@add("x02_place_codes", "SELECT doc_id, ['US','NL','','SE,NO,DK,FI,IS','','US'][doc_id % 6 + 1] AS codes FROM documents")
def x02(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(A.codes_for(pick(F.col("doc_id"), PLACES)), ",").alias("codes"))


@add("x03_sponsorship", f"SELECT doc_id, {listed(SPONSORED)}[doc_id % 8 + 1] AS sponsorship FROM documents")
def x03(spark, d):
    return told(spark, d).select("doc_id", A.sponsorship(F.col("text")).alias("sponsorship"))


def facts(spark, d):
    df = told(spark, d)
    stored = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("FR"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("facts", bound(A.stated(F.col("text")), lambda said: A.merged([stored, said["required"]], [F.when(F.col("doc_id") % 16 == 4, "offered"), said["sponsorship"]])))


MERGED_SQL = f"m AS (SELECT doc_id, lang, list_sort(list_concat(CASE WHEN doc_id % 3 = 0 THEN ['FR'] ELSE [] END, CASE WHEN {listed(CODES)}[doc_id % 8 + 1] = '' THEN [] ELSE [{listed(CODES)}[doc_id % 8 + 1]] END)) AS required, CASE WHEN doc_id % 16 = 4 THEN 'offered' ELSE {listed(SPONSORED)}[doc_id % 8 + 1] END AS sponsorship FROM documents)"


@add("x04_merged_facts", f"+ {MERGED_SQL} SELECT doc_id, array_to_string(required, ',') AS required, sponsorship FROM m")
def x04(spark, d):
    return facts(spark, d).select("doc_id", F.array_join("facts.required", ",").alias("required"), "facts.sponsorship")


@add(
    "x05_decision",
    f"+ {MERGED_SQL} SELECT doc_id, CASE WHEN sponsorship = 'offered' THEN NULL WHEN len(required) > 0 AND NOT list_has_any(required, ['DE', 'FR']) THEN 'auth_required' WHEN len(required) = 0 AND sponsorship = 'refused' AND upper(lang) NOT IN ('DE', 'FR') THEN 'no_sponsorship' END AS reason FROM m",
)
def x05(spark, d):
    reason = A.decision(F.col("facts.required"), F.col("facts.sponsorship"), F.upper("lang"), ("DE", "FR"), True)
    return facts(spark, d).select("doc_id", reason.alias("reason"))


GATE_PLACES = ("United States", "the Nordics", "it", None)
GATE_SPONSORED = ("Offered", "refused ", "maybe", None)
VERDICT_SQL = f"{listed(('US', 'DK,FI,IS,NO,SE', '', ''))}[doc_id % 4 + 1]"


@add("x06_verdict_facts", f"SELECT doc_id, CASE WHEN doc_id % 4 = 3 AND doc_id // 4 % 4 = 3 THEN NULL ELSE {VERDICT_SQL} END AS required, CASE doc_id // 4 % 4 WHEN 0 THEN 'offered' WHEN 1 THEN 'refused' END AS sponsorship FROM documents")
def x06(spark, d):
    """A reader's verdict comes as JSON: a list of places and a word on sponsorship; either may be missing, and what is no place is no fact."""
    key = F.col("doc_id")
    place, word = pick(key, GATE_PLACES), pick(F.floor(key / 4), GATE_SPONSORED)
    sent = F.to_json(F.struct(F.when(place.isNotNull(), F.array(place)).alias("work_authorization_required"), word.alias("visa_sponsorship")))
    read = F.from_json(sent, "work_authorization_required array<string>, visa_sponsorship string")
    df = table(spark, d, "documents").select("doc_id", read.alias("v"))
    facts_ = A.from_verdict(F.col("v.work_authorization_required"), F.col("v.visa_sponsorship"))
    return df.select("doc_id", facts_.alias("f")).select("doc_id", F.array_join("f.required", ",").alias("required"), "f.sponsorship")


@add(
    "x07_relevant_lines",
    f"""+ t AS (SELECT doc_id, text || ' Last line. ' || {listed(SENTENCES)}[doc_id % 8 + 1] || chr(10) || 'Visa again: ' || repeat('x', CAST(doc_id % 90 AS INTEGER)) AS text FROM documents),
    s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text[201:], '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+'), lambda x: trim(x)), lambda x: regexp_matches(x, '{A.MENTIONS}')) AS told FROM t),
    n AS (SELECT doc_id, told, i, told[i] AS line, list_sum(list_transform(told[1:i], lambda x: length(x))) AS upto FROM (SELECT *, unnest(range(1, len(told) + 1)) AS i FROM s)),
    k AS (SELECT doc_id, string_agg(line, ' ' ORDER BY i) AS lines FROM n WHERE upto <= 120 GROUP BY 1) SELECT doc_id, coalesce(lines, '') AS lines FROM documents LEFT JOIN k USING (doc_id)""",
)
def x07(spark, d):
    """Each document ends in a sentence of the bindings and one more."""
    key = F.col("doc_id")
    text = F.concat("text", F.lit(" Last line. "), pick(key, SENTENCES), F.lit("\nVisa again: "), F.repeat(F.lit("x"), (key % 90).cast("int")))
    return table(spark, d, "documents").select("doc_id", A.relevant_sentences(text, 200, 120).alias("lines"))


@add(
    "r11_authorization",
    f"+ {MERGED_SQL} SELECT doc_id, CASE WHEN sponsorship = 'offered' THEN '' WHEN len(required) > 0 AND NOT list_has_any(required, ['DE', 'FR']) THEN 'auth_required' WHEN len(required) = 0 AND sponsorship = 'refused' AND upper(lang) NOT IN ('DE', 'FR') THEN 'no_sponsorship' ELSE '' END AS codes FROM m",
)
def r11(spark, d):
    """Stage-one rule: what a reader stored and what the text says, merged, then decided for the candidate of the rules."""
    rules = R.Rules(authorized=("DE", "FR"), needs_sponsorship=True)
    stored = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("FR"))).otherwise(F.array().cast("array<string>"))
    df = told(spark, d).withColumn("stored", F.struct(stored.alias("required"), F.when(F.col("doc_id") % 16 == 4, "offered").alias("sponsorship")))
    df = R.judged(df, R.authorization(F.col("text"), F.upper("lang"), rules, F.col("stored")))
    return df.select("doc_id", F.array_join("verdict.codes", ",").alias("codes"))
