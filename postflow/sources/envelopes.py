"""Raw envelopes, seed lists, answers of readers and snapshots: what is read and kept around the postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postflow.functions.urls import board_hits
from postflow.sources.adapters import ENVELOPE, LIST


def write_envelopes(envelopes: DataFrame, folder: str) -> None:
    """Appends envelopes as JSON lines, a folder for each source and run, so that a replay reads only its own."""
    envelopes.write.mode("append").option("compression", "gzip").partitionBy("source", "run_key").json(folder)


def scan_envelopes(spark: SparkSession, folder: str, source: str, run_key: str) -> DataFrame:
    """The envelopes of one source and run, payloads as they came. A broken line is dropped; a run that was never fetched gives none."""
    rows = spark.read.schema(ENVELOPE).option("mode", "DROPMALFORMED").json(folder)
    return rows.where((F.col("source") == source) & (F.col("run_key") == run_key))


def is_truncated(truncated: Column, source: Column, payload: Column, legacy: tuple[str, ...] = ("linkedin",)) -> Column:
    """Whether a listing came cut short: the envelope says so; older envelopes of some sources said it inside the payload."""
    inside = F.get_json_object(payload, "$.truncated") == "true"
    return F.coalesce(truncated, F.when(source.isin(*legacy), inside), F.lit(False))


def crawl_hits(lines: DataFrame, platforms) -> DataFrame:
    """(provider, token, records): boards that the URLs of an index (JSON lines) name, and by how many records. A broken line is skipped."""
    urls = lines.select(F.get_json_object("value", "$.url").alias("url")).where("url is not null")
    hits = urls.select(F.explode(board_hits(F.col("url"), platforms)).alias("hit"))
    return hits.groupBy("hit.provider", "hit.token").agg(F.count("*").alias("records"))


def guessed_boards(companies: DataFrame, known: DataFrame, providers: tuple[str, ...]) -> DataFrame:
    """Candidate boards (provider, token, company_id) of companies (company_id, token), one for each provider, without known ones. Of equal tokens the smallest company counts."""
    own = companies.where("token is not null").groupBy("token").agg(F.min("company_id").alias("company_id"))
    spread = own.select("token", "company_id", F.explode(F.array(*map(F.lit, providers))).alias("provider"))
    return spread.join(known.select("provider", "token").distinct(), ["provider", "token"], "left_anti")


def seeded(seeds: DataFrame, boards: DataFrame, market: str, via: str) -> DataFrame:
    """Boards after a seed list (provider, token) is registered: new, known (already so filed), moved (filed elsewhere), or untouched. Registering twice changes nothing."""
    listed = seeds.select("provider", "token").distinct().withColumn("listed", F.lit(True))
    both = boards.select("provider", "token", "market", "via").withColumn("there", F.lit(True)).join(listed, ["provider", "token"], "full")
    same = (F.col("market") == market) & (F.col("via") == via)
    outcome = F.when(F.col("listed").isNull(), "untouched").when(F.col("there").isNull(), "new").when(same, "known").otherwise("moved")
    filed = lambda c, v: F.when(F.col("listed"), F.lit(v)).otherwise(F.col(c)).alias(c)
    return both.select("provider", "token", filed("market", market), filed("via", via), outcome.alias("outcome"))


def search_refs(titles: DataFrame, locations: tuple[str, ...]) -> DataFrame:
    """A search for each title and location ("title|location"); without locations one that names none."""
    return titles.select(F.explode(F.array(*[F.concat_ws("|", "title", F.lit(p)) for p in locations or ("",)])).alias("token")).distinct()


def read_through(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(source, job_id, html, origin): pages that were fetched before, and misses."""
    return wanted.join(cache.select("source", "job_id", "html"), ["source", "job_id"], "left").withColumn("origin", F.when(F.col("html").isNotNull(), "cache").otherwise("miss"))


VERDICT_LISTS = ("verdicts", "results", "jobs", "scores")


def listed(v: Column, path: str = "$") -> Column:
    """The array at a path of a variant; null if there is none."""
    return F.try_variant_get(v, path, "array<variant>")


def objects(items: Column) -> Column:
    """The objects among an array of variants, as JSON."""
    return F.transform(F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))), lambda x: F.to_json(x))


def verdict_items(answers: DataFrame, answer: str) -> DataFrame:
    """The verdicts (a column `item` of texts) in answers: a bare array, an array under one of four names, or batches of these. Each answer is parsed once."""
    none = F.array().cast("array<variant>")
    named = lambda v: F.coalesce(listed(v), *[listed(v, f"$.{k}") for k in VERDICT_LISTS])
    v = F.col("parsed")
    batches = F.flatten(F.transform(F.coalesce(listed(v, "$.batches"), none), lambda b: F.coalesce(named(b), none)))
    return answers.select(F.try_parse_json(answer).alias("parsed")).select(F.explode(objects(F.coalesce(named(v), batches))).alias("item"))


def printed_items(outputs: DataFrame, output: str) -> DataFrame:
    """The objects (a column `item` of texts) of the array that a program printed: bare, as the result of an envelope, or amid prose; nothing if there is none that parses."""
    told = outputs.select(F.col(output).alias("whole"), F.try_parse_json(output).alias("parsed"))
    result = F.coalesce(F.try_variant_get("parsed", "$.result", "string"), "whole")
    told = told.select(F.coalesce(listed(F.col("parsed")), listed(F.col("parsed"), "$.result")).alias("found"), F.trim(result).alias("text"))
    amid = F.nullif(F.regexp_extract("text", r"(?s)\[.*\]", 0), F.lit(""))
    return told.select(F.coalesce("found", listed(F.try_parse_json(amid))).alias("found")).select(F.explode(objects(F.col("found"))).alias("item"))


VERDICT = "job_id string, score string, reasoning string, red_flags array<string>, work_authorization_required array<string>, visa_sponsorship string"


def valid_verdicts(items: DataFrame) -> DataFrame:
    """Verdicts of items (a column `item` of texts) that name a job by number and score it between 0 and 1."""
    v = items.select(F.from_json("item", VERDICT).alias("v")).select("v.*")
    v = v.withColumns({"job_id": F.col("job_id").try_cast("bigint"), "score": F.col("score").try_cast("double"), "reasoning": F.trim(F.coalesce("reasoning", F.lit("")))})
    return v.where("job_id is not null and score between 0 and 1")


def newest(snapshots: DataFrame, keep: int = 5) -> DataFrame:
    """The newest runs (run_id, payload): what a history keeps."""
    return snapshots.orderBy(F.desc("run_id")).limit(keep)


def rates_in_use(snapshots: DataFrame, now: Column, max_age_hours: float = 24.0) -> DataFrame:
    """(currency, rate, source): the newest snapshot of exchange rates (fetched_at, payload, live) that may be used.

    A cached one that is fresh counts; else the newest live one; else the newest cached one, however old. A payload that does not parse is no snapshot.
    """
    rates = snapshots.withColumn("rates", F.from_json("payload", "rates map<string, double>")["rates"]).where("rates is not null")
    age = (F.unix_timestamp(now) - F.unix_timestamp("fetched_at")) / 3600
    rank = F.when(~F.col("live") & (age <= max_age_hours), 0).when(F.col("live"), 1).otherwise(2)
    best = rates.agg(F.min(F.struct(rank.alias("rank"), (-F.unix_timestamp("fetched_at")).alias("age"), F.when(F.col("live"), "live").otherwise("cache").alias("source"), F.to_json("rates").alias("rates"))).alias("b"))
    return best.select("b.source", F.explode(F.from_json("b.rates", "map<string, double>")).alias("currency", "rate"))
