"""What a new listing does to stored postings, and what scanned links do to boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postflow.functions.text import content_hash

#: Fields that are kept or replaced together, fields kept one by one, and fields that are always replaced.
BODY = ("description_html", "description_text", "description_md", "description_lang", "jd_completeness", "jd_source", "jd_extracted_at", "description_hash")
PAY = ("salary_min", "salary_max", "salary_currency", "salary_period", "salary_is_stated")
POSTER = ("poster_name", "poster_profile_url")
PLAIN = ("title", "location_raw")
HASHED = ("title", "location_raw", "description_text")


def upserted(stored: DataFrame, listed: DataFrame, key: str = "id", first: tuple[str, ...] = (), latest: tuple[str, ...] = ()) -> DataFrame:
    """Stored postings (with content_hash, repost_count, missed_runs, is_active) after a listing, and the outcome: new, updated, unchanged or absent.

    A listing never takes away: a body that is missing, or poorer than a full one that is stored, leaves all eight fields of the body as
    they are; stated pay outlives its absence; poster fields are kept one by one. Whether anything changed is told by a hash over the body
    that survives. A posting that comes back after it went inactive is a repost. Absent postings are left to the missed-run counter.
    Of further fields, `first` stay as first stored, and `latest` take each new value that is known.
    If the stored postings have no content_hash, it is found where it is needed, and not given out.
    """
    hashed = "content_hash" in stored.columns
    both = stored.alias("o").join(listed.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    old, new = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    is_new, absent = old(key).isNull(), new(key).isNull()
    blank = lambda c: F.coalesce(new(c), F.lit("")) == ""
    no_body = blank("description_html") & blank("description_text") & blank("description_md")
    poorer = (old("jd_completeness") == "full") & ~new("jd_completeness").eqNullSafe(F.lit("full"))
    keep_body = ~is_new & (absent | no_body | F.coalesce(poorer, F.lit(False)))
    keep_pay = ~is_new & (absent | (F.coalesce(old("salary_is_stated"), F.lit(False)) & ~F.coalesce(new("salary_is_stated"), F.lit(False))))

    def chosen(keep: Column, fields: tuple[str, ...]) -> list[Column]:
        return [F.when(keep, old(c)).otherwise(new(c)).alias(c) for c in fields]

    poster = [F.coalesce(new(c), old(c)).alias(c) for c in POSTER]
    further = [F.coalesce(old(c), new(c)).alias(c) for c in first] + [F.coalesce(new(c), old(c)).alias(c) for c in latest]
    was_active = F.coalesce(old("is_active"), F.lit(True))
    hashes = [F.when(absent, old("content_hash")).alias("_hash"), old("content_hash").alias("_old_hash")] if hashed else [F.struct(*[old(c) for c in HASHED]).alias("_was")]
    kept = [*hashes, is_new.alias("_new"), absent.alias("_absent"), was_active.alias("_was_active"), F.coalesce(old("repost_count"), F.lit(0)).alias("_reposts"), F.coalesce(old("missed_runs"), F.lit(0)).alias("_missed")]
    rows = both.select(F.coalesce(old(key), new(key)).alias(key), *chosen(absent, PLAIN), *chosen(keep_body, BODY), *chosen(keep_pay, PAY), *poster, *further, *kept)
    now = content_hash(*[F.col(c) for c in HASHED])
    if hashed:
        rows = rows.withColumn("content_hash", F.coalesce("_hash", now))
        same = F.col("content_hash") == F.col("_old_hash")
    else:
        same = F.when(F.struct(*HASHED).eqNullSafe(F.col("_was")), True).otherwise(now == content_hash(*[F.col("_was")[c] for c in HASHED]))
    outcome = F.when(F.col("_new"), "new").when(F.col("_absent"), "absent").when(same, "unchanged").otherwise("updated")
    back = ~F.col("_new") & ~F.col("_absent") & ~F.col("_was_active")
    rows = rows.withColumns({"outcome": outcome, "repost_count": F.col("_reposts") + back.cast("int"), "missed_runs": F.when(F.col("_absent"), F.col("_missed")).otherwise(0), "is_active": F.when(F.col("_absent"), F.col("_was_active")).otherwise(True)})
    return rows.drop("_hash", "_new", "_absent", "_old_hash", "_was", "_was_active", "_reposts", "_missed")


def harvested(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Boards after a scan: (provider, token, company_id, outcome) of every board that was hit.

    hits: provider, token, at (order), company_id (null unless a structured field had the link: a link in a body may be anyone's). A board
    that is not known is new; a known one without a company is linked to that of the first structured hit; else it is only known.
    """
    first = F.min(F.when(F.col("company_id").isNotNull(), F.struct("at", "company_id")))["company_id"]
    found = hits.groupBy("provider", "token").agg(first.alias("told"))
    both = found.join(known.select("provider", "token", F.col("company_id").alias("own"), F.lit(True).alias("there")), ["provider", "token"], "left")
    outcome = F.when(F.col("there").isNull(), "new").when(F.col("own").isNull() & F.col("told").isNotNull(), "linked").otherwise("known")
    return both.select("provider", "token", F.coalesce("own", "told").alias("company_id"), outcome.alias("outcome"))


def last_standing(log: DataFrame, key: str, order: list[str], status: str = "status", undo: str = "undo") -> DataFrame:
    """(key, status): the last action of each key that was not undone. An undo takes back the action right before it."""
    ahead = F.lead(status).over(Window.partitionBy(key).orderBy(*order))
    left = log.withColumn("_next", ahead).where((F.col(status) != undo) & ~F.col("_next").eqNullSafe(F.lit(undo)))
    return left.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias(status))
