"""The rolling ledger of shortlisted postings: a table of text columns, upserted by job_id and updated at points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postflow.operators.storage import saved

COLUMNS = ("job_id", "fit", "title", "company", "location", "work_model", "employment_type", "salary", "url", "source", "applied", "cv_status", "first_seen", "last_seen")
#: Columns that an export refreshes; the others of a row that is there belong to the reader.
REFRESHED = ("fit", "title", "company", "location", "work_model", "employment_type", "salary", "url", "source", "last_seen")


def fresh_rows(cards: DataFrame, today: str) -> DataFrame:
    """Cards (job_id, score, title, company, location, work_model, employment_type, salary, url, source) as new rows; what is missing is blank."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    fit = F.coalesce(F.format_string("%.2f", F.col("score").cast("double")), F.lit(""))
    fit = F.when(F.col("score").isNotNull(), fit).otherwise("").alias("fit")
    own = [text(c) for c in ("title", "company", "location", "work_model", "employment_type", "salary", "url", "source")]
    return cards.select(F.col("job_id").cast("string").alias("job_id"), fit, *own, F.lit("FALSE").alias("applied"), F.lit("").alias("cv_status"), F.lit(today).alias("first_seen"), F.lit(today).alias("last_seen"))


def upserted(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Existing rows refreshed by fresh ones of the same job, the reader's columns kept, and new rows. Rows without a job_id are dropped."""
    old, new = existing.where("job_id <> ''").alias("o"), fresh.alias("n")
    pick = lambda c: (F.coalesce(f"n.{c}", f"o.{c}") if c in REFRESHED else F.coalesce(f"o.{c}", f"n.{c}")).alias(c)
    return old.join(new, F.col("o.job_id") == F.col("n.job_id"), "full").select(*map(pick, COLUMNS))


def order() -> list[Column]:
    """Unapplied first, then by fit, then by the newest number."""
    return [F.col("applied") == "TRUE", F.desc(F.coalesce(F.col("fit").try_cast("double"), F.lit(0.0))), F.desc(F.coalesce(F.col("job_id").try_cast("bigint"), F.lit(0)))]


def replace(rows: DataFrame, folder: str) -> None:
    """Writes the ledger in its order. The rows are saved first, as they are usually made of what is replaced; Spark's committer swaps the files in at the end."""
    saved(rows).orderBy(*order()).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(folder)


def read(spark, folder: str) -> DataFrame:
    return spark.read.schema(", ".join(f"{c} string" for c in COLUMNS)).option("header", True).option("nullValue", "\0").csv(folder).fillna("")


def marked(rows: DataFrame, job_ids: DataFrame, applied: bool = True, cv_status: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows with the given jobs (job_id as text) marked as applied or not, and the jobs that are not there."""
    hit = job_ids.select("job_id").distinct().withColumn("hit", F.lit(True))
    both = rows.join(hit, "job_id", "left")
    changed = {"applied": F.when(F.col("hit"), "TRUE" if applied else "FALSE").otherwise(F.col("applied"))}
    if cv_status is not None:
        changed["cv_status"] = F.when(F.col("hit"), cv_status).otherwise(F.col("cv_status"))
    return both.withColumns(changed).select(*COLUMNS), hit.select("job_id").join(rows.select("job_id"), "job_id", "left_anti")
