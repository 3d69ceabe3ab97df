"""Companies of records that come in order: found by domain, else by normalised name, else created; what one record creates, later ones find.

A walk would look at one record after the other. Here, rounds settle all records at once whose answer no open record can change:

* A record whose domain has a company has its answer. So has one without domain whose name has a company.
* A record whose domain has none, and whose name's company has another domain, changes nothing. It takes that company, unless an earlier
  record of its domain may still give the domain a company.
* Of all others, the earliest of its domain that is the earliest of its name too settles: it creates a company, or gives its domain to
  its name's company, which had none.

Every round settles the earliest open record at least; a domain or name that any number of records share takes a few rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postflow.operators.storage import saved


def resolved(records: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(at, company, created) for records (at, domain, name). at: their order, unique; name: normalised; blank domains and names are none.

    known: companies (company, domain, name) that are there already, in order of their ids. New companies have the number of the record
    that created them, negated and less one, so that they never meet known ones.
    """
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit("")).alias(c)
    open_ = saved(records.select(F.col("at").cast("bigint").alias("at"), blank("domain"), blank("name")))
    there = (open_.select(F.col("at").alias("company"), "domain", "name").limit(0) if known is None else known).select(F.col("company").cast("bigint").alias("company"), blank("domain"), blank("name"))
    domains = saved(there.where("domain is not null").groupBy("domain").agg(F.min("company").alias("by_domain")))
    names = saved(there.where("name is not null").groupBy("name").agg(F.min_by("company", "company").alias("by_name"), F.min_by(F.col("domain").isNotNull(), "company").alias("has_domain")))
    told = []
    while not open_.isEmpty():
        seen = open_.join(domains, "domain", "left").join(names, "name", "left")
        sure = F.when(F.col("by_domain").isNotNull(), F.col("by_domain")).when(F.col("domain").isNull(), F.col("by_name"))
        seen = saved(seen.withColumn("sure", sure).withColumn("inert", F.col("domain").isNotNull() & F.coalesce("has_domain", F.lit(False))))
        rest = seen.where("sure is null")
        active = rest.where("not inert")
        first = lambda key: active.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("at").alias(f"first_{key}"))
        placed = saved(rest.join(first("domain"), "domain", "left").join(first("name"), "name", "left"))
        own = lambda key: F.coalesce(F.col(f"first_{key}") == F.col("at"), F.lit(True))
        decides = placed.where(~F.col("inert") & own("domain") & own("name")).withColumn("made", F.col("by_name").isNull())
        decided = saved(decides.select("at", "domain", "name", F.when(F.col("made"), -F.col("at") - 1).otherwise(F.col("by_name")).alias("company"), F.col("made").alias("created")))
        passed = placed.where("inert and (first_domain is null or at < first_domain)")
        now = [seen.where("sure is not null").select("at", F.col("sure").alias("company"), F.lit(False).alias("created")), passed.select("at", F.col("by_name").alias("company"), F.lit(False).alias("created")), decided.select("at", "company", "created")]
        settled = saved(reduce(DataFrame.unionByName, now))
        told.append(settled)
        domains = saved(domains.unionByName(decided.where("domain is not null").select("domain", F.col("company").alias("by_domain"))))
        new = decided.where("name is not null").select("name", F.col("company").alias("new"), F.col("domain").isNotNull().alias("new_domain"))
        names = saved(names.join(new, "name", "full").select("name", F.coalesce("by_name", "new").alias("by_name"), (F.coalesce("has_domain", F.lit(False)) | F.coalesce("new_domain", F.lit(False))).alias("has_domain")))
        open_ = saved(open_.join(settled.select("at"), "at", "left_anti"))
    return reduce(DataFrame.unionByName, told) if told else open_.select("at", F.col("at").alias("company"), F.lit(False).alias("created"))
