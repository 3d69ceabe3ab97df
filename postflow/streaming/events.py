"""Structured Streaming over the event log and over runs of listings: budgets, caps, sessions, duplicates, counters, queues and replays.

The tables are single files, so a stream of them would be one batch. `arrivals` cuts a table into the parts in which it would have
arrived, in order of time; `drained` lays one part down after the other and lets the stream take it, always from the same checkpoint: a
part is a batch, state goes from batch to batch and is dropped once the watermark has passed it. Two empty closing parts move the
watermark past the end, so that everything still open is given out. Results are written to the shared checkpoint folder, a folder for
each batch (a replayed batch overwrites its own), and the query gives that table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from postflow.operators.storage import scratch, shared_folder
from postflow.sources.envelopes import write_envelopes
from postflow.sources.logs import append_events, event_stream
from postflow.streaming.states import SIGHTING, Breakers, absences, keyed_state, processed
from postflow.streaming.sync import Sync

PARTS = 4
BUNDLE = 32_768  # sightings, about, whose items' state is one value
END = "end"  # the kind of a closing row


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def arrivals(df: DataFrame, at: str, parts: int = PARTS, closing: DataFrame | None = None) -> list[DataFrame]:
    """A table in parts of rising `at`, and twice the closing rows."""
    place = (F.unix_micros(at) if df.schema[at].dataType.typeName() == "timestamp" else F.col(at)).cast("double")
    low, high = df.agg(F.min(place), F.max(place)).first()
    step = ((high or 0.0) - (low or 0.0)) / parts + 1e-9
    part = F.least(F.floor((place - (low or 0.0)) / step), F.lit(parts - 1))
    return [df.where(part == k) for k in range(parts)] + ([closing, closing] if closing is not None else [])


def event_parts(spark: SparkSession, sf_dir: str, again: bool = False) -> list[DataFrame]:
    """Events as they arrived; `again`: every event comes twice."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    df = df.select("event_id", "ts", "user_id", "event_type")
    end = df.agg((F.max("ts") + F.expr("interval 60 days")).alias("ts")).select(F.lit(-1).cast("bigint").alias("event_id"), "ts", F.lit(-1).cast("bigint").alias("user_id"), F.lit(END).alias("event_type"))
    return arrivals(df.unionAll(df) if again else df, "ts", closing=end)


def drained(parts: list[DataFrame], read: Callable[[DataFrame], DataFrame], keep: str = "true") -> DataFrame:
    """What the stream `read` makes of parts that arrive in turn, with the number of the pass. keep: which rows are results.

    Closing rows must reach the stateful operator (a filter before it would be pushed into the scan); results are freed of them here.
    """
    spark = parts[0].sparkSession
    folder, base, state = (fresh(spark, x) for x in ("arrivals", "stream", "state"))
    schema = None
    for number, part in enumerate(parts, 1):
        part.write.mode("append").parquet(folder)
        found = read(spark.readStream.schema(parts[0].schema).parquet(folder))
        schema = found.schema

        def put(batch: DataFrame, k: int, to: str = f"{base}/pass={number}") -> None:
            batch.where(keep).write.mode("overwrite").parquet(f"{to}/batch={k}")

        found.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{base}/pass=0/batch=-1")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return spark.read.schema(f"{columns}, pass int, batch int").parquet(base).drop("batch")


def late_by(df: DataFrame, delay: str = "1 day") -> DataFrame:
    return df.withWatermark("ts", delay)


def windowed(spark: SparkSession, sf_dir: str, window: Column, key: str) -> DataFrame:
    """(key, start, n) of events; a window is given out once, when the watermark has passed its end."""
    counted = lambda df: late_by(df).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")
    return drained(event_parts(spark, sf_dir), counted, f"cast({key} as string) not in ('-1', '{END}')").drop("pass")


def daily_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user a day."""
    return windowed(spark, sf_dir, F.window("ts", "1 day"), "user_id").withColumnRenamed("start", "day")


def weekly_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each kind in the seven days from each day on."""
    return windowed(spark, sf_dir, F.window("ts", "7 days", "1 day"), "event_type").withColumnRenamed("start", "since")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "6 hours") -> DataFrame:
    """Sessions of each user: they end when nothing happens for the gap."""
    return windowed(spark, sf_dir, F.session_window("ts", gap), "user_id").withColumnRenamed("start", "began")


def seen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though all of them come twice within the watermark."""
    once = lambda df: late_by(df).dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "user_id")
    return drained(event_parts(spark, sf_dir, again=True), once, "event_id >= 0").drop("pass")


def queue_outcomes(spark: SparkSession, sf_dir: str, days: int = 21, asked: str = "signup", accepted: str = "purchase") -> DataFrame:
    """(event_id, released_at): invitations and the first acceptance by the same user within `days`; null once they have expired."""
    within = (F.col("who") == F.col("user_id")) & (F.col("accepted_at") > F.col("invited_at")) & (F.col("accepted_at") <= F.col("invited_at") + F.expr(f"interval {days} days"))

    def answered(df: DataFrame) -> DataFrame:
        of = lambda kind: late_by(df).where(F.col("event_type").isin(kind, END))
        invites = of(asked).select("event_id", F.col("user_id").alias("who"), F.col("ts").alias("invited_at"))
        accepts = of(accepted).select("user_id", F.col("ts").alias("accepted_at"))
        return invites.join(accepts, within, "leftOuter").select("event_id", "accepted_at")

    found = drained(event_parts(spark, sf_dir), answered, "event_id >= 0")
    return found.groupBy("event_id").agg(F.min("accepted_at").alias("released_at"))


def in_runs(seen: DataFrame, parts: int = PARTS, grace: int | None = None, forget: int | None = None) -> DataFrame:
    """What is told of the absences of (key, item, at), whose runs `at` arrive in turn, up to the last run; a closing row lets its timers fire."""
    spark = seen.sparkSession
    with scratch(spark) as tables, keyed_state(spark):
        rows = tables.saved(seen.select("key", "item", F.col("at").cast("bigint").alias("at")))
        n, last = rows.agg(F.count("*"), F.max("at")).first()
        close = spark.range(1 if n else 0).select(F.lit(-1).cast("bigint").alias("key"), F.lit(-1).cast("bigint").alias("item"), F.lit((last or 0) + 1).cast("bigint").alias("at"))
        bundle = F.pmod(F.xxhash64("key", "item"), F.lit(n // BUNDLE + 1)).alias("bundle")
        day = F.timestamp_seconds(F.col("at") * 86_400).alias("ts")
        read = lambda df: absences(df.select(*SIGHTING, bundle, day).withWatermark("ts", "0 seconds"), "bundle", grace, forget)
        return drained(arrivals(rows, "at", parts, close), read, f"key >= 0 AND at <= {last or 0}").drop("pass")


def missed_runs(seen: DataFrame, parts: int = PARTS, forget: int | None = None) -> DataFrame:
    """(key, item, at, missed) from (key, item, at): how many runs an item of a board was missed for each time that it is seen."""
    return in_runs(seen, parts, forget=forget)


def retirements(seen: DataFrame, grace: int = 2, parts: int = PARTS) -> DataFrame:
    """(key, item, at): the runs by which items had been missed `grace` times in a row. Those of the last run come from timers alone."""
    return in_runs(seen, parts, grace).select("key", "item", "at")


def breaker_rows(spark: SparkSession, sf_dir: str, processor: StatefulProcessor) -> DataFrame:
    counted = lambda df: processed(late_by(df, "0 seconds").withColumn("us", F.unix_micros("ts")), ["user_id"], processor)
    with keyed_state(spark):
        return drained(event_parts(spark, sf_dir), counted, "user_id >= 0").drop("pass").withColumn("at", F.timestamp_micros("at"))


def breakers(spark: SparkSession, sf_dir: str, trips_at: int = 3, first: int = 60, longest: int = 3600) -> DataFrame:
    """(event_id, streak, cooldown, tripped) of refusals: the pause doubles with every refusal in a row, and the breaker trips at `trips_at`."""
    found = breaker_rows(spark, sf_dir, Breakers("error", first, longest)).where("kind = 'refused'")
    return found.select("event_id", "streak", "cooldown", (F.col("streak") >= trips_at).alias("tripped"))


def releases(spark: SparkSession, sf_dir: str, first: int = 60, longest: int = 3600) -> DataFrame:
    """(event_id, user_id, released_at): the cooldowns that ended before the user was refused again, by the refusal that set them."""
    return breaker_rows(spark, sf_dir, Breakers("error", first, longest)).where("kind = 'released'").select("event_id", "user_id", F.col("at").alias("released_at"))


def in_passes(df: DataFrame, at: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two passes over a growing table with one checkpoint: the second reads only what came after the first. Adds pass."""
    middle = F.lit((df.agg(F.max(at)).first()[0] or 0) // 2)
    return drained([df.where(F.col(at) <= middle), df.where(F.col(at) > middle)], read)


def resumed(log: DataFrame, early: Column, keep: int = 500) -> DataFrame:
    """What a reader of the event log gets once it resumes: it has read the early events, stopped, and the others have been appended since."""
    spark = log.sparkSession
    folder, out = fresh(spark, "log"), fresh(spark, "read")
    for k, rows in enumerate((log.where(early), log.where(~early))):
        append_events(rows, folder)

        def put(batch: DataFrame, number: int, to: str = f"{out}/pass={k}") -> None:
            batch.write.mode("overwrite").parquet(f"{to}/batch={number}")

        put(spark.createDataFrame([], log.schema), -1)
        stream = event_stream(spark, folder, log.schema, keep).writeStream.option("checkpointLocation", f"{out}-state")
        stream.trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.parquet(f"{out}/pass=1").drop("batch")


ITEMS = "items"  # the source of envelopes whose payload is a list of ids


def listed_items(envelopes: DataFrame) -> DataFrame:
    """Postings of envelopes whose payload is a JSON list of ids."""
    found = envelopes.select("run_key", "source", "token", F.explode(F.from_json("payload", "array<string>")).alias("external_id"))
    return found.withColumns({"title": F.concat_ws("|", "token", "external_id"), "location_raw": F.lit(None).cast("string")})


def synced(runs: DataFrame, grace: int = 2, phases: int = 2, page: int = 1000) -> DataFrame:
    """The stored postings (board, item, first_run, last_run, missed, is_active) after runs (run, board, item, truncated), sent as envelopes in phases.

    Listed postings are stored or seen again; the others of a board that was listed whole miss one more run, and go inactive at `grace`.
    A listing that was cut short, or a board that was not listed at all, retires nothing.
    """
    spark = runs.sparkSession
    folder, store = fresh(spark, "runs"), fresh(spark, "store")
    nth = F.row_number().over(Window.partitionBy("run", "board").orderBy("item")) - 1
    items = F.to_json(F.sort_array(F.collect_list(F.col("item").cast("string"))))
    pages = runs.withColumn("page", F.floor(nth / page)).groupBy("run", "board", "page").agg(items.alias("payload"), F.bool_or("truncated").alias("truncated"))
    none = F.lit(None).cast("string")
    sent = pages.select("run", F.lpad(F.col("run").cast("string"), 12, "0").alias("run_key"), F.lit(ITEMS).alias("source"), F.lit(ITEMS).alias("provider"), F.col("board").cast("string").alias("token"), F.lit("global").alias("market"), none.cast("bigint").alias("board_id"), none.alias("fetched_at"), "payload", "truncated", F.lit(False).alias("refused"))
    sync = Sync(spark, store, listed_items, grace=grace)
    with scratch(spark) as tables:
        sent = tables.saved(sent)
        low, high = sent.agg(F.min("run"), F.max("run")).first()
        for k in range(phases):
            until = F.col("run") * phases < F.lit((low or 0) * phases + ((high or 0) - (low or 0) + 1) * (k + 1))
            since = F.col("run") * phases >= F.lit((low or 0) * phases + ((high or 0) - (low or 0) + 1) * k)
            write_envelopes(sent.where(until & since).drop("run"), folder)
            tables.free(sent) if k == phases - 1 else None
            sync.drain(folder, ITEMS)
    item = F.substring_index("id", "|", -1).cast("bigint")
    return sync.listed().select(F.col("board").cast("bigint").alias("board"), item.alias("item"), F.col("first_run").cast("bigint").alias("first_run"), F.col("last_run").cast("bigint").alias("last_run"), F.col("missed_runs").cast("bigint").alias("missed"), "is_active")
