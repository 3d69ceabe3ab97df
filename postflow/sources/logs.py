"""Raw envelopes and the event log as Spark data sources, for batch reads and for streams.

`envelopes`: JSON lines (packed or not) in a folder for each source and run (source=.../run_key=...). Filters on these two columns choose folders before
any file is opened, and each file is a partition. As a stream, its offset is the last run taken: run keys rise with time, and a run is
listed once it is whole.

`eventlog`: Parquet segments (segment=...) of events with rising `seq`. As a stream, its offset is the last seq taken: a reader that stops
resumes behind it. The log answers for its newest `cap` events only: who asks for older ones gets the whole tail that is left.

Folders are reached through Arrow's file systems, so that they may lie on any shared store that Arrow knows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from postflow.sources.adapters import ENVELOPE

PUSH = "spark.sql.python.filterPushdown.enabled"
ROWS = 1000  # envelopes of a batch; a payload may be large
PLACED = ("source", "run_key")  # the columns that folders stand for


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def folders(store: fs.FileSystem, at: str, name: str) -> dict[str, str]:
    """The folders `name=value` at a place, by value."""
    found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return {unquote(f.base_name.split("=", 1)[1]): f.path for f in found if f.type == fs.FileType.Directory and f.base_name.startswith(f"{name}=")}


def files(store: fs.FileSystem, at: str, suffix: str | tuple[str, ...]) -> list[str]:
    return sorted(f.path for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))


class EnvelopeFile(InputPartition):
    def __init__(self, path: str, source: str, run_key: str):
        self.path, self.source, self.run_key = path, source, run_key


class EnvelopeFolder:
    """What batch and stream readers share. Files are read whole; a broken line is no envelope."""

    def __init__(self, path: str, schema: StructType, only: str | None):
        self.path, self.schema = path, schema
        self.wanted: dict[str, set] = {"source": {only}} if only else {}

    def _runs(self) -> list[tuple[str, str, str]]:
        """(source, run, folder) of what is wanted."""
        store, at = opened(self.path)
        keep = lambda column, value: column not in self.wanted or value in self.wanted[column]
        return [(s, r, folder) for s, under in folders(store, at, "source").items() if keep("source", s) for r, folder in folders(store, under, "run_key").items() if keep("run_key", r)]

    def _files(self, runs: list[tuple[str, str, str]]) -> Sequence[InputPartition]:
        store, _ = opened(self.path)
        return [EnvelopeFile(path, s, r) for s, r, folder in runs for path in files(store, folder, (".json", ".json.gz"))]

    def read(self, partition: EnvelopeFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing was found
            return
        store, _ = opened(self.path)
        schema, held = to_arrow_schema(self.schema), []
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}

        def typed(name: str, value):
            ok = {"bigint": isinstance(value, int) and not isinstance(value, bool), "boolean": isinstance(value, bool)}.get(kinds[name], isinstance(value, str))
            return value if ok else json.dumps(value) if kinds[name] == "string" and value is not None else None

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, schema=schema)

        with store.open_input_stream(partition.path) as stream:
            for line in _lines(stream):
                try:
                    found = json.loads(line)
                except ValueError:
                    continue
                if isinstance(found, dict):
                    row = {c: typed(c, found.get(c)) for c in kinds}
                    held.append(row | {"source": partition.source, "run_key": partition.run_key})
                if len(held) == ROWS:
                    yield batch()
                    held = []
        if held:
            yield batch()


class EnvelopeReader(EnvelopeFolder, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and membership of source and run; all others stay with Spark."""
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if column in PLACED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        return self._files(self._runs())


class EnvelopeStreamReader(EnvelopeFolder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"run_key": ""}

    def latestOffset(self) -> dict:
        return {"run_key": max((r for _, r, _ in self._runs()), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self._files([x for x in self._runs() if start["run_key"] < x[1] <= end["run_key"]])


def _lines(stream: pa.NativeFile) -> Iterator[bytes]:
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from whole
    if rest:
        yield rest


class Envelopes(DataSource):
    """Options: path, and for a stream the one source to read (all if it is not given)."""

    @classmethod
    def name(cls) -> str:
        return "envelopes"

    def schema(self) -> str:
        return ENVELOPE

    def reader(self, schema: StructType) -> EnvelopeReader:
        return EnvelopeReader(self.options["path"], schema, self.options.get("source"))

    def streamReader(self, schema: StructType) -> EnvelopeStreamReader:
        return EnvelopeStreamReader(self.options["path"], schema, self.options.get("source"))


class Segment(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class EventSegments:
    def __init__(self, path: str, cap: int, since: int, schema: StructType):
        self.path, self.cap, self.since, self.schema = path, cap, since, schema

    def _segments(self) -> list[tuple[int, str]]:
        store, at = opened(self.path)
        return sorted((int(k), p) for k, p in folders(store, at, "segment").items())

    def newest(self) -> int:
        """The largest seq, from the footers of the last segment alone."""
        store, _ = opened(self.path)
        for _, folder in reversed(self._segments()):
            tops = [self._top(pq.ParquetFile(path, filesystem=store).metadata) for path in files(store, folder, ".parquet")]
            if any(t is not None for t in tops):
                return max(t for t in tops if t is not None)
        return self.since

    @staticmethod
    def _top(footer: pq.FileMetaData) -> int | None:
        at = footer.schema.names.index("seq")
        return max((footer.row_group(i).column(at).statistics.max for i in range(footer.num_row_groups)), default=None)

    def between(self, after: int, upto: int) -> Sequence[InputPartition]:
        """The files with events after one seq and up to another, of those that the log still answers for."""
        after = max(after, upto - self.cap)
        store, _ = opened(self.path)
        segments = self._segments()
        held = [p for (k, p), (after_it, _) in zip(segments, [*segments[1:], (None, "")], strict=True) if k <= upto and (after_it is None or after_it > after)]
        return [Segment(path, after, upto) for folder in held for path in files(store, folder, ".parquet")]

    def read(self, partition: Segment | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        store, _ = opened(self.path)
        seq = ds.field("seq")
        table = ds.dataset(partition.path, filesystem=store, format="parquet").to_table(columns=self.schema.names, filter=(seq > partition.after) & (seq <= partition.upto))
        yield from table.cast(to_arrow_schema(self.schema)).to_batches()


class EventLogReader(EventSegments, DataSourceReader):
    def partitions(self) -> Sequence[InputPartition]:
        return self.between(self.since, self.newest())


class EventLogStreamReader(EventSegments, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"seq": self.since}

    def latestOffset(self) -> dict:
        return {"seq": self.newest()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.between(start["seq"], end["seq"])


class EventLog(DataSource):
    """Options: path, cap (500: how many of the newest events are answered for), since (0: where a new reader begins). Events need a column seq."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> StructType:
        raise NotImplementedError("give the log's schema")

    def _settings(self, schema: StructType) -> tuple[str, int, int, StructType]:
        return self.options["path"], int(self.options.get("cap", "500")), int(self.options.get("since", "0")), schema

    def reader(self, schema: StructType) -> EventLogReader:
        return EventLogReader(*self._settings(schema))

    def streamReader(self, schema: StructType) -> EventLogStreamReader:
        return EventLogStreamReader(*self._settings(schema))


def append_events(df: DataFrame, folder: str, each: int = 10_000) -> None:
    """Appends events to a log in segments that begin at a multiple of `each`."""
    first = (F.floor((F.col("seq") - 1) / each) * each + 1).cast("bigint")
    df.withColumn("segment", first).write.mode("append").partitionBy("segment").parquet(folder)


def registered(spark: SparkSession) -> SparkSession:
    spark.conf.set(PUSH, "true")
    spark.dataSource.register(Envelopes)
    spark.dataSource.register(EventLog)
    return spark


def envelopes_at(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    df = registered(spark).read.format("envelopes").load(folder)
    return df if where is None else df.where(where)


def envelope_stream(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    reader = registered(spark).readStream.format("envelopes")
    return (reader.option("source", source) if source else reader).load(folder)


def event_stream(spark: SparkSession, folder: str, schema: StructType | str, cap: int = 500, since: int = 0) -> DataFrame:
    return registered(spark).readStream.format("eventlog").schema(schema).option("cap", cap).option("since", since).load(folder)
