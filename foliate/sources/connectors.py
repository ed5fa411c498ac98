"""Python Data Sources: vendor files as a catalog, and a sink that writes a file per report or a log per task.

Call `register(spark)` once per session.  Both take folders that every node can open under
the same path (a mounted share); tables in other stores are read and written by Spark's own
formats.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from foliate.sources.catalogs import CANDIDATE


def local_path(path: str) -> str:
    """The folder behind a file: address or a plain path."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"not a mounted folder: {path}")
    return unquote(parts.path) if parts.scheme else path


@dataclass
class Piece(InputPartition):
    """Bytes of a file: lines that begin in them."""

    path: str
    start: int
    end: int


class VendorCatalog(DataSource):
    """Format "vendor_catalog": folders of JSON lines as rows of CANDIDATE under a provider's name, and reason.

    Options: path; provider; columns, JSON that names the vendor's field for each column;
    split_bytes.  Files are read in byte ranges, one partition each.  Equality, lists,
    prefixes and substrings of text columns are pushed down and tested before rows leave the
    reader.  Values that do not cast are missing (blank text, year 0); lines that are no
    JSON object are skipped.  reason is "no identity" without series and number, "no id"
    without ids, else "".
    """

    @classmethod
    def name(cls) -> str:
        return "vendor_catalog"

    def schema(self) -> str:
        return ", ".join(["provider string", *[f"{c} {k}" for c, k in CANDIDATE.items()], "reason string"])

    def reader(self, schema: StructType) -> VendorReader:
        return VendorReader(dict(self.options))


class VendorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = local_path(options["path"])
        self.provider = options.get("provider", "Vendor")
        self.columns = json.loads(options.get("columns", "{}"))
        self.split_bytes = int(options.get("split_bytes", 64 << 20))
        self.tests: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        text = {"provider", "reason", *[c for c, k in CANDIDATE.items() if k == "string"]}
        for f in filters:
            if isinstance(f, (EqualTo, In, StringContains, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in text:
                self.tests.append(f)
            elif not isinstance(f, IsNotNull):  # no column of ours is null
                yield f

    def partitions(self) -> list[Piece]:
        out = []
        for folder, _, files in sorted(os.walk(self.folder)):
            for name in sorted(files):
                if not name.startswith((".", "_")):
                    path = os.path.join(folder, name)
                    size = os.path.getsize(path)
                    out += [Piece(path, at, min(at + self.split_bytes, size)) for at in range(0, size, self.split_bytes)]
        return out or [Piece("", 0, 0)]

    def _row(self, line: bytes) -> tuple | None:
        try:
            given = json.loads(line)
        except ValueError:
            return None
        if not isinstance(given, dict):
            return None
        row = [self.provider]
        for c, kind in CANDIDATE.items():
            v = given.get(self.columns.get(c))
            if kind == "int":
                row.append(int(str(v).strip()) if re.fullmatch(r"\s*[+-]?[0-9]{1,9}\s*", str(v)) else 0)
            else:
                row.append("" if v is None else str(v))
        r = dict(zip(["provider", *CANDIDATE], row, strict=True))
        reason = "no identity" if not r["series_name"] and not r["issue_number"] else "no id" if not r["issue_id"] and not r["series_id"] else ""
        return (*row, reason)

    def _kept(self, row: tuple) -> bool:
        r = dict(zip(["provider", *CANDIDATE, "reason"], row, strict=True))
        for f in self.tests:
            v = r[f.attribute[0]]
            if isinstance(f, EqualTo):
                ok = v == f.value
            elif isinstance(f, In):
                ok = v in f.value
            else:
                ok = f.value in v if isinstance(f, StringContains) else v.startswith(f.value)
            if not ok:
                return False
        return True

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        names = ["provider", *CANDIDATE, "reason"]
        kinds = [pa.string(), *[pa.int32() if k == "int" else pa.string() for k in CANDIDATE.values()], pa.string()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        if not partition.path:
            return
        rows: list[tuple] = []
        with open(partition.path, "rb") as f:
            f.seek(max(0, partition.start - 1))
            if partition.start:
                f.readline()  # the line that begins before belongs to the piece before
            while f.tell() < partition.end and (line := f.readline()):
                if (row := self._row(line)) and self._kept(row):
                    rows.append(row)
                if len(rows) >= 10_000:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    names: list[str]


class TextFiles(DataSource):
    """Format "text_files": rows (name, content) as one file each; without names, a task's contents as lines of one log.

    Options: path; layout "files" (default) or "log".  Tasks write to a hidden folder of the
    job; the commit moves their files into place, and a job or task that fails leaves none.
    Names must be unique within a job (`unique_names`); files of earlier jobs are replaced.
    It reads a folder's files back in `parts` tasks (option, default 8), each the files whose
    names' remainders are its own: nothing lists them all, and no file costs a task's share.
    """

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> TextWriter:
        return TextWriter(dict(self.options), [f.name for f in schema.fields])

    def reader(self, schema: StructType) -> DataSourceReader:
        return TextReader(dict(self.options))


class TextReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.parts = local_path(options["path"]), int(options.get("parts", 8))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.parts)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        contents: list[str] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(contents, pa.string())], ["name", "content"])

        with os.scandir(self.folder) as found:
            for e in found:
                if e.name.startswith(".") or zlib.crc32(os.fsencode(e.name)) % self.parts != partition.value or not e.is_file():
                    continue
                with open(e.path, encoding="utf-8", newline="") as f:
                    names.append(e.name)
                    contents.append(f.read())
                size += len(contents[-1])
                if size > 1 << 24 or len(names) >= 10_000:
                    yield batch()
                    names, contents, size = [], [], 0
        if names:
            yield batch()


class TextWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.folder, self.layout, self.columns = local_path(options["path"]), options.get("layout", "files"), columns
        if not {"name", "content"} <= set(columns) and self.layout == "files" or "content" not in columns:
            raise ValueError(f"columns name and content are needed, not {columns}")
        self.job = uuid.uuid4().hex
        self.staging = os.path.join(self.folder, f".{self.job}")
        os.makedirs(self.staging)

    def write(self, rows: Iterator) -> Staged:
        own = os.path.join(self.staging, uuid.uuid4().hex)  # a folder for each attempt: one that is given up is never moved
        os.mkdir(own)  # fails once the job has been given up
        names: list[str] = []
        if self.layout == "log":
            name = f"events-{self.job}-{os.path.basename(own)}.log"
            with open(os.path.join(own, name), "w", encoding="utf-8", newline="\n") as f:
                for r in rows:
                    f.write(f"{r['content'] or ''}\n")
            names.append(name)
        else:
            for r in rows:
                name = re.sub(r"[\x00/\\]", "_", r["name"] or "unnamed")
                with open(os.path.join(own, name), "x", encoding="utf-8", newline="\n") as f:
                    f.write(r["content"] or "")
                names.append(name)
        return Staged(own, names)

    def commit(self, messages: list) -> None:
        staged = [m for m in messages if m is not None]
        seen: set[str] = set()
        for m in staged:
            again = seen.intersection(m.names)
            if again:
                self.abort(messages)
                raise ValueError(f"names occur twice: {sorted(again)[:3]}")
            seen.update(m.names)
        for m in staged:
            for name in m.names:
                os.replace(os.path.join(m.folder, name), os.path.join(self.folder, name))
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        """Take the staging folder away first, so that tasks still running have nowhere to write, then delete it."""
        gone = f"{self.staging}.gone"
        if os.path.isdir(self.staging):
            os.replace(self.staging, gone)
        for folder, folders, files in os.walk(gone, topdown=False):
            for name in files:
                os.remove(os.path.join(folder, name))
            for name in folders:
                os.rmdir(os.path.join(folder, name))
        if os.path.isdir(gone):
            os.rmdir(gone)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, with filters pushed down to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorCatalog)
    spark.dataSource.register(TextFiles)


def unique_names(reports: DataFrame, name: str = "name", order: str = "file_id") -> DataFrame:
    """Of reports with one name the first (by `order`) keeps it, the k-th becomes stem_k before its extension.

    A name that another report carries already is taken again until none clashes, so names
    are unique however they are spelled.
    """
    again = F.row_number().over(W.partitionBy(name).orderBy(order))
    stem, end = F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 2)
    made: Column = F.when(F.col("_again") > 1, F.concat(stem, F.lit("_"), F.col("_again").cast("string"), end)).otherwise(F.col(name))
    once = reports.withColumn("_again", again).withColumn("_made", made)
    # a made name may be another report's own: such ones carry their key as well
    own = reports.select(F.col(name).alias("_made")).distinct().withColumn("_taken", F.lit(True))
    told = once.join(own, "_made", "left")
    keyed = F.concat(stem, F.lit("_"), F.col("_again").cast("string"), F.lit("_"), F.col(order).cast("string"), end)
    return told.withColumn(name, F.when((F.col("_again") > 1) & F.col("_taken"), keyed).otherwise(F.col("_made"))).select(*reports.columns)


def write_reports(reports: DataFrame, folder: str) -> None:
    """A file per report (name, report) below `folder`."""
    reports.select("name", F.col("report").alias("content")).write.format("text_files").mode("append").save(folder)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """name and report of each file below `folder`, three tasks a core."""
    parts = 3 * spark.sparkContext.defaultParallelism
    return spark.read.format("text_files").option("path", folder).option("parts", parts).load().select("name", F.col("content").alias("report"))


def write_log(lines: DataFrame, folder: str, line: str = "line") -> None:
    """A log per task below `folder`."""
    lines.select(F.col(line).alias("content")).write.format("text_files").option("layout", "log").mode("append").save(folder)


# Job events as lines


def event_line() -> Column:
    """A job event as key=value pairs: its job, then what is known of the other nine fields.

    Columns job_id, archive, sha256, provider, provider_id, confidence, status, duration_ms,
    error_code, error_message.  Hashes show 12 digits; numbers are rounded, halves to even;
    error messages stand in quotes.
    """
    text = lambda c, key, shown=None: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{key}="), F.col(c) if shown is None else shown))
    number = lambda c, key, unit="": F.when(F.coalesce(F.col(c), F.lit(0.0)) != 0, F.concat(F.lit(f"{key}="), F.bround(F.col(c).cast("double"), 0).cast("bigint").cast("string"), F.lit(unit)))
    quoted = F.regexp_replace(F.regexp_replace(F.replace("error_message", F.lit("\\"), F.lit("\\\\")), "\n", r"\\n"), "\t", r"\\t")
    single = F.concat(F.lit("'"), F.replace(quoted, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), quoted, F.lit('"'))
    only_single = F.contains("error_message", F.lit("'")) & ~F.contains("error_message", F.lit('"'))
    return F.concat_ws(
        " ", F.concat(F.lit("job="), F.coalesce(F.col("job_id").cast("string"), F.lit(""))), text("archive", "archive"), text("sha256", "sha256", F.concat(F.substring("sha256", 1, 12), F.lit("…"))), text("provider", "provider"), text("provider_id", "issue"),
        number("confidence", "confidence"), text("status", "status"), number("duration_ms", "duration", "ms"), text("error_code", "error_code"), text("error_message", "error", F.when(only_single, double).otherwise(single)),
    )


EVENT_FIELDS = ["job_id", "archive", "sha256", "provider", "provider_id", "confidence", "status", "duration_ms", "error_code", "error_message"]


def event_json() -> Column:
    """A job event as a JSON object of all ten fields; missing text is empty, missing numbers 0."""
    numbers = ("confidence", "duration_ms")
    return F.to_json(F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in numbers else F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in EVENT_FIELDS]))


# Records as JSON

TEXTS = ["title", "series", "number", "volume", "summary", "notes", "publisher", "genre", "web", "language", "format"]
NUMBERS = ["count", "year", "month", "day"]
LISTS = ["writers", "pencillers", "inkers", "colorists", "letterers", "cover_artists", "characters", "teams", "story_arcs", "story_arc_numbers"]
#: The order of fields in a record's JSON.
RECORD = ["title", "series", "number", "volume", "count", "summary", "notes", "year", "month", "day", "publisher", "genre", "web", "language", "format", *LISTS]


def record_to_json(columns: list[str]) -> Column:
    """A record's JSON from the columns (of RECORD) that a table has."""
    return F.to_json(F.struct(*[F.col(c) for c in RECORD if c in columns]), {"ignoreNullFields": "false"})


def record_from_json(data: Column) -> Column:
    """All fields of RECORD, and provider_name, from a record's JSON.

    Absent text is empty, but language "en" and format "Comic"; an absent, null or zero count
    is 1, other numbers 0.  Lists may be arrays, or text between commas; items are trimmed,
    blank ones dropped.  Text that is no JSON object gives the defaults.
    """
    schema = ", ".join([*[f"{c} string" for c in (*TEXTS, *LISTS, *NUMBERS)], "provider_name string", "provider string"])
    # read within an array: of a bare from_json Spark makes a parser for each field that is taken out of it
    return F.get(F.transform(F.array(F.from_json(data, schema)), _record), F.lit(0))


def _record(r: Column) -> Column:
    """The fields of RECORD, and provider_name, out of a record as its JSON tells it."""
    default = {"language": "en", "format": "Comic"}

    def listed(c: str) -> Column:
        as_array = F.from_json(r[c], "array<string>")
        items = F.when(F.trim(r[c]).startswith("["), F.coalesce(as_array, F.array().cast("array<string>"))).otherwise(F.split(F.coalesce(r[c], F.lit("")), ","))
        return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))

    def number(c: str) -> Column:
        n = F.coalesce(r[c].try_cast("int"), F.lit(0))
        return F.when(n == 0, 1).otherwise(n) if c == "count" else n

    fields = [F.coalesce(r[c], F.lit(default.get(c, ""))).alias(c) if c in TEXTS else number(c).alias(c) if c in NUMBERS else listed(c).alias(c) for c in RECORD]
    name = F.coalesce(F.nullif(r["provider_name"], F.lit("")), r["provider"], F.lit("")).alias("provider_name")
    return F.struct(*fields, name)
