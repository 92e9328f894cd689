"""WARC archives: a Spark job that writes them and a Python data source that
reads them.

Writing.  Each row becomes one record, an HTTP response whose payload is the
text.  Of records with equal payloads of at least ``least_bytes`` bytes the one
with the least id is the ``response``; the others are ``revisit`` records, which
carry the HTTP header only and refer to it.  The least id is a partial minimum
per digest; records are put together by column functions and written by Spark's
own text writer (its commit protocol survives lost executors), one file a task.

Reading (``spark.read.format("warc")``).  The driver lists files and packs them
into partitions; equality and IN predicates on the record type and on header
columns are pushed down; a task parses the headers of a record first and seeks
past the block of one that is not wanted, or whose payload is not asked for
(option ``payload`` = ``false``).

Defined results: null text is an empty payload; a null URL gives an empty
header; line breaks in a URL are percent-encoded; a null id gives a record id
without number, read back as null, and revisits the least non-null id; rows
with equal id and payload are alike (all response, or all revisit); an empty
table gives archives without records, and a folder without files no rows.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from marktwert.llm import common as C

LEAST_BYTES = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
URN = "urn:page:"

#: Columns filled from headers alone.
HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
SCHEMA = ("record_type string, record_id string, target_uri string, payload_digest string, refers_to string, "
          "payload_bytes long, payload binary")


# ---- writing ---------------------------------------------------------------
def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
            least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``record`` (header and block) of every row."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.withColumns({"n": F.octet_length("body").cast("long"),
                             "digest": F.sha2(F.encode("body", "utf-8"), 256)})
    # stored, so that its size is known: texts are shuffled only if the groups are too many to broadcast
    first = C.store(pages.sparkSession, rows.where(F.col("n") >= least_bytes).groupBy("digest")
                    .agg(F.min("id").alias("first"), F.count("*").alias("rows")).where("rows > 1")
                    .select("digest", "first"), "copies")
    rows = rows.join(first, "digest", "left")
    again = (F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(F.col("http"), F.when(F.col("again"), "").otherwise(F.col("body")))

    def urn(c: str) -> F.Column:
        return F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    rows = rows.withColumns({"again": again, "http": http}).withColumn("block", block)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("again"), "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn("id"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(F.col("again"), F.concat(F.lit("\r\nWARC-Refers-To: "), urn("first"),
                                        F.lit(f"\r\nWARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit("\r\n\r\n"))
    return rows.select(F.concat(head, F.col("block")).alias("record"))


def write(pages: DataFrame, path: str, **kw) -> None:
    """Write the archive files of ``pages`` to the folder ``path``."""
    records(pages, **kw).write.option("lineSep", RECORD_END).text(path)


# ---- reading ---------------------------------------------------------------
class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(0)
        self.paths = paths


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])
    return pafs.LocalFileSystem(), path


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options ``payload`` (default
    true) and ``bytesPerPartition``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.size = int(options.get("bytesPerPartition", options.get("bytesperpartition", 64 << 20)))
        self.wanted: dict[str, set[str]] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if name not in HEADER_COLUMNS:
                yield f
                continue
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self) -> list[Files]:
        fs, root = _filesystem(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.size
                       and not f.base_name.startswith(("_", ".")))
        groups, size = [[]], 0
        for path, n in files:
            if size and size + n > self.size:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += n
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                for row in read_records(stream, self.wanted, self.payload):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= 4096 or size > 8_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [*HEADER_COLUMNS, "payload_bytes", "payload"]
    kinds = [pa.string()] * len(HEADER_COLUMNS) + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def _headers(stream) -> dict[str, str] | None:
    """Header lines up to the blank line; None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):  # between records
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record at this place: {line[:60]!r}")
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def read_records(stream, wanted: dict[str, set[str]], payload: bool) -> Iterator[tuple]:
    """Rows of the records whose headers fit; the rest is sought past."""
    while (head := _headers(stream)) is not None:
        length = int(head.get("content-length", 0))
        values = [head.get(h) for h in HEADER_COLUMNS.values()]
        fits = all(head.get(HEADER_COLUMNS[c]) in ok for c, ok in wanted.items())
        if not fits:
            stream.seek(length, 1)
            continue
        if not payload:
            # the HTTP header tells the size of the payload
            left, size = length, None
            while left > 0:
                line = stream.readline()
                left -= len(line)
                if line.lower().startswith(b"content-length:"):
                    size = int(line[15:])
                if line in (b"\r\n", b""):
                    break
            stream.seek(left, 1)
            yield (*values, size, None)
            continue
        http, _, body = stream.read(length).partition(b"\r\n\r\n")
        size = next((int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(body))
        yield (*values, size, body)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records below ``path``.  Pushing predicates into a Python data
    source needs a session switch, which is set here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def page_number(column: str) -> F.Column:
    """Number of a record id written by :func:`records`, null if it has none."""
    text = F.regexp_extract(column, f"^<{URN}(-?[0-9]+)>$", 1)
    return F.when(text != "", text.cast("long"))
