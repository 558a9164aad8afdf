"""WARC archives: a sink that writes records through Spark's own committed writer, and a Python data source that reads them.

Writing: a record is one string, built by SQL functions; the text writer ends each with the blank lines that part
records, so a lost executor leaves no half-written archive behind. Reading: files are planned into partitions by size,
predicates on record type and header columns are pushed into the reader, a record's headers are parsed first, and a
payload that is not wanted is skipped by its length without being read into the result.

Defined results. Null html: an empty payload. Null url: an empty target. Null page_id: never referred to by a revisit
unless no other record has the payload, in which case all of them are responses. Repeated rows of the largest page_id
are all responses. Line breaks in header values are percent-encoded. Empty table: no records.
"""

import json
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull

from .common import scratch, small, stored

VERSION = "WARC/1.1"
RECORDS_PER_FILE = 50_000
SPLIT_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed values: base32
SCHEMA = ("record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_digest string, "
          "payload_bytes long, headers map<string,string>, payload binary")


def base32_sha1(payload):
    """SHA-1 as 32 base32 letters: 40 hexadecimal digits in groups of 20 bits."""
    digest = F.sha1(payload)
    letters = []
    for g in range(8):
        v = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _urn(key):
    h = F.md5(F.concat(F.lit("page:"), key))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _line(name, value):
    """A header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """One WARC record per page in column `value`; equal payloads of at least min_bytes become revisits of one response."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumns({
        "payload_bytes": F.octet_length("html").cast("long"), "digest": base32_sha1(F.encode("html", "UTF-8"))})
    repeated = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(
        F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    rows = rows.join(small(stored(repeated, "payloads")), ["digest", "payload_bytes"], "left")
    revisit = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    uri = F.col("url")
    for mark, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        uri = F.replace(uri, F.lit(mark), F.lit(code))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    own = F.coalesce(F.col("page_id").cast("string"), F.concat(F.lit("none:"), F.col("digest"), F.lit(":"), F.coalesce("url", F.lit(""))))
    value = F.concat(
        F.lit(f"{VERSION}\r\n"), _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(own)), _line("WARC-Target-URI", uri), _line("WARC-Date", F.lit(DATE)),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", F.when(revisit, _urn(F.col("first").cast("string")))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("X-Page-Id", F.col("page_id")), _line("X-Refers-To-Page", F.when(revisit, F.col("first"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)
    return rows.select(value.alias("value"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write pages as WARC files below path; every file holds whole records and at most records_per_file of them."""
    (records(pages, min_bytes).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
     .mode("error").text(path))


class FileGroup(InputPartition):
    def __init__(self, paths):
        super().__init__(paths)
        self.paths = paths


def _open(path):
    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return open(unquote(parts.path) if parts.scheme else path, "rb")
    from pyarrow import fs
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class WarcReader(DataSourceReader):
    PUSHED = {"record_type", "record_id", "target_uri", "page_id", "refers_to", "payload_digest", "payload_bytes"}

    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.payload = options.get("payload", "true") == "true"
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.wanted = []  # (column, accepted values; None stands for any value but null)

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in self.PUSHED and isinstance(f, (EqualTo, In, IsNotNull)):
                values = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
                self.wanted.append((name, values))
            else:
                yield f

    def partitions(self):
        groups, here, size = [], [], 0
        for path, length in self.files:
            if here and size + length > self.split:
                groups.append(FileGroup(here))
                here, size = [], 0
            here.append(path)
            size += length
        return groups + ([FileGroup(here)] if here else [])

    def read(self, partition):
        for path in partition.paths:
            with _open(path) as file:
                yield from self._records(file, path)

    def _records(self, file, path):
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: a record should begin here, not {line[:40]!r}")
            headers = _headers(file)
            left = int(headers["Content-Length"])
            number = lambda k: int(headers[k]) if k in headers else None
            row = {"record_type": headers.get("WARC-Type"), "record_id": headers.get("WARC-Record-ID"),
                   "target_uri": headers.get("WARC-Target-URI"), "page_id": number("X-Page-Id"),
                   "refers_to": number("X-Refers-To-Page"),
                   "payload_digest": (headers.get("WARC-Payload-Digest") or "").removeprefix("sha1:") or None}
            if not all(self._accepts(row[k], v) for k, v in self.wanted if k in row):
                file.seek(left, 1)
                continue
            length, payload = None, None
            if headers.get("Content-Type", "").startswith("application/http"):
                start = file.tell()
                file.readline()
                length = int(_headers(file).get("Content-Length", 0))
                left -= file.tell() - start
            if self.payload and row["record_type"] != "revisit" and self._accepts_length(length):
                payload, left = file.read(left), 0
            file.seek(left, 1)
            if self._accepts_length(length):
                yield (*row.values(), length, headers, payload)

    @staticmethod
    def _accepts(value, values):
        return value is not None and (values is None or value in values)

    def _accepts_length(self, length):
        return all(self._accepts(length, v) for k, v in self.wanted if k == "payload_bytes")


def _headers(file):
    found = {}
    while (line := file.readline()).strip():
        name, _, value = line.decode().rstrip("\r\n").partition(":")
        found[name] = value.strip()
    return found


class WarcSource(DataSource):
    """Options: files (JSON list of path and length), payload (false: payloads are skipped), splitBytes."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_warc(spark, path: str, payload: bool = True) -> DataFrame:
    """Records below path; filters on the header columns reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    listed = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    files = [(f.getPath().toString(), f.getLen()) for f in listed if not f.getPath().getName().startswith(("_", "."))]
    return spark.read.format("warc").option("files", json.dumps(files)).option("payload", str(payload).lower()).load()


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages as archives in the shared folder and read back one row per record.

    Payloads of responses are read and digested anew; those of revisits do not exist and are not looked for.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path, min_bytes)
    response = read_warc(spark, path).where(F.col("record_type") == "response").select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"), "target_uri")
    revisit = read_warc(spark, path, payload=False).where(F.col("record_type") == "revisit").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri")
    return response.unionByName(revisit)
