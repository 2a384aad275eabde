"""WARC archives: written by Spark's own text writer, read by a Python data source.

Writing: every record is a string that ends in CRLF CRLF, so the text sink with a line feed as separator writes valid
archives to any file system Spark can reach, under its commit protocol. Records with equal payloads are written once as
a response; the others are revisits that name it.

Reading: one partition per file, or per run of small ones. The reader takes over predicates on the record type and on
headers, parses headers first, and steps over a payload unless a record that passed wants it decoded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from cairn.session import shared_dir, ship

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Bytes of archives that one partition reads, unless a single file is larger.
PARTITION_BYTES = 32 << 20
#: Digests of repeated payloads that may be broadcast: some 100 bytes each, so at most about 20 MB.
BROADCAST_DIGESTS = 200_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
SCHEMA = "page_id bigint, record_type string, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string or binary column: eight groups of 20 bits."""
    digest = F.sha1(payload)
    out = []
    for k in range(8):
        group = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(group, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to) of the records to write; refers_to is null in responses.

    Of the pages whose payloads are equal and of at least `least` bytes, the one with the smallest page_id is the
    response. Digests are counted on narrow rows, summed up before the shuffle; those that repeat are broadcast if there are
    few, else the pages are shuffled by digest, and Spark splits a digest that many of them share.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", sha1_base32(F.col("html")))
    repeated = rows.where(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("payload_digest", "first")
    near = (F.col("payload_bytes") >= least) & (F.col("page_id") > F.col("first"))
    if repeated.count() <= BROADCAST_DIGESTS:  # then no payload is shuffled
        repeated = F.broadcast(repeated)
    return rows.join(repeated, "payload_digest", "left").select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(near, F.col("first")).alias("refers_to"))


def write(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write the output of records() to `path` as gzipped archives, about one per task."""
    end = F.lit("\r\n")
    clean = F.regexp_replace("url", "[\\r\\n]", "")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    own = F.coalesce(name(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")))  # reads back as null
    visit = F.col("refers_to").isNotNull()
    block = F.when(visit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), "html"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(visit, F.lit("revisit")).otherwise(F.lit("response")), end,
        F.lit("WARC-Record-ID: "), own, end,
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), clean, end,
        F.lit("WARC-Payload-Digest: sha1:"), "payload_digest", end,
        F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string"), end,
        F.when(visit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    # the sink adds the line feed that ends the record
    rows.select(F.concat(head, block, F.lit("\r\n\r")).alias("value")).write.option("compression", "gzip").option("lineSep", "\n").text(path)


def _open(path: str):
    """A byte stream of `path` on any file system that Arrow knows; gzip is undone."""
    import pyarrow.fs as pfs

    system, name = pfs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pfs.LocalFileSystem(), path)
    return system.open_input_stream(name, compression="gzip" if name.endswith(".gz") else None, buffer_size=1 << 20)


class Stream:
    """Lines and blocks of a byte stream."""

    def __init__(self, raw) -> None:
        self.raw, self.buffer, self.at = raw, b"", 0

    def more(self) -> bool:
        chunk = self.raw.read(1 << 20)
        self.buffer, self.at = self.buffer[self.at :] + chunk, 0
        return bool(chunk)

    def head(self) -> bytes | None:
        """Up to the blank line; None at the end of the archive."""
        while (to := self.buffer.find(b"\r\n\r\n", self.at)) < 0:
            if not self.more():
                if self.buffer[self.at :].strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        out, self.at = self.buffer[self.at : to], to + 4
        return out

    def skip(self, n: int) -> None:
        while n > len(self.buffer) - self.at:
            n -= len(self.buffer) - self.at
            self.at = len(self.buffer)
            if not self.more():
                raise ValueError("the archive ends inside a record")
        self.at += n

    def take(self, n: int) -> bytes:
        parts = []
        while n > len(self.buffer) - self.at:
            parts.append(self.buffer[self.at :])
            n -= len(parts[-1])
            self.at = len(self.buffer)
            if not self.more():
                raise ValueError("the archive ends inside a record")
        parts.append(self.buffer[self.at : self.at + n])
        self.at += n
        return b"".join(parts)


    def until_next(self) -> bytes:
        """The block of a record that doesn't tell its length: up to the next record or the end."""
        while (to := self.buffer.find(b"\r\n\r\nWARC/", self.at)) < 0:
            if not self.more():
                out, self.at = self.buffer[self.at :].removesuffix(b"\r\n\r\n"), len(self.buffer)
                return out
        out, self.at = self.buffer[self.at : to], to + 4
        return out


def parse(stream: Stream, wanted, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA for the records that `wanted` lets pass; only their payloads are read, if at all.

    A record without a length reaches to the next one; header bytes that aren't UTF-8 are replaced.
    """
    while (head := stream.head()) is not None:
        lines = head.lstrip(b"\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = h.get("content-length", "")
        n = int(size) if size.isdigit() else None
        number = lambda x: int(m[1]) if (m := re.match(r"<urn:page:(-?\d+)>", h.get(x, ""))) else None
        size = h.get("x-payload-length")
        row = {"page_id": number("warc-record-id"), "record_type": h.get("warc-type"), "url": h.get("warc-target-uri"), "payload_bytes": int(size) if size else None, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "refers_to": number("warc-refers-to")}
        block = stream.until_next() if n is None else None
        keep = wanted(row)
        decode = keep and payload and row["record_type"] == "response"
        if n is not None:
            block = stream.take(n) if decode else None
            stream.skip(4 if decode else n + 4)
        if keep:
            yield (*row.values(), block.partition(b"\r\n\r\n")[2] if decode else None)


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.files, self.payload = options["files"].split("\n") if options["files"] else [], options.get("payload", "true") == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over comparisons of header columns with constants; hand back the rest."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else ""
            if name in ("page_id", "record_type", "url", "payload_bytes", "payload_digest", "refers_to") and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.tests.append((type(f).__name__, name, tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[Files]:
        groups: list[list[str]] = []
        size = PARTITION_BYTES
        for line in self.files:
            n, _, path = line.partition(" ")
            if size + int(n) > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += int(n)
        return [Files(g) for g in groups]

    def read(self, partition: Files) -> Iterator[tuple]:
        kinds = {k.__name__: v for k, v in _TESTS.items()}

        def wanted(row: dict) -> bool:
            return all(row[name] is not None and (kind == "IsNotNull" or kinds[kind](row[name], value)) for kind, name, value in self.tests)

        for path in partition.paths:
            with _open(path) as raw:
                yield from parse(Stream(raw), wanted, self.payload)


class WarcSource(DataSource):
    """Format `warc`. Options: files (lines of size, space, path), payload (false: never decode payloads)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """SCHEMA rows of every archive (*.warc, *.txt, gzipped or not) right below `path`; an empty folder gives none."""
    ship(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    files = sorted((f.getPath().toString(), f.getLen()) for f in listed if f.isFile() and re.search(r"\.(warc|txt)(\.gz)?$", f.getPath().getName()))
    return spark.read.format("warc").option("payload", str(payload).lower()).option("files", "\n".join(f"{n} {p}" for p, n in files)).load()


def archive(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write a WARC record per page and read the archives back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Lengths and digests of responses are computed anew from the payloads read back, those of revisits come from their
    headers. A null html or url counts as empty; a page without page_id is a response without one; line ends in a url are dropped. Pages that repeat a page_id each have a
    record; of equal payloads under one smallest page_id each such row is a response. An empty table gives no rows;
    other columns are ignored. The archives stay at `path`, by default below the shared folder.
    """
    import uuid

    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/cairn/warc-{uuid.uuid4().hex}"
    write(records(pages), path)
    whole = read(spark, path).where("record_type = 'response'")
    visits = read(spark, path, payload=False).where("record_type = 'revisit'")
    seen = whole.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), "record_type", "refers_to")
    return seen.unionByName(visits.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
