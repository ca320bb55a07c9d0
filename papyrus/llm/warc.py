"""WARC archives: a DataFrame writer, and a Python data source that reads them.

write_archive() makes one record for each page. Spark's text writer does the writing (its line separator is the end of a
record), so archives go to any file system that Spark can write, a file for each task. Equal payloads are stored once: the
other pages get revisit records.

WarcSource plans its partitions from the files, takes over filters on the record type, page id, digest and target URI,
parses a record's headers first, and seeks past the block of a record that the filters drop or whose payload nobody asked
for (option ``payload=false``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from papyrus.llm.common import checkpointed, pick

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 100
#: Repeated digests that are broadcast at most (about 100 bytes each); with more of them the pages are shuffled by digest.
MAX_BROADCAST = 200_000
SCHEMA = "record_type string, page_id long, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload string"
END = "\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, refers_to (null unless the page revisits an equal payload).

    Of equal payloads of LEAST_BYTES or more the one with the smallest page_id is the response, the others revisit it; rows
    that share that page_id are all responses, and rows without a page_id revisit like others. Null html counts as empty.
    """
    own = pick(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long")).withColumn("html", F.coalesce("html", F.lit("")))
    own = own.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2("html", 256))
    # Only the digests that occur again are joined; a hot one is a single row here, however many pages it has.
    again = own.where(F.col("payload_bytes") >= LEAST_BYTES).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    again = checkpointed(again.where("n > 1 and first_id is not null").drop("n"))
    few = again.count() <= MAX_BROADCAST
    joined = own.join(F.broadcast(again) if few else again, ["payload_digest"], "left")
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(revisits, F.col("first_id")).alias("refers_to"))


def _record() -> Column:
    """The text of a record without its closing END."""
    revisit = F.col("refers_to").isNotNull()
    uri = F.regexp_replace(F.col("url"), r"[\x00-\x20\x7F]+", "%20")
    block = F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", compression: str = "none") -> None:
    """Writes a new folder of WARC files, a file for each task; with compression "gzip" each is compressed as a whole."""
    with_revisits(pages, id_col, url_col, html_col).select(_record().alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


@dataclass
class FilePart(InputPartition):
    paths: tuple[str, ...]


def _filesystem(path: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _holds(filter_: Filter, value: object) -> bool:
    if value is None:
        return False
    match filter_:
        case EqualTo():
            return value == filter_.value
        case In():
            return value in filter_.value
        case GreaterThan():
            return value > filter_.value
        case GreaterThanOrEqual():
            return value >= filter_.value
        case LessThan():
            return value < filter_.value
        case LessThanOrEqual():
            return value <= filter_.value
    return True  # IsNotNull


class WarcReader(DataSourceReader):
    HEADERS = ("record_type", "page_id", "target_uri", "payload_bytes", "payload_digest", "refers_to")

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.filters = options["path"], []
        self.payload = options.get("payload", "true").lower() != "false"
        self.bytes, self.pushdown = int(options.get("partitionBytes", 64 << 20)), options.get("pushdown", "true").lower() != "false"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            known = self.pushdown and isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull))
            if known and len(f.attribute) == 1 and f.attribute[0] in self.HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        """Whole files, several small ones together up to partitionBytes."""
        from pyarrow import fs

        system, root = _filesystem(self.path)
        found = [i for i in system.get_file_info(fs.FileSelector(root, recursive=True)) if i.is_file and not i.base_name.startswith((".", "_"))]
        parts, size = [[]], 0
        for info in sorted(found, key=lambda i: i.path):
            if parts[-1] and size + info.size > self.bytes:
                parts.append([])
                size = 0
            parts[-1].append(info.path)
            size += info.size
        return [FilePart(tuple(p)) for p in parts if p] or [FilePart(())]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        for path in partition.paths:
            packed = path.endswith(".gz")
            with system.open_input_stream(path, compression="gzip") if packed else system.open_input_file(path) as raw:
                yield from self._records(raw, not packed)

    def _records(self, raw, seekable: bool) -> Iterator[tuple]:  # noqa: ANN001
        """The records of a file; blocks that nobody needs are passed by a seek, in compressed files by reading on without keeping."""
        buffer, past = b"", 0  # past: how far the place in the file is behind where the next bytes are wanted

        def need(n: int) -> bool:
            """At least n bytes in the buffer, if the file has them."""
            nonlocal buffer, past
            while past and not seekable:
                skipped = len(raw.read(min(past, 1 << 20)))
                past = past - skipped if skipped else 0
            if past:
                raw.seek(raw.tell() + past)
                past = 0
            while len(buffer) < n:
                more = raw.read(max(n - len(buffer), 1 << 16))
                if not more:
                    break
                buffer += more
            return len(buffer) >= n

        while need(1):
            while (stop := buffer.find(b"\r\n\r\n")) < 0:
                if not need(len(buffer) + 1):
                    raise ValueError("a WARC record ends within its headers")
            first, *lines = buffer[:stop].decode("utf-8").split("\r\n")
            if not first.startswith("WARC/"):
                raise ValueError(f"no WARC record: {first[:40]!r}")
            head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            start, length = stop + 4, int(head["content-length"])
            values = self._values(head)
            dropped = any(not _holds(f, values[self.HEADERS.index(f.attribute[0])]) for f in self.filters)
            if dropped or not self.payload or values[0] != "response":
                payload = None  # nothing of the block is read or decoded
            else:
                need(start + length)
                block = buffer[start : start + length]
                body = block[block.find(b"\r\n\r\n") + 4 :]
                values[3], values[4], payload = len(body), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "replace")
                if head.get("warc-payload-digest") != f"sha256:{values[4]}":
                    raise ValueError(f"payload of {head.get('warc-record-id')} does not match its digest")
            if not dropped:
                yield (*values, payload)
            end = start + length + 4
            if end <= len(buffer):
                buffer = buffer[end:]
            else:
                buffer, past = b"", end - len(buffer)

    @staticmethod
    def _values(head: dict[str, str]) -> list:
        def page(text: str | None) -> int | None:
            number = (text or "").strip("<>").rpartition(":")[2]
            return int(number) if number.lstrip("-").isdigit() else None

        length = head.get("x-payload-length")
        return [head.get("warc-type"), page(head.get("warc-record-id")), head.get("warc-target-uri"), int(length) if length else None, head.get("warc-payload-digest", "").rpartition(":")[2] or None, page(head.get("warc-refers-to"))]


class WarcSource(DataSource):
    """spark.read.format("warc").option("path", folder): one row for each record, see SCHEMA."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options)


def read_archive(spark: SparkSession, path: str, where: str | None = None, **options: str) -> DataFrame:
    """The records of an archive; ``where`` is a condition on the header columns that the reader applies itself.

    Spark keeps the filters that were pushed into a loaded relation for its later queries too. So every call loads anew,
    only ``where`` is pushed, and filters that a caller adds later stay above it.
    """
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    loaded = spark.read.format("warc").options(path=path, pushdown=str(where is not None).lower(), **options).load()
    if where is None:
        return loaded
    mark = "_record"  # not deterministic: filters do not pass it
    return loaded.where(where).withColumn(mark, F.monotonically_increasing_id()).where(F.col(mark) >= 0).drop(mark)
