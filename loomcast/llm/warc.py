"""WARC archives of pages, and a normaliser for archives compressed as one stream.

``write_stream`` writes records as one gzip stream per file. ``members`` inflates such a file, from front
to back, and gives every record a gzip member of its own; ``write_archives`` writes them as one file per
archive, with a sidecar index (archive, number, offset, length, record id, type). ``read_back`` reads every
member of the archives and matches it with the index; only records' figures are shuffled, never payloads.

Records with equal payloads of at least ``revisit_bytes`` bytes are stored once: that with the smallest id is
the response, the others are revisits that name it. Smaller ones are all responses.

Nulls and empties: a null payload is empty. Rows with equal ids each get a record; among equal payloads all
rows with the smallest id are responses. Rows with a null id have records without an id; they are responses
unless a row with an id has the same payload. An empty table gives an empty result. Other columns are ignored.
A very long payload needs memory for itself.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomcast.llm.storage import scratch, stored
from loomcast.shipping import shipped

END = "\r\n\r\n"
# Spark's text writer must put something behind a row: an empty gzip member, so that the file stays valid
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
HEADER = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)\r\n")
READ = 1 << 18


def classified(pages: DataFrame, revisit_bytes: int, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type, refers_to."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload")) \
        .withColumn("payload_bytes", F.octet_length("payload").cast("long")) \
        .withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256))
    # stored: the planner then knows whether the payloads that repeat are few, and moves no payload for them
    first = stored(rows.filter(F.col("payload_bytes") >= revisit_bytes).groupBy("payload_digest")
                   .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "payload_digest", "left") \
        .withColumn("record_type", F.when(again, "revisit").otherwise("response")) \
        .withColumn("refers_to", F.when(again, F.col("first"))).drop("first")


def record(rows: DataFrame) -> Column:
    """A record without its closing empty lines. A revisit has no payload, but its digest."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise("")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda k, v: F.concat(F.lit(k + ": "), v, F.lit("\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", name(F.col("page_id"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(F.col("refers_to").isNotNull(), line("WARC-Refers-To", name(F.col("refers_to")))).otherwise(""),
        line("Content-Length", F.octet_length(body).cast("string")), F.lit("\r\n"), body)


ARCHIVE_BYTES = 1 << 27  # payloads of an archive, unless one is larger


def write_stream(rows: DataFrame, path: str, records: int, most: int = ARCHIVE_BYTES) -> None:
    """Archives of at most ``records`` records and ``most`` bytes of payloads (or one record), each file one gzip
    stream, by Spark's text writer. Payloads above ``most / records`` bytes go by powers of two of their size to
    archives of fewer records, in folders ``large-...``."""
    unit = max(1, most // records)
    power = F.lit(0)
    for k in range(32):  # a string has less than 2**31 bytes
        power = F.when(F.col("payload_bytes") > (unit << k), k + 1).otherwise(power)
    rows = rows.withColumn("_power", power)
    large = sorted(r[0] for r in rows.select("_power").filter("_power > 0").distinct().collect())
    for k in [0, *large]:
        rows.filter(F.col("_power") == k).select(record(rows).alias("value")) \
            .write.option("maxRecordsPerFile", min(records, max(1, most // (unit << k)))) \
            .option("lineSep", END).option("compression", "gzip").text(f"{path}/large-{k}" if k else path)


def inflated(content: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip file in parts; one stream or several."""
    at, size, engine = 0, len(content), zlib.decompressobj(31)
    while at < size:
        feed = content[at:at + READ]
        at += len(feed)
        while len(feed):
            out = engine.decompress(feed, READ)
            if out:
                yield out
            if engine.eof:
                feed = engine.unused_data
                engine = zlib.decompressobj(31)
            else:
                feed = engine.unconsumed_tail


def records_of(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, whole record, payload) of a stream of records; memory holds a record and one part."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            part = next(parts, None)
            if part is None:
                return False
            held.extend(part)
        return True

    while True:
        searched = 0
        while (end := held.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(held) - 3)
            if not need(len(held) + 1):
                if held:
                    raise ValueError("archive ends inside a record")
                return
        headers = {k.decode().lower(): v.decode() for k, v in HEADER.findall(bytes(held[:end + 2]))}
        if not held.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        size = end + 4 + int(headers["content-length"])
        if not need(size + 4) or held[size:size + 4] != b"\r\n\r\n":
            raise ValueError("a record does not end as it should")
        yield headers, bytes(held[:size + 4]), bytes(held[end + 4:size])
        del held[:size + 4]


def member(data: bytes) -> bytes:
    engine = zlib.compressobj(6, zlib.DEFLATED, 31)
    return engine.compress(data) + engine.flush()


MEMBERS = "archive string, number long, offset long, length long, record_id string, record_type string, member binary"


def members(files: DataFrame) -> DataFrame:
    """One row per record of archives read by Spark's ``binaryFile`` source: its own gzip member and its place in
    the rewritten archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEMBERS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        for batch in batches:
            for row in range(batch.num_rows):
                archive = batch.column(0)[row].as_py().rpartition("/")[2].partition(".")[0]
                content = memoryview(batch.column(1)[row].as_buffer())
                rows, offset, held = [], 0, 0
                for number, (headers, whole, _) in enumerate(records_of(inflated(content))):
                    own = member(whole)
                    rows.append((archive, number, offset, len(own), headers["warc-record-id"], headers["warc-type"], own))
                    offset += len(own) + len(EMPTY)
                    held += len(own)
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return files.select("path", "content").transform(shipped).mapInArrow(run, MEMBERS)


INDEX = ["archive", "number", "offset", "length", "record_id", "record_type"]


def write_archives(found: DataFrame, path: str) -> None:
    """``path``/archives/archive=NAME/part-...: one file per archive; ``path``/index: the sidecar as Parquet.

    An archive is made by one task, in order: ``found`` must have its rows in one partition, as ``members`` gives
    them. A stored table does not, since Spark reads a file of several row groups in several tasks. ``found`` is
    made twice, which moves and keeps no member but compresses each a second time.
    """
    found.select(*INDEX).write.parquet(f"{path}/index")
    found.sortWithinPartitions("archive", "number").select("archive", F.col("member").cast("string").alias("value")) \
        .write.partitionBy("archive").option("encoding", "ISO-8859-1").option("lineSep", EMPTY.decode("latin-1")) \
        .text(f"{path}/archives")


def normalise(spark: SparkSession, source: str, path: str) -> None:
    """Rewrite all archives in ``source`` to ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz") \
        .option("recursiveFileLookup", True).load(source)
    write_archives(members(files), path)


READ_BACK = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
             "archive string, offset long, length long")


def members_of(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of every gzip member that is not empty."""
    at = 0
    while at < len(content):
        engine, data, feed, used = zlib.decompressobj(31), [], b"", 0
        while not engine.eof:
            feed = content[at + used:at + used + READ]
            if not len(feed):
                raise ValueError("archive ends inside a member")
            used += len(feed)
            data.append(engine.decompress(feed))
        used -= len(engine.unused_data)
        whole = b"".join(data)
        if whole:
            yield at, used, whole
        at += used


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Pages of the archives in ``path``; a record that the index does not name, or names elsewhere, is an error."""
    number = re.compile(r"<urn:page:(-?\d*)>")

    def page(text: str | None) -> int | None:
        found = number.fullmatch(text or "")
        return int(found[1]) if found and found[1] else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ_BACK.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for row in range(batch.num_rows):
                rows, archive = [], batch.column(0)[row].as_py()
                for at, size, data in members_of(memoryview(batch.column(1)[row].as_buffer())):
                    (headers, _, payload), = records_of(iter([data]))
                    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the record at {archive}:{at} is damaged")
                    full = len(payload) if kind == "response" else int(headers["warc-payload-length"])
                    rows.append((page(headers["warc-record-id"]), full, digest, kind, page(headers.get("warc-refers-to")),
                                 archive, at, size))
                columns = list(zip(*rows)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    index = spark.read.schema("archive string, offset long, length long, record_type string").parquet(f"{path}/index") \
        .select("archive", "offset", F.col("length").alias("_length"), F.col("record_type").alias("_type"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*") \
        .load(f"{path}/archives").select(F.regexp_extract("path", r"archive=([^/]+)/", 1).alias("archive"), "content")
    found = files.transform(shipped).mapInArrow(run, READ_BACK).join(index, ["archive", "offset"], "full")
    same = F.coalesce((F.col("length") == F.col("_length")) & (F.col("record_type") == F.col("_type")), F.lit(False))
    wrong = F.raise_error(F.concat(F.lit("index and archive differ at "), "archive", F.lit(":"), F.col("offset").cast("string")))
    return found.withColumn("record_type", F.when(same, F.col("record_type")).otherwise(wrong.cast("string"))) \
        .select(*[c.split()[0] for c in READ_BACK.split(", ")])


def round_trip(pages: DataFrame, revisit_bytes: int = 100, records: int = 1000, id_col: str = "page_id",
               html_col: str = "html") -> DataFrame:
    """Write the pages as archives of one stream, normalise them, and read the result."""
    spark = pages.sparkSession
    path = scratch(spark)
    write_stream(classified(pages, revisit_bytes, id_col, html_col), f"{path}/stream", records)
    normalise(spark, f"{path}/stream", f"{path}/members")
    return read_back(spark, f"{path}/members")
