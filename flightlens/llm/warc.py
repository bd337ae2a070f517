"""WARC archives: written as one gzip stream per file, normalised to one member per record.

1. Pages become WARC/1.1 records. Of pages with equal payloads the one with the largest
   identifier is a response, the others revisit it. Spark's text writer writes the records, as
   whole files in gzip, each one stream: good to store, but no record can be read alone.
2. The normaliser inflates each file once, cuts the stream into records by their lengths,
   and writes every record as a gzip member of its own (again by the text writer, with an
   empty gzip member as the separator between rows).
3. The normalised files are read back member by member; a sidecar index has each record's
   file, offset, length and headers.

All files go through Spark's readers and writers, so any store that Spark can reach
will do and a lost executor only repeats its files. Files hold at most ``per_file``
records; a file's compressed bytes are in memory whole, inflated data is streamed.
"""

from __future__ import annotations

import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flightlens.llm.common import prepare
from flightlens.session import materialize, scratch_dir

PER_FILE = 2000
CHUNK = 1 << 20
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# A gzip member without content, in bytes: magic, deflate, no flags, no time, unknown system, empty block, checksum and size 0.
EMPTY_MEMBER = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
RECORD = "file string, seq bigint, member binary"
INDEX = "file string, `offset` bigint, length bigint, page_id bigint, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, target_uri string, intact boolean"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of 40 hexadecimal digits: every five are four characters."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def described(pages: DataFrame) -> DataFrame:
    """(id, url, payload, digest, n_bytes, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select(F.col("page_id").alias("id"), F.col("url"), payload.alias("payload"))
    df = df.withColumns({"digest": base32(F.sha1("payload")), "n_bytes": F.octet_length("payload").cast("long")})
    # Only payloads with several identifiers need a partner; the html itself is not shuffled for them.
    same = df.groupBy("digest").agg(F.max("id").alias("largest"), F.min("id").alias("smallest"), F.count("*").alias("n"), F.count("id").alias("named"))
    same = materialize(same.where("n > 1 AND largest IS NOT NULL AND (smallest < largest OR named < n)").select("digest", "largest"), "copies")
    df = df.join(same, "digest", "left")
    return df.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("largest")), F.col("largest"))).drop("largest")


def uri(page: Column) -> Column:
    return F.concat(F.lit("urn:page:"), F.coalesce(page.cast("string"), F.lit("none")))


def records(pages: DataFrame) -> DataFrame:
    """One column ``value``: a whole record but for its last line feed, which is the text writer's separator."""
    df = described(pages)
    target = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    kind = F.when(revisit, "revisit").otherwise("response")
    pairs = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", F.concat(F.lit("<"), uri(F.col("id")), F.lit(">"))),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    head = [F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")) for name, value in pairs]
    refers = F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), uri(F.col("refers_to")), F.lit(">\r\n"))).otherwise("")
    return df.select(F.concat(F.lit("WARC/1.1\r\n"), *head, refers, F.lit("\r\n"), block, F.lit("\r\n\r")).alias("value"))


def write_monolithic(pages: DataFrame, path: str, *, per_file: int = PER_FILE) -> None:
    """WARC files, each a single gzip stream."""
    records(pages).write.option("maxRecordsPerFile", per_file).option("compression", "gzip").option("lineSep", "\n").text(path)


def gzip_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")


def inflated(content: bytes):
    """The inflated stream, in pieces of bounded size; goes on over several members."""
    at = 0
    while at < len(content):
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            data = unzip.unconsumed_tail or content[at : at + CHUNK]
            if not unzip.unconsumed_tail:
                at += len(data)
            if not data:
                raise ValueError("the gzip stream ends early")
            yield unzip.decompress(data, CHUNK)
        at -= len(unzip.unused_data)


HEAD_END = b"\r\n\r\n"
LENGTH = re.compile(rb"\r\ncontent-length:\s*(\d+)", re.IGNORECASE)


def cut(stream):
    """Whole records of a stream of WARC data."""
    data = bytearray()
    for piece in stream:
        data += piece
        while (end := data.find(HEAD_END)) >= 0:
            found = LENGTH.search(data, 0, end)
            if not data.startswith(b"WARC/") or not found:
                raise ValueError("no WARC record where one should start")
            size = end + 4 + int(found[1]) + 4
            if len(data) < size:
                break
            yield bytes(data[:size])
            del data[:size]
    if data:
        raise ValueError("the last WARC record ends early")


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def rewrite(batches):
    """(path, content) of monolithic files → (file, seq, member), a row per record."""
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            name, rows, held = path.as_py().rsplit("/", 1)[-1].split(".")[0], [], 0
            for seq, record in enumerate(cut(inflated(content.as_py()))):
                rows.append((name, seq, member(record)))
                held += len(rows[-1][2])
                if held >= 4 * CHUNK:
                    yield rows_of(rows)
                    rows, held = [], 0
            if rows:
                yield rows_of(rows)


def rows_of(rows) -> pa.RecordBatch:
    names, seqs, members = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(seqs, pa.int64()), pa.array(members, pa.binary())], names=["file", "seq", "member"])


def normalise(spark: SparkSession, monolithic: str, path: str) -> None:
    """Rewrites the files under ``monolithic`` with a gzip member per record: one folder per file.

    The rows of a file stay in their task and order, so nothing is shuffled.
    """
    prepare(spark)
    rows = gzip_files(spark, monolithic).mapInArrow(rewrite, RECORD).sortWithinPartitions("file", "seq")
    separator = EMPTY_MEMBER.decode("latin-1")
    out = rows.select("file", F.col("member").cast("string").alias("value"))
    out.write.partitionBy("file").option("encoding", "ISO-8859-1").option("lineSep", separator).option("compression", "none").text(path)


def number(value: str | None) -> int | None:
    tail = (value or "").strip("<>").rsplit(":", 1)[-1]
    return int(tail) if tail.lstrip("-").isdigit() else None


def parse(record: bytes) -> dict:
    head, _, block = record.partition(HEAD_END)
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    http, _, body = block[: int(fields["content-length"])].partition(HEAD_END)
    size = int(LENGTH.search(b"\r\n" + http)[1])
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    return {
        "page_id": number(fields["warc-record-id"]),
        "record_type": kind,
        "payload_bytes": size,
        "payload_digest": digest,
        "refers_to": number(fields.get("warc-refers-to")),
        "target_uri": fields["warc-target-uri"],
        "intact": kind == "revisit" and not body or kind == "response" and len(body) == size and sha1_base32(body) == digest,
    }


def sha1_base32(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def read_members(batches):
    """(path, content) of normalised files → index rows, a batch per file."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("target_uri", pa.string()), ("intact", pa.bool_())])
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1), strict=True):
            data, at, rows = content.as_py(), 0, []
            view = memoryview(data)
            while at < len(data):
                unzip, parts, start, fed = zlib.decompressobj(31), [], at, at
                while not unzip.eof:
                    if fed >= len(data):
                        raise ValueError("a gzip member ends early")
                    parts.append(unzip.decompress(view[fed : fed + CHUNK]))
                    fed += CHUNK
                at = min(fed, len(data)) - len(unzip.unused_data)
                if record := b"".join(parts):
                    rows.append(parse(record) | {"file": path.as_py(), "offset": start, "length": at - start})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


def normalised_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_index(spark: SparkSession, normalised: str, path: str) -> DataFrame:
    """Reads every record back and writes the sidecar index of files, offsets and lengths."""
    prepare(spark)
    normalised_files(spark, normalised).mapInArrow(read_members, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def archive(pages: DataFrame, path: str | None = None, *, per_file: int = PER_FILE) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) and returns the index of the normalised files.

    ``path`` gets the folders ``monolithic``, ``records`` and ``index``; the default is a folder
    of its own in the session's shared folder. Payload: the html in UTF-8; a null one is empty.
    A null identifier counts as smaller than any other; rows that repeat the largest
    identifier are all responses. White space and control characters of a URL become ``%20``.
    No row: no file, an empty index.
    """
    spark = pages.sparkSession
    path = path or scratch_dir(spark, f"warc-{uuid.uuid4().hex}")
    write_monolithic(pages, f"{path}/monolithic", per_file=per_file)
    normalise(spark, f"{path}/monolithic", f"{path}/records")
    return write_index(spark, f"{path}/records", f"{path}/index")
