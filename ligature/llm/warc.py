"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Archives are WARC/1.0 files that Spark's text writer lays down: a record is a row, the blank lines
that end a record are the line separator, so any file system that Spark knows will do and plain
files of any size can be split; ``compression="gzip"`` writes whole files as one gzip stream each.
Reading splits the files at the magic "WARC/1.0", wherever it stands, also inside payloads. Each
such piece is a candidate record, and its Content-Length names its successor's offset. Pointer
jumping from offset 0 of each file then doubles its reach every round, and only candidates that the
chain reaches are records; the others are part of a payload and go back there. A later scan may be
split otherwise than the first, so it finds pieces again by their SHA-256, not by their place.

Pages with equal payloads (SHA-256 and length) of at least ``least`` bytes are stored once: the
smallest page_id's record is the response, the others are revisit records without a payload that
name it. Null html counts as empty; null page_ids come last; repeated rows of the smallest page_id
are all responses. Null urls are written empty. A url of printable ASCII is written as it is, any
other percent-encoded and marked so.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ligature.llm.common import read, shared_folder, sliced, written

MAGIC, END = "WARC/1.0\r\n", "\r\n\r\n"
#: Records of an archive at most: the writer begins another file then.
RECORDS = 1000
#: Fixed value: how WARC/1.0 names revisits of an equal payload.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PLAIN = re.compile(r"[\x21-\x7E]*")

def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads compressed for the way through the shuffle, with their sizes and digests."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in sliced(batches):
        data = [h.as_buffer().to_pybytes() for h in batch.column(2)]
        digests = [base64.b32encode(hashlib.sha1(d).digest()).decode() for d in data]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack.compress(d) for d in data], pa.binary()), pa.array(list(map(len, data)), pa.int64()), pa.array(digests, pa.string()), pa.array([hashlib.sha256(d).digest() for d in data], pa.binary())], names=["page_id", "url", "packed", "payload_bytes", "payload_digest", "sha256"])


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, packed (html, zstd), payload_bytes, payload_digest, refers_to (null for responses)."""
    ddl = "page_id long, url string, packed binary, payload_bytes long, payload_digest string, sha256 binary"
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_packed, ddl)
    # only payloads that several rows share are looked up; the list is written, so that its size is known
    sizes = rows.where(F.col("payload_bytes") >= least).groupBy("sha256", "payload_bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    rows = rows.join(written(sizes.where("n > 1").drop("n"), "shared"), ["sha256", "payload_bytes"], "left")
    # a null page_id is never the smallest, unless there is no other
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select("page_id", "url", "packed", "payload_bytes", "payload_digest", F.when(again, F.col("first")).alias("refers_to"))


def _texts(date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One record per row, without the blank lines that end it."""
        unpack = zstandard.ZstdDecompressor()
        for batch in sliced(batches):
            out = []
            for page_id, url, packed, size, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body, plain = unpack.decompress(packed) if refers_to is None else b"", _PLAIN.fullmatch(url)
                head = [
                    f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>", f"WARC-Date: {date}",
                    f"WARC-Target-URI: {url if plain else quote(url, safe='')}", *([] if plain else ["X-Target-Encoded: 1"]), f"WARC-Payload-Digest: sha1:{digest}",
                    *([] if refers_to is None else [f"X-Payload-Length: {size}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]), f"Content-Length: {len(body)}",
                ]
                out.append(MAGIC + "\r\n".join(head) + END + body.decode())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    return write


def write_archives(pages: DataFrame, path: str, least: int = 0, records: int = RECORDS, date: str | None = None, compression: str = "none") -> None:
    """One record per page, in the text files of the folder ``path``, dated ``date`` or now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    with_types(pages, least).mapInArrow(_texts(date), "value string").write.option("lineSep", END).option("maxRecordsPerFile", records).option("compression", compression).text(path)


_FIELDS = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_FIELDS_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_PLACE = [("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("reach", pa.int64()), ("run", pa.int64()), ("leap", pa.int64()), ("digest", pa.binary())]
_PLACE_DDL = "file string, block long, place long, at long, size long, reach long, run long, leap long, digest binary"


def _number(text: str) -> int | None:
    digits = text.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.removeprefix("-").isdigit() else None


def record(data: bytes) -> tuple[tuple, int, bytes | None]:
    """The fields of a record without its magic, the bytes it says it has (-1: not a record), its payload."""
    head, _, body = data.partition(b"\r\n\r\n")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
    if not field.get("content-length", "").isdecimal():
        return (None,) * 6, -1, None
    n = int(field["content-length"])
    body, kind = body[:n], field.get("warc-type", "")
    whole = kind == "response"
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode() if whole else field.get("warc-payload-digest", "").removeprefix("sha1:")
    length = n if whole else _number(field.get("x-payload-length", "")) or 0
    url = field.get("warc-target-uri", "")
    told = (_number(field.get("warc-record-id", "")), unquote(url) if "x-target-encoded" in field else url, kind, _number(field.get("warc-refers-to", "")), length, digest)
    return told, len(MAGIC) + len(head) + 4 + n + 4, body if whole else None


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per piece: its place in its block and, were it a record, its fields and reach.

    A piece that reaches exactly to the next one is regular. A run is a stretch of regular pieces
    and the odd one that ends it. leap is where the chain goes that enters a run: to its odd piece,
    from there to what that reaches, or out of the block."""
    held: list[list] = []

    def flush() -> pa.RecordBatch:
        run, leap = 0, held[-1][3] + held[-1][4]
        for row in reversed(held):
            odd = row[5] != row[4]
            if odd:
                run, leap = run + 1, row[3]
            row[6:8] = run, leap if not odd else row[3] + row[5] if row[5] >= 0 else None
        columns = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PLACE + _FIELDS, strict=True)], names=[n for n, _ in _PLACE + _FIELDS])

    for batch in batches:
        for value, file, block in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if held and held[0][:2] != [file, block]:
                yield flush()
                held = []
            data = value.as_py()
            told, reach, _ = record(data)
            at = held[-1][3] + held[-1][4] if held else 0
            held.append([file, block, len(held), at, len(MAGIC) + len(data), reach, 0, 0, hashlib.sha256(data).digest(), *told])
    if held:
        yield flush()


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row per place where the magic stands: file, block, off, next (where its record would end),
    run, leap, digest of its bytes, and the fields of its record. The text before a file's first magic is left out."""
    pieces = written(_scan(spark, path).mapInArrow(_pieces, f"{_PLACE_DDL}, {_FIELDS_DDL}"), "pieces")
    # a block's pieces begin where those of the file's earlier blocks end
    blocks = pieces.groupBy("file", "block").agg(F.sum("size").alias("size"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", (F.coalesce(F.sum("size").over(earlier), F.lit(0)) - len(MAGIC)).alias("base"))
    shifted = pieces.join(blocks, ["file", "block"])
    columns = [(F.col("base") + F.col("at")).alias("off"), F.when(F.col("reach") >= 0, F.col("base") + F.col("at") + F.col("reach")).alias("next"), (F.col("base") + F.col("leap")).alias("leap")]
    return shifted.select("file", "block", *columns, "run", "digest", *(n for n, _ in _FIELDS)).where("off >= 0")


def reached(found: DataFrame) -> DataFrame:
    """file, off of the candidates on the chain from each file's start.

    Pointer jumping over leaps finds where the chain enters runs; it passes all of a run from there."""
    jumps = found.select("file", "off", F.col("leap").alias("next"))
    known = jumps.where("off = 0").select("file", "off")
    while True:
        known = written(known, "known")
        ahead = known.join(jumps, ["file", "off"]).select("file", F.col("next").alias("off")).where("off is not null")
        further = written(ahead.join(jumps.select("file", "off"), ["file", "off"], "left_semi").join(known, ["file", "off"], "left_anti").distinct(), "ahead")
        if further.isEmpty():
            break
        known = known.union(further)
        onward = jumps.select("file", F.col("off").alias("next"), F.col("next").alias("then"))
        jumps = written(jumps.join(onward, ["file", "next"], "left").select("file", "off", F.col("then").alias("next")), "jumps")
    entered = found.join(known, ["file", "off"], "left_semi").groupBy("file", "block", "run").agg(F.min("off").alias("entry"))
    return found.join(entered, ["file", "block", "run"]).where("off >= entry").select("file", "off")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(*told, payload) for told, _, payload in (record(d.as_py()) for d in batch.column(0))]
        kinds = [*_FIELDS, ("payload", pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[n for n, _ in kinds])


def _with_data(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (digest, ...) with the bytes of the pieces that the digests name: pieces of one
    digest are equal, so any of them will do, whichever way this scan is split."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([hashlib.sha256(v.as_buffer()).digest() for v in batch.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([found, batch.column(0)], names=["digest", "data"])

    asked = written(wanted.select("digest").distinct(), "asked")
    pieces = _scan(spark, path).select("value").mapInArrow(named, "digest binary, data binary").join(asked, "digest", "left_semi")
    return pieces.groupBy("digest").agg(F.first("data").alias("data")).join(wanted, "digest")


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, payload_bytes, payload_digest (both
    of the full payload; of a response they are computed anew), and payload (null for revisits).

    Without ``payloads`` the records' bytes stay in their first task, which has hashed them."""
    found = written(candidates(spark, path), "candidates")
    chain = reached(found).withColumn("real", F.lit(True))
    marked = written(found.join(chain, ["file", "off"], "left"), "marked")
    # candidates off the chain are part of the last record before them
    before = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.select("file", "digest", "off", "real", F.last(F.when(F.col("real"), F.col("off")), True).over(before).alias("owner"))
    false = written(owned.where("real is null and owner is not null"), "false")
    fields = [n for n, _ in _FIELDS]
    records = marked.where("real")
    if false.isEmpty() and not payloads:
        return records.select(*fields, F.lit(None).cast("binary").alias("payload"))
    owners = false.select("file", F.col("owner").alias("off")).distinct()
    if payloads:
        wanted = owned.where("owner is not null").select("file", "digest", "off", "owner")
        rest = None
    else:
        wanted = false.select("file", "digest", "off", "owner").union(records.join(owners, ["file", "off"], "left_semi").select("file", "digest", "off", F.col("off").alias("owner")))
        rest = records.join(owners, ["file", "off"], "left_anti").select(*fields, F.lit(None).cast("binary").alias("payload"))
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("off", "data"))), lambda p: p.data)
    magic = F.lit(MAGIC).cast("binary")
    joined = _with_data(spark, path, wanted).groupBy("file", "owner").agg(F.aggregate(pieces, F.lit(None).cast("binary"), lambda a, p: F.when(a.isNull(), p).otherwise(F.concat(a, magic, p))).alias("data"))
    read_ = joined.select("data").mapInArrow(_read, f"{_FIELDS_DDL}, payload binary")
    return read_ if rest is None else rest.union(read_)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, coalesce(html, '') as h from pages),
k as (select page_id, h, min(page_id) over (partition by h) as first, sha1(h) as d from p)
select page_id, strlen(h)::bigint as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(d, 1 + (i // 8) * 10, 10))::bigint >> (35 - 5 * (i % 8))) & 31), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from k
"""
