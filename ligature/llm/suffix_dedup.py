"""Removal of every byte under a string of LENGTH bytes that starts twice, by bucket refinement.

The suffixes of the corpus are sorted only as far as LENGTH bytes and only where that can matter:

1. Every window of LENGTH bytes picks its anchor, the q-gram of least hash in it (the leftmost of
   equals). Equal windows pick equal anchors, so the anchors' q-grams are the initial buckets; a
   bucket of one anchor holds no repeated window. A run is a stretch of windows with one anchor.
2. Runs whose contexts (all bytes of their windows) have one 128-bit BLAKE2 digest are repeated as a
   whole. One run of each such class stays as a representative.
3. In buckets of several classes the representatives' windows are told apart by bucket-pointer
   refinement: positions are grouped by their first 8 bytes, then by their own bucket and that
   of the position 8, 16, ... bytes on, until the buckets stand for LENGTH bytes. Each round uses
   the buckets that the last one left; positions alone in theirs drop out. A task holds some whole
   buckets of step 1 at a time.
   A bucket of over CROWD representatives is first refined over the cluster: by the bucket of all
   whole q-grams that its windows hold on both sides of the anchor, then by that of the whole
   window. Those buckets' identifiers are 128-bit BLAKE2 digests; stretches alone in theirs drop
   out after the first. Results don't depend on CROWD.

Null counts as empty; texts under LENGTH bytes are kept as they are. Matches don't cross documents.
Rows are numbered once and written with their numbers, so repeated rows, null doc_ids and a new
split of the input at a later scan do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import read, sliced, splitmix, whole_text, written
from ligature.llm.decontaminate import merged

LENGTH, GRAM = 400, 64
#: Windows hashed at once; representatives of a bucket that one task may hold; bytes refined at once.
SEGMENT, CROWD, BATCH = 1 << 17, 2048, 1 << 20
_PLACE = np.uint64((1 << 20) - 1)


@lru_cache
def _tables(base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Random values of the bytes, powers of an odd base modulo 2**64, and their inverses."""
    n = SEGMENT + LENGTH + 1

    def powers(b: int) -> np.ndarray:
        out, k = np.ones(n, np.uint64), 1
        while k < n:
            out[k : 2 * k] = out[: min(k, n - k)] * np.uint64(pow(b, k, 1 << 64))
            k *= 2
        return out

    return np.array(splitmix(256, base), np.uint64), powers(base), powers(pow(base, -1, 1 << 64))


#: Odd constants of multiplicative hashing.
BASE, MIX = 0x9E3779B97F4A7C15, np.uint64(0xD6E8FEB86659FD93)


class Sums:
    """Prefix sums that give the hash of any substring of a segment in constant time."""

    def __init__(self, data: np.ndarray):
        values, powers, self.inverse = _tables(BASE)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * powers[: len(data)], out=self.sums[1:])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width``."""
    n = 1
    while n * 2 <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    rest = width - n
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of a document by segment: first window, last window, hash of the anchor, its position."""
    for at in range(0, len(data) - length + 1, SEGMENT):
        part = data[at : at + SEGMENT + length - 1]
        sums, n = Sums(part), len(part) - gram + 1
        grams = (sums.sums[gram:] - sums.sums[:-gram]) * sums.inverse[:n]
        order = grams * MIX
        order ^= order >> np.uint64(29)
        order *= MIX
        anchors = least((order & ~_PLACE) | np.arange(n, dtype=np.uint64), length - gram + 1) & _PLACE
        new = np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
        first, last = np.concatenate(([0], new)), np.concatenate((new - 1, [len(anchors) - 1]))
        anchor = anchors[first].astype(np.int64)
        yield first + at, last + at, grams[anchor], anchor + at


def digests(data: memoryview, starts: list[int], ends: list[int]) -> np.ndarray:
    """128-bit digests of slices, as two columns of longs."""
    return np.frombuffer(b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(starts, ends, strict=True)), "<i8").reshape(-1, 2)


_RUN = "uid long, run long, gram long, c1 long, c2 long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches):
        for uid, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = unpack.decompress(packed.as_py())
            for first, last, gram, _ in runs_of(np.frombuffer(data, np.uint8)):
                context = digests(memoryview(data), first.tolist(), (last + LENGTH).tolist())
                columns = (np.full(len(first), uid, np.int64), first << 17 | (last - first), gram.view(np.int64), context[:, 0], context[:, 1])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["uid", "run", "gram", "c1", "c2"])


def _together(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of some size."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _all_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _together(_runs(batches))


def repeated_windows(parts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Which windows of each part are equal to another window of any part, by refinement."""
    starts = np.cumsum([0, *map(len, parts)])
    data = np.frombuffer(b"".join([*parts, bytes(8)]), np.uint8)
    n = starts[-1]
    # positions: starts of windows, and all that lie within windows as later offsets
    ends = np.repeat(starts[1:], np.diff(starts))
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)[:n].copy().view("<u8").ravel()
    _, bucket = np.unique(eight, return_inverse=True)
    bucket, size = bucket.astype(np.int64), 8
    place = np.arange(n)
    whole = place + length <= ends
    active = place[whole]
    while size < length:
        step = min(size, length - size)
        # positions that windows in question still point to, as far as their text goes
        need = np.zeros(n + 1, np.int64)
        np.add.at(need, active, 1)
        np.add.at(need, np.minimum(active + length - size - step + 1, n), -1)
        at = np.flatnonzero(np.cumsum(need[:-1]) > 0)
        pair = bucket[at] * (n + 1) + bucket[at + step]
        _, found, many = np.unique(pair, return_inverse=True, return_counts=True)
        bucket = np.full(n, -1, np.int64)
        bucket[at] = found
        active = active[many[found[np.searchsorted(at, active)]] > 1]
        size += step
    _, found, many = np.unique(bucket[active], return_inverse=True, return_counts=True)
    hit = np.zeros(n, bool)
    hit[active[many[found] > 1]] = True
    return [hit[a : b - length + 1] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edges = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each representative run of a document."""
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches):
        out: list[list] = [[], [], [], [], []]
        for uid, packed, reps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = unpack.decompress(packed.as_py())
            for r in reps:
                first, more = r["run"] >> 17, r["run"] & (1 << 17) - 1
                for column, value in zip(out, (r["gram"], r["crowd"], uid, first, data[first : first + more + LENGTH]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.binary())], names=["gram", "crowd", "uid", "first", "bytes"])


_COVERED = "uid long, first long, last long"


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of rows (gram, uid, first, bytes) that come sorted by gram."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], []]
        for (_, uid, first, _), hit in zip(rows, repeated_windows([r[3] for r in rows]), strict=True):
            a, b = stretches(hit)
            out[0] += [uid] * len(a)
            out[1] += (a + first).tolist()
            out[2] += (b + first).tolist()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["uid", "first", "last"])

    held, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= BATCH and row[0] != held[-1][0]:
                yield flush(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    if held:
        yield flush(held)


def _pointed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of the windows of rows (gram, uid, first, bytes) that hold the same whole grams about
    their anchor, with the bucket of all those grams."""
    for batch in sliced(batches):
        out: list[list] = [[], [], [], [], [], [], []]
        for gram, uid, first, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            anchor = int(next(runs_of(np.frombuffer(data, np.uint8)))[3][0])
            offset = anchor - np.arange(len(data) - LENGTH + 1)
            left, right = offset // GRAM, (LENGTH - offset) // GRAM
            new = np.flatnonzero((np.diff(left) != 0) | (np.diff(right) != 0)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(offset)], strict=True):
                key = digests(memoryview(data), [anchor - GRAM * int(left[a])], [anchor + GRAM * int(right[a])])[0].tolist()
                for column, value in zip(out, (gram, int(left[a]), *key, uid, first + a, data[a : b - 1 + LENGTH]), strict=True):
                    column.append(value)
        kinds = [*[pa.int64()] * 6, pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["gram", "side", "p1", "p2", "uid", "first", "bytes"])


def _window_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        for uid, first, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = data.as_py()
            at = np.arange(len(data) - LENGTH + 1)
            d = digests(memoryview(data), at.tolist(), (at + LENGTH).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(np.full(len(at), uid, np.int64)), pa.array(at + first)], names=["h1", "h2", "uid", "first"])


def _crowded(contexts: DataFrame) -> DataFrame:
    """Repeated windows of the buckets that no task should hold: refined over the cluster."""
    key = ["gram", "side", "p1", "p2"]
    pointed = written(contexts.mapInArrow(_pointed, "gram long, side long, p1 long, p2 long, uid long, first long, bytes binary"), "pointed")
    shared = written(pointed.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "buckets")
    left = pointed.join(shared, key, "left_semi").select("uid", "first", "bytes")
    windows = written(left.mapInArrow(_window_digests, "h1 long, h2 long, uid long, first long"), "windows")
    twice = written(windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2"), "twice")
    return windows.join(twice, ["h1", "h2"], "left_semi").select("uid", "first", F.col("first").alias("last"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the way through the shuffle."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in sliced(batches):
        data = [t.as_buffer().to_pybytes() for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(map(len, data)), pa.int64()), pa.array([pack.compress(d) for d in data], pa.binary())], names=["uid", "doc_id", "n_bytes", "packed"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in sliced(batches):
        out: list[list] = [[], [], [], [], []]
        for doc_id, packed, covered in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            data = unpack.decompress(packed.as_py())
            begins, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if covered.is_valid and len(covered):
                runs = covered.values
                begins, ends = merged(runs.field(0).to_numpy(), runs.field(1).to_numpy() + LENGTH)
            kept, at = hashlib.sha256(), 0
            for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            for column, value in zip(out, (doc_id, len(data), int((ends - begins).sum()), len(begins), kept.hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _run(first: str = "run"):
    return F.shiftrightunsigned(first, 17).alias("first"), (F.shiftrightunsigned(first, 17) + F.col(first).bitwiseAND(F.lit((1 << 17) - 1))).alias("last")


def covered_windows(base: DataFrame) -> DataFrame:
    """uid, first, last: stretches of windows that start elsewhere too (base: uid, n_bytes, packed)."""
    texts = base.where(F.col("n_bytes") >= LENGTH).select("uid", "packed")
    runs = written(texts.mapInArrow(_all_runs, _RUN), "runs")
    # lists to join with are written first, so that adaptive execution can split a hot bucket's rows
    grams = written(runs.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "grams")
    shared = written(runs.join(grams, "gram"), "shared")
    # a run of each class in the first document that has it stands for the class
    best = written(shared.groupBy("gram", "c1", "c2").agg(F.count("*").alias("n"), F.min("uid").alias("uid"), F.min_by("run", "uid").alias("run")), "classes")
    repeated = written(best.where("n > 1").select("gram", "c1", "c2"), "repeated")
    whole = shared.join(repeated, ["gram", "c1", "c2"], "left_semi").select("uid", *_run())
    several = written(best.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "several")
    reps = best.join(several, "gram").select("uid", F.struct("run", "gram", (F.col("k") > CROWD).alias("crowd")).alias("rep"))
    reps = reps.groupBy("uid").agg(F.collect_list("rep").alias("reps"))
    contexts = written(texts.join(reps, "uid").select("uid", "packed", "reps").mapInArrow(_contexts, "gram long, crowd boolean, uid long, first long, bytes binary"), "contexts")
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ("gram", "uid", "first", "bytes")
    refined = contexts.where("not crowd").select(*columns).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(_refined, _COVERED)
    return whole.union(refined).union(_crowded(contexts.where("crowd").select(*columns)))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    base = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), whole_text())
    base = written(base.mapInArrow(_packed, "uid long, doc_id long, n_bytes long, packed binary"), "packed")
    covered = written(covered_windows(base), "covered").groupBy("uid").agg(F.collect_list(F.struct("first", "last")).alias("covered"))
    return base.join(covered, "uid", "left").select("doc_id", "packed", "covered").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
