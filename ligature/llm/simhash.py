"""SimHash near-duplicates over Golay-code fuzzy keys.

A 64-bit fingerprint has three segments of 22, 21 and 21 bits, A, B and C. The binary Golay code
of length 23 is perfect: each word has exactly one codeword within 3 errors. A fingerprint is
indexed under the codeword of a segment and looked up under the codewords of all words within one
error of it (six at most), so a segment with one wrong bit is always found. Three wrong bits leave

* a segment without an error beside one with at most one: exact bits of one, fuzzy key of another
  (six families), or
* one error in each segment: fuzzy keys of A and B, and one exact half of C (two families).

A pair is emitted by the first family that fits it, hence once. Candidates are verified by their
Hamming distance inside the join; equal fingerprints are one row there, so a group of copies costs
as much as one document. Null and wordless texts have fingerprint 0, linked like any other.
Duplicate rows keep their own output row; null doc_ids don't name a component unless alone in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import LOWER_SPACED, read, sliced, whole_text, written
from ligature.llm.components import components

SEED, SHINGLE, DISTANCE = 42, 3, 3
#: Segments as (shift, bits).
SEGMENTS = ((42, 22), (21, 21), (0, 21))
HALVES = ((0, 10), (10, 11))
#: Families: exact segment, fuzzy segment; then the half of C kept exact.
PAIRED = tuple(permutations(range(3), 2))
#: Generator polynomial of the [23, 12] code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """A bit is 1 if set in over half of the shingles' XXH64."""
    words = text.encode().translate(LOWER_SPACED).split()
    if not words:
        return 0
    data = b" ".join(words)
    if len(words) <= size:
        hashes = [xxhash.xxh64_intdigest(data, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[: len(words) - size] + 1).tolist()]
        hashes = [xxhash.xxh64_intdigest(data[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(np.array(hashes[i : i + 4096], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


@lru_cache
def codewords() -> np.ndarray:
    """Index of the nearest codeword of every 22-bit word; shorter words are padded with zeros."""
    syndromes = np.zeros(1 << 23, np.int16)
    for bit in range(23):
        s = 1 << bit
        for k in range(bit, 10, -1):
            if s >> k & 1:
                s ^= GENERATOR << (k - 11)
        syndromes[1 << bit : 2 << bit] = syndromes[: 1 << bit] ^ np.int16(s)
    errors = np.zeros(1 << 11, np.int32)
    one = [1 << i for i in range(23)]
    for x in [*one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one if a < b for c in one if b < c)]:
        errors[syndromes[x]] = x
    words = np.arange(1 << 22, dtype=np.int32)
    return ((words ^ errors[syndromes[: 1 << 22]]) >> 11).astype(np.int16)


def near(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices of all words within one error, sorted by row, and which of them are first."""
    flips = words[:, None] ^ np.array([0, *(1 << i for i in range(bits))], np.int64)[None, :]
    found = np.sort(codewords()[flips], axis=1)
    first = np.ones(found.shape, bool)
    first[:, 1:] = found[:, 1:] != found[:, :-1]
    width = max(1, int(first.sum(1).max(initial=1)))
    order = np.argsort(~first, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(found, order, 1).astype(np.int64), np.take_along_axis(first, order, 1)


def keys(prints: np.ndarray) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray]]:
    """(is a lookup, family, row numbers, keys) of unsigned fingerprints."""
    parts = [(prints >> np.uint64(s) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    own = [codewords()[p].astype(np.int64) for p in parts]
    ball = [near(p, b) for p, (_, b) in zip(parts, SEGMENTS, strict=True)]
    rows = np.arange(len(prints))
    for f, (x, y) in enumerate(PAIRED):
        yield False, f, rows, (parts[x] << 12 | own[y]) << 3 | f
        r, c = np.nonzero(ball[y][1])
        yield True, f, r, (parts[x][r] << 12 | ball[y][0][r, c]) << 3 | f
    both = ball[0][1][:, :, None] & ball[1][1][:, None, :]
    r, i, j = np.nonzero(both)
    fuzzy = ball[0][0][r, i] << 12 | ball[1][0][r, j]
    for f, (shift, bits) in enumerate(HALVES, len(PAIRED)):
        half = parts[2] >> shift & (1 << bits) - 1
        yield False, f, rows, ((own[0] << 12 | own[1]) << 11 | half) << 3 | f
        yield True, f, r, (fuzzy << 11 | half[r]) << 3 | f


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _keys(lookup: bool):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(prints), 4096):
                block = prints[at : at + 4096]
                for is_lookup, _, rows, found in keys(block.view(np.uint64)):
                    if is_lookup == lookup:
                        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(block[rows])], names=["key", "fp"])

    return emit


def _first_family(x: Column) -> Column:
    """The first family by which two fingerprints with XOR ``x`` are found."""
    errors = [F.bit_count(x.bitwiseAND(F.lit(((1 << b) - 1) << s if s + b < 64 else -(1 << s)))) for s, b in SEGMENTS]
    low = F.bit_count(x.bitwiseAND(F.lit((1 << HALVES[0][1]) - 1)))
    found = F.when((errors[0] > 0) & (errors[1] > 0) & (errors[2] > 0), F.when(low == 0, F.lit(len(PAIRED))).otherwise(F.lit(len(PAIRED) + 1)))
    for f, (a, b) in enumerate(PAIRED):
        found = found.when((errors[a] == 0) & (errors[b] <= 1), F.lit(f))
    return found.otherwise(F.lit(-1))


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), whole_text()).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): each pair of different fingerprints of ``distinct`` (fp) within DISTANCE bits, once."""
    # each fingerprint makes some hundred rows: a fixed number of tasks, which Spark does not merge
    distinct = distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    index = distinct.mapInArrow(_keys(False), "key long, fp long").select("key", F.col("fp").alias("a"))
    lookups = distinct.mapInArrow(_keys(True), "key long, fp long").select("key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    near_enough = (F.col("a") < F.col("b")) & (F.bit_count(x) <= DISTANCE) & (_first_family(x) == F.col("i.key").bitwiseAND(F.lit(7)))
    # the planner takes mapInArrow's rows for as many as its input's and would broadcast all keys
    return index.alias("i").join(lookups.hint("merge").alias("l"), (F.col("i.key") == F.col("l.key")) & near_enough).select("a", "b")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fp (signed 64 bits), component_id (smallest doc_id reachable)."""
    found = written(fingerprints(docs), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes.select("fp"))).select(F.col("node").alias("fp"), "root")
    named = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.join(smallest, "root").select("fp", "component_id"), "named")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", digits.alias("fingerprint"), "component_id")
