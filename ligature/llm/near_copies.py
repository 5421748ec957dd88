"""Near copies: SimHash with Golay-code keys at five words and a Jaccard similarity of 0.8 or more.

The wide form of operator 8. A document is the set of its five-word shingles. Its fingerprint has
SEGMENTS segments of 24 bits, summed over the set; how far each sum lies from zero is kept too. The
extended binary Golay code has 4,096 codewords of 24 bits; a segment is decoded to its nearest ones,
weighing each wrong bit by its sum, as unsure bits are those that near copies differ in. A band
takes three segments, so a document has PROBES keys of 36 bits a band: the likeliest combinations
of its segments' codewords. By pigeonhole some band of a near copy has few errors. Documents that
share a key are joined, and links are verified on the whole sets, so no link is wrong. Of pairs
of random texts, 0.93 share a key at a similarity of 0.82 and all measured ones from 0.9 on; groups
lose less, as copies are linked through each other. A test compares groups to those of all pairs.

All pairs of a bucket aren't made. In each of a few rounds a bucket has a centre, and a set is
compared to one centre of its buckets in each of TRIES groups of bands, so a round has at most TRIES
pairs a set. Of buckets with the same members one is enough. First the member of least hash is centre.
Then each set's own shingles are counted, those that no other set of a bucket has: the member with
fewest, which is likest to the others, is centre, sets of its component aren't compared to it, and
sets whose own shingles alone rule out a link aren't compared at all. What is still in different components of a bucket after
ROUNDS is compared by parities, bits of which each differing shingle turns one, so that as many bits
as differ, at least as many shingles do. Only pairs that this doesn't rule out are made and verified;
no link is lost. Pairs within a component change nothing.

Shingles are 64-bit hashes of lower-cased words; texts of fewer words have one. Equal sets are one
row. Null and wordless texts have the empty set, linked like any other. Rows are numbered once and
written. Null doc_ids don't name a component unless alone in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ligature.llm.common import LOWER_SPACED, numbered, sliced, splitmix, texts_of, written
from ligature.llm.components import components
from ligature.llm.simhash import GENERATOR

SEED, SHINGLE = 42, 5
SEGMENTS, BITS, PROBES = 12, 24, 8
#: Segments of each band: two rules that share few pairs of segments.
BANDS = tuple((i, (i + 1) % SEGMENTS, (i + 3) % SEGMENTS) for i in range(SEGMENTS))
#: Codewords of a segment that combinations take, and the ranks that they combine.
NEAREST = 5
RANKS = np.array([c for c in product(range(NEAREST), repeat=3) if (c[0] + 1) * (c[1] + 1) * (c[2] + 1) <= PROBES])
#: Bits of two fingerprints that may differ: six deviations above the mean at a similarity of 0.8.
FAR = 80
#: Rounds that link a bucket's members to centres, and centres that a set is compared to in each.
ROUNDS, TRIES = 2, 4
_MIX = np.array(splitmix(2 * -(-SEGMENTS * BITS // 64), SEED), np.uint64).reshape(-1, 2) | np.uint64(1)


@lru_cache
def code() -> np.ndarray:
    """Half the codewords as signs, 2,048 x 24; the other half are their complements."""
    words = np.arange(1 << 11, dtype=np.int64) << 11
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    words |= rest
    bits = (words[:, None] >> np.arange(23)) & 1
    return np.concatenate([bits, bits.sum(1, keepdims=True) % 2], 1).astype(np.float32) * 2 - 1


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = text.encode().translate(LOWER_SPACED).split()
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), SEED) for i in range(max(1, len(words) - size + 1))} if words else set()
    return np.sort(np.fromiter(found, np.uint64, len(found)).view(np.int64))


def digest(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def parities(found: np.ndarray) -> np.ndarray:
    """For each place, whether an odd number of hashes end in it; as many places as shingles, or more."""
    width = max(64, 1 << (len(found) - 1).bit_length())
    held = np.bincount((found.view(np.uint64) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((held & 1).astype(np.uint8), bitorder="little").view("<i8")


def sums(found: np.ndarray) -> np.ndarray:
    """For each bit of the fingerprint, shingles that set it less shingles that don't."""
    total = np.zeros(len(_MIX) * 64, np.int64)
    for at in range(0, len(found), 2048):
        h = (found[at : at + 2048].view(np.uint64)[:, None] ^ _MIX[None, :, 0]) * _MIX[None, :, 1]
        h ^= h >> np.uint64(32)
        h *= _MIX[None, :, 0]
        h ^= h >> np.uint64(29)
        total += np.unpackbits(h.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return (2 * total - len(found))[: SEGMENTS * BITS]


def keys(margins: np.ndarray) -> np.ndarray:
    """Keys of documents (rows of sums): documents x (bands x probes)."""
    near, cost = [], []
    for s in range(SEGMENTS):
        fit = margins[:, s * BITS : (s + 1) * BITS].astype(np.float32) @ code().T
        size = np.abs(fit)
        best = np.argpartition(size, -NEAREST, axis=1)[:, -NEAREST:]
        size = np.take_along_axis(size, best, 1)
        # equal fits in the order of their codewords, so that equal sums give equal keys
        best = np.take_along_axis(best, np.lexsort((best, -size), axis=1), 1)
        fit = np.take_along_axis(fit, best, 1)
        near.append(best.astype(np.int64) << 1 | (fit > 0))
        cost.append(np.abs(fit[:, :1]) - np.abs(fit))
    out = []
    for b, band in enumerate(BANDS):
        total = sum(cost[s][:, RANKS[:, i]] for i, s in enumerate(band))
        likeliest = np.argsort(total, axis=1, kind="stable")[:, :PROBES]
        found = sum(near[s][:, RANKS[:, i]] << (12 * i) for i, s in enumerate(band))
        out.append(np.take_along_axis(found, likeliest, 1) << 4 | b)
    return np.concatenate(out, 1)


_LONGS = -(-SEGMENTS * BITS // 64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingles(t.as_py()) for t in batch.column(2)]
        margins = np.array([sums(x) for x in sets], np.int64).reshape(len(sets), SEGMENTS * BITS)
        bits = np.zeros((len(sets), _LONGS * 64), bool)
        bits[:, : SEGMENTS * BITS] = margins > 0
        prints = np.packbits(bits, axis=1, bitorder="little").view("<i8").reshape(len(sets), _LONGS)
        found = [np.unique(k) if len(x) else k[:0] for k, x in zip(keys(margins), sets, strict=True)]
        columns = [batch.column(0), batch.column(1), pa.array([digest(x) for x in sets], pa.int64()), pa.array(map(len, sets), pa.int32()), pa.array(list(prints), pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64())), pa.array([parities(x) for x in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "fp", "n", "bits", "keys", "odd"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingles(t.as_py()) for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])


def _could_be(n: tuple, bits: tuple) -> Column:
    """Whether sizes and fingerprints of two sets allow a link."""
    differ = sum((F.bit_count(F.get(bits[0], F.lit(i)).bitwiseXOR(F.get(bits[1], F.lit(i)))) for i in range(_LONGS)), F.lit(0))
    return (5 * F.least(*n) >= 4 * F.greatest(*n)) & (differ <= FAR)


def _fewest_differing(x: Column, y: Column) -> Column:
    """How many parities of two sets differ, hence a number of shingles that they don't share. Where one
    has twice the places (sizes that could link differ by less), its halves are added up."""
    width = F.least(F.size(x), F.size(y))
    xor = lambda p, q: p.bitwiseXOR(q)
    x, y = (F.when(F.size(z) > width, F.zip_with(F.slice(z, 1, width), F.slice(z, width + 1, width), xor)).otherwise(z) for z in (x, y))
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda total, bits: total + bits)


def _verified(pairs: DataFrame, base: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of set digests that are similar enough, by their whole sets."""
    prints = prints.select("fp", "n", "bits")
    pairs = pairs.join(prints.toDF("a", "na", "xa"), "a").join(prints.toDF("b", "nb", "xb"), "b")
    pairs = written(pairs.where(_could_be(("na", "nb"), ("xa", "xb"))).select("a", "b"), "possible")
    needed = pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct()
    uids = written(classes.join(needed, "fp", "left_semi").select("uid"), "needed")
    sets = written(texts_of(base).join(uids, "uid", "left_semi").mapInArrow(_sets, "fp long, shingles array<long>"), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return written(both.where(5 * shared >= 4 * (F.size("x") + F.size("y") - shared)).select("a", "b"), "similar")


def _ordered(x: str, y: str, pairs: DataFrame) -> DataFrame:
    return written(pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "pairs")


def _group() -> Column:
    """The group of a key's band."""
    return F.pmod(F.col("key").bitwiseAND(F.lit(15)), F.lit(TRIES))


def _centre(turn: int, of: str = "fp") -> Column:
    """A bucket's member with fewest own shingles and of least hash, in an order of each group of bands."""
    return F.min_by(of, F.struct("own", F.xxhash64("fp", _group(), F.lit(turn)), "fp"))


def _few_each(turn: int, pairs: DataFrame) -> DataFrame:
    """Of each set's pairs (key, fp, c, co) with centres, the one with fewest own shingles and of least
    hash in each group of bands."""
    order = F.struct("co", F.xxhash64("c", _group(), F.lit(turn)), "c")
    return pairs.groupBy("fp", _group().alias("of")).agg(F.min_by("c", order).alias("c")).where("c <> fp")


def _members() -> list[Column]:
    """How many members a bucket has, and a 128-bit digest of them."""
    return [F.count("*").alias("held"), F.bit_xor(F.xxhash64("fp")).alias("d1"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("d2")]


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of buckets with the roots of their sets' components."""
    return shared.drop("root").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _split(shared: DataFrame, roots: DataFrame, *by: Column) -> DataFrame:
    """key, fp, root and other columns of buckets whose members are in several components. Of buckets
    with the same members (and the same ``by``), which make the same pairs, one is enough."""
    rooted = written(_rooted(shared, roots), "rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), *_members()).where("low < high")
    several = several.groupBy("held", "d1", "d2", *by).agg(F.min("key").alias("key")).select("key")
    return written(rooted.join(written(several, "several"), "key", "left_semi"), "split")


def _with_own(shared: DataFrame, base: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows of buckets with n, bits, odd and own: how many shingles no other set of these rows has.
    Sets that so many rule out (similarity at most that of all others to all) leave."""
    uids = written(classes.join(shared.select("fp").distinct(), "fp", "left_semi").select("uid"), "asked")
    sets = texts_of(base).join(uids, "uid", "left_semi").mapInArrow(_sets, "fp long, shingles array<long>")
    single = sets.select("fp", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("held"), F.min("fp").alias("fp")).where("held = 1")
    own = written(single.groupBy("fp").agg(F.count("*").alias("own")), "own")
    facts = prints.join(own, "fp", "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long"))).where("5 * (n - own) >= 4 * n")
    return written(shared.drop("own").join(facts, "fp"), "facts")


def _together(rows: DataFrame) -> DataFrame:
    """Rows (key, fp) of buckets with several members, by one shuffle of all rows: most keys have one set,
    and what is asked of buckets later isn't sent for those. A bucket's rows meet in one task, spilled if
    many; as each set has a row for each of its keys, a bucket stands out only with a large part of all sets."""
    held = F.count("*").over(Window.partitionBy("key"))
    return written(rows.withColumn("held", held).where("held > 1").select("key", "fp"), "together")


def _all_links(rows: DataFrame, base: DataFrame, classes: DataFrame, prints: DataFrame) -> DataFrame:
    """(fp, root) of all linked sets of rows (key, fp)."""
    # lists to join with are written first, so that adaptive execution can split a hot bucket's rows
    rows = _together(rows).withColumn("own", F.lit(0).cast("long"))
    buckets = rows.groupBy("key").agg(_centre(0).alias("c"), *_members()).where("held > 1")
    # a bucket's centre follows from its members and the group of its band
    buckets = buckets.groupBy("held", "d1", "d2", _group().alias("of")).agg(F.min_by("c", "key").alias("c"), F.min("key").alias("key")).select("key", "c", F.lit(0).alias("co"))
    shared = written(rows.join(written(buckets, "centres"), "key"), "shared")
    links = _verified(_ordered("c", "fp", _few_each(0, shared)), base, classes, prints)
    roots = components(links).select(F.col("node").alias("fp"), "root")
    shared = _with_own(_rooted(shared.select("key", "fp"), roots), base, classes, prints)
    for turn in range(1, ROUNDS):
        shared = shared if turn == 1 else _split(shared, roots, _group().alias("of"))
        centres = written(shared.groupBy("key").agg(_centre(turn).alias("c"), _centre(turn, "root").alias("cr"), F.min("own").alias("co")), "centres")
        pairs = shared.join(centres, "key").where("cr <> root")
        links = links.union(_verified(_ordered("c", "fp", _few_each(turn, pairs)), base, classes, prints))
        roots = components(links).select(F.col("node").alias("fp"), "root")
    left = _split(shared, roots)
    x, y = left.alias("x"), left.alias("y")
    near = (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & _could_be(("x.n", "y.n"), ("x.bits", "y.bits"))
    # what two sets share is at most the rest of either, and they differ in what each has alone
    total = F.col("x.n") + F.col("y.n")
    near &= (9 * F.least(F.col("x.n") - F.col("x.own"), F.col("y.n") - F.col("y.own")) >= 4 * total) & (9 * (F.col("x.own") + F.col("y.own")) <= total)
    near &= 9 * _fewest_differing(F.col("x.odd"), F.col("y.odd")) <= total
    # files hold a set's columns once for many of its rows, so their size says little of what a broadcast takes
    pairs = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    links = links.union(_verified(_ordered("a", "b", pairs), base, classes, prints))
    return components(links).select(F.col("node").alias("fp"), "root")


def near_groups_of(base: DataFrame) -> DataFrame:
    """One row per row of a numbered table: uid, doc_id, fp, component_id (smallest doc_id reachable
    over similar pairs), and keep (uid of the row that stands for the component)."""
    found = written(texts_of(base).mapInArrow(_signatures, "uid long, doc_id long, fp long, n int, bits array<long>, keys array<long>, odd array<long>"), "signatures")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    classes = written(found.groupBy("fp").agg(F.min("uid").alias("uid"), F.count("*").alias("rows"), F.min("doc_id").alias("least"), F.min_by("uid", order).alias("first")), "classes")
    # of equal sets one row is enough
    again = found.select("uid", "fp").join(written(classes.where("rows > 1").select("fp", F.col("uid").alias("own")), "repeated"), "fp").where("uid <> own")
    one = found.join(written(again.select("uid"), "again"), "uid", "left_anti")
    roots = _all_links(one.select(F.explode("keys").alias("key"), "fp"), base, classes, one.select("fp", "n", "bits", "odd"))
    named = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"), F.min_by("first", F.struct(F.col("least").isNull(), "least", "first")).alias("keep"))
    told = written(named.join(written(best, "best"), "root").select("fp", "component_id", "keep"), "told")
    return found.select("uid", "doc_id", "fp").join(told, "fp").select("uid", "doc_id", "fp", "component_id", "keep")


def near_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, component_id."""
    return near_groups_of(numbered(docs.select("doc_id", "text"))).select("doc_id", "component_id")
