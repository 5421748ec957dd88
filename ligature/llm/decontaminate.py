"""Benchmark decontamination over a positional inverted index of the training tokens.

The index is sharded by document: each row holds one document's postings of the test vocabulary,
the sorted terms with the ascending word positions of each. It is written once for all test items
whose vocabulary fits TERMS words (else once for each such shelf of items). Terms are ranked by
how often they occur in the whole corpus. A phrase is looked up from its rarest term: that term's
positions, less its offset in the phrase, are candidate starts; they are intersected with the
offset-adjusted positions of the next rarer terms in turn until all words agree. Since each shard
answers for its own documents, no posting moves.

The phrases of a shelf go to the index in blocks of bounded size, each against all rows, and a
document's answers from several blocks are united, so the test set may be of any size. Rows are
numbered once and written. Null texts have no words and items without words no window; repeated
item rows count once, null item_ids as the text 'null'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import numbered, read, sliced, texts_of, whole_text, written

WINDOW = 10
#: Characters of test text that one block holds; a single longer item is a block of its own.
BLOCK_BYTES = 1 << 20
#: Words that the index knows at once; a single item of more is a shelf of its own.
TERMS = 1_000_000
#: Bytes of words: 0-9, a-z (A-Z become these), all of 0x80 and above; others become blanks.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Phrases:
    """Windows of a block of test items: distinct phrases, each with the items that hold it."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW, vocabulary: dict[bytes, int] | None = None):
        self.vocabulary: dict[bytes, int] = {} if vocabulary is None else vocabulary
        held: dict[tuple[int, ...], set[str]] = {}
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                held.setdefault(tuple(ids[at : at + window]), set()).add(name)
        self.phrases = list(held)
        self.items = [sorted(x) for x in held.values()]

    def plan(self, uses: np.ndarray) -> Plan:
        return Plan(self, uses)


class Plan:
    """Phrases ordered for lookup: by their rarest term, with the other terms from rare to frequent."""

    def __init__(self, found: Phrases, uses: np.ndarray):
        order = [sorted(range(len(p)), key=lambda i, p=p: (uses[p[i]], i)) for p in found.phrases]
        width = max(map(len, order), default=1)
        rarest = np.array([p[o[0]] for p, o in zip(found.phrases, order, strict=True)], np.int64)
        by_term = np.argsort(rarest, kind="stable")
        #: For phrase, rank: term and offset, -1 past the phrase's end.
        self.terms, self.offsets = np.full((len(order), width), -1, np.int64), np.zeros((len(order), width), np.int64)
        for row, i in enumerate(by_term.tolist()):
            self.terms[row, : len(order[i])] = [found.phrases[i][k] for k in order[i]]
            self.offsets[row, : len(order[i])] = order[i]
        self.sizes = (self.terms >= 0).sum(1)
        self.items = [found.items[i] for i in by_term.tolist()]
        #: Phrases whose rarest term is t: rows first[t] to first[t + 1].
        self.first = np.searchsorted(rarest[by_term], np.arange(len(found.vocabulary) + 1))

    def find(self, terms: np.ndarray, positions: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of all exact matches in postings sorted by term, then position."""
        many = self.first[terms + 1] - self.first[terms]
        phrase = np.repeat(self.first[terms], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        start = np.repeat(positions, many) - self.offsets[phrase, 0]
        fits = (start >= 0) & (start + self.sizes[phrase] <= n_words)
        phrase, start, postings = phrase[fits], start[fits], terms * n_words + positions
        for rank in range(1, self.terms.shape[1]):
            if not len(phrase):
                break
            term = self.terms[phrase, rank]
            wanted = term * n_words + start + self.offsets[phrase, rank]
            at = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
            fits = (term < 0) | (postings[at] == wanted)
            phrase, start = phrase[fits], start[fits]
        return phrase, start


def postings(base: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """The index of a numbered table: uid, doc_id, n_words, terms and positions (same length, by term,
    then position)."""
    sent = base.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = sent.value.get
        for batch in sliced(batches):
            counts, terms, places = [], [], []
            for text in batch.column(2):
                found = words(text.as_py())
                ids = np.fromiter((look(w, -1) for w in found), np.int32, len(found))
                at = np.flatnonzero(ids >= 0)
                order = np.argsort(ids[at], kind="stable")
                counts.append(len(found))
                terms.append(ids[at][order])
                places.append(at[order].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], names=["uid", "doc_id", "n_words", "terms", "positions"])

    return texts_of(base).mapInArrow(index, "uid long, doc_id long, n_words long, terms array<int>, positions array<int>")


def frequencies(index: DataFrame, n: int) -> np.ndarray:
    """Corpus frequency of each test term: one number a term reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["term", "uses"])

    out = np.zeros(n, np.int64)
    for term, uses in index.select("terms").mapInArrow(count, "term long, uses long").groupBy("term").agg(F.sum("uses").alias("uses")).collect():
        out[term] = uses
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str | None]]]:
    """The test items in blocks of at most ``limit`` bytes of text or one item."""
    block, size = [], 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), whole_text()).distinct().orderBy("i", "text")
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def _matched(index: DataFrame, plan: Plan) -> DataFrame:
    """uid, doc_id, n_words, begins and ends of hit runs of words (disjoint, ascending), items."""
    sent = index.sparkSession.sparkContext.broadcast(plan)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        for batch in sliced(batches):
            begins, ends, items = [], [], []
            for n, terms, places in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                phrase, start = plan.find(terms.values.to_numpy().astype(np.int64), places.values.to_numpy().astype(np.int64), n)
                b, e = merged(start, start + plan.sizes[phrase])
                begins.append(b)
                ends.append(e)
                items.append(sorted({i for p in np.unique(phrase).tolist() for i in plan.items[p]}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(begins, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["uid", "doc_id", "n_words", "begins", "ends", "items"])

    return index.mapInArrow(match, "uid long, doc_id long, n_words long, begins array<long>, ends array<long>, items array<string>")


def merged(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open runs as disjoint ascending runs."""
    if not len(begins):
        return begins, ends
    order = np.argsort(begins, kind="stable")
    begins, ends = begins[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], begins[1:] > ends[:-1]))
    return begins[new], ends[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(ends) - 1]))]


def shelves(benchmark: DataFrame, limit: int = BLOCK_BYTES, terms: int = TERMS) -> Iterator[tuple[dict[bytes, int], int, int]]:
    """Vocabularies, each with the first and the last block whose words it holds, its end excluded."""
    vocabulary, first, at = {}, 0, 0
    for at, block in enumerate(blocks(benchmark, limit)):
        new = {w for _, text in block for w in words(text)}.difference(vocabulary)
        if vocabulary and len(vocabulary) + len(new) > terms:
            yield vocabulary, first, at
            vocabulary, first = {}, at
            new = {w for _, text in block for w in words(text)}
        for w in sorted(new):
            vocabulary[w] = len(vocabulary)
    yield vocabulary, first, at + 1


def _united(index: DataFrame, hits: list[DataFrame]) -> DataFrame:
    """One row per document of the index from the hits of several blocks (as many a document as blocks)."""
    rows = reduce(DataFrame.union, hits)
    schema = rows.schema
    lists = ("begins", "ends", "items")
    joined = rows.groupBy("uid").agg(*(F.flatten(F.collect_list(c)).alias(c) for c in lists))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [merged(b.values.to_numpy(), e.values.to_numpy()) for b, e in zip(batch.column(3), batch.column(4), strict=True)]
            items = [sorted(set(x)) for x in batch.column(5).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r[0] for r in runs], pa.list_(pa.int64())), pa.array([r[1] for r in runs], pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=batch.schema.names)

    filled = [F.coalesce(F.col(c), F.array().cast(schema[c].dataType)).alias(c) for c in lists]
    return index.select("uid", "doc_id", "n_words").join(joined, "uid", "left").select("uid", "doc_id", "n_words", *filled).mapInArrow(unite, schema)


def matches(base: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, terms: int = TERMS) -> DataFrame:
    """One row per row of a numbered table: uid, doc_id, n_words, begins and ends of the hit runs, items."""
    found, index = [], None
    for vocabulary, first, end in shelves(benchmark, block_bytes, terms):
        index = written(postings(base, vocabulary), "postings")
        uses = frequencies(index, len(vocabulary))
        for block in islice(blocks(benchmark, block_bytes), first, end):
            found.append(_matched(index, Phrases(block, window, vocabulary).plan(uses)))
    if not found:
        found.append(_matched(index, Phrases([]).plan(np.zeros(0, np.int64))))
    return found[0] if len(found) == 1 else _united(index, [f.where(F.size("items") > 0) for f in found])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, terms: int = TERMS) -> DataFrame:
    """One row per document: uid, doc_id, n_words, begins and ends of the hit runs, and items."""
    return matches(numbered(docs.select("doc_id", "text")), benchmark, window, block_bytes, terms)


def near_matches(docs: DataFrame, terms: list[str], within: int) -> DataFrame:
    """doc_id and start: stretches of at most ``within`` words that hold all ``terms``, by their
    first word. Candidates come from the rarest term; no terms or an absent one give no rows."""
    wanted = sorted({w for t in terms for w in words(t)})
    vocabulary = {w: i for i, w in enumerate(wanted)}
    index = written(postings(numbered(docs.select("doc_id", "text")), vocabulary), "postings")
    rare = np.argsort(frequencies(index, len(wanted)), kind="stable").tolist()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts = [], []
            for doc_id, t, p in zip(batch.column(1).to_pylist(), batch.column(3), batch.column(4), strict=True):
                t, p = t.values.to_numpy(), p.values.to_numpy()
                lists = [p[t == term] for term in rare]
                if lists and all(map(len, lists)):
                    # the first word of a stretch is an occurrence of some term not far before the rarest
                    begins = np.unique(np.concatenate(lists))
                    begins = begins[np.searchsorted(lists[0], begins) < np.searchsorted(lists[0], begins + within)]
                    for places in lists[1:]:
                        begins = begins[np.searchsorted(places, begins) < np.searchsorted(places, begins + within)]
                    ids += [doc_id] * len(begins)
                    starts += begins.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64())], names=["doc_id", "start"])

    return index.mapInArrow(search, "doc_id long, start long")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hits = F.aggregate(F.zip_with("begins", "ends", lambda b, e: e - b), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", hits.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with iw as (select coalesce(item_id::varchar, 'null') as item, {_WORDS} as w from benchmark),
p as (select distinct item, len(x) as n, array_to_string(x, ' ') as phrase from
      (select item, w[g:g + 9] as x from iw, lateral (select unnest(range(1, greatest(len(w) - 9, 1) + 1)) as g) where len(w) > 0)),
dw as (select doc_id, {_WORDS} as w from documents),
m as (select d.doc_id, d.pos, p.n, p.item from
      (select doc_id, l.n, g.pos, array_to_string(w[g.pos:g.pos + l.n - 1], ' ') as phrase
       from dw, (select distinct n from p) l, lateral (select unnest(range(1, len(w) - l.n + 2)) as pos) g) d
      join p on p.n = d.n and p.phrase = d.phrase),
h as (select doc_id, count(distinct pos + k) as n_hit from (select distinct doc_id, pos, n from m) q, lateral (select unnest(range(0, q.n)) as k) group by doc_id),
i as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from m group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(h.n_hit, 0)::bigint as n_hit, coalesce(i.n_items, 0)::bigint as n_items,
       sha256(coalesce(i.items, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from dw d left join h on h.doc_id = d.doc_id left join i on i.doc_id = d.doc_id
"""
