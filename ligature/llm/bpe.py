"""Byte-pair encoding by backtracking over longest matches, and decoding by an offset table.

A piece (one match of the pre-tokenizer's pattern) is covered from the left by the longest token
that an Aho-Corasick automaton finds there. A token is accepted if merging would leave the border
to its predecessor alone, which the pair-compatibility table answers (filled as pairs turn up: a
pair's answer follows from the tokens' merge trees). If not, the next shorter token is tried, and
if none fits, the predecessor is taken back; positions that failed are never tried again, so the
work is linear in the piece. The result is exactly that of merging in rank order.

Null counts as the empty text, which has no tokens. Texts are encoded whole; special tokens in a
text are recognised as the tokenizers library does by default. Invalid byte sequences that decoding
may meet become U+FFFD. Repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm.common import read, sliced, whole_text

#: The pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces, and words, that a worker remembers (twice so many at most), and the longest of them.
REMEMBERED, LONGEST = 200_000, 48


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encoder and decoder of one tokenizer file of the tokenizers library (byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, model = byte_letters(), spec["model"]
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # ranks number the tokens so that a merge's rank is above those of its parts: bytes, then merges
        names = [t for t in vocab if len(t) == 1]
        ranks = {t: r for r, t in enumerate(names)}
        self.split: list[tuple[int, int]] = [(r, r) for r in range(len(names))]
        self.pairs: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if (whole := a + b) not in ranks:
                ranks[whole] = len(ranks)
                self.split.append((ranks[a], ranks[b]))
            self.pairs.setdefault((ranks[a], ranks[b]), ranks[whole])
        self.tokens = [raw(t) for t in ranks]
        self.sizes = [len(t) for t in self.tokens]
        self.ids = [vocab[t] for t in ranks]
        by_bytes = {t: r for r, t in enumerate(self.tokens)}
        #: The longest token that is a proper prefix of each, or -1.
        self.shorter = [next((by_bytes[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in by_bytes), -1) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for t, r in by_bytes.items():
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(pieces) + ")") if pieces else None
        self.find = regex.compile(PATTERN).findall
        self.odd_spaces = regex.compile(r"\s\s|[^\S \n]|[ \n]$").search
        # the offset table: token id's bytes are blob[offsets[id]:offsets[id + 1]]
        texts = {i: t for i, t in zip(self.ids, self.tokens, strict=True)} | {i: t.encode() for t, i in self.special.items()}
        lengths = [len(texts.get(i, b"")) for i in range(max(texts) + 1)]
        self.offsets = np.concatenate(([0], np.cumsum(lengths)))
        self.blob = np.frombuffer(b"".join(texts.get(i, b"") for i in range(max(texts) + 1)), np.uint8)
        self.slices = [self.blob[a:b].tobytes() for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True)]
        self.pieces, self.units = Memory(REMEMBERED, LONGEST), Memory(REMEMBERED, LONGEST)
        self.pack = [struct.Struct(f"<{n}I").pack for n in range(16)]

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens in rank order keeps the border between them."""
        if (known := self.fits.get((left, right))) is not None:
            return known
        a, b, limit = left, right, len(self.split)
        while True:
            if self.pairs.get((a, b), limit) < limit:
                answer = False
                break
            # undo the later of the two merges next to the border: it must come after any across it
            if a > b:
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    if b + 1 == limit:
                        answer = True
                        break
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    if a == limit:
                        answer = True
                        break
        if len(self.fits) > 200_000:
            self.fits.clear()
        self.fits[left, right] = answer
        return answer

    def ranks_of(self, data: bytes) -> list[int]:
        """Ranks of the tokens of one piece."""
        text, scan, known, sizes, shorter = data.decode("latin-1"), self.automaton.iter_long, self.fits.get, self.sizes, self.shorter
        found = [rank for _, rank in scan(text)]
        # in many pieces the longest matches from the left stand as they are
        at, last = 0, -1
        for i, token in enumerate(found):
            if last >= 0 and not ((fit := known((last, token))) or fit is None and self.compatible(last, token)):
                break
            at += sizes[token]
            last = token
        else:
            return found
        del found[i:]
        n, closed = len(text), set()
        while True:
            end = at + sizes[token]
            if end not in closed and (not found or (fit := known((found[-1], token))) or fit is None and self.compatible(found[-1], token)):
                found.append(token)
                if end == n:
                    return found
                at = end
                token = next(scan(text, at))[1]
            elif (token := shorter[token]) < 0:
                closed.add(at)
                token = found.pop()
                at -= sizes[token]

    def packed(self, piece: str) -> bytes:
        """Ids of one piece as little-endian 32-bit integers."""
        ranks = self.ranks_of(piece.encode())
        return self.pack[len(ranks)](*map(self.ids.__getitem__, ranks)) if len(ranks) < len(self.pack) else np.array([self.ids[r] for r in ranks], "<u4").tobytes()

    def unit(self, unit: str) -> bytes:
        """Ids of what stands between two borders of encode()."""
        if unit.isascii() and unit.isalpha():  # one piece by the pattern
            return self.packed(f" {unit}")
        text = unit if unit[:1] == "\n" else f" {unit}"
        return b"".join([self.pieces.get(p, self.packed) for p in self.find(text)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        if self.special_pattern and len(parts := self.special_pattern.split(text)) > 1:
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.encode(p) for i, p in enumerate(parts))
        if not text or self.odd_spaces(text) or text[0] == "\n":
            return b"".join([self.pieces.get(p, self.packed) for p in self.find(text)])
        # where blanks and line breaks stand alone, the pattern always has a border before them
        first, *units = text.replace("\n", " \n").split(" ")
        return b"".join([*(self.pieces.get(p, self.packed) for p in self.find(first)), *self.units.all(units, self.unit)])

    def decode(self, ids: bytes) -> str:
        """The text of packed ids."""
        numbers = np.frombuffer(ids, "<u4")
        return b"".join([b"".join(map(self.slices.__getitem__, numbers[at : at + (1 << 20)].tolist())) for at in range(0, len(numbers), 1 << 20)]).decode("utf-8", errors="replace")


class Memory:
    """Results by text, the recently used ones of bounded number and size."""

    def __init__(self, most: int, longest: int):
        self.most, self.longest, self.new, self.old = most, longest, {}, {}

    def get(self, text: str, make) -> bytes:
        if (known := self.new.get(text)) is None:
            if (known := self.old.get(text)) is None:
                known = make(text)
            if len(text) <= self.longest:
                if len(self.new) >= self.most:
                    self.old, self.new = self.new, {}
                self.new[text] = known
        return known

    def all(self, texts: list[str], make) -> list[bytes]:
        found = list(map(self.new.get, texts))
        if None in found:
            found = [self.get(t, make) if x is None else x for t, x in zip(texts, found, strict=True)]
        return found


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _coded(path: str):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in sliced(batches):
            ids, texts = [], []
            for text in batch.column(1):
                ids.append(coder.encode(text.as_py()))
                texts.append(hashlib.sha256(coder.decode(ids[-1]).encode()).hexdigest())
            sums = [hashlib.sha256(x).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(sums, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return code


def bpe_encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), ids_sha256, and
    decoded_sha256 of the text that decoding the ids gives back."""
    return docs.select(F.col("doc_id").cast("long"), whole_text()).mapInArrow(_coded(path or default_path()), "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string")


def bpe_decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows with packed ``ids``; null ids count as none."""
    path = path or default_path()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(x.as_py() or b"") for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(read(spark, sf_dir, "documents")).drop("ids")
