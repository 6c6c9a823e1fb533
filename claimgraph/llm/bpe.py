"""Byte-pair encoding of whole texts by a public vocabulary, in numpy over many words at once.

A text is cut at single spaces into pieces, which repeat; only pieces not seen
before are split by the vocabulary's pattern, and only words not seen before are
encoded. Those words go into padded matrices by length; in each round every row
merges its leftmost pair of least rank, looked up in a hash table, and is
compacted. Rows without a pair to merge leave the matrix. A long word is a row of its
own that merges all places of its least rank in a round.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the byte-level vocabularies split text before the merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: A worker forgets its pieces and words when it holds more than this many tokens of them; results do not depend on it.
CACHE_TOKENS = 4_000_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.int32(2**31 - 1)
_UNSAFE = -1
#: Words longer than 2^(LAST_BUCKET - 1) bytes share the last bucket, longest first; a matrix has at most about MATRIX_CELLS cells. Words of more than LONG bytes are merged alone.
LAST_BUCKET, MATRIX_CELLS, LONG = 6, 1 << 21, 256


class Merges:
    """The pairs that merge, as an open-addressing hash table: pair -> token, whose number is its rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            if len(token) > 1:
                a, b = _last_merge(token, rank, ranks)
                left.append(a), right.append(b), made.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = int(np.ceil(np.log2(4 * len(keys) + 16)))
        size = 1 << self.bits
        self.keys = np.full(size, np.uint64(2**64 - 1))
        self.values = np.full(size, _NONE, np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        values = np.array(made, np.int32)
        self.probes = 0
        while len(todo):
            at = slots[todo]
            free = self.values[at] == _NONE
            _, first = np.unique(at, return_index=True)
            chosen = np.zeros(len(todo), bool)
            chosen[first] = True
            placed = free & chosen
            self.keys[at[placed]], self.values[at[placed]] = keys[todo[placed]], values[todo[placed]]
            todo = todo[~placed]
            slots[todo] = (slots[todo] + 1) & (size - 1)
            self.probes += 1

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or the greatest int32."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        flat = keys.ravel()
        slots = self._slots(flat)
        found = np.where(self.keys[slots] == flat, self.values[slots], _NONE)
        open_ = np.flatnonzero((found == _NONE) & (self.values[slots] != _NONE))
        for _ in range(self.probes):
            if not len(open_):
                break
            slots[open_] = (slots[open_] + 1) & (len(self.keys) - 1)
            at = slots[open_]
            hit = self.keys[at] == flat[open_]
            found[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (self.values[at] != _NONE)]
        return found.reshape(keys.shape)

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        """The tokens of each word, all words merged side by side."""
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        buckets = np.minimum(np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64), LAST_BUCKET)
        for i in np.flatnonzero(lengths > LONG):
            out[i] = self._alone(words[i])
        for b in np.unique(buckets):
            rows = np.flatnonzero((buckets == b) & (lengths <= LONG))
            rows = rows[np.argsort(-lengths[rows], kind="stable")]
            while len(rows):
                step = max(1, MATRIX_CELLS // int(max(lengths[rows[0]], 1)))
                self._bucket(words, lengths, rows[:step], out)
                rows = rows[step:]
        return out

    def _alone(self, word: bytes) -> np.ndarray:
        """The tokens of one word, all places of the least rank merged at once, leftmost first.

        A merge makes only pairs of higher rank, so all places of a rank merge before
        any other: a round for each rank that occurs, not for each letter.
        """
        tokens = self.byte[np.frombuffer(word, np.uint8)]
        pairs = self.ranks(tokens[:-1], tokens[1:])
        while len(pairs):
            best = pairs.min()
            if best == _NONE:
                break
            at = np.flatnonzero(pairs == best)
            touching = np.diff(at, prepend=-2) == 1
            if touching.any():
                # Of overlapping places every second one merges, from the left.
                number = np.arange(len(at))
                at = at[(number - np.maximum.accumulate(np.where(touching, 0, number))) % 2 == 0]
            tokens[at] = best
            tokens, pairs = np.delete(tokens, at + 1), np.delete(pairs, at)
            at = at - np.arange(len(at))
            for side in (at - 1, at):
                side = side[(side >= 0) & (side < len(pairs))]
                pairs[side] = self.ranks(tokens[side], tokens[side + 1])
        return tokens

    def _bucket(self, words: list[bytes], lengths: np.ndarray, rows: np.ndarray, out: list[np.ndarray]) -> None:
        n = lengths[rows].copy()
        width = int(n.max(initial=0))
        matrix = np.full((len(rows), width), -1, np.int32)
        matrix[np.arange(width) < n[:, None]] = self.byte[np.frombuffer(b"".join(words[r] for r in rows), np.uint8)]
        pairs = self._pairs(matrix, n)
        while len(rows):
            best = pairs.min(axis=1, initial=_NONE) if pairs.shape[1] else np.full(len(rows), _NONE)
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[rows[k]] = matrix[k, : n[k]].copy()
                rows, matrix, pairs, n, best = rows[~done], matrix[~done], pairs[~done], n[~done], best[~done]
                if not len(rows):
                    return
                width = int(n.max())
                matrix, pairs = matrix[:, :width], pairs[:, : width - 1]
            at = pairs.argmin(axis=1)
            every = np.arange(len(rows))
            # Compaction: what stands right of the merged pair moves one to the left.
            cells = np.arange(matrix.shape[1] - 1)
            source = cells + (cells > at[:, None])
            matrix = np.take_along_axis(matrix, source, axis=1)
            matrix[every, at] = best
            n -= 1
            width = matrix.shape[1]
            fresh = np.full((len(rows), max(width - 1, 0)), _NONE, np.int32)
            if width > 1:
                source = np.arange(width - 1)
                source = source + (source >= at[:, None])
                fresh = np.take_along_axis(pairs, source, axis=1)
                for side in (at - 1, at):
                    ok = (side >= 0) & (side < n - 1)
                    k, s = every[ok], side[ok]
                    fresh[k, s] = self.ranks(matrix[k, s], matrix[k, s + 1])
                fresh[np.arange(width - 1) >= (n - 1)[:, None]] = _NONE
            pairs = fresh

    def _pairs(self, matrix: np.ndarray, n: np.ndarray) -> np.ndarray:
        if matrix.shape[1] < 2:
            return np.full((len(matrix), 0), _NONE, np.int32)
        pairs = np.full((len(matrix), matrix.shape[1] - 1), _NONE, np.int32)
        held = np.arange(pairs.shape[1]) < (n - 1)[:, None]
        pairs[held] = self.ranks(matrix[:, :-1][held], matrix[:, 1:][held])
        return pairs


def _last_merge(token: bytes, rank: int, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens whose merge gives `token`: what its bytes come to by merges of lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        options = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
        i = min(range(len(options)), key=options.__getitem__)
        if options[i] >= rank:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    if len(parts) != 2:
        raise ValueError(f"token {rank} is no merge of two others")
    return ranks[parts[0]], ranks[parts[1]]


class Encoder:
    """Encodes texts by a vocabulary of ranks; keeps what it learnt of pieces and words, within CACHE_TOKENS."""

    def __init__(self, vocabulary: str = DEFAULT_VOCABULARY):
        import regex

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.merges = Merges(ranks)
        self.split = regex.compile(PATTERN).findall
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.pieces: dict[str, int] = {}
        self.after: dict[str, int] = {}  # by the piece without its leading space
        self.flat = np.zeros(1 << 16, np.int32)
        self.starts: list[int] = []
        self.sizes: list[int] = []
        self.used = 0
        self.arrays: tuple[np.ndarray, np.ndarray] | None = None

    def _learn(self, fresh: dict[str, None]) -> None:
        """Encode new pieces (with their leading space, if any)."""
        if not fresh:
            return
        split = {p: self.split(p) for p in fresh}
        unknown = list(dict.fromkeys(w for ws in split.values() for w in ws if w not in self.words))
        encoded = self.merges.encode([w.encode("utf-8", "replace") for w in unknown])
        self.words.update(zip(unknown, encoded, strict=True))
        for piece, words in split.items():
            tokens = self.words[words[0]] if len(words) == 1 else np.concatenate([self.words[w] for w in words]) if words else np.zeros(0, np.int32)
            while self.used + len(tokens) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
            self.flat[self.used : self.used + len(tokens)] = tokens
            self.pieces[piece] = len(self.starts)
            if piece[:1] == " ":
                self.after[piece[1:]] = len(self.starts)
            self.starts.append(self.used)
            self.sizes.append(len(tokens))
            self.used += len(tokens)
        self.arrays = None

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The text in pieces that encode alone: a cut before a single space after a character that is no white space."""
        parts = text.split(" ")
        pieces, held = [], parts[0]
        for p in parts[1:]:
            if held and not held[-1].isspace():
                pieces.append(held)
                held = " " + p
            else:
                held += " " + p
        pieces.append(held)
        return pieces

    def _places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The piece numbers of all texts, and how many each text has."""
        if self.used > CACHE_TOKENS:
            self._forget()
        parts, firsts, counts = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                own = text.split(" ")
                counts[i] = len(own)
                firsts.append(own[0])
                parts += own
        fresh = set(parts)
        fresh.difference_update(self.after)
        # A part that is empty or ends in white space belongs together with the next: its text is cut more carefully.
        unsafe = [p for p in fresh if not p or p[-1].isspace()]
        self.after.update(dict.fromkeys(unsafe, _UNSAFE))
        fresh.difference_update(unsafe)
        self._learn({f" {p}": None for p in fresh} | {p: None for p in firsts if p not in self.pieces})
        codes = np.fromiter(map(self.after.__getitem__, parts), np.int64, len(parts))
        ends = np.cumsum(counts)
        begins = ends - counts
        unsafe_at = np.flatnonzero(codes == _UNSAFE)
        codes[begins[counts > 0]] = np.fromiter(map(self.pieces.__getitem__, firsts), np.int64, len(firsts))
        if len(unsafe_at):
            cut = {i: self._cut(texts[i]) for i in np.unique(np.searchsorted(ends, unsafe_at, side="right")).tolist()}
            self._learn({p: None for own in cut.values() for p in own if p not in self.pieces})
            pieces, at, get = [], 0, self.pieces.__getitem__
            for i, own in cut.items():
                pieces += [codes[at : begins[i]], np.fromiter(map(get, own), np.int64, len(own))]
                at = ends[i]
                counts[i] = len(own)
            codes = np.concatenate([*pieces, codes[at:]])
        return codes, counts

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self.arrays is None:
            self.arrays = np.array(self.starts, np.int64), np.array(self.sizes, np.int64)
        return self.arrays

    def sizes_of(self, texts: list[str | None]) -> np.ndarray:
        """The number of tokens of each text; 0 for null and empty ones."""
        places, counts = self._places(texts)
        running = np.concatenate([[0], np.cumsum(self._tables()[1][places])]) if len(places) else np.zeros(1, np.int64)
        ends = np.cumsum(counts)
        return running[ends] - running[ends - counts]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All tokens one after the other, and the offsets of the texts in them."""
        places, counts = self._places(texts)
        if not len(places):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        starts, sizes = self._tables()
        begin, size = starts[places], sizes[places]
        ends = np.cumsum(size)
        index = np.arange(int(ends[-1])) + np.repeat(begin - (ends - size), size)
        upto = np.concatenate([[0], ends])
        offsets = np.concatenate([[0], upto[np.cumsum(counts)]])
        return self.flat[index], offsets


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str = DEFAULT_VOCABULARY) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(vocabulary)


#: Texts are taken from a batch in blocks of about so many bytes; a single longer text is a block.
BLOCK_CHARS = 6_000_000


def blocks(texts: pa.Array) -> Iterator[list[str | None]]:
    """The texts as Python strings, some at a time."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
    number = (np.cumsum(sizes) - sizes) // BLOCK_CHARS
    starts = np.flatnonzero(np.diff(number, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(texts)], strict=True):
        yield texts.slice(a, b - a).to_pylist()


def encode(rows: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, ids: str = "ids") -> DataFrame:
    """key, ids: the tokens of each text, without special tokens (their spellings are ordinary text).

    A null or empty text gives an empty list. Rows keep their number; no exchange.
    Other columns are ignored. The vocabulary file is read by each worker, so its
    path must exist on the executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        for batch in batches:
            at = 0
            for texts in blocks(batch.column(1)):
                flat, offsets = model.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), lists], names=["key", "ids"])
                at += len(texts)

    kind = rows.schema[key].dataType.simpleString()
    shaped = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return shaped.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), F.col("ids").alias(ids))


def count_tokens(rows: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, name: str = "tokens") -> DataFrame:
    """key, tokens (long): the number of tokens of each text, 0 for a null or empty one; as `encode`, without the lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(vocabulary)
        for batch in batches:
            sizes = [model.sizes_of(texts) for texts in blocks(batch.column(1))]
            total = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total.astype(np.int64))], names=["key", "tokens"])

    kind = rows.schema[key].dataType.simpleString()
    shaped = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return shaped.mapInArrow(run, f"key {kind}, tokens bigint").select(F.col("key").alias(key), F.col("tokens").alias(name))
