"""Encoding texts with a public byte-level BPE vocabulary (queries p6_, p7_).

A text is cut into words by the vocabulary's own pattern. Each new word of a
batch is merged over a segment tree: leaf i holds the rank of the pair that
starts at symbol i, joined with i so that ties fall to the left; the root is
the next merge; a merge changes three leaves and their paths to the root. The
trees of all words of one length class are rows of one array and are merged in
step, so a batch costs a few hundred array operations. Words already encoded by
this worker are taken from a table of bounded size.

Defined results: null and empty texts give an empty list; names of special
tokens are ordinary text; very long texts and very long words are encoded whole.
"""

from __future__ import annotations

import base64
import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words kept by a worker; the table is emptied when it's full.
TABLE_WORDS = 400_000
#: Characters encoded at a time, which bounds a worker's memory.
CHUNK_CHARS = 2_000_000

_white = "\t-\r \x85\xa0  -     　"


def _numbers() -> str:
    """A character class body of the numbers that aren't decimal digits."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


@functools.lru_cache(1)
def word_pattern() -> re.Pattern:
    """The byte-level vocabularies' pattern, in terms of the standard library's classes."""
    n = _numbers()
    return re.compile(rf"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_{n}]+| ?[\d{n}]+| ?(?:[^{_white}\w]|_)+|[{_white}]+(?![^{_white}])|[{_white}]+")


FREE = np.int64(1) << 62


class Encoder:
    """Words to ids by a vocabulary file of ranks (``base64(token) rank`` a line)."""

    def __init__(self, path: str):
        ranks: dict[bytes, int] = {}
        with open(path, "rb") as file:
            for line in file:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append((left << 20) | right)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys, self.merged = np.array(keys, np.int64)[order], np.array(merged, np.int64)[order]
        self.pairs = dict(zip(keys, merged))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.int32)
        self.used = 0
        self.starts: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.table: tuple[np.ndarray, np.ndarray] | None = None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], FREE >> 20)

    def together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of at most ``P`` bytes, P a power of two, as one array and its row lengths."""
        n = len(words)
        size = np.array([len(w) for w in words])
        p = 1 << max(1, int(size.max() - 1).bit_length())
        symbols = np.zeros((n, p), np.int64)
        inside = np.arange(p) < size[:, None]
        symbols[inside] = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        after = np.where(np.arange(1, p + 1) < size[:, None], np.arange(1, p + 1), -1)
        before = np.broadcast_to(np.arange(-1, p - 1), (n, p)).copy()
        alive = inside.copy()
        tree = np.full((n, 2 * p), FREE, np.int64)
        row, col = np.nonzero(after >= 0)
        tree[row, p + col] = (self.rank(symbols[row, col], symbols[row, col + 1]) << 20) | col
        level = p
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        limit = FREE >> 20 << 20
        row = np.flatnonzero(tree[:, 1] < limit)
        while len(row):
            root = tree[row, 1]
            i = root & 0xFFFFF
            j = after[row, i]
            k = after[row, j]
            h = before[row, i]
            symbols[row, i] = root >> 20
            after[row, i] = k
            alive[row, j] = False
            some = k >= 0
            before[row[some], k[some]] = i[some]
            right = np.full(len(row), FREE, np.int64)
            right[some] = (self.rank(symbols[row[some], i[some]], symbols[row[some], k[some]]) << 20) | i[some]
            left = np.full(len(row), FREE, np.int64)
            some = h >= 0
            left[some] = (self.rank(symbols[row[some], h[some]], symbols[row[some], i[some]]) << 20) | h[some]
            tree[row, p + j] = FREE
            tree[row, p + i] = right
            tree[row[some], p + h[some]] = left[some]
            paths = [(row, (p + j) >> 1), (row, (p + i) >> 1), (row[some], (p + h[some]) >> 1)]
            for _ in range(p.bit_length() - 1):
                for at, node in paths:
                    tree[at, node] = np.minimum(tree[at, 2 * node], tree[at, 2 * node + 1])
                paths = [(at, node >> 1) for at, node in paths]
            row = row[tree[row, 1] < limit]
        return symbols[alive].astype(np.int32), alive.sum(1)

    def alone(self, word: bytes) -> np.ndarray:
        """Ids of one long word, over a tree in a plain list."""
        get, void = self.pairs.get, int(FREE)
        symbols = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbols)
        p = 1 << (n - 1).bit_length()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        after[-1] = -1

        def leaf(i: int) -> int:
            j = after[i]
            r = get((symbols[i] << 20) | symbols[j]) if j >= 0 else None
            return void if r is None else (r << 32) | i

        tree = [void] * (2 * p)
        tree[p : p + n] = [leaf(i) for i in range(n)]
        for node in range(p - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        alive = bytearray(b"\x01" * n)
        while (root := tree[1]) < void:
            i = root & 0xFFFFFFFF
            j = after[i]
            symbols[i], after[i], alive[j] = root >> 32, after[j], 0
            if after[j] >= 0:
                before[after[j]] = i
            changed = [(i, leaf(i)), (j, void)]
            if (h := before[i]) >= 0:
                changed.append((h, leaf(h)))
            for at, value in changed:
                node = p + at
                tree[node] = value
                while node > 1:
                    node >>= 1
                    least = min(tree[2 * node], tree[2 * node + 1])
                    if tree[node] == least:
                        break
                    tree[node] = least
        return np.array([s for s, a in zip(symbols, alive) if a], np.int32)

    def learn(self, words: list[str]) -> None:
        """Put new words into the table."""
        groups: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            b = w.encode("utf-8", "surrogatepass")
            groups.setdefault(max(1, (len(b) - 1).bit_length()), []).append((w, b))
        for power, group in groups.items():
            step = max(1, (1 << 19) >> power)
            for at in range(0, len(group), step):
                part = group[at : at + step]
                if power <= 8:
                    ids, sizes = self.together([b for _, b in part])
                else:
                    rows = [self.alone(b) for _, b in part]
                    ids, sizes = np.concatenate(rows), np.array([len(r) for r in rows])
                while self.used + len(ids) > len(self.flat):
                    self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
                self.flat[self.used : self.used + len(ids)] = ids
                known = len(self.index)
                self.index.update((w, known + n) for n, (w, _) in enumerate(part))
                self.starts.append(self.used + np.cumsum(sizes) - sizes)
                self.sizes.append(sizes)
                self.used += len(ids)
        self.table = None

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place in the table's flat ids and its number of ids."""
        if len(self.index) > TABLE_WORDS:
            self.clear()
        missing = set(words).difference(self.index)
        if missing:
            self.learn(sorted(missing))
        if self.table is None:
            self.starts, self.sizes = [np.concatenate(self.starts)], [np.concatenate(self.sizes)]
            self.table = (self.starts[0], self.sizes[0])
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        return self.table[0][at], self.table[1][at]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        _, sizes, per_text = self._cut(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        edges = np.concatenate([[0], np.cumsum(per_text)])
        return ends[edges[1:]] - ends[edges[:-1]]

    def _cut(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        find = word_pattern().findall
        words: list[str] = []
        per_text = np.zeros(len(texts), np.int64)
        for n, text in enumerate(texts):
            if text:
                found = find(text)
                per_text[n] = len(found)
                words += found
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), per_text
        starts, sizes = self.words(words)
        return starts, sizes, per_text

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and the number of each text."""
        starts, sizes, per_text = self._cut(texts)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        place = np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1])
        edges = np.concatenate([[0], np.cumsum(per_text)])
        return self.flat[place], ends[edges[1:]] - ends[edges[:-1]]


@functools.lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about CHUNK_CHARS bytes of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(sizes) - sizes) // CHUNK_CHARS
    edges = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, 1) if batch.num_rows else ():
                flat, sizes = own.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["key", "ids"])

    return run


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            for part in slices(batch, 1) if batch.num_rows else ():
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.counts(part.column(1).to_pylist()), pa.int64())], names=["key", "n"])

    return run


def encoded(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(``key``, ids): one narrow pass without a shuffle; repeated rows stay repeated."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(_ids(path), schema).toDF(key, "ids")


def token_counts(df: DataFrame, key: str, text: str, path: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(``key``, n_tokens): as ``encoded``, but only the lengths leave the worker."""
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n", T.LongType())])
    return df.select(key, text).mapInArrow(_counts(path), schema).toDF(key, "n_tokens")
