"""Near-copies of records with small edits (queries p4_).

A record is the set of its word pairs; two records belong together where the
pairs in both are at least ``threshold`` of those in either. Each pair is hashed
into one of ``GROUPS`` groups and a record's group counts are a point. The sum
of the lesser coordinates of two points bounds how many pairs they share, and so
their similarity, from above; for a node of an R-tree the greatest coordinates
of its points serve in the same way.

One tree over all records would make every record visit most of it. Two similar
records share one of their rarest pairs (a record with n pairs must share
ceil(threshold * n) of them, so one of its n - ceil(threshold * n) + 1 rarest),
and so the first axis of the tree is the rare pair that a point is entered
under. A record's pairs from that one on are the ``rest``: under the rarest pair
that two records share, both have as many left as they have to share. Axes are spread over cells, and a cell is a task's R-trees: each is
packed by (axis, size, counts) and joined with itself from the root down, a
level at a time, dropping node pairs that are disjoint on the first axis or
below the bound. Pairs of points are first told apart by the parities of the
counts of more groups: where they differ, so do the counts. Long records fill
their groups, so they have more of them (``TIERS``), which surviving pairs are
bounded by once more. What is left is verified on the sets of pairs.

A record's point is sent once to each of its cells, however many of its axes lie
there, and a batch of records goes to a cell as one compressed block, so what is
shuffled is a small part of the texts' size.

How rare a pair is, is read from a table of ``RARITY`` counters over all
records; pairs with one counter count as one. Any fixed order of pairs gives
the same result, so the counters' collisions cost time and lose nothing. An
axis whose counter exceeds ``LEAST_HOT`` is cut into buckets, and each two of
them are an axis of their own.

Records with the same set are one class and enter once. Defined results: null
counts as empty; records of one word are like those of the same word only;
records without a word are like nothing; repeated rows of one id are one, and of
an id with several texts one of them counts; very long texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import consistent
from quern.session import staged

#: Coordinates of the trees' points; a record is sent with 4 times as many, and from these sizes on with 16 and 64 times.
GROUPS = 32
TIERS = (400, 1600)
RARITY, PART = 1 << 22, 1 << 16
#: Bits that tell which records have a candidate; prints that a task remembers so as not to send a copy again.
MARKS, SEEN = 1 << 22, 200_000
#: Records whose points are sent together.
BATCH = 10_000
LEAST_HOT = 20_000
FANOUT = 16
#: Entries of one tree; node pairs looked at together; records of a cell, about, which bounds a task's memory.
TREE_POINTS, FRONT, CELL_RECORDS = 40_000, 100_000, 200_000

#: What lies between words.
BETWEEN = r"[^\p{L}\p{N}]+"
ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_pairs(texts: list[str], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each text's adjacent word pairs, one text after the other; their number by text; and that of words."""
    words = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.replace_substring_regex(pa.array(texts, pa.large_string()), BETWEEN, " ")))
    offsets = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    here = coded.dictionary.to_pylist()
    for w in set(here).difference(known):
        known[w] = xxhash.xxh64_intdigest(w)
    none = here.index("") if "" in here else -1
    ids = np.array([known[w] for w in here], np.uint64)[coded.indices.to_numpy()]
    text = np.repeat(np.arange(len(texts)), np.diff(offsets))
    if none >= 0:  # a text without words is split into an empty one
        real = coded.indices.to_numpy() != none
        ids, text = ids[real], text[real]
    sizes = np.bincount(text, minlength=len(texts))
    if len(ids) < 2:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), sizes
    pairs = mixed(ids[:-1] * ODD + (ids[1:] ^ (ids[1:] >> np.uint64(17)))).view(np.int64)
    inside = text[:-1] == text[1:]
    pairs, text = pairs[inside], text[:-1][inside].astype(np.uint16 if len(texts) < 1 << 16 else np.int64)
    order = np.argsort(pairs)
    order = order[np.argsort(text[order], kind="stable")]
    pairs, text = pairs[order], text[order]
    new = np.ones(len(pairs), bool)
    new[1:] = (pairs[1:] != pairs[:-1]) | (text[1:] != text[:-1])
    return pairs[new], np.bincount(text[new], minlength=len(texts)), sizes


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))


def _binaries(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, fields) to (id, x, y, pairs): x and y are a fingerprint of the set, or of the word where there's only one."""
    known: dict[str, int] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            fields = [c.to_pylist() for c in part.columns[1:]]
            texts = [consistent(" ".join(x or "" for x in row)).lower() for row in zip(*fields)]
            if len(known) > 300_000:
                known.clear()
            flat, sizes, n_words = word_pairs(texts, known)
            ends = np.cumsum(sizes)
            keep = np.flatnonzero(n_words)
            prints = np.zeros((len(keep), 2), np.int64)
            for n, i in enumerate(keep.tolist()):
                held = flat[ends[i] - sizes[i] : ends[i]].tobytes() if sizes[i] else "".join(c for c in texts[i] if c.isalnum()).encode()
                prints[n] = np.frombuffer(xxhash.xxh128_digest(held, int(not sizes[i])), np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(keep)), pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), _lists(flat, sizes[keep])], names=["id", "x", "y", "pairs"]
            )


def shared_least(n: np.ndarray | int, threshold: float) -> np.ndarray | int:
    """How many of n pairs a similar record has to share at least."""
    return np.ceil(threshold * np.asarray(n) - 1e-9).astype(np.int64)


def _places(pairs: np.ndarray) -> np.ndarray:
    return (pairs.view(np.uint64) % np.uint64(RARITY)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (pairs) to this task's counters, a row for each part of the table that has any: (part, places and counts)."""
    table = np.zeros(RARITY, np.uint32)
    for batch in batches:
        table += np.bincount(_places(batch.column(0).flatten().to_numpy()), minlength=RARITY).astype(np.uint32)
    parts, rows = [], []
    for part, counts in enumerate(table.reshape(-1, PART)):
        at = np.flatnonzero(counts)
        if len(at):
            parts.append(part)
            rows.append(pa.compress(at.astype(np.uint16).tobytes() + counts[at].tobytes(), "zstd", asbytes=True))
            rows[-1] = len(at).to_bytes(4, "little") + rows[-1]
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), _binaries(rows)], names=["part", "counters"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of all tasks by part, as logarithms of one byte, which keep their order."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = int.from_bytes(row[:4], "little")
            data = pa.decompress(row[4:], 6 * n, "zstd", asbytes=True)
            table = held.setdefault(part, np.zeros(PART, np.int64))
            table[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.uint32, n, 2 * n)
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), _binaries([short(t).tobytes() for t in held.values()])], names=["part", "counters"])


def short(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 64, then eight steps a doubling."""
    return np.where(counts < 64, counts, np.minimum(255, 64 + np.floor(8 * np.log2(np.maximum(counts, 64) / 64)))).astype(np.uint8)


#: The greatest count that each byte stands for; the last one for all above.
LONG = np.array([n if n < 64 else np.ceil(64 * 2 ** ((n - 63) / 8)) for n in range(256)])


def rarities(sets: DataFrame) -> np.ndarray:
    """The table of counters of all sets: RARITY bytes, whatever the data."""
    parts = sets.select("pairs").mapInArrow(_counted, "part int, counters binary").repartition("part").mapInArrow(_summed, "part int, counters binary")
    table = np.zeros(RARITY, np.uint8).reshape(-1, PART)
    found = parts.toArrow()
    for part, row in zip(found["part"].to_pylist(), found["counters"].to_pylist()):
        table[part] = np.frombuffer(row, np.uint8)
    return table.ravel()


def tier_of(sizes: np.ndarray) -> np.ndarray:
    return 1 + np.searchsorted(TIERS, sizes, "left")


def _vectors(flat: np.ndarray, sizes: np.ndarray, tier: int) -> np.ndarray:
    """Group counts of the sets, 255 at most: what is above is known by the size."""
    width = GROUPS << (2 * tier)
    row = np.repeat(np.arange(len(sizes)), sizes)
    group = ((flat >> 7) & (width - 1)).astype(np.int64)
    return np.minimum(np.bincount(row * width + group, minlength=len(sizes) * width), 255).astype(np.uint8).reshape(-1, width)


def _folded(vectors: np.ndarray) -> np.ndarray:
    """The counts of a quarter of the groups."""
    quarter = vectors.shape[1] // 4
    return np.minimum(vectors.reshape(len(vectors), 4, quarter).sum(1, dtype=np.uint16), 255).astype(np.uint8)


def once(batches: Iterator[pa.RecordBatch], pairs: int, wanted: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, ..) that have pairs, of equal prints the first that this task sees, and those whose place in ``wanted`` is marked."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        x = batch.column(0).to_numpy()
        keep = np.diff(batch.column(pairs).offsets.to_numpy()) > 0
        if wanted is not None:
            keep &= wanted[(x & (MARKS - 1)) >> 3] >> (x & 7).astype(np.uint8) & 1 == 1
        for i, print_ in zip(np.flatnonzero(keep).tolist(), zip(x[keep].tolist(), batch.column(1).to_numpy()[keep].tolist())):
            keep[i] = print_ not in seen
            seen.add(print_)
        if len(seen) > SEEN:
            seen.clear()
        if keep.any():
            yield batch.filter(pa.array(keep))


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many, or of some hundred pairs for each of so many; but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= 4000 * rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _blocks(threshold: float, rarity: np.ndarray, cells: int):
    """From (x, y, pairs) to blocks (cell, raw size, block): the points of a batch's records that have an axis in the cell, and their axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(once(batches, 2), BATCH):
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                lists = part.column(2)
                offsets = lists.offsets.to_numpy().astype(np.int64)
                sizes, flat = np.diff(offsets), lists.flatten().to_numpy()
                x, y = part.column(0).to_numpy(), part.column(1).to_numpy()
                row = np.repeat(np.arange(len(sizes)), sizes)
                seen = rarity[_places(flat)]
                order = np.argsort(seen, kind="stable")  # of one counter, by the pair: sets are sorted
                order = order[np.argsort(row[order], kind="stable")]
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                # A counter of one: no other record has the pair
                early = (place < np.repeat(sizes - shared_least(sizes, threshold) + 1, sizes)) & (seen[order] > 1)
                rare, rest = order[early], (np.repeat(sizes, sizes) - place)[early]
                of, axis = row[rare], flat[rare].view(np.uint64)
                side = np.full(len(rare), 2, np.uint8)
                buckets = np.ceil(LONG[seen[rare]] / LEAST_HOT).astype(np.int64)
                if len(buckets) and buckets.max() > 1:
                    own = (mixed(x.view(np.uint64) * ODD)[of] % buckets.astype(np.uint64)).astype(np.int64)
                    times = np.repeat(np.arange(len(of)), buckets)
                    other = np.arange(len(times)) - np.repeat(np.cumsum(buckets) - buckets, buckets)
                    own, of, rest = own[times], of[times], rest[times]
                    low, high = np.minimum(own, other).astype(np.uint64), np.maximum(own, other).astype(np.uint64)
                    axis = np.where(buckets[times] > 1, mixed(axis[times] + ODD * (low * np.uint64(1 << 20) + high + np.uint64(1))), axis[times])
                    side = np.where(own == other, 2, own > other).astype(np.uint8)
                spread = mixed(axis)
                cell = (spread % np.uint64(cells)).astype(np.int64)
                short_axis = (spread >> np.uint64(32)).astype(np.uint32)  # two axes of a cell that fall together give candidates that fail the check
                tier = tier_of(sizes)
                vectors = {int(t): _vectors(flat[np.repeat(tier == t, sizes)], sizes[tier == t], t) for t in np.unique(tier)}
                within = np.zeros(len(sizes), np.int64)
                for t in vectors:
                    within[tier == t] = np.arange((tier == t).sum())
                by = np.lexsort((short_axis, cell))
                cuts = np.flatnonzero(np.diff(cell[by], prepend=-1, append=-1))
                out: list[list] = [[], [], []]
                for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    entry = by[lo:hi]
                    held, who = np.unique(of[entry], return_inverse=True)
                    held = held[np.argsort(tier[held], kind="stable")]
                    who = np.argsort(np.argsort(tier[np.unique(of[entry])], kind="stable"), kind="stable")[who]
                    raw = np.array([len(held), len(entry)], np.int64).tobytes() + x[held].tobytes() + y[held].tobytes() + sizes[held].tobytes() + short_axis[entry].tobytes() + who.astype(np.int32).tobytes() + rest[entry].astype(np.int32).tobytes() + side[entry].tobytes()
                    raw += b"".join(v[within[held[tier[held] == t]]].tobytes() for t, v in sorted(vectors.items()))
                    for column, value in zip(out, (int(cell[entry[0]]), len(raw), pa.compress(raw, "zstd", asbytes=True))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), _binaries(out[2])], names=["cell", "size", "block"])

    return run


#: Parities of a record whose counts reach their limit.
UNKNOWN = np.uint64(0xFFFFFFFFFFFFFFFF)


class Cell:
    """Points of one cell's blocks: prints, sizes, counts at each tier, and entries (axis, point, side).

    A record that several tasks have sent is the first of its points.
    """

    def __init__(self, blocks: list[bytes]):
        prints, sizes, axes, points, rests, sides = [], [], [], [], [], []
        vectors: list[list[np.ndarray]] = [[] for _ in range(len(TIERS) + 2)]
        count = 0
        for raw in blocks:
            n, m = np.frombuffer(raw, np.int64, 2).tolist()
            at = 16
            prints.append(np.frombuffer(raw, np.int64, 2 * n, at).reshape(2, n))
            sizes.append(np.frombuffer(raw, np.int64, n, at + 16 * n))
            at += 24 * n
            axes.append(np.frombuffer(raw, np.uint32, m, at))
            points.append(np.frombuffer(raw, np.int32, m, at + 4 * m).astype(np.int64) + count)
            rests.append(np.frombuffer(raw, np.int32, m, at + 8 * m))
            sides.append(np.frombuffer(raw, np.uint8, m, at + 12 * m))
            at += 13 * m
            have = np.bincount(tier_of(sizes[-1]), minlength=len(vectors))
            for t, k in enumerate(have.tolist()):
                width = GROUPS << (2 * t)
                vectors[t].append(np.frombuffer(raw, np.uint8, k * width, at).reshape(k, width))
                at += k * width
            count += n
        self.prints, self.sizes = np.concatenate(prints, axis=1), np.concatenate(sizes)
        self.axis, self.point, self.rest, self.side = map(np.concatenate, (axes, points, rests, sides))
        order = np.lexsort(self.prints)
        again = np.zeros(count, bool)
        again[1:] = (np.diff(self.prints[:, order], axis=1) == 0).all(0)
        if again.any():
            first = np.empty(count, np.int64)
            first[order] = np.minimum.reduceat(order, np.flatnonzero(~again))[np.cumsum(~again) - 1]
            keep = np.flatnonzero(first[self.point] == self.point)
            self.axis, self.point, self.rest, self.side = self.axis[keep], self.point[keep], self.rest[keep], self.side[keep]
        self.tier = tier_of(self.sizes)
        own = [np.concatenate(v) if v else np.zeros((0, GROUPS << (2 * t)), np.uint8) for t, v in enumerate(vectors)]
        # counts[t]: of all points of tier t and above, folded; row[t] says where
        self.counts, self.row = [], []
        for t in range(len(own)):
            table = np.zeros((int((self.tier >= t).sum()), GROUPS << (2 * t)), np.uint8)
            row = np.cumsum(self.tier >= t) - 1
            for higher in range(t, len(own)):
                v = own[higher]
                for _ in range(higher - t):
                    v = _folded(v)
                table[row[self.tier == higher]] = v
            self.counts.append(table)
            self.row.append(row)
        self.parity = np.packbits(self.counts[1] & 1, axis=1).view(np.uint64)
        self.parity[(self.counts[1] == 255).any(1)] = UNKNOWN

    def reach(self, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Whether the bound of two points, by the finest groups that both have, reaches the threshold."""
        ok = np.ones(len(x), bool)
        tier = np.minimum(self.tier[x], self.tier[y])
        for t in range(1, len(self.counts)):
            at = np.flatnonzero(tier == t)
            for part in np.split(at, range(20_000, len(at), 20_000)):
                a, b = self.counts[t][self.row[t][x[part]]], self.counts[t][self.row[t][y[part]]]
                ok[part] = bound(a, b, self.sizes[x[part]], self.sizes[y[part]]) * (1 + threshold) >= threshold * (self.sizes[x[part]] + self.sizes[y[part]]) - 1e-9
        return ok


def bound(a: np.ndarray, b: np.ndarray, s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """How many pairs sets of s and t pairs can share at most; counts of 255 may stand for more, which the sizes tell."""
    total = np.minimum(a, b).sum(1, dtype=np.uint32).astype(np.int64)
    if len(a) and (a.max() == 255 or b.max() == 255):
        total += np.minimum(s - a.sum(1, dtype=np.uint32), t - b.sum(1, dtype=np.uint32))
    return np.minimum(total, np.minimum(s, t))


class RTree:
    """Points packed in order of (axis, size, counts); level 0 are the points themselves, the last level one root."""

    def __init__(self, axis: np.ndarray, size: np.ndarray, counts: np.ndarray, rest: np.ndarray | None = None, parity: np.ndarray | None = None):
        order = np.lexsort((*counts.T[:3], size, axis))
        self.order = order
        self.parity = None if parity is None else [np.ascontiguousarray(p) for p in parity[order].T]
        axis, size, counts = axis[order], size[order], counts[order]
        over = size - counts.sum(1, dtype=np.uint32)  # pairs above the counts' limit
        rest = size if rest is None else rest[order].astype(np.int64)
        self.levels = [(axis, axis, size, rest, counts, over)]  # least and greatest axis, least size, greatest rest, counts and excess
        while len(self.levels[-1][0]) > 1:
            a, b, s, r, c, o = self.levels[-1]
            edge = np.arange(0, len(a), FANOUT)
            top = np.maximum.reduceat
            self.levels.append((a[edge], top(b, edge), np.minimum.reduceat(s, edge), top(r, edge), top(c, edge), top(o, edge)))

    def close(self, level: int, x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
        """Whether nodes x and y of a level can hold points entered under one axis whose bound reaches the threshold."""
        a, b, s, r, c, o = self.levels[level]
        ok = a[x] == a[y] if level == 0 else (a[x] <= b[y]) & (a[y] <= b[x])
        at = np.flatnonzero(ok)
        far = np.minimum(r[x[at]], r[y[at]]) * (1 + threshold) < threshold * (s[x[at]] + s[y[at]]) - 1e-9
        ok[at[far]] = False
        at = at[~far]
        if level == 0 and self.parity and len(at):
            u, v = x[at], y[at]
            unlike = sum(np.bitwise_count(p[u] ^ p[v]).astype(np.uint16) for p in self.parity)
            unlike[(self.parity[0][u] == UNKNOWN) | (self.parity[0][v] == UNKNOWN)] = 0
            far = (s[u] + s[v] - unlike) * ((1 + threshold) / 2) < threshold * (s[u] + s[v]) - 1e-9
            ok[at[far]] = False
            at = at[~far]
        if len(at):
            x, y = x[at], y[at]
            overlap = np.minimum(c[x], c[y]).sum(1, dtype=np.uint32) + np.minimum(o[x], o[y])
            ok[at] = overlap * (1 + threshold) >= threshold * (s[x] + s[y]) - 1e-9
        return ok

    def joined(self, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of points (as given) that survive the bounds at every level."""
        zero = np.zeros(1, np.int64)
        stack = [(len(self.levels) - 1, zero, zero)]
        while stack:
            level, x, y = stack.pop()
            if level == 0:
                if len(x):
                    yield self.order[x], self.order[y]
                continue
            if len(x) > FRONT // FANOUT**2:
                cut = max(1, FRONT // FANOUT**2)
                stack += [(level, x[i : i + cut], y[i : i + cut]) for i in range(0, len(x), cut)]
                if len(x) > cut:
                    level, x, y = stack.pop()
            below = len(self.levels[level - 1][0])
            child = np.arange(FANOUT)
            u = np.repeat(x[:, None] * FANOUT + child, FANOUT, axis=1).ravel()
            v = np.tile(y[:, None] * FANOUT + child, (1, FANOUT)).ravel()
            ok = (u < below) & (v < below) & ((u < v) if level == 1 else (u <= v))
            u, v = u[ok], v[ok]
            keep = self.close(level - 1, u, v, threshold)
            stack.append((level - 1, u[keep], v[keep]))


def cell_candidates(cell: Cell, threshold: float) -> Iterator[np.ndarray]:
    """Pairs of prints (rows ax, ay, bx, by, the lesser first) whose bound reaches the threshold."""
    order = np.argsort(cell.axis, kind="stable")
    axis = cell.axis[order]
    edges = np.append(np.flatnonzero(np.diff(axis)) + 1, len(axis))
    low, found, held = 0, [], 0
    while low < len(axis):
        high = int(edges[min(np.searchsorted(edges, low + TREE_POINTS), len(edges) - 1)])
        entry = order[low:high]
        point, side = cell.point[entry], cell.side[entry]
        rank = np.cumsum(np.diff(axis[low:high], prepend=axis[low]) != 0)
        for x, y in RTree(rank, cell.sizes[point], cell.counts[0][point], cell.rest[entry], cell.parity[point]).joined(threshold):
            ok = (point[x] != point[y]) & ((side[x] != side[y]) | (side[x] == 2))
            x, y = point[x[ok]], point[y[ok]]
            key = np.unique(np.minimum(x, y) * len(cell.sizes) + np.maximum(x, y))
            found.append(key)
            held += len(key)
            if held > 2_000_000:
                found = [np.unique(np.concatenate(found))]
                held = len(found[0])
                if held > 1_000_000:
                    yield _reaching(cell, found[0], threshold)
                    found, held = [], 0
        low = high
    if found:
        yield _reaching(cell, np.unique(np.concatenate(found)), threshold)


def _reaching(cell: Cell, key: np.ndarray, threshold: float) -> np.ndarray:
    x, y = key // len(cell.sizes), key % len(cell.sizes)
    ok = cell.reach(x, y, threshold)
    a, b = cell.prints[:, x[ok]], cell.prints[:, y[ok]]
    swap = (a[0] > b[0]) | (a[0] == b[0]) & (a[1] > b[1])
    return np.concatenate([np.where(swap, b, a), np.where(swap, a, b)])


def _candidates(threshold: float):
    """From blocks, all of a cell one after another, to candidates (ax, ay, bx, by)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            for found in cell_candidates(Cell(held), threshold):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["ax", "ay", "bx", "by"])

        for batch in batches:
            for cell, size, block in zip(*(c.to_pylist() for c in batch.columns)):
                if held and cell != last:
                    yield from flush()
                    held = []
                last = cell
                held.append(pa.decompress(block, size, "zstd", asbytes=True))
        if held:
            yield from flush()

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (x) to this task's marks by part: (part, bits)."""
    bits = np.zeros(MARKS, bool)
    for batch in batches:
        bits[batch.column(0).to_numpy() & (MARKS - 1)] = True
    parts = bits.reshape(-1, PART)
    some = np.flatnonzero(parts.any(1))
    rows = [pa.compress(np.packbits(parts[i], bitorder="little").tobytes(), "zstd", asbytes=True) for i in some.tolist()]
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _binaries(rows)], names=["part", "bits"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            bits = np.frombuffer(pa.decompress(row, PART // 8, "zstd", asbytes=True), np.uint8)
            held[part] = held[part] | bits if part in held else bits
    yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), _binaries([b.tobytes() for b in held.values()])], names=["part", "bits"])


def marks(prints: DataFrame) -> np.ndarray:
    """A bit for each remainder of the prints (x): MARKS bits, whatever the data. More prints mark more, and none is lost."""
    table = np.zeros(MARKS // 8, np.uint8).reshape(-1, PART // 8)
    found = prints.mapInArrow(_marked, "part int, bits binary").repartition("part").mapInArrow(_united, "part int, bits binary").toArrow()
    for part, row in zip(found["part"].to_pylist(), found["bits"].to_pylist()):
        table[part] = np.frombuffer(row, np.uint8)
    return table.ravel()


def near_copies(df: DataFrame, key: str, fields: list[str], threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) between classes of records with equal sets, and members (rep, id); a and b are reps, a < b."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), *[F.col(f).cast("string").alias(f"f{n}") for n, f in enumerate(fields)])
    sets = staged(rows.mapInArrow(_sets, "id long, x long, y long, pairs array<long>"), "sets")
    seen = sets.groupBy("id").agg(F.min(F.struct("x", "y")).alias("p")).select("id", "p.x", "p.y")
    reps = staged(seen.groupBy("x", "y").agg(F.min("id").alias("rep")), "reps")
    members = seen.join(reps, ["x", "y"]).select("rep", "id")
    table = spark.sparkContext.broadcast(rarities(sets))  # RARITY bytes
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells = max(partitions, -(-32 * reps.count() // CELL_RECORDS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(threshold, table.value, cells)(batches)

    prints = "ax long, ay long, bx long, by long"
    spread = sets.select("x", "y", "pairs").mapInArrow(blocks, "cell int, size long, block binary")
    spread = spread.repartition(cells, "cell").sortWithinPartitions("cell")
    candidates = staged(spread.mapInArrow(_candidates(threshold), prints).distinct(), "candidates")
    ends = candidates.select(F.col("ax").alias("x"), F.col("ay").alias("y"), "*").unionByName(candidates.select(F.col("bx").alias("x"), F.col("by").alias("y"), "*"))
    bits = spark.sparkContext.broadcast(marks(ends.select("x")))  # MARKS bits

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return once(batches, 2, bits.value)

    # Only the sets of records that have a candidate are shuffled, to it; both meet there
    held = sets.select("x", "y", "pairs").mapInArrow(wanted, "x long, y long, pairs array<long>").groupBy("x", "y").agg(F.first("pairs").alias("pairs"))
    both = held.join(ends, ["x", "y"]).groupBy("ax", "ay", "bx", "by").agg(F.collect_list("pairs").alias("sets")).withColumn("both", F.size(F.array_intersect(F.col("sets")[0], F.col("sets")[1])))
    similarity = F.col("both") / (F.size(F.col("sets")[0]) + F.size(F.col("sets")[1]) - F.col("both"))
    links = both.withColumn("similarity", similarity).where(F.col("similarity") >= threshold - 1e-12)
    for end in ("a", "b"):
        links = links.join(reps.select(F.col("x").alias(f"{end}x"), F.col("y").alias(f"{end}y"), F.col("rep").alias(end)), [f"{end}x", f"{end}y"])
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity"), members


def near_pairs(df: DataFrame, key: str, fields: list[str], threshold: float = 0.7, names: tuple[str, str] = ("faq_id_a", "faq_id_b")) -> DataFrame:
    """Distinct pairs of ids at or above the threshold, the smaller id first, members of equal sets included."""
    links, members = near_copies(df, key, fields, threshold)
    members = staged(members, "members")
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(within).where("x < y").distinct().toDF(*names)


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) of links (a, b): the least id that each end is connected with, by large and small stars.

    Each round hangs the greater neighbours of a node, then the lesser ones, on
    its least neighbour; the number of rounds is logarithmic in practice and the
    edges never grow. Every round is a written table, so no lineage piles up.
    """
    edges = staged(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = staged(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        changed = small.exceptAll(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).limit(1).count()
        fewer = changed == 0 and small.count() == edges.count()
        edges = small
        if fewer:
            break
    else:
        raise RuntimeError("the stars did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()


def near_groups(df: DataFrame, key: str, fields: list[str], threshold: float = 0.7) -> DataFrame:
    """One row per record: (``key``, group_id, class_id, links); group_id is the least id that it's connected with by links."""
    links, members = near_copies(df, key, fields, threshold)
    links, members = staged(links.select("a", "b"), "links"), staged(members, "members")
    ends = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    found = components(links).select(F.col("id").alias("rep"), "component")
    known = members.join(found, "rep", "left").join(ends, "rep", "left").select("id", "rep", F.coalesce("component", "rep").alias("component"), "links")
    base = df.select(F.col(key).cast("long").alias("id")).distinct().join(known, "id", "left")
    return base.select(
        F.col("id").alias(key), F.coalesce("component", "id").alias("group_id"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
