"""Long exact spans shared between records (queries p8_).

Streaming every document through an index of every other shard would cost the
square of the number of shards, so documents are first routed to the shards
where they can have a match. Of each text, the k-grams are hashed and the least
of each window of w starts is kept; with k + w - 1 = ``span`` every run of that
length holds a kept k-gram, the same one in both texts. A k-gram kept in two
different texts is shared, and its lead is the least text that holds it. All
passages (a shared k-gram with what lies around it) of one lead form a shard of
related text. Routing only says who is streamed where; matches are found by:

A shard's passages are indexed as a compressed FM-index: bit vectors of a
wavelet matrix over the Burrows-Wheeler transform with block counts, every
``RATE``-th suffix, and a bit for each suffix whose document isn't that of the
one before. The passages are then streamed against it. Backward search runs to
the left from every (span / 2)-th character and gives the matching statistic
there: how long the text that ends there is also in another document, which is
known by the bits of its suffix interval. A run of ``span`` characters holds a
stretch between two of these ends, so where the statistic falls short of half a
span nothing is shared; most ends of text that isn't shared fall out after a few
steps. The intervals of the others are located by the sampled suffixes, the
matches extended both ways, and those of at least ``span`` characters reported.

Exact copies are joined into one class by fingerprint before that and return as
members. The counts by k-gram are aggregated before they are shuffled. A shard
above a size bound is cut into buckets, and each pair of buckets is a task.

Defined results: null, empty and shorter texts have no spans; "character" is a
Unicode code point; repeated rows of one id aren't different documents; ties
and very long texts need nothing special.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import staged

#: Characters hashed at a time; characters of a shard above which it is cut into buckets; of passages indexed together.
CHUNK_CHARS, SHARD_CHARS, INDEX_CHARS = 1_000_000, 1_000_000, 1_000_000
#: Fingerprints that a task remembers so as not to hash a copy again.
SEEN = 200_000
#: Of so many suffixes of an index one is kept; occurrences located at a time.
RATE, LOCATED = 8, 200_000

ODD, STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD
MASK = (1 << 64) - 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, modulo 2^64."""
    size = max(1 << 20, 1 << n.bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, STEP, np.uint64)
        down = np.full(size, pow(STEP, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
    return _powers[size]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each window of ``width`` values that starts at a place."""
    least, size = values, 1
    while size * 2 <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def kept_grams(texts: list[str], k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of the k-grams kept by windows of w starts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    codes = codes_of("".join(texts))
    n = len(codes)
    if n < k + w - 1:
        return (np.zeros(0, np.int64),) * 3
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.multiply(codes.astype(np.uint64) + np.uint64(0x51ED27), np.uint64(ODD), out=sums[1:])
    sums[1:] *= up[:n]
    np.cumsum(sums, out=sums)
    value = sums[k:] - sums[:-k]
    value *= down[: len(value)]
    value ^= value >> np.uint64(32)
    value *= np.uint64(MIX)
    value ^= value >> np.uint64(29)
    key = value & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(len(key), dtype=np.uint64)
    void = np.uint64(MASK)
    for end in ends[:-1].tolist():
        key[max(0, end - k + 1) : end] = void
    least = sliding_least(key, w)
    place = least[np.flatnonzero(np.diff(least, prepend=void))]
    place = np.unique((place[place != void] & np.uint64(0xFFFFFFFF)).astype(np.int64))
    text = np.searchsorted(ends, place, "right")
    return text, place - (ends - sizes)[text], value[place].view(np.int64)


def _anchors(span: int, k: int, repeats: bool = False):
    """(gram, doc, place) of the kept k-grams, with ``repeats`` also the places left out because one with the same surroundings is there."""
    w = span - k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        docs: list[int] = []
        texts: list[str] = []
        held = 0

        def flush() -> pa.RecordBatch:
            text, place, value = kept_grams(texts, k, w)
            order = np.lexsort((value, text))
            same = np.zeros(len(order), bool)
            again: dict[int, list[int]] = {}
            if len(order):
                repeated = (np.diff(value[order], prepend=value[order[0]] + 1) == 0) & (np.diff(text[order], prepend=-1) == 0)
                same[order[repeated]] = True
                if same.any():  # of a k-gram's places in one text, those with other surroundings are enough
                    known: dict[tuple, int] = {}
                    for i in order.tolist():
                        t, p = int(text[i]), int(place[i])
                        first = known.setdefault((t, texts[t][max(0, p - span + k) : p + span], min(p, span - k)), i)
                        same[i] = first != i
                        if repeats and first != i:
                            again.setdefault(first, []).append(p)
            take = ~same
            columns = [pa.array(value[take]), pa.array(np.array(docs, np.int64)[text[take]] if take.any() else np.zeros(0, np.int64)), pa.array(place[take].astype(np.int32))]
            if repeats:
                columns.append(pa.array([again.get(i) for i in np.flatnonzero(take).tolist()], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(columns, names=["gram", "doc", "place", "again"][: len(columns)])

        for batch in batches:
            for one, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if one in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(one)
                docs.append(doc)
                texts.append(text)
                held += len(text)
                if held >= CHUNK_CHARS:
                    yield flush()
                    docs, texts, held = [], [], 0
        if texts:
            yield flush()

    return run


def _passages(span: int, k: int):
    """From (doc, text, [(lead, place)]) to passages (lead, doc, start, text)."""
    around = span - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc, text, grams in zip(*(c.to_pylist() for c in batch.columns)):
                by_lead: dict[int, list[int]] = {}
                for g in grams:
                    by_lead.setdefault(g["lead"], []).append(g["place"])
                for lead, places in by_lead.items():
                    places.sort()
                    start, end = None, 0
                    for p in [*places, None]:
                        if start is not None and (p is None or p - around > end):
                            for column, x in zip(out, (lead, doc, start, text[start:end])):
                                column.append(x)
                            start = None
                        if p is not None:
                            start = max(0, p - around) if start is None else start
                            end = min(len(text), p + span)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], batch.schema.field(0).type), pa.array(out[2], pa.int32()), pa.array(out[3], pa.string())], names=["lead", "doc", "start", "passage"]
            )

    return run


class Bits:
    """A bit vector with block counts."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.counts = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.counts[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each place."""
        word = at >> 6
        return self.counts[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Bit vectors of a sequence: the rank of a symbol, and the symbol at a place, in a logarithmic number of steps."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.bits, self.zeros = [], []
        for level in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (sequence >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(len(sequence) - int(self.bits[-1].counts[-1]))
            sequence = np.concatenate([sequence[bit == 0], sequence[bit == 1]])
        self.first = self._walk(np.arange(symbols), np.zeros(symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for n, (bits, zeros) in enumerate(zip(self.bits, self.zeros)):
            ones = bits.rank(at)
            at = np.where((symbol >> (len(self.bits) - 1 - n)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.first[symbol]

    def read(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in zip(self.bits, self.zeros):
            bit, ones = bits.get(at), bits.rank(at)
            symbol = symbol << 1 | bit
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Places in order of their suffixes, by doubling; each separator (0, the last symbol of all too) is a symbol of its own, in order of place.

    Only places that are still tied are sorted again.
    """
    n, width = len(symbols), int(symbols.max() + 1).bit_length()
    ends = np.flatnonzero(symbols == 0)
    ahead = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    held = 62 // width
    key = np.zeros(n, np.int64)
    for j in range(held):
        key <<= width
        key[: max(0, n - j)] |= np.where(ahead[: max(0, n - j)] >= j, symbols[j:] + 1, 0)
    order = np.argsort(key, kind="stable")
    new = np.diff(key[order], prepend=-1) != 0
    new |= ahead[order] < held
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            return order
        place = order[tied]
        key = rank[place] * (n + 1) + rank[place + held]
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[tied] = place
        new[tied] = np.diff(key, prepend=-1) != 0
        rank[place] = np.maximum.accumulate(np.where(new[tied], tied, 0))
        held *= 2


class FMIndex:
    """Backward search over texts that end with a separator, the symbol 0; ``docs`` tells whose a place is.

    What is kept is a few bits a character: the wavelet matrix, the marks and
    places of every RATE-th suffix, and where the document changes.
    """

    def __init__(self, symbols: np.ndarray, docs: np.ndarray):
        order = suffix_order(symbols)
        self.size = len(symbols)
        letters = int(symbols.max()) + 1
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=letters))])
        self.matrix = WaveletMatrix(symbols[order - 1], letters)
        kept = (order % RATE == 0) | (symbols[order - 1] == 0)  # the first of a text, too: separators aren't walked over
        self.kept, self.places = Bits(kept), order[kept].astype(np.int32)
        self.changes = Bits(np.diff(docs[order], prepend=docs[order[0]]) != 0)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals after one more symbol to the left."""
        return self.before[symbol] + self.matrix.rank(symbol, low), self.before[symbol] + self.matrix.rank(symbol, high)

    def several(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether an interval has suffixes of more than one document."""
        return (high > low) & (self.changes.rank(np.maximum(low + 1, high)) > self.changes.rank(np.minimum(low + 1, self.size)))

    def statistics(self, symbols: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each end, how many symbols before it, ``most`` at the most, are in several documents; and the suffix interval of the last that are."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size, np.int64)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for n in range(1, most + 1):
            symbol = symbols[ends[live] - n]
            lo, hi = self.step(symbol, low[live], high[live])
            ok = (symbol > 0) & self.several(lo, hi)
            live = live[ok]
            if not len(live):
                break
            low[live], high[live], length[live] = lo[ok], hi[ok], n
        return length, low, high

    def located(self, slots: np.ndarray) -> np.ndarray:
        """The places of suffixes: to the left until one that is kept."""
        places, live, steps = np.empty(len(slots), np.int64), np.arange(len(slots)), 0
        while len(live):
            done = self.kept.get(slots)
            places[live[done]] = self.places[self.kept.rank(slots[done])] + steps
            live, slots = live[~done], slots[~done]
            symbol, rank = self.matrix.read(slots)
            slots = self.before[symbol] + rank
            steps += 1
        return places


def shared_in(docs: np.ndarray, starts: np.ndarray, sides: np.ndarray, passages: list[str], span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Matches (doc, start, other doc, start there, length) of at least ``span`` characters between passages of different documents, doc < other doc.

    ``sides``: passages of side 0 and 1 are only compared with each other, those
    of side 2 with all. A match reaches at most ``span`` characters beyond where
    it was found; longer ones come as several that overlap.
    """
    sizes = np.array([len(p) + 1 for p in passages])
    base = np.cumsum(sizes) - sizes
    codes = codes_of("\0".join(passages) + "\0").astype(np.int64) + 1
    last = base + sizes - 1
    codes[last] = 0
    own = np.repeat(np.arange(len(passages)), sizes)
    _, symbols = np.unique(codes, return_inverse=True)
    index = FMIndex(symbols, docs[own])
    half = (span + 1) // 2
    count = (sizes - 1) // half
    ends = np.repeat(base - half * (np.cumsum(count) - count), count) + half * np.arange(1, count.sum() + 1)
    length, low, high = index.statistics(symbols, ends, half)
    found = np.flatnonzero(length >= half)
    apart = codes.copy()
    apart[last] = -1 - np.arange(len(passages))  # no two separators are equal
    pad = np.concatenate([np.full(span, -(1 << 40)), apart, np.full(span, -(1 << 41))])
    wide = span - half
    # Equal stretches have one interval, which is located once
    interval, of = np.unique(low[found] * (len(codes) + 1) + high[found], return_inverse=True)
    first, size = interval // (len(codes) + 1), interval % (len(codes) + 1) - interval // (len(codes) + 1)
    offset = np.cumsum(size) - size
    slots = np.repeat(first - offset, size) + np.arange(size.sum())
    places = np.concatenate([index.located(part) for part in np.split(slots, range(LOCATED, len(slots), LOCATED))]) if len(slots) else slots
    part = (np.cumsum(size[of]) - size[of]) // LOCATED
    for n in np.unique(part):
        which = part == n
        many, start = size[of[which]], offset[of[which]]
        x, y = np.repeat(ends[found[which]] - half, many), places[np.repeat(start - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        p, q = own[x], own[y]
        ok = (docs[p] < docs[q]) & ((sides[p] != sides[q]) | (sides[p] == 2))
        x, y, p, q = x[ok], y[ok], p[ok], q[ok]
        left = _run(pad, x + span - 1, y + span - 1, -1, wide)
        right = _run(pad, x + span + half, y + span + half, 1, wide)
        ok = left + half + right >= span
        x, y, p, q, left, right = x[ok], y[ok], p[ok], q[ok], left[ok], right[ok]
        if len(x):
            yield docs[p], starts[p] + x - left - base[p], docs[q], starts[q] + y - left - base[q], left + half + right


def _run(codes: np.ndarray, x: np.ndarray, y: np.ndarray, step: int, most: int) -> np.ndarray:
    """How many symbols in a row are equal from x and y on, ``most`` at the most."""
    length = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    for _ in range(most):
        live = live[codes[x[live] + step * length[live]] == codes[y[live] + step * length[live]]]
        if not len(live):
            break
        length[live] += 1
    return length


def longest(docs: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The spans (rows doc, start, end) that lie in no other of their document."""
    order = np.lexsort((-end, start, docs))
    docs, start, end = docs[order], start[order], end[order]
    group = np.cumsum(np.diff(docs, prepend=docs[:1]) != 0)
    reach = end + group * (int(end.max()) + 1)
    keep = np.diff(np.maximum.accumulate(reach), prepend=-1) > 0
    return np.stack([docs[keep], start[keep], end[keep]])


class Held:
    """Distinct numbers out of many that repeat."""

    def __init__(self):
        self.sure, self.parts, self.count = np.zeros(0, np.int64), [], 0

    def add(self, numbers: np.ndarray) -> None:
        self.parts.append(np.unique(numbers))
        self.count += len(self.parts[-1])
        if self.count > max(2_000_000, len(self.sure)):
            self.all()

    def all(self) -> np.ndarray:
        self.sure, self.parts, self.count = np.unique(np.concatenate([self.sure, *self.parts])), [], 0
        return self.sure


def _matches(span: int, spans: bool):
    """From passages, all of a shard one after another, to distinct links (doc, other), doc < other; with ``spans`` also to (doc, null, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], []]
        held, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            ids, own = np.unique(np.array(rows[0], np.int64), return_inverse=True)
            links, known = Held(), np.zeros((3, 0), np.int64)
            spanned: list[np.ndarray] = []
            count = 0
            for a, s, b, t, n in shared_in(own, np.array(rows[1], np.int64), np.array(rows[2]), rows[3], span):
                links.add(a * len(ids) + b)
                if spans:
                    spanned += [np.stack([a, s, s + n]), np.stack([b, t, t + n])]
                    count += 2 * len(a)
                    if count > 2_000_000:
                        known, spanned, count = longest(*np.concatenate([known, *spanned], axis=1)), [], 0
            if spanned:
                known = longest(*np.concatenate([known, *spanned], axis=1))
            known = np.stack([ids[known[0]], known[1], known[2]])
            key = links.all()
            links = np.stack([ids[key // len(ids)], ids[key % len(ids)]])
            none = lambda n: pa.nulls(n, pa.int64())
            names = ["doc", "other", "start", "end"]
            yield pa.RecordBatch.from_arrays([pa.array(links[0]), pa.array(links[1]), none(links.shape[1]), none(links.shape[1])], names=names)
            if spans:
                yield pa.RecordBatch.from_arrays([pa.array(known[0]), none(known.shape[1]), pa.array(known[1]), pa.array(known[2])], names=names)

        for batch in batches:
            leads = zip(*(batch.column(i).to_pylist() for i in range(3)))
            for group, doc, start, side, passage in zip(leads, *(batch.column(i).to_pylist() for i in range(3, 7))):
                if held >= INDEX_CHARS and group != last:
                    yield from flush()
                    rows, held = [[], [], [], []], 0
                last = group
                # A document of the other side or group of the same task may meet it again: distinct() follows
                for column, x in zip(rows, (doc, start, side, passage)):
                    column.append(x)
                held += len(passage)
        if rows[0]:
            yield from flush()

    return run


def shared_spans(df: DataFrame, key: str, text: str, span: int = 200, gram: int | None = None, repeats: bool = False) -> tuple[DataFrame, ...]:
    """Spans that different texts share, and the documents of each class of equal texts.

    Returns links (doc, other) between the least documents of the classes, doc <
    other, and members (rep, doc) of texts of at least ``span`` characters. With
    ``repeats`` there are also rows (doc, null, start, end) of the shared spans
    of both sides. ``key`` must be whole numbers.

    Of places in one text with the same surroundings only the first is matched;
    with ``repeats`` the others come third, as (rep, place, again).
    """
    k = gram or span // 2
    if not 0 < k < span:
        raise ValueError("a gram must be shorter than the span")
    docs = df.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).where(F.length("text") >= span).withColumn("print", F.xxhash64("text"))
    members = staged(docs.select("doc", "print", F.xxhash64(F.lit(17), "text").alias("check")).distinct(), "members")
    reps = members.groupBy("print", "check").agg(F.min("doc").alias("rep"))
    fields = "gram long, doc long, place int" + ", again array<int>" * repeats
    grams = staged(docs.select("print", "doc", "text").mapInArrow(_anchors(span, k, repeats), fields), "grams")
    shared = grams.groupBy("gram").agg(F.min("doc").alias("lead"), F.max("doc").alias("most")).where("lead < most").select("gram", "lead")
    wanted = grams.select("gram", "doc", "place").join(shared, "gram").groupBy("doc").agg(F.collect_list(F.struct("lead", "place")).alias("grams"))
    # A task hashes a text once, but copies in several tasks come from several; one of them is enough.
    classes = members.join(reps, ["print", "check"]).select("doc", "rep")
    wanted = wanted.join(classes, "doc").groupBy("rep").agg(F.min_by("grams", "doc").alias("grams")).withColumnRenamed("rep", "doc")
    texts = docs.select("doc", "text").join(wanted, "doc").select("doc", "text", "grams")
    passages = texts.mapInArrow(_passages(span, k), "lead long, doc long, start int, passage string")
    passages = staged(passages, "passages")
    large = passages.groupBy("lead").agg(F.sum(F.length("passage")).alias("chars")).where(F.col("chars") > SHARD_CHARS)
    large = large.select("lead", F.ceil(F.col("chars") / SHARD_CHARS).cast("int").alias("buckets"))
    bucket = F.pmod(F.xxhash64("doc"), F.coalesce("buckets", F.lit(1))).cast("int")
    spread = passages.join(large, "lead", "left").withColumn("bucket", bucket)
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("buckets", F.lit(1)) - 1)))
    spread = spread.select(
        "lead", F.least("bucket", "other").alias("i"), F.greatest("bucket", "other").alias("j"), "doc", "start",
        F.when(F.col("bucket") == F.col("other"), 2).otherwise((F.col("bucket") > F.col("other")).cast("int")).alias("side"), "passage",
    )
    sorted_ = spread.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j")
    matches = sorted_.mapInArrow(_matches(span, repeats), "doc long, other long, start long, end long")
    if not repeats:
        return matches, classes
    others = grams.where("again IS NOT NULL").join(classes, "doc").select("rep", "place", F.explode("again").alias("again")).distinct()
    return matches, classes, others


def sharing_pairs(df: DataFrame, key: str, text: str, span: int = 200, names: tuple[str, str] = ("doc_id_a", "doc_id_b")) -> DataFrame:
    """Distinct pairs of documents that share a run of at least ``span`` characters, the smaller id first, members of classes included."""
    matches, members = shared_spans(df, key, text, span)
    links = matches.select(F.col("doc").alias("doc_a"), F.col("other").alias("doc_b")).distinct()
    a = members.select(F.col("rep").alias("doc_a"), F.col("doc").alias("x"))
    b = members.select(F.col("rep").alias("doc_b"), F.col("doc").alias("y"))
    across = links.join(a, "doc_a").join(b, "doc_b").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    within = a.join(b, F.col("doc_a") == F.col("doc_b")).where("x < y").select("x", "y")
    return across.unionByName(within).where("x < y").distinct().toDF(*names)


def _on_repeats(spans: DataFrame, repeats: DataFrame, span: int, k: int) -> DataFrame:
    """The spans (rep, a, b) as they lie around the places (rep, again) whose surroundings are those of (rep, place)."""
    first, last = F.col("place") - (span - k), F.col("place") + span
    at = repeats.select("rep", "place").distinct().withColumn("part", F.floor(F.col("place") / span))
    parts = F.sequence(F.floor(F.col("a") / span), F.floor((F.col("b") - k) / span))
    near = spans.withColumn("part", F.explode(parts)).join(at, ["rep", "part"]).where("a <= place").where(F.col("b") >= F.col("place") + k)
    near = near.select("rep", "place", F.greatest(F.col("a"), first).alias("a"), F.least(F.col("b"), last).alias("b")).where(F.col("b") - F.col("a") >= span)
    near = near.groupBy("rep", "place").agg(F.min("a").alias("a"), F.max("b").alias("b"))  # all hold the gram: one run
    by = F.col("again") - F.col("place")
    return near.join(repeats, ["rep", "place"]).select("rep", (F.col("a") + by).alias("a"), (F.col("b") + by).alias("b"))


def shared_share(df: DataFrame, key: str, text: str, span: int = 200) -> DataFrame:
    """(``key``, n_chars, shared_chars, share, copies, links) of each document.

    ``shared_chars`` counts the characters in runs of at least ``span`` that
    another document has too; copies of one text share all of it. ``links`` is
    the number of other texts (classes, not members) that share a run.
    """
    k = span // 2
    matches, members, repeats = shared_spans(df, key, text, span, k, repeats=True)
    matches = staged(matches, "matches")
    pairs = matches.where("other IS NOT NULL").select(F.col("doc").alias("rep"), "other").distinct()
    ends = pairs.groupBy("rep").agg(F.count(F.lit(1)).alias("links")).unionByName(pairs.groupBy(F.col("other").alias("rep")).agg(F.count(F.lit(1)).alias("links")))
    links = ends.groupBy("rep").agg(F.sum("links").alias("links"))
    covered = matches.where("other IS NULL").groupBy(F.col("doc").alias("rep"), F.col("start").alias("a")).agg(F.max("end").alias("b"))
    before = Window.partitionBy("rep").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    covered = covered.unionByName(_on_repeats(covered, repeats, span, k)).groupBy("rep", "a").agg(F.max("b").alias("b")).withColumn("reached", F.coalesce(F.max("b").over(before), F.lit(0)))
    covered = covered.groupBy("rep").agg(F.sum(F.greatest(F.lit(0), F.col("b") - F.greatest("a", "reached"))).alias("covered"))
    copies = members.groupBy("rep").agg(F.count(F.lit(1)).alias("copies"))
    by_doc = members.join(copies, "rep").join(covered, "rep", "left").join(links, "rep", "left").drop("rep").dropDuplicates(["doc"])
    base = df.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long").alias("n_chars"))
    out = base.join(by_doc, "doc", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0))).cast("long")
    out = out.select(F.col("doc").alias(key), "n_chars", shared.alias("shared_chars"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0))).distinct()
