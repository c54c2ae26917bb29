"""Near-copies and shared spans against brute force."""

import random

import numpy as np
import pytest

from quern.llm import nearcopy, spans

WORDS = [f"từ{i}" for i in range(400)]


def edited(words, rng, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], [rng.choice(WORDS)], [words[at], rng.choice(WORDS)]])
    return words


def brute(texts, threshold):
    sets = {i: set(nearcopy.word_pairs([(t or "").lower()], {})[0].tolist()) for i, t in texts.items()}
    ids = sorted(sets)
    same = lambda a, b: texts[a] and not sets[a] and not sets[b] and texts[a].lower() == (texts[b] or "").lower()
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if same(a, b) or (u := sets[a] | sets[b]) and len(sets[a] & sets[b]) / len(u) >= threshold}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    out, n = {}, 0
    for _ in range(25):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(20, 80))]
        for _ in range(rng.randrange(1, 6)):
            out[n] = " ".join(edited(base, rng, rng.randrange(0, 6)))
            n += 1
    for i in range(4):
        out[n + i] = out[0]
    out |= {n + 10: None, n + 11: "", n + 12: "một", n + 13: " ".join(WORDS * 20), n + 14: "Một", n + 15: "hai", n + 16: " ".join(WORDS * 20 + ["cuối"])}
    return out


@pytest.mark.parametrize("hot, tree, tiers, cell", [(20_000, 40_000, (400, 1600), 200_000), (3, 10, (30, 50), 50)])
def test_near_pairs_equal_brute_force(spark, texts, monkeypatch, hot, tree, tiers, cell):
    for name, value in (("LEAST_HOT", hot), ("TREE_POINTS", tree), ("TIERS", tiers), ("CELL_RECORDS", cell)):
        monkeypatch.setattr(nearcopy, name, value)
    df = spark.createDataFrame([(i, t, None, 1) for i, t in texts.items()] + [(0, texts[0], None, 1)], "id long, question string, answer string, pairs int").repartition(3)
    got = {tuple(r) for r in nearcopy.near_pairs(df, "id", ["question", "answer"], 0.7).collect()}
    assert got == brute(texts, 0.7)
    assert nearcopy.near_pairs(df.limit(0), "id", ["question", "answer"]).count() == 0


def test_groups_are_the_components(spark, texts):
    df = spark.createDataFrame([(i, t, None) for i, t in texts.items()], "id long, question string, answer string")
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute(texts, 0.7):
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["group_id"] for r in nearcopy.near_groups(df, "id", ["question", "answer"], 0.7).collect()}
    assert got == {i: root(i) for i in texts}


def test_the_tree_bound_drops_no_similar_points():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(5, 60))) for _ in range(150)]
    sets += [np.unique(np.concatenate([s[: max(3, len(s) - 2)], rng.integers(0, 300, 1)])) for s in sets[:60]]
    counts = np.stack([np.bincount(s % nearcopy.GROUPS, minlength=nearcopy.GROUPS) for s in sets])
    size = np.array([len(s) for s in sets])
    tree = nearcopy.RTree(np.zeros(len(sets), np.int64), size, counts)
    found = {(min(a, b), max(a, b)) for x, y in tree.joined(0.7) for a, b in zip(x.tolist(), y.tolist())}
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both / (size[a] + size[b] - both) >= 0.7:
                assert (a, b) in found


def test_counts_at_their_limit_stay_an_upper_bound():
    a = np.array([[255, 3], [255, 0]], np.uint8)
    assert nearcopy.bound(a[:1], a[1:], np.array([400]), np.array([300])).tolist() == [255 + min(400 - 258, 300 - 255)]
    counts = np.array([0, 1, 63, 64, 65, 100, 5000, 10**7])
    short = nearcopy.short(counts)
    assert (np.diff(short.astype(int)) >= 0).all() and (nearcopy.LONG[short[:-1]] >= counts[:-1]).all()


def test_suffixes_are_sorted_to_their_separators():
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab", k=rng.randrange(0, 60))) for _ in range(60)] + ["abab" * 20] * 5
    symbols = np.array([" ab".index(c) for t in texts for c in t + " "])
    ends = np.flatnonzero(symbols == 0).tolist()
    suffixes = [(symbols[i : e].tolist(), e) for n, e in enumerate(ends) for i in range(ends[n - 1] + 1 if n else 0, e + 1)]
    # A separator is less than any letter, and one before the other in order of place
    want = sorted(range(len(symbols)), key=lambda i: ([x for x in suffixes[i][0]] + [0, suffixes[i][1]]))
    assert spans.suffix_order(symbols).tolist() == want


def test_matching_statistics_and_located_suffixes(monkeypatch):
    rng = random.Random(2)
    common = "".join(rng.choices("abcd", k=40))
    texts = ["".join(rng.choices("abcd", k=rng.randrange(0, 90))) + common[rng.randrange(0, 20) :] * rng.randrange(0, 2) for _ in range(40)]
    text = "".join(t + "\0" for t in texts)
    symbols, docs = np.array(["\0abcd".index(c) for c in text]), np.repeat(np.arange(40), [len(t) + 1 for t in texts])
    index = spans.FMIndex(symbols, docs)
    ends = np.array([i for i in range(len(text)) if i % 7 == 0 and i >= 30])
    length, low, high = index.statistics(symbols, ends, 30)

    def elsewhere(i, e):
        return any(text[i:e] in t for d, t in enumerate(texts) if d != docs[i])

    for e, n, lo, hi in zip(ends.tolist(), length.tolist(), low.tolist(), high.tolist()):
        best = 0
        while best < 30 and text[e - best - 1] != "\0" and docs[e - best - 1] == docs[e - 1] and elsewhere(e - best - 1, e):
            best += 1
        assert n == best
        if n:
            word = text[e - n : e]
            assert sorted(index.located(np.arange(lo, hi)).tolist()) == [i for i in range(len(text)) if text.startswith(word, i)]


def test_spans_within_others_are_dropped():
    rows = np.array([[1, 0, 10], [1, 2, 8], [1, 2, 12], [2, 3, 4], [1, 0, 10], [2, 0, 2]]).T
    assert spans.longest(*rows).T.tolist() == [[1, 0, 10], [1, 2, 12], [2, 0, 2], [2, 3, 4]]


def shared(texts, span):
    where = {}
    for i, t in texts:
        for a in range(len(t or "") - span + 1):
            where.setdefault(t[a : a + span], set()).add(i)
    return {(a, b) for s in where.values() for a in s for b in s if a < b}


@pytest.mark.parametrize("shard", [1_000_000, 300])
def test_sharing_pairs_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spans, "SHARD_CHARS", shard)
    rng = random.Random(7)
    alphabet = "abcdefghijklmnop ệ🙂"
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(35, 90))) for _ in range(8)]
    rows = []
    for i in range(120):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 150)))
        for _ in range(rng.randrange(0, 3)):
            p, at = rng.choice(passages), rng.randrange(0, len(t) + 1)
            cut = rng.randrange(0, 20)
            t = t[:at] + p[cut:] + t[at:]
        rows.append((i, t))
    rows += [(200, None), (201, ""), (202, "x" * 300), (203, "y" + "x" * 120), (204, rows[0][1]), (205, rows[0][1]), (206, " " * 70 + "a"), (207, "b" + " " * 80)]
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in [*rows, rows[3]]], "id long, text string, gram string, doc int").repartition(4)
    got = {tuple(r) for r in spans.sharing_pairs(df, "id", "text", 40).collect()}
    assert got == shared(rows, 40)
    assert spans.sharing_pairs(df.limit(0), "id", "text", 40).count() == 0


def test_shared_share_counts_covered_characters(spark):
    p = "".join(random.Random(1).choices("abcdefghij", k=60))
    rows = [(1, "Q" * 30 + p + "R" * 10), (2, p + "S" * 40), (3, "kein Anteil"), (4, None), (5, "U" * 50), (6, "U" * 50), (7, p[:45] + "V" * 30)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["shared_chars"], r["copies"], r["links"]) for r in spans.shared_share(df, "id", "text", 40).collect()}
    assert got == {1: (60, 1, 2), 2: (60, 1, 2), 3: (0, 1, 0), 4: (0, 1, 0), 5: (50, 2, 0), 6: (50, 2, 0), 7: (45, 1, 2)}


def test_shared_share_covers_repeats_inside_a_document(spark):
    rng = random.Random(3)
    noise = lambda n: "".join(rng.choices("abcdefghij", k=n))
    p = noise(700)
    texts = {1: noise(50) + p + noise(60) + p + noise(70), 2: "Z" + p + "Y", 3: p[100:650] + "W" + p[100:650] + "V" + p[300:], 4: " " * 900 + "q" + " " * 500, 5: "r" + " " * 450, 6: noise(300)}
    windows = {}
    for i, t in texts.items():
        for a in range(len(t) - 199):
            windows.setdefault(t[a : a + 200], set()).add(i)
    want = {i: len({c for a in range(len(t) - 199) if len(windows[t[a : a + 200]]) > 1 for c in range(a, a + 200)}) for i, t in texts.items()}
    df = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    assert {r["id"]: r["shared_chars"] for r in spans.shared_share(df, "id", "text", 200).collect()} == want
    assert want[1] == 1400 and want[4] == 1400
