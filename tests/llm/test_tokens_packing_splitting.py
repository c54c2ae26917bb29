"""Token ids, containers and pieces."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import packing, splitting, tokens

tiktoken = pytest.importorskip("tiktoken")
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_VOCABULARY), reason="needs the vocabulary files")


@pytest.fixture(scope="module")
def reference():
    import base64

    import public_tokenizers

    with open(tokens.DEFAULT_VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(texts):
    flat, sizes = tokens.encoder(tokens.DEFAULT_VOCABULARY).encode(texts)
    return [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]


CASES = ["", None, " ", "Thẻ của tôi bị khoá, I'll wait.", "x" * 5000, "aé" * 3000, " " * 700, "<|endoftext|>", "\x1c\x1d a", "٣٤ Ⅷ½²", "안녕하세요 ｗｉｄｅ", "a\n\n  b", "_ __x", "🙂👍🏽", "é", "can't we've"]


def test_ids_equal_the_reference(reference):
    assert ids(CASES) == [reference.encode_ordinary(x or "") for x in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_random_texts(reference, texts):
    assert ids(texts) == [reference.encode_ordinary(x) for x in texts] or not texts


def test_a_full_word_table_changes_nothing(reference, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_WORDS", 3)
    texts = [f"từ {i} khác {i * 7}" for i in range(20)]
    assert ids(texts) == ids(texts) == [reference.encode_ordinary(x) for x in texts]


def test_encoded_table(spark, reference):
    df = spark.createDataFrame([(1, "xin chào", "z"), (2, None, "z"), (3, "", "z"), (1, "xin chào", "z")], "id long, text string, ids string")
    assert sorted((r["id"], r["ids"]) for r in tokens.encoded(df, "id", "text").collect()) == [(1, reference.encode_ordinary("xin chào"))] * 2 + [(2, []), (3, [])]
    assert tokens.encoded(df.limit(0), "id", "text").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=60))
def test_windows_hold_all_within_the_capacity(sizes):
    sizes = np.array(sizes)
    window = packing.fill(sizes, 50)
    used = np.bincount(window, sizes)
    assert used.max() <= 50 and used.sum() == sizes.sum()
    assert len(used) <= max(2 * -(-sizes.sum() // 50), (sizes > 25).sum(), 1)


def test_near_equal_windows():
    sizes = np.random.default_rng(3).integers(1, 800, 700)
    window = packing.fill(sizes, 2048)
    assert window.max() + 1 <= -(-sizes.sum() // 2048) + 2


def test_packed_table(spark):
    df = spark.createDataFrame([(i, 100 + 37 * i % 900, "z") for i in range(200)] + [(900, 5000, "z"), (901, 0, "z"), (902, None, "z"), (903, 2048, "z"), (5, 100, "z")], "id long, n long, size string")
    out = packing.packed(df, "id", "n", 2048).collect()
    used, seen = {}, {}
    for r in out:
        used.setdefault(r["container"], []).append((r["place"], r["at"], r["n_tokens"]))
        seen.setdefault(r["id"], []).append((r["piece"], r["first_token"], r["n_tokens"]))
    for places in used.values():
        places.sort()
        assert [p for p, _, _ in places] == list(range(len(places))) and sum(n for *_, n in places) <= 2048
        assert [a for _, a, _ in places] == [sum(n for *_, n in places[:i]) for i in range(len(places))]
    assert sorted(seen[900]) == [(0, 0, 2048), (1, 2048, 2048), (2, 4096, 904)] and 901 not in seen and 902 not in seen and len(seen[5]) == 2
    assert all(len(v) == 1 for k, v in seen.items() if k not in (900, 5))
    assert packing.packed(df.limit(0), "id", "n").count() == 0


def check(text, limit, overlap):
    found = splitting.cuts(text, limit, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(b - a <= limit for a, b in found)
    for (a, b), (c, d) in zip(found, found[1:]):
        assert a < c <= b < d and b - c <= overlap
    end, following = splitting.successors(text, limit, overlap)
    at, plain = 0, []
    while at < len(text) or not plain:
        plain.append((at, int(end[at])))
        at = int(following[at]) if text else 1
    assert found == plain
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab .\n,1"), min_size=1, max_size=400), st.integers(20, 60))
def test_cuts_by_doubling_equal_cuts_one_by_one(text, limit):
    check(text, limit, 8)


def test_natural_boundaries_come_first():
    text = ("Câu một dài vừa phải. " * 30 + "\n\n" + "Đoạn hai có nhiều câu. " * 40).strip()
    (a, b), *_ = check(text, 1000, 100)
    assert text[:b].endswith("\n\n") and all(text[x - 1].isspace() for x, _ in check(text, 1000, 100)[1:])


def test_sections_of_very_long_texts_change_nothing(monkeypatch):
    text = "Một câu ngắn. Một câu dài hơn một chút nữa.\n" * 2000 + "x" * 5000
    whole = splitting.cuts(text)
    monkeypatch.setattr(splitting, "SECTION_CHARS", 6000)
    assert splitting.cuts(text) == whole
    assert splitting.cuts("") == [(0, 0)]


def test_pieces_table(spark):
    df = spark.createDataFrame([(1, "từ " * 600, "z"), (2, "ngắn", "z"), (3, None, "z"), (4, "", "z")], "id long, answer string, piece_no string")
    out = splitting.pieces(df, "id", "answer").collect()
    assert sorted({(r["id"], r["piece_no"]) for r in out}) == [(1, 0), (1, 1), (2, 0), (4, 0)]
    assert splitting.pieces(df.limit(0), "id", "answer").count() == 0
