"""Queries that SQL can't express, against plain loops on the smallest tables."""

import math
import re
from difflib import SequenceMatcher
from pathlib import Path

import pytest

from quern.plans import answers, dialogue, retrieval

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="needs the test tables")


def words(text):
    return set(re.findall(r"\w+", (text or "").lower()))


@pytest.fixture(scope="module")
def data(spark):
    read = lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")
    return {
        "asked": {r["query_id"]: r["query"] for r in read("intent_query").collect()},
        "faq": {r["faq_id"]: r["question"] for r in read("faq").collect()},
        "vectors": {r["vec_id"]: r["embedding"] for r in read("embeddings").collect()},
        "hits": [(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.bm25_topk(spark, str(FOLDER)).collect()],
    }


def test_fuzzy_match(spark, data):
    expected = {}
    for q, text in data["asked"].items():
        own = words(text)
        for d, other in data["faq"].items():
            if other is not None and len(own & words(other)) >= 0.6 * len(own):
                score = SequenceMatcher(None, text.lower(), other.lower()).ratio()
                if score >= 0.85:
                    expected[q, d] = round(score, 6)
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieval.fuzzy_match(spark, str(FOLDER)).collect()}
    assert got == expected


def test_exact_match_inject(spark, data):
    exact = {r["query_id"]: r["doc_id"] for r in retrieval.fuzzy_match(spark, str(FOLDER)).where("rank = 1").collect()}
    lists = {}
    for q, d, rank in sorted(data["hits"], key=lambda h: (h[0], h[2])):
        lists.setdefault(q, []).append(d)
    for q, d in exact.items():
        if d not in lists.setdefault(q, []):
            lists[q].insert(0, d)
    got = {}
    for r in sorted(retrieval.exact_match_inject(spark, str(FOLDER)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == lists


def test_verify_relevance(spark, data):
    kept = {}
    for q, d, rank in data["hits"]:
        text, other = data["asked"][q], data["faq"][d] or ""
        terms = lambda t: {w for w in t.lower().split() if len(w) > 1 and w not in retrieval.STOPS_RELEVANCE}
        share = len(terms(text) & terms(other)) / len(terms(text)) if terms(text) else 0
        compound = any(t in text.lower() and t in other.lower() for t in retrieval.COMPOUNDS)
        kept.setdefault(q, []).append((d, rank, compound or share >= 0.3 or SequenceMatcher(None, text.lower(), other.lower()).ratio() >= 0.4))
    expected = {(q, d, rank) for q, rows in kept.items() if sum(k for *_, k in rows) / len(rows) >= 0.3 for d, rank, k in rows if k}
    assert {(r["query_id"], r["doc_id"], r["rank"]) for r in retrieval.verify_relevance(spark, str(FOLDER)).collect()} == expected


def test_mmr_topk(spark, data):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.hypot(*a) * math.hypot(*b))

    vectors = {i: v for i, v in data["vectors"].items() if v}
    expected = {}
    for q in (i for i in vectors if i % 20 == 0):
        score = {d: cosine(vectors[q], v) for d, v in vectors.items()}
        pool = sorted(score, key=lambda d: (-round(score[d], 9), d))[:6]
        taken = []
        while len(taken) < 3:
            value = {d: 0.5 * score[d] - 0.5 * max((cosine(vectors[d], vectors[t]) for t in taken), default=0) for d in pool if d not in taken}
            taken.append(max(value, key=lambda d: (round(value[d], 9), -pool.index(d))))
        expected[q] = taken
    got = {}
    for r in sorted(retrieval.mmr_topk(spark, str(FOLDER)).collect(), key=lambda r: r["place"]):
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == expected


def test_similarity_boost(spark, data):
    base = {(r["query_id"], r["doc_id"]): r for r in answers.rerank_breakdown(spark, str(FOLDER)).collect()}
    got = answers.similarity_boost(spark, str(FOLDER)).collect()
    assert {(r["query_id"], r["doc_id"]) for r in got} == set(base)
    for r in got:
        row = base[r["query_id"], r["doc_id"]]
        text, other = data["asked"][r["query_id"]].lower(), (data["faq"][r["doc_id"]] or "").lower()
        ratio = SequenceMatcher(None, text, other).ratio()
        early = min(row["base"] * (2.5 if ratio > 0.9 else 1.5 if ratio > 0.75 else 1), 1)
        late = 5 if ratio > 0.95 else 2 if ratio > 0.9 else 0.5 if ratio > 0.75 else 0
        assert r["ratio"] == pytest.approx(ratio, abs=1e-6) and r["boosted"] == pytest.approx(row["score"] - row["base"] + early + late, abs=1e-5)


def test_context_fold(spark):
    rows = sorted(dialogue._stepped(spark, str(FOLDER)).collect(), key=lambda r: (r["conv_id"], r["turn_no"]))
    expected = {}
    for r in rows:
        topic, faq, step, n = expected.get(r["conv_id"], (None, None, 0, 0))
        if r["topic"] and r["topic"] != topic:
            topic, step = r["topic"], 0
        expected[r["conv_id"]] = (topic, faq if r["faq_id"] is None else r["faq_id"], step if r["step"] is None else r["step"], n + 1)
    got = {r["conv_id"]: (r["topic"], r["faq_id"], r["step"], r["turns"]) for r in dialogue.context_fold(spark, str(FOLDER)).collect()}
    assert got == expected
