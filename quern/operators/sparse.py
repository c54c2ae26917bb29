"""Lexical retrieval: BM25 and keyword counts.

Texts are cut into words in composed form, without ``STOP_WORDS``. What is kept
of a corpus is its words as 64-bit hashes, one list a document, written once,
and the weight of each term. A batch of queries meets the corpus as products of
blocks (``operators.blocks``), so no row is made for a query and a document that
share a frequent word. Null and empty texts have no words and count with length
0; terms repeated in a query count each time.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import composed, content_words
from quern.operators import blocks
from quern.operators.alike import containing
from quern.operators.ranking import max_normalised, ranked
from quern.session import staged

K1, B, EPSILON = 1.5, 0.75, 0.25
# Words that BM25 leaves out.
STOP_WORDS = "của và các có được cho từ với trong là đề một này đó những thì bị hay hoặc vì nếu mà khi".split()


def postings(docs: DataFrame, key: str, text: str, stop: list[str] = STOP_WORDS, shortest: int = 1) -> tuple[DataFrame, DataFrame]:
    """postings(doc_id, term, tf) and lengths(doc_id, dl), the index' two tables, written once for its several readers."""
    cut = docs.select(F.col(key).alias("doc_id"), content_words(composed(F.col(text)), list(stop), shortest).alias("words"))
    lengths = staged(cut.select("doc_id", F.size("words").cast("long").alias("dl")), "lengths")
    return staged(cut.select("doc_id", F.explode("words").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")), "postings"), lengths


def term_weights(post: DataFrame, lengths: DataFrame) -> tuple[DataFrame, tuple[int, float, float]]:
    """terms(term, df, idf) and (n, average length, mean idf) of the corpus; a negative idf becomes EPSILON x the mean."""
    n, average = lengths.agg(F.count(F.lit(1)), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf")), (n, average, mean)


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


class Index:
    """A corpus to ask several batches of queries: its words, its size, and the terms' weights."""

    def __init__(self, docs: DataFrame, key: str, text: str, stop: list[str] = STOP_WORDS, shortest: int = 1):
        self.stop, self.shortest = list(stop), shortest
        words = docs.select(F.col(key).cast("long").alias("key"), hashed(content_words(composed(F.col(text)), self.stop, shortest)).alias("terms"))
        self.words = staged(words, "words")
        counted = self.words.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.n, self.average = self.words.agg(F.count(F.lit(1)), F.coalesce(F.avg(F.size("terms")), F.lit(0.0))).first()
        raw = counted.withColumn("raw", F.log(F.lit(self.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        raw = staged(raw, "terms")
        self.mean = raw.agg(F.avg("raw")).first()[0] or 0.0
        self.weights = raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * self.mean)).otherwise(F.col("raw")).alias("idf"))

    def top(self, queries: DataFrame, k: int, query_text: str = "query") -> DataFrame:
        """hits(query_id, doc_id, method, score, rank): the k best, and of these the positive ones."""
        terms = hashed(content_words(composed(F.col(query_text)), self.stop, self.shortest))
        asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(terms).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
        asked = asked.join(self.weights, "term").groupBy("query_id").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("w"))).alias("t"))
        asked = asked.select("query_id", F.transform("t", lambda x: x["term"]).alias("terms"), F.transform("t", lambda x: x["w"]).alias("weights"))
        average = self.average or 1.0

        def score(q: dict, d: dict) -> np.ndarray:
            row = np.repeat(np.arange(len(d["ids"])), d["sizes"])
            order = np.lexsort((d["terms"], row))
            row, term = row[order], d["terms"][order]
            new = np.flatnonzero(np.r_[len(row) > 0, (np.diff(row) != 0) | (np.diff(term) != 0)]) if len(row) else np.zeros(0, np.int64)
            tf = np.diff(np.r_[new, len(row)])
            row, term = row[new], term[new]
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * d["sizes"][row] / average))
            return blocks.sparse_product(q, {"ids": d["ids"], "sizes": np.bincount(row, minlength=len(d["ids"])), "terms": term, "weights": part})

        hits = blocks.products(asked, self.words, k, score, positive=True)
        return hits.withColumn("method", F.lit("bm25")).select("query_id", "doc_id", "method", "score", "rank")


def bm25(queries: DataFrame, docs: DataFrame, key: str, text: str, k: int, query_text: str = "query", stop: list[str] = STOP_WORDS, shortest: int = 1) -> DataFrame:
    """hits(query_id, doc_id, method, score, rank) of one batch; several share an ``Index``."""
    return Index(docs, key, text, stop, shortest).top(queries, k, query_text)


def keyword_scores(queries: DataFrame, docs: DataFrame, key: str, title: str, body: str, k: int, query_text: str = "query", stop: list[str] = (), shortest: int = 2, compounds: list[str] = ()) -> DataFrame:
    """Twice the query's keywords that are in the title plus once those in the body, by the best of the query.

    Keywords are the distinct words, and those of ``compounds`` (terms of
    several words) that the query has; they count wherever the lower-case text
    contains them, within a word too. Within a word is found by the vocabulary:
    a keyword is in a text where it is in one of its words, so keywords are looked
    for in the distinct words, and these meet documents by equality.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    held = lambda c: F.filter(F.array(*[F.when(low(c).contains(t), F.lit(t)) for t in compounds]), lambda x: x.isNotNull()) if compounds else F.array().cast("array<string>")
    terms = F.array_union(F.array_distinct(content_words(F.col(query_text), list(stop), shortest)), held(query_text))
    asked = staged(queries.select(F.col("query_id").cast("long").alias("query_id"), terms.alias("words")).distinct(), "keywords")
    words = staged(docs.select(F.col(key).cast("long").alias("key"), *[F.array_distinct(content_words(F.col(c), [], 1)).alias(n) for c, n in ((title, "t"), (body, "b"))], held(title).alias("tc"), held(body).alias("bc")), "words")
    wanted = asked.select(F.explode("words").alias("keyword")).distinct()
    vocabulary = words.select(F.explode(F.array_union("t", "b")).alias("word")).distinct()
    within = containing(wanted.withColumnRenamed("keyword", "text"), vocabulary.withColumnRenamed("word", "other")).toDF("keyword", "word")

    def side(name: str, points: int) -> DataFrame:
        single = words.select("key", F.explode(name).alias("word")).join(within, "word").select("key", "keyword")
        several = words.select("key", F.explode(f"{name}c").alias("keyword"))
        return single.unionByName(several).distinct().select("key", "keyword", F.lit(float(points)).alias("w"))

    known = side("t", 2).unionByName(side("b", 1)).groupBy("key").agg(F.collect_list(F.struct(F.xxhash64("keyword").alias("term"), "w")).alias("l"))
    lists = lambda c: (F.transform(c, lambda x: x["term"]).alias("terms"), F.transform(c, lambda x: x["w"]).alias("weights"))
    hits = blocks.products(asked.select("query_id", hashed(F.col("words")).alias("terms"), F.transform("words", lambda _: F.lit(1.0)).alias("weights")), known.select("key", *lists("l")), k, blocks.sparse_product, positive=True)
    return max_normalised(hits).withColumn("method", F.lit("keyword")).select("query_id", "doc_id", "method", "score", "rank")


def listed_scores(docs: DataFrame, key: str, title: str, body: str, lists: dict[str, list[str]], k: int, by: str = "intent") -> DataFrame:
    """(``by``, doc_id, score, rank): for each list the k documents with most of its terms, twice in the title and once in the body, by the best of the list.

    All lists are read in one pass over the documents.
    """
    count = lambda c, terms: sum((F.lower(F.coalesce(F.col(c), F.lit(""))).contains(t).cast("int") for t in terms), F.lit(0))
    scored = [F.struct(F.lit(name).alias(by), (2 * count(title, terms) + count(body, terms)).cast("double").alias("score")) for name, terms in lists.items()]
    rows = docs.select(F.col(key).alias("doc_id"), F.explode(F.array(*scored)).alias("s")).select(F.col(f"s.{by}").alias("query_id"), "doc_id", "s.score").where("score > 0")
    return max_normalised(ranked(rows, k=k)).withColumnRenamed("query_id", by)


def memory_search(queries: DataFrame, items: DataFrame, k: int, query_text: str = "query", text: str = "text") -> DataFrame:
    """Share of the query's distinct words in an item of the same user; the k best above 0.

    ``queries`` (query_id, user_id, query_text), ``items`` (doc_id, user_id, text). Meets by (user, word).
    """
    asked = queries.select("query_id", "user_id", F.array_distinct(content_words(F.col(query_text), [], 1)).alias("words")).withColumn("n", F.size("words"))
    asked = asked.select("query_id", "user_id", "n", F.explode("words").alias("term"))
    held = items.select("doc_id", "user_id", F.explode(F.array_distinct(content_words(F.col(text), [], 1))).alias("term"))
    found = asked.join(held, ["user_id", "term"]).groupBy("query_id", "doc_id").agg((F.count(F.lit(1)) / F.max("n")).alias("score"))
    return ranked(found, k=k).withColumn("method", F.lit("memory")).select("query_id", "doc_id", "method", "score", "rank")
