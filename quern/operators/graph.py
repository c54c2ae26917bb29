"""A property graph as two tables: nodes(id, label, name, ...) and edges(src, rel_type, label, entity_name, ...).

Names are compared without case and outer blanks. Null names match nothing and
are left out of collections. Repeated edges count once. A hot entity (one that
a third of all edges lead to) is a hot join key; the adaptive join splits it,
and all counts are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import staged

#: Parts a frequent name's sets of entities are spread over.
SALTS = 16


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def merged_edges(edges: DataFrame, keys: list[str], latest: str) -> DataFrame:
    """One edge for each key, with the properties of its latest addition (ties: the greater confidence)."""
    w = Window.partitionBy(*keys).orderBy(F.col(latest).desc_nulls_last(), F.col("confidence").desc_nulls_last())
    return edges.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def folded_nodes(loads: DataFrame, key: str, order: str) -> DataFrame:
    """One node a key from any number of loads: of each property the last value that isn't null, in the order of ``order``. By aggregation, so loads are folded before the shuffle."""
    columns = [c for c in loads.columns if c not in (key, order)]
    last = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    return loads.groupBy(key).agg(*last)


def resolved_edges(edges: DataFrame, nodes: DataFrame, ends: dict[str, tuple[str, str]], key: str = "id") -> DataFrame:
    """Edges whose ends are given by a property instead of the id: ``ends`` maps each end's column to (label, property).

    An edge of which an end is no node, or by null, is left out; a property that
    several nodes have gives an edge to each.
    """
    for column, (label, name) in ends.items():
        own = nodes.where(F.col("label") == label).select(F.col(key).alias(f"{column}_{key}"), F.col(name).alias(column)).distinct()
        edges = edges.join(own, column)
    return edges


def upserted_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Batch upsert: rows of both by key; where both have a property, the new one counts unless it's null."""
    a, b = old.alias("a"), new.alias("b")
    columns = [c for c in old.columns if c != key]
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    return joined.select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns])


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that break uniqueness, with their number of rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def statistics(edges: DataFrame) -> DataFrame:
    """Edges in all, by relation and by label, in one pass."""
    sets = edges.groupingSets([[], ["rel_type"], ["label"]], "rel_type", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    return sets.select(F.when(F.col("level") == 3, "all").when(F.col("level") == 1, "relation").otherwise("label").alias("what"), F.coalesce("rel_type", "label").alias("name"), "n")


def entity_matches(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose entity is one of the query's: equal names, or one within the other at word borders from 3 characters on."""
    names = edges.select("src", "rel_type", "label", name_key(F.col("entity_name")).alias("name")).where("name <> ''").distinct()
    asked = entities.select("query_id", "etype", name_key(F.col("value")).alias("value")).where("value <> ''").distinct()
    pairs = name_pairs(names.select("name").distinct(), asked.select("value").distinct())
    return names.join(pairs, "name").join(asked, "value").select("query_id", "etype", F.col("src").alias("doc_id"), "rel_type", "label", "name", F.col("value"), (F.col("name") == F.col("value")).alias("exact"))


# Relations that say what a document has of each entity type; weight of a match by the first relation that matched; phrases that make two errors alike.
RELATIONS = {
    "service": "MENTIONS_SERVICE", "bank": "MENTIONS_BANK", "error": "DESCRIBES_ERROR", "action": "SUGGESTS_ACTION", "feature": "USES_FEATURE", "fee": "HAS_FEE", "limit": "HAS_LIMIT", "status": "HAS_STATUS", "requirement": "REQUIRES", "topic": "ABOUT",
    "timeframe": "HAS_TIMEFRAME", "document": "REQUIRES_DOCUMENT", "accounttype": "AFFECTS_ACCOUNT", "uielement": "NAVIGATES_TO", "contactchannel": "CONTACTS",
}
RELATION_WEIGHTS = [("DESCRIBES_ERROR", 1.5), ("ABOUT", 1.5), ("MENTIONS_BANK", 1.5), ("MENTIONS_SERVICE", 1.5), ("SUGGESTS_ACTION", 1.2), ("USES_FEATURE", 1.3)]
ALIKE_ERRORS = ["thất bại", "chưa nhận", "không nhận"]
BONUSES = ["service", "bank", "error", "action", "fee", "status", "limit", "feature", "topic"]


def entity_bonuses(asked: Callable[[str], Column], held: Callable[[str], Column]) -> dict[str, Column]:
    """Bonus by entity type; ``asked`` and ``held`` give a type's names in the query and in the document, as written."""
    some = lambda c: F.size(c) > 0
    same = lambda t: F.arrays_overlap(asked(t), held(t))

    def within(t: str, markers: list[str] = ()) -> Column:
        """Whether one of the names contains the other, or both one of the phrases; in any case."""

        def near(x: Column, y: Column) -> Column:
            either = F.contains(F.lower(x), F.lower(y)) | F.contains(F.lower(y), F.lower(x))
            for m in markers:
                either = either | (F.contains(F.lower(x), F.lit(m)) & F.contains(F.lower(y), F.lit(m)))
            return either

        return F.exists(asked(t), lambda x: F.exists(held(t), lambda y: near(x, y)))

    return {
        "service": F.when(same("service"), 2.0).when(some(asked("service")) & some(held("service")), -1.0).otherwise(0.3),
        "bank": F.when(same("bank"), 1.5).when(some(asked("bank")) & some(held("bank")), -0.8).otherwise(0.2),
        "error": F.when(some(held("error")) & ~some(asked("error")), -2.0).when(same("error"), 4.0).when(within("error", ALIKE_ERRORS), 3.0).otherwise(0.0),
        "action": F.when(same("action"), 1.8).otherwise(0.0),
        "fee": F.when(some(asked("fee")) & some(held("fee")), 2.0).otherwise(0.0),
        "status": F.when(same("status"), 1.5).otherwise(0.0),
        "limit": F.when(some(asked("limit")) & some(held("limit")), 1.5).otherwise(0.0),
        "feature": F.when(within("feature"), 2.5).when(some(asked("feature")) & some(held("feature")), -0.5).otherwise(0.0),
        "topic": F.when(within("topic"), 2.0).otherwise(0.0),
    }


def entity_scores(edges: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """hits(query_id, doc_id, entities, exact, weight, bonus_<type> .., raw, score, rank): the k best documents by matched entities.

    ``raw`` is matched entities (label and name) x weight of the relation, half
    a point for each matched name that is written as in the query, and the
    bonuses; ``score`` is raw by the best of the query, 0 where that isn't
    positive. ``edges`` (src, rel_type, label, entity_name), ``entities``
    (query_id, etype, value); null and blank names count nowhere.

    Documents with the same edges score alike, and so do queries with the same
    entities, so sets are scored, not rows: of a set of edges the k least
    documents, of a set of entities each query. A hot entity is thus joined once
    for each set that holds it.
    """
    known = edges.where("trim(entity_name) <> ''").select("src", "rel_type", "label", F.col("entity_name").alias("raw")).distinct()
    documents = known.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("rel_type", "label", "raw"))).alias("edges"))
    least = documents.withColumn("nth", F.row_number().over(Window.partitionBy("edges").orderBy("src"))).where(F.col("nth") <= k)
    classes = least.groupBy("edges").agg(F.array_sort(F.collect_list("src")).alias("members")).withColumn("doc_set", F.col("members")[0])
    said = entities.where("trim(value) <> ''").select("query_id", F.lower("etype").alias("etype"), "value").distinct()
    queries = said.groupBy("query_id").agg(F.array_sort(F.collect_set(F.struct("etype", "value"))).alias("asked"))
    sets = queries.groupBy("asked").agg(F.min("query_id").alias("query_set"))
    names = classes.select("doc_set", F.explode("edges").alias("e")).select("doc_set", "e.*", name_key(F.col("e.raw")).alias("name"))
    values = sets.select("query_set", F.explode("asked").alias("a")).select("query_set", name_key(F.col("a.value")).alias("value")).distinct()
    pairs = name_pairs(names.select("name").distinct(), values.select("value").distinct())
    met = names.join(pairs, "name").join(values, "value").groupBy("query_set", "doc_set").agg(F.collect_set(F.struct("rel_type", "label", "raw", "name")).alias("met"))
    rows = met.join(classes.select("doc_set", "edges"), "doc_set").join(sets, "query_set")

    asked = lambda t: F.transform(F.filter("asked", lambda x: x["etype"] == t), lambda x: x["value"])
    held = lambda t: F.transform(F.filter("edges", lambda x: x["rel_type"] == RELATIONS[t]), lambda x: x["raw"])
    said_as = F.transform("asked", lambda x: x["value"])
    weight = F.coalesce(*[F.when(F.exists("met", lambda m: m["rel_type"] == r), F.lit(w)) for r, w in RELATION_WEIGHTS], F.lit(1.0))
    rows = rows.withColumns({
        "entities": F.size(F.array_distinct(F.transform("met", lambda m: F.struct(m["label"], m["name"])))),
        "exact": F.size(F.array_intersect(F.array_distinct(F.transform("met", lambda m: m["raw"])), said_as)), "weight": weight,
    } | {f"bonus_{t}": c for t, c in entity_bonuses(asked, held).items()})
    total = F.col("entities") * F.col("weight") + 0.5 * F.col("exact")
    for t in BONUSES:
        total = total + F.col(f"bonus_{t}")
    parts = ["entities", "exact", "weight", *[f"bonus_{t}" for t in BONUSES]]
    rows = rows.select("query_set", "doc_set", *parts, total.alias("raw"))
    best = rows.withColumn("nth", F.row_number().over(Window.partitionBy("query_set").orderBy(F.round("raw", 9).desc(), "doc_set"))).where(F.col("nth") <= k).drop("nth")
    each = best.join(classes.select("doc_set", F.explode("members").alias("doc_id")), "doc_set").drop("doc_set")
    first = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_set").orderBy(F.round("raw", 9).desc(), "doc_id"))).where(F.col("rank") <= k)
    top = F.max("raw").over(Window.partitionBy("query_set"))
    first = first.withColumn("score", F.when(top > 0, F.col("raw") / top).otherwise(F.lit(0.0)))
    return queries.join(sets, "asked").select("query_id", "query_set").join(first, "query_set").drop("query_set").select("query_id", "doc_id", *parts, "raw", "score", "rank")


def name_pairs(names: DataFrame, values: DataFrame) -> DataFrame:
    """(name, value) of names and values that are equal, or one within the other at word borders from 3 characters on.

    Not all are compared with all: the shorter is a run of the longer one's
    words, so each is split into its runs of whole words and runs meet by equality.
    """

    def runs(column: str) -> Column:
        w = F.split(F.col(column), r"\s+")
        return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), " ")))))

    equal = names.join(values, F.col("name") == F.col("value"))
    inside = names.withColumn("run", F.explode(runs("name"))).where("length(run) >= 3 AND run <> name").join(values, F.col("run") == F.col("value")).select("name", "value")
    around = values.withColumn("run", F.explode(runs("value"))).where("length(run) >= 3 AND run <> value").join(names, F.col("run") == F.col("name")).select("name", "value")
    return equal.unionByName(inside).unionByName(around).distinct()


def most_shared(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed, src, shared): the k other documents that share most entities with each seed, smaller ids first; every entity counts.

    Documents with the same set of entities share equally much with all others,
    so sets are compared, not documents: of a seed's sets the first k + 1, of a
    set the k + 1 least documents can be among its k (one may be the seed).
    """
    names = edges.select("src", name_key(F.col("entity_name")).alias("name")).where("name <> ''").distinct()
    documents = names.groupBy("src").agg(F.array_sort(F.collect_set("name")).alias("names"))
    least = documents.withColumn("nth", F.row_number().over(Window.partitionBy("names").orderBy("src"))).where(F.col("nth") <= k + 1)
    sets = least.groupBy("names").agg(F.array_sort(F.collect_set("src")).alias("members")).withColumn("first", F.col("members")[0])
    own = documents.join(seeds.select(F.col("doc_id").alias("src")).distinct(), "src")
    salt = F.pmod(F.xxhash64("first"), F.lit(SALTS)).alias("salt")
    asked = own.select("names").distinct().select("names", F.explode("names").alias("name")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    held = sets.select("first", salt, F.explode("names").alias("name"))
    counts = asked.join(held, ["name", "salt"]).groupBy("names", "first").agg(F.count(F.lit(1)).alias("shared"))
    best = Window.partitionBy("names").orderBy(F.desc("shared"), "first")
    counts = counts.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    near = counts.join(sets.select("first", "members"), "first").select("names", "shared", F.explode("members").alias("doc_id"))
    near = own.select(F.col("src").alias("seed"), "names").join(near, "names").where("seed <> doc_id")
    last = Window.partitionBy("seed").orderBy(F.desc("shared"), "doc_id")
    return near.withColumn("nth", F.row_number().over(last)).where(F.col("nth") <= k).select("seed", F.col("doc_id").alias("src"), "shared")


def similar_above(edges: DataFrame, seeds: DataFrame, threshold: float, k: int) -> DataFrame:
    """(seed, src, similarity, rank): the k other documents whose entities, over those of either, are more than ``threshold`` the seed's.

    Sets are compared as in ``most_shared``. Two such sets share one of the
    rarest entities of the smaller part that they must have in common, so sets
    meet by their rare entities only.
    """
    names = edges.select("src", name_key(F.col("entity_name")).alias("name")).where("name <> ''").distinct()
    frequency = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    ordered = names.join(frequency, "name").groupBy("src").agg(F.array_sort(F.collect_set(F.struct("n", "name"))).alias("names"))
    documents = ordered.select("src", F.transform("names", lambda x: x["name"]).alias("names"))
    least = documents.withColumn("nth", F.row_number().over(Window.partitionBy("names").orderBy("src"))).where(F.col("nth") <= k + 1)
    sets = least.groupBy("names").agg(F.array_sort(F.collect_set("src")).alias("members")).withColumn("first", F.col("members")[0])
    own = documents.join(seeds.select(F.col("doc_id").alias("src")).distinct(), "src")
    rarest = lambda c: F.slice(c, 1, F.size(c) - F.ceil(F.size(c) * threshold).cast("int") + 1)
    asked = own.select("names").distinct().select("names", F.explode(rarest("names")).alias("name"))
    held = sets.select("first", F.col("names").alias("others"), F.explode(rarest("names")).alias("name"))
    pairs = asked.join(held, "name").select("names", "first", "others").distinct()
    alike = F.size(F.array_intersect("names", "others")) / F.size(F.array_union("names", "others"))
    near = pairs.withColumn("similarity", alike).where(F.col("similarity") > threshold).join(sets.select("first", F.explode("members").alias("doc_id")), "first")
    near = own.select(F.col("src").alias("seed"), "names").join(near, "names").where("seed <> doc_id")
    last = Window.partitionBy("seed").orderBy(F.round("similarity", 9).desc(), "doc_id")
    return near.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("seed", F.col("doc_id").alias("src"), "similarity", "rank")


def collected(edges: DataFrame) -> DataFrame:
    """(src, a sorted array of names for each of RELATIONS, n): one pass over the edges, without the fan-out of fifteen joins."""
    name = F.nullif(name_key(F.col("entity_name")), F.lit(""))
    lists = [F.array_sort(F.collect_set(F.when(F.col("rel_type") == r, name))).alias(t) for t, r in RELATIONS.items()]
    return edges.groupBy("src").agg(*lists, F.size(F.collect_set(F.when(name.isNotNull(), F.struct("rel_type", name.alias("name"))))).cast("long").alias("n"))


def alternative_actions(edges: DataFrame) -> DataFrame:
    """(src, alternatives): the actions of all documents with one of a document's errors, sorted."""
    side = lambda t: edges.where((F.col("rel_type") == RELATIONS[t]) & (F.trim("entity_name") != "")).select("src", name_key(F.col("entity_name")).alias(t)).distinct()
    answered = side("error").join(side("action"), "src").select("error", "action").distinct()
    rows = side("error").join(answered.groupBy("error").agg(F.collect_set("action").alias("actions")), "error")
    return rows.groupBy("src").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("actions")))).alias("alternatives"))


def paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth) of all nodes that directed edges (a, b) lead to, the least depth of each; starts(start). Cycles end.

    By doubling: ``jumps`` holds the pairs exactly 2^n steps apart. A round joins
    what is reached within 2^n - 1 steps with them and so reaches 2^(n + 1) - 1;
    a round that reaches nothing new is the last. The longest path takes a
    logarithmic number of rounds, each a written table that the next one reads
    once. Meant for chains and trees of steps, whose pairs at one distance are no
    more than their nodes times their branching.
    """
    reached = staged(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct(), "reached")
    jumps = staged(edges.select("a", "b").where("a <> b").distinct(), "jumps")
    count, steps = reached.count(), 1
    while True:
        further = reached.join(jumps, reached["node"] == jumps["a"]).select("start", F.col("b").alias("node"), (F.col("depth") + steps).alias("depth"))
        reached = staged(reached.unionByName(further).groupBy("start", "node").agg(F.min("depth").alias("depth")), "reached")
        before, count = count, reached.count()
        if count == before:
            return reached
        ahead = jumps.select(F.col("a").alias("b"), F.col("b").alias("c"))
        jumps, steps = staged(jumps.join(ahead, "b").select("a", F.col("c").alias("b")).distinct(), "jumps"), 2 * steps
