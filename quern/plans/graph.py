"""Entity graph (ops S16-S22, G1-G15, R1) and steps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import procedures as P
from quern.operators.ranking import ranked
from quern.plans.common import sql_ranked, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _edges(spark, folder):
    return table(spark, folder, "faq_edge")


@query("""SELECT 'all' AS what, NULL AS name, count(*) AS n FROM faq_edge UNION ALL SELECT 'relation', rel_type, count(*) FROM faq_edge GROUP BY rel_type UNION ALL SELECT 'label', label, count(*) FROM faq_edge GROUP BY label""")
def graph_stats(spark, folder):
    """Edges in all, by relation, by label."""
    return G.statistics(_edges(spark, folder))


@query("SELECT faq_id, count(*) AS n FROM (SELECT src AS faq_id FROM faq_edge) GROUP BY faq_id HAVING count(*) > 1")
def graph_key_uniqueness(spark, folder):
    """Keys that would break a constraint."""
    return G.repeated_keys(_edges(spark, folder).withColumnRenamed("src", "faq_id"), "faq_id")


@query("""SELECT src, rel_type, label, lower(trim(entity_name)) AS name, round(confidence, 6) AS confidence FROM faq_edge WHERE entity_name IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY src, rel_type, label, lower(trim(entity_name)) ORDER BY added_at DESC NULLS LAST, confidence DESC NULLS LAST) = 1""")
def graph_merge_edges(spark, folder):
    """One edge a key, latest properties."""
    edges = _edges(spark, folder).where("entity_name IS NOT NULL").withColumn("name", G.name_key(F.col("entity_name")))
    return G.merged_edges(edges, ["src", "rel_type", "label", "name"], "added_at").select("src", "rel_type", "label", "name", F.round("confidence", 6).alias("confidence"))


@query("""SELECT concat_ws('|', source, sheet_name, row_id) AS node, last(question ORDER BY faq_id) FILTER (question IS NOT NULL) AS question, last(intent ORDER BY faq_id) FILTER (intent IS NOT NULL) AS intent, count(*) AS loads
  FROM faq WHERE source IS NOT NULL AND sheet_name IS NOT NULL AND row_id IS NOT NULL GROUP BY source, sheet_name, row_id""")
def graph_upsert_nodes(spark, folder):
    """All loads of a node merged, property by property, in the order they came."""
    rows = table(spark, folder, "faq").where("source IS NOT NULL AND sheet_name IS NOT NULL AND row_id IS NOT NULL")
    loads = rows.select(F.concat_ws("|", "source", "sheet_name", F.col("row_id").cast("string")).alias("node"), "question", "intent", "faq_id")
    return G.folded_nodes(loads, "node", "faq_id").join(loads.groupBy("node").agg(F.count(F.lit(1)).alias("loads")), "node")


@query("""SELECT concat_ws('|', source, sheet_name, row_id) AS node, faq_id, count(*) OVER (PARTITION BY source, sheet_name, row_id) AS nodes FROM faq WHERE source IS NOT NULL AND sheet_name IS NOT NULL AND row_id IS NOT NULL""")
def graph_create_nodes(spark, folder):
    """The form that creates: each load is a node of its own."""
    rows = table(spark, folder, "faq").where("source IS NOT NULL AND sheet_name IS NOT NULL AND row_id IS NOT NULL")
    made = rows.select(F.concat_ws("|", "source", "sheet_name", F.col("row_id").cast("string")).alias("node"), "faq_id")
    return made.join(made.groupBy("node").agg(F.count(F.lit(1)).alias("nodes")), "node")


@query("""WITH n AS (SELECT DISTINCT label, lower(trim(entity_name)) AS name FROM faq_edge WHERE trim(entity_name) <> ''), e AS (SELECT DISTINCT turn_no, conv_id, topic FROM chat_turn WHERE topic IS NOT NULL)
  SELECT DISTINCT conv_id, turn_no, f.faq_id, lower(trim(e.topic)) AS name FROM e JOIN chat_turn t USING (conv_id, turn_no) JOIN faq f ON f.faq_id = t.faq_id JOIN n ON n.label = 'Action' AND n.name = lower(trim(e.topic))""")
def graph_relate_by_property(spark, folder):
    """An edge from the document a turn was answered by to the action it is about, both ends found by a property."""
    turns = table(spark, folder, "chat_turn").where("topic IS NOT NULL AND faq_id IS NOT NULL").select("conv_id", "turn_no", F.col("faq_id").cast("string").alias("document"), G.name_key(F.col("topic")).alias("action")).distinct()
    actions = _edges(spark, folder).where("trim(entity_name) <> ''").select("label", G.name_key(F.col("entity_name")).alias("name")).distinct().withColumn("id", F.concat_ws(":", "label", "name"))
    documents = table(spark, folder, "faq").select(F.lit("FAQ").alias("label"), F.col("faq_id").cast("string").alias("name"), F.col("faq_id").cast("string").alias("id"))
    edges = G.resolved_edges(turns, actions.unionByName(documents, allowMissingColumns=True), {"document": ("FAQ", "name"), "action": ("Action", "name")})
    return edges.select("conv_id", "turn_no", F.col("document_id").cast("long").alias("faq_id"), F.col("action").alias("name")).distinct()


_E = "(SELECT query_id, etype, lower(trim(value)) AS value FROM (SELECT DISTINCT conv_id * 1000 + turn_no AS query_id, m.key AS etype, unnest(m.value) AS value FROM (SELECT conv_id, turn_no, unnest(map_entries(entities)) AS m FROM chat_turn WHERE entities IS NOT NULL AND conv_id % 20 = 0)) WHERE trim(value) <> '')"
_N = "(SELECT DISTINCT src, rel_type, label, lower(trim(entity_name)) AS name FROM faq_edge WHERE trim(entity_name) <> '')"
MATCH = f"""(SELECT DISTINCT query_id, etype, src AS doc_id, rel_type, label, name, value, name = value AS exact FROM {_N} n, {_E} e WHERE name = value
  OR length(value) >= 3 AND contains(' ' || name || ' ', ' ' || value || ' ') OR length(name) >= 3 AND contains(' ' || value || ' ', ' ' || name || ' '))"""


def _turn_entities(spark, folder):
    turns = table(spark, folder, "chat_turn").where("entities IS NOT NULL AND conv_id % 20 = 0")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn_no")).alias("query_id"), F.explode(F.map_entries("entities")).alias("m")).select("query_id", F.col("m.key").alias("etype"), F.explode("m.value").alias("value"))


def _matches(spark, folder):
    return G.entity_matches(_edges(spark, folder), _turn_entities(spark, folder))


@query(f"SELECT * FROM {MATCH}")
def graph_entity_match(spark, folder):
    """Edges whose entity is one of the turn's, of every 20th conversation, equal or within one another."""
    return _matches(spark, folder)


_w = "CASE " + " ".join(f"WHEN bool_or(rel_type = '{r}') THEN {w}" for r, w in G.RELATION_WEIGHTS) + " ELSE 1.0 END"
_said = "(SELECT DISTINCT query_id, lower(etype) AS etype, value FROM (SELECT conv_id * 1000 + turn_no AS query_id, m.key AS etype, unnest(m.value) AS value FROM (SELECT conv_id, turn_no, unnest(map_entries(entities)) AS m FROM chat_turn WHERE entities IS NOT NULL AND conv_id % 20 = 0)) WHERE trim(value) <> '')"
_types = sorted({t for t in G.BONUSES})
_asked_lists = ", ".join(f"coalesce(list(DISTINCT value) FILTER (etype = '{t}'), []) AS q_{t}" for t in _types)
_held_lists = ", ".join(f"coalesce(list(DISTINCT entity_name) FILTER (rel_type = '{G.RELATIONS[t]}'), []) AS d_{t}" for t in _types)


def _within_sql(t: str, markers: list[str] = ()) -> str:
    either = " OR ".join(["contains(lower(x), lower(y))", "contains(lower(y), lower(x))", *[f"contains(lower(x), '{m}') AND contains(lower(y), '{m}')" for m in markers]])
    return f"len(list_filter(q_{t}, lambda x: len(list_filter(d_{t}, lambda y: {either})) > 0)) > 0"


_BONUS_SQL = f"""CASE WHEN list_has_any(q_service, d_service) THEN 2.0 WHEN len(q_service) > 0 AND len(d_service) > 0 THEN -1.0 ELSE 0.3 END AS bonus_service,
  CASE WHEN list_has_any(q_bank, d_bank) THEN 1.5 WHEN len(q_bank) > 0 AND len(d_bank) > 0 THEN -0.8 ELSE 0.2 END AS bonus_bank,
  CASE WHEN len(d_error) > 0 AND len(q_error) = 0 THEN -2.0 WHEN list_has_any(q_error, d_error) THEN 4.0 WHEN {_within_sql('error', G.ALIKE_ERRORS)} THEN 3.0 ELSE 0.0 END AS bonus_error,
  CASE WHEN list_has_any(q_action, d_action) THEN 1.8 ELSE 0.0 END AS bonus_action, CASE WHEN len(q_fee) > 0 AND len(d_fee) > 0 THEN 2.0 ELSE 0.0 END AS bonus_fee,
  CASE WHEN list_has_any(q_status, d_status) THEN 1.5 ELSE 0.0 END AS bonus_status, CASE WHEN len(q_limit) > 0 AND len(d_limit) > 0 THEN 1.5 ELSE 0.0 END AS bonus_limit,
  CASE WHEN {_within_sql('feature')} THEN 2.5 WHEN len(q_feature) > 0 AND len(d_feature) > 0 THEN -0.5 ELSE 0.0 END AS bonus_feature, CASE WHEN {_within_sql('topic')} THEN 2.0 ELSE 0.0 END AS bonus_topic"""
_sum = " + ".join(f"bonus_{t}" for t in G.BONUSES)
_shown_bonuses = ", ".join(f"bonus_{t}::DOUBLE AS bonus_{t}" for t in G.BONUSES)


@query(f"""WITH said AS {_said}, m AS (SELECT DISTINCT query_id, n.src AS doc_id, rel_type, label, lower(trim(entity_name)) AS name, entity_name AS raw FROM faq_edge n JOIN {_E} e ON lower(trim(n.entity_name)) = e.value
    OR length(e.value) >= 3 AND contains(' ' || lower(trim(n.entity_name)) || ' ', ' ' || e.value || ' ') OR length(trim(n.entity_name)) >= 3 AND contains(' ' || e.value || ' ', ' ' || lower(trim(n.entity_name)) || ' ') WHERE trim(n.entity_name) <> ''),
  a AS (SELECT query_id, doc_id, CAST(count(DISTINCT (label, name)) AS INT) AS entities, {_w} AS weight, list(DISTINCT raw) AS raws FROM m GROUP BY ALL), q AS (SELECT query_id, list(DISTINCT value) AS said, {_asked_lists} FROM said GROUP BY query_id),
  d AS (SELECT src AS doc_id, {_held_lists} FROM faq_edge WHERE trim(entity_name) <> '' GROUP BY src),
  b AS (SELECT a.query_id, a.doc_id, entities, CAST(len(list_intersect(raws, said)) AS INT) AS exact, weight::DOUBLE AS weight, {_BONUS_SQL} FROM a JOIN q USING (query_id) JOIN d USING (doc_id)),
  s AS (SELECT *, entities * weight + 0.5 * exact + {_sum} AS score FROM b)
  SELECT query_id, doc_id, entities, exact, weight, {_shown_bonuses}, round(score, 6) AS raw, round(CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END, 6) AS score, rank FROM ({sql_ranked('s', 10)})""")
def graph_entity_score(spark, folder):
    """The ten best documents of each turn of every 20th conversation, by matched entities, relation weight, names as written, and the bonus of each entity type."""
    hits = G.entity_scores(_edges(spark, folder), _turn_entities(spark, folder), 10)
    return hits.withColumns({c: F.round(c, 6) for c in ("raw", "score")})


@query("""WITH m AS (SELECT DISTINCT src, lower(trim(entity_name)) AS name FROM faq_edge WHERE trim(entity_name) <> ''),
  s AS (SELECT a.src AS query_id, b.src AS doc_id, count(*)::DOUBLE AS score FROM m a JOIN m b USING (name) WHERE a.src <> b.src AND a.src % 20 = 0 GROUP BY ALL)
  SELECT query_id, doc_id, CAST(score AS BIGINT) AS shared FROM (""" + sql_ranked("s", 3) + ")")
def graph_similar(spark, folder):
    """The three documents that share most entities with every 20th, frequent entities included."""
    edges = _edges(spark, folder)
    seeds = edges.where("src % 20 = 0").select(F.col("src").alias("doc_id")).distinct()
    return G.most_shared(edges, seeds, 3).select(F.col("seed").alias("query_id"), F.col("src").alias("doc_id"), "shared")


@query("""WITH m AS (SELECT src, list_sort(list(DISTINCT lower(trim(entity_name)))) AS names FROM faq_edge WHERE trim(entity_name) <> '' GROUP BY src),
  s AS (SELECT a.src AS query_id, b.src AS doc_id, len(list_intersect(a.names, b.names)) / len(list_distinct(a.names || b.names)) AS score FROM m a JOIN m b ON list_has_any(a.names, b.names) WHERE a.src <> b.src AND a.src % 20 = 0)
  SELECT query_id, doc_id, round(score, 6) AS similarity, rank FROM (""" + sql_ranked("(SELECT * FROM s WHERE score > 0.8)", 10) + ")")
def graph_similar_above(spark, folder):
    """Of every 20th document the ten most similar above 0.8, by shared entities over all."""
    edges = _edges(spark, folder)
    seeds = edges.where("src % 20 = 0").select(F.col("src").alias("doc_id")).distinct()
    return G.similar_above(edges, seeds, 0.8, 10).select(F.col("seed").alias("query_id"), F.col("src").alias("doc_id"), F.round("similarity", 6).alias("similarity"), "rank")


@query("""SELECT DISTINCT lower(trim(e.entity_name)) AS topic, f.faq_id, f.question FROM faq_edge e JOIN faq f ON f.faq_id = e.src WHERE e.rel_type = 'ABOUT' AND trim(e.entity_name) <> ''""")
def graph_topic_documents(spark, folder):
    """The documents about each topic."""
    about = _edges(spark, folder).where("rel_type = 'ABOUT' AND trim(entity_name) <> ''").select(G.name_key(F.col("entity_name")).alias("topic"), F.col("src").alias("faq_id")).distinct()
    return about.join(table(spark, folder, "faq").select("faq_id", "question"), "faq_id").distinct()


@query("""SELECT a.name AS action, b.name AS bank, count(*) AS n FROM (SELECT DISTINCT src, lower(trim(entity_name)) AS name FROM faq_edge WHERE rel_type = 'SUGGESTS_ACTION' AND entity_name IS NOT NULL) a
  JOIN (SELECT DISTINCT src, lower(trim(entity_name)) AS name FROM faq_edge WHERE rel_type = 'MENTIONS_BANK' AND entity_name IS NOT NULL) b USING (src) GROUP BY ALL""")
def graph_one_hop(spark, folder):
    """What one hop over the document leads to."""
    side = lambda r, n: _edges(spark, folder).where((F.col("rel_type") == r) & F.col("entity_name").isNotNull()).select("src", G.name_key(F.col("entity_name")).alias(n)).distinct()
    return side("SUGGESTS_ACTION", "action").join(side("MENTIONS_BANK", "bank"), "src").groupBy("action", "bank").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT e.name AS error, array_to_string(list_sort(list(DISTINCT a.name)), '; ') AS actions FROM (SELECT DISTINCT src, lower(trim(entity_name)) AS name FROM faq_edge WHERE rel_type = 'DESCRIBES_ERROR' AND entity_name IS NOT NULL) e
  JOIN (SELECT DISTINCT src, lower(trim(entity_name)) AS name FROM faq_edge WHERE rel_type = 'SUGGESTS_ACTION' AND entity_name IS NOT NULL) a USING (src) GROUP BY e.name""")
def graph_error_solutions(spark, folder):
    """Actions collected by error."""
    side = lambda r, n: _edges(spark, folder).where((F.col("rel_type") == r) & F.col("entity_name").isNotNull()).select("src", G.name_key(F.col("entity_name")).alias(n)).distinct()
    both = side("DESCRIBES_ERROR", "error").join(side("SUGGESTS_ACTION", "action"), "src")
    return both.groupBy("error").agg(F.array_join(F.array_sort(F.collect_set("action")), "; ").alias("actions"))


_of = lambda r: f"coalesce(array_to_string(list_sort(list(DISTINCT lower(trim(entity_name))) FILTER (rel_type = '{r}' AND trim(entity_name) <> '')), '; '), '')"


@query(f"""WITH e AS (SELECT src, {', '.join(f"{_of(r)} AS \"{t}\"" for t, r in G.RELATIONS.items())}, count(DISTINCT (rel_type, lower(trim(entity_name)))) FILTER (trim(entity_name) <> '') AS n FROM faq_edge GROUP BY src),
  x AS (SELECT DISTINCT src, lower(trim(entity_name)) AS name FROM faq_edge WHERE rel_type = 'DESCRIBES_ERROR' AND trim(entity_name) <> ''), y AS (SELECT DISTINCT src, lower(trim(entity_name)) AS name FROM faq_edge WHERE rel_type = 'SUGGESTS_ACTION' AND trim(entity_name) <> ''),
  o AS (SELECT x.name AS error, list_distinct(list(y.name)) AS actions FROM x JOIN y USING (src) GROUP BY x.name), alt AS (SELECT src, array_to_string(list_sort(list_distinct(flatten(list(actions)))), '; ') AS alternatives FROM x JOIN o ON o.error = x.name GROUP BY src)
  SELECT faq_id, {', '.join(f"coalesce(\"{t}\", '') AS \"{t}\"" for t in G.RELATIONS)}, coalesce(n, 0) AS n, coalesce(alternatives, '') AS alternatives FROM faq LEFT JOIN e ON e.src = faq_id LEFT JOIN alt ON alt.src = faq_id""")
def graph_context(spark, folder):
    """Entities of each document collected by each of the fifteen relations in one pass, and the actions that its errors are answered with elsewhere, joined once."""
    edges = _edges(spark, folder)
    found, alternatives = G.collected(edges), G.alternative_actions(edges)
    faq = table(spark, folder, "faq").select("faq_id")
    rows = faq.join(found.withColumnRenamed("src", "faq_id"), "faq_id", "left").join(alternatives.withColumnRenamed("src", "faq_id"), "faq_id", "left")
    joined = lambda c: F.coalesce(F.array_join(c, "; "), F.lit("")).alias(c)
    return rows.select("faq_id", *[joined(t) for t in G.RELATIONS], F.coalesce("n", F.lit(0)).alias("n"), joined("alternatives"))


LINES = """(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate) AS number, l_partkey FROM lineitem)"""


def _lines(spark, folder):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate"]
    return table(spark, folder, "lineitem").withColumn("number", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))).select(F.col("l_orderkey").alias("parent_id"), "number", F.col("l_partkey").alias("text"))


@query(f"""WITH RECURSIVE l AS (SELECT l_orderkey * 100 + number AS a, l_orderkey * 100 + number + 1 AS b FROM {LINES} x WHERE EXISTS (SELECT 1 FROM {LINES} y WHERE y.l_orderkey = x.l_orderkey AND y.number = x.number + 1)),
  w AS (SELECT o_orderkey * 100 + 1 AS start, o_orderkey * 100 + 1 AS node, 0 AS depth FROM orders UNION ALL SELECT start, b, depth + 1 FROM w JOIN l ON l.a = w.node) SELECT start, node, min(depth) AS depth FROM w GROUP BY ALL""")
def graph_recursive_path(spark, folder):
    """All steps that are reached from each order's first, however many."""
    lines = _lines(spark, folder)
    here = lines.select((F.col("parent_id") * 100 + F.col("number")).alias("b"), F.lag("number").over(Window.partitionBy("parent_id").orderBy("number")).alias("before"), "parent_id")
    edges = here.where("before IS NOT NULL").select((F.col("parent_id") * 100 + F.col("before")).alias("a"), "b")
    starts = table(spark, folder, "orders").select((F.col("o_orderkey") * 100 + 1).alias("start"))
    return G.paths(edges, starts)


@query(f"SELECT l_orderkey AS parent_id, number, l_partkey AS text, total FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS total FROM {LINES}) WHERE number = 2")
def step_next(spark, folder):
    """P5: step 2 of each order with the number of all."""
    return P.steps_from(_lines(spark, folder), 2, True)


@query(f"SELECT l_orderkey AS parent_id, number, l_partkey AS text, total FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS total FROM {LINES}) WHERE number >= 3")
def step_remaining(spark, folder):
    """The steps from 3 on with the number of all."""
    return P.steps_from(_lines(spark, folder), 3, False)


@query(f"SELECT l_orderkey AS parent_id, string_agg('Step ' || number || ': ' || l_partkey, chr(10) ORDER BY number) AS text FROM {LINES} WHERE number >= 2 GROUP BY l_orderkey")
def step_text(spark, folder):
    """The continuation from step 2 as one text, numbering kept."""
    return P.rendered(_lines(spark, folder).where("number >= 2"))


STEP_SQL = """(SELECT faq_id, CAST(regexp_extract(line, '^\\s*(?:Bước |B|Step |\\(?)(\\d+)', 1) AS INT) AS number, line FROM (SELECT faq_id, unnest(string_split(answer, chr(10))) AS line FROM (SELECT faq_id, answer FROM faq WHERE answer IS NOT NULL))
  WHERE regexp_matches(line, '^\\s*(Bước \\d{1,3}:|B\\d{1,3} -|Step \\d{1,3}:|\\(?\\d{1,3}[.)]) '))"""


@query(f"SELECT faq_id, count(*) AS steps, min(number) AS first, max(number) AS last FROM {STEP_SQL} GROUP BY faq_id")
def step_parse(spark, folder):
    """Numbered steps read from answers."""
    found = P.parsed_steps(table(spark, folder, "faq"), "faq_id", "answer")
    return found.groupBy("faq_id").agg(F.count(F.lit(1)).alias("steps"), F.min("number").alias("first"), F.max("number").alias("last"))


_mark = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN {n}" for n, p in enumerate(P.MARKS, 1)) + " END"
_number = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN CAST(regexp_extract(line, '{p}', 1) AS INT)" for p in P.MARKS) + " END"


@query(f"""WITH l AS (SELECT faq_id, unnest(string_split(answer, chr(10))) AS line FROM faq WHERE answer IS NOT NULL), m AS (SELECT faq_id, {_mark} AS mark, {_number} AS number FROM l), o AS (SELECT faq_id, min(mark) AS mark FROM m GROUP BY faq_id)
  SELECT faq_id, mark, count(*) AS steps, min(number) AS first, max(number) AS last FROM m JOIN o USING (faq_id, mark) GROUP BY ALL""")
def step_marks(spark, folder):
    """The steps of each answer by the first of three ways to mark them that it uses."""
    found = P.first_marked_steps(table(spark, folder, "faq"), "faq_id", "answer")
    return found.groupBy("faq_id", "mark").agg(F.count(F.lit(1)).alias("steps"), F.min("number").alias("first"), F.max("number").alias("last"))


@query(f"""WITH t AS (SELECT faq_id, min(number) AS n FROM {STEP_SQL} GROUP BY faq_id), g AS (SELECT src, count(*) AS e FROM faq_edge WHERE rel_type = 'SUGGESTS_ACTION' AND entity_name IS NOT NULL GROUP BY src)
  SELECT f.faq_id, CASE WHEN t.n IS NOT NULL THEN 'text' WHEN g.e IS NOT NULL THEN 'graph' ELSE 'none' END AS source FROM faq f LEFT JOIN t USING (faq_id) LEFT JOIN g ON g.src = f.faq_id""")
def step_hybrid(spark, folder):
    """Steps from the text, else from the graph."""
    text = P.parsed_steps(table(spark, folder, "faq"), "faq_id", "answer").select("faq_id", F.lit(1).alias("t")).distinct()
    edges = _edges(spark, folder).where("rel_type = 'SUGGESTS_ACTION' AND entity_name IS NOT NULL").select(F.col("src").alias("faq_id"), F.lit(1).alias("g")).distinct()
    rows = table(spark, folder, "faq").select("faq_id").join(text, "faq_id", "left").join(edges, "faq_id", "left")
    return rows.select("faq_id", F.when(F.col("t") == 1, "text").when(F.col("g") == 1, "graph").otherwise("none").alias("source"))


NEED = ["p_type", "promo"]


@query("""WITH p AS (SELECT o_orderkey, o_orderpriority, count(*) AS steps, sum(CAST(contains(lower(p_name), 'blue') AS INT) + CAST(contains(lower(p_name), 'widget') AS INT)) AS optional FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL
   HAVING bool_or(contains(lower(p_name), 'gear')) AND bool_or(contains(lower(p_type), 'a'))) SELECT o_orderpriority AS topic, o_orderkey AS process_id, steps FROM p QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY optional DESC, steps DESC, o_orderkey) = 1""")
def process_lookup(spark, folder):
    """For each topic the process with all required words, by optional words, then by steps."""
    parts = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    steps = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").join(parts, "l_partkey")
    topics = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = steps.join(topics, "l_orderkey").select(F.col("o_orderpriority").alias("topic"), F.col("l_orderkey").alias("process_id"), "p_name", "p_type")
    return P.best_process(rows, {"p_name": ["gear"], "p_type": ["a"]}, {"p_name": ["blue", "widget"]})
