"""Queries by name over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lucidgraph import data, iterations
from lucidgraph.functions import terms, vectors
from lucidgraph.functions.measures import with_measures
from lucidgraph.operators import clustering, deduction, embedding, evaluation, graph, mining
from lucidgraph.plans.patterns import match
from lucidgraph.plans.rules import Atom, Rule
from lucidgraph.sources import labels as label_sources
from lucidgraph.sources import output, triples
from lucidgraph.sources.storage import work_folder
from lucidgraph.streaming.supports import RunningSupports

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SMALL = ("nation", "customer", "supplier")
STAR = ("nation", "customer", "orders")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str) -> list:
    return [F.round(F.col(n), 6).alias(n) for n in names]


_KG, _SMALL, _STAR, _LAB = data.graph_sql(), data.graph_sql(SMALL), data.graph_sql(STAR), data.CUSTOMERS_SQL

# ---- sources and sinks ----


@query("SELECT 'n' || n_nationkey AS s, 'name' AS p, n_name AS o FROM nation WHERE strpos(n_name, ' ') = 0 UNION ALL SELECT 'n' || n_nationkey, 'name', split_part(n_name, ' ', 1) FROM nation WHERE strpos(n_name, ' ') > 0")
def src_triples_file(spark, d):
    """A whitespace-separated file: extra fields are left out, and lines with a backslash."""
    path = work_folder(spark, "triples")
    n = data.table(spark, d, "nation")
    lines = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit("\tname \t"), "n_name", F.lit(" ")).alias("value"))
    lines.unionByName(n.select(F.concat(F.lit("a\\b c "), "n_name").alias("value"))).write.text(path)
    return triples.read_triples(spark, path)


@query("SELECT * FROM (VALUES ('a', 'knows', 'b'), ('b', 'knows', 'c'), ('a', 'knows', 'b')) AS t(s, p, o)")
def src_list(spark, d):
    return triples.from_list(spark, [("a", "knows", "b"), ("b", "knows", "c"), ("a", "knows", "b")])


@query(f"SELECT g, count(*) AS n FROM ({data.quads_sql()}) GROUP BY g")
def src_graph_size(spark, d):
    return data.quads(spark, d).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT s, p, o FROM ({data.quads_sql(('nation',))}) UNION ALL SELECT s, p, o FROM ({data.quads_sql(('nation',))}) UNION ALL SELECT s, p, o FROM ({data.quads_sql(('supplier',))})")
def src_joint(spark, d):
    n = data.graph(spark, d, ("nation",))
    return triples.joint(n, n, data.graph(spark, d, ("supplier",)))


@query("SELECT 'http://execute_aux.org/auxC' || c || '_' || i AS s, 'http://execute_aux.org/auxBelongsTo' AS p, 'http://execute_aux.org/aux_dummy_entity_' || c || '_' || i AS o FROM range(10) a(c), range(-1, 11) b(i)")
def src_place_holders(spark, d):
    return triples.place_holders(spark)


@query("SELECT 'c' || c_custkey AS entity, 'segment' AS relation, c_mktsegment AS label FROM customer")
def src_labels_file(spark, d):
    path = work_folder(spark, "labels")
    data.table(spark, d, "customer").select(F.concat_ws("\t", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("segment"), "c_mktsegment").alias("value")).write.text(path)
    return label_sources.read_labels(spark, path)


@query("SELECT 'p' || p_partkey AS entity, 'http://execute_aux.org/auxBelongsTo' AS relation, p_brand AS label FROM part")
def src_labels_two_columns(spark, d):
    path = work_folder(spark, "labels")
    data.table(spark, d, "part").select(F.concat_ws(" ", F.concat(F.lit("p"), F.col("p_partkey").cast("string")), "p_brand").alias("value")).write.text(path)
    return label_sources.read_labels(spark, path)


@query("SELECT 'c' || c_custkey AS s, 'http://execute_aux.org/auxBelongsTo' AS p, 'http://execute_aux.org/auxC' || c_mktsegment || '_3' AS o FROM customer")
def src_cluster_triples(spark, d):
    pairs = data.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("entity"), F.col("c_mktsegment").alias("label"))
    return label_sources.cluster_triples(pairs, iteration=3)


@query("SELECT 'p' || p_partkey AS name, row_number() OVER (ORDER BY 'p' || p_partkey) - 1 AS id FROM part")
def src_dictionary(spark, d):
    """Dumped with its count and read again."""
    path = work_folder(spark, "dictionary")
    names = data.table(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    output.write_dictionary(label_sources.dictionary(names), path)
    return output.read_dictionary(spark, path)


@query(f"SELECT g, s, p, o FROM ({data.quads_sql(('nation', 'supplier'))})")
def snk_quads(spark, d):
    """Written by graph, twice the same rows in one, and read again."""
    path = work_folder(spark, "quads")
    q = data.quads(spark, d, ("nation", "supplier"))
    triples.write_quads(q.unionByName(q.filter("g = 'nation'")), path)
    return spark.read.parquet(path).select(F.col("g").cast("string").alias("g"), "s", "p", "o")


@query(f"SELECT s, p, o FROM ({data.quads_sql(('nation',))}) UNION SELECT s, p, o FROM ({data.quads_sql(('customer',))})")
def snk_index_union(spark, d):
    q = triples.index(data.graph(spark, d, ("nation",)), "a").unionByName(triples.index(data.graph(spark, d, ("customer", "nation")), "b"))
    return triples.graphs(q, ["a", "b"])


@query(f"SELECT g, count(*) AS n FROM ({data.quads_sql(SMALL)}) WHERE g <> 'supplier' GROUP BY g")
def snk_drop_graph(spark, d):
    q = data.quads(spark, d, SMALL)
    left = triples.dropped(q, "supplier")
    assert triples.graph_exists(q, "supplier") and not triples.graph_exists(left, "supplier")
    return left.groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT '<' || s || '>' || chr(9) || '<' || p || '>' || chr(9) || '<' || o || '>' AS value FROM ({_SMALL})")
def snk_triple_lines(spark, d):
    return triples.triple_lines(data.graph(spark, d, SMALL), braces=True)


@query(f"SELECT p || '(' || s || ',' || o || ')' AS value FROM ({_SMALL})")
def snk_fact_lines(spark, d):
    return triples.fact_lines(data.graph(spark, d, SMALL))


@query("SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 3) AS total FROM embeddings")
def snk_vector_lines(spark, d):
    """Vectors written as lines and read again."""
    v = data.vectors(spark, d)
    lines = v.select("id", F.array_join(F.transform("vec", lambda x: x.cast("string")), "\t").alias("value"))
    back = lines.select(F.col("id").alias("vec_id"), F.transform(F.split("value", "\t"), lambda x: x.cast("float").cast("double")).alias("v"))
    return back.select("vec_id", F.size("v").cast("long").alias("n"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))


@query(f"SELECT s || chr(9) || o || chr(9) || p AS value FROM ({_SMALL})")
def prj_subject_object_relation(spark, d):
    lines = data.graph(spark, d, SMALL).select(F.concat_ws("\t", "s", "p", "o").alias("value"))
    return triples.subject_object_relation(lines)


# ---- terms ----


@query(
    "SELECT page_id, url, regexp_extract(url, '^https?://[^/?#]*/?([^?#]*)', 1) AS path, strpos(url, chr(92)) = 0 AS valid, starts_with(url, 'http:') OR starts_with(url, 'https:') AS is_url, "
    "'<' || url || '>' AS braced, '<' || url || '> <seenAt> ?t.' AS pattern, '(' || url || ',seenAt,?t)' AS tuple FROM pages"
)
def fn_terms(spark, d):
    u = F.col("url")
    braced = terms.add_braces(u)
    return data.table(spark, d, "pages").select(
        "page_id", terms.strip_braces(braced).alias("url"), terms.url_path(u).alias("path"), terms.valid_id(u).alias("valid"), terms.is_url(u).alias("is_url"), braced.alias("braced"),
        terms.query_pattern(u, F.lit("seenAt"), F.lit("?t")).alias("pattern"), terms.tuple_text(u, F.lit("seenAt"), F.lit("?t")).alias("tuple"),
    )


@query("SELECT 'http://exp-data.org/' || c_custkey AS s, 'http://exp-data.org/segment' AS p, 'http://exp-data.org/' || c_mktsegment AS o FROM customer")
def fn_full_urls(spark, d):
    rows = data.table(spark, d, "customer").select(F.concat(F.lit("<"), F.col("c_custkey").cast("string"), F.lit(">")).alias("s"), F.lit("segment").alias("p"), F.col("c_mktsegment").alias("o"))
    return triples.formatted(rows, "http://exp-data.org/")


@query("SELECT page_id, replace(replace(url, '=', '%3D'), '%3D', '=') AS url FROM pages")
def fn_unquote(spark, d):
    return data.table(spark, d, "pages").select("page_id", terms.unquoted(F.replace("url", F.lit("="), F.lit("%3D"))).alias("url"))


# ---- projections, sets, neighbourhoods ----


@query(f"SELECT label, count(*) AS n FROM ({_LAB}) GROUP BY label")
def agg_label_distribution(spark, d):
    return label_sources.distribution(data.customers_by_region(spark, d))


@query(f"SELECT DISTINCT label FROM ({_LAB})")
def prj_unique_labels(spark, d):
    return label_sources.unique_labels(data.customers_by_region(spark, d))


@query("SELECT user_id AS entity, arg_max(event_type, (ts, event_id)) AS label FROM events GROUP BY user_id")
def prj_last_label(spark, d):
    rows = data.table(spark, d, "events").select(F.col("user_id").alias("entity"), F.col("event_type").alias("label"), F.struct("ts", "event_id").alias("at"))
    return label_sources.as_mapping(rows, "at")


@query(f"SELECT p, count(DISTINCT s) AS subjects, count(DISTINCT o) AS objects, round(count(DISTINCT s) / count(DISTINCT o), 6) AS ratio, count(DISTINCT s) / count(DISTINCT o) > 10 AS binds_constants, count(DISTINCT s) / count(DISTINCT o) > 50 AS categorical FROM ({_KG}) GROUP BY p")
def agg_predicate_stats(spark, d):
    rows = graph.predicate_classes(graph.predicate_stats(data.graph(spark, d)))
    return rows.withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT DISTINCT p, true AS subjects_close, true AS objects_close FROM ({_KG})")
def agg_predicate_stats_sketched(spark, d):
    """Whether sketched counts are within 20 % of the exact ones: four times the sketch's usual error."""
    kg = data.graph(spark, d)
    sketched = graph.predicate_stats(kg, approximate=True).select("p", F.col("subjects").alias("s"), F.col("objects").alias("o"))
    both = graph.predicate_stats(kg).join(sketched, "p")
    return both.select("p", *[(F.abs(F.col(x) - F.col(c)) <= 0.2 * F.col(c)).alias(f"{c}_close") for x, c in (("s", "subjects"), ("o", "objects"))])


@query(
    f"""WITH kg AS ({_SMALL}), e AS (SELECT s AS node, p, 'out' AS dir, o AS nbr FROM kg UNION SELECT o, p, 'in', s FROM kg),
k AS (SELECT *, row_number() OVER (PARTITION BY node, p, dir ORDER BY nbr) AS n FROM e WHERE node LIKE 'nation/%')
SELECT DISTINCT CASE WHEN dir = 'out' THEN node ELSE nbr END AS s, p, CASE WHEN dir = 'out' THEN nbr ELSE node END AS o FROM k WHERE n <= 7"""
)
def graph_neighbours(spark, d):
    kg = data.graph(spark, d, SMALL)
    return graph.neighbours(kg, kg.filter("o like 'nation/%'").select("o").distinct(), limit=7)


@query(
    f"""WITH kg AS ({_SMALL}), e AS (SELECT s AS node, p, 'out' AS dir, o AS nbr FROM kg UNION SELECT o, p, 'in', s FROM kg),
k AS (SELECT *, row_number() OVER (PARTITION BY node, p, dir ORDER BY nbr) AS n FROM e), c AS (SELECT * FROM k WHERE n <= 100),
t1 AS (SELECT * FROM c WHERE node = 'region/1'), f AS (SELECT DISTINCT nbr AS node FROM t1 WHERE nbr <> 'region/1'),
t AS (SELECT * FROM t1 UNION ALL SELECT c.* FROM c JOIN f USING (node))
SELECT DISTINCT CASE WHEN dir = 'out' THEN node ELSE nbr END AS s, p, CASE WHEN dir = 'out' THEN nbr ELSE node END AS o FROM t"""
)
def graph_slice_two_hops(spark, d):
    return graph.subgraph(data.graph(spark, d, SMALL), spark.createDataFrame([("region/1",)], "node string"), hops=2)


@query(f"SELECT DISTINCT p FROM ({_KG}) WHERE s LIKE 'order/1'")
def graph_predicates_of(spark, d):
    return graph.predicates_of(data.graph(spark, d), Atom("order/1", "?p", "?y"))


@query(f"SELECT DISTINCT s AS x FROM ({_SMALL}) WHERE p = 'inNation' AND o = 'nation/3' ORDER BY x LIMIT 100")
def graph_entities_of(spark, d):
    return graph.entities_of(data.graph(spark, d, SMALL), [Atom("?x", "inNation", "nation/3")])


@query(
    f"""WITH a AS (SELECT p, count(*) / count(DISTINCT s) AS t, count(*) / count(DISTINCT o) AS h FROM ({_KG}) GROUP BY p)
SELECT p, round(t, 6) AS tails_per_head, round(h, 6) AS heads_per_tail, (CASE WHEN h > 1.5 THEN 'n' ELSE '1' END) || '-' || (CASE WHEN t > 1.5 THEN 'n' ELSE '1' END) AS kind FROM a"""
)
def graph_relation_cardinality(spark, d):
    return graph.relation_cardinality(data.graph(spark, d)).select("p", *_r("tails_per_head", "heads_per_tail"), "kind")


@query(f"SELECT p, side, count(*) AS n, min(name) AS first, max(name) AS last FROM (SELECT DISTINCT p, 'head' AS side, s AS name FROM ({_SMALL}) UNION SELECT DISTINCT p, 'tail', o FROM ({_SMALL})) GROUP BY p, side")
def graph_type_constraints(spark, d):
    rows = graph.type_constraints(data.graph(spark, d, SMALL))
    return rows.groupBy("p", "side").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"), F.max("name").alias("last"))


@query(
    f"""WITH kg AS ({_SMALL}), e AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT s AS name FROM kg UNION SELECT o FROM kg)),
r AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM (SELECT DISTINCT p AS name FROM kg))
SELECT h.id AS h, r.id AS r, t.id AS t FROM kg JOIN e h ON h.name = s JOIN e t ON t.name = o JOIN r ON r.name = p"""
)
def graph_encoded(spark, d):
    kg = data.graph(spark, d, SMALL)
    ents = label_sources.dictionary(kg.select(F.col("s").alias("name")).union(kg.select("o")))
    return graph.encode(kg, ents, label_sources.dictionary(kg.select(F.col("p").alias("name"))))


@query(f"SELECT node, count(*) AS degree FROM (SELECT s AS node FROM ({_SMALL}) UNION ALL SELECT o FROM ({_SMALL})) GROUP BY node")
def graph_degrees(spark, d):
    return graph.degrees(data.graph(spark, d, SMALL))


@query(f"SELECT DISTINCT label FROM ({_LAB}) WHERE label <> 'region/2'")
def set_negative_heads(spark, d):
    return label_sources.unique_labels(data.customers_by_region(spark, d)).filter("label <> 'region/2'")


@query(f"SELECT DISTINCT o AS name FROM ({_SMALL}) WHERE p = 'inNation' EXCEPT SELECT s FROM ({_SMALL}) WHERE p = 'inNation'")
def set_except(spark, d):
    kg = data.graph(spark, d, SMALL).filter("p = 'inNation'")
    return kg.select(F.col("o").alias("name")).subtract(kg.select("s"))


# ---- patterns ----

_HEAD = Atom("?x", "livesIn", "?c")


def _rule(*atoms: tuple[str, str, str]) -> Rule:
    return Rule(_HEAD, tuple(Atom(*a) for a in atoms))


@query(f"SELECT DISTINCT a.s AS x, a.o AS y, b.s AS z FROM ({_STAR}) a JOIN ({_STAR}) b ON b.o = a.s WHERE a.p = 'inNation' AND b.p = 'placedBy' AND a.s <> b.s AND a.o <> b.s")
def pat_join(spark, d):
    found = match(data.graph(spark, d, STAR), [_rule(("?x", "inNation", "?y"), ("?z", "placedBy", "?x"))])
    return found.select(F.col("v_x").alias("x"), F.col("v_y").alias("y"), F.col("v_z").alias("z"))


@query(f"SELECT DISTINCT a.s AS x FROM ({_STAR}) a JOIN ({_STAR}) b ON b.o = a.s JOIN ({_STAR}) c ON c.s = b.s WHERE a.p = 'inNation' AND a.o = 'nation/4' AND b.p = 'placedBy' AND c.p = 'priority' AND c.o = 'priority/1-URGENT'")
def pat_constants(spark, d):
    rule = _rule(("?x", "inNation", "nation/4"), ("?z", "placedBy", "?x"), ("?z", "priority", "priority/1-URGENT"))
    return match(data.graph(spark, d, STAR), [rule], keep=["?x"]).select(F.col("v_x").alias("x")).distinct()


@query(f"SELECT DISTINCT a.s AS x, b.s AS y FROM ({_SMALL}) a JOIN ({_SMALL}) b ON a.o = b.o WHERE a.p = 'inRegion' AND b.p = 'inRegion' AND a.s <> b.s")
def pat_injective(spark, d):
    """Two nations of a region: variables bind different nodes."""
    return match(data.graph(spark, d, ("nation",)), [_rule(("?x", "inRegion", "?r"), ("?y", "inRegion", "?r"))], keep=["?x", "?y"]).select(F.col("v_x").alias("x"), F.col("v_y").alias("y")).distinct()


@query(f"SELECT DISTINCT a.s AS x, c.s AS y FROM ({_SMALL}) a JOIN ({_SMALL}) b ON a.o = b.s JOIN ({_SMALL}) n ON n.o = b.o JOIN ({_SMALL}) c ON c.o = n.s WHERE a.p = 'inNation' AND a.s LIKE 'supplier/%' AND b.p = 'inRegion' AND n.p = 'inRegion' AND c.p = 'inNation' AND c.s LIKE 'supplier/%' AND a.o = c.o AND a.s <> c.s")
def pat_cycle(spark, d):
    """A closing atom joins on both its ends: pairs of suppliers of one nation, found around its region."""
    kg = data.graph(spark, d, ("nation", "supplier"))
    rule = _rule(("?x", "inNation", "?n"), ("?n", "inRegion", "?r"), ("?y", "inNation", "?n"))
    return match(kg, [rule], keep=["?x", "?y"]).select(F.col("v_x").alias("x"), F.col("v_y").alias("y")).distinct()


@query(
    f"""WITH kg AS ({_STAR}), lab AS ({_LAB})
SELECT label AS cluster, binding, count(DISTINCT entity) AS support FROM (SELECT DISTINCT label, entity, p AS binding FROM lab JOIN kg ON s = entity) GROUP BY ALL HAVING count(DISTINCT entity) > 3"""
)
def pat_predicate_bindings(spark, d):
    return mining.pattern_bindings(data.graph(spark, d, STAR), _rule(("?x", "?p", "?y")), data.customers_by_region(spark, d), "?p", min_support=3)


@query(
    f"""WITH kg AS ({_STAR}), lab AS ({_LAB}), c AS (SELECT label AS cluster, b.o AS binding, count(DISTINCT entity) AS support FROM lab JOIN kg a ON a.o = entity AND a.p = 'placedBy' JOIN kg b ON b.s = a.s AND b.p = 'priority' GROUP BY ALL)
SELECT cluster, binding, support FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY support DESC, binding) AS n FROM c) WHERE n <= 3"""
)
def pat_constant_bindings_top(spark, d):
    return mining.pattern_bindings(data.graph(spark, d, STAR), _rule(("?z", "placedBy", "?x"), ("?z", "priority", "?v")), data.customers_by_region(spark, d), "?v", limit=3)


@query(f"SELECT entity AS x FROM ({_LAB}) WHERE entity IN (SELECT o FROM ({_STAR}) WHERE p = 'placedBy')")
def pat_restricted_anchors(spark, d):
    """A body and a restriction to the labelled entities."""
    anchors = data.customers_by_region(spark, d).select("entity")
    return match(data.graph(spark, d, STAR), [_rule(("?z", "placedBy", "?x"))], keep=["?x"], anchors=anchors).select(F.col("v_x").alias("x")).distinct()


_GIVEN = (
    _rule(("?x", "inNation", "?y"), ("?y", "inRegion", "region/1")),
    _rule(("?z", "placedBy", "?x")),
    _rule(("?z", "placedBy", "?x"), ("?z", "priority", "priority/1-URGENT")),
    _rule(("?z", "placedBy", "?x"), ("?z", "status", "status/P")),
)
_GIVEN_SQL = (
    "SELECT DISTINCT a.s AS x FROM kg a JOIN kg b ON b.s = a.o WHERE a.p = 'inNation' AND b.p = 'inRegion' AND b.o = 'region/1'",
    "SELECT DISTINCT o FROM kg WHERE p = 'placedBy'",
    "SELECT DISTINCT a.o FROM kg a JOIN kg b ON b.s = a.s WHERE a.p = 'placedBy' AND b.p = 'priority' AND b.o = 'priority/1-URGENT'",
    "SELECT DISTINCT a.o FROM kg a JOIN kg b ON b.s = a.s WHERE a.p = 'placedBy' AND b.p = 'status' AND b.o = 'status/P'",
)
_SUPPORTS = f"""kg AS ({_STAR}), lab AS ({_LAB}), m(rule_id, x) AS ({" UNION ALL ".join(f"SELECT '{r.rule_id()}', x FROM ({q}) AS t(x)" for r, q in zip(_GIVEN, _GIVEN_SQL))}),
sz AS (SELECT label AS cluster, count(DISTINCT entity) AS size FROM lab GROUP BY label),
g AS (SELECT r.rule_id, sz.cluster, sz.size, (SELECT count(DISTINCT m.x) FROM m JOIN lab ON lab.entity = m.x WHERE m.rule_id = r.rule_id AND lab.label = sz.cluster) AS support FROM (SELECT DISTINCT rule_id FROM m) r CROSS JOIN sz)"""
# over a full grid g(rule_id, cluster, size, support)
_MEASURES = """
c AS (SELECT *, support / size::DOUBLE AS cov FROM g),
o AS (SELECT a.rule_id, a.cluster, max(b.cov) AS cmax, sum(b.cov) AS csum, sum(b.support) AS osup, sum(b.size) AS osize, count(*) AS n, count(*) FILTER (WHERE b.support > 0) AS nz FROM c a JOIN c b ON a.rule_id = b.rule_id AND a.cluster <> b.cluster GROUP BY ALL),
q AS (SELECT c.rule_id, c.cluster, c.support, c.size, cov AS c_coverage, CASE WHEN csum + cov > 0 THEN cov / (csum + cov) END AS n_coverage, CASE WHEN cmax < cov THEN cov - cmax ELSE 0 END AS x_coverage,
  CASE WHEN support + osup > 0 THEN (support + osup) / (size + osize)::DOUBLE * (support / (support + osup)::DOUBLE - size / (size + osize)::DOUBLE) END AS wr_acc,
  CASE WHEN nz + (support > 0)::INT > 0 THEN cov * (log10((n + 1) / (nz + (support > 0)::INT)::DOUBLE + 1) + 1) END AS tfidf FROM c JOIN o USING (rule_id, cluster))"""
_MARKS = ("c_coverage", "n_coverage", "x_coverage", "wr_acc", "tfidf")
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in _MARKS)


@query(f"WITH {_SUPPORTS} SELECT rule_id, cluster, support, size FROM g")
def pat_supports(spark, d):
    return mining.supports(data.graph(spark, d, STAR), _GIVEN, data.customers_by_region(spark, d))


@query(f"WITH {_SUPPORTS}, {_MEASURES} SELECT rule_id, cluster, support, size, {_ROUNDED} FROM q")
def fn_measures(spark, d):
    grid = with_measures(mining.supports(data.graph(spark, d, STAR), _GIVEN, data.customers_by_region(spark, d)))
    return grid.select("rule_id", "cluster", "support", "size", *_r(*_MARKS))


@query(f"SELECT label AS cluster, count(DISTINCT entity) AS size FROM ({_LAB}) GROUP BY label")
def agg_cluster_sizes(spark, d):
    return mining.cluster_sizes(data.customers_by_region(spark, d))


# ---- mining ----


def _mined_sql(kg: str, least: float, beam: int) -> str:
    """Path rules of up to two atoms with constants, each level bound, cut to a beam, pruned and measured."""
    atom = lambda d, a, b, p: f"CASE WHEN {d} = 'out' THEN '({a} ' || {p} || ' ' || {b} || ')' ELSE '(' || {b} || ' ' || {p} || ' {a})' END"
    return f"""
WITH kg AS ({kg}), lab AS ({_LAB}), sz AS (SELECT label AS cluster, count(DISTINCT entity) AS size, floor(count(DISTINCT entity) * {least}::DOUBLE) AS least FROM lab GROUP BY label),
st AS (SELECT p, count(DISTINCT s) / count(DISTINCT o) > 10 AS bind, count(DISTINCT s) / count(DISTINCT o) > 50 AS cat FROM kg GROUP BY p),
e AS (SELECT s AS node, p, 'out' AS d, o AS nbr FROM kg UNION ALL SELECT o, p, 'in', s FROM kg),
m1 AS (SELECT DISTINCT entity AS x, label AS cluster, p, d, nbr FROM lab JOIN e ON node = entity WHERE nbr <> entity),
b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, d ORDER BY c DESC, p) AS n FROM (SELECT cluster, d, p, count(DISTINCT x) AS c FROM m1 GROUP BY ALL) JOIN sz USING (cluster) WHERE c > least) WHERE n <= {beam}),
k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, d, p ORDER BY c DESC, nbr) AS n FROM (SELECT cluster, d, p, nbr, count(DISTINCT x) AS c FROM m1 SEMI JOIN b1 USING (cluster, d, p) SEMI JOIN (SELECT p FROM st WHERE bind) USING (p) WHERE d = 'out' GROUP BY ALL) JOIN sz USING (cluster) WHERE c > least) WHERE n <= {beam}),
a1 AS (SELECT cluster, d, p FROM b1 ANTI JOIN (SELECT p FROM st WHERE cat) USING (p)),
m2 AS (SELECT DISTINCT m1.x, m1.cluster, m1.p AS p1, m1.d AS d1, e.p AS p2, e.d AS d2, e.nbr AS nbr FROM m1 JOIN a1 USING (cluster, d, p) JOIN e ON e.node = m1.nbr WHERE e.nbr <> m1.x AND e.nbr <> m1.nbr),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, p1, d1, d2 ORDER BY c DESC, p2) AS n FROM (SELECT cluster, p1, d1, d2, p2, count(DISTINCT x) AS c FROM m2 GROUP BY ALL) JOIN sz USING (cluster) WHERE c > least) WHERE n <= {beam}),
k2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster, p1, d1, d2, p2 ORDER BY c DESC, nbr) AS n FROM (SELECT cluster, p1, d1, d2, p2, nbr, count(DISTINCT x) AS c FROM m2 SEMI JOIN b2 USING (cluster, p1, d1, d2, p2) SEMI JOIN (SELECT p AS p2 FROM st WHERE bind) USING (p2) WHERE d2 = 'out' GROUP BY ALL) JOIN sz USING (cluster) WHERE c > least) WHERE n <= {beam}),
a2 AS (SELECT cluster, p1, d1, d2, p2 FROM b2 WHERE p2 NOT IN (SELECT p FROM st WHERE cat)),
all1 AS (SELECT DISTINCT entity AS x, label AS cluster, p, d, nbr FROM lab JOIN e ON node = entity WHERE nbr <> entity),
all2 AS (SELECT DISTINCT m.x, m.cluster, m.p AS p1, m.d AS d1, e.p AS p2, e.d AS d2, e.nbr FROM all1 m SEMI JOIN (SELECT DISTINCT d, p FROM a1) t USING (d, p) JOIN e ON e.node = m.nbr WHERE e.nbr <> m.x AND e.nbr <> m.nbr),
r AS (SELECT cluster, {atom('d', '?x', "'?x1'", 'p')} AS rule_id, d, p, NULL AS v, NULL AS d2, NULL AS p2 FROM a1
  UNION ALL SELECT cluster, {atom('d', '?x', 'nbr', 'p')}, d, p, nbr, NULL, NULL FROM k1
  UNION ALL SELECT cluster, {atom('d1', '?x', "'?x1'", 'p1')} || ', ' || {atom('d2', '?x1', "'?x2'", 'p2')}, d1, p1, NULL, d2, p2 FROM a2
  UNION ALL SELECT cluster, {atom('d1', '?x', "'?x1'", 'p1')} || ', ' || {atom('d2', '?x1', 'nbr', 'p2')}, d1, p1, nbr, d2, p2 FROM k2),
u AS (SELECT DISTINCT rule_id, d, p, v, d2, p2 FROM r),
s AS (SELECT u.rule_id, m.cluster, count(DISTINCT m.x) AS support FROM u JOIN all1 m ON u.d2 IS NULL AND m.d = u.d AND m.p = u.p AND (u.v IS NULL OR m.nbr = u.v) GROUP BY ALL
  UNION ALL SELECT u.rule_id, m.cluster, count(DISTINCT m.x) FROM u JOIN all2 m ON m.d1 = u.d AND m.p1 = u.p AND m.d2 = u.d2 AND m.p2 = u.p2 AND (u.v IS NULL OR m.nbr = u.v) GROUP BY ALL),
g AS (SELECT u.rule_id, sz.cluster, sz.size, coalesce(s.support, 0) AS support FROM u CROSS JOIN sz LEFT JOIN s USING (rule_id, cluster)),
{_MEASURES}
SELECT q.cluster, q.rule_id AS body_text, q.support, q.size, {_ROUNDED} FROM q SEMI JOIN r USING (rule_id, cluster)"""


_PATHS = mining.Settings(shape="path", max_length=2, min_coverage=0.1, beam=20)


@query(_mined_sql(_STAR, 0.1, 20))
def mine_paths(spark, d):
    """All path rules of up to two atoms over a tenth of a region's customers."""
    rules, grid = mining.Miner(data.graph(spark, d, STAR), _PATHS).mine(data.customers_by_region(spark, d))
    return mining.rules_table(rules, grid, "livesIn").select("cluster", "body_text", "support", "size", *_r(*_MARKS))


def _mined(shape: str, **more) -> Query:
    def run(spark, d):
        s = mining.Settings(shape=shape, min_coverage=0.1, **more)
        return mining.explain(data.graph(spark, d, STAR), data.customers_by_region(spark, d), s).select("cluster", "rank", "body_text", "support", "size", *_r(*_MARKS))

    run.__name__ = f"mine_{shape}"
    return run


for _shape in ("tree", "categorical", "subgraph"):
    query()(_mined(_shape))


@query()
def mine_first_generation(spark, d):
    s = mining.Settings(shape="path", min_coverage=0.1, first_generation=True, constant_relations=("inRegion", "priority", "status"), categorical_relations=("priority", "status"))
    return mining.explain(data.graph(spark, d, STAR), data.customers_by_region(spark, d), s).select("cluster", "rank", "body_text", "support", "size", *_r(*_MARKS))


@query(f"SELECT cluster, body_text, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY x_coverage DESC NULLS LAST, body_text) AS n FROM ({_mined_sql(_STAR, 0.1, 20)})) WHERE n <= 3")
def top_rules_per_cluster(spark, d):
    rows = mine_paths(spark, d)
    order = Window.partitionBy("cluster").orderBy(F.col("x_coverage").desc_nulls_last(), "body_text")
    return rows.withColumn("rank", F.row_number().over(order)).filter("rank <= 3").select("cluster", "body_text", "rank")


# ---- deduction and feedback ----


def _rules() -> list[Rule]:
    quality = (0.9, 0.2, 0.6, 0.6)
    heads = ("region/1", "region/2", "region/3", "region/1")
    return [Rule(Atom("?x", "livesIn", h), r.body, {"x_coverage": q}) for r, q, h in zip(_GIVEN, quality, heads)]


_FIRED = f"""kg AS ({_STAR}), fired(s, o, rule_id, quality) AS ({" UNION ALL ".join(f"SELECT x, '{r.head.o}', '{r.rule_id()}', {r.qualities['x_coverage']}::DOUBLE FROM ({q}) AS t(x)" for r, q in zip(_rules(), _GIVEN_SQL))}),
con AS (SELECT s, o, max(quality) AS quality, arg_min(rule_id, (-quality, rule_id)) AS main_rule, count(*) AS n_rules FROM fired GROUP BY s, o),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY quality DESC, o) AS rank FROM con WHERE quality > 0.1::DOUBLE)"""


@query(f"WITH {_FIRED} SELECT s, 'livesIn' AS p, o, rule_id, quality FROM fired")
def ded_fire(spark, d):
    return deduction.fire(data.graph(spark, d, STAR), _rules())


def _inferred(spark, d, topk: int = -1) -> DataFrame:
    return deduction.infer(data.graph(spark, d, STAR), _rules(), min_quality=0.1, topk=topk)


@query(f"WITH {_FIRED} SELECT s, 'livesIn' AS p, o, quality, main_rule, n_rules, rank FROM ranked WHERE rank <= 2")
def ded_infer(spark, d):
    return _inferred(spark, d, 2).select("s", "p", "o", "quality", "main_rule", F.size("sources").cast("long").alias("n_rules"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_FIRED} SELECT s, 'livesIn_4' AS p, o FROM ranked WHERE rank = 1")
def fb_direct(spark, d):
    return deduction.direct(_inferred(spark, d, 1), 4)


@query(f"WITH {_FIRED}, one AS (SELECT s, o FROM ranked WHERE rank = 1) SELECT a.s, 'http://execute.org/sameCLAs_0' AS p, b.s AS o FROM one a JOIN one b ON a.o = b.o")
def fb_same_cluster(spark, d):
    """All ordered pairs of a cluster: the result itself grows with the square of its size."""
    return deduction.same_cluster(_inferred(spark, d, 1))


@query(
    f"""WITH {_FIRED}, k AS (SELECT f.* FROM fired f JOIN ranked r USING (s, o) WHERE r.rank <= 5 AND f.quality > 0.1::DOUBLE)
SELECT s, 'http://execute.org/ground_1' AS p, 'http://execute.org/r' || rule_id || '_1' AS o FROM k UNION ALL SELECT 'http://execute.org/r' || rule_id || '_1', 'http://execute.org/explain_1', o FROM k"""
)
def fb_rule_nodes(spark, d):
    return deduction.rule_nodes(_inferred(spark, d, 5), 0.1, 1)


@query(f"WITH {_FIRED} SELECT f.s, 'http://execute.org/r' || rule_id || '_2' AS p, f.o FROM fired f JOIN ranked r USING (s, o) WHERE r.rank <= 5 AND f.quality > 0.1::DOUBLE")
def fb_rule_edges(spark, d):
    return deduction.feedback(data.graph(spark, d, STAR), _rules(), None, "explAsEdges", min_quality=0.1, iteration=2)


@query(f"WITH {_FIRED} SELECT s || chr(9) || 'livesIn' || chr(9) || o || chr(9) || quality AS value FROM ranked")
def snk_prediction_lines(spark, d):
    return deduction.prediction_lines(_inferred(spark, d))


# ---- evaluation ----

_PAIRS_SQL = "SELECT vec_id AS id, label AS truth, vec_id % 7 AS predicted FROM embeddings"


def _pairs(spark, d) -> DataFrame:
    return data.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("truth"), F.pmod("vec_id", F.lit(7)).alias("predicted"))


@query(f"SELECT truth, predicted, count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY ALL")
def ev_contingency(spark, d):
    return evaluation.contingency(_pairs(spark, d))


@query(
    f"""WITH t AS (SELECT truth, predicted, count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY ALL), a AS (SELECT truth, sum(n) AS x FROM t GROUP BY truth), b AS (SELECT predicted, sum(n) AS x, max(n) AS top FROM t GROUP BY predicted),
n AS (SELECT sum(n)::DOUBLE AS n, sum(n * (n - 1) / 2) AS p FROM t), pa AS (SELECT sum(x * (x - 1) / 2) AS p FROM a), pb AS (SELECT sum(x * (x - 1) / 2) AS p, sum(top) AS top FROM b),
ha AS (SELECT -sum(x / n * ln(x / n)) AS h FROM a, n), hb AS (SELECT -sum(x / n * ln(x / n)) AS h FROM b, n),
mi AS (SELECT sum(t.n / n.n * ln(t.n * n.n / (a.x * b.x))) AS m FROM t JOIN a USING (truth) JOIN b USING (predicted) CROSS JOIN n)
SELECT round((n.p - pa.p * pb.p / (n.n * (n.n - 1) / 2)) / ((pa.p + pb.p) / 2 - pa.p * pb.p / (n.n * (n.n - 1) / 2)), 6) AS ari, round(m / ((ha.h + hb.h) / 2), 6) AS nmi, round(m / ha.h, 6) AS hms, round(pb.top / n.n, 6) AS pur FROM n, pa, pb, ha, hb, mi"""
)
def ev_partition_scores(spark, d):
    return evaluation.partition_scores(evaluation.contingency(_pairs(spark, d))).select(*_r("ari", "nmi", "hms", "pur"))


#: The best one-to-one assignment of the 7 predicted clusters: the most for each set of true ones that is used up.
_ASSIGNED = (
    f"c AS (SELECT truth, predicted, count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY ALL), tr AS (SELECT truth, size, row_number() OVER (ORDER BY truth) - 1 AS bit FROM (SELECT truth, count(*) AS size FROM ({_PAIRS_SQL}) GROUP BY truth)), s0 AS (SELECT 0 AS used, 0 AS got, 0::DOUBLE AS part), "
    + ", ".join(
        f"s{k + 1} AS (SELECT used, max(got) AS got, arg_max(part, (got, part)) AS part FROM (SELECT used | (1 << bit) AS used, got + coalesce(n, 0) AS got, part + coalesce(n, 0) / size AS part FROM s{k} JOIN tr ON used & (1 << bit) = 0 LEFT JOIN c ON c.truth = tr.truth AND c.predicted = {k}) GROUP BY used)"
        for k in range(7)
    )
    + ", best AS (SELECT max(got) AS got, arg_max(part, (got, part)) AS part FROM s7)"
)


@query(f"WITH {_ASSIGNED} SELECT round(got / (SELECT sum(size) FROM tr), 6) AS micro, round(part / (SELECT count(*) FROM tr), 6) AS macro FROM best")
def ev_accuracy(spark, d):
    micro, macro = evaluation.accuracy(evaluation.contingency(_pairs(spark, d)))
    return spark.createDataFrame([(round(micro, 6), round(macro, 6))], "micro double, macro double")




_V = "list_transform(embedding, lambda x: x::DOUBLE)"
_D2 = "sqrt(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: (a.v[k] - b.v[k]) ** 2)))"
_COS = "list_cosine_similarity(a.v, b.v)"


def _silhouette_sql(label: str) -> str:
    return f"""WITH v AS (SELECT vec_id AS id, {label} AS label, {_V} AS v FROM embeddings),
d AS (SELECT a.id, a.label AS la, b.label AS lb, avg({_D2}) AS d FROM v a JOIN v b ON a.id <> b.id GROUP BY ALL),
s AS (SELECT id, max(CASE WHEN la = lb THEN d END) AS a, min(CASE WHEN la <> lb THEN d END) AS b FROM d GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS ss FROM s"""


@query(
    f"""WITH {_ASSIGNED}, p AS ({SQL['ev_partition_scores']}), ss AS ({_silhouette_sql('vec_id % 7')})
SELECT 'ACC' AS metric, round(got / (SELECT sum(size) FROM tr), 6) AS value FROM best UNION ALL SELECT 'ARI', ari FROM p UNION ALL SELECT 'NMI', nmi FROM p UNION ALL SELECT 'SS', ss FROM ss"""
)
def ev_all(spark, d):
    v = data.vectors(spark, d)
    found = evaluation.evaluate(_pairs(spark, d), v.select("id", "vec", F.pmod("id", F.lit(7)).alias("label")))
    return spark.createDataFrame([(k, round(float(x), 6)) for k, x in found.items()], "metric string, value double")


@query(_silhouette_sql("label"))
def ev_silhouette(spark, d):
    """All pairs of vectors: the measure is quadratic."""
    return evaluation.silhouette(data.vectors(spark, d)).select(*_r("ss"))


@query(f"WITH v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings) SELECT round(avg(list_cosine_similarity(v, list_transform(range(1, len(v) + 1), lambda k: v[k] + (k % 3 - 1) / 10.0::DOUBLE))), 6) AS similarity FROM v")
def ev_mean_similarity(spark, d):
    v = data.vectors(spark, d).select("id", F.transform("vec", lambda x: x.cast("double")).alias("vec"))
    other = v.select("id", F.transform("vec", lambda x, i: x + (F.pmod(i + 1, F.lit(3)) - 1) / F.lit(10.0)).alias("vec"))
    return evaluation.mean_similarity(v, other).select(*_r("similarity"))


@query(
    f"""WITH m AS ({_mined_sql(_STAR, 0.1, 20)}), r AS (SELECT cluster, 'wr_acc' AS measure, wr_acc AS q, row_number() OVER (PARTITION BY cluster ORDER BY wr_acc DESC NULLS LAST, body_text) AS n FROM m
UNION ALL SELECT cluster, 'x_coverage', x_coverage, row_number() OVER (PARTITION BY cluster ORDER BY x_coverage DESC NULLS LAST, body_text) FROM m)
SELECT measure, CAST(k AS INTEGER) AS k, round(avg(q), 5) AS value FROM r JOIN range(1, 4) AS t(k) ON n <= k WHERE k <= (SELECT max(c) FROM (SELECT count(*) AS c FROM m GROUP BY cluster)) GROUP BY measure, k"""
)
def ev_top_quality(spark, d):
    rows = mine_paths(spark, d).withColumnRenamed("body_text", "rule_id")
    return evaluation.top_quality(rows, ("wr_acc", "x_coverage")).withColumn("value", F.round("value", 5))


@query(
    f"""WITH m AS ({_mined_sql(_STAR, 0.1, 20)}), f AS (SELECT cluster, x_coverage, row_number() OVER (PARTITION BY cluster ORDER BY x_coverage DESC, body_text) AS n FROM m)
SELECT (SELECT count(DISTINCT label) FROM ({_LAB})) AS clusters, (SELECT count(*) FROM f WHERE n = 1) AS clusters_with_any_explans, (SELECT count(*) FROM f WHERE n = 1 AND x_coverage > 0.5::DOUBLE) AS clusters_with_accepted_explans"""
)
def ev_explanation_stats(spark, d):
    order = Window.partitionBy("cluster").orderBy(F.col("x_coverage").desc_nulls_last(), "body_text")
    rows = mine_paths(spark, d).withColumn("rank", F.row_number().over(order))
    return evaluation.explanation_stats(data.customers_by_region(spark, d).select(F.col("label").alias("cluster")), rows, threshold=0.5)


@query(
    f"""WITH {_FIRED}, lab AS ({_LAB}), t AS (SELECT entity AS s, label AS o, coalesce(rank, 0) AS r FROM lab LEFT JOIN ranked ON ranked.s = entity AND ranked.o = label),
n AS (SELECT count(*) AS n, count(DISTINCT r) AS kinds FROM t)
SELECT 'predictions_mrr' AS metric, round(sum(CASE WHEN r > 0 THEN 1.0::DOUBLE / r ELSE 0 END) / count(*), 6) AS value FROM t
UNION ALL SELECT 'predictions_coverage', round((SELECT count(DISTINCT s) FROM ranked WHERE s IN (SELECT s FROM t)) / (SELECT count(DISTINCT s) FROM t), 6)
UNION ALL SELECT 'hit@' || k, round((SELECT count(*) FROM t WHERE r BETWEEN 1 AND k) / (SELECT n FROM n), 6) FROM range(1, 20) AS q(k) WHERE k <= (SELECT kinds FROM n)"""
)
def ev_predictions(spark, d):
    truth = data.customers_by_region(spark, d).select(F.col("entity").alias("s"), F.col("label").alias("o"))
    return evaluation.evaluate_predictions(_inferred(spark, d), truth).withColumn("value", F.round("value", 6))


@query(f"WITH {_FIRED} SELECT entity, label AS truth, coalesce((SELECT max(o) FROM ranked WHERE s = entity AND rank = 1), '-2') AS predicted FROM ({_LAB})")
def ev_aligned(spark, d):
    return label_sources.aligned(data.customers_by_region(spark, d), _inferred(spark, d, 1).select(F.col("s").alias("entity"), F.col("o").alias("label")))


@query("SELECT event_type, round(avg(value), 6) AS value, count(*) AS n FROM events GROUP BY event_type")
def ev_average_trials(spark, d):
    rows = data.table(spark, d, "events").select("event_type", "value")
    mean = evaluation.average_trials(rows, ["event_type"])
    return mean.join(rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "event_type").withColumn("value", F.round("value", 6))


@query("WITH m AS (SELECT n_nationkey AS iteration, (n_nationkey * 7) % 11 AS score FROM nation) SELECT iteration, score FROM m WHERE iteration > 0 ORDER BY score DESC, iteration LIMIT 1")
def ev_best_iteration(spark, d):
    rows = data.table(spark, d, "nation").select(F.col("n_nationkey").alias("iteration"), F.pmod(F.col("n_nationkey") * 7, F.lit(11)).alias("score"))
    return evaluation.best_iteration(rows, "score")


# ---- vectors ----


@query(f"WITH v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings) SELECT a.id AS i, b.id AS j, round({_D2}, 6) AS d, round((1 - {_COS}) / 2, 6) AS c FROM v a JOIN v b ON a.id < b.id")
def vec_distances(spark, d):
    return evaluation.distance_table(data.vectors(spark, d), {"d": ("euclidean", 1.0), "c": ("cosine", 0.5)}, digits=6, sort="d")


_S3 = "FROM v a JOIN v b ON b.id = a.id + 1 JOIN v c ON c.id = a.id + 2"
_IDX = "range(1, len(a.v) + 1)"
_HALF = "range(1, (len(a.v) // 2) + 1)"


@query(
    f"""WITH v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings)
SELECT a.id, round(-list_sum(list_transform({_IDX}, lambda k: abs(a.v[k] + b.v[k] - c.v[k]))), 5) AS transe, round(list_sum(list_transform({_IDX}, lambda k: a.v[k] * b.v[k] * c.v[k])), 5) AS distmult,
round(list_sum(list_transform({_HALF}, lambda k: a.v[k] * b.v[k] * c.v[k] + a.v[k + 32] * b.v[k] * c.v[k + 32] + a.v[k] * b.v[k + 32] * c.v[k + 32] - a.v[k + 32] * b.v[k + 32] * c.v[k])), 5) AS complex {_S3}"""
)
def vec_scores(spark, d):
    v = data.vectors(spark, d)
    s, p, o = (v.select((F.col("id") - i).alias("id"), F.col("vec").alias(n)) for i, n in enumerate("spo"))
    rows = s.join(p, "id").join(o, "id")
    c = [F.col(x) for x in "spo"]
    return rows.select("id", F.round(vectors.transe(*c), 5).alias("transe"), F.round(vectors.distmult(*c), 5).alias("distmult"), F.round(vectors.complex_score(*c), 5).alias("complex"))


@query(f"WITH v AS (SELECT vec_id AS id, list_transform({_V}, lambda x: x * (vec_id % 3)) AS v FROM embeddings), n AS (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v) SELECT id, round(list_sum(list_transform(v, lambda x: x * CASE WHEN n > 1 THEN 1 / n ELSE 1 END)), 5) AS total FROM n")
def vec_clipped(spark, d):
    v = data.vectors(spark, d).select("id", F.transform("vec", lambda x: x.cast("double") * F.pmod("id", F.lit(3))).alias("vec"))
    return v.select("id", F.round(F.aggregate(vectors.clipped(F.col("vec")), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query(
    f"""WITH v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings), c AS (SELECT id AS centre, v FROM v WHERE id < 5),
r AS (SELECT a.id, b.centre, 1 / (1 + ({_D2}) ** 2) AS r FROM v a CROSS JOIN c b), q AS (SELECT *, r / sum(r) OVER (PARTITION BY id) AS q FROM r), f AS (SELECT centre, sum(q) AS f FROM q GROUP BY centre)
SELECT id, centre, round(q, 6) AS q, round((q * q / f) / sum(q * q / f) OVER (PARTITION BY id), 6) AS p FROM q JOIN f USING (centre)"""
)
def vec_soft_assignment(spark, d):
    v = data.vectors(spark, d)
    return vectors.soft_assignment(v, v.filter("id < 5").select(F.col("id").alias("centre"), "vec")).select("id", "centre", *_r("q", "p"))


# ---- clustering ----


def _clustered(name: str, **settings) -> Query:
    def run(spark, d):
        return clustering.method(name, **settings)(data.vectors(spark, d).select("id", "vec"))

    run.__name__ = f"cl_{name}"
    return run


_DBSCAN = {"eps": 0.6, "least": 4, "metric": "cosine"}
query(
    f"""WITH RECURSIVE v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings), near AS MATERIALIZED (SELECT a.id AS i, b.id AS j FROM v a JOIN v b ON 1 - {_COS} <= {_DBSCAN['eps']}::DOUBLE OR a.id = b.id),
core AS MATERIALIZED (SELECT i FROM near GROUP BY i HAVING count(*) >= {_DBSCAN['least']}), link AS MATERIALIZED (SELECT i, j FROM near WHERE i IN (SELECT i FROM core) AND j IN (SELECT i FROM core)),
reach(i, j) AS (SELECT i, i FROM core UNION SELECT r.i, l.j FROM reach r JOIN link l ON l.i = r.j), root AS (SELECT i, min(j) AS root FROM reach GROUP BY i),
border AS (SELECT n.i AS id, arg_min(r.root, n.j) AS root FROM near n JOIN root r ON r.i = n.j GROUP BY n.i), own AS (SELECT v.id, coalesce(c.root, b.root) AS root FROM v LEFT JOIN root c ON c.i = v.id LEFT JOIN border b ON b.id = v.id),
num AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM root))
SELECT id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM own LEFT JOIN num USING (root)"""
)(_clustered("dbscan", **_DBSCAN))


def _settled(name: str, **settings) -> Query:
    """What holds of a clustering whose numbers depend on chance or on rounding: points, clusters and gapless numbers."""

    def run(spark, d):
        rows = clustering.method(name, **settings)(data.vectors(spark, d).select("id", "vec"))
        one = rows.agg(F.count_distinct("id").alias("points"), F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster").alias("clusters"), F.max("cluster").alias("last"))
        return one.select("points", "rows", *(["clusters"] if "k" in settings else []), (F.col("last") + 1 == F.col("clusters")).alias("gapless"))

    run.__name__ = f"cl_{name}"
    return run


for _name, _settings in {"kmeans": {"k": 10, "restarts": 3}, "hierarchical": {"k": 10}, "spectral": {"k": 10}, "multicut": {"cut": 0.55}}.items():
    query(f"SELECT count(*) AS points, count(*) AS rows, {'10 AS clusters, ' if 'k' in _settings else ''}true AS gapless FROM embeddings")(_settled(_name, **_settings))


# ---- embedding ----


def _fit(model: str) -> Query:
    def run(spark, d):
        kg = data.graph(spark, d, ("nation", "supplier"))
        t = embedding.Training(model=model, k=16, epochs=40, rounds=2, rate=0.05 if model != "convkb" else 0.02)
        losses = embedding.train(kg, t)[1]
        return spark.createDataFrame([(model, len(losses), losses[-1] < losses[0])], "model string, rounds long, fell boolean")

    run.__name__ = f"em_train_{model}"
    return run


for _model in embedding.MODELS:
    query(f"SELECT '{_model}' AS model, 2 AS rounds, true AS fell")(_fit(_model))


def _small_model(spark, d) -> tuple[DataFrame, embedding.Embedding]:
    kg = data.graph(spark, d, ("nation",))
    return kg, embedding.train(kg, embedding.Training(k=8, epochs=40, rounds=1))[0]


@query(f"SELECT p, count(*) AS facts, true AS in_unit, true AS above_others FROM ({data.graph_sql(('nation',))}) GROUP BY p")
def em_predict_calibrated(spark, d):
    """Scores of all facts and of as many with the object moved on, and probabilities fitted to them."""
    kg, model = _small_model(spark, d)
    region = F.concat(F.lit("region/"), F.pmod(F.substring("o", 8, 9).cast("int") + 1, F.lit(5)).cast("string"))
    good, bad = embedding.predict(model, kg), embedding.predict(model, kg.withColumn("o", region))
    fitted = embedding.calibrate(good, bad)
    sure, other = (embedding.probabilities(fitted, x) for x in (good, bad))
    least = other.agg(F.avg("probability")).first()[0]
    return sure.groupBy("p").agg(F.count(F.lit(1)).alias("facts"), F.min(F.col("probability").between(0, 1)).alias("in_unit"), (F.avg("probability") > least).alias("above_others"))


@query(f"SELECT name FROM (SELECT s AS name FROM ({_SMALL}) UNION SELECT o FROM ({_SMALL}))")
def em_save_load(spark, d):
    """All names after a model of the nations went on with all triples, was saved and loaded."""
    _, model = _small_model(spark, d)
    grown = embedding.start(data.graph(spark, d, SMALL), model.training, model)
    path = work_folder(spark, "model")
    embedding.save(grown, path)
    return embedding.load(spark, path).entities.select("name")


@query(f"SELECT name FROM (SELECT s AS name FROM ({_SMALL}) UNION SELECT o FROM ({_SMALL})) EXCEPT (SELECT s FROM ({data.graph_sql(('nation',))}) UNION SELECT o FROM ({data.graph_sql(('nation',))}))")
def em_new_names(spark, d):
    known = embedding.vocabulary(data.graph(spark, d, ("nation",)))[0]
    return embedding.vocabulary(data.graph(spark, d, SMALL))[0].join(known, "name", "left_anti")


@query("SELECT vec_id AS id, label, len(embedding) AS n FROM embeddings WHERE label = 3")
def em_lookup(spark, d):
    v = data.vectors(spark, d)
    found = embedding.lookup(v.select(F.col("id").cast("string").alias("name"), "vec"), v.filter("label = 3").select(F.col("id").cast("string")), "raise")
    return found.select(F.col("name").cast("long").alias("id"), F.lit(3).alias("label"), F.size("vec").cast("long").alias("n"))


@query(
    f"""WITH k AS ({_SMALL}), c AS ({data.graph_sql(('nation',))}), f AS (SELECT entity AS s, 'f1' AS p, label AS o FROM ({_LAB}) UNION ALL SELECT entity, 'f2', label FROM ({_LAB}))
SELECT 'retrain' AS mode, (SELECT count(*) FROM k) + (SELECT count(*) FROM f) AS n UNION ALL SELECT 'subgraph_only', (SELECT count(*) FROM c) UNION ALL SELECT 'graph_only', (SELECT count(*) FROM k)
UNION ALL SELECT 'assignments_only', (SELECT count(*) FROM f) UNION ALL SELECT 'assignments_graph', (SELECT count(*) FROM k) + (SELECT count(*) FROM f) UNION ALL SELECT 'assignments_subgraph', (SELECT count(*) FROM c) + (SELECT count(*) FROM f)"""
)
def em_update_data(spark, d):
    """How many triples each mode trains on, with the last two of three feedbacks."""
    kg, context = data.graph(spark, d, SMALL), data.graph(spark, d, ("nation",))
    lab = data.customers_by_region(spark, d)
    history = [lab.select(F.col("entity").alias("s"), F.lit(f"f{i}").alias("p"), F.col("label").alias("o")) for i in range(3)]
    sets = {m: embedding.update_data(kg, context, history, "adapt_progressive", m, 2) for m in embedding.DATA_MODES}
    sets["retrain"] = embedding.update_data(kg, context, history, "retrain", "graph_only", 2)
    out = None
    for mode, rows in sets.items():
        one = rows.groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- rules, iterations, streams ----


@query(" UNION ALL ".join(f"SELECT '{r.rule_id()}' AS rule_id, '{r.head.o}' AS cluster, {len(r.body)} AS atoms" for r in _rules()))
def io_rules(spark, d):
    """Rules written to read and to load, and loaded."""
    path = work_folder(spark, "rules")
    output.write_rules(spark, {"region/1": _rules()}, path)
    return output.read_rules(spark, f"{path}.parsable").select("rule_id", "cluster", F.size("body").cast("long").alias("atoms"))


@query("SELECT unnest([0, 1]) AS itr_num, 5 AS clusters, (SELECT count(*) FROM supplier) AS entities, true AS measured")
def it_pipeline(spark, d):
    """Two iterations over all suppliers: cluster sizes, accuracy against their regions, rule measures."""
    kg = data.graph(spark, d, ("nation", "supplier"))
    nation = data.table(spark, d, "nation").select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("o"), F.concat(F.lit("region/"), F.col("n_regionkey").cast("string")).alias("label"))
    targets = kg.filter("p = 'inNation'").join(F.broadcast(nation), "o").select(F.col("s").alias("entity"), F.lit("livesIn").alias("relation"), "label")
    plan = iterations.Plan(iterations=2, method_settings={"k": 5, "restarts": 2}, training=embedding.Training(k=8, epochs=8, rounds=1))
    found = iterations.run(kg, targets, plan).metrics()
    ok = lambda m: all(-1 <= m[k] <= 1 for k in ("ACC", "ARI", "NMI", "SS")) and 0 <= m["clusters_with_any_explans"] <= m["clusters"]
    return spark.createDataFrame([(int(m["itr_num"]), len(m["clusters_sizes"]), sum(m["clusters_sizes"]), ok(m)) for m in found], "itr_num long, clusters long, entities long, measured boolean")


@query(f"WITH {_SUPPORTS} SELECT rule_id, cluster, support, size FROM g")
def st_running_supports(spark, d):
    """The triples come as a stream of files; the last supports are those of all of them."""
    folder = work_folder(spark, "stream")
    kg = data.graph(spark, d, STAR)
    kg.repartition(2, "s").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("s string, p string, o string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    running = RunningSupports(spark, _GIVEN, data.customers_by_region(spark, d), f"{folder}/state")
    running.start(stream, f"{folder}/checkpoint", once=True).awaitTermination()
    return running.current()


# ---- further checks of parameters ----


@query(_mined_sql(f"SELECT * FROM ({_STAR}) WHERE p <> 'status'", 0.1, 20))
def mine_without_relation(spark, d):
    """A relation that is excluded is in no rule."""
    s = mining.Settings(shape="path", max_length=2, min_coverage=0.1, beam=20, excluded_relations=("status",))
    rules, grid = mining.Miner(data.graph(spark, d, STAR), s).mine(data.customers_by_region(spark, d))
    return mining.rules_table(rules, grid, "livesIn").select("cluster", "body_text", "support", "size", *_r(*_MARKS))


@query(_mined_sql(_STAR, 0.5, 2))
def mine_narrow_beam(spark, d):
    """Two bindings of each pattern, over half of a region's customers."""
    s = mining.Settings(shape="path", max_length=2, min_coverage=0.5, beam=2)
    rules, grid = mining.Miner(data.graph(spark, d, STAR), s).mine(data.customers_by_region(spark, d))
    return mining.rules_table(rules, grid, "livesIn").select("cluster", "body_text", "support", "size", *_r(*_MARKS))


@query(
    f"""WITH m AS ({_mined_sql(_STAR, 0.1, 20)}), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY x_coverage DESC NULLS LAST, body_text) AS n FROM m)
SELECT cluster, '?x livesIn ' || cluster || chr(9) || '<=' || chr(9) || body_text || chr(9) || 'c_support: ' || support AS value FROM r WHERE n <= 10"""
)
def snk_rule_lines(spark, d):
    order = Window.partitionBy("cluster").orderBy(F.col("x_coverage").desc_nulls_last(), "body_text")
    rows = mine_paths(spark, d).withColumns({"head_rel": F.lit("livesIn"), "c_support": F.col("support"), "rank": F.row_number().over(order)})
    return output.rule_lines(rows, 10, ("c_support",)).select("cluster", "value")


@query(f"WITH {_FIRED} SELECT s, 'livesIn' AS p, o, round(avg(quality), 6) AS quality FROM fired GROUP BY s, o HAVING avg(quality) > 0.3::DOUBLE")
def ded_infer_mean_quality(spark, d):
    """Another aggregate of a prediction's rules than the best."""
    found = deduction.infer(data.graph(spark, d, STAR), _rules(), min_quality=0.3, quality=F.avg)
    return found.select("s", "p", "o", *_r("quality"))


@query(f"WITH kg AS ({data.graph_sql()}) SELECT p, count(*) AS n FROM kg GROUP BY p")
def src_size(spark, d):
    return data.graph(spark, d).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT i, count(*) AS n, round(min(d), 6) AS least FROM (WITH v AS (SELECT vec_id AS id, {_V} AS v FROM embeddings) SELECT a.id AS i, {_D2} AS d FROM v a JOIN v b ON a.id < b.id) GROUP BY i")
def snk_distance_lines(spark, d):
    """The upper triangle of the distances written as lines and read again."""
    rows = evaluation.distances(data.vectors(spark, d), then=("i long, n long, least double", output.least_of_lines))
    return rows.groupBy("i").agg(F.sum("n").alias("n"), F.round(F.min("least"), 6).alias("least"))


@query(f"SELECT truth, predicted, n FROM (SELECT truth, predicted, count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY ALL) WHERE n = (SELECT max(n) FROM (SELECT count(*) AS n FROM ({_PAIRS_SQL}) GROUP BY truth, predicted))")
def ev_largest_cells(spark, d):
    table = evaluation.contingency(_pairs(spark, d))
    return table.join(table.agg(F.max("n").alias("n")), "n").select("truth", "predicted", "n")
