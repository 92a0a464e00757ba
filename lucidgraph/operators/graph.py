"""Statistics, neighbourhoods and slices of a triple table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lucidgraph.plans.patterns import column_of, match
from lucidgraph.plans.rules import Atom, Rule, is_var
from lucidgraph.sources.storage import stored

# Relations whose objects are worth binding to constants, by local name.
CONSTANT_RELATIONS = (
    "rdf:type", "isCitizenOf", "hasGender", "hasMusicalRole", "isPoliticianOf", "genre", "type", "charge", "element", "atype", "ind1", "inda",
    "lumo", "logp", "hasfeature", "inphase", "courselevel", "taughtby_quarter", "yearsinprogram", "hasposition", "linkprop", "alb", "tbil", "dbil",
    "gpt", "tcho", "tp", "got", "ztt", "ttt", "che", "sex", "age", "dur", "b_rel12", "fibros", "activity",
)
# Relations that say nothing unless their object is a constant, by local name.
CATEGORICAL_RELATIONS = (
    "rdf:type", "hasGender", "isCitizenOf", "genre", "type", "charge", "element", "atype", "ind1", "inda", "hasfeature", "linkprop", "alb", "tbil",
    "dbil", "gpt", "tcho", "tp", "got", "ztt", "ttt", "che", "sex",
)
# Relations of the university benchmark whose objects are worth binding.
UNIVERSITY = "http://semantics.crl.ibm.com/univ-bench-dl.owl#"
UNIVERSITY_RELATIONS = (
    "like", "hasMajor", "isCrazyAbout", "love", "hasUndergraduateDegreeFrom", "enrollIn", "isStudentOf", "hasMasterDegreeFrom", "hasDoctoralDegreeFrom", "worksFor",
)
# The prefix of data without one of its own, and the type relation's URL.
DATA_PREFIX = "http://exp-data.org/"
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
CONSTANT_RATIO, CATEGORICAL_RATIO = 10, 50


def with_prefix(names: Iterable[str], prefix: str = DATA_PREFIX) -> list[str]:
    """Local names, the same below a prefix, and the type relation's URL."""
    return list(dict.fromkeys([*names, *[prefix + n for n in names], RDF_TYPE]))


def usual_constants() -> list[str]:
    return with_prefix(CONSTANT_RELATIONS) + [UNIVERSITY + n for n in UNIVERSITY_RELATIONS]


def usual_categorical() -> list[str]:
    return with_prefix(CATEGORICAL_RELATIONS)


def predicate_stats(kg: DataFrame, approximate: bool = False) -> DataFrame:
    """(p, subjects, objects): distinct counts by predicate; ``approximate``: HyperLogLog sketches, one pass."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    return kg.groupBy("p").agg(count("s").cast("long").alias("subjects"), count("o").cast("long").alias("objects"))


def predicate_classes(stats: DataFrame) -> DataFrame:
    """Adds ratio, binds_constants (over 10 subjects an object) and categorical (over 50)."""
    ratio = F.col("subjects") / F.col("objects")
    return stats.withColumns({"ratio": ratio, "binds_constants": ratio > CONSTANT_RATIO, "categorical": ratio > CATEGORICAL_RATIO})


def edges(kg: DataFrame) -> DataFrame:
    """(node, p, direction, nbr): each triple from both ends."""
    out = kg.select(F.col("s").alias("node"), "p", F.lit("out").alias("direction"), F.col("o").alias("nbr"))
    return out.unionByName(kg.select(F.col("o").alias("node"), "p", F.lit("in").alias("direction"), F.col("s").alias("nbr")))


def neighbours(kg: DataFrame, entities: DataFrame, limit: int | None = 100) -> DataFrame:
    """Triples at the entities (one column), at most ``limit`` per entity, predicate and direction, the first by name."""
    wanted = entities.select(F.col(entities.columns[0]).alias("node")).distinct()
    found = edges(kg).join(wanted, "node").distinct()
    if limit:
        found = found.withColumn("_n", F.row_number().over(Window.partitionBy("node", "p", "direction").orderBy("nbr"))).filter(F.col("_n") <= limit).drop("_n")
    out = F.col("direction") == "out"
    return found.select(F.when(out, F.col("node")).otherwise(F.col("nbr")).alias("s"), "p", F.when(out, F.col("nbr")).otherwise(F.col("node")).alias("o")).distinct()


def subgraph(kg: DataFrame, entities: DataFrame, hops: int = 1, limit: int | None = 100) -> DataFrame:
    """Triples within ``hops`` of the entities. Each hop's triples and the nodes seen are written, so plans stay short."""
    frontier = entities.select(F.col(entities.columns[0]).alias("node")).distinct()
    seen, found = frontier, None
    for hop in range(hops):
        level = stored(neighbours(kg, frontier, limit), "slice")
        found = level if found is None else found.unionByName(level)
        if hop + 1 < hops:
            ends = level.select(F.col("s").alias("node")).union(level.select(F.col("o").alias("node"))).distinct()
            frontier = stored(ends.join(seen, "node", "left_anti"), "frontier")
            seen = seen.unionByName(frontier)
    return found.distinct() if found is not None else kg.limit(0)


def predicates_of(kg: DataFrame, atom: Atom) -> DataFrame:
    """Distinct values of a pattern's predicate variable."""
    return match(kg, [Rule(Atom("", "", ""), (atom,), {}, ())], keep=[atom.p], injective=False, distinct_atoms=False).select(F.col(column_of(atom.p)).alias("p")).distinct()


def entities_of(kg: DataFrame, body: Sequence[Atom], limit: int | None = 100) -> DataFrame:
    """Distinct bindings of a pattern's only argument variable, the first ``limit`` by name."""
    variables = list(dict.fromkeys(v for a in body for v in a.args() if is_var(v)))
    found = match(kg, [Rule(Atom("", "", ""), tuple(body), {}, ())], keep=variables, injective=False, distinct_atoms=False).select(*[F.col(column_of(v)).alias(v.removeprefix("?")) for v in variables]).distinct()
    return found.orderBy(*found.columns).limit(limit) if limit else found


def relation_cardinality(kg: DataFrame, threshold: float = 1.5) -> DataFrame:
    """(p, tails_per_head, heads_per_tail, kind): averages over distinct triples, kind by the threshold."""
    t = kg.select("s", "p", "o").distinct()
    rows = t.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("heads"), F.count_distinct("o").alias("tails"))
    rows = rows.select("p", (F.col("n") / F.col("heads")).alias("tails_per_head"), (F.col("n") / F.col("tails")).alias("heads_per_tail"))
    many, few = F.lit("n"), F.lit("1")
    side = lambda c: F.when(F.col(c) > threshold, many).otherwise(few)
    return rows.withColumn("kind", F.concat(side("heads_per_tail"), F.lit("-"), side("tails_per_head")))


def type_constraints(kg: DataFrame) -> DataFrame:
    """(p, side, name): the distinct heads and tails of each relation, a row each."""
    sides = F.array(F.struct(F.lit("head").alias("side"), F.col("s").alias("name")), F.struct(F.lit("tail").alias("side"), F.col("o").alias("name")))
    return kg.select("p", F.inline(sides)).distinct()


def encode(kg: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(h, r, t) ids by dictionaries (name, id)."""
    heads = entities.select(F.col("name").alias("s"), F.col("id").alias("h"))
    tails = entities.select(F.col("name").alias("o"), F.col("id").alias("t"))
    return kg.join(heads, "s").join(tails, "o").join(relations.select(F.col("name").alias("p"), F.col("id").alias("r")), "p").select("h", "r", "t")


def degrees(kg: DataFrame) -> DataFrame:
    return edges(kg).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
