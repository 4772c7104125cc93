"""Tree queries over region, nation, customer and order as one hierarchy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..operators import tree as T
from ..sources.tables import read_table

#: The levels stand for ranks, highest first.
LEVELS = {"region": "KINGDOM", "nation": "PHYLUM", "customer": "FAMILY", "order": "SPECIES"}

TREE_SQL = """tree AS (
  SELECT 'r' || r_regionkey AS id, NULL AS parent, 'KINGDOM' AS rank, r_name AS name FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'PHYLUM', n_name FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'FAMILY', c_name FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'SPECIES', o_orderpriority FROM orders)"""
_UP = """up AS (
  SELECT id, parent AS ancestor, 1 AS depth FROM tree WHERE parent IS NOT NULL
  UNION ALL SELECT u.id, t.parent, u.depth + 1 FROM up u JOIN tree t ON u.ancestor = t.id WHERE t.parent IS NOT NULL)"""
_CLOSURE = f"WITH RECURSIVE {TREE_SQL}, {_UP} "


def tree(spark: SparkSession, d: str, orders: bool = True) -> DataFrame:
    def part(table, id_tag, id_col, parent_tag, parent_col, rank, name):
        parent = F.concat(F.lit(parent_tag), F.col(parent_col).cast("string")) if parent_col else F.lit(None).cast("string")
        return read_table(spark, d, table).select(F.concat(F.lit(id_tag), F.col(id_col).cast("string")).alias("id"), parent.alias("parent"), F.lit(rank).alias("rank"), F.col(name).alias("name"))

    parts = [part("region", "r", "r_regionkey", None, None, "KINGDOM", "r_name"), part("nation", "n", "n_nationkey", "r", "n_regionkey", "PHYLUM", "n_name"), part("customer", "c", "c_custkey", "n", "c_nationkey", "FAMILY", "c_name")]
    if orders:
        parts.append(part("orders", "o", "o_orderkey", "c", "o_custkey", "SPECIES", "o_orderpriority"))
    return reduce(DataFrame.unionByName, parts)


def q_children_counts(spark, d):
    """Roots and their children with counts one level down, in the order of ranks."""
    m = T.metrics(tree(spark, d), counted={"PHYLUM": "p", "FAMILY": "f", "SPECIES": "s"})
    t = tree(spark, d, orders=False).filter(F.col("rank").isin("KINGDOM", "PHYLUM"))
    return t.join(m, "id").select("id", "parent", "rank", "name", "num_children", "num_descendants")


def q_tree_metrics(spark, d):
    m = T.metrics(tree(spark, d), counted={"PHYLUM": "p", "FAMILY": "f", "SPECIES": "s"})
    return m.select("id", "num_children", "num_descendants", "num_synonyms", "num_p", "num_f", "num_s")


def q_ancestors(spark, d):
    return T.ancestors(tree(spark, d))


def q_descendants(spark, d):
    return T.descendants(tree(spark, d), tree(spark, d).filter("rank = 'PHYLUM'"))


def q_classification(spark, d):
    t = tree(spark, d)
    return T.classification(T.ancestors(t, include_self=True), t, ["KINGDOM", "PHYLUM", "FAMILY", "SPECIES"])


def q_first_with_rank(spark, d):
    t = tree(spark, d)
    return T.first_with_rank(T.ancestors(t), t, "PHYLUM")


def q_path_order(spark, d):
    p = T.paths(tree(spark, d), key=T.sibling_key("rank", "name", "name"))
    return p.select("id", "depth", F.concat_ws("/", "path").alias("path"))


def q_tree_lines(spark, d):
    return T.render(tree(spark, d), "id", "parent", "name", "rank").select("id", "line")


def q_contract(spark, d):
    """Nations are dropped, customers hang on regions."""
    return T.contract(tree(spark, d), F.col("rank") != "PHYLUM")


def q_without_subtrees(spark, d):
    return T.without_subtrees(tree(spark, d), (F.col("rank") == "PHYLUM") & (F.col("name") < "J")).select("id", "rank")


def q_tree_problems(spark, d):
    """Orders whose customer is taken for their child make inversions; every third nation hangs on itself."""
    t = tree(spark, d)
    loops = (F.col("rank") == "PHYLUM") & (F.substring("id", 2, 9).cast("int") % 3 == 0)
    broken = t.withColumn("parent", F.when(loops, F.col("id")).when(F.col("rank") == "KINGDOM", F.lit("x")).otherwise(F.col("parent")))
    return T.problems(broken.withColumn("rank", F.when(F.col("name") == "1-URGENT", F.lit("ORDER")).otherwise(F.col("rank"))))


def q_tree_chunks(spark, d):
    t = tree(spark, d)
    return T.chunks(T.metrics(t, counted={}), t, 2, 15)


def q_tree_stats(spark, d):
    return T.tree_stats(tree(spark, d))


def q_from_ranks(spark, d):
    """Supplier places as columns become a tree; equal nation names of one region are one node."""
    s = read_table(spark, d, "supplier").join(read_table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nodes, leaves = T.from_ranks(s.select("s_suppkey", F.col("r_name").alias("kingdom"), F.col("n_name").alias("phylum")), ["kingdom", "phylum"], "s_suppkey")
    sizes = leaves.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("parent", "id")
    up = nodes.select(F.col("id").alias("_p"), F.col("name").alias("parent_name"))
    return nodes.join(up, F.col("parent") == F.col("_p"), "left").join(sizes, "id", "left").select("rank", "name", "parent_name", F.coalesce("n", F.lit(0)).alias("n"))


def q_traverse_tree(spark, d):
    """All rows below each nation and the rows themselves, by the general walk."""
    t = tree(spark, d).withColumn("is_synonym", F.col("rank") == "SPECIES")
    return T.traverse(T.relations(t), t.filter("rank = 'PHYLUM'"), "TREE_WITHOUT_PRO_PARTE").select("root", "id", "depth")


def q_parents_and_accepted(spark, d):
    t = tree(spark, d).withColumn("is_synonym", F.col("rank") == "SPECIES")
    return T.traverse(T.relations(t), t.filter("is_synonym"), "PARENTS_AND_ACCEPTED").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("top"))


def q_synonym_terminals(spark, d):
    """Parts point at the part of half their key; chains end at part 1."""
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2)).alias("accepted"))
    return T.terminals(p).select("id", "terminal", "steps", "in_cycle")


def q_move_children(spark, d):
    moves = read_table(spark, d, "nation").filter("n_nationkey % 2 = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("old"), F.concat(F.lit("n"), (F.col("n_nationkey") - 1).cast("string")).alias("new"))
    return T.move_children(tree(spark, d), moves).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def q_homonym_context(spark, d):
    """Order priorities are names that many orders share; their customers' nations and regions tell them apart."""
    t = tree(spark, d)
    context = T.homonym_context(t.filter("rank = 'SPECIES'").select("id", "name"), T.ancestors(t, start=t.filter("rank = 'SPECIES'")))
    return context.select("name", "id", F.concat_ws(",", "distinct_ancestors").alias("distinct_ancestors"))


def q_synonym_parents(spark, d):
    """Orders as synonyms of customers show the customer as accepted and the nation as parent."""
    t = tree(spark, d).withColumn("is_synonym", F.col("rank") == "SPECIES")
    return R.accepted_of(t).select("id", "parent", "accepted_id", "accepted")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_METRICS = """SELECT t.id, count(u.id) FILTER (u.depth = 1)::BIGINT AS num_children, count(u.id)::BIGINT AS num_descendants, 0::BIGINT AS num_synonyms,
  count(u.id) FILTER (c.rank = 'PHYLUM')::BIGINT AS num_p, count(u.id) FILTER (c.rank = 'FAMILY')::BIGINT AS num_f, count(u.id) FILTER (c.rank = 'SPECIES')::BIGINT AS num_s
  FROM tree t LEFT JOIN up u ON u.ancestor = t.id LEFT JOIN tree c ON c.id = u.id GROUP BY t.id"""
_SELF = "closure AS (SELECT * FROM up UNION ALL SELECT id, id, 0 FROM tree)"
_SMALL = TREE_SQL.replace("\n  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'SPECIES', o_orderpriority FROM orders", "")
_PATHS = f"""WITH RECURSIVE {TREE_SQL}, p AS (
  SELECT id, name, rank, 0 AS depth, id AS path FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.id, t.name, t.rank, p.depth + 1, p.path || '/' || t.id FROM p JOIN tree t ON t.parent = p.id) """
_BROKEN = f"""WITH RECURSIVE {TREE_SQL}, b AS (
  SELECT id, CASE WHEN rank = 'PHYLUM' AND substr(id, 2)::INT % 3 = 0 THEN id WHEN rank = 'KINGDOM' THEN 'x' ELSE parent END AS parent, name,
    CASE WHEN name = '1-URGENT' THEN 25 WHEN rank = 'KINGDOM' THEN 2 WHEN rank = 'PHYLUM' THEN 6 WHEN rank = 'FAMILY' THEN 30 ELSE 47 END AS o FROM tree)"""
SQL = {
    "q_children_counts": _CLOSURE + f", m AS ({_METRICS}) SELECT t.id, t.parent, t.rank, t.name, num_children, num_descendants FROM tree t JOIN m USING (id) WHERE rank IN ('KINGDOM', 'PHYLUM')",
    "q_tree_metrics": _CLOSURE + _METRICS,
    "q_ancestors": _CLOSURE + "SELECT id, ancestor, depth FROM up",
    "q_descendants": _CLOSURE + "SELECT u.ancestor AS root, u.id, u.depth FROM up u JOIN tree t ON t.id = u.ancestor WHERE t.rank = 'PHYLUM'",
    "q_classification": _CLOSURE + f""", {_SELF} SELECT c.id, max(ancestor) FILTER (t.rank = 'KINGDOM') AS kingdom_id, max(ancestor) FILTER (t.rank = 'PHYLUM') AS phylum_id,
      max(ancestor) FILTER (t.rank = 'FAMILY') AS family_id, max(ancestor) FILTER (t.rank = 'SPECIES') AS species_id FROM closure c JOIN tree t ON t.id = c.ancestor GROUP BY c.id""",
    "q_first_with_rank": _CLOSURE + "SELECT u.id, u.ancestor AS found FROM up u JOIN tree t ON t.id = u.ancestor WHERE t.rank = 'PHYLUM'",
    "q_path_order": _PATHS + "SELECT id, depth, path FROM p",
    "q_tree_lines": _PATHS + "SELECT id, repeat(' ', 2 * depth) || name || ' [' || lower(rank) || ']' AS line FROM p",
    "q_contract": f"WITH {TREE_SQL} SELECT t.id, CASE WHEN u.rank = 'PHYLUM' THEN u.parent ELSE t.parent END AS parent, t.rank, t.name FROM tree t LEFT JOIN tree u ON u.id = t.parent WHERE t.rank <> 'PHYLUM'",
    "q_without_subtrees": _CLOSURE + "SELECT id, rank FROM tree t WHERE NOT (rank = 'PHYLUM' AND name < 'J') AND NOT EXISTS (SELECT 1 FROM up u JOIN tree a ON a.id = u.ancestor WHERE u.id = t.id AND a.rank = 'PHYLUM' AND a.name < 'J')",
    "q_tree_problems": _BROKEN + """ SELECT 'self_loop' AS "check", id FROM b WHERE id = parent UNION ALL SELECT 'unknown_parent', id FROM b WHERE parent = 'x'
      UNION ALL SELECT 'rank_inversion', b.id FROM b JOIN b u ON u.id = b.parent WHERE b.o <= u.o""",
    "q_tree_chunks": _CLOSURE + """, m AS (SELECT t.id, t.parent, count(u.id) + 1 AS size FROM tree t LEFT JOIN up u ON u.ancestor = t.id GROUP BY ALL)
      SELECT m.id, m.size::BIGINT AS size FROM m LEFT JOIN m a ON a.id = m.parent WHERE m.size BETWEEN 2 AND 15 AND (a.id IS NULL OR a.size > 15)""",
    "q_tree_stats": _CLOSURE + "SELECT count(*)::BIGINT AS n_rows, (count(*) FILTER (parent IS NULL))::BIGINT AS n_roots, (SELECT max(depth) FROM up) AS max_depth FROM tree",
    "q_from_ranks": """WITH s AS (SELECT s_suppkey, r_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
      SELECT 'KINGDOM' AS rank, r_name AS name, NULL AS parent_name, 0::BIGINT AS n FROM s GROUP BY r_name UNION ALL SELECT 'PHYLUM', n_name, r_name, count(*) FROM s GROUP BY n_name, r_name""",
    "q_traverse_tree": _CLOSURE + f", {_SELF} SELECT c.ancestor AS root, c.id, c.depth FROM closure c JOIN tree t ON t.id = c.ancestor WHERE t.rank = 'PHYLUM'",
    "q_parents_and_accepted": _CLOSURE + "SELECT u.id AS root, count(*)::BIGINT AS n, max(depth) AS top FROM up u JOIN tree t USING (id) WHERE t.rank = 'SPECIES' GROUP BY u.id",
    "q_synonym_terminals": "SELECT p_partkey AS id, 1::BIGINT AS terminal, floor(log2(p_partkey))::BIGINT AS steps, false AS in_cycle FROM part WHERE p_partkey > 1",
    "q_move_children": f"WITH {TREE_SQL} SELECT CASE WHEN parent LIKE 'n%' AND substr(parent, 2)::INT % 2 = 1 THEN 'n' || (substr(parent, 2)::INT - 1) ELSE parent END AS parent, count(*)::BIGINT AS n FROM tree GROUP BY 1",
    "q_homonym_context": _CLOSURE + """, a AS (SELECT t.name, t.id, u.ancestor FROM tree t JOIN up u USING (id) WHERE t.rank = 'SPECIES'),
      k AS (SELECT name, ancestor FROM a GROUP BY ALL HAVING count(DISTINCT id) = 1)
      SELECT name, id, string_agg(ancestor, ',' ORDER BY ancestor) AS distinct_ancestors FROM a SEMI JOIN k USING (name, ancestor) GROUP BY name, id""",
    "q_synonym_parents": f"""WITH {TREE_SQL} SELECT t.id, CASE WHEN t.rank = 'SPECIES' THEN a.parent ELSE t.parent END AS parent, CASE WHEN t.rank = 'SPECIES' THEN a.id END AS accepted_id,
      CASE WHEN t.rank = 'SPECIES' THEN a.name END AS accepted FROM tree t LEFT JOIN tree a ON a.id = t.parent""",
}
