"""Reads, joins, paging, set operations and keyed writes on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..operators import aggregates as A
from ..operators import relational as R
from ..sources.tables import ntz, read_table


def _t(spark, d, name):
    return read_table(spark, d, name)


def q_soft_delete(spark, d):
    """Finished orders count as deleted; current ones of good value remain."""
    o = _t(spark, d, "orders").withColumn("deleted", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    return R.current(o).filter("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_orderstatus")


def q_range(spark, d):
    return R.key_range(_t(spark, d, "orders"), 1000, 5000, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def q_stale(spark, d):
    return R.stale(_t(spark, d, "orders"), F.lit("1996-01-01").cast("timestamp_ntz"), "o_orderdate").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def q_named(spark, d):
    return R.named(_t(spark, d, "part"), "Red Widget", "p_name").select("p_partkey", "p_name")


def q_by_digest(spark, d):
    return R.by_digest(_t(spark, d, "nation"), "NATION_7", "n_name").select("n_nationkey", "n_name")


def q_exclusion(spark, d):
    return R.excluding(_t(spark, d, "customer"), "c_mktsegment", ["MACHINERY", "FURNITURE"]).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def q_root_children(spark, d):
    """Children of one region in taxonomic order; regions are the roots."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_name").alias("name"), F.lit(False).alias("is_synonym"))
    return R.children(n, 1).select("id", "name")


def q_until_rank(spark, d):
    """Part sizes stand for ranks: 1 KINGDOM, 2 FAMILY, 3 SPECIES, and so on by five."""
    ranks = F.element_at(F.array(*[F.lit(r) for r in ("KINGDOM", "FAMILY", "GENUS", "SPECIES", "SUBSPECIES")]), (F.col("p_size") % 5 + 1).cast("int"))
    return R.until_rank(_t(spark, d, "part").withColumn("rank", ranks), "GENUS").select("p_partkey", "rank")


def q_kname_view(spark, d):
    """Customers with the names of their nation and region, by left joins to small tables."""
    c = _t(spark, d, "customer")
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    with_nation = R.with_name(c.join(n.select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"), "left"), n, "c_nationkey", "n_nationkey", "n_name", "nation")
    return R.with_name(with_nation, r, "n_regionkey", "r_regionkey", "r_name", "kingdom").select("c_custkey", "c_name", "nation", "kingdom")


def q_linnean_view(spark, d):
    """A chain of joins with one compound condition: line items with order, customer, nation, region, and the
    supplier's nation only where goods were returned."""
    li = _t(spark, d, "lineitem")
    o, c, n, r, s = (_t(spark, d, x) for x in ("orders", "customer", "nation", "region", "supplier"))
    sn = n.select(F.col("n_nationkey").alias("sn_key"), F.col("n_name").alias("supplier_nation"))
    out = (
        li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(sn, (F.col("s_nationkey") == F.col("sn_key")) & (F.col("l_returnflag") == "R"), "left")
    )
    return out.groupBy("r_name", "n_name", "supplier_nation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def q_nub_view(spark, d):
    """Four joins in one view: orders with customer, nation, region, and totals; ``deleted`` as a boolean."""
    o, c, n, r = (_t(spark, d, x) for x in ("orders", "customer", "nation", "region"))
    lines = _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n_lines"))
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.join(lines, F.col("o_orderkey") == F.col("k"), "left").select("o_orderkey", "c_name", "n_name", "r_name", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), (F.col("o_orderstatus") == "F").alias("deleted"))


def q_homonyms(spark, d):
    """Pairs of different parts of one name, counted from the sizes of the groups."""
    return R.homonyms(_t(spark, d, "part"), "p_name", "p_partkey")


def q_components(spark, d):
    """Line items seen from the customers that their orders map to, without two hidden segments."""
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("usage_id"), "l_partkey")
    rel = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("usage"), F.col("o_custkey").alias("nub"), F.col("c_mktsegment").alias("source"))
    src = _t(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.lower("c_mktsegment").alias("title")).distinct()
    out = R.components_for(li, rel, src, ["BUILDING", "MACHINERY"])
    return out.groupBy("nub", "source_title").agg(F.count(F.lit(1)).alias("n"), F.min("source_taxon_key").alias("first_key"))


def q_related(spark, d):
    rel = _t(spark, d, "orders").select(F.col("o_orderkey").alias("usage"), F.col("o_custkey").alias("nub"), F.col("o_orderstatus").alias("source"))
    o = _t(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    return R.related(o, rel, 370, ["F", "O"]).select("id", "o_orderstatus")


def q_orphans(spark, d):
    return R.orphans(_t(spark, d, "customer"), _t(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey", "c_name")


def q_semi_exclusion(spark, d):
    li = _t(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return _t(spark, d, "part").join(li, "p_partkey", "left_semi").select("p_partkey", "p_name")


def q_page(spark, d):
    """A page of a total order: the limit is what is asked for."""
    return R.page(_t(spark, d, "customer"), [F.col("c_acctbal").desc(), "c_custkey"], 20, 10).select("c_custkey", F.round("c_acctbal", 2).alias("c_acctbal"))


def q_sitemap(spark, d):
    """Keys by page of 500, and the bounds of each page."""
    o = R.page_of(_t(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], 500)
    return o.groupBy("page").agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count(F.lit(1)).alias("n"))


def q_array_agg(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string"))).alias("parts"))


def q_rekey(spark, d):
    """Parts of one name and brand get one key, and their line items follow."""
    p = _t(spark, d, "part").groupBy("p_name", "p_brand").agg(F.collect_list("p_partkey").alias("keys"), F.min("p_partkey").alias("new_key"))
    li = R.rekey(p, "keys", _t(spark, d, "lineitem"), "l_partkey", "new_key")
    return li.groupBy("new_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def q_union_replace(spark, d):
    """Orders of status O are replaced by halved ones, others stay."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter("o_orderstatus = 'O' and o_orderkey % 2 = 0").withColumn("o_totalprice", F.col("o_totalprice") / 2)
    return R.replace_group(o, new, "o_orderstatus").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


def q_upsert(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    changes = c.filter("c_custkey % 10 = 0").select(F.when(F.col("c_custkey") % 20 == 0, F.col("c_custkey")).otherwise(F.col("c_custkey") + 1_000_000_000).alias("c_custkey"), F.lit("changed").alias("c_name"), "c_nationkey")
    return R.upsert(c, changes, ["c_custkey"])


def q_insert_missing(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("id"))
    rows = _t(spark, d, "supplier").select(F.concat(F.lit("NATION_"), F.col("s_nationkey") + 20).alias("name"), F.lit(-1).cast("long").alias("id")).distinct()
    return R.insert_missing(n, rows, ["name"])


def q_delete_keys(spark, d):
    """Backbone rows are marked, later ones go."""
    p = _t(spark, d, "part").select("p_partkey", "p_name").withColumn("deleted", F.lit(None).cast("string"))
    return R.delete_keys(p, p.filter("p_name like 'red%'"), "p_partkey", 500, F.lit("now"))


def q_key_updates(spark, d):
    """-1 means the row itself, and given keys overwrite."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") < 10, -1).otherwise(F.col("p_size")).cast("long").alias("genus_key"))
    changes = p.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.col("id") * 2).alias("genus_key"))
    return R.update_keys(R.self_keys(p, ["genus_key"]), changes, ["genus_key"])


def q_issues(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.array(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("issues"))
    changed = R.change_issues(o, "issues", ["NO_MATCH"], ["1-URGENT"], F.col("o_orderkey") % 2 == 0)
    return R.having_value(changed, "issues", "NO_MATCH").select("o_orderkey", F.concat_ws("|", "issues").alias("issues"))


def q_next_ids(spark, d):
    return R.next_ids(_t(spark, d, "supplier").select("s_suppkey", "s_name"), [F.col("s_name").desc()], 1000)


def q_backbone_export(spark, d):
    """The flat export: higher keys and names beside each row, null as an empty field."""
    c, n, r = (_t(spark, d, x) for x in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(
        F.concat_ws("\t", F.col("c_custkey").cast("string"), F.coalesce("n_name", F.lit("")), F.coalesce("r_name", F.lit("")), C.default_status(F.when(F.col("c_acctbal") > 0, F.lit("DOUBTFUL")), F.col("c_acctbal") < -500)).alias("line")
    )


def q_source_export(spark, d):
    """The bulk export of a source: rows with status and name fall-backs."""
    p = _t(spark, d, "part")
    canonical = F.when(F.col("p_size") % 3 == 0, F.lit("  ")).otherwise(F.col("p_name"))
    return p.select("p_partkey", C.canonical_or_name(canonical, F.upper("p_name")).alias("name"), C.default_status(F.when(F.col("p_size") > 40, F.lit("DOUBTFUL")), F.col("p_size") < 10).alias("status"))


def q_duplicate_keys(spark, d):
    return A.duplicates(_t(spark, d, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("key")), "key")


def q_latest_per_key(spark, d):
    """The last event of each user."""
    e = ntz(_t(spark, d, "events"), "ts")
    return A.latest(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "ts")


def q_first_order(spark, d):
    return A.first_values(_t(spark, d, "orders"), ["o_custkey"], F.struct("o_orderdate", "o_orderkey"), ["o_orderkey", "o_orderstatus"])


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

SQL = {
    "q_soft_delete": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' AND o_totalprice > 100000",
    "q_range": "SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 5000",
    "q_stale": "SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' GROUP BY 1",
    "q_named": "SELECT p_partkey, p_name FROM part WHERE lower(p_name) = 'red widget'",
    "q_by_digest": "SELECT n_nationkey, n_name FROM nation WHERE md5(n_name) = md5('NATION_7')",
    "q_exclusion": "SELECT c_mktsegment, count(*)::BIGINT AS n FROM customer WHERE c_mktsegment NOT IN ('MACHINERY', 'FURNITURE') GROUP BY 1",
    "q_root_children": "SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey = 1",
    "q_until_rank": "SELECT p_partkey, (['KINGDOM', 'FAMILY', 'GENUS', 'SPECIES', 'SUBSPECIES'])[p_size % 5 + 1] AS rank FROM part WHERE p_size % 5 < 3",
    "q_kname_view": "SELECT c_custkey, c_name, n_name AS nation, r_name AS kingdom FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "q_linnean_view": """SELECT r_name, n.n_name, sn.n_name AS supplier_nation, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation n ON c_nationkey = n.n_nationkey LEFT JOIN region ON n.n_regionkey = r_regionkey LEFT JOIN supplier ON l_suppkey = s_suppkey
      LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey AND l_returnflag = 'R' GROUP BY 1, 2, 3""",
    "q_nub_view": """SELECT o_orderkey, c_name, n_name, r_name, coalesce(k.n, 0)::BIGINT AS n_lines, o_orderstatus = 'F' AS deleted FROM orders JOIN customer ON o_custkey = c_custkey
      LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) k ON k.l_orderkey = o_orderkey""",
    "q_homonyms": "SELECT a.p_name, count(*)::BIGINT AS n_pairs, min(b.p_partkey) AS least FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_partkey <> b.p_partkey GROUP BY 1",
    "q_components": """SELECT o_custkey AS nub, lower(c_mktsegment) AS source_title, count(*)::BIGINT AS n, min(o_orderkey) AS first_key FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2""",
    "q_related": "SELECT o_orderkey AS id, o_orderstatus FROM orders WHERE o_custkey = 370 AND o_orderstatus IN ('F', 'O')",
    "q_orphans": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "q_semi_exclusion": "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
    "q_page": "SELECT c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY customer.c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20",
    "q_sitemap": """SELECT ceil(rn / 500)::BIGINT AS page, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*)::BIGINT AS n
      FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1""",
    "q_array_agg": "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS parts FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY 1",
    "q_rekey": """SELECT new_key, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name, p_brand) AS new_key FROM part)
      ON l_partkey = p_partkey GROUP BY 1""",
    "q_union_replace": """SELECT o_orderstatus, count(*)::BIGINT AS n, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 2 ELSE o_totalprice END), 1) AS total FROM orders
      WHERE o_orderstatus <> 'O' OR o_orderkey % 2 = 0 GROUP BY 1""",
    "q_upsert": """SELECT c_custkey, CASE WHEN c_custkey % 20 = 0 THEN 'changed' ELSE c_name END AS c_name, c_nationkey FROM customer
      UNION ALL SELECT c_custkey + 1000000000, 'changed', c_nationkey FROM customer WHERE c_custkey % 20 = 10""",
    "q_insert_missing": """SELECT n_name AS name, n_nationkey::BIGINT AS id FROM nation UNION ALL
      SELECT DISTINCT 'NATION_' || (s_nationkey + 20), -1::BIGINT FROM supplier WHERE 'NATION_' || (s_nationkey + 20) NOT IN (SELECT n_name FROM nation)""",
    "q_delete_keys": "SELECT p_partkey, p_name, CASE WHEN p_name LIKE 'red%' THEN 'now' END AS deleted FROM part WHERE NOT (p_name LIKE 'red%' AND p_partkey > 500)",
    "q_key_updates": """SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN p_partkey * 2 WHEN p_size < 10 THEN p_partkey ELSE p_size END::BIGINT AS genus_key FROM part""",
    "q_issues": """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus || '|NO_MATCH' ELSE o_orderstatus || '|' || o_orderpriority || '|NO_MATCH' END AS issues
      FROM orders WHERE o_orderkey % 2 = 0""",
    "q_next_ids": "SELECT s_suppkey, s_name, (999 + row_number() OVER (ORDER BY s_name DESC))::BIGINT AS id FROM supplier",
    "q_backbone_export": """SELECT c_custkey::VARCHAR || chr(9) || coalesce(n_name, '') || chr(9) || coalesce(r_name, '') || chr(9)
      || CASE WHEN c_acctbal > 0 THEN 'DOUBTFUL' WHEN c_acctbal < -500 THEN 'SYNONYM' ELSE 'ACCEPTED' END AS line
      FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "q_source_export": """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_name END AS name,
      CASE WHEN p_size > 40 THEN 'DOUBTFUL' WHEN p_size < 10 THEN 'SYNONYM' ELSE 'ACCEPTED' END AS status FROM part""",
    "q_duplicate_keys": "SELECT l_orderkey || '-' || l_linenumber AS key, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "q_latest_per_key": "SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "q_first_order": "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1",
}
