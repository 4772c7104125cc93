"""Queries through the service facade: the driver's tables dressed as a store with a backbone and one checklist.

Regions, nations and customers are the backbone, every fifth customer a synonym of the one before. Orders are the rows of
a checklist that map to their customers; those still open count as deleted. Lines of orders are extension records.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..api import Store
from ..sources.tables import read_table as _t

_C, _O = 10_000_000, 1_000_000_000


def store(spark, d) -> Store:
    none = F.lit(None)

    def usage(df, key, dataset, rank, parent, synonym, name, basionym="null", deleted="null", issues="array()"):
        return df.select(
            F.expr(key).cast("long").alias("id"), F.lit(dataset).alias("dataset"), F.expr(key).cast("long").alias("name_id"), F.lit(rank).alias("rank"), F.expr(parent).cast("long").alias("parent"), F.expr(synonym).cast("boolean").alias("is_synonym"),
            F.when(F.expr(synonym).cast("boolean"), "SYNONYM").otherwise("ACCEPTED").alias("status"), F.expr(basionym).cast("long").alias("basionym"), F.expr(deleted).cast("boolean").alias("deleted"), F.expr(key).cast("string").alias("taxon_id"),
            F.expr(issues).cast("array<string>").alias("issues"), F.expr(name).alias("_name"),
        )

    c = f"{_C} + c_custkey"
    rows = usage(_t(spark, d, "region"), "1 + r_regionkey", "backbone", "KINGDOM", "null", "false", "r_name")
    rows = rows.unionByName(usage(_t(spark, d, "nation"), "100 + n_nationkey", "backbone", "PHYLUM", "1 + n_regionkey", "false", "n_name"))
    rows = rows.unionByName(usage(_t(spark, d, "customer"), c, "backbone", "FAMILY", f"case when c_custkey % 5 = 0 then {c} - 1 else 100 + c_nationkey end", "c_custkey % 5 = 0", "c_name"))
    rows = rows.unionByName(usage(_t(spark, d, "orders"), f"{_O} + o_orderkey", "list", "SPECIES", "null", "false", "o_orderpriority", f"{_O} + o_orderkey - o_orderkey % 4", "case when o_orderstatus = 'O' then true end", "case when o_orderkey % 3 = 0 then array('BACKBONE_MATCH_NONE') else array() end"))
    li, o = _t(spark, d, "lineitem"), _t(spark, d, "orders")
    record = [((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).cast("long").alias("id"), (F.lit(_O) + F.col("l_orderkey")).cast("long").alias("usage_id")]
    return Store(
        {
            "usage": rows.drop("_name"), "name": rows.select("id", F.col("_name").alias("scientific_name"), F.lower("_name").alias("canonical_name")),
            "nub_rel": o.select((F.lit(_O) + F.col("o_orderkey")).cast("long").alias("usage"), (F.lit(_C) + F.col("o_custkey")).cast("long").alias("nub"), F.lit("list").alias("source")),
            "dataset": spark.createDataFrame([("list", "A list")], "key string, title string"),
            "vernacular": li.select(*record, F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_returnflag") == "N", "en").otherwise("de").alias("language"), (F.col("l_linenumber") == 2).alias("preferred")),
            "description": li.select(*record, F.when(F.col("l_linestatus") == "O", "en").otherwise("fr").alias("language"), F.lower("l_returnflag").alias("type")),
            "distribution": li.select(*record, F.when(F.col("l_quantity") > 25, F.concat(F.lit("T"), F.col("l_linenumber").cast("string"))).alias("threat_status")),
            "verbatim": o.select((F.lit(_O) + F.col("o_orderkey")).cast("long").alias("usage_id"), F.to_json(F.struct("o_orderpriority")).alias("json")),
            "dataset_metrics": o.select(F.lit("list").alias("dataset"), F.col("o_orderkey").alias("n"), F.struct("o_orderdate", "o_orderkey").alias("created")), "metrics": o.select((F.lit(_O) + F.col("o_orderkey")).cast("long").alias("id"), F.col("o_custkey").alias("n")),
        }, red_list="list",
    )


_SHOWN = ("id", "rank", "parent", "is_synonym", "scientific_name")


def q_api_usages(spark, d):
    return store(spark, d).usages().select("id", "parent", "accepted_id", "accepted", "scientific_name")


def q_api_get(spark, d):
    return store(spark, d).get(_C + 5).select("id", "parent", "accepted_id", "accepted")


def q_api_list(spark, d):
    return store(spark, d).list("list", offset=20, limit=50).select(*_SHOWN)


def q_api_key_of(spark, d):
    return store(spark, d).key_of("backbone", str(_C + 7))


def q_api_counts(spark, d):
    s = store(spark, d)
    return s.count().unionByName(s.count("list")).unionByName(s.max_key("list").select(F.col("id").alias("n")))


def q_api_by_canonical(spark, d):
    return store(spark, d).by_canonical("1-URGENT", ["list"]).select("id", "scientific_name")


def q_api_root(spark, d):
    return store(spark, d).root("backbone", 1, 3).select(*_SHOWN)


def q_api_children(spark, d):
    return store(spark, d).children(103, 2, 20).select(*_SHOWN)


def q_api_children_until_rank(spark, d):
    s = store(spark, d)
    return s.children_until_rank(2, "PHYLUM").unionByName(s.children_until_rank(103, "PHYLUM")).select(*_SHOWN)


def q_api_synonyms(spark, d):
    return store(spark, d).synonyms(_C + 4).select(*_SHOWN)


def q_api_parents(spark, d):
    return store(spark, d).parents(_C + 5).select("id", "depth")


def q_api_combinations(spark, d):
    return store(spark, d).combinations(_O + 4).select("id")


def q_api_related(spark, d):
    s = store(spark, d)
    return s.related(_C + 1, ["list"]).unionByName(s.related(_C + 2)).unionByName(s.related(_C + 1, [])).select("id")


def q_api_top_levels(spark, d):
    return store(spark, d).top_levels(("KINGDOM", "PHYLUM")).select("id", "n_children")


def q_api_record(spark, d):
    s = store(spark, d)
    return s.verbatim(_O + 1).select("usage_id", "json", F.col("created.o_orderkey").alias("latest")).join(s.metrics(_O + 1).select(F.col("id").alias("usage_id"), "n"), "usage_id")


def q_api_name(spark, d):
    return store(spark, d).name(100).select("scientific_name", F.col("parsed.type").alias("type"))


def q_api_extension(spark, d):
    return store(spark, d).extension("vernacular", _C + 1, 1, 30).select("id", "name", "source_title", "source_taxon_key")


def q_api_extension_range(spark, d):
    return store(spark, d).extension_range("description", _O + 1, _O + 40).select("id", "usage_id")


def q_api_toc(spark, d):
    return store(spark, d).toc(_O + 1).select("language", "type", F.concat_ws(",", F.transform("keys", lambda k: k.cast("string"))).alias("keys"))


def q_api_vernacular_in(spark, d):
    return store(spark, d).vernacular_in("EN").select("usage_id", "name")


def q_api_red_list(spark, d):
    s = store(spark, d)
    return s.red_list_category(_C + 1).select("key", "taxon_id", "category")


def q_api_without_match(spark, d):
    return store(spark, d).without_match("list")


def q_api_search(spark, d):
    return store(spark, d).search({"RANK": ["FAMILY"], "status": ["SYNONYM"]}, None, 3, 25).select("id", "score")


def q_api_facets(spark, d):
    return store(spark, d).facets({"RANK": ["FAMILY"], "STATUS": ["ACCEPTED"]}, ["rank", "status"], True)


def q_api_suggest(spark, d):
    return store(spark, d).suggest("a", limit=50).select("id", "score")


def q_api_metrics_totals(spark, d):
    totals, _ = store(spark, d).compute_metrics()
    return totals.select("dataset", "count_usages", "count_synonyms", "count_names", "count_nub")


def q_api_metrics_counts(spark, d):
    _, counts = store(spark, d).compute_metrics()
    return counts.select("dataset", "metric", "key", "n")


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}

_STORE = f"""WITH usage AS (
  SELECT 1 + r_regionkey::BIGINT AS id, 'backbone' AS dataset, 'KINGDOM' AS rank, 2 AS o, NULL::BIGINT AS parent, false AS is_synonym, NULL::BIGINT AS basionym, false AS gone, r_name AS scientific_name, false AS unmatched FROM region
  UNION ALL SELECT 100 + n_nationkey::BIGINT, 'backbone', 'PHYLUM', 6, 1 + n_regionkey, false, NULL, false, n_name, false FROM nation
  UNION ALL SELECT {_C} + c_custkey, 'backbone', 'FAMILY', 30, CASE WHEN c_custkey % 5 = 0 THEN {_C} + c_custkey - 1 ELSE 100 + c_nationkey END, c_custkey % 5 = 0, NULL, false, c_name, false FROM customer
  UNION ALL SELECT {_O} + o_orderkey, 'list', 'SPECIES', 47, NULL, false, {_O} + o_orderkey - o_orderkey % 4, o_orderstatus = 'O', o_orderpriority, o_orderkey % 3 = 0 FROM orders),
live AS (SELECT * FROM usage WHERE NOT gone),
shown AS (SELECT u.*, CASE WHEN u.is_synonym THEN a.id END AS accepted_id, CASE WHEN u.is_synonym THEN a.scientific_name END AS accepted, CASE WHEN u.is_synonym THEN a.parent ELSE u.parent END AS up FROM live u LEFT JOIN live a ON a.id = u.parent) """
_COLS = "id, rank, parent, is_synonym, scientific_name"
_VERNACULAR = f"SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, {_O} + l_orderkey AS usage_id, 'part ' || l_partkey AS name, CASE WHEN l_returnflag = 'N' THEN 'en' ELSE 'de' END AS language, l_linenumber = 2 AS preferred FROM lineitem"
SQL = {
    "q_api_usages": _STORE + "SELECT id, up AS parent, accepted_id, accepted, scientific_name FROM shown",
    "q_api_get": _STORE + f"SELECT id, up AS parent, accepted_id, accepted FROM shown WHERE id = {_C + 5}",
    "q_api_list": _STORE + f"SELECT {_COLS} FROM live WHERE dataset = 'list' ORDER BY id LIMIT 50 OFFSET 20",
    "q_api_key_of": f"SELECT {_C + 7}::BIGINT AS id",
    "q_api_counts": _STORE + "SELECT count(*)::BIGINT AS n FROM live UNION ALL SELECT count(*) FROM live WHERE dataset = 'list' UNION ALL SELECT max(id) FROM usage WHERE dataset = 'list'",
    "q_api_by_canonical": _STORE + "SELECT id, scientific_name FROM live WHERE lower(scientific_name) = '1-urgent'",
    "q_api_root": _STORE + f"SELECT {_COLS} FROM live WHERE dataset = 'backbone' AND parent IS NULL ORDER BY scientific_name LIMIT 3 OFFSET 1",
    "q_api_children": _STORE + f"SELECT {_COLS} FROM live WHERE parent = 103 AND NOT is_synonym ORDER BY scientific_name, id LIMIT 20 OFFSET 2",
    "q_api_children_until_rank": _STORE + f"SELECT {_COLS} FROM live WHERE parent IN (2, 103) AND NOT is_synonym AND o <= 6",
    "q_api_synonyms": _STORE + f"SELECT {_COLS} FROM live WHERE parent = {_C + 4} AND is_synonym",
    "q_api_parents": _STORE + f"SELECT {_C + 4}::BIGINT AS id, 1 AS depth UNION ALL SELECT 100 + c_nationkey, 2 FROM customer WHERE c_custkey = 4 UNION ALL SELECT 1 + n_regionkey, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 4",
    "q_api_combinations": _STORE + f"SELECT id FROM live WHERE basionym = {_O + 4} AND id <> {_O + 4}",
    "q_api_related": _STORE + f"SELECT id FROM live JOIN orders ON id = {_O} + o_orderkey WHERE o_custkey IN (1, 2)",
    "q_api_top_levels": _STORE + "SELECT u.id, count(c.id)::BIGINT AS n_children FROM live u LEFT JOIN live c ON c.parent = u.id AND c.dataset = 'backbone' AND NOT c.is_synonym WHERE u.rank IN ('KINGDOM', 'PHYLUM') GROUP BY u.id",
    "q_api_record": f"SELECT {_O} + o_orderkey AS usage_id, '{{\"o_orderpriority\":\"' || o_orderpriority || '\"}}' AS json, (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest, o_custkey AS n FROM orders WHERE o_orderkey = 1",
    "q_api_name": "SELECT n_name AS scientific_name, 'UNPARSED' AS type FROM nation WHERE n_nationkey = 0",
    "q_api_extension": f"SELECT v.id, v.name, 'A list' AS source_title, v.usage_id AS source_taxon_key FROM ({_VERNACULAR}) v JOIN orders ON v.usage_id = {_O} + o_orderkey WHERE o_custkey = 1 ORDER BY v.id LIMIT 30 OFFSET 1",
    "q_api_extension_range": f"SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, {_O} + l_orderkey AS usage_id FROM lineitem WHERE l_orderkey BETWEEN 1 AND 40",
    "q_api_toc": "SELECT CASE WHEN l_linestatus = 'O' THEN 'en' ELSE 'fr' END AS language, lower(l_returnflag) AS type, string_agg(((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey)::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) AS keys FROM lineitem WHERE l_orderkey = 1 GROUP BY 1, 2",
    "q_api_vernacular_in": f"SELECT usage_id, arg_min(name, (NOT preferred)::INT * 1000000000000000 + id) AS name FROM ({_VERNACULAR}) WHERE language = 'en' GROUP BY 1",
    "q_api_red_list": f"""SELECT {_C + 1}::BIGINT AS key, ({_O} + o_orderkey)::VARCHAR AS taxon_id, coalesce('T' || (SELECT min(l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25), 'NOT_EVALUATED') AS category FROM orders WHERE o_custkey = 1""",
    "q_api_without_match": _STORE + "SELECT id FROM live WHERE dataset = 'list' AND unmatched",
    "q_api_search": _STORE + "SELECT id, 0::DOUBLE AS score FROM live WHERE rank = 'FAMILY' AND is_synonym ORDER BY id LIMIT 25 OFFSET 3",
    "q_api_facets": _STORE + """SELECT 'rank' AS facet, rank AS value, count(*)::BIGINT AS n FROM live WHERE NOT is_synonym GROUP BY 2
      UNION ALL SELECT 'status', CASE WHEN is_synonym THEN 'SYNONYM' ELSE 'ACCEPTED' END, count(*) FROM live WHERE rank = 'FAMILY' GROUP BY 2""",
    "q_api_suggest": _STORE + "SELECT id, 100::DOUBLE AS score FROM live WHERE dataset = 'backbone' AND lower(scientific_name) LIKE 'a%' ORDER BY id LIMIT 50",
    "q_api_metrics_totals": _STORE + "SELECT dataset, count(*)::BIGINT AS count_usages, (count(*) FILTER (is_synonym))::BIGINT AS count_synonyms, count(*)::BIGINT AS count_names, (count(*) FILTER (dataset = 'list'))::BIGINT AS count_nub FROM live GROUP BY 1",
    "q_api_metrics_counts": _STORE + """SELECT dataset, 'rank' AS metric, rank AS key, count(*)::BIGINT AS n FROM live GROUP BY 1, 3 UNION ALL SELECT dataset, 'status', CASE WHEN is_synonym THEN 'SYNONYM' ELSE 'ACCEPTED' END, count(*) FROM live GROUP BY 1, 3
      UNION ALL SELECT dataset, 'issue', 'BACKBONE_MATCH_NONE', count(*) FROM live WHERE unmatched GROUP BY 1
      UNION ALL SELECT 'list', 'extension', unnest(['vernacular', 'description', 'distribution']), n FROM (SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O')
      UNION ALL SELECT 'list', 'vernacular_language', CASE WHEN l_returnflag = 'N' THEN 'en' ELSE 'de' END, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O' GROUP BY 3""",
}
