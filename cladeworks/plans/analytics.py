"""Metrics, counts, facets, choice per group and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions.ranks import rank_dim, rank_pairs, symmetric_pairs
from ..operators import aggregates as A
from ..operators import search as S
from ..sources.tables import read_table as _t


def q_dataset_metrics(spark, d):
    """Orders as usages of their customer's segment: lowest priority is a synonym, status F a match."""
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return A.dataset_metrics(o, "c_mktsegment", "c_name", F.col("o_orderpriority") == "5-LOW", F.col("o_orderstatus") == "F")


def q_count_maps(spark, d):
    """The count map of event types, written out in its order."""
    m = A.count_map(_t(spark, d, "events"), "event_type", ["user_id"])
    return m.select("user_id", F.concat_ws(",", F.transform("counts", lambda x: F.concat_ws("=", x["key"], x["n"].cast("string")))).alias("counts"))


def q_counts_long(spark, d):
    return A.counts_long(_t(spark, d, "lineitem"), {"flag": "l_returnflag", "status": "l_linestatus", "line": "l_linenumber"})


def q_percent(spark, d):
    """Labelled documents by source, in whole percent."""
    joined = _t(spark, d, "documents").select("doc_id", "source").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = joined.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count("quality").alias("labelled"))
    return out.withColumn("percent", C.percentage(F.col("labelled"), F.col("total")))


def q_match_summary(spark, d):
    o = _t(spark, d, "orders")
    return A.match_summary(o, F.col("o_orderstatus") == "F", F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_totalprice") > 200000, ["o_orderpriority"])


def q_duplicates_rank(spark, d):
    """Parts of one type and name: the largest of the cheapest is the primary one."""
    p = A.priority(_t(spark, d, "part"), ["p_type", "p_name"], [F.col("p_retailprice"), F.col("p_size").desc(), "p_partkey"])
    return p.select("p_partkey", "is_primary")


def q_topk_margin(spark, d):
    """The three best line items of each part by price, and the margin to the next."""
    best = A.best_with_margin(_t(spark, d, "lineitem"), ["l_partkey"], "l_extendedprice", ["l_orderkey", "l_linenumber"], 3)
    return best.select("l_partkey", "l_orderkey", "place", F.round("margin", 2).alias("margin"))


def q_alike_but_apart(spark, d):
    return A.alike_but_apart(_t(spark, d, "lineitem"), ["l_partkey"], "l_quantity", 1.0, "l_returnflag")


def q_similar_names(spark, d):
    """Names that normalize alike: the first stays, the others are flagged."""
    p = _t(spark, d, "part").withColumn("normed", F.regexp_replace(F.lower("p_name"), "[aeiou ]", ""))
    return A.priority(p, ["normed"], ["p_partkey"], "is_first").select("p_partkey", (~F.col("is_first")).alias("similar"))


def q_facets_single(spark, d):
    o = _t(spark, d, "orders")
    f = S.filters(o, {"O_ORDERSTATUS": ["F", "O"], "o-totalprice": ["100000,300000"]})
    return A.facets(o, f, ["o_orderstatus", "o_orderpriority"])


def q_facets_multi(spark, d):
    """Each facet ignores its own filter."""
    o = _t(spark, d, "orders")
    f = S.filters(o, {"o_orderstatus": ["F"], "o_orderpriority": ["1-URGENT", "2-HIGH"], "o_totalprice": ["*,250000"]})
    return A.facets(o, f, ["o_orderstatus", "o_orderpriority"], multi_select=True, min_count=2)


def q_facet_page(spark, d):
    """A page of a facet: the limit is what is asked for."""
    return A.facet_counts(_t(spark, d, "documents"), "source", 1, 5, 2)


def q_facets_documents(spark, d):
    docs = _t(spark, d, "documents").select("lang", "source", "n_chars")
    return A.facets(docs, S.filters(docs, {"lang": ["en", "fr"]}), ["lang", "source"], multi_select=True)


def q_max_key(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.max("o_orderkey").alias("max_key"), F.count(F.lit(1)).alias("n"))


def q_toc(spark, d):
    c = _t(spark, d, "conversations").select("role", "turn", "conv_id").distinct()
    return A.table_of_contents(c, "role", "turn", "conv_id").select("role", "turn", F.concat_ws(",", F.transform("keys", lambda x: x.cast("string"))).alias("keys"))


def q_grouped_children(spark, d):
    g = A.grouped_children(_t(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"])
    return g.select("l_orderkey", F.size("items").cast("long").alias("n"), F.concat_ws(";", F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string")))).alias("items"))


def q_rank_dim(spark, d):
    return rank_dim(spark).select("rank", F.col("ordinal").cast("long").alias("ordinal"), "is_linnean")


def q_rank_pairs(spark, d):
    """How often each rank matches another and the mean similarity."""
    p = rank_pairs(spark)
    return p.groupBy("a").agg(F.sum(F.col("matches").cast("long")).alias("n_matches"), F.max("similarity").alias("best"))


def q_symmetric_pairs(spark, d):
    return symmetric_pairs(spark, [("A", "B"), ("B", "C")])


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
_ORDERS = "FROM orders WHERE "
SQL = {
    "q_dataset_metrics": """SELECT c_mktsegment, count(*)::BIGINT AS count_usages, (count(*) FILTER (o_orderpriority = '5-LOW'))::BIGINT AS count_synonyms, count(DISTINCT c_name)::BIGINT AS count_names,
      (count(*) FILTER (o_orderstatus = 'F'))::BIGINT AS count_nub, floor((count(*) FILTER (o_orderstatus = 'F')) * 100 / count(*))::BIGINT AS nub_coverage
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "q_count_maps": """SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY n DESC, event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""",
    "q_counts_long": """SELECT 'flag' AS metric, l_returnflag AS key, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'status', l_linestatus, count(*) FROM lineitem GROUP BY ALL
      UNION ALL SELECT 'line', l_linenumber::VARCHAR, count(*) FROM lineitem GROUP BY ALL""",
    "q_percent": """SELECT source, count(*)::BIGINT AS total, count(quality)::BIGINT AS labelled, floor(count(quality) * 100 / count(*))::BIGINT AS percent
      FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "q_match_summary": """SELECT o_orderpriority, count(*)::BIGINT AS total, (count(*) FILTER (m))::BIGINT AS matches, (count(*) FILTER (o_orderpriority = '4-NOT SPECIFIED'))::BIGINT AS unparsable,
      (count(*) FILTER (r))::BIGINT AS relevant, (count(*) FILTER (r AND m))::BIGINT AS relevant_matches, floor((count(*) FILTER (m)) * 100 / count(*))::BIGINT AS perc_matches,
      CASE WHEN count(*) FILTER (r) = 0 THEN 100 ELSE floor((count(*) FILTER (r AND m)) * 100 / count(*) FILTER (r)) END::BIGINT AS perc_relevant
      FROM (SELECT *, o_orderstatus = 'F' AS m, o_totalprice > 200000 AS r FROM orders) GROUP BY 1""",
    "q_duplicates_rank": "SELECT p_partkey, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_retailprice, p_size DESC, p_partkey) = 1 AS is_primary FROM part",
    "q_topk_margin": """SELECT l_partkey, l_orderkey, place::INTEGER AS place, round(margin, 2) AS margin FROM (
      SELECT l_partkey, l_orderkey, row_number() OVER w AS place, l_extendedprice - lead(l_extendedprice) OVER w AS margin FROM lineitem
      WINDOW w AS (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)) WHERE place <= 3""",
    "q_alike_but_apart": """SELECT l_partkey, count(*)::BIGINT AS n_close, count(DISTINCT l_returnflag)::BIGINT AS n_values, count(DISTINCT l_returnflag) > 1 AS ambiguous FROM (
      SELECT *, max(l_quantity) OVER (PARTITION BY l_partkey) AS best FROM lineitem) WHERE best - l_quantity <= 1 GROUP BY 1""",
    "q_similar_names": "SELECT p_partkey, row_number() OVER (PARTITION BY regexp_replace(lower(p_name), '[aeiou ]', '', 'g') ORDER BY p_partkey) > 1 AS similar FROM part",
    "q_facets_single": f"""WITH f AS (SELECT * {_ORDERS} o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 100000 AND 300000)
      SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*)::BIGINT AS n FROM f GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM f GROUP BY ALL""",
    "q_facets_multi": f"""SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*)::BIGINT AS n {_ORDERS} o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice <= 250000 GROUP BY ALL HAVING count(*) > 1
      UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) {_ORDERS} o_orderstatus = 'F' AND o_totalprice <= 250000 GROUP BY ALL HAVING count(*) > 1""",
    "q_facet_page": "SELECT source AS value, count(*)::BIGINT AS n FROM documents GROUP BY 1 ORDER BY n DESC, value LIMIT 5 OFFSET 2",
    "q_facets_documents": """SELECT 'lang' AS facet, lang AS value, count(*)::BIGINT AS n FROM documents GROUP BY ALL
      UNION ALL SELECT 'source', source, count(*) FROM documents WHERE lang IN ('en', 'fr') GROUP BY ALL""",
    "q_max_key": "SELECT o_orderstatus, max(o_orderkey) AS max_key, count(*)::BIGINT AS n FROM orders GROUP BY 1",
    "q_toc": "SELECT role, turn, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS keys FROM (SELECT DISTINCT role, turn, conv_id FROM conversations) GROUP BY ALL",
    "q_grouped_children": "SELECT l_orderkey, count(*)::BIGINT AS n, string_agg(l_linenumber || ':' || l_partkey, ';' ORDER BY l_linenumber, l_partkey) AS items FROM lineitem GROUP BY 1",
    "q_symmetric_pairs": "SELECT * FROM (VALUES ('A','A'),('A','B'),('B','A'),('B','B'),('B','C'),('C','B'),('C','C')) t(a, b)",
}
