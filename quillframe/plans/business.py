"""Queries over keyed business tables: joins, merges, coverage and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import order_number
from ..operators import dedup, merge
from .tables import read

PRIORITIES = ("2-HIGH", "5-LOW", "1-URGENT")


def doc_links_4way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines to orders to customers to nations, over a list of nations."""
    wanted = read(spark, sf_dir, "nation").where(F.col("n_nationkey").isin(1, 2, 3))
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(wanted, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("n_links"), F.count_distinct("o_orderkey").alias("n_orders"))


def filename_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names that begin with a ten-digit key, joined on it."""
    orders = read(spark, sf_dir, "orders")
    names = orders.select(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("_"), F.col("o_orderstatus"), F.lit(".pdf")).alias("filename"))
    keyed = names.withColumn("key", order_number(F.col("filename")).cast("long"))
    return keyed.join(orders, F.col("key") == F.col("o_orderkey")).where("o_totalprice > 200000").select("filename", "o_custkey")


def limit_then_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders by key, then their lines."""
    page = read(spark, sf_dir, "orders").orderBy("o_orderkey").offset(100).limit(50).select("o_orderkey", "o_orderpriority")
    return page.join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderpriority", "l_partkey", "l_linenumber", "l_quantity")


def tagged_branches_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of orders: those of known customers, of suppliers' numbers only, and of neither."""
    keys = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") * 2).alias("c"))
    customers, suppliers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c"), "c_mktsegment"), read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c")).distinct()
    known = keys.join(customers, "c").select("k", "c_mktsegment", F.lit("customer").alias("tag"))
    other = keys.join(suppliers, "c").join(customers, "c", "left_anti").select("k", F.lit("supplier").alias("tag"))
    rest = keys.join(customers, "c", "left_anti").join(suppliers, "c", "left_anti").select("k", F.lit("unknown").alias("tag"))
    return known.unionByName(other, allowMissingColumns=True).unionByName(rest, allowMissingColumns=True)


def coverage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders and customers have lines: metric, value."""
    orders, lines = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_quantity > 45")
    both = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    has = F.col("l_orderkey").isNotNull()
    row = both.agg(
        F.count_distinct("o_orderkey").alias("orders"), F.count_distinct(F.when(has, F.col("o_orderkey"))).alias("orders_with_lines"), F.count_distinct(F.when(has, F.col("o_custkey"))).alias("customers_with_lines"), F.count_if(has).alias("lines")
    )
    return row.unpivot([], ["orders", "orders_with_lines", "customers_with_lines", "lines"], "metric", "value")


def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer")
    return customers.join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


def class_counts_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and keys of each class, with a row for a list of classes together."""
    e = read(spark, sf_dir, "events")
    count = (F.count_distinct("event_id").alias("n_files"), F.count_distinct("user_id").alias("n_keys"))
    listed = e.where(F.col("event_type").isin("click", "view")).agg(*count).withColumn("event_type", F.lit("listed"))
    return e.groupBy("event_type").agg(*count).unionByName(listed)


def acl_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that a reader of two regions sees, through their nations."""
    scopes = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return read(spark, sf_dir, "customer").join(scopes, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")


def scope_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return read(spark, sf_dir, "nation").join(n, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def enum_order_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in a given order of classes, unknown ones last, then the greatest price: the first 20."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), F.col("o_orderpriority"))
    rank = F.when(place > 0, place).otherwise(len(PRIORITIES) + 1)
    return read(spark, sf_dir, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_orderpriority")


def upsert_newer_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later activity of a user replaces the value, if it is newer."""
    e = read(spark, sf_dir, "events").select("user_id", "ts", "value", "event_id")
    old = dedup.latest(e.where("event_id % 2 = 0"), "user_id", "ts").select("user_id", "ts", "value")
    new = dedup.latest(e.where("event_id % 2 = 1"), "user_id", "ts").select("user_id", "ts", "value")
    return merge.upsert(old, new, "user_id", ["ts", "value"], newer="ts")


def keyed_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    new = parts.where("p_partkey % 3 = 0").select("p_partkey", F.lit("Brand#new").alias("p_brand"), F.when(F.col("p_size") > 20, 0).alias("p_size"))
    return merge.update_by_key(parts, new, "p_partkey", ["p_brand", "p_size"])


def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return merge.delete_keys(parts, parts.where("p_partkey % 5 = 1"), "p_partkey")


def composite_key_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose (order, line number) isn't there yet, once each."""
    lines = read(spark, sf_dir, "lineitem").select(F.concat_ws("__", "l_orderkey", "l_linenumber").alias("key"), "l_quantity")
    old = lines.where("l_quantity > 10")
    return merge.missing_rows(lines, old, ["key"])


def conflict_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one user and type: the last where only the time differs, flagged where values differ too."""
    e = read(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("id"), "ts", (F.col("value") > 50).alias("high"))
    return dedup.consistent(e, "id", "ts", strict=False).select("id", "ts", "conflict")


def order_totals_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: totals by status and priority with subtotals."""
    return read(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def distinct_sorted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select("l_suppkey").distinct().orderBy("l_suppkey")


def replicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(1), F.lit(3)))
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", copies.alias("copy"))


QUERIES = {f.__name__: f for f in (doc_links_4way, filename_key_join, limit_then_join, tagged_branches_union, coverage_stats, missing_keys, class_counts_with_total, acl_visible, scope_counts, enum_order_topk, upsert_newer_wins, keyed_update, delete_by_key, composite_key_insert, conflict_dedup, order_totals_rollup, distinct_sorted_keys, replicate_rows)}

ORACLE_SQL = {
    "doc_links_4way": "SELECT n_name, count(*) AS n_links, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (1, 2, 3) GROUP BY n_name",
    "filename_key_join": "SELECT lpad(o_orderkey::VARCHAR, 10, '0') || '_' || o_orderstatus || '.pdf' AS filename, o_custkey FROM orders WHERE o_totalprice > 200000",
    "limit_then_join": "SELECT o_orderkey, o_orderpriority, l_partkey, l_linenumber, l_quantity FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100) JOIN lineitem ON o_orderkey = l_orderkey",
    "tagged_branches_union": """WITH k AS (SELECT o_orderkey AS k, o_custkey * 2 AS c FROM orders)
  SELECT k, c_mktsegment, 'customer' AS tag FROM k JOIN customer ON c = c_custkey
  UNION ALL SELECT k, NULL, 'supplier' FROM k WHERE c IN (SELECT s_suppkey FROM supplier) AND c NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT k, NULL, 'unknown' FROM k WHERE c NOT IN (SELECT s_suppkey FROM supplier) AND c NOT IN (SELECT c_custkey FROM customer)""",
    "coverage_stats": """WITH b AS (SELECT * FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 45) ON o_orderkey = l_orderkey)
  SELECT 'orders' AS metric, count(DISTINCT o_orderkey) AS value FROM b UNION ALL SELECT 'orders_with_lines', count(DISTINCT o_orderkey) FROM b WHERE l_orderkey IS NOT NULL
  UNION ALL SELECT 'customers_with_lines', count(DISTINCT o_custkey) FROM b WHERE l_orderkey IS NOT NULL UNION ALL SELECT 'lines', count(l_orderkey) FROM b""",
    "missing_keys": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "class_counts_with_total": "SELECT event_type, count(DISTINCT event_id) AS n_files, count(DISTINCT user_id) AS n_keys FROM events GROUP BY event_type UNION ALL SELECT 'listed', count(DISTINCT event_id), count(DISTINCT user_id) FROM events WHERE event_type IN ('click', 'view')",
    "acl_visible": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = c_nationkey AND r_name IN ('ASIA', 'EUROPE'))",
    "scope_counts": "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS n FROM nation",
    "enum_order_topk": "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 WHEN '1-URGENT' THEN 3 ELSE 4 END, o_totalprice DESC, o_orderkey LIMIT 20",
    "upsert_newer_wins": """WITH o AS (SELECT user_id, ts, value FROM events WHERE event_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) = 1),
  n AS (SELECT user_id, ts, value FROM events WHERE event_id % 2 = 1 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) = 1)
  SELECT user_id, CASE WHEN o.ts IS NULL OR n.ts > o.ts THEN n.ts ELSE o.ts END AS ts, CASE WHEN o.ts IS NULL OR n.ts > o.ts THEN n.value ELSE o.value END AS value FROM o FULL JOIN n USING (user_id)""",
    "keyed_update": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 3 = 0 AND p_size > 20 THEN 0 ELSE p_size END AS p_size FROM part",
    "delete_by_key": "SELECT p_partkey, p_name FROM part WHERE p_partkey % 5 <> 1",
    "composite_key_insert": """WITH l AS (SELECT l_orderkey || '__' || l_linenumber AS key, l_quantity FROM lineitem)
  SELECT key, min(l_quantity) AS l_quantity FROM l WHERE key NOT IN (SELECT key FROM l WHERE l_quantity > 10) GROUP BY key""",
    "conflict_dedup": "SELECT user_id || '/' || event_type AS id, max(ts) AS ts, count(DISTINCT value > 50) > 1 AS conflict FROM events GROUP BY 1",
    "order_totals_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "distinct_sorted_keys": "SELECT DISTINCT l_suppkey FROM lineitem",
    "replicate_rows": "SELECT conv_id, turn, unnest([1, 2, 3])::INT AS copy FROM conversations",
}
