"""Relational queries over the star schema and events: what an analyst does with sample tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.catalog import query, table
from weftline.operators import relational


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("revenue_by_nation", """SELECT n_name, r_name, round(sum(o_totalprice), 2) AS revenue, count(DISTINCT c_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def revenue_by_nation(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.countDistinct("c_custkey").alias("customers"))


@query("forecast_revenue", "SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_discount BETWEEN 0.04 AND 0.06 AND l_quantity < 24")
def forecast_revenue(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").filter("l_discount BETWEEN 0.04D AND 0.06D AND l_quantity < 24").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query("top_orders", "SELECT o_custkey, o_orderkey, o_totalprice, rk FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk <= 3")
def top_orders(spark, sf_dir):
    return relational.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3, "rk").select("o_custkey", "o_orderkey", "o_totalprice", F.col("rk").cast("long").alias("rk"))


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(spark, sf_dir):
    big = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return table(spark, sf_dir, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("full_join", "SELECT coalesce(s.n_nationkey, c.n_nationkey) AS nation, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM (SELECT s_nationkey AS n_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s.n_nationkey = c.n_nationkey")
def full_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("s"))
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("c"))
    return s.join(c, "nation", "full").select("nation", F.coalesce("s", F.lit(0)).alias("suppliers"), F.coalesce("c", F.lit(0)).alias("customers"))


@query("asof_join", """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id AS last_id, user_id, ts FROM events WHERE event_id % 2 = 1),
r AS (SELECT a.event_id, max((b.ts, b.last_id)) AS m FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts <= a.ts GROUP BY 1) SELECT event_id, m[2] AS last_id FROM r""".replace("m[2]", "CASE WHEN m IS NULL THEN NULL ELSE struct_extract(m, 2) END"))
def asof_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.filter("event_id % 2 = 0").select("event_id", "user_id", "ts")
    right = e.filter("event_id % 2 = 1").select(F.col("event_id").alias("last_id"), "user_id", "ts")
    return relational.asof(left, right, ["user_id"], "ts", "last_id").select("event_id", "last_id")


@query("range_join", "SELECT e.event_id, o.o_orderkey FROM events e JOIN (SELECT o_orderkey, o_orderkey * 3 AS low, o_orderkey * 3 + 7 AS high FROM orders) o ON e.event_id >= o.low AND e.event_id < o.high")
def range_join(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 3).alias("low"), (F.col("o_orderkey") * 3 + 7).alias("high"))
    return relational.in_range(table(spark, sf_dir, "events").select("event_id"), "event_id", spans, "low", "high", 64).select("event_id", "o_orderkey")


@query("cube", "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"))


@query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("pivot", "SELECT o_orderstatus, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent, count(*) FILTER (o_orderpriority LIKE '2%') AS high FROM orders GROUP BY 1")
def pivot(spark, sf_dir):
    p = table(spark, sf_dir, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1)).groupBy("o_orderstatus").pivot("p", ["1", "2"]).count()
    return p.select("o_orderstatus", F.coalesce("1", F.lit(0)).alias("urgent"), F.coalesce("2", F.lit(0)).alias("high"))


@query("window_functions", """SELECT event_id, lag(value) OVER w AS before, round(sum(value) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS rolling, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS BIGINT) AS rk, CAST(ntile(4) OVER w AS BIGINT) AS quarter FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def window_functions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.round(F.sum("value").over(w.rowsBetween(-4, 0)), 4).alias("rolling"), F.dense_rank().over(W.partitionBy("user_id").orderBy("event_type")).cast("long").alias("rk"), F.ntile(4).over(w).cast("long").alias("quarter"))


@query("set_operations", """(SELECT 'both' AS kind, c_nationkey AS nation FROM customer INTERSECT SELECT 'both', s_nationkey FROM supplier) UNION ALL (SELECT 'customers', c_nationkey FROM customer EXCEPT SELECT 'customers', s_nationkey FROM supplier)""")
def set_operations(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"))
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "nation")
    return kind(c.intersect(s), "both").unionByName(kind(c.subtract(s), "customers"))


@query("string_functions", "SELECT p_partkey, upper(p_name) AS up, reverse(p_brand) AS back, length(p_name) AS n, replace(p_type, ' ', '_') AS kind, substr(p_name, 2, 4) AS part, lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded FROM part")
def string_functions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("up"), F.reverse("p_brand").alias("back"), F.length("p_name").cast("long").alias("n"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("kind"), F.substring("p_name", 2, 4).alias("part"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("padded"))


@query("date_functions", "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS days FROM orders")
def date_functions(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), (F.dayofweek(d) - 1).cast("long").alias("dow"), F.trunc(d, "month").cast("timestamp_ntz").alias("month"), F.datediff(d.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query("array_functions", "SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(CAST(list_max(embedding) AS DOUBLE), 5) AS most, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 5) AS norm FROM embeddings")
def array_functions(spark, sf_dir):
    squared = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.array_max("embedding").cast("double"), 5).alias("most"), F.round(squared, 5).alias("norm"))


@query("distinct_counts", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT json_extract_string(props, '$.k')) AS keys, CAST(median(value) * 1000 AS BIGINT) // 1000 AS mid FROM events GROUP BY 1")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.get_json_object("props", "$.k")).alias("keys"), F.floor(F.median("value")).cast("long").alias("mid"))
