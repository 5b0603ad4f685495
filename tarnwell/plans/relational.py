"""Relational, set, window, time and streaming queries over the engine's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tarnwell.operators import relational as ops
from tarnwell.runtime import ensure_checkpoint_dir
from tarnwell.sources import read_jsonl, table, write_jsonl
from tarnwell.streaming import jobs

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def of(*names: str):
    return lambda spark, d: tuple(table(spark, d, n) for n in names)


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 49 AND l_discount >= 0.09""")
def scan_filter_project(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 49 and l_discount >= 0.09").select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate <= date '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.sum(revenue()), 2).alias("sum_disc"),
        F.round(F.sum(revenue() * (1 + F.col("l_tax"))), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@query("""SELECT l_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
 WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1995-03-15' AND l_shipdate > DATE '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def top_orders(spark, d):
    c, o, li = of("customer", "orders", "lineitem")(spark, d)
    j = c.where("c_mktsegment = 'BUILDING'").join(o.where("o_orderdate < date '1995-03-15'"), F.col("c_custkey") == F.col("o_custkey"))
    j = j.join(li.where("l_shipdate > date '1995-03-15'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "o_orderdate").agg(F.round(F.sum(revenue()), 2).alias("revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def local_suppliers(spark, d):
    c, o, li, s, n, r = of("customer", "orders", "lineitem", "supplier", "nation", "region")(spark, d)
    j = c.join(o, c.c_custkey == o.o_custkey).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, (F.col("l_suppkey") == s.s_suppkey) & (c.c_nationkey == s.s_nationkey))
    return j.join(n, F.col("s_nationkey") == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).groupBy("n_name").agg(F.round(F.sum(revenue()), 2).alias("revenue"))


@query("""SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1994-01-01' AND l_shipdate < DATE '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def forecast_revenue(spark, d):
    f = table(spark, d, "lineitem").where("l_shipdate >= date '1994-01-01' and l_shipdate < date '1995-01-01' and l_discount between 0.05 and 0.07 and l_quantity < 24")
    return f.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 4).alias("revenue"))


@query("SELECT n_name, count(s_suppkey) AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name")
def left_join(spark, d):
    n, s = of("nation", "supplier")(spark, d)
    return n.join(s, n.n_nationkey == s.s_nationkey, "left").groupBy("n_name").agg(F.count("s_suppkey").alias("suppliers"))


@query("SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 48)")
def semi_join(spark, d):
    o, li = of("orders", "lineitem")(spark, d)
    return o.join(li.where("l_quantity > 48"), o.o_orderkey == li.l_orderkey, "left_semi").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def anti_join(spark, d):
    p, li = of("part", "lineitem")(spark, d)
    return p.join(li.where("l_quantity > 40"), p.p_partkey == li.l_partkey, "left_anti").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(a.n_nationkey, b.n_nationkey) AS k, a.c AS customers, b.c AS suppliers FROM (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
 FULL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS c FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b USING (n_nationkey)""")
def full_join(spark, d):
    c, s = of("customer", "supplier")(spark, d)
    a = c.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    b = s.where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")


@query("""SELECT b.r_regionkey AS band, count(*) AS n FROM orders JOIN (SELECT r_regionkey, r_regionkey * 60000.0 AS lo, r_regionkey * 60000.0 + 90000 AS hi FROM region) b ON o_totalprice BETWEEN lo AND hi GROUP BY 1""")
def band_containment(spark, d):
    r, o = of("region", "orders")(spark, d)
    lo = F.col("r_regionkey") * 60000.0
    bands = r.select(F.col("r_regionkey").alias("band"), lo.alias("lo"), (lo + 90000).alias("hi"))
    return ops.range_join(o.select("o_totalprice"), bands, "o_totalprice", "lo", "hi", 30000.0).groupBy("band").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT user_id, ts, event_id AS click FROM events WHERE event_type = 'click') SELECT e.event_id, c.click FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts""")
def asof_join(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click"))
    return ops.asof(left, right, "user_id", "ts", ["click"]).select("event_id", "click")


@query("SELECT o_orderpriority, o_orderstatus, CAST(grouping(o_orderpriority) AS INT) AS gp, CAST(grouping(o_orderstatus) AS INT) AS gs, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube(spark, d):
    return table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.grouping("o_orderpriority").cast("int").alias("gp"), F.grouping("o_orderstatus").cast("int").alias("gs"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY ROLLUP (year(o_orderdate), month(o_orderdate))")
def rollup(spark, d):
    return table(spark, d, "orders").select(F.year("o_orderdate").cast("bigint").alias("y"), F.month("o_orderdate").cast("bigint").alias("m")).rollup("y", "m").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, CAST(rank() OVER w AS INT) AS rk, CAST(dense_rank() OVER w AS INT) AS dr, lag(l_quantity) OVER o AS before, lead(l_quantity) OVER o AS after, sum(l_quantity) OVER (o ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS moving,
 sum(l_quantity) OVER (o ROWS UNBOUNDED PRECEDING) AS running FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC), o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def window_frames(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    w, o = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity")), Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return li.select(
        "l_orderkey", "l_linenumber", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.lag("l_quantity").over(o).alias("before"), F.lead("l_quantity").over(o).alias("after"),
        F.sum("l_quantity").over(o.rowsBetween(-2, 0)).alias("moving"), F.sum("l_quantity").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("running"),
    )


@query("""(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey + 100 FROM nation EXCEPT SELECT s_nationkey + 100 FROM supplier)""")
def set_operations(spark, d):
    c, s, n = of("customer", "supplier", "nation")(spark, d)
    both = c.select(F.col("c_nationkey").alias("k")).intersect(s.select(F.col("s_nationkey").alias("k")))
    return both.unionByName(n.select((F.col("n_nationkey") + 100).alias("k")).exceptAll(s.select((F.col("s_nationkey") + 100).alias("k")).distinct()))


@query("""SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'O') AS "O", sum(l_quantity) FILTER (l_linestatus = 'F') AS "F" FROM lineitem GROUP BY l_returnflag""")
def pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(F.sum("l_quantity"))


@query("""SELECT s_suppkey, field, v FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT (v FOR field IN (nation, balance))""")
def unpivot(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return s.unpivot("s_suppkey", ["nation", "balance"], "field", "v")


@query("""WITH RECURSIVE t(level, k) AS (SELECT 0, n_nationkey FROM nation WHERE n_nationkey = 1 UNION ALL SELECT level + 1, n_nationkey FROM t JOIN nation ON n_nationkey IN (t.k * 2, t.k * 2 + 1) WHERE level < 6) SELECT CAST(level AS INT) AS level, CAST(k AS BIGINT) AS k FROM t""")
def recursive_walk(spark, d):
    """A walk from parent to children, level by level."""
    name = f"nation_{uuid.uuid4().hex}"
    table(spark, d, "nation").createOrReplaceTempView(name)
    return spark.sql(f"""WITH RECURSIVE t(level, k) AS (SELECT 0, cast(n_nationkey AS bigint) FROM {name} WHERE n_nationkey = 1
      UNION ALL SELECT level + 1, cast(n_nationkey AS bigint) FROM t JOIN {name} ON n_nationkey IN (t.k * 2, t.k * 2 + 1) WHERE level < 6) SELECT level, k FROM t""")


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY user_id")
def json_functions(spark, d):
    e = table(spark, d, "events", "user_id", "props").select("user_id", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


@query("""SELECT o_orderkey, CAST(date_diff('day', o_orderdate, max(l_shipdate)) AS INT) AS days, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dow FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate""")
def date_functions(spark, d):
    o, li = of("orders", "lineitem")(spark, d)
    last = li.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("last"))
    j = o.join(last, o.o_orderkey == last.l_orderkey)
    return j.select("o_orderkey", F.datediff("last", "o_orderdate").alias("days"), F.trunc("o_orderdate", "month").alias("month"), F.dayofweek("o_orderdate").alias("dow"))


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.windowed_counts(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL '2 hours' THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '2 hours' AS "end", count(*) AS n FROM g GROUP BY user_id, k""")
def session_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.sessions(e).withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("""SELECT CAST(count(*) AS BIGINT) AS rows, count(DISTINCT l_partkey) AS parts, CAST(quantile_cont(l_extendedprice, 0.5) AS DOUBLE) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem""")
def statistics(spark, d):
    li = table(spark, d, "lineitem")
    return li.agg(F.count("*").alias("rows"), F.count_distinct("l_partkey").alias("parts"), F.percentile("l_extendedprice", 0.5).alias("median"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"))


@query()
def approximate(spark, d):
    return table(spark, d, "lineitem").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.approx_percentile("l_extendedprice", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), F.lit(1000)).alias("prices"))


@query("SELECT l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY 1")
def salted_sum(spark, d):
    return ops.salted_sum(table(spark, d, "lineitem", "l_returnflag", "l_quantity"), "l_returnflag", F.col("l_quantity"))


@query("SELECT p_brand, p_type, count(DISTINCT l_suppkey) AS suppliers, max(l_extendedprice) AS dearest FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def hash_join(spark, d):
    p, li = of("part", "lineitem")(spark, d)
    return p.join(li, p.p_partkey == li.l_partkey).groupBy("p_brand", "p_type").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.max("l_extendedprice").alias("dearest"))


@query()
def jsonl_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Chunks written as JSON lines and read back by an explicit schema."""
    q = table(spark, d, "question_sample2", "sample_id", "id", "chunk_type", "text")
    path = f"{ensure_checkpoint_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    write_jsonl(q, path)
    return read_jsonl(spark, path, q.schema)


SQL["jsonl_round_trip"] = "SELECT sample_id, id, chunk_type, text FROM question_sample2"


@query(SQL["tumbling_windows"])
def stream_windows(spark, d):
    return jobs.run_closed(spark, d, jobs.windowed_counts).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT time_bucket(INTERVAL '2 hours', ts) - k * INTERVAL '2 hours' AS start, event_type, count(*) AS n FROM events, range(3) r(k) GROUP BY ALL")
def stream_sliding(spark, d):
    return jobs.run_closed(spark, d, jobs.sliding_counts).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(SQL["session_windows"])
def stream_sessions(spark, d):
    s = jobs.run_closed(spark, d, jobs.sessions)
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, arg_min(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def stream_first_facts(spark, d):
    return jobs.run_to_end(jobs.first_facts(jobs.events(spark, d)))
