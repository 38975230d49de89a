"""The shapes of the engine's tables on the tables at hand, in Spark and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'error'")
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    e = e.select(F.col("event_id").alias("seq"), user.cast("string").alias("problem_id"), F.col("event_type").alias("method"), k.alias("k"), "value", "ts",
                 (F.lit(1) + user % 5).cast("int").alias("level"), (F.lit(2019) + user % 8).cast("int").alias("year"), (user % 2).cast("int").alias("parity"))
    return e.withColumn("error", F.when(F.col("k") % 10 == 0, "failed")).withColumn("correct", (F.col("k") % 10 != 0) & (F.col("value") > 20)) \
        .withColumn("compute_tokens", (F.lit(10) + F.col("k")).cast("long")).withColumn("usd", F.col("value") / 1e6).withColumn("protocol_hash", F.col("method")) \
        .withColumn("source", F.when(F.col("level") <= 3, "math500").otherwise(F.concat(F.lit("aime"), F.col("year").cast("string"))))


RESULT_ROWS = """result_rows AS (
  SELECT seq, problem_id, method, k, value, ts, level, year, parity, CASE WHEN k % 10 = 0 THEN 'failed' END AS error, (k % 10 <> 0) AND value > 20 AS correct,
         (10 + k)::BIGINT AS compute_tokens, value / 1e6 AS usd, method AS protocol_hash, CASE WHEN level <= 3 THEN 'math500' ELSE 'aime' || year::VARCHAR END AS source
  FROM (SELECT event_id AS seq, user_id::VARCHAR AS problem_id, event_type AS method, json_extract_string(props, '$.k')::INT AS k, value, ts,
               (1 + user_id % 5)::INT AS level, (2019 + user_id % 8)::INT AS year, (user_id % 2)::INT AS parity FROM events WHERE event_type <> 'error'))"""

LATEST = RESULT_ROWS + """, latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY problem_id, method ORDER BY (coalesce(error, '') <> ''), seq DESC) AS rn FROM result_rows) WHERE rn = 1)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in li.columns])
    return li.select(F.col("l_orderkey").alias("problem_id"), (F.row_number().over(w) - 1).cast("int").alias("i"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("answer"),
                     F.col("l_discount").alias("score"), F.col("l_quantity").cast("long").alias("tokens"), (F.col("l_extendedprice") / 1e6).alias("usd"))


SAMPLES = """samples AS (
  SELECT l_orderkey AS problem_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1)::INT AS i,
         nullif(l_returnflag, 'N') AS answer, l_discount AS score, l_quantity::BIGINT AS tokens, l_extendedprice / 1e6 AS usd FROM lineitem)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels"), "doc_id")
    digest = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 4), 16, 10).cast("long")
    return j.select(F.col("source").alias("problem_id"), (F.lit(1) + F.col("doc_id") % 14).cast("int").alias("depth"), (digest % 1000 / 1000.0).alias("score"), (F.col("quality") == 1).alias("label"),
                    (F.col("doc_id") * 7 % 9 / 8.0).alias("soft"), (F.col("toxic") == 1).alias("terminal"), F.concat("source", F.lit("#"), F.col("doc_id").cast("string")).alias("prefix_id"),
                    (F.col("doc_id") % 3).cast("int").alias("variant"), (F.col("doc_id") % 4).cast("long").alias("calls"), (F.col("doc_id") % 2).cast("long").alias("hits"), (F.col("n_chars") / 1000.0).alias("latency"), (F.col("n_chars") / 1e6).alias("usd"))


SCORED = """scored AS (
  SELECT source AS problem_id, (1 + doc_id % 14)::INT AS depth, (('0x' || substr(md5(doc_id::VARCHAR), 1, 4))::BIGINT % 1000) / 1000.0::DOUBLE AS score, quality = 1 AS label, (doc_id * 7 % 9) / 8.0::DOUBLE AS soft, toxic = 1 AS terminal,
         source || '#' || doc_id::VARCHAR AS prefix_id, (doc_id % 3)::INT AS variant, (doc_id % 4)::BIGINT AS calls, (doc_id % 2)::BIGINT AS hits, n_chars / 1000.0::DOUBLE AS latency, n_chars / 1e6::DOUBLE AS usd
  FROM documents JOIN labels USING (doc_id))"""


def traces(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy(F.col("conv_id").cast("string").alias("problem_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("steps"), F.count("*").cast("int").alias("n_steps"))


TRACES = "traces AS (SELECT conv_id::VARCHAR AS problem_id, list(text ORDER BY turn, text) AS steps, count(*)::INT AS n_steps FROM conversations GROUP BY conv_id)"


def problems(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    level = F.when(F.col("c_custkey") % 11 != 0, (F.ascii("c_mktsegment") % 5).cast("int"))
    return c.select(F.col("c_name").alias("id"), level.alias("level"), F.concat(F.lit("q "), "c_name").alias("question"), F.round("c_acctbal").cast("string").alias("answer"))


PROBLEMS = "problems AS (SELECT c_name AS id, CASE WHEN c_custkey % 11 <> 0 THEN (ascii(c_mktsegment) % 5)::INT END AS level FROM customer)"


def tree(spark: SparkSession, d: str) -> DataFrame:
    """region (root) -> nation -> customer -> order; visits are orders below."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("node_id"), F.col("o_custkey").alias("parent_id"), F.least(F.lit(1.0), F.round(F.col("o_totalprice") / 500000, 4)).alias("v"), F.col("o_orderpriority").alias("final_answer"))
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    base = o.join(c.select(F.col("c_custkey").alias("parent_id"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("tree_id"), F.col("c_name").alias("cname"), "n_name"), "parent_id")
    order_nodes = base.select("tree_id", F.concat(F.lit("o"), F.col("node_id").cast("string")).alias("node_id"), F.concat(F.lit("c"), F.col("parent_id").cast("string")).alias("parent_id"), F.lit(3).alias("depth"), F.col("final_answer").alias("step"), F.lit(1).cast("long").alias("N"), F.col("v").alias("W"), F.col("v").alias("value"), F.lit(True).alias("terminal"), "final_answer")
    level = lambda key, parent, depth, step: base.groupBy("tree_id", key.alias("node_id"), parent.alias("parent_id"), step.alias("step")).agg(F.count("*").alias("N"), F.round(F.sum("v"), 4).alias("W")).select("tree_id", "node_id", "parent_id", F.lit(depth).alias("depth"), "step", "N", "W", F.lit(None).cast("double").alias("value"), F.lit(False).alias("terminal"), F.lit(None).cast("string").alias("final_answer"))
    customers = level(F.concat(F.lit("c"), F.col("parent_id").cast("string")), F.concat(F.lit("n"), F.col("nation").cast("string")), 2, F.col("cname"))
    nations = level(F.concat(F.lit("n"), F.col("nation").cast("string")), F.concat(F.lit("r"), F.col("tree_id").cast("string")), 1, F.col("n_name"))
    roots = level(F.concat(F.lit("r"), F.col("tree_id").cast("string")), F.lit(None).cast("string"), 0, F.lit(""))
    both = order_nodes.unionByName(customers).unionByName(nations).unionByName(roots)
    w = Window.partitionBy("tree_id", "parent_id")
    return both.withColumn("child_pos", (F.row_number().over(w.orderBy("node_id")) - 1).cast("int")).withColumn("prior", F.col("N") / F.sum("N").over(w)).withColumn("virtual_loss", F.lit(0))


TREE = """base AS (SELECT n_regionkey AS tree_id, c_nationkey AS nation, c_custkey AS cust, o_orderkey AS ord, least(1.0::DOUBLE, round(o_totalprice / 500000, 4)) AS v, o_orderpriority AS ans, c_name, n_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
raw AS (SELECT tree_id, 'o' || ord AS node_id, 'c' || cust AS parent_id, 3 AS depth, ans AS step, 1::BIGINT AS N, v AS W, v AS value, true AS terminal, ans AS final_answer FROM base
  UNION ALL SELECT tree_id, 'c' || cust, 'n' || nation, 2, c_name, count(*), round(sum(v), 4), NULL, false, NULL FROM base GROUP BY ALL
  UNION ALL SELECT tree_id, 'n' || nation, 'r' || tree_id, 1, n_name, count(*), round(sum(v), 4), NULL, false, NULL FROM base GROUP BY ALL
  UNION ALL SELECT tree_id, 'r' || tree_id, NULL, 0, '', count(*), round(sum(v), 4), NULL, false, NULL FROM base GROUP BY ALL),
tree AS (SELECT *, (row_number() OVER (PARTITION BY tree_id, parent_id ORDER BY node_id) - 1)::INT AS child_pos, N / sum(N) OVER (PARTITION BY tree_id, parent_id) AS prior, 0 AS virtual_loss FROM raw)"""


def calls(spark: SparkSession, d: str) -> DataFrame:
    r = result_rows(spark, d)
    return r.select("seq", F.col("method").alias("run"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.lit(1) + F.col("k")).cast("double").alias("estimate"), F.round(F.col("value") / 100, 4).alias("usd"), "k").withColumn("sec", F.col("us") / 1e6)


CALLS = RESULT_ROWS + """, calls AS (SELECT seq, method AS run, epoch_us(ts) AS us, (1 + k)::DOUBLE AS estimate, round(value / 100, 4) AS usd, k, epoch_us(ts) / 1e6 AS sec FROM result_rows)"""
