"""The canonical inputs, as deterministic projections of the tables, in DataFrame form and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def intdiv(c: str, n: int) -> Column:
    return F.floor(F.col(c) / n).cast("long")


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered change log: (seq, key, is_deleted, type, int_value, float_value, string_value)."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"),
        (kind == "error").alias("is_deleted"),
        F.when(kind == "click", "int").when(kind.isin("view", "purchase"), "float").when(kind == "signup", "string").alias("type"),
        F.when(kind == "click", F.floor("value").cast("long")).alias("int_value"),
        F.when(kind.isin("view", "purchase"), F.col("value")).alias("float_value"),
        F.when(kind == "signup", F.col("props")).alias("string_value"),
    )


def kv_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in runs of 100 records; the runs with an even number are in level 1, the newer, odd ones in level 0."""
    log = kv_log(spark, sf_dir).withColumn("run_id", intdiv("seq", 100))
    return log.withColumn("level", (1 - F.col("run_id") % 2).cast("int"))


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    path = F.when(kind.isin("click", "view", "error"), F.concat(F.lit("/kv/u"), user.cast("string"))).when(kind == "purchase", "/status")
    path = path.otherwise(F.when(user % 4 == 0, "/health/nodes").when(user % 4 == 1, F.concat(F.lit("/health/node/"), user.cast("string"))).when(user % 4 == 2, "/diagnose").otherwise("/nodes/1"))
    status = F.when(user % 10 == 0, 404).when(user % 10 == 1, 409).when(user % 10 == 2, 500).when(user % 10 == 3, 302).otherwise(200)
    return table(spark, sf_dir, "events").select("event_id", F.when(kind == "click", "PUT").when(kind == "error", "DELETE").otherwise("GET").alias("method"), path.alias("path"), status.alias("status"), (F.col("value") / 100).alias("duration_s"), micros().alias("us"))


def node_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster, node_id, address, reachable, healthy, latency_ms, leader_id, term, message): a cluster per nation."""
    k, b = F.col("s_suppkey"), F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cluster"), k.alias("node_id"), F.concat(F.lit("node"), k.cast("string"), F.lit(":"), (6000 + k % 1000).cast("string")).alias("address"), (b > -500).alias("reachable"), (b > 2000).alias("healthy"), F.floor(F.abs(b)).cast("long").alias("latency_ms"), F.when(k % 7 != 0, k % 5).alias("leader_id"), (k % 11).alias("term"), F.when(b > 2000, "ok").when(b > -500, "log is behind").otherwise("connection refused").alias("message"))


def raft_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, idx, term, payload): the orders as a log on three nodes.

    Planted faults: node 3 differs in term and payload at every 97th entry of the uncommitted last
    tenth, and in the payload alone at every 1009th entry, committed ones too.
    """
    o = table(spark, sf_dir, "orders")
    last = o.agg(F.max("o_orderkey").alias("last"))
    rows = o.crossJoin(F.broadcast(last)).select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("node"), F.col("o_orderkey").alias("idx"), (1 + intdiv("o_orderkey", 100)).alias("term"), F.concat_ws("=", F.col("o_custkey").cast("string"), "o_orderstatus").alias("payload"), "last")
    off = (F.col("node") == 3) & (F.col("idx") % 97 == 0) & (F.col("idx") * 10 > F.col("last") * 9)
    return rows.select("node", "idx", (F.col("term") + F.when(off, 1).otherwise(0)).alias("term"), F.when(off, F.concat(F.lit("x"), "payload")).when((F.col("node") == 3) & (F.col("idx") % 1009 == 0), F.concat(F.lit("y"), "payload")).otherwise(F.col("payload")).alias("payload"))


def raft_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, term, commit_index): the leaders of the groups of raft_match; every third was elected after the last entry."""
    top = raft_match(spark, sf_dir).groupBy("grp").agg(F.max("match_index").alias("top"), F.min("match_index").alias("low"))
    return top.select("grp", (1 + intdiv("top", 100) + F.when(F.col("grp") % 3 == 2, 5).otherwise(0)).cast("long").alias("term"), intdiv("low", 2).alias("commit_index"))


def raft_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, node, term, role): what nodes said of themselves; every 97th report is of a second leader."""
    e = F.col("event_id")
    term = intdiv("event_id", 50)
    node = F.when(e % 97 == 0, (term + 1) % 5).otherwise(F.col("user_id") % 5)
    return table(spark, sf_dir, "events").select(e.alias("seq"), node.alias("node"), term.alias("term"), F.when((F.col("user_id") % 5 == term % 5) | (e % 97 == 0), "Leader").otherwise("Follower").alias("role"))


def raft_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, peer, seq, term, leader_term, success, match_index): answers to leaders, some of an earlier or a later term."""
    e, grp = F.col("event_id"), F.col("user_id") % 40
    term = F.when(e % 11 == 0, 8).when((e % 499 == 0) & (e > 500), 10).otherwise(9).cast("long")
    return table(spark, sf_dir, "events").select(grp.alias("grp"), (e % 4).alias("peer"), e.alias("seq"), term.alias("term"), F.lit(9).cast("long").alias("leader_term"), (F.col("event_type") != "error").alias("success"), F.floor(e / 2).cast("long").alias("match_index"))


def raft_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, commit_index, applied, term, role): the nodes of raft_log, committed up to nine tenths."""
    last = table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("last"))
    return last.select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("node"), "last").select("node", (F.floor(F.col("last") * 9 / 10) - F.col("node")).cast("long").alias("commit_index"), F.floor(F.col("last") / 2).cast("long").alias("applied"), (1 + F.floor(F.col("last") / 100) - F.when(F.col("node") == 3, 1).otherwise(0)).cast("long").alias("term"), F.when(F.col("node") < 3, "Leader").otherwise("Follower").alias("role"))


def raft_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("grp"), (F.col("o_orderkey") % 4).alias("peer")).agg(F.max("o_orderkey").alias("match_index"))


def raft_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vote requests in order, each with the candidate's last entry and the voter's own."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(e.alias("seq"), intdiv("event_id", 50).alias("term"), (F.col("user_id") % 5).alias("voter"), (e % 3).alias("candidate"), intdiv("event_id", 100).alias("last_term"), (e % 1000).alias("last_index"), (intdiv("event_id", 100) - F.col("user_id") % 2).alias("own_term"), (F.col("user_id") * 7 % 1000).alias("own_index"))


def sim_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sequence, src, dst, us): messages by their delivery time in microseconds."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), (F.col("user_id") % 5).alias("src"), (F.col("event_id") % 5).alias("dst"), micros().alias("us"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error")).select(F.col("event_id").alias("idx"), F.when(F.col("event_type") == "signup", "Add").otherwise("Remove").alias("kind"), (F.col("user_id") % 50).alias("peer"))


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty")).select(F.concat("l_returnflag", "l_linestatus").alias("name"), (F.col("qty") / F.col("n")).alias("throughput"), "n")


SQL = """
WITH kv_log AS (SELECT event_id AS seq, 'u' || lpad(user_id::VARCHAR, 6, '0') AS key, event_type = 'error' AS is_deleted,
  CASE WHEN event_type = 'click' THEN 'int' WHEN event_type IN ('view', 'purchase') THEN 'float' WHEN event_type = 'signup' THEN 'string' END AS type,
  CASE WHEN event_type = 'click' THEN floor(value)::BIGINT END AS int_value,
  CASE WHEN event_type IN ('view', 'purchase') THEN value END AS float_value,
  CASE WHEN event_type = 'signup' THEN props END AS string_value FROM events),
kv_runs AS (SELECT *, seq // 100 AS run_id, (1 - (seq // 100) % 2)::INT AS level FROM kv_log),
http_log AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'PUT' WHEN 'error' THEN 'DELETE' ELSE 'GET' END AS method,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN '/kv/u' || user_id WHEN event_type = 'purchase' THEN '/status'
    WHEN user_id % 4 = 0 THEN '/health/nodes' WHEN user_id % 4 = 1 THEN '/health/node/' || user_id WHEN user_id % 4 = 2 THEN '/diagnose' ELSE '/nodes/1' END AS path,
  CASE user_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 409 WHEN 2 THEN 500 WHEN 3 THEN 302 ELSE 200 END AS status, value / 100 AS duration_s, epoch_us(ts) AS us FROM events),
node_health AS (SELECT s_nationkey AS cluster, s_suppkey AS node_id, 'node' || s_suppkey || ':' || (6000 + s_suppkey % 1000) AS address,
  s_acctbal > -500 AS reachable, s_acctbal > 2000 AS healthy, floor(abs(s_acctbal))::BIGINT AS latency_ms,
  CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 5 END AS leader_id, s_suppkey % 11 AS term,
  CASE WHEN s_acctbal > 2000 THEN 'ok' WHEN s_acctbal > -500 THEN 'log is behind' ELSE 'connection refused' END AS message FROM supplier),
raft_log AS (SELECT node, idx, CASE WHEN off THEN term + 1 ELSE term END AS term, CASE WHEN off THEN 'x' || payload WHEN node = 3 AND idx % 1009 = 0 THEN 'y' || payload ELSE payload END AS payload FROM (
  SELECT n.node, o_orderkey AS idx, 1 + o_orderkey // 100 AS term, o_custkey || '=' || o_orderstatus AS payload,
    n.node = 3 AND o_orderkey % 97 = 0 AND o_orderkey * 10 > (SELECT max(o_orderkey) FROM orders) * 9 AS off
  FROM orders, (VALUES (1::BIGINT), (2), (3)) n(node))),
raft_nodes AS (SELECT node, floor(last * 9 / 10)::BIGINT - node AS commit_index, last // 2 AS applied, 1 + last // 100 - (CASE WHEN node = 3 THEN 1 ELSE 0 END) AS term,
  CASE WHEN node < 3 THEN 'Leader' ELSE 'Follower' END AS role FROM (SELECT max(o_orderkey) AS last FROM orders), (VALUES (1::BIGINT), (2), (3)) n(node)),
raft_match AS (SELECT o_custkey % 20 AS grp, o_orderkey % 4 AS peer, max(o_orderkey) AS match_index FROM orders GROUP BY ALL),
raft_leaders AS (SELECT grp, 1 + max(match_index) // 100 + CASE WHEN grp % 3 = 2 THEN 5 ELSE 0 END AS term, min(match_index) // 2 AS commit_index FROM raft_match GROUP BY grp),
raft_roles AS (SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN (event_id // 50 + 1) % 5 ELSE user_id % 5 END AS node, event_id // 50 AS term,
  CASE WHEN user_id % 5 = event_id // 50 % 5 OR event_id % 97 = 0 THEN 'Leader' ELSE 'Follower' END AS role FROM events),
raft_responses AS (SELECT user_id % 40 AS grp, event_id % 4 AS peer, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 8 WHEN event_id % 499 = 0 AND event_id > 500 THEN 10 ELSE 9 END AS term,
  9 AS leader_term, event_type <> 'error' AS success, event_id // 2 AS match_index FROM events),
raft_votes AS (SELECT event_id AS seq, event_id // 50 AS term, user_id % 5 AS voter, event_id % 3 AS candidate, event_id // 100 AS last_term, event_id % 1000 AS last_index,
  event_id // 100 - user_id % 2 AS own_term, user_id * 7 % 1000 AS own_index FROM events),
sim_events AS (SELECT event_id AS sequence, user_id % 5 AS src, event_id % 5 AS dst, epoch_us(ts) AS us FROM events),
membership AS (SELECT event_id AS idx, CASE WHEN event_type = 'signup' THEN 'Add' ELSE 'Remove' END AS kind, user_id % 50 AS peer FROM events WHERE event_type IN ('signup', 'error')),
experiments AS (SELECT l_returnflag || l_linestatus AS name, round(sum(l_quantity), 2) / count(*) AS throughput, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus)
"""
