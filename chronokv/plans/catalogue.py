"""Every registered query of the engine, each with its SQL.

A query takes (spark, sf_dir) and reads the whole tables. ``SQL`` bodies follow the common table
expressions of ``chronokv.sources.views``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronokv.functions import text, values
from chronokv.functions.random import next_f64, next_u64
from chronokv.operators import health, kv, metrics, raft, runs, sim
from chronokv.operators.ordering import lagged, numbered
from chronokv.sources import formats, views
from chronokv.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = (views.SQL.replace("WITH", "WITH RECURSIVE", 1) if "walk AS" in sql else views.SQL) + sql
        return f

    return add


CELL = "type, int_value, float_value, string_value"
NEWEST = "QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1"


def small(spark: SparkSession, schema: str, *rows) -> DataFrame:
    """A list of faults or nodes as a table."""
    return spark.createDataFrame(list(rows), schema)


# Key-value state


@query(f"SELECT seq, key, is_deleted, {CELL} FROM kv_log")
def kv_log_scan(spark, sf):
    return views.kv_log(spark, sf)


@query(f"SELECT * EXCLUDE is_deleted FROM (SELECT key, seq, is_deleted, {CELL} FROM kv_log {NEWEST}) WHERE NOT is_deleted")
def kv_snapshot(spark, sf):
    return kv.snapshot(views.kv_log(spark, sf))


@query(f"SELECT * EXCLUDE is_deleted FROM (SELECT key, seq, is_deleted, {CELL} FROM kv_log WHERE key = 'u000007' {NEWEST}) WHERE NOT is_deleted")
def kv_get(spark, sf):
    return kv.get(views.kv_log(spark, sf), "u000007")


@query(f"""SELECT w.key, s.seq, {", ".join("s." + c.strip() for c in CELL.split(","))}
FROM (SELECT DISTINCT 'u' || lpad(c_custkey::VARCHAR, 6, '0') AS key FROM customer) w
LEFT JOIN (SELECT * FROM (SELECT * FROM kv_log {NEWEST}) WHERE NOT is_deleted) s USING (key)""")
def kv_multi_get(spark, sf):
    wanted = views.table(spark, sf, "customer").select(F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("key")).distinct()
    return kv.multi_get(views.kv_log(spark, sf), wanted)


@query(f"SELECT key FROM (SELECT key, is_deleted FROM kv_log {NEWEST}) WHERE NOT is_deleted")
def kv_live_keys(spark, sf):
    return kv.snapshot(views.kv_log(spark, sf).select("seq", "key", "is_deleted")).select("key")


@query(f"SELECT * EXCLUDE is_deleted FROM (SELECT key, seq, is_deleted, {CELL} FROM kv_log WHERE seq <= 4999 {NEWEST}) WHERE NOT is_deleted")
def kv_as_of(spark, sf):
    return kv.as_of(views.kv_log(spark, sf), 4999)


@query(f"""SELECT seq, key, is_deleted, {CELL}, row_number() OVER w AS version, lead(seq) OVER w AS "until", lag(type) OVER w AS type_before FROM kv_log WINDOW w AS (PARTITION BY key ORDER BY seq)""")
def kv_history(spark, sf):
    return kv.history(views.kv_log(spark, sf))


@query(f"""SELECT key, seq, is_deleted, {CELL} FROM kv_log {NEWEST}""")
def overlay_merge(spark, sf):
    log = views.kv_runs(spark, sf)
    top, below = log.where("run_id % 3 = 2 or run_id >= 50"), log.where("not (run_id % 3 = 2 or run_id >= 50)")
    newer = kv.latest(top.drop("run_id", "level"))
    older = kv.latest(below.drop("run_id", "level"))
    # What is newer of the two is on top, key by key.
    on_top = newer.join(older.select("key", F.col("seq").alias("s")), "key", "left").where("s is null or seq > s").drop("s")
    return kv.overlay(on_top, older)


# Runs


@query(f"SELECT level, run_id, key, seq, is_deleted, {CELL} FROM kv_runs QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1")
def flush_runs(spark, sf):
    return runs.fold_runs(views.kv_runs(spark, sf))


FLUSH = """, s AS (SELECT seq, key, substr(key, 6, 2)::BIGINT % 8 AS shard, row_number() OVER (PARTITION BY substr(key, 6, 2)::BIGINT % 8 ORDER BY seq) AS k FROM kv_log),
walk AS (SELECT shard, k, seq, key, 0::BIGINT AS run, [key] AS held FROM s WHERE k = 1
  UNION ALL SELECT s.shard, s.k, s.seq, s.key, CASE WHEN len(held) >= 8 THEN run + 1 ELSE run END, CASE WHEN len(held) >= 8 THEN [s.key] WHEN list_contains(held, s.key) THEN held ELSE list_append(held, s.key) END
  FROM walk JOIN s ON s.shard = walk.shard AND s.k = walk.k + 1)
SELECT shard, run, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS records, count(DISTINCT key) AS entries FROM walk GROUP BY shard, run"""


@query(FLUSH)
def flush_by_keys(spark, sf):
    """A shard's table is flushed at 8 distinct keys: a row per run with its first and last record and its keys."""
    log = views.kv_log(spark, sf).select("seq", "key", F.pmod(F.substring("key", 6, 2).cast("long"), F.lit(8)).alias("shard"))
    cut = runs.flush_points(log, 8)
    return cut.groupBy("shard", "run").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("records"), F.count_distinct("key").alias("entries"))


@query(f"SELECT run_id, key, seq, is_deleted, {CELL} FROM kv_runs WHERE run_id = 3 QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1")
def run_scan(spark, sf):
    return runs.fold_runs(views.kv_runs(spark, sf).where("run_id = 3")).drop("level")


@query("SELECT level, run_id, count(DISTINCT key) AS entries, min(key) AS first_key, max(key) AS last_key, max(seq) AS last_seq, max(run_id) OVER () + 1 AS next_id FROM kv_runs GROUP BY level, run_id")
def run_catalog(spark, sf):
    log = views.kv_runs(spark, sf)
    next_id = log.agg((F.max("run_id") + 1).alias("next_id"))
    return log.groupBy("level", "run_id").agg(F.count_distinct("key").alias("entries"), F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.max("seq").alias("last_seq")).crossJoin(F.broadcast(next_id))


@query("SELECT run_id, count(*) FILTER (bad) AS violations, count(*) AS entries FROM (SELECT run_id, lag(key) OVER (PARTITION BY run_id ORDER BY seq) >= key AS bad FROM kv_runs) GROUP BY run_id")
def run_order_check(spark, sf):
    return runs.order_violations(views.kv_runs(spark, sf))


RENDER = "CASE type WHEN 'int' THEN int_value::VARCHAR WHEN 'float' THEN CASE WHEN float_value = floor(float_value) THEN floor(float_value)::BIGINT::VARCHAR ELSE float_value::VARCHAR END WHEN 'string' THEN string_value END"
SIZES = f"octet_length(encode(key)) AS key_len, coalesce(octet_length(encode({RENDER})), 0) AS value_len"


@query(f""", e AS (SELECT * FROM kv_runs QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1), s AS (SELECT run_id, key, {SIZES} FROM e)
SELECT run_id, key, (10 + key_len + value_len)::INT AS record_len, (45 + coalesce(sum(10 + key_len + value_len) OVER (PARTITION BY run_id ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset" FROM s""")
def run_offsets(spark, sf):
    return runs.offsets(runs.fold_runs(views.kv_runs(spark, sf))).select("run_id", "key", "record_len", "offset")


@query(f""", e AS (SELECT * FROM kv_runs QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1)
SELECT key, level, run_id, seq, is_deleted, {CELL} FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY level, run_id DESC) = 1""")
def compact_level(spark, sf):
    return runs.merge(runs.fold_runs(views.kv_runs(spark, sf)))


@query("SELECT level, count(DISTINCT run_id) AS n_runs FROM kv_runs GROUP BY level HAVING count(DISTINCT run_id) >= 3")
def compaction_candidates(spark, sf):
    return views.kv_runs(spark, sf).groupBy("level").agg(F.count_distinct("run_id").alias("n_runs")).where("n_runs >= 3")


@query(""", e AS (SELECT level, run_id, count(DISTINCT key) AS n FROM kv_runs GROUP BY level, run_id)
SELECT level, count(*) AS merges, sum(n)::BIGINT AS entries_in, (SELECT count(DISTINCT key) FROM kv_runs k WHERE k.level = e.level) AS entries_out FROM e GROUP BY level""")
def compaction_stats(spark, sf):
    log = views.kv_runs(spark, sf)
    each = log.groupBy("level", "run_id").agg(F.count_distinct("key").alias("n")).groupBy("level").agg(F.count("*").alias("merges"), F.sum("n").alias("entries_in"))
    return each.join(log.groupBy("level").agg(F.count_distinct("key").alias("entries_out")), "level")


@query(f", s AS (SELECT run_id, {SIZES} FROM kv_runs) SELECT run_id, sum(10 + key_len + value_len)::BIGINT AS bytes FROM s GROUP BY run_id")
def storage_bytes(spark, sf):
    return runs.record_sizes(views.kv_runs(spark, sf)).groupBy("run_id").agg(F.sum("record_len").alias("bytes"))


@query(""", n AS (SELECT run_id, count(DISTINCT key) AS n FROM kv_runs GROUP BY run_id), b AS (SELECT *, greatest(8, ceil(-n * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS bits FROM n)
SELECT run_id, n, bits, greatest(1, round(bits / n * ln(2)))::INT AS hashes FROM b""")
def bloom_sizing(spark, sf):
    n = views.kv_runs(spark, sf).groupBy("run_id").agg(F.count_distinct("key").alias("n"))
    return n.select("run_id", "n", runs.bloom_bits(F.col("n")).alias("bits"), runs.bloom_hashes(F.col("n")).alias("hashes"))


@query()
def bloom_probe(spark, sf):
    """Every run is asked for its own keys and those of the run before."""
    log = views.kv_runs(spark, sf)
    return runs.bloom_probe(log, log.select("run_id", "key").union(log.select(F.col("run_id") + 1, "key")))


@query("SELECT run_id, key FROM kv_runs GROUP BY run_id, key")
def bloom_no_false_negative(spark, sf):
    log = views.kv_runs(spark, sf)
    return runs.bloom_probe(log, log).where("may_contain").select("run_id", "key")


@query(f"SELECT seq, key, is_deleted, {CELL} FROM kv_log WHERE seq < coalesce((SELECT min(seq) FROM kv_log WHERE float_value > 60), 9223372036854775807)")
def wal_valid_prefix(spark, sf):
    return runs.valid_prefix(views.kv_log(spark, sf), ~F.coalesce(F.col("float_value") > 60, F.lit(False)))


NUMBER_XOR = "xor(xor(xor({0} & 255, {0} >> 8 & 255), xor({0} >> 16 & 255, {0} >> 24 & 255)), xor(xor({0} >> 32 & 255, {0} >> 40 & 255), xor({0} >> 48 & 255, {0} >> 56 & 255)))"


@query(f"""SELECT seq, xor(xor(xor(xor({NUMBER_XOR.format("seq")}, CASE WHEN is_deleted THEN 2 ELSE 1 END), code), xor({NUMBER_XOR.format("key_len")}, {NUMBER_XOR.format("value_len")})),
  list_reduce(list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::INT, 2))::INT), lambda a, b: xor(a, b), 0))::INT AS checksum
FROM (SELECT seq, is_deleted, CASE type WHEN 'int' THEN 1 WHEN 'float' THEN 2 WHEN 'string' THEN 3 ELSE 0 END AS code, octet_length(encode(key))::BIGINT AS key_len, coalesce(octet_length(encode({RENDER})), 0)::BIGINT AS value_len, hex(encode(key || coalesce({RENDER}, ''))) AS h FROM kv_log)""")
def wal_checksum(spark, sf):
    return views.kv_log(spark, sf).select("seq", values.record_checksum("seq", "is_deleted", "type", "key", values.render()).alias("checksum"))


@query(f", s AS (SELECT seq, {SIZES} FROM kv_log) SELECT seq, key_len::INT AS key_len, value_len::INT AS value_len, (10 + key_len + value_len)::INT AS record_len FROM s")
def record_sizes(spark, sf):
    return runs.record_sizes(views.kv_log(spark, sf)).select("seq", "key_len", "value_len", "record_len")


@query(f"SELECT seq, key, is_deleted, type, {RENDER} AS value FROM kv_log")
def wal_round_trip(spark, sf):
    return formats.decode_log(formats.encode_log(views.kv_log(spark, sf)))


@query(f"SELECT run_id, key, is_deleted, type, {RENDER} AS value FROM kv_runs QUALIFY row_number() OVER (PARTITION BY run_id, key ORDER BY seq DESC) = 1")
def run_round_trip(spark, sf):
    return formats.decode_runs(formats.encode_runs(runs.fold_runs(views.kv_runs(spark, sf))))


# Replicated logs


@query("SELECT node, idx, term, payload FROM raft_log")
def raft_log_scan(spark, sf):
    return views.raft_log(spark, sf)


@query("SELECT node, idx, term, payload FROM raft_log JOIN (SELECT node, applied, commit_index FROM raft_nodes) USING (node) WHERE idx > applied AND idx <= commit_index")
def raft_committed(spark, sf):
    nodes = F.broadcast(views.raft_nodes(spark, sf).select("node", "applied", "commit_index"))
    return views.raft_log(spark, sf).join(nodes, "node").where("idx > applied and idx <= commit_index").select("node", "idx", "term", "payload")


QUORUM = ", q AS (SELECT grp, (count(*) + 1)::INT AS nodes, list_sort(list(match_index), 'DESC')[(count(*) + 1) // 2] AS quorum_index FROM raft_match GROUP BY grp)"


@query(f"{QUORUM} SELECT grp, nodes, quorum_index, greatest(commit_index, coalesce((SELECT max(idx) FROM raft_log r WHERE r.node = 1 AND r.term = l.term AND r.idx <= quorum_index), commit_index)) AS commit_index FROM q JOIN raft_leaders l USING (grp)")
def raft_quorum_commit(spark, sf):
    log = views.raft_log(spark, sf).where("node = 1")
    return raft.quorum_commit(views.raft_match(spark, sf), views.raft_leaders(spark, sf), log)


PROGRESS = """, o AS (SELECT grp, min(seq) AS gone FROM raft_responses WHERE term > leader_term GROUP BY grp),
h AS (SELECT r.* FROM raft_responses r LEFT JOIN o USING (grp) WHERE term = leader_term AND (gone IS NULL OR seq < gone)),
d AS (SELECT grp, peer, max(seq) AS seq, arg_max(match_index, seq) AS m FROM h WHERE success GROUP BY ALL)"""


@query(f"{PROGRESS} SELECT grp, peer, coalesce(any_value(m), 0) AS match_index, greatest(1, coalesce(any_value(m), 0) + 1 - count(*) FILTER (NOT success AND (d.seq IS NULL OR h.seq > d.seq))) AS next_index FROM h LEFT JOIN d USING (grp, peer) GROUP BY grp, peer")
def raft_peer_progress(spark, sf):
    return raft.peer_progress(views.raft_responses(spark, sf))


@query("SELECT seq, node, 3 + row_number() OVER (PARTITION BY node ORDER BY seq) AS term, node AS voted_for, 1 AS votes, node = 4 AS won FROM (SELECT event_id AS seq, user_id % 5 AS node FROM events WHERE event_type = 'error')")
def raft_elections(spark, sf):
    timeouts = views.table(spark, sf, "events").where("event_type = 'error'").select(F.col("event_id").alias("seq"), (F.col("user_id") % 5).alias("node"))
    cluster = spark.range(5).select(F.col("id").alias("node"), F.lit(3).cast("long").alias("term"), F.when(F.col("id") == 4, 1).otherwise(5).alias("size"))
    return raft.elections(numbered(timeouts, ["node"], ["seq"], "turn"), cluster)


@query("SELECT max_by(node, (term * 1000 - node)) AS leader, count(*) AS leaders, max(term) AS term FROM raft_nodes WHERE role = 'Leader'")
def raft_leader(spark, sf):
    return views.raft_nodes(spark, sf).where("role = 'Leader'").agg(F.max_by("node", F.struct("term", -F.col("node"))).alias("leader"), F.count("*").alias("leaders"), F.max("term").alias("term"))


@query("SELECT voter, term, count(*) AS requests, sum(count(*)) OVER (PARTITION BY voter ORDER BY term)::BIGINT AS so_far FROM raft_votes GROUP BY voter, term")
def raft_terms(spark, sf):
    each = views.raft_votes(spark, sf).groupBy("voter", "term").agg(F.count("*").alias("requests"))
    return each.withColumn("so_far", F.sum("requests").over(Window.partitionBy("voter").orderBy("term")))


GRANTED = "SELECT voter, term, seq, candidate, last_term, last_index FROM raft_votes WHERE last_term > own_term OR (last_term = own_term AND last_index >= own_index) QUALIFY row_number() OVER (PARTITION BY voter, term ORDER BY seq) = 1"


@query(GRANTED)
def raft_vote_grant(spark, sf):
    return raft.votes_granted(views.raft_votes(spark, sf))


TALLY = f", g AS ({GRANTED}), t AS (SELECT term, candidate, count(DISTINCT voter) AS votes FROM g GROUP BY term, candidate)"


@query(f"{TALLY} SELECT term, candidate, votes, votes >= 3 AS won FROM t")
def raft_vote_tally(spark, sf):
    return raft.vote_tally(raft.votes_granted(views.raft_votes(spark, sf)), 5)


@query("SELECT voter, seq, CASE WHEN lag(last_term) OVER w IS NULL THEN true ELSE (last_term, last_index) >= (lag(last_term) OVER w, lag(last_index) OVER w) END AS up_to_date FROM raft_votes WINDOW w AS (PARTITION BY voter ORDER BY seq)")
def raft_log_up_to_date(spark, sf):
    votes = lagged(views.raft_votes(spark, sf).select("voter", "seq", "last_term", "last_index"), ["voter"], ["seq"], ["last_term", "last_index"])
    lt, li = F.col("before_last_term"), F.col("before_last_index")
    return votes.select("voter", "seq", F.coalesce((F.col("last_term") > lt) | ((F.col("last_term") == lt) & (F.col("last_index") >= li)), F.lit(True)).alias("up_to_date"))


@query("""SELECT b.node, b.idx, p.idx IS NOT NULL AS accepted FROM raft_log b LEFT JOIN (SELECT idx, term FROM raft_log WHERE node = 1) p ON p.idx = b.idx - 1 AND p.term = (b.idx - 1) // 100 + 1 WHERE b.node = 3""")
def raft_append_check(spark, sf):
    log = views.raft_log(spark, sf)
    local = log.where("node = 1").select((F.col("idx") + 1).alias("idx"), F.col("term").alias("prev_term"), F.lit(True).alias("has"))
    asked = log.where("node = 3").select("node", "idx", (F.floor((F.col("idx") - 1) / 100) + 1).cast("long").alias("prev_term"))
    return asked.join(local, ["idx", "prev_term"], "left").select("node", "idx", F.col("has").isNotNull().alias("accepted"))


@query(""", l AS (SELECT idx, term, payload FROM raft_log WHERE node = 3), i AS (SELECT idx, term, payload FROM raft_log WHERE node = 1), c AS (SELECT min(l.idx) AS cut FROM l JOIN i USING (idx) WHERE l.term <> i.term)
SELECT idx, term, payload FROM l, c WHERE cut IS NULL OR idx < cut UNION ALL SELECT idx, term, payload FROM i, c WHERE idx >= cut""")
def raft_conflict(spark, sf):
    log = views.raft_log(spark, sf)
    return raft.conflict(log.where("node = 3").drop("node"), log.where("node = 1").drop("node"))


@query("SELECT DISTINCT idx, term, payload FROM raft_log")
def raft_dedup(spark, sf):
    return views.raft_log(spark, sf).select("idx", "term", "payload").dropDuplicates()


@query("""SELECT w.idx, w.term, r.idx IS NOT NULL AS answered FROM (SELECT idx, term FROM raft_log WHERE node = 3) w
LEFT JOIN (SELECT l.idx, l.term FROM raft_log l JOIN raft_nodes n ON n.node = l.node WHERE l.node = 1 AND l.idx <= n.commit_index) r ON r.idx = w.idx AND r.term = w.term""")
def raft_ack_join(spark, sf):
    log = views.raft_log(spark, sf)
    done = log.where("node = 1").join(F.broadcast(views.raft_nodes(spark, sf).select("node", "commit_index")), "node").where("idx <= commit_index").select("idx", "term", F.lit(True).alias("done"))
    return log.where("node = 3").select("idx", "term").join(done, ["idx", "term"], "left").select("idx", "term", F.col("done").isNotNull().alias("answered"))


@query("SELECT grp, peer, match_index, max(match_index) OVER (PARTITION BY grp) - match_index AS lag FROM raft_match")
def raft_replication_lag(spark, sf):
    return views.raft_match(spark, sf).withColumn("lag", F.max("match_index").over(Window.partitionBy("grp")) - F.col("match_index"))


@query("SELECT node, count(*) AS stale FROM raft_log l JOIN (SELECT node, term AS now FROM raft_nodes) n USING (node) WHERE l.term < now GROUP BY node")
def raft_stale_msgs(spark, sf):
    now = F.broadcast(views.raft_nodes(spark, sf).select("node", F.col("term").alias("now")))
    return views.raft_log(spark, sf).join(now, "node").where("term < now").groupBy("node").agg(F.count("*").alias("stale"))


@query("""SELECT peer, idx FROM (SELECT * FROM (SELECT idx, kind, peer FROM membership UNION ALL SELECT -1, 'Add', n_nationkey FROM nation) QUALIFY row_number() OVER (PARTITION BY peer ORDER BY idx DESC) = 1) WHERE kind = 'Add'""")
def membership_replay(spark, sf):
    return raft.members(views.membership(spark, sf), views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("peer")))


@query("SELECT term, count(DISTINCT node) AS leaders FROM raft_roles WHERE role = 'Leader' GROUP BY term HAVING count(DISTINCT node) > 1")
def inv_election_safety(spark, sf):
    return raft.election_safety(views.raft_roles(spark, sf))


PAIRS = "raft_log a JOIN raft_log b ON a.idx = b.idx AND a.node < b.node"


@query(f"SELECT a.node AS node_a, b.node AS node_b, min(a.idx) FILTER (a.term <> b.term) AS first_difference, max(a.idx) FILTER (a.term = b.term) AS last_agreement FROM {PAIRS} GROUP BY a.node, b.node HAVING min(a.idx) FILTER (a.term <> b.term) < max(a.idx) FILTER (a.term = b.term)")
def inv_log_matching(spark, sf):
    return raft.log_matching(views.raft_log(spark, sf))


@query(f"SELECT a.node AS node_a, b.node AS node_b, a.idx FROM {PAIRS} JOIN raft_nodes na ON na.node = a.node JOIN raft_nodes nb ON nb.node = b.node WHERE a.payload IS DISTINCT FROM b.payload AND a.idx <= least(na.commit_index, nb.commit_index)")
def inv_state_safety(spark, sf):
    return raft.state_safety(views.raft_log(spark, sf), views.raft_nodes(spark, sf))


@query("SELECT key, count(DISTINCT node) AS nodes, count(DISTINCT payload) AS variants FROM (SELECT idx AS key, node, payload FROM raft_log) GROUP BY key HAVING count(DISTINCT payload) > 1")
def replica_divergence(spark, sf):
    return raft.divergence(views.raft_log(spark, sf).select(F.col("idx").alias("key"), "node", F.col("payload").alias("value")))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'signup') THEN 'read' WHEN user_id % 3 = 0 THEN 'accepted' WHEN user_id % 7 = 0 THEN 'Node ' || (user_id % 3) || ' is not leader and no leader is currently known'
  ELSE 'Not leader; current leader is Node ' || (user_id % 5) END AS outcome FROM events""")
def write_outcome(spark, sf):
    e, user = views.table(spark, sf, "events"), F.col("user_id")
    none = F.concat(F.lit("Node "), (user % 3).cast("string"), F.lit(" is not leader and no leader is currently known"))
    hint = F.concat(F.lit("Not leader; current leader is Node "), (user % 5).cast("string"))
    return e.select("event_id", F.when(F.col("event_type").isin("view", "signup"), "read").when(user % 3 == 0, "accepted").when(user % 7 == 0, none).otherwise(hint).alias("outcome"))


@query("""SELECT event_id, CASE op WHEN 'Set' THEN 1 WHEN 'Delete' THEN 2 END AS command, CASE WHEN op IN ('Set', 'Delete') THEN 'u' || user_id END AS key, CASE WHEN op = 'Set' THEN value::VARCHAR END AS value
FROM (SELECT *, CASE event_type WHEN 'click' THEN 'Set' WHEN 'purchase' THEN 'Set' WHEN 'error' THEN 'Delete' WHEN 'view' THEN 'Get' ELSE 'Status' END AS op FROM events)""")
def store_command(spark, sf):
    kind = F.col("event_type")
    op = F.when(kind.isin("click", "purchase"), "Set").when(kind == "error", "Delete").when(kind == "view", "Get").otherwise("Status")
    asked = views.table(spark, sf, "events").select("event_id", op.alias("op"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("value").cast("string").alias("value"))
    command, key, value = text.store_command("op", "key", "value")
    return asked.select("event_id", command.alias("command"), key.alias("key"), value.alias("value"))


# Event streams


@query("SELECT sequence, src, dst, us, row_number() OVER (PARTITION BY dst ORDER BY us, sequence) AS turn FROM sim_events")
def sim_event_order(spark, sf):
    return numbered(views.sim_events(spark, sf), ["dst"], ["us", "sequence"], "turn")


@query("SELECT src, dst, us, row_number() OVER (PARTITION BY src, dst ORDER BY us, sequence) AS link_sequence FROM sim_events")
def event_sequence(spark, sf):
    return numbered(views.sim_events(spark, sf), ["src", "dst"], ["us", "sequence"], "link_sequence").drop("sequence")


LINKS = [(1, 2, 3, 50_000), (0, 4, 10, 1_000_000), (3, 3, 1, 7)]
LINKS_SQL = ", f(src, dst, n, delay_us) AS (VALUES (1::BIGINT, 2::BIGINT, 3, 50000), (0, 4, 10, 1000000), (3, 3, 1, 7))"


def _links(spark):
    return small(spark, "src long, dst long, n int, delay_us long", *LINKS)


@query("SELECT sequence AS trigger_sequence, us, row_number() OVER (PARTITION BY src ORDER BY us, sequence) AS turn FROM sim_events WHERE us <= (SELECT min(us) + 86400000000 FROM sim_events)")
def sim_due_faults(spark, sf):
    e = views.sim_events(spark, sf)
    now = e.agg((F.min("us") + 86_400_000_000).alias("now"))
    due = e.crossJoin(F.broadcast(now)).where("us <= now")
    return numbered(due.select("src", F.col("sequence").alias("trigger_sequence"), "us"), ["src"], ["us", "trigger_sequence"], "turn").drop("src")


@query("SELECT * FROM sim_events WHERE src <> 2 AND dst <> 2 AND NOT (src = 0 AND dst = 1) AND NOT (src = 1 AND dst = 0)")
def sim_deliverable(spark, sf):
    return sim.deliverable(views.sim_events(spark, sf), small(spark, "node long", (2,)), small(spark, "src long, dst long", (0, 1), (1, 0)))


@query(f"{LINKS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY sequence) AS k FROM sim_events) SELECT x.sequence, x.src, x.dst, x.us FROM x LEFT JOIN f ON f.src = x.src AND f.dst = x.dst WHERE n IS NULL OR k > n")
def sim_drop(spark, sf):
    return sim.drop_next(views.sim_events(spark, sf), _links(spark).select("src", "dst", "n"))


@query(f"{LINKS_SQL} SELECT sequence, src, dst, us + coalesce(delay_us, 0) AS us FROM sim_events LEFT JOIN f USING (src, dst)")
def sim_delay(spark, sf):
    return sim.delay(views.sim_events(spark, sf), _links(spark).select("src", "dst", "delay_us"))


@query(f"""{LINKS_SQL}, x AS (SELECT e.*, n, row_number() OVER (PARTITION BY src, dst ORDER BY sequence) AS k FROM sim_events e LEFT JOIN f USING (src, dst))
SELECT sequence, src, dst, us, 0::INT AS "copy" FROM x UNION ALL SELECT sequence, src, dst, us + 10000, 1 FROM x WHERE k <= n""")
def sim_duplicate(spark, sf):
    return sim.duplicate_next(views.sim_events(spark, sf), _links(spark).select("src", "dst", "n"), 10_000)


@query(", p AS (SELECT dst, min(us) + 3600000000 AS a, min(us) + 7200000000 AS b FROM sim_events WHERE dst IN (1, 3) GROUP BY dst) SELECT sequence, e.src, e.dst, greatest(us, coalesce(b, us)) AS us FROM sim_events e LEFT JOIN p ON p.dst = e.dst AND us >= a AND us < b")
def sim_pause(spark, sf):
    e = views.sim_events(spark, sf)
    pauses = e.where("dst in (1, 3)").groupBy("dst").agg((F.min("us") + 3_600_000_000).alias("from_us"), (F.min("us") + 7_200_000_000).alias("to_us"))
    return sim.pause(e, pauses)


@query(", a AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1), b AS (SELECT n_nationkey AS k FROM nation WHERE n_regionkey <> 1) SELECT a.k AS src, b.k AS dst FROM a, b UNION ALL SELECT b.k, a.k FROM a, b")
def partition_links(spark, sf):
    return sim.partition_links(views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("node"), "n_regionkey"), "n_regionkey = 1")


@query("SELECT * FROM (SELECT src, sequence, us, us - lag(us) OVER (PARTITION BY src ORDER BY us, sequence) AS gap_us FROM sim_events) WHERE gap_us > 1800000000")
def timeout_gaps(spark, sf):
    return raft.timeout_gaps(views.sim_events(spark, sf).select("src", "sequence", "us"), ["src"], 1_800_000_000)


FAULTS = [("crash", 0.05), ("restart", 0.10), ("partition", 0.08), ("heal", 0.15), ("drop", 0.05), ("delay", 0.10)]


@query("SELECT seq, CASE WHEN r < 0.05 THEN 'crash' WHEN r < 0.05 + 0.10 THEN 'restart' WHEN r < 0.05 + 0.10 + 0.08 THEN 'partition' WHEN r < 0.05 + 0.10 + 0.08 + 0.15 THEN 'heal' WHEN r < 0.05 + 0.10 + 0.08 + 0.15 + 0.05 THEN 'drop' WHEN r < 0.05 + 0.10 + 0.08 + 0.15 + 0.05 + 0.10 THEN 'delay' END AS fault FROM (SELECT event_id AS seq, (event_id * 7919 % 1009) / 1009.0::DOUBLE AS r FROM events)")
def fault_roll(spark, sf):
    rolls = views.table(spark, sf, "events").select(F.col("event_id").alias("seq"), ((F.col("event_id") * 7919 % 1009) / F.lit(1009.0)).alias("r"))
    return rolls.select("seq", sim.fault_of("r", FAULTS).alias("fault"))


MASK = "18446744073709551616::UHUGEINT"


@query(f""", z0 AS (SELECT event_id, ((42 + (event_id + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % {MASK}) AS z FROM events),
z1 AS (SELECT event_id, (xor(z, z // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {MASK} AS z FROM z0), z2 AS (SELECT event_id, (xor(z, z // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {MASK} AS z FROM z1), z3 AS (SELECT event_id, xor(z, z // 2147483648::UHUGEINT) AS z FROM z2)
SELECT event_id, z::DECIMAL(20, 0) AS draw, (z // 2048::UHUGEINT)::DOUBLE / 9007199254740992 AS unit FROM z3""")
def splitmix(spark, sf):
    at = views.table(spark, sf, "events").select("event_id", F.lit(42).cast("long").alias("seed"), (F.col("event_id") + 1).alias("n"))
    return at.select("event_id", next_u64("seed", "n").alias("draw"), next_f64("seed", "n").alias("unit"))


# Metrics

ROUTE = "CASE WHEN path LIKE '/kv/%' THEN '/kv/{key}' WHEN path = '/health/nodes' THEN path WHEN path LIKE '/health/node/%' THEN '/health/node/{id}' WHEN path IN ('/status', '/metrics') THEN path WHEN path LIKE '/errors/recent%' THEN '/errors/recent' WHEN path IN ('/diagnose', '/recovery/recommend') THEN path ELSE 'unmatched' END"
BOUNDS = ", ".join(f"({b}::DOUBLE)" for b in metrics.BUCKETS)
HISTOGRAM = f", r AS (SELECT method, {ROUTE} AS route, duration_s FROM http_log), h AS (SELECT method, route, le, count(*) FILTER (duration_s <= le) AS cnt FROM r, (SELECT * FROM (VALUES {BOUNDS}, ('inf'::DOUBLE)) b(le)) GROUP BY ALL)"


def routed(spark, sf):
    return views.http_log(spark, sf).withColumn("route", text.route("path"))


@query(f"SELECT event_id, path, {ROUTE} AS route FROM http_log")
def route_normalize(spark, sf):
    return routed(spark, sf).select("event_id", "path", "route")


@query(f"SELECT method, {ROUTE} AS route, status, count(*) AS requests FROM http_log GROUP BY ALL")
def http_counters(spark, sf):
    return routed(spark, sf).groupBy("method", "route", "status").agg(F.count("*").alias("requests"))


@query(f"{HISTOGRAM} SELECT method, route, le, cnt FROM h")
def http_histogram(spark, sf):
    return metrics.histogram(routed(spark, sf), ["method", "route"])


@query(f"{HISTOGRAM} SELECT route, le, sum(cnt)::BIGINT AS cnt FROM h GROUP BY route, le")
def histogram_merge(spark, sf):
    return metrics.merge_histograms(metrics.histogram(routed(spark, sf), ["method", "route"]), ["route"])


QUANTILE = """, m AS (SELECT {by} le, sum(cnt)::BIGINT AS cnt FROM h GROUP BY ALL), w AS (SELECT *, lag(le, 1, 0.0) OVER (PARTITION BY {part} ORDER BY le) AS before, lag(cnt, 1, 0) OVER (PARTITION BY {part} ORDER BY le) AS below, max(cnt) OVER (PARTITION BY {part}) AS total FROM m),
f AS (SELECT * FROM w WHERE cnt >= {q} * total QUALIFY row_number() OVER (PARTITION BY {part} ORDER BY le) = 1)
SELECT {by} round(CASE WHEN total = 0 THEN 0.0 WHEN le = 'inf'::DOUBLE THEN before WHEN cnt = below THEN le ELSE before + ({q} * total - below) / (cnt - below) * (le - before) END, 9) AS quantile FROM f"""


@query(HISTOGRAM + QUANTILE.format(by="route,", part="route", q="0.95"))
def histogram_quantile(spark, sf):
    merged = metrics.merge_histograms(metrics.histogram(routed(spark, sf), ["method", "route"]), ["route"])
    return metrics.quantile(merged, 0.95, ["route"]).withColumn("quantile", F.round("quantile", 9))


@query(""", n AS (SELECT method, round(duration_s * 100, 2) AS d FROM http_log), o AS (SELECT method, d, row_number() OVER (PARTITION BY method ORDER BY d) - 1 AS k, count(*) OVER (PARTITION BY method) AS n FROM n)
SELECT method, any_value(n) AS n, min(d) FILTER (k = least(floor(n * 0.5), n - 1)) AS p50, min(d) FILTER (k = least(floor(n * 0.95), n - 1)) AS p95, min(d) FILTER (k = least(floor(n * 0.99), n - 1)) AS p99, min(d) AS "min", max(d) AS "max" FROM o GROUP BY method""")
def latency_stats(spark, sf):
    return metrics.nearest_rank(views.http_log(spark, sf).withColumn("d", F.round(F.col("duration_s") * 100, 2)), ["method"], "d", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query(f"SELECT {ROUTE} AS route, count(*) AS requests, round(avg(duration_s) * 1000, 4) AS avg_ms, round(100.0 * count(*) FILTER (status BETWEEN 200 AND 299) / count(*), 6) AS success_pct FROM http_log GROUP BY ALL")
def latency_avg(spark, sf):
    ok = F.count_if(F.col("status").between(200, 299))
    return routed(spark, sf).groupBy("route").agg(F.count("*").alias("requests"), F.round(F.avg("duration_s") * 1000, 4).alias("avg_ms"), F.round(100.0 * ok / F.count("*"), 6).alias("success_pct"))


@query("SELECT CASE WHEN status BETWEEN 200 AND 299 THEN '2xx' WHEN status BETWEEN 400 AND 499 THEN '4xx' WHEN status BETWEEN 500 AND 599 THEN '5xx' ELSE 'other' END AS class, count(*) AS requests FROM http_log GROUP BY ALL")
def status_classes(spark, sf):
    return views.http_log(spark, sf).groupBy(metrics.status_class("status").alias("class")).agg(F.count("*").alias("requests"))


@query(f"SELECT method || ' ' || {ROUTE} AS route, count(*) AS requests, round(100.0 * count(*) / (SELECT count(*) FROM http_log), 6) AS pct FROM http_log GROUP BY ALL")
def route_share(spark, sf):
    each = routed(spark, sf).groupBy(F.concat_ws(" ", "method", "route").alias("route")).agg(F.count("*").alias("requests"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("requests").alias("total")))).select("route", "requests", F.round(100.0 * F.col("requests") / F.col("total"), 6).alias("pct"))


@query(f", r AS (SELECT method, {ROUTE} AS route, status, count(*) AS n FROM http_log GROUP BY ALL) SELECT 'api_requests_total' AS name, method, route, status::VARCHAR AS status, n::DOUBLE AS value FROM r")
def prom_parse(spark, sf):
    c = http_counters(spark, sf)
    line = F.format_string('api_requests_total{method="%s",route="%s",status="%d"} %d', "method", "route", "status", "requests")
    lines = c.select(line.alias("value")).union(spark.createDataFrame([("# TYPE api_requests_total counter",), ("",), ("broken line {",), ("api_requests_total NaN",)], "value string"))
    got = metrics.parse_metrics(lines)
    return got.select("name", *[F.col("labels")[k].alias(k) for k in ("method", "route", "status")], "value")


@query(""", c AS (SELECT method, us, count(*) OVER (PARTITION BY method ORDER BY us, event_id) AS cnt, event_id FROM http_log), s AS (SELECT *, CASE WHEN lag(cnt) OVER w IS NULL THEN 0 ELSE 1 END AS step FROM c WINDOW w AS (PARTITION BY method ORDER BY us))
SELECT method, us, cnt, round(sum(step) OVER (PARTITION BY method ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) / 3600.0, 9) AS rate FROM s""")
def prom_rate(spark, sf):
    c = numbered(views.http_log(spark, sf).select("method", "us", "event_id"), ["method"], ["us", "event_id"], "cnt").drop("event_id")
    return metrics.rate(c, ["method"], 3_600_000_000).withColumn("rate", F.round("rate", 9))


HOUR = 3_600_000_000
RATES = f""", r AS (SELECT method, {ROUTE} AS route, us // {HOUR} AS hour, duration_s FROM http_log),
h AS (SELECT method, route, hour, le, count(*) FILTER (duration_s <= le) AS inc FROM r, (SELECT * FROM (VALUES {BOUNDS}, ('inf'::DOUBLE)) b(le)) GROUP BY ALL),
c AS (SELECT *, sum(inc) OVER (PARTITION BY method, route, le ORDER BY hour) AS cnt, row_number() OVER (PARTITION BY method, route, le ORDER BY hour) AS nth FROM h),
i AS (SELECT method, route, le, sum(inc) FILTER (nth > 1 AND hour > (SELECT max(hour) FROM r) - 24) AS inc FROM c GROUP BY ALL),
m AS (SELECT route, le, round(sum(coalesce(inc, 0)) / 86400.0, 12) AS cnt FROM i GROUP BY ALL)"""


@query(RATES + QUANTILE.format(by="route,", part="route", q="0.99").replace(", m AS (SELECT route, le, sum(cnt)::BIGINT AS cnt FROM h GROUP BY ALL)", ""))
def prom_rate_quantile(spark, sf):
    """The 0.99 quantile of the buckets' rates over the last day, of counters that are read once an hour."""
    requests = routed(spark, sf).withColumn("hour", F.floor(F.col("us") / HOUR).cast("long"))
    hourly = metrics.histogram(requests, ["method", "route", "hour"])
    now = requests.agg(F.max("hour").alias("now"))  # one row
    grown = metrics.last_increase(metrics.counters(hourly, ["method", "route", "le"], "hour"), now, ["method", "route", "le"], "hour", 24)
    merged = grown.groupBy("route", "le").agg(F.round(F.sum("increase") / 86_400, 12).alias("cnt"))
    return metrics.quantile(merged, 0.99, ["route"]).withColumn("quantile", F.round("quantile", 9))


@query("SELECT user_id % 8 AS worker, method, count(*) AS ops FROM http_log JOIN (SELECT event_id, user_id FROM events) USING (event_id) GROUP BY ALL")
def op_mix(spark, sf):
    e = views.table(spark, sf, "events")
    kind = F.col("event_type")
    return e.select((F.col("user_id") % 8).alias("worker"), F.when(kind == "click", "PUT").when(kind == "error", "DELETE").otherwise("GET").alias("method")).groupBy("worker", "method").agg(F.count("*").alias("ops"))


@query(", b AS (SELECT throughput AS base FROM experiments ORDER BY name LIMIT 1) SELECT name, n, round(throughput, 6) AS throughput, round(CASE WHEN base = 0 THEN 0 ELSE (throughput / base - 1) * 100 END, 6) AS pct FROM experiments, b")
def pct_vs_baseline(spark, sf):
    e = views.experiments(spark, sf)
    base = e.agg(F.min_by("throughput", "name").alias("base"))
    return e.crossJoin(F.broadcast(base)).select("name", "n", F.round("throughput", 6).alias("throughput"), F.round(values.percent_change(F.col("throughput"), F.col("base")), 6).alias("pct"))


# Health


@query("SELECT cluster, bool_and(healthy) AS success, count(*) AS cluster_size, count(*) FILTER (healthy) AS healthy_nodes, count(*) FILTER (healthy) || '/' || count(*) || ' nodes responding healthily' AS message FROM node_health GROUP BY cluster")
def health_rollup(spark, sf):
    return health.rollup(views.node_health(spark, sf))


DIAGNOSE = """, d AS (SELECT cluster, count(*) AS cluster_size, count(*) FILTER (healthy) AS healthy_nodes, count(*) FILTER (reachable) AS reachable_nodes, arg_max(leader_id, node_id) FILTER (healthy AND leader_id IS NOT NULL) AS leader_id, coalesce(max(term) FILTER (healthy), 0) AS term, count(*) FILTER (NOT healthy OR NOT reachable) AS issues FROM node_health GROUP BY cluster),
x AS (SELECT *, healthy_nodes > cluster_size // 2 AS success, healthy_nodes || '/' || cluster_size || ' nodes healthy, ' || reachable_nodes || '/' || cluster_size || ' reachable' AS s FROM d)"""


@query(f"{DIAGNOSE} SELECT * EXCLUDE s, CASE WHEN success THEN s ELSE 'DEGRADED: ' || s || ' - quorum may be lost' END AS message FROM x")
def diagnose(spark, sf):
    return health.diagnose(views.node_health(spark, sf))


@query("SELECT cluster, node_id, address, message, row_number() OVER (PARTITION BY cluster ORDER BY node_id) AS place FROM node_health WHERE NOT healthy QUALIFY place <= 5")
def health_errors(spark, sf):
    w = Window.partitionBy("cluster").orderBy("node_id")
    return views.node_health(spark, sf).where("not healthy").select("cluster", "node_id", "address", "message", F.row_number().over(w).alias("place")).where("place <= 5")


@query("""SELECT o_orderkey AS request, (row_number() OVER (PARTITION BY o_orderkey ORDER BY node_id <> o_custkey % 10, node_id) - 1)::INT AS attempt, node_id FROM orders JOIN node_health ON cluster = o_orderkey % 25""")
def leader_lookup(spark, sf):
    requests = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") % 25).alias("cluster"), (F.col("o_custkey") % 10).alias("hint"))
    return health.candidates(requests, views.node_health(spark, sf))


SUMMARY = "CASE event_id % 9 WHEN 0 THEN 'Leader lost on node ' || user_id WHEN 1 THEN 'Quorum missing' WHEN 2 THEN 'a network SPLIT' WHEN 3 THEN 'requests TIMEOUT often' WHEN 4 THEN 'the leader is slow' WHEN 5 THEN 'Election without a leader' WHEN 6 THEN 'majority unavailable' WHEN 7 THEN 'disk full' ELSE event_type END"
CLASS = """CASE WHEN contains(t, 'leader') AND (contains(t, 'lost') OR contains(t, 'no leader') OR contains(t, 'election')) THEN 'Leader loss / election failure' WHEN contains(t, 'quorum') OR contains(t, 'majority') OR contains(t, 'unavailable') THEN 'Quorum loss / majority of nodes down'
 WHEN contains(t, 'network') OR contains(t, 'partition') OR contains(t, 'split') THEN 'Network partition' WHEN contains(t, 'slow') OR contains(t, 'latency') OR contains(t, 'timeout') THEN 'High latency / timeouts' ELSE 'General cluster issue' END"""


@query(f"SELECT event_id, summary, {CLASS} AS diagnosis, CASE {' '.join(f'WHEN {CLASS} = {chr(39)}{k}{chr(39)} THEN {chr(39)}{v[0]}{chr(39)}' for k, v in text.STEPS.items())} END AS first_step FROM (SELECT event_id, {SUMMARY} AS summary, lower({SUMMARY}) AS t FROM events)")
def recovery_classify(spark, sf):
    e, k = views.table(spark, sf, "events"), F.col("event_id") % 9
    s = F.when(k == 0, F.concat(F.lit("Leader lost on node "), F.col("user_id").cast("string")))
    for i, words in enumerate(["Quorum missing", "a network SPLIT", "requests TIMEOUT often", "the leader is slow", "Election without a leader", "majority unavailable", "disk full"], 1):
        s = s.when(k == i, words)
    got = e.select("event_id", s.otherwise(F.col("event_type")).alias("summary")).withColumn("diagnosis", text.classify_failure("summary"))
    return got.withColumn("steps", text.steps_for("diagnosis")).select("event_id", "summary", "diagnosis", F.col("steps")[0]["action"].alias("first_step"))


@query(f"{DIAGNOSE} SELECT cluster, CASE WHEN issues = 0 THEN 'Cluster healthy' ELSE 'Node health issue detected' END AS diagnosis, CASE WHEN issues = 0 THEN healthy_nodes || '/' || cluster_size || ' nodes healthy; no node-failure recovery is indicated.' ELSE issues || ' node(s) are unreachable or unhealthy.' END AS message FROM x")
def recovery_advise(spark, sf):
    return health.advise(health.diagnose(views.node_health(spark, sf)))


@query("SELECT event_id, CASE WHEN user_id % 4 = 0 THEN 200 WHEN user_id % 3 = 0 THEN CASE WHEN value > 50 THEN 504 ELSE 409 END ELSE 502 END AS status FROM events")
def http_status(spark, sf):
    e = views.table(spark, sf, "events").select("event_id", (F.col("user_id") % 4 == 0).alias("success"), (F.col("user_id") % 3 == 0).alias("replied"), (F.col("value") > 50).alias("late"))
    return e.select("event_id", text.http_status("success", "replied", "late").alias("status"))


# Parsing and scalars

RAW = "CASE event_id % 6 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '-' || value WHEN 2 THEN props WHEN 3 THEN '99999999999999999999' WHEN 4 THEN '1e' || (event_id % 9) ELSE ' ' || event_type END"


def _raw(spark, sf):
    e, k = views.table(spark, sf, "events"), F.col("event_id") % 6
    return e.select("event_id", F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.concat(F.lit("-"), F.col("value").cast("string"))).when(k == 2, F.col("props")).when(k == 3, "99999999999999999999").when(k == 4, F.concat(F.lit("1e"), (F.col("event_id") % 9).cast("string"))).otherwise(F.concat(F.lit(" "), "event_type")).alias("raw"))


@query(f"SELECT event_id, raw, CASE WHEN regexp_full_match(raw, '[+-]?\\d+') AND try_cast(raw AS BIGINT) IS NOT NULL THEN 'int' WHEN regexp_full_match(raw, '[+-]?(\\d+\\.?\\d*(e\\d+)?)') THEN 'float' ELSE 'string' END AS type FROM (SELECT event_id, {RAW} AS raw FROM events)")
def infer_type(spark, sf):
    return _raw(spark, sf).withColumn("type", values.infer_type("raw"))


@query(f"""SELECT event_id, CASE tag WHEN 'string' THEN CASE WHEN raw LIKE '"%"' THEN NULL ELSE 'string values must be JSON strings' END WHEN 'int' THEN CASE WHEN regexp_full_match(raw, '-?(0|[1-9]\\d*)') AND try_cast(raw AS BIGINT) IS NOT NULL THEN NULL ELSE 'int values must be 64-bit integers' END
 WHEN 'float' THEN CASE WHEN regexp_full_match(raw, '-?(0|[1-9]\\d*)(\\.\\d+)?(e\\d+)?') THEN NULL ELSE 'float values must be numbers' END ELSE 'type must be string, int, or float' END AS error FROM (SELECT event_id, {RAW} AS raw, CASE event_id % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'int' WHEN 2 THEN 'float' ELSE 'blob' END AS tag FROM events)""")
def validate_values(spark, sf):
    k = F.col("event_id") % 4
    tagged = _raw(spark, sf).withColumn("tag", F.when(k == 0, "string").when(k == 1, "int").when(k == 2, "float").otherwise("blob"))
    return tagged.select("event_id", values.value_error("tag", "raw").alias("error"))


@query("SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'expected a key at /kv/{key}' WHEN 1 THEN 'expected a key at /kv/{key}' END AS error FROM events")
def validate_keys(spark, sf):
    e, k = views.table(spark, sf, "events"), F.col("event_id") % 7
    key = F.when(k == 0, F.lit("")).when(k == 1, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/x"))).otherwise(F.concat(F.lit("u"), F.col("user_id").cast("string")))
    return e.select("event_id", key.alias("key")).select("event_id", values.key_error("key").alias("error"))


@query("SELECT node_id, address, CASE WHEN node_id % 5 = 0 THEN false ELSE true END AS ok FROM (SELECT node_id, CASE WHEN node_id % 5 = 0 THEN replace(address, ':', ':7') || '99' ELSE address END AS address FROM node_health)")
def addr_validate(spark, sf):
    bad = F.when(F.col("node_id") % 5 == 0, F.concat(F.replace("address", F.lit(":"), F.lit(":7")), F.lit("99"))).otherwise(F.col("address"))
    return views.node_health(spark, sf).select("node_id", bad.alias("address")).withColumn("ok", text.address_ok("address"))


@query("SELECT node_id, CASE WHEN node_id % 6 = 0 THEN 'api:1' WHEN node_id % 6 = 1 THEN NULL WHEN node_id % 6 = 2 THEN 'node' || node_id || ':' || (7000 + node_id % 1000) ELSE 'node' || node_id || ':' || (7000 + node_id % 1000) END AS api FROM node_health")
def api_address(spark, sf):
    k = F.col("node_id") % 6
    given = views.node_health(spark, sf).select("node_id", F.when(k == 1, F.concat(F.lit("node"), F.col("node_id").cast("string"), F.lit(":9000"))).when(k == 2, F.replace("address", F.lit(":6"), F.lit(":7"))).otherwise(F.col("address")).alias("address"), F.when(k == 0, " api:1 ").alias("explicit"))
    return given.select("node_id", text.api_address("address", "explicit").alias("api"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'get' WHEN 2 THEN 'delete' WHEN 3 THEN 'usage' ELSE 'unknown' END AS verb, CASE WHEN event_id % 5 < 3 THEN 'u' || user_id END AS key, CASE WHEN event_id % 5 = 0 THEN event_type || ' ' || value END AS value FROM events")
def cli_parse(spark, sf):
    e, k = views.table(spark, sf, "events"), F.col("event_id") % 5
    user = F.col("user_id").cast("string")
    line = F.when(k == 0, F.concat(F.lit("  SET u"), user, F.lit("  "), "event_type", F.lit("   "), F.col("value").cast("string"), F.lit(" "))).when(k == 1, F.concat(F.lit("Get u"), user)).when(k == 2, F.concat(F.lit("del u"), user)).when(k == 3, F.lit("get")).otherwise(F.lit("frob x"))
    verb, key, value = text.command("line")
    return e.select("event_id", line.alias("line")).select("event_id", verb.alias("verb"), key.alias("key"), value.alias("value"))


PEERS = "(SELECT s_nationkey AS cluster, s_suppkey AS id, 'node' || s_suppkey || ':' || (6000 + s_suppkey % 1000) AS addr FROM supplier WHERE s_suppkey % 4 <> 3)"


@query(f"SELECT * FROM {PEERS}")
def peer_parse(spark, sf):
    k = F.col("node_id")
    item = F.when(k % 4 == 3, F.lit("bad")).otherwise(F.concat(k.cast("string"), F.lit(":"), "address"))
    lists = views.node_health(spark, sf).groupBy("cluster").agg(F.array_join(F.collect_list(item), ",").alias("peers"))
    return lists.select("cluster", F.explode(F.split("peers", ",")).alias("p")).select("cluster", F.split("p", ":", 2).alias("x")).where(F.size("x") == 2).select("cluster", F.col("x")[0].try_cast("long").alias("id"), F.col("x")[1].alias("addr")).where("id is not null")


@query("SELECT DISTINCT peer FROM (SELECT user_id % 50 AS peer FROM events WHERE event_type = 'signup' UNION ALL SELECT n_nationkey FROM nation) WHERE peer <> 7")
def peer_union(spark, sf):
    found = views.membership(spark, sf).where("kind = 'Add'").select("peer")
    return found.union(views.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long"))).distinct().where("peer <> 7")


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS op, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'u' || user_id END AS key, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_id % 7 <> 0 AS ok FROM events")
def request_parse(spark, sf):
    e = views.table(spark, sf, "events")
    good = F.to_json(F.struct(F.col("event_type").alias("op"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.struct(F.lit("float").alias("type"), F.col("value").alias("value")).alias("value")))
    lines = e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(good).alias("line"))
    got = lines.select("event_id", F.from_json("line", "op string, key string, value struct<type:string,value:double>").alias("r"))
    return got.select("event_id", F.col("r.op").alias("op"), F.col("r.key").alias("key"), F.col("r.value.value").alias("value"), F.coalesce(F.col("r.op").isNotNull(), F.lit(False)).alias("ok"))


@query("SELECT event_id, CASE event_id % 4 WHEN 3 THEN 'raw' ELSE event_type END AS content FROM events")
def json_unwrap(spark, sf):
    k = F.col("event_id") % 4
    kind = F.col("event_type")
    boxed = F.when(k == 0, F.to_json(F.struct(F.struct(kind.alias("v")).alias("structuredContent")))).when(k == 1, F.to_json(F.struct(F.struct(kind.alias("v")).alias("data")))).when(k == 2, F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), F.to_json(F.struct(kind.alias("v"))).alias("text"))).alias("content")))).otherwise(F.lit('{"v": "raw"}'))
    e = views.table(spark, sf, "events").select("event_id", boxed.alias("j"))
    inner = F.coalesce(F.get_json_object("j", "$.structuredContent"), F.get_json_object("j", "$.data"), F.get_json_object("j", "$.content[0].text"), F.col("j"))
    return e.select("event_id", F.get_json_object(inner, "$.v").alias("content"))


@query(f"SELECT seq, type, {RENDER} AS rendered FROM kv_log")
def value_render(spark, sf):
    return views.kv_log(spark, sf).select("seq", "type", values.render().alias("rendered"))


@query("SELECT seq, CASE type WHEN 'int' THEN 1 WHEN 'float' THEN 2 WHEN 'string' THEN 3 END AS log_code, CASE type WHEN 'int' THEN 0 WHEN 'float' THEN 1 WHEN 'string' THEN 2 END AS run_code FROM kv_log")
def type_codes(spark, sf):
    return views.kv_log(spark, sf).select("seq", values.type_code("type", values.LOG_CODES).alias("log_code"), values.type_code("type", values.RUN_CODES).alias("run_code"))


@query("SELECT o_orderkey, CASE WHEN b >= 1048576 THEN printf('%.2f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.2f KB', b / 1024.0) ELSE b || ' bytes' END AS size FROM (SELECT o_orderkey, o_orderkey * o_custkey AS b FROM orders)")
def format_bytes(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_custkey")).alias("b")).select("o_orderkey", values.format_bytes("b").alias("size"))


@query("SELECT o_orderkey, 'key_' || CASE WHEN length(o_orderkey::VARCHAR) < 6 THEN lpad(o_orderkey::VARCHAR, 6, '0') ELSE o_orderkey::VARCHAR END AS key, 'val_' || o_orderkey AS value FROM orders")
def format_keys(spark, sf):
    return views.table(spark, sf, "orders").select("o_orderkey", values.format_key("o_orderkey").alias("key"), F.concat(F.lit("val_"), F.col("o_orderkey").cast("string")).alias("value"))


@query("SELECT node_id, regexp_full_match('/node' || (node_id % 30), '/node[1-9]\\d*') AS is_node FROM node_health")
def name_regex(spark, sf):
    return views.node_health(spark, sf).select("node_id", F.concat(F.lit("/node"), (F.col("node_id") % 30).cast("string")).rlike(r"^/node[1-9]\d*$").alias("is_node"))


@query("SELECT node, idx, term FROM raft_log WHERE idx % 10 = 0")
def sample_every_nth(spark, sf):
    return views.raft_log(spark, sf).where("idx % 10 = 0").select("node", "idx", "term")


# Streaming


def _stream(spark, sf, name):
    path = f"{sf}/{name}.parquet"
    table = spark.read.parquet(path)
    first = table.select("_metadata.file_path").limit(1).collect()
    source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 64)
    if first and first[0][0].endswith(f"/{name}.parquet"):  # one file; a stream reads folders
        return source.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return source.parquet(path)


def _log_stream(spark, sf):
    kind = F.col("event_type")
    return _stream(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("key"), (kind == "error").alias("is_deleted"), F.col("event_type").alias("kind"), "value")


@query(f"SELECT * EXCLUDE is_deleted FROM (SELECT key, seq, is_deleted, event_type AS kind, e.value FROM kv_log JOIN (SELECT event_id AS seq, event_type, value FROM events) e USING (seq) {NEWEST}) WHERE NOT is_deleted")
def stream_kv_state(spark, sf):
    at = state.work_dir(spark)
    state.fold(_log_stream(spark, sf), f"{at}/state", f"{at}/checkpoint")
    return kv.live(kv.latest(spark.read.parquet(f"{at}/state").drop("batch"))).select("key", "seq", "kind", "value")


@query("SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(spark, sf):
    at = state.work_dir(spark)
    state.dedup(_stream(spark, sf, "events").select("event_type", "user_id"), f"{at}/out", f"{at}/checkpoint", ["event_type", "user_id"])
    return spark.read.parquet(f"{at}/out")


@query(""", d AS (SELECT epoch_us(ts) // 86400000000 * 86400000000 AS start_us, event_type, value FROM events)
SELECT start_us, event_type, count(*) AS n, round(sum(value), 2) AS total FROM d WHERE start_us + 86400000000 <= (SELECT max(epoch_us(ts)) - 3600000000 FROM events) GROUP BY start_us, event_type""")
def stream_windows(spark, sf):
    """Days that are closed: the newest event is an hour or more behind their end."""
    at = state.work_dir(spark)
    events = _stream(spark, sf, "events").withColumn("ts", F.timestamp_micros(views.micros()))
    state.tumbling(events, "1 day", "1 hour", f"{at}/out", f"{at}/checkpoint")
    return spark.read.parquet(f"{at}/out").select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


@query(f"SELECT key, seq, is_deleted FROM (SELECT key, seq, is_deleted FROM kv_log {NEWEST})")
def stream_flush(spark, sf):
    """The newest version of every key over the runs that the triggers flushed."""
    at = state.work_dir(spark)
    state.flush_batches(_log_stream(spark, sf).select("seq", "key", "is_deleted"), f"{at}/runs", f"{at}/checkpoint")
    return kv.latest(spark.read.parquet(f"{at}/runs").select("key", "seq", "is_deleted"))
