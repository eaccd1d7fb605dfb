"""Properties of the operators that no single query shows, on hand-made and closed-form inputs."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from chronokv.functions import text, values
from chronokv.functions.random import splitmix
from chronokv.operators import health, kv, metrics, raft, runs, sim
from chronokv.operators.ordering import lagged, numbered
from chronokv.sources import formats
from chronokv.streaming import state

LOG = "seq long, key string, is_deleted boolean, type string, int_value long, float_value double, string_value string"


def log_of(spark, *rows):
    return spark.createDataFrame([(i, k, v is None, None if v is None else {int: "int", float: "float", str: "string"}[type(v)], v if type(v) is int else None, v if type(v) is float else None, v if type(v) is str else None) for i, (k, v) in enumerate(rows)], LOG)


@pytest.fixture(scope="module")
def stress(spark):
    """10,000 keys written, all written again, the first half deleted."""
    n = 10_000
    base = spark.range(n).select(F.col("id"), values.format_key("id").alias("key"))
    set_ = lambda k, prefix: base.select((F.col("id") + k * n).alias("seq"), "key", F.lit(False).alias("is_deleted"), F.lit("string").alias("type"), F.lit(None).cast("long").alias("int_value"), F.lit(None).cast("double").alias("float_value"), F.concat(F.lit(prefix), F.col("id").cast("string")).alias("string_value"))
    gone = set_(2, "").where("seq < 25000").withColumns({"is_deleted": F.lit(True), "type": F.lit(None).cast("string"), "string_value": F.lit(None).cast("string")})
    return set_(0, "val_").unionByName(set_(1, "new_val_")).unionByName(gone)


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()))


def test_crud(spark):
    log = log_of(spark, ("key1", "value1"), ("key2", "value2"), ("key1", "again"), ("key2", None))
    assert rows(kv.snapshot(log), "key", "string_value") == [("key1", "again")]
    assert kv.get(log, "key2").count() == 0 and kv.get(log, "nonexistent").count() == 0
    wanted = spark.createDataFrame([("key1",), ("key2",), ("no",)], "key string")
    assert rows(kv.multi_get(log, wanted), "key", F.coalesce("string_value", F.lit("-"))) == [("key1", "again"), ("key2", "-"), ("no", "-")]


def test_a_key_may_change_type(spark):
    log = log_of(spark, ("a", 1), ("a", 2.5), ("a", "x"), ("b", "y"), ("b", 7))
    assert rows(kv.snapshot(log), "key", "type") == [("a", "string"), ("b", "int")]


def test_closed_form(stress):
    state_ = kv.snapshot(stress)
    assert state_.count() == 5000
    assert state_.where("string_value <> concat('new_val_', cast(cast(substring(key, 5) as int) as string))").count() == 0
    assert state_.agg(F.min("key")).first()[0] == "key_005000"


def test_runs_keep_the_snapshot(stress):
    want = rows(kv.snapshot(stress), "key", "string_value")
    for width in (7, 1000, 40_000):
        log = stress.withColumn("run_id", F.floor(F.col("seq") / width).cast("long")).withColumn("level", F.lit(0))
        merged = runs.merge(runs.fold_runs(log))
        assert merged.count() == 10_000  # tombstones stay
        assert rows(kv.live(merged), "key", "string_value") == want


def test_repeats_and_order_do_not_matter(stress):
    want = rows(kv.snapshot(stress), "key", "string_value")
    assert rows(kv.snapshot(stress.union(stress).orderBy(F.rand(3))), "key", "string_value") == want
    assert rows(kv.as_of(stress, 10**9), "key", "string_value") == want
    assert kv.as_of(stress, 9_999).count() == 10_000


def test_overlay_hides_by_tombstones(spark):
    below, top = log_of(spark, ("a", 1), ("b", 2)), log_of(spark, ("a", None), ("c", 3))
    assert rows(kv.live(kv.overlay(kv.latest(top), kv.latest(below))), "key") == [("b",), ("c",)]


def test_flush_writes_sorted_runs(spark, stress, tmp_path):
    runs.flush(stress.withColumn("run_id", F.floor(F.col("seq") / 5000).cast("long")).withColumn("level", F.lit(0)), f"file://{tmp_path}/runs")
    back = spark.read.parquet(f"file://{tmp_path}/runs")
    assert rows(kv.snapshot(back.drop("run_id", "level")), "key") == rows(kv.snapshot(stress), "key")
    one = [r.key for r in spark.read.parquet(f"file://{tmp_path}/runs/run_id=2").collect()]
    assert one == sorted(one)


# Binary formats


def test_log_file_stops_at_damage():
    records = [formats.log_record(i, f"k{i}", i % 3 == 0, 2, None if i % 3 == 0 else str(i / 2)) for i in range(9)]
    data = b"".join(records)
    assert [r[0] for r in formats.read_log(data)] == list(range(9))
    assert next(formats.read_log(records[1])) == (1, "k1", False, "float", "0.5")
    at = len(b"".join(records[:5])) + 20
    assert [r[0] for r in formats.read_log(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])] == [0, 1, 2, 3, 4]
    assert [r[0] for r in formats.read_log(data[:-3])] == list(range(8))
    assert list(formats.read_log(b"")) == []


def test_run_file():
    entries = [("a", False, 0, "1"), ("b", True, None, None), ("é", False, 2, "x")]
    data = formats.run_file(entries)
    assert list(formats.read_run(data)) == [("a", False, "int", "1"), ("b", True, None, None), ("é", False, "string", "x")]
    assert formats.run_index(data) == [(b"a", 45), (b"b", 57), ("é".encode(), 68)]
    with pytest.raises(ValueError):
        formats.run_file(entries[::-1])
    with pytest.raises(ValueError):
        list(formats.read_run(b"XXXX" + data[4:]))


# Replicated logs


def test_conflict_keeps_the_leaders_suffix(spark):
    entries = lambda *x: spark.createDataFrame(list(x), "idx long, term long, payload string")
    local, incoming = entries((1, 1, "a"), (2, 1, "b"), (3, 1, "c")), entries((2, 2, "B"), (3, 2, "C"))
    assert rows(raft.conflict(local, incoming), "idx", "term", "payload") == [(1, 1, "a"), (2, 2, "B"), (3, 2, "C")]
    assert rows(raft.conflict(local, entries((2, 1, "b"), (3, 1, "c"), (4, 1, "d"))), "idx", "payload") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]  # repeats are not appended again


def test_quorum(spark):
    match = lambda *x: spark.createDataFrame([(1, i, m) for i, m in enumerate(x)], "grp long, peer long, match_index long")
    for peers, want in (((5, 3), 5), ((9, 7, 4, 1), 7), ((8,), 8)):
        assert raft.quorum_index(match(*peers)).first()["quorum_index"] == want


def test_only_the_leaders_term_commits(spark):
    match = spark.createDataFrame([(1, 1, 4), (1, 2, 4), (2, 1, 3), (2, 2, 2)], "grp long, peer long, match_index long")
    log = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3)], "idx long, term long")
    leaders = lambda *x: spark.createDataFrame(list(x), "grp long, term long, commit_index long")
    commit = lambda d: rows(raft.quorum_commit(match, d, log), "grp", "commit_index")
    assert commit(leaders((1, 3, 1), (2, 2, 1))) == [(1, 4), (2, 3)]
    assert commit(leaders((1, 4, 1), (2, 3, 1))) == [(1, 1), (2, 1)]  # held by all, but of an earlier term, or not held yet
    assert commit(leaders((1, 2, 1), (2, 1, 2))) == [(1, 3), (2, 2)]  # the last of its own term; never back


def test_peer_progress_steps_back_after_refusals(spark):
    schema = "grp long, peer long, seq long, term long, leader_term long, success boolean, match_index long"
    told = [(1, 1, 1, 5, 5, True, 7), (1, 1, 2, 5, 5, False, 0), (1, 1, 3, 4, 5, True, 99), (1, 2, 4, 5, 5, False, 0), (1, 2, 5, 5, 5, False, 0), (2, 1, 1, 5, 5, True, 3), (2, 1, 2, 6, 5, False, 0), (2, 1, 3, 5, 5, True, 9)]
    assert rows(raft.peer_progress(spark.createDataFrame(told, schema)), "grp", "peer", "match_index", "next_index") == [(1, 1, 7, 7), (1, 2, 0, 1), (2, 1, 3, 4)]


def test_numbers_and_predecessors_across_ranges(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.pmod(F.xxhash64("id"), F.lit(10**6)).alias("t"), F.col("id").alias("part")).repartition(7)
    want: dict = {}
    for k, t, i in sorted(map(tuple, df.collect())):
        want.setdefault(k, []).append((t, i))
    got: dict = {}
    for k, n, t, i in sorted((r.k, r.n, r.t, r.part) for r in numbered(df, ["k"], ["t", "part"], "n").collect()):
        got.setdefault(k, []).append((t, i))
        assert n == len(got[k])
    assert got == want
    before = {(r.k, r.t, r.part): r.before_t for r in lagged(df, ["k"], ["t", "part"], ["t"]).collect()}
    assert all(before[k, t, i] == (want[k][n - 1][0] if n else None) for k in want for n, (t, i) in enumerate(want[k]))


def test_tables_are_flushed_at_distinct_keys(spark):
    log = spark.createDataFrame([(i, k, s) for i, (s, k) in enumerate([(0, "a"), (0, "a"), (0, "b"), (1, "x"), (0, "a"), (0, "b"), (1, "x"), (0, "c"), (1, "y")])], "seq long, key string, shard long")
    assert rows(runs.flush_points(log, 2), "shard", "seq", "run") == [(0, 0, 0), (0, 1, 0), (0, 2, 0), (0, 4, 1), (0, 5, 1), (0, 7, 2), (1, 3, 0), (1, 6, 0), (1, 8, 0)]


def test_checksum_is_that_of_the_record(spark):
    log = log_of(spark, ("a", 1), ("key", 2.5), ("é", "text"), ("a", None)).withColumn("seq", F.col("seq") * 70_000 + 3)
    got = log.select("seq", values.record_checksum("seq", "is_deleted", "type", "key", values.render()).alias("c"), "key", "is_deleted", "type", values.render().alias("v")).collect()
    for r in got:
        assert formats.log_record(r.seq, r.key, r.is_deleted, values.LOG_CODES.get(r.type, 0), r.v)[-1] == r.c


def test_bloom_filters_hold_their_keys(spark):
    held = spark.range(4000).select((F.col("id") % 4).alias("run_id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    other = spark.range(4000, 12_000).select((F.col("id") % 4).alias("run_id"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    assert runs.bloom_probe(held, held).where("not may_contain").count() == 0
    assert runs.bloom_probe(held, other).where("may_contain").count() < 0.03 * 8000


def test_nodes_are_tried_in_order(spark):
    nodes = spark.createDataFrame([(1, 30), (1, 10), (1, 20), (2, 5)], "cluster long, node_id long")
    asked = spark.createDataFrame([(1, 1, 20), (2, 1, None), (3, 1, 99), (4, 2, 5), (5, 3, 1)], "request long, cluster long, hint long")
    assert rows(health.candidates(asked, nodes), "request", "attempt", "node_id") == [(1, 0, 20), (1, 1, 10), (1, 2, 30), (2, 0, 10), (2, 1, 20), (2, 2, 30), (3, 0, 10), (3, 1, 20), (3, 2, 30), (4, 0, 5)]


def test_tried_nodes_take_little_disk(spark, tmp_path):
    nodes = {c: sorted((k * 7919 + c) % 100_003 for k in range(600)) for c in range(25)}
    asked = [(i, c, None if i < 500 else -1 if i < 600 else nodes.get(c, [7] * 10)[9]) for i in range(1560) for c in [i % 26]]  # cluster 25 has no nodes
    df = health.candidates(spark.createDataFrame(asked, "request long, cluster long, hint long"), spark.createDataFrame([(c, n) for c, x in nodes.items() for n in x], "cluster long, node_id long"))
    df.write.parquet(f"file://{tmp_path}/out")
    want = [(i, k, n) for i, c, h in asked for k, n in enumerate(sorted(nodes.get(c, []), key=lambda n: (n != h, n)))]
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas().sort_values(["request", "attempt"])
    assert list(map(tuple, got.to_numpy().tolist())) == want
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.8 * len(want)


def test_planted_violations_are_found(spark):
    log = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (1, 3, 2, "c"), (2, 1, 1, "a"), (2, 2, 9, "x"), (2, 3, 2, "c")], "node long, idx long, term long, payload string")
    assert rows(raft.log_matching(log), "node_a", "node_b", "first_difference", "last_agreement") == [(1, 2, 2, 3)]
    nodes = spark.createDataFrame([(1, 2), (2, 2)], "node long, commit_index long")
    assert rows(raft.state_safety(log, nodes), "idx") == [(2,)]
    assert raft.state_safety(log, spark.createDataFrame([(1, 2), (2, 1)], "node long, commit_index long")).count() == 0
    states = spark.createDataFrame([(1, 1, "Leader"), (2, 1, "Leader"), (1, 2, "Leader"), (1, 2, "Leader"), (3, 2, "Follower")], "node long, term long, role string")
    assert rows(raft.election_safety(states), "term", "leaders") == [(1, 2)]


def test_members(spark):
    changes = spark.createDataFrame([(1, "Add", 4), (2, "Remove", 1), (3, "Remove", 4), (5, "Add", 4)], "idx long, kind string, peer long")
    assert rows(raft.members(changes, spark.createDataFrame([(1,), (2,)], "peer long")), "peer") == [(2,), (4,)]


# Event streams


def test_link_faults(spark):
    events = spark.createDataFrame([(k, 1, 2, 100 * k) for k in range(4)] + [(9, 2, 1, 50)], "sequence long, src long, dst long, us long")
    assert rows(sim.drop_next(events, spark.createDataFrame([(1, 2, 1)], "src long, dst long, n int")), "sequence") == [(1,), (2,), (3,), (9,)]
    assert rows(sim.delay(events, spark.createDataFrame([(1, 2, 7)], "src long, dst long, delay_us long")), "sequence", "us")[:2] == [(0, 7), (1, 107)]
    twice = sim.duplicate_next(events, spark.createDataFrame([(1, 2, 3)], "src long, dst long, n int"), 10)
    assert twice.count() == 8 and twice.where("copy = 1").agg(F.max("us")).first()[0] == 210
    held = sim.pause(events, spark.createDataFrame([(2, 100, 250)], "dst long, from_us long, to_us long"))
    assert rows(held, "sequence", "us") == [(0, 0), (1, 250), (2, 250), (3, 300), (9, 50)]
    none = spark.createDataFrame([], "node long")
    assert sim.deliverable(events, none, spark.createDataFrame([(1, 2)], "src long, dst long")).count() == 1
    assert sim.deliverable(events, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([], "src long, dst long")).count() == 0


def test_splitmix_is_the_published_sequence():
    import numpy as np

    assert [int(x) for x in splitmix(np.zeros(3, np.uint64), np.array([1, 2, 3]))] == [0xE220A8397B1DCDAF, 0x6E789E6AA1B965F4, 0x06C45D188009454F]


# Metrics


def test_quantiles(spark):
    b = lambda *x: spark.createDataFrame([("s", le, c) for le, c in x], "s string, le double, cnt long")
    q = lambda df, p: metrics.quantile(df, p, ["s"]).first()["quantile"]
    hist = b((0.1, 10), (0.5, 20), (math.inf, 20))
    assert q(hist, 0.5) == pytest.approx(0.1) and q(hist, 0.75) == pytest.approx(0.3)
    assert q(b((0.1, 10), (math.inf, 20)), 0.99) == pytest.approx(0.1)
    assert q(b((0.1, 0), (math.inf, 0)), 0.9) == 0.0


def test_rates_over_spans_and_resets(spark):
    import random

    r, samples = random.Random(1), []
    for k in range(2):
        us, cnt = 0, 0
        for _ in range(300):
            us, cnt = us + r.randint(1, 40), 0 if r.random() < 0.02 else cnt + r.randint(0, 3)
            samples.append((k, us, cnt))
    got = {(x.k, x.us): x.rate for x in metrics.rate(spark.createDataFrame(samples, "k int, us long, cnt long"), ["k"], 100).collect()}
    for k in range(2):
        own = [(u, c) for j, u, c in samples if j == k]
        steps = [(u, 0 if n == 0 else c - own[n - 1][1] if c >= own[n - 1][1] else c) for n, (u, c) in enumerate(own)]
        for u, _ in own:
            assert got[k, u] == pytest.approx(sum(s for v, s in steps if u - 100 <= v <= u) / 1e-4)


def test_rates_of_crowded_windows_and_times(spark):
    """Every window holds all samples, and samples share their times; a sum of each window on its own takes the square of their number."""
    import time

    n = 120_000
    samples = spark.range(n).select(F.lit("s").alias("k"), F.floor(F.col("id") / 2).alias("us"), F.col("id").alias("cnt"))
    began = time.perf_counter()
    got = metrics.rate(samples, ["k"], 10**6).select("us", "cnt", "rate").toPandas().sort_values("cnt")
    assert got["cnt"].tolist() == list(range(n)) and got["rate"].tolist() == [float(i | 1) for i in range(n)]
    assert time.perf_counter() - began < 60


def test_increase_of_counters(spark):
    hourly = spark.createDataFrame([("a", 1, 5), ("a", 2, 3), ("a", 4, 2), ("b", 4, 9)], "s string, hour long, cnt long")
    grown = metrics.last_increase(metrics.counters(hourly, ["s"], "hour"), spark.createDataFrame([(4,)], "now long"), ["s"], "hour", 3)
    assert rows(grown, "s", "increase") == [("a", 5), ("b", 0)]
    reset = spark.createDataFrame([("a", 1, 9), ("a", 2, 4), ("a", 3, 6)], "s string, hour long, cnt long")
    assert rows(metrics.last_increase(reset, spark.createDataFrame([(3,)], "now long"), ["s"], "hour", 2), "s", "increase") == [("a", 6)]


def test_nearest_rank_takes_the_upper_middle(spark):
    v = spark.createDataFrame([("a", float(x)) for x in range(10)] + [("b", 3.0), ("b", None)], "g string, v double")
    got = {r.g: r for r in metrics.nearest_rank(v, ["g"], "v", {"p50": 0.5, "p99": 0.99}).collect()}
    assert (got["a"].p50, got["a"].p99, got["a"].n) == (5.0, 9.0, 10) and got["b"].p50 == 3.0


def test_metric_lines(spark):
    lines = spark.createDataFrame([("# HELP x y",), ('x{a="1",b="c,\\"d}"} 2.5 123',), ("y 7",), ("z NaN",), ("bad",), ("",)], "value string")
    got = {(r["name"], r["value"], r["labels"].get("a")) for r in metrics.parse_metrics(lines).collect()}
    assert got == {("x", 2.5, "1"), ("y", 7.0, None)}


# Health, text, values


def test_diagnosis(spark):
    nodes = spark.createDataFrame([(1, 1, "a:1", True, True, 3, 2, 4, "ok"), (1, 2, "b:1", False, False, 0, None, 9, "refused"), (1, 3, "c:1", True, False, 0, 1, 7, "behind")], "cluster long, node_id long, address string, reachable boolean, healthy boolean, latency_ms long, leader_id long, term long, message string")
    d = health.diagnose(nodes).first()
    assert (d.success, d.healthy_nodes, d.reachable_nodes, d.leader_id, d.term, d.issues) == (False, 1, 2, 2, 4, 2)
    assert d.message == "DEGRADED: 1/3 nodes healthy, 2/3 reachable - quorum may be lost"
    assert rows(nodes.select(health.issue().alias("i")).where("i is not null"), "i") == [("node 2 (b:1) is unreachable: refused",), ("node 3 (c:1) is reachable but unhealthy: behind",)]


@pytest.mark.parametrize(("raw", "kind"), [("42", "int"), ("+5", "int"), ("-0", "int"), ("9223372036854775808", "float"), ("1e3", "float"), (".5", "float"), ("nan", "float"), ("-inf", "float"), (" 7 ", "string"), ("1d", "string"), ("", "string"), ("x", "string"), (None, None)])
def test_inference(spark, raw, kind):
    assert spark.createDataFrame([(raw,)], "raw string").select(values.infer_type("raw")).first()[0] == kind


def test_addresses_and_routes(spark):
    df = spark.createDataFrame([("h:6001", None), ("h:7005", ""), ("h:8000", None), ("bad", None), ("h:1", " x:9 ")], "a string, e string")
    assert [r[0] for r in df.select(text.api_address("a", "e")).collect()] == ["h:7001", "h:7005", None, None, "x:9"]
    assert [r[0] for r in df.select(text.address_ok("a")).collect()] == [True, True, True, False, True]
    paths = spark.createDataFrame([("/kv/a",), ("/kv",), ("/errors/recent?x",), ("/health/node/3",), ("/nodes/1",)], "p string")
    assert [r[0] for r in paths.select(text.route("p")).collect()] == ["/kv/{key}", "unmatched", "/errors/recent", "/health/node/{id}", "unmatched"]


# Streaming


def test_stream_equals_batch(spark, stress, tmp_path):
    for k, part in enumerate(stress.randomSplit([1.0, 1.0, 1.0], 5)):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        source = spark.readStream.schema(stress.schema).parquet(f"file://{tmp_path}/in")
        state.fold(source, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
        assert k < 3
    got = kv.snapshot(spark.read.parquet(f"file://{tmp_path}/out").drop("batch"))
    assert rows(got, "key", "string_value") == rows(kv.snapshot(stress), "key", "string_value")


def test_stream_windows_and_flush(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"file://{tmp_path}/in")
    source = lambda: spark.readStream.schema(events.schema).parquet(f"file://{tmp_path}/in")
    state.tumbling(source(), "1 day", "1 hour", f"file://{tmp_path}/w", f"file://{tmp_path}/ck1")
    closed = spark.read.parquet(f"file://{tmp_path}/w")
    assert 0 < closed.agg(F.sum("n")).first()[0] <= events.count()
    changes = source().select(F.col("event_id").alias("seq"), F.col("user_id").cast("string").alias("key"), (F.col("event_type") == "error").alias("is_deleted"))
    state.flush_batches(changes, f"file://{tmp_path}/r", f"file://{tmp_path}/ck2")
    assert spark.read.parquet(f"file://{tmp_path}/r").select("key").distinct().count() == events.select("user_id").distinct().count()
