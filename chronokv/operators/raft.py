"""Analytics over replicated logs: commit, elections, conflicts, membership and safety."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronokv.operators.kv import latest
from chronokv.operators.ordering import lagged


def quorum_index(match: DataFrame) -> DataFrame:
    """Per group the highest index that a majority holds, the leader included.

    Of n - 1 peers' match indexes this is the floor(n / 2)-th largest.
    """
    ranked = F.sort_array(F.collect_list("match_index"), asc=False)  # a group has as many rows as peers
    return match.groupBy("grp").agg(ranked.alias("m")).select("grp", (F.size("m") + 1).alias("nodes"), F.get("m", (F.floor((F.size("m") + 1) / 2) - 1).cast("int")).alias("quorum_index"))


def quorum_commit(match: DataFrame, leaders: DataFrame, log: DataFrame) -> DataFrame:
    """Per group the commit index after the peers' acknowledgements: (grp, nodes, quorum_index, commit_index).

    Only an entry of the leader's own term advances it: the last such entry that a majority holds
    commits all before it. Without one the index stays. ``leaders``: (grp, term, commit_index);
    ``log``: (idx, term), joined on the term, so entries of other terms do not leave the scan.
    """
    held = quorum_index(match).join(leaders, "grp")
    own = log.select(F.col("idx"), F.col("term")).join(held.select("grp", "term", "quorum_index"), "term").where(F.col("idx") <= F.col("quorum_index"))
    last = own.groupBy("grp").agg(F.max("idx").alias("last"))
    return held.join(last, "grp", "left").select("grp", "nodes", "quorum_index", F.greatest("commit_index", F.coalesce("last", "commit_index")).alias("commit_index"))


def elections(timeouts: DataFrame, cluster: DataFrame) -> DataFrame:
    """Every election that a timeout starts: (seq, node, term, voted_for, votes, won).

    A node's term grows by one at each of its timeouts (seq, node, turn, from 1), it votes for
    itself, and in a cluster of one it has won at once. ``cluster``: (node, term, size) before.
    """
    started = timeouts.join(F.broadcast(cluster), "node")  # a row for each node of a cluster
    return started.select("seq", "node", (F.col("term") + F.col("turn")).alias("term"), F.col("node").alias("voted_for"), F.lit(1).alias("votes"), (F.col("size") < 2).alias("won"))


def peer_progress(responses: DataFrame) -> DataFrame:
    """What a leader knows of every peer after its answers: (grp, peer, match_index, next_index).

    ``responses``: (grp, peer, seq, term, leader_term, success, match_index). A success sets the
    match index and the next one after it; a refusal steps back by one, to 1 at least; answers of
    an earlier term count for nothing, and after one of a later term the leader has stepped down.
    """
    keys = ["grp", "peer"]
    over = responses.groupBy("grp").agg(F.min(F.when(F.col("term") > F.col("leader_term"), F.col("seq"))).alias("over"))
    heard = responses.join(over, "grp").where((F.col("term") == F.col("leader_term")) & (F.col("over").isNull() | (F.col("seq") < F.col("over"))))
    done = heard.groupBy(*keys).agg(F.max(F.when(F.col("success"), F.struct("seq", "match_index"))).alias("last"))
    refused = heard.join(done, keys).groupBy(*keys).agg(F.count_if(~F.col("success") & (F.col("last").isNull() | (F.col("seq") > F.col("last.seq")))).alias("back"), F.first("last.match_index").alias("m"))
    m = F.coalesce("m", F.lit(0).cast("long"))
    return refused.select(*keys, m.alias("match_index"), F.greatest(F.lit(1).cast("long"), m + 1 - F.col("back")).alias("next_index"))


def votes_granted(votes: DataFrame) -> DataFrame:
    """Per voter and term the first request of a candidate whose log is not behind the voter's: by last term, then index."""
    current = F.struct("last_term", "last_index") >= F.struct(F.col("own_term").alias("last_term"), F.col("own_index").alias("last_index"))
    first = votes.where(current).groupBy("voter", "term").agg(F.min_by(F.struct("candidate", "last_term", "last_index"), "seq").alias("v"), F.min("seq").alias("seq"))
    return first.select("voter", "term", "seq", "v.*")


def vote_tally(granted: DataFrame, nodes: int) -> DataFrame:
    """Per term and candidate the distinct voters, and whether they are a majority of ``nodes``."""
    return granted.groupBy("term", "candidate").agg(F.count_distinct("voter").alias("votes")).withColumn("won", F.col("votes") >= nodes // 2 + 1)


def conflict(local: DataFrame, incoming: DataFrame) -> DataFrame:
    """The log after an append: local entries before the first index whose terms differ, then the incoming ones from there."""
    both = local.alias("l").join(incoming.alias("i"), F.col("l.idx") == F.col("i.idx"))
    cut = both.where("l.term <> i.term").agg(F.min("l.idx").alias("cut"))
    kept = local.crossJoin(F.broadcast(cut)).where("cut is null or idx < cut").drop("cut")
    added = incoming.crossJoin(F.broadcast(cut)).where("cut is not null and idx >= cut").drop("cut")
    fresh = incoming.crossJoin(F.broadcast(cut)).where("cut is null").drop("cut").join(local.select("idx"), "idx", "left_anti").select(*local.columns)
    return kept.unionByName(added).unionByName(fresh)


def members(changes: DataFrame, bootstrap: DataFrame) -> DataFrame:
    """Peers after all membership changes in log order; bootstrap peers count as added before the log."""
    start = bootstrap.select(F.lit(-1).cast("long").alias("idx"), F.lit("Add").alias("kind"), "peer")
    return latest(start.unionByName(changes.select("idx", "kind", "peer")), ["idx"], ["peer"]).where("kind = 'Add'").select("peer", "idx")


def pairs(log: DataFrame) -> DataFrame:
    """Entries of two nodes at the same index: an equi-join, so it grows with the log."""
    a, b = log.alias("a"), log.alias("b")
    return a.join(b, (F.col("a.idx") == F.col("b.idx")) & (F.col("a.node") < F.col("b.node"))).select(F.col("a.node").alias("node_a"), F.col("b.node").alias("node_b"), F.col("a.idx").alias("idx"), (F.col("a.term") == F.col("b.term")).alias("same_term"), F.col("a.payload").eqNullSafe(F.col("b.payload")).alias("same_payload"))


def log_matching(log: DataFrame) -> DataFrame:
    """Node pairs that differ in term below an index at which they agree."""
    edges = pairs(log).groupBy("node_a", "node_b").agg(F.min(F.when(~F.col("same_term"), F.col("idx"))).alias("first_difference"), F.max(F.when(F.col("same_term"), F.col("idx"))).alias("last_agreement"))
    return edges.where("first_difference < last_agreement")


def state_safety(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries that two nodes have both committed but that differ."""
    n = nodes.select("node", "commit_index")
    committed = log.join(F.broadcast(n), "node").where(F.col("idx") <= F.col("commit_index")).drop("commit_index")
    return pairs(committed).where(~F.col("same_payload")).select("node_a", "node_b", "idx")


def election_safety(states: DataFrame) -> DataFrame:
    """Terms in which more than one node is the leader: ``states`` (node, term, role)."""
    return states.where("role = 'Leader'").groupBy("term").agg(F.count_distinct("node").alias("leaders")).where("leaders > 1")


def divergence(states: DataFrame) -> DataFrame:
    """Keys that do not have one value on all nodes: (key, nodes, variants)."""
    return states.groupBy("key").agg(F.count_distinct("node").alias("nodes"), F.count_distinct(F.coalesce(F.col("value"), F.lit("\0"))).alias("variants")).where("variants > 1")


def timeout_gaps(beats: DataFrame, by: list[str], limit_us: int) -> DataFrame:
    """Silences of more than ``limit_us`` between successive beats."""
    before = lagged(beats, by, ["us", "sequence"], ["us"])
    return before.withColumn("gap_us", F.col("us") - F.col("before_us")).where(F.col("gap_us") > limit_us).drop("before_us")
