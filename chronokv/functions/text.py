"""Routes, addresses, commands, messages and the rules that classify them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Route labels by path, in order (fixed values).
ROUTES = [("/kv/", True, "/kv/{key}"), ("/health/nodes", False, "/health/nodes"), ("/health/node/", True, "/health/node/{id}"), ("/status", False, "/status"), ("/metrics", False, "/metrics"), ("/errors/recent", True, "/errors/recent"), ("/diagnose", False, "/diagnose"), ("/recovery/recommend", False, "/recovery/recommend")]
#: Failure classes: (label, words of which one occurs, words of which one must occur too) (fixed values).
FAILURES = [
    ("Leader loss / election failure", ["leader"], ["lost", "no leader", "election"]),
    ("Quorum loss / majority of nodes down", ["quorum", "majority", "unavailable"], []),
    ("Network partition", ["network", "partition", "split"], []),
    ("High latency / timeouts", ["slow", "latency", "timeout"], []),
]
GENERAL = "General cluster issue"
#: The four steps for each class (fixed values).
STEPS = {
    "Leader loss / election failure": ["diagnose_nodes", "wait_election", "restart_isolated_node", "verify_quorum"],
    "Quorum loss / majority of nodes down": ["diagnose_nodes", "restore_nodes", "verify_leader", "replay_pending_ops"],
    "Network partition": ["identify_partition", "restore_connectivity", "wait_convergence", "check_stale_reads"],
    "High latency / timeouts": ["check_metrics", "diagnose_nodes", "investigate_load", "reduce_traffic"],
    "General cluster issue": ["diagnose_nodes", "get_recent_errors", "get_cluster_status", "escalate"],
}


def route(path: str) -> Column:
    out = F.lit("unmatched")
    for start, prefix, label in reversed(ROUTES):
        out = F.when(F.col(path).startswith(start) if prefix else F.col(path) == start, label).otherwise(out)
    return out


def classify_failure(summary: str) -> Column:
    """The first class whose words occur in the summary, whatever their case."""
    text, out = F.lower(summary), F.lit(GENERAL)
    any_of = lambda ws: F.coalesce(*[F.when(text.contains(w), True) for w in ws], F.lit(False))
    for label, some, also in reversed(FAILURES):
        out = F.when(any_of(some) & (any_of(also) if also else F.lit(True)), label).otherwise(out)
    return out


def steps_for(label: str) -> Column:
    """The ordered steps of a class as structs (order, action)."""
    out = F.array().cast("array<struct<order:int,action:string>>")
    for name, actions in STEPS.items():
        steps = F.array(*[F.struct(F.lit(k + 1).alias("order"), F.lit(a).alias("action")) for k, a in enumerate(actions)])
        out = F.when(F.col(label) == name, steps).otherwise(out)
    return out


def address_ok(address: str) -> Column:
    c = F.col(address)
    port = F.regexp_extract(c, r":(\d{1,5})$", 1).try_cast("int")
    return F.coalesce(c.rlike(r"^[a-zA-Z0-9._-]+:\d{1,5}$") & port.between(1, 65535), F.lit(False))


def api_address(address: str, explicit: str) -> Column:
    """The explicit address, or the one whose port is 1000 above a port 6000-6999; ports 7000-7999 stay; else null."""
    host, port = F.regexp_extract(address, r"^(.*):(\d+)$", 1), F.regexp_extract(address, r"^(.*):(\d+)$", 2).try_cast("int")
    given = F.trim(F.coalesce(F.col(explicit), F.lit("")))
    return F.when(given != "", F.when(given.rlike(r"^[^:]*:[^:]*$"), given)).when(port.between(6000, 6999), F.concat(host, F.lit(":"), (port + 1000).cast("string"))).when(port.between(7000, 7999), F.concat(host, F.lit(":"), port.cast("string")))


def command(line: str) -> tuple[Column, Column, Column]:
    """(verb, key, value) of a command line: the verb in lower case, the rest of SET joined by single spaces."""
    parts = F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")
    word = F.lower(F.get(parts, F.lit(0)))
    verb = F.when(word == "del", "delete").otherwise(word)
    n = F.size(parts)
    known = F.when((verb == "set") & (n >= 3), "set").when(verb.isin("get", "delete", "connect") & (n >= 2), verb).when(verb.isin("status", "help", "exit", "quit"), verb).when(verb.isin("set", "get", "delete", "connect"), "usage").otherwise("unknown")
    has_key = known.isin("set", "get", "delete", "connect")
    return known, F.when(has_key, F.get(parts, F.lit(1))), F.when(known == "set", F.array_join(F.slice(parts, 3, F.greatest(n, F.lit(1))), " "))


def http_status(success: str, replied: str, deadline: str) -> Column:
    """200 on success; a failed reply is 409, or 504 past the deadline; without any reply 502."""
    return F.when(F.col(success), 200).when(F.col(replied), F.when(F.col(deadline), 504).otherwise(409)).otherwise(502)


def store_command(op: str, key: str, value: str) -> tuple[Column, Column, Column]:
    """(code, key, value) of the log command that an operation becomes; reads become none."""
    o = F.col(op)
    return F.when(o == "Set", 1).when(o == "Delete", 2), F.when(o.isin("Set", "Delete"), F.col(key)), F.when(o == "Set", F.col(value))
