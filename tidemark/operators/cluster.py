"""Nodes, leases and load as queries over tables of nodes (node_id, host, port, started_at) and leases (partition, node_id, expires_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_leases(claims: DataFrame, now_ms: int) -> DataFrame:
    """The holder of each partition at an instant, from all claims made by then.

    A claim is granted if no lease is live when it is made, and renews the lease of its own node; a claim made while another node's
    lease is live is refused for good. So a partition's claims are folded in order of time, one step per claim.
    """
    claim = F.struct("claimed_ms", "node_id", "expires_ms")
    made = claims.where(F.col("claimed_ms") <= now_ms).groupBy("partition").agg(F.sort_array(F.collect_list(claim)).alias("claims"))
    kind = claims.select(F.struct("node_id", "expires_ms")).schema[0].dataType
    free = lambda held, c: held["expires_ms"].isNull() | (held["expires_ms"] <= c["claimed_ms"]) | (held["node_id"] == c["node_id"])
    step = lambda held, c: F.when(free(held, c), F.struct(c["node_id"].alias("node_id"), c["expires_ms"].alias("expires_ms")).cast(kind)).otherwise(held)
    none = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind.fields]).cast(kind)
    held = made.select("partition", F.aggregate("claims", none, step).alias("c"))
    return held.where(F.col("c.expires_ms") > now_ms).select("partition", "c.node_id", "c.expires_ms")


def fair_share(leases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Partitions that each node holds, its fair share (all partitions over all nodes, rounded down, plus one) and how many it releases at this tick: one if it holds more."""
    partitions, n = leases.agg(F.countDistinct("partition")).scalar(), nodes.agg(F.count("*")).scalar()
    held = nodes.select("node_id").join(leases.groupBy("node_id").agg(F.count("*").alias("held")), "node_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    share = F.floor(partitions / F.greatest(n, F.lit(1))) + 1
    return held.select("node_id", "held", share.cast("long").alias("fair_share"), ((F.col("held") > share) & (n > 1)).cast("int").alias("release"))


def leaders(leases: DataFrame, nodes: DataFrame) -> DataFrame:
    return leases.join(nodes, "node_id").select("partition", "node_id", "host", "port")


def accepted_appends(records: DataFrame, leases: DataFrame, node_id: object) -> tuple[DataFrame, DataFrame]:
    """(records that a node may append, the others with ``_error``): only the leader of a partition appends to it."""
    held = leases.where(F.col("node_id") == node_id).select("partition", F.lit(True).alias("__held"))
    marked = records.join(held, "partition", "left")
    error = F.concat(F.lit("Not leader for partition "), F.col("partition")).alias("_error")
    return marked.where(F.col("__held").isNotNull()).drop("__held"), marked.where(F.col("__held").isNull()).select(*records.columns, error)


def peers(nodes: DataFrame, node_id: object) -> DataFrame:
    return nodes.where(F.col("node_id") != node_id)


def status(leases: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes with the partitions that they hold, in order."""
    held = leases.groupBy("node_id").agg(F.sort_array(F.collect_list("partition")).alias("partitions"))
    return nodes.join(held, "node_id", "left").withColumn("partitions", F.coalesce("partitions", F.array().cast(leases.select(F.array("partition")).schema[0].dataType)))
