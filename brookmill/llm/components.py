"""Connected components by hash-to-min over relations: every round is an aggregation, a join and a distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.session import SharedTable, join_hot


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> SharedTable:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node that is reached.

    A cluster C(v) is kept as rows (node v, member u), never as a collected list, so a component of a third of all
    nodes is only many rows. Each round a node sends its cluster to the cluster's minimum m and sends m to every
    member: rows (m, u) and (u, m). It stops when a round changes nothing, told by a count and two order-free hashes.
    An edge (a, a) gives a single node. Rows with a null end are left out. Repeated edges count once. No edges give no
    rows. Raises after ``max_rounds``; the method needs about log(longest path) rounds.
    """
    both = edges.where("a is not null and b is not null").select("a", "b").distinct()
    clusters = both.select(F.explode(F.array(
        F.struct(F.col("a").alias("node"), F.col("a").alias("member")), F.struct(F.col("b").alias("node"), F.col("b").alias("member")),
        F.struct(F.col("a").alias("node"), F.col("b").alias("member")), F.struct(F.col("b").alias("node"), F.col("a").alias("member")),
    )).alias("x")).select("x.*").distinct()
    now, before = SharedTable(clusters, "clusters"), None
    for _ in range(max_rounds):
        rows = now.read()
        marks = rows.agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "member")).alias("x"),
            F.sum(F.pmod(F.hash("node", "member"), F.lit(1 << 20))).alias("s"),
        ).first()
        if before is not None and marks == before[0]:
            before[1].drop()
            done = SharedTable(rows.groupBy("node").agg(F.min("member").alias("component")), "components")
            now.drop()
            return done
        mins = rows.groupBy("node").agg(F.min("member").alias("m"), F.count("*").alias("n"))
        sent = join_hot(rows, mins, "node", "n", marks["n"])
        after = sent.select(F.explode(F.array(
            F.struct(F.col("m").alias("node"), F.col("member").alias("member")), F.struct(F.col("member").alias("node"), F.col("m").alias("member")),
        )).alias("x")).select("x.*").distinct()
        if before is not None:
            before[1].drop()
        before = (marks, now)
        now = SharedTable(after, "clusters")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
