"""Reachability and integrity as relations. Audits return the rows that break a rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def reachable(roots: DataFrame, edges: DataFrame, max_depth: int = 12) -> DataFrame:
    """slot, depth of all nodes below the roots (slot). A node is visited once for each depth; depth is bounded, so forged cycles end."""
    front = seen = roots.select("slot", F.lit(0).alias("depth")).distinct()
    down = edges.select(F.col("parent_slot").alias("slot"), "child_slot")
    for depth in range(1, max_depth + 1):
        front = front.join(down, "slot").select(F.col("child_slot").alias("slot"), F.lit(depth).alias("depth")).distinct()
        seen = seen.union(front)
    return seen.groupBy("slot").agg(F.min("depth").alias("depth"))


def traversal_faults(roots: DataFrame, edges: DataFrame, max_depth: int, budget: int) -> DataFrame:
    """fault, slot: nodes at the deepest level that is allowed though it isn't a leaf's (depth), more nodes than the container has chunks (budget), nodes with several parents (seen twice)."""
    found = reachable(roots, edges, max_depth)
    deep = found.where(F.col("depth") >= max_depth).select(F.lit("depth").alias("fault"), "slot")
    many = found.agg(F.count("*").alias("n")).where(F.col("n") > budget).select(F.lit("budget").alias("fault"), F.lit(None).cast("long").alias("slot"))
    return deep.union(many).union(seen_twice(edges).select(F.lit("seen twice").alias("fault"), "slot"))


def fast_open(chunks: DataFrame, named: DataFrame, high_water: int) -> DataFrame:
    """Chunks that a checkpoint leaves to look at: those it names below its high-water mark, and all from there on."""
    low = chunks.where(F.col("slot") < high_water).join(named.select("slot").distinct(), "slot", "left_semi")
    return low.unionByName(chunks.where(F.col("slot") >= high_water))


def other_namespace(nodes: DataFrame, told: str = "namespace", expected: str = "root_namespace") -> DataFrame:
    """Nodes that say another namespace than the root that they hang from."""
    return nodes.where(F.col(told) != F.col(expected))


def subtree(nodes: DataFrame, edges: DataFrame, again: DataFrame) -> DataFrame:
    """fault, slot of all nodes below one root: another namespace (told), a hash that isn't the pointer's, several parents.
    nodes: slot, namespace, told, payload_hash; edges: parent_slot, child_slot, child_hash; again: further pointers."""
    one = lambda name, rows, slot="slot": rows.select(F.lit(name).alias("fault"), F.col(slot).alias("slot"))
    found = one("namespace", other_namespace(nodes, "told", "namespace")).union(one("hash", hash_mismatch(edges, nodes), "child_slot"))
    return found.union(one("seen twice", seen_twice(edges.unionByName(again))))


def orphans(owned: DataFrame, kept: DataFrame, by: str = "slot") -> DataFrame:
    return owned.join(kept.select(by).distinct(), by, "left_anti")


def seen_twice(edges: DataFrame) -> DataFrame:
    """Slots with several parents."""
    return edges.groupBy(F.col("child_slot").alias("slot")).agg(F.count("*").alias("n")).where("n > 1")


def hash_mismatch(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pointers whose recorded hash isn't the child's."""
    return edges.join(nodes.select(F.col("slot").alias("child_slot"), "payload_hash"), "child_slot", "left").where("payload_hash is null or payload_hash <> child_hash").select("parent_slot", "child_slot")


def ranges(edges: DataFrame) -> DataFrame:
    """Each pointer with the keys that its child may hold: from its first key up to the next pointer's."""
    upper = F.lead("first_key").over(Window.partitionBy("parent_slot").orderBy("ord"))
    return edges.withColumn("upper", upper)


def out_of_range(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries (slot, key) outside the range of their node's pointer. The first child of a node has no lower bound."""
    r = ranges(edges).select(F.col("child_slot").alias("slot"), "first_key", "upper", "ord")
    low = (F.col("ord") > 0) & (F.col("key") < F.col("first_key"))
    return entries.join(r, "slot").where(low | F.coalesce(F.col("key") >= F.col("upper"), F.lit(False))).select("slot", "key")


def root_hash(roots: DataFrame) -> DataFrame:
    """The hash over all roots' hashes in the order of namespaces."""
    ordered = F.array_sort(F.collect_list(F.struct("namespace", "root_hash")))
    return roots.agg(F.sha2(F.unhex(F.array_join(F.transform(ordered, lambda r: r.root_hash), "")), 256).alias("tx_root_hash"))


def report(nodes: DataFrame, index: DataFrame) -> DataFrame:
    """One row: nodes and the commit verified, levels, entries, distinct batches."""
    a = nodes.agg((F.count("*") + 1).alias("chunks_verified"), F.max("level").alias("top"))
    b = index.agg(F.count("*").alias("entries"), F.count_distinct("namespace", "batch_id").alias("batches"))
    return a.join(F.broadcast(b)).select("chunks_verified", (F.col("top") + 1).alias("max_depth"), "entries", "batches")
