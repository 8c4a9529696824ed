"""Prefix trie of conversations by an Euler tour: shared turns and what sharing saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebars.llm.list_ranking import IN_ONE_TASK, list_ranks
from tidebars.llm.running import running_totals
from tidebars.llm.sharding import row_numbers
from tidebars.session import stage

FAMILY, MOST_SHARED = 5, 9
IDS_A_CHUNK = 4096
NODE = ["depth", "p1", "p2"]
ABOVE = ["up_depth", "q1", "q2"]


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % MOST_SHARED


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, k1, k2, bytes, one``: each turn by hashes of role and text. Missing
    roles and texts count as empty ones; turns of no conversation are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(role, text).alias("k1"), F.xxhash64(F.lit(1), role, text).alias("k2"),
        F.octet_length(text).cast("long").alias("bytes"), F.lit(1).cast("long").alias("one"),
    )


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, part, place, k1, k2, bytes, one``: the first h turns of the first conversation
    of the family (part 0), then a conversation's own turns after its first h (part 1)."""
    own = stage(running_totals(turns, "conv_id", ["turn", "k1", "k2"], ["one"]).withColumnRenamed("one_sum", "place"))
    head = own.filter(F.col("place") < MOST_SHARED).withColumnRenamed("conv_id", "first")
    ids = own.select("conv_id").distinct().withColumns({"first": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": shared_turns(F.col("conv_id"))})
    what = ["place", "k1", "k2", "bytes", "one"]
    given = ids.join(head, "first").filter("place <= h").select("conv_id", F.lit(0).alias("part"), *what)
    kept = own.filter(F.col("place") > shared_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), *what)
    return given.unionAll(kept)


def prefix_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, p1, p2, up_depth, q1, q2, bytes`` of every prefix (one turn and more)
    of every sequence in ``turns`` (``conv_id, part, place, k1, k2, bytes, one``).

    A prefix is known by its depth and 128 bits: the exclusive or of one hash of (depth,
    turn) for each of its turns, so that long conversations are run over in parallel and
    the prefix one turn shorter (q1, q2) needs no look-up.
    """
    deep = running_totals(turns, "conv_id", ["part", "place"], ["one"]).withColumnRenamed("one_sum", "depth")
    hashed = stage(deep.select("conv_id", "depth", "bytes", F.xxhash64("depth", "k1", "k2").alias("p1"), F.xxhash64(F.lit(2), "depth", "k1", "k2").alias("p2")))
    run = running_totals(hashed, "conv_id", ["depth"], xors=["p1", "p2"])
    return run.select(
        "conv_id", "depth", F.col("p1_sum").alias("p1"), F.col("p2_sum").alias("p2"), (F.col("depth") - 1).alias("up_depth"),
        F.col("p1_sum").bitwiseXOR(F.col("p1")).alias("q1"), F.col("p2_sum").bitwiseXOR(F.col("p2")).alias("q2"), "bytes",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the joined chunks of each node; rows come node by node, in order."""
    node, state = None, None
    names = [*NODE, "ends_sha256"]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([v]) for v in node], pa.array([state.hexdigest()])], names=names)

    for batch in batches:
        done = []
        for *key, chunk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != node:
                if node:
                    done.append(row())
                node, state = key, hashlib.sha256(chunk.encode())
            else:
                state.update(f",{chunk}".encode())
        yield from done
    if node:
        yield row()


def end_digests(ends: DataFrame) -> DataFrame:
    """``depth, p1, p2, ends_sha256`` from ``conv_id`` and node of every conversation's last turn.

    Ids are first joined in chunks of a range of ids each; the chunks of a node are then
    hashed one after another, in bounded memory however many conversations end there.
    """
    chunks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / IDS_A_CHUNK).alias("chunk")).agg(F.array_sort(F.collect_set("conv_id")).alias("ids"))
    joined = chunks.select(*NODE, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    ordered = joined.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").select(*NODE, "ids")
    return ordered.mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")


def trie_nodes(prefixes: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """``depth, p1, p2, up_depth, q1, q2, conv_id, n_convs, bytes`` of every node, the root with them."""
    what = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes")]
    nodes = prefixes.groupBy(*NODE, *ABOVE).agg(*what)
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = conv_ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], *[none.alias(c) for c in ABOVE], "conv_id", "n_convs", zero.alias("bytes"))
    return nodes.unionByName(root)


def subtree_sums(nodes: DataFrame, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``nodes`` with ``parent_conv_id, n_children, n_leaves, saved_tokens``.

    Nodes are numbered by (parent, key), so siblings follow one another. Each has an arc
    that enters it and one that leaves it; every arc finds the next of the Euler tour
    from its node, its parent and the parent's children. The tour is list-ranked, leaves
    and savings are summed along it, and what lies between a node's two arcs is its subtree.
    """
    numbered, _ = row_numbers(nodes, [*ABOVE, "p1", "p2"])
    numbered = stage(numbered.withColumnRenamed("row_number", "i"))
    kids = numbered.filter("up_depth IS NOT NULL").groupBy(*ABOVE).agg(F.min("i").alias("first"), F.count("*").alias("n_children"))
    kids = kids.toDF(*NODE, "first", "n_children")
    numbered = stage(numbered.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    # the node, not the parent, may be one of a third of all rows: Spark splits that side
    parents = numbered.filter("n_children > 0").select(
        *[F.col(c).alias(a) for c, a in zip(NODE, ABOVE, strict=True)], F.col("i").alias("above"), F.col("conv_id").alias("parent_conv_id"),
        F.col("first").alias("eldest"), (F.col("first") + F.col("n_children") - 1).alias("youngest"),
    )
    placed = stage(numbered.join(parents, ABOVE, "left"))
    enter, leave = F.col("i") * 2, F.col("i") * 2 + 1
    inner = F.col("n_children") > 0
    own = F.col("n_children") == 0
    saved = (F.col("n_convs") - 1) * F.col("bytes")
    none = F.lit(None).cast("long")
    entering = placed.select(
        enter.alias("id"), F.when(F.col("i") == F.col("eldest"), F.col("above") * 2).when(F.col("above").isNotNull(), enter - 1).otherwise(none).alias("prev"),
        F.when(inner, F.col("first") * 2).otherwise(leave).alias("next"), own.cast("long").alias("leaf"), saved.alias("saved"),
    )
    leaving = placed.select(
        leave.alias("id"), F.when(inner, (F.col("first") + F.col("n_children") - 1) * 2 + 1).otherwise(enter).alias("prev"),
        F.when(F.col("i") == F.col("youngest"), F.col("above") * 2 + 1).when(F.col("above").isNotNull(), enter + 2).otherwise(none).alias("next"),
        F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"),
    )
    arcs = stage(entering.unionAll(leaving))
    ranks = list_ranks(arcs.select("id", "prev", "next"), in_one_task)
    tour = stage(arcs.join(ranks, "id").select("id", "rank", "leaf", "saved", F.lit(0).cast("long").alias("tour")))
    summed = running_totals(tour, "tour", ["rank"], ["leaf", "saved"])
    leaves = F.col("id") % 2 == 1
    between = lambda c: F.sum(F.when(leaves, F.col(f"{c}_sum")).otherwise(F.col(c) - F.col(f"{c}_sum")))
    subtree = summed.groupBy(F.expr("id div 2").alias("i")).agg(between("leaf").alias("n_leaves"), between("saved").alias("saved_tokens"))
    return placed.join(subtree, "i")


def conversation_trie(conversations: DataFrame, rebuild: bool = True, in_one_task: int = IN_ONE_TASK) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``
    of every node of the trie of all conversations.

    Turns (``conv_id, turn, role, text``) are taken in order of turn, a missing turn first, turns
    of the same number in order of their hashes. With ``rebuild`` each conversation begins with
    turns of the first of its family (``rebuilt_turns``). Turns without a conversation
    are left out. A conversation without any turn left ends at the root. An empty table
    gives no rows; other columns are ignored.
    """
    turns = stage(turn_rows(conversations))
    parts = rebuilt_turns(turns) if rebuild else running_totals(turns, "conv_id", ["turn", "k1", "k2"], ["one"]).select(
        "conv_id", F.lit(0).alias("part"), F.col("one_sum").alias("place"), "k1", "k2", "bytes", "one"
    )
    prefixes = stage(prefix_rows(stage(parts)))
    ids = stage(turns.select("conv_id").distinct())
    nodes = stage(trie_nodes(prefixes, ids))
    last = prefixes.groupBy("conv_id").agg(F.max("depth").alias("depth"))
    last = ids.join(last, "conv_id", "left").select("conv_id", F.coalesce("depth", F.lit(0)).alias("depth"))
    ends = last.join(prefixes.select("conv_id", "depth", "p1", "p2"), ["conv_id", "depth"], "left")
    ends = ends.select("conv_id", "depth", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p1", "p2")])
    found = subtree_sums(nodes, in_one_task).join(end_digests(ends), NODE, "left")
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
