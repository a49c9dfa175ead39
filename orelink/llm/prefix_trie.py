"""Prefix trie of conversations by preorder intervals.

A node is a distinct sequence of first turns. Its key is 128 bits: two running XORs over 64-bit hashes of (place, role, text),
so a conversation of any length gets the keys of all its prefixes by running totals, without carrying texts or paths.

Lexicographic rank without long paths: among a node's members the conversation of the least hashed id leads it. A conversation leads
one stretch of consecutive depths and branches off the stretch of another; it is one row. Leaders change along a path about ln(members) times, since the
hash is as good as a random order, so a path of any depth is a short list (2 * depth + 1, branch, ..., 2 * depth), and these lists, sorted, are a preorder:
children that branch off come before the one that goes on. ``end`` of a node's subtree is its leader's, and leaves and savings of a subtree are
the prefix sum at its end minus that before its start.

Scale: numbering, prefix keys and prefix sums run over range partitions (``prefix.running``), so a conversation that holds a third of all turns
is many tasks; nodes are aggregated with map-side combine; joins on parents and leaders go through ``keyed_join``. Leader paths are found by
pointer doubling, in about log2(ln(conversations)) rounds. The ids that end at a node are joined in chunks of ``CHUNK`` ids by many tasks; only for nodes with more than
one chunk a task streams the chunks' bytes into SHA-256, which is sequential by nature, one chunk in memory at a time.

Defined cases: turns in the order of turn (null first), ties by hashes of role and text; null roles and texts are empty; rows that
repeat are turns that repeat; a negative conv_id groups with its remainder taken as SQL does (-3 % 100 = -3); rows of a null conv_id belong to no conversation and are left out; texts are hashed whole; other columns are ignored; an
empty table has no conversation and so no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import dropped, keyed_join, written
from orelink.llm.prefix import running

SEEDS = (17, 71)
CHUNK = 4096
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["x1", "x2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, m1, m2, chars): turns in order, each as two hashes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marks = [F.xxhash64(F.lit(seed), role, text).alias(f"m{i}") for i, seed in enumerate(SEEDS, 1)]
    turns = written(conversations.where("conv_id is not null").select("conv_id", "turn", *marks, F.char_length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("one")))
    placed = running(turns, ["turn", "m1", "m2"], {"pos": "one"}, key=("conv_id",))
    dropped(turns)
    return placed


def shared_prefixes(turns: DataFrame, group: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Numbered turns in which conversation c begins with the first h = crc32(c) % most turns of conversation c - c % group, and (conv_id, depth)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own")).select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
    heads = turns.where(F.col("pos") < most)  # fewer than ``most`` rows a conversation, joined by at most ``group`` others
    lengths = heads.groupBy("conv_id").agg(F.max("pos").alias("has")).withColumnRenamed("conv_id", "base")
    sizes = sizes.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("has", F.lit(0).cast("long"))))
    sizes = written(sizes.select("conv_id", "base", "h", "m", F.col("own").alias("_rows"), (F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("length")))
    own = keyed_join(turns, sizes, ["conv_id"]).where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("m"))
    lent = sizes.select("conv_id", "base", "m", "length").join(heads.withColumnRenamed("conv_id", "base"), "base").where("pos <= m").withColumn("depth", F.col("pos"))
    columns = ["conv_id", "depth", "length", "m1", "m2", "chars"]
    return own.select(*columns).unionByName(lent.select(*columns)), sizes


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns as they are, and (conv_id, length)."""
    sizes = written(turns.groupBy("conv_id").agg(F.count("*").alias("length")).withColumn("_rows", F.col("length")))
    return keyed_join(turns.withColumnRenamed("pos", "depth"), sizes, ["conv_id"]), sizes


def prefixes(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each conversation and prefix of it, the empty one included: its node's key, its parent's, and whether the conversation ends there."""
    steps = [F.xxhash64("depth", f"m{i}").alias(f"e{i}") for i in (1, 2)]
    steps = written(turns.select("conv_id", "depth", "length", "chars", *steps))
    keyed = running(steps, ["depth"], xors={"x1": "e1", "x2": "e2"}, key=("conv_id",))
    rows = keyed.select("conv_id", "depth", (F.col("depth") == F.col("length")).alias("ends"), "chars", "x1", "x2", F.col("x1").bitwiseXOR(F.col("e1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("e2")).alias("p2"))
    zero = F.lit(0).cast("long")
    roots = sizes.select("conv_id", zero.alias("depth"), (F.col("length") == 0).alias("ends"), zero.alias("chars"), zero.alias("x1"), zero.alias("x2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    out = written(rows.unionByName(roots))
    dropped(steps, keyed)
    return out


def distinct_nodes(rows: DataFrame) -> DataFrame:
    """One row a node: key, depth, members, smallest member, leader, saving, children, and the parent's conv_id, leader and key."""
    first = lambda c: F.min(c).alias(c)  # noqa: E731  equal in all rows of a node
    nodes = rows.groupBy("x1", "x2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("leader"), first("depth"), first("chars"), first("p1"), first("p2"))
    nodes = written(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")).drop("chars"))
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    counted = written(nodes.join(children, NODE, "left").fillna(0, ["n_children"]))
    parents = counted.where("n_children > 0").select(F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("leader").alias("parent_leader"), F.col("n_children").alias("_rows"))
    below = keyed_join(counted.where("p1 is not null"), parents, ["p1", "p2"])
    top = counted.where("p1 is null").withColumns({"parent_conv_id": F.lit(None).cast("long"), "parent_leader": F.lit(None).cast("long")})
    out = written(below.unionByName(top))
    dropped(nodes, counted)
    return out


def leader_paths(nodes: DataFrame) -> DataFrame:
    """(leader, led: number of nodes it leads, path): the path names the branches from the root's leader down, as (2 * depth + 1, leader) pairs."""
    led = nodes.groupBy("leader").agg(F.min(F.struct("depth", "parent_leader")).alias("head"), F.count("*").alias("led"))
    own = F.when(F.col("head.parent_leader").isNull(), F.array().cast("array<long>")).otherwise(F.array(F.col("head.depth") * 2 - 1, F.col("leader")))
    paths = written(led.select("leader", "led", F.col("head.parent_leader").alias("up"), own.alias("path")))
    while paths.where("up is not null").limit(1).count():
        asked = paths.where("up is not null").groupBy(F.col("up").alias("leader")).agg(F.count("*").alias("_rows"))
        above = written(paths.join(asked, "leader").select(F.col("leader").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"), "_rows"))
        longer = keyed_join(paths.where("up is not null"), above, ["up"]).select("leader", "led", F.col("next").alias("up"), F.concat("head", "path").alias("path"))
        paths, old = written(longer.unionByName(paths.where("up is null"))), paths
        dropped(old, above)
    return paths


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node, which come sorted; one node at a time."""
    at, state = None, None

    def out():
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([at[1]], pa.int64()), pa.array([state.hexdigest()])], ["x1", "x2", "ends_sha256"])

    for b in batches:
        for x1, x2, ids in zip(*(b.column(n).to_pylist() for n in ("x1", "x2", "ids"))):
            if at != (x1, x2):
                if at:
                    yield out()
                at, state = (x1, x2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if at:
        yield out()


def end_digests(rows: DataFrame) -> DataFrame:
    """(x1, x2, ends_sha256) for the nodes where conversations end."""
    ends = written(rows.where("ends").select("x1", "x2", "conv_id", F.lit(1).cast("long").alias("one")))
    placed = running(ends, ["conv_id"], {"n": "one"}, key=("x1", "x2"))
    chunk = F.expr(f"(n - 1) div {CHUNK}").alias("chunk")
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    chunks = written(placed.groupBy("x1", "x2", chunk).agg(ids.alias("ids"), F.count("*").alias("many")))
    single = chunks.where(f"chunk = 0 and many < {CHUNK}").select("x1", "x2", F.sha2(F.col("ids").cast("binary"), 256).alias("ends_sha256"))
    hot = chunks.where(f"many = {CHUNK} or chunk > 0").repartition("x1", "x2").sortWithinPartitions("x1", "x2", "chunk").select("x1", "x2", "ids")
    out = written(single.unionByName(hot.mapInArrow(_digests, "x1 long, x2 long, ends_sha256 string")))
    dropped(ends, placed, chunks)
    return out


def trie(conversations: DataFrame, group: int | None = None, most: int = 0) -> DataFrame:
    """A row for each node; with ``group``, of conversations rebuilt by ``shared_prefixes``.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, start and
    end (preorder interval of the subtree, from 1).
    """
    turns = numbered(conversations)
    built, sizes = shared_prefixes(turns, group, most) if group else whole(turns)
    rows = prefixes(built, sizes)
    nodes, digests = distinct_nodes(rows), end_digests(rows)
    found = leader_paths(nodes)
    paths = found.select("leader", "path", F.col("led").alias("_rows"))
    keyed = keyed_join(nodes, paths, ["leader"])
    leaf, one = (F.col("n_children") == 0).cast("long"), F.lit(1).cast("long")
    sorted_by = written(keyed.select("*", F.concat("path", F.array(F.col("depth") * 2)).alias("rank_key"), leaf.alias("leaf"), one.alias("one")).drop("path"))
    placed = running(sorted_by, ["rank_key"], {"start": "one", "leaves": "leaf", "savings": "saved"})
    # a leader's block holds its own stretch and the blocks that branch off: every leader counts for all on its path
    chain = F.flatten(F.array(F.array("leader"), F.filter("path", lambda x, i: i % 2 == 1), F.array("top")))
    top = nodes.where("p1 is null").select(F.col("leader").alias("top"))  # one row
    blocks = paths.crossJoin(F.broadcast(top)).select(F.explode(F.array_distinct(chain)).alias("leader"), "_rows")
    begins = placed.groupBy("leader").agg(F.min("start").alias("begin"), F.count("*").alias("led"))
    ends = blocks.groupBy("leader").agg(F.sum("_rows").alias("block")).join(begins, "leader").select("leader", (F.col("begin") + F.col("block") - 1).alias("end"), F.col("led").alias("_rows"))
    at_end = placed.select(F.col("start").alias("end"), F.col("leaves").alias("leaves_end"), F.col("savings").alias("savings_end"))
    ends = written(ends.join(at_end, "end"))
    closed = keyed_join(placed, ends, ["leader"])
    full = closed.join(digests, NODE, "left")
    out = full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves_end") - F.col("leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("savings_end") - F.col("savings") + F.col("saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "start", "end",
    )
    result = written(out)
    dropped(turns, sizes, rows, nodes, found, sorted_by, placed, ends, digests)
    return result
