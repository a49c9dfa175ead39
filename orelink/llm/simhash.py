"""SimHash near-duplicate groups by covering locality-sensitive hashing.

Words are runs outside ``[\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased; features are 3-word
shingles with repeats (fewer words: the whole sequence; none: fingerprint 0). Two fingerprints link
when they differ in at most two bits. Seven structured masks cover that radius: bit ``i`` carries the
non-zero vector ``m(i)`` of GF(2)^3 and mask ``v`` holds the bits with ``<m(i), v> = 1``. Any two
differing bits leave a non-zero ``v`` orthogonal to both, so the pair agrees under mask ``v``.

Scale: equal fingerprints collapse (with map-side partial aggregation) before anything is joined, so
a group of exact copies is one node. Buckets of at most ``PAIR_BUCKET`` nodes compare their pairs. In a larger bucket
two nodes can only differ in the bits that its mask leaves out, so seven masks over these bits split it, and once more
where that is not enough: 28 bits are left out at first, then 12, then 6, so that at the third level a bucket holds 64
nodes at most. Components are contracted in rounds; fingerprints of more than a thousandth of the rows are joined by broadcast.

Defined cases: a null text is empty; a null ``doc_id`` gets a row, links like others, and never names
a component unless all ids of the component are null (then it is null); rows that repeat stay, one
result row each; empty tables give empty results; other columns are ignored. ``representatives`` keeps one row
of every component, those without any id included; rows that share a doc_id are told apart by their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import as_bytes, dropped, keyed_join, texts, written

RADIUS = 2
BITS = 64
PAIR_BUCKET = 32
LEVELS = 3
SHINGLE = 3


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of one text."""
    words = text.lower().split()  # bytes.lower and bytes.split know ASCII only: A-Z and [\x20\x09-\x0D]
    if not words:
        return 0
    grams = map(b" ".join, zip(words, words[1:], words[2:])) if len(words) >= SHINGLE else [b" ".join(words)]
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        marks = np.fromiter(map(fingerprint, as_bytes(b, "text")), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("body"), pa.array(marks.view(np.int64))], ["doc_id", "body", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, body, fp): one row per document; ``fp`` holds the 64 bits as a signed long, ``body`` a hash of the text."""
    return texts(docs).withColumn("body", F.xxhash64("text")).mapInArrow(_fingerprints, "doc_id long, body long, fp long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def split_masks(bits: list[int]) -> list[list[int]]:
    """For each non-zero v of GF(2)^3 the bits among ``bits`` that its mask holds; two bits of ``bits`` are both left out by some v."""
    return [[b for j, b in enumerate(bits) if ((j % 7 + 1) & v).bit_count() % 2] for v in range(1, 2 ** (RADIUS + 1))]


def mask_tree() -> list[list[int]]:
    """The masks of each level as signed longs: 7, 49 and 343, child k of mask m at 7 * m + k; a child's mask includes its parent's."""
    levels, held = [], [[]]
    for _ in range(LEVELS):
        held = [h + more for h in held for more in split_masks([b for b in range(BITS) if b not in h])]
        levels.append([_signed(sum(1 << b for b in h)) for h in held])
    return levels


def links(nodes: DataFrame) -> DataFrame:
    """(u, v): the pairs of distinct fingerprints ``fp`` of ``nodes`` within the radius, u < v."""
    tables, found = [], []
    left = nodes.select("fp", F.lit(0).alias("mask"))
    for level, masks in enumerate(mask_tree()):
        cover = F.array(*[F.lit(m) for m in masks])
        children = F.transform(F.sequence(F.col("mask") * 7, F.col("mask") * 7 + 6), lambda m: F.struct(m.alias("mask"), F.col("fp").bitwiseAND(F.get(cover, m)).alias("key")))
        keyed = left.select("fp", F.explode(children).alias("k")).select("fp", "k.*").distinct()
        shared = written(keyed.groupBy("mask", "key").agg(F.count("*").alias("size")).where("size > 1"))
        members = written(keyed.join(shared, ["mask", "key"]))
        small = members if level == LEVELS - 1 else members.where(F.col("size") <= PAIR_BUCKET)
        pairs = small.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).select(F.explode("fps").alias("u"), "fps").select("u", F.explode("fps").alias("v"))  # PAIR_BUCKET or 64 at most
        found.append(pairs.where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)))
        left = members.where(F.col("size") > PAIR_BUCKET).select("fp", "mask")
        tables += [shared, members]
        if left.isEmpty():
            break
    edges = written(reduce(DataFrame.unionByName, found).distinct())
    dropped(*tables)
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v), by contraction.

    Each round every node joins the neighbour of least priority, a hash drawn anew per round, and edges
    move to the joined nodes; the nodes left shrink by a constant factor, whatever the shape.
    """
    edges = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    roots, rounds = None, 0
    while not edges.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(rounds), c).alias("p"), F.col(c).alias("to"))  # noqa: B023, E731
        step = written(
            edges.groupBy("u")
            .agg(F.min(rank("v")).alias("least"))
            .select("u", F.least("least", F.struct(F.xxhash64(F.lit(rounds), "u").alias("p"), F.col("u").alias("to")))["to"].alias("to"))
        )
        moved = edges.join(step, "u").select(F.col("to").alias("nu"), "v")
        moved = written(moved.join(step.select(F.col("u").alias("v"), F.col("to").alias("nv")), "v").where("nu <> nv").select(F.col("nu").alias("u"), F.col("nv").alias("v")).distinct())
        if roots is None:
            new = step.select(F.col("u").alias("node"), F.col("to").alias("root"))
            new._orelink_path = step._orelink_path
        else:
            new = written(roots.join(step, roots["root"] == step["u"], "left").select("node", F.coalesce("to", "root").alias("root")))
            dropped(roots, step)
        dropped(edges)
        edges, roots, rounds = moved, new, rounds + 1
    if roots is None:
        roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        roots._orelink_path = edges._orelink_path
    else:
        dropped(edges)
    return roots


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, body, fp, root, component_id): ``root`` is a fingerprint that stands for the component."""
    marks = written(fingerprints(docs))
    nodes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_rows")))
    edges = links(nodes)
    roots = components(edges)
    rooted = written(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "_rows", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(ids, "root").select("fp", "root", "component_id", "_rows"))
    dropped(nodes, edges, roots, rooted)
    return keyed_join(marks, named, ["fp"]).select("doc_id", "body", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    return _grouped(docs).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component: that of its smallest doc_id, of its smallest text hash among equals.

    Rows that agree in both are one row if all their columns agree; else that of the least columns in order stays.
    Columns named like ``key`` below are not kept.
    """
    key = ["_rep_id", "_rep_null", "_rep_body"]  # no null among them, so that the join and the grouping share a shuffle
    named = lambda doc_id, body: (F.coalesce(doc_id, F.lit(0)).alias(key[0]), doc_id.isNull().alias(key[1]), body.alias(key[2]))
    least = _grouped(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "body")).alias("r"))
    keep = written(least.select(*named(F.col("r.doc_id"), F.col("r.body"))))
    docs = docs.drop(*key)
    keyed = docs.select(*docs.columns, *named(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))))
    return keyed.join(keep, key, "left_semi").groupBy(*key).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*[c for c in docs.columns if c != "text"]))).alias("r")).select("r.*")
