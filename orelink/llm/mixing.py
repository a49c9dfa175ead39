"""Mixing sources to target weights by weighted fair queueing, with built-in columns only.

A document's size is its number of words ``[^\\x20\\x09-\\x0D]+``. Sources share a budget of ``share`` times all sizes by weight; a
source's target stops at ``repeats`` times its own size, and what is left over is shared by weight among the others, until no
target is above. Each source plays its documents in a shuffled order, ``repeats`` times over. A document's virtual finish time is
the words its source has played by then, divided by the source's target; all documents are sorted by it globally and the
budget ends the mix. Documents over ``PACKET`` words queue as packets of that size, each with a finish time of its own, so that one very long
document neither holds up its source nor overshoots its target: a source's words end within a packet of its target, and the mix holds
exactly the budget.

Targets without a loop: sources in the order of (``repeats`` * size / weight) are full up to the first one whose limit is above the
share that the budget left by the full ones gives it.

Scale: the shuffle key is an MD5 of id, text and seed; running totals (``prefix.running``) sort narrow rows by range, so neither a hot source
nor copies make a large task; a source's totals join by ``keyed_join``. Texts are read once, to count; only the columns named in
``carry`` travel. The two sorts hold a row for each document and ``repeats`` rows for each packet.

Defined cases: a null or empty text has size 0 and gives nothing; a null source is a source, the last; a null doc_id is an id like
others; rows that repeat are documents of their own, and tie: which of them gives more words is open, the rows of the result are
not; if all sizes are 0, all targets are 0; empty tables give none; columns not in ``carry`` are ignored, those in ``carry`` keep their
names, but for names as in ``OWN``, which raise an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelink.llm.common import dropped, keyed_join, written
from orelink.llm.prefix import running

PACKET = 1024
SEED = "mix"
OWN = ("size", "source_size", "target", "taken", "starts", "finish", "_row", "_source", "_key", "_part")
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def sized(docs: DataFrame, carry: tuple[str, ...], seed: str) -> DataFrame:
    """carry, size, _source (a text that sorts null sources last), _key (place in the shuffle), _row (a number of its own)."""
    if clash := set(carry) & set(OWN):
        raise ValueError(f"columns named {sorted(clash)} cannot be carried")
    text = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t"))
    return written(docs.select(*carry, F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), source.alias("_source"), key.alias("_key"), F.monotonically_increasing_id().alias("_row")))


def targets(rows: DataFrame, weights: tuple[int, ...], share: tuple[int, int], repeats: int) -> DataFrame:
    """(_source, source_size, target, _base, _rows) for each source of ``sized`` rows; _base: words of the sources before it."""
    sizes = written(rows.groupBy("_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"), F.lit(1).cast("long").alias("one")))
    ranked = running(sizes, ["_source"], {"rank": "one", "upto": "source_size"})
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    weighed = ranked.withColumn("weight", F.get(cycle, (F.col("rank") - 1) % len(weights))).withColumn("limit", repeats * F.col("source_size"))
    weighed = written(weighed.withColumn("fills_at", F.col("limit") / F.col("weight")))
    filled = running(weighed, ["fills_at", "_source"], {"limits": "limit", "weights": "weight"})
    whole = filled.agg(F.sum("source_size").alias("total"), F.sum("weight").alias("all_weights"))  # one row
    both = filled.crossJoin(F.broadcast(whole))
    a, b = share  # the budget is a/b of all sizes; amounts are kept times b, so that one division is left
    left, heft = a * F.col("total") - b * (F.col("limits") - F.col("limit")), F.col("all_weights") - (F.col("weights") - F.col("weight"))
    both = both.withColumn("left", left).withColumn("heft", heft)
    open_ = both.where(F.col("limit").cast("double") * b * F.col("heft") >= F.col("left").cast("double") * F.col("weight"))
    level = open_.agg(F.min_by(F.struct("left", "heft"), F.struct("fills_at", "_source")).alias("at"))  # one row: the first source that is not filled
    target = F.when(F.col("at").isNull(), F.col("limit").cast("double")).otherwise(
        F.least(F.col("limit").cast("double"), F.col("at.left").cast("double") * F.col("weight") / (b * F.col("at.heft")))
    )
    out = written(filled.crossJoin(F.broadcast(level)).select("_source", "source_size", target.alias("target"), (F.col("upto") - F.col("source_size")).alias("_base"), "_rows"))
    dropped(sizes, ranked, weighed, filled)
    return out


def mix(docs: DataFrame, weights: tuple[int, ...], share: tuple[int, int] = (3, 2), repeats: int = 2, carry: tuple[str, ...] = ("doc_id", "source"), seed: str = SEED) -> DataFrame:
    """``carry`` of every document plus size, source_size, target (of its source), taken (words of it in the mix, repeats counted),
    finish (virtual finish time of its first whole play) and starts (words of the mix ahead of its first; null: not in the mix).

    ``share`` is the budget over all sizes, as a fraction of two integers.
    """
    rows = sized(docs, carry, seed)
    goals = targets(rows, weights, share, repeats)
    queued = written(keyed_join(rows.select("_source", "_key", "_row", "size"), goals, ["_source"]))
    played = running(queued, ["_source", "_key", "_row"], {"upto": "size"})
    end = F.col("upto") - F.col("_base")
    first = F.col("_pass") * F.col("source_size") + end - F.col("size")
    plays = played.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("_pass"))
    packets = plays.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {PACKET}"))).alias("_packet"))
    done = F.least(F.col("size"), (F.col("_packet") + 1) * PACKET)
    packets = written(packets.select("_row", "_source", "_key", (done - F.col("_packet") * PACKET).alias("words"), (first + done).alias("play"), ((first + done) / F.col("target")).alias("finish")))
    line = running(packets, ["finish", "_source", "play", "_row"], {"upto": "words"})
    budget = goals.agg(F.floor(share[0] * F.sum("source_size") / share[1]).cast("long").alias("budget"))  # one row
    start = F.col("upto") - F.col("words")
    cut = line.crossJoin(F.broadcast(budget)).where(start < F.col("budget")).select("_row", start.alias("start"), F.least(F.col("words"), F.col("budget") - start).alias("words"))
    taken = cut.groupBy("_row").agg(F.sum("words").alias("taken"), F.min("start").alias("starts"))
    facts = played.select("_row", "source_size", "target", F.try_divide(end, F.col("target")).alias("finish"))
    out = rows.join(facts, "_row").join(taken, "_row", "left")
    out = written(out.select(*carry, "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "finish", "starts"))
    dropped(rows, goals, queued, played, packets, line)
    return out
