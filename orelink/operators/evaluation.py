"""Evaluation of matcher decisions against labelled pairs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = ("MATCH", "NEEDS_REVIEW", "NOT_A_MATCH")


def decision_class(decision):
    """Decision state -> evaluation class; weak evidence counts as a review."""
    return F.when(decision == "HIGH_CONFIDENCE_MATCH", "MATCH").when(decision.isin("NEEDS_TECHNICAL_REVIEW", "LOW_CONFIDENCE"), "NEEDS_REVIEW").otherwise("NOT_A_MATCH")


def _pairs(n: str):
    return F.floor(F.col(n) * (F.col(n) - 1) / 2).cast("long")


def group_links(groups: DataFrame) -> DataFrame:
    """(group_id, member, head, pairs): each member with its group's least member, and how many pairs the group stands for."""
    sizes = groups.groupBy("group_id").agg(F.min("member").alias("head"), F.count("*").alias("_n"))
    return groups.join(sizes, "group_id").select("group_id", "member", "head", _pairs("_n").alias("pairs"))


def _ratios(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and F1 to tp, fp and fn; 0 where undefined."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = counts.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def clustered(groups: DataFrame, clusters: DataFrame) -> DataFrame:
    """groups: (group_id, member), each member once; clusters: (cluster, member), each once. One row: pairs of members counted as same group against same cluster.

    Every count is a sum of n (n - 1) / 2 over groups, clusters or both, so no pair is made. Members without a cluster are ``skipped``.
    """
    both = groups.join(clusters, "member", "left")
    known = both.where("cluster is not null")
    cells = known.groupBy("group_id", "cluster").agg(F.count("*").alias("n"))
    sums = lambda name, key: cells.groupBy(key).agg(F.sum("n").alias("_n")).agg(F.coalesce(F.sum(_pairs("_n")), F.lit(0)).alias(name))
    tp = cells.withColumnRenamed("n", "_n").agg(F.coalesce(F.sum(_pairs("_n")), F.lit(0)).alias("tp"))
    all_ = both.agg(F.count("cluster").alias("_n"), F.count_if(F.col("cluster").isNull()).alias("skipped")).select(_pairs("_n").alias("evaluated"), "skipped")
    row = tp.crossJoin(sums("positives", "group_id")).crossJoin(sums("predicted", "cluster")).crossJoin(all_)  # one row each
    fp, fn = F.col("predicted") - F.col("tp"), F.col("positives") - F.col("tp")
    return _ratios(row.select("evaluated", "skipped", "positives", "tp", fp.alias("fp"), (F.col("evaluated") - F.col("tp") - fp - fn).alias("tn"), fn.alias("fn")))


def evaluated(groups: DataFrame, conflicts: DataFrame, decided: DataFrame, records: DataFrame) -> DataFrame:
    """The matcher's decisions against labelled groups (their pairs should match) and conflict pairs (they should not). One row.

    groups: (group_id, member), a member in several groups at most once each; conflicts: (a, b), each pair once; decided: (a, b, state), each
    pair once and a < b; records: (member). Pairs of a record that is absent are skipped. A pair that was never decided is no match. Pairs of groups are counted, those decided are
    looked up by equal group; none is listed.
    """
    there = groups.join(records.select("member"), "member", "left_semi")
    total = lambda rows, name: rows.groupBy("group_id").agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(_pairs("_n")), F.lit(0)).alias(name))
    side = lambda s: there.select(F.col("member").alias(s), F.col("group_id").alias(f"_{s}"))
    high, review = F.col("state") == "HIGH_CONFIDENCE_MATCH", F.col("state") == "NEEDS_TECHNICAL_REVIEW"
    same = decided.join(side("a"), "a").join(side("b"), "b").where("_a = _b").agg(F.count_if(high).alias("tp"), F.count_if(review).alias("_reviewed"))
    asked = conflicts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    known = asked.join(records.select(F.col("member").alias("a")), "a", "left_semi").join(records.select(F.col("member").alias("b")), "b", "left_semi")
    said = known.join(decided, ["a", "b"], "left").agg(F.count("*").alias("negatives"), F.count_if(high).alias("fp"), F.count_if(review).alias("_held"))
    row = total(there, "positives").crossJoin(total(groups, "_all")).crossJoin(same).crossJoin(said).crossJoin(asked.agg(F.count("*").alias("_asked")))  # one row each
    pairs = F.col("positives") + F.col("negatives")
    out = row.select(
        pairs.alias("evaluated"), "positives", "negatives", "tp", "fp", (F.col("negatives") - F.col("fp")).alias("tn"), (F.col("positives") - F.col("tp")).alias("fn"),
        F.coalesce(F.try_divide(F.col("_reviewed") + F.col("_held"), pairs), F.lit(0.0)).alias("review_rate"), (F.col("negatives") - F.col("fp")).alias("conflicts_caught"), F.col("fp").alias("unsafe_matches"),
        (F.col("_all") - F.col("positives") + F.col("_asked") - F.col("negatives")).alias("skipped"),
    )
    return _ratios(out)


def binary(pairs: DataFrame) -> DataFrame:
    """pairs: truth, predicted (booleans). Confusion counts and ratios (0 where undefined)."""
    t, p = F.col("truth"), F.col("predicted")
    return _ratios(pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn")))


def confusion(pairs: DataFrame) -> DataFrame:
    """pairs: ground_truth, predicted (classes). One row for each truth class, a column for each prediction."""
    return pairs.groupBy("ground_truth").pivot("predicted", list(CLASSES)).count().fillna(0)


def per_class(pairs: DataFrame) -> DataFrame:
    """Precision, recall, F1 (4 decimals) and support of every class that occurs as truth."""
    counts = pairs.groupBy("ground_truth", "predicted").agg(F.count("*").alias("n"))
    truth = counts.groupBy(F.col("ground_truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("ground_truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    said = counts.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted"))
    out = truth.join(said, "class", "left").fillna(0, ["predicted"])
    four = lambda x: F.round(F.coalesce(x, F.lit(0.0)), 4)
    return out.select("class", "support", "tp", "predicted", four(F.try_divide("tp", "predicted")).alias("precision"), four(F.try_divide("tp", "support")).alias("recall"), four(F.try_divide(2 * F.col("tp"), F.col("predicted") + F.col("support"))).alias("f1"))


def overall(classes: DataFrame) -> DataFrame:
    """Accuracy, macro and weighted F1 of ``per_class`` rows."""
    return classes.agg(
        F.round(F.try_divide(F.sum("tp"), F.sum("support")), 4).alias("accuracy"), F.round(F.avg("f1"), 4).alias("macro_f1"), F.round(F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")), 4).alias("weighted_f1")
    )


def dataset_problems(pairs: DataFrame) -> DataFrame:
    """pairs: pair_id, a, b, ground_truth as "ORG|CODE" texts. Malformed, self, same-organization, repeated or mislabelled pairs."""
    form = r"^[^|]+\|[^|]+$"
    key = F.concat_ws("~", F.least("a", "b"), F.greatest("a", "b"))
    repeated = pairs.groupBy(key.alias("key")).agg(F.min("pair_id").alias("first"))
    checked = pairs.withColumn("key", key).join(repeated, "key")
    problem = (
        F.when(~F.col("a").rlike(form) | ~F.col("b").rlike(form), "malformed")
        .when(F.col("a") == F.col("b"), "self_pair")
        .when(F.substring_index("a", "|", 1) == F.substring_index("b", "|", 1), "same_organization")
        .when(~F.col("ground_truth").isin(*CLASSES), "bad_label")
        .when(F.col("pair_id") > F.col("first"), "duplicate_pair")
    )
    return checked.select("pair_id", problem.alias("problem")).where("problem is not null")


def score_ranges(scored: DataFrame) -> DataFrame:
    """scored: predicted, score. Least and largest score of each predicted class."""
    return scored.groupBy("predicted").agg(F.min("score").alias("low"), F.max("score").alias("high"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """Pairs of classes (in the order of CLASSES) whose score ranges meet; ``ranges`` has a row for each class."""
    rank = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("predicted"))
    a = ranges.select(F.col("predicted").alias("a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), rank.alias("rank_a"))
    b = ranges.select(F.col("predicted").alias("b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"), rank.alias("rank_b"))
    return a.join(b, (F.col("rank_a") < F.col("rank_b")) & (F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))).select("a", "b")


def by_category(pairs: DataFrame, enough: int = 8) -> DataFrame:
    """pairs: category, ground_truth, predicted. Agreement (4 decimals) and whether the sample suffices."""
    out = pairs.groupBy("category").agg(F.count("*").alias("pairs"), F.count_if(F.col("ground_truth") == F.col("predicted")).alias("agreed"))
    return out.select("category", "pairs", F.round(F.col("agreed") / F.col("pairs"), 4).alias("agreement"), (F.col("pairs") >= enough).alias("sufficient"))


def conflict_rate(pairs: DataFrame) -> DataFrame:
    """pairs: conflict_expected, conflict_attribute, conflict_detected. Over pairs that declare an expectation."""
    asked = pairs.where("conflict_expected is not null and conflict_attribute is not null")
    out = asked.agg(F.count("*").alias("expected"), F.count_if("conflict_detected").alias("detected"))
    return out.withColumn("rate", F.round(F.coalesce(F.try_divide("detected", "expected"), F.lit(0.0)), 4))


def runs(pairs: DataFrame) -> DataFrame:
    """pairs: run_id, ground_truth, predicted. The record of each run: accuracy, wrong matches, missed matches, review rate."""
    truth, said = F.col("ground_truth"), F.col("predicted")
    out = pairs.groupBy("run_id").agg(
        F.count("*").alias("pairs"), F.count_if(truth == said).alias("agreed"), F.count_if((truth == "NOT_A_MATCH") & (said == "MATCH")).alias("false_positives"),
        F.count_if((truth == "MATCH") & (said == "NOT_A_MATCH")).alias("false_negatives"), F.count_if(said == "NEEDS_REVIEW").alias("reviews"),
    )
    return out.select("run_id", "pairs", F.round(F.col("agreed") / F.col("pairs"), 4).alias("accuracy"), "false_positives", "false_negatives", F.round(F.col("reviews") / F.col("pairs"), 4).alias("review_rate"))


def inconsistent_runs(recorded: DataFrame, pairs: DataFrame) -> DataFrame:
    """Recorded runs whose figures are not those that their pairs give: (run_id, problem)."""
    fresh = runs(pairs).select("run_id", *[F.col(c).alias(f"_{c}") for c in ("pairs", "accuracy", "false_positives", "false_negatives")])
    both = recorded.join(fresh, "run_id", "left")
    problem = F.when(F.col("_pairs").isNull(), "no_pairs")
    for c in ("pairs", "accuracy", "false_positives", "false_negatives"):
        problem = problem.when(F.abs(F.col(c) - F.col(f"_{c}")) > 1e-9, c)
    return both.select("run_id", problem.alias("problem")).where("problem is not null")


def config_fingerprint(config: dict) -> str:
    """cfg- and six hex digits: 32-bit FNV-1a over the UTF-16 units of the settings' compact JSON, keys in their own order."""
    h = 0x811C9DC5
    units = json.dumps(config, separators=(",", ":"), ensure_ascii=False).encode("utf-16-le")
    for at in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[at : at + 2], "little")) * 0x01000193 & 0xFFFFFFFF
    return f"cfg-{h:08x}"[:10]


def mirrored(runs: DataFrame, path: str) -> None:
    """Adds evaluation runs to a folder of JSON lines; earlier runs stay as they are."""
    runs.write.mode("append").json(path)
