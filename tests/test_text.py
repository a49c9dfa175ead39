"""Goldens of the text and matching expressions."""

import random

from pyspark.sql import functions as F

from orelink.functions import similarity as S
from orelink.functions import text as T
from orelink.operators import matching as M


def column(spark, values, expression, kind="s string"):
    rows = spark.createDataFrame([(v,) for v in values], kind)
    return [r[0] for r in rows.select(expression(F.col("s"))).collect()]


def test_normalize(spark):
    given = ["skf brg 6205-2RS", "Motor 75KW, 415volts 3PH", "PUMP 8X6-11", "7.5KW", "", None, "VLV 6in 600#"]
    assert column(spark, given, T.normalize) == ["SKF BEARING 6205-2RS", "MOTOR 75 KW 415 V THREE_PHASE", "PUMP 8X6-11", "7 5 KW", "", "", "VALVE 6 IN 600#"]


def test_describe(spark):
    rows = [(1, "SKF DEEP GROOVE BRG 6205-2RS"), (2, "HEX BOLT M20X80 A2-70 WITH NUT AND WASHER"), (3, "BALL VALVE 2IN"), (4, "??"), (5, "CENT PMP 8X6-11 KSB 16 BAR")]
    got = {r.id: r for r in T.describe(spark.createDataFrame(rows, "id int, description string")).collect()}
    facts = lambda r: {a.attribute_name: (a.normalized_value, a.unit) for a in r.attributes}
    assert facts(got[1]) == {"manufacturer": ("SKF", None), "bearing_type": ("DEEP_GROOVE_BALL", None), "series": ("6205", None), "bore_diameter": ("25", "MM"), "seal_type": ("2RS", None)}
    assert (got[1].category, got[1].quality.status) == ("Bearings", "good")
    assert got[2].assembly.components == ["NUT", "WASHER"] and facts(got[2])["length"] == ("80", "MM")
    assert got[3].category == "Bearings"  # a tie goes to the first name
    assert got[4].quality.status == "invalid" and got[4].category is None
    assert facts(got[5])["suction_size"] == ("8", "IN") and facts(got[5])["pressure_rating"] == ("16", "BAR")


def test_fuzzy_and_trigrams(spark):
    assert column(spark, ["GATE VLV CL 300 RF", "VALVE 300# CLASS150"], S.fuzzy_tokens) == [["GATE", "VALVE", "CLASS_300", "RF"], ["VALVE", "CLASS_300", "CLASS_150"]]

    def fnv(text):
        h = 2166136261
        for c in text.encode():
            h = (h ^ c) * 16777619 & 0xFFFFFFFF
        return h

    assert column(spark, ["ABC", "  Q"], S.fnv1a) == [fnv("ABC"), fnv("  Q")]


def test_blocking_equals_quadratic(spark):
    rng = random.Random(4)
    words = ["BOLT", "HEX", "M20", "NUT", "STUD", "GRADE", "ZINC"]
    rows = [(i, i % 3, "c", rng.sample(words, 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "material_id long, org_id int, category string, keys array<string>")
    for k in (1, 2):
        fast = {(r.a, r.b, r.shared) for r in M.candidate_pairs(df, k).collect()}
        assert fast == {(r.a, r.b, r.shared) for r in M.quadratic_pairs(df).where(f"shared >= {k}").collect()}


def test_scores_and_decisions(spark):
    rows = [
        (1, 1, "a", "SKF DEEP GROOVE BALL BEARING 6205-2RS", "SKF"), (2, 2, "b", "SKF BALL BRG 6205 2RS", "SKF"), (3, 3, "c", "SKF BALL BRG 6206 2RS", "SKF"),
        (4, 1, "d", "HEX BOLT M20X80 SS304", None), (5, 2, "e", "HEX BOLT M20X80 SS304 WITH NUT", None),
    ]
    features = M.features(spark.createDataFrame(rows, "material_id long, org_id int, code string, description string, manufacturer string"))
    scored = M.explained(M.score_pairs(M.candidate_pairs(features), features))
    got = {(r.material_id_a, r.material_id_b): r for r in scored.collect()}
    assert got[1, 2].technical == 100 and not got[1, 2].conflicts
    assert got[1, 3].decision == "NEEDS_TECHNICAL_REVIEW" and got[1, 3].conflicts
    assert got[4, 5].assembly_differs and got[4, 5].match_type == "needs_review"
    assert "decision=HIGH_CONFIDENCE_MATCH" in got[1, 2].explanation and "agrees=" in got[1, 2].explanation and "conflict=" not in got[1, 2].explanation
    assert "conflict=" in got[1, 3].explanation and "assembly=" in got[4, 5].explanation


def test_texts_are_worked_out_once(spark):
    """Neither a lambda nor a filter computes the text of a kernel anew."""
    from orelink.plans import kernels, matching

    data = "/root/testdata/sf0.001"
    plan = lambda q: q(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert plan(kernels.k3_embeddings).count("regexp_replace(upper(") == 1
    assert plan(kernels.k1_trigrams).count("regexp_replace(upper(") == 1 and plan(kernels.k1_trigrams).count("Aggregate") == 2
    assert plan(kernels.k6_text_signals).count("regexp_replace(upper(") == 4  # tokens and vector of two texts
    for q in (kernels.t7_classified, kernels.t14_reprocessed, matching.t11_text_pipeline):
        shown = plan(q)
        assert shown.count("regexp_replace(upper(coalesce(description") == 1, q


def test_equal_texts_come_back_to_every_row(spark):
    rows = spark.createDataFrame([(1, "Hex bolt"), (2, None), (3, "Hex bolt"), (4, None), (4, None)], "id int, description string")
    got = T.once_each(rows, ["description"], lambda t: t.withColumn("n", F.length("description"))).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "Hex bolt", 8), (2, None, None), (3, "Hex bolt", 8), (4, None, None), (4, None, None)], key=str)
