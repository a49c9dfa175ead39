"""CSV reading and writing, header mapping, reprocessing and the runs' mirror."""

import glob

import pytest

from orelink.functions import text as T
from orelink.operators import evaluation as E
from orelink.sources import imports as I


def test_csv_keeps_quotes_commas_and_line_breaks(spark, tmp_path):
    rows = [("M-1", 'bolt, "hex"', "x\ny"), ("M-2", "  nut ", None), ("M-3", "", "a")]
    I.write_csv(spark.createDataFrame(rows, "code string, description string, note string").coalesce(1), str(tmp_path / "f.csv"))
    (part,) = glob.glob(str(tmp_path / "f.csv" / "part-*"))
    assert open(part, "rb").read() == b'code,description,note\r\nM-1,"bolt, ""hex""","x\r\ny"\r\nM-2,nut,\r\nM-3,,a\r\n'
    got = I.read_any(spark, part + "") if part.endswith(".csv") else I.read_csv(spark, part)
    assert sorted(map(tuple, got.collect())) == [("M-1", 'bolt, "hex"', "x\ny"), ("M-2", "nut", None), ("M-3", None, "a")]


def test_csv_reader_trims_skips_blank_lines_and_refuses_endless_cells(spark, tmp_path):
    plain, endless = tmp_path / "a.csv", tmp_path / "b.csv"
    plain.write_bytes(b"code,description\r\n\r\n A , b c \r\n\r\nB,\r\n")
    assert list(map(tuple, I.read_csv(spark, str(plain)).collect())) == [("A", "b c"), ("B", None)]
    endless.write_text("code,description\nA," + "x" * (I.CELL_MAX + 1) + "\n")
    with pytest.raises(Exception, match="(?i)malformed|length|FAILED_READ|parse"):
        I.read_csv(spark, str(endless)).collect()


def test_json_and_parquet_read_as_text(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "code int, description string").coalesce(1).write.json(str(tmp_path / "j"))
    (part,) = glob.glob(str(tmp_path / "j" / "part-*.json"))
    assert list(map(tuple, I.read_any(spark, part).collect())) == [("1", "a")]


def test_headers_of_a_source_map_and_the_rest_stays(spark):
    got = I.mapped(spark.createDataFrame([("A", "valve", "7")], "MAT_CODE string, `Mat Desc` string, LEGACY_BIN string")).first()
    assert (got.material_code, got.description, got.source_metadata) == ("A", "valve", {"LEGACY_BIN": "7"})


def test_manual_attributes_stay_over_extracted_ones(spark):
    own = [("seal_type", "ZZ", "ZZ", None, True), ("note", "x", "x", None, False)]
    rows = [(1, "BALL BRG 6205-2RS SKF", None, None, None, own), (2, "thing", "Motors", "kept", "ACME", None), (3, None, None, None, None, None)]
    got = {r.material_id: r for r in T.reprocessed(spark.createDataFrame(rows, f"material_id int, description string, category string, subcategory string, manufacturer string, manual array<{T.ATTRIBUTE}>")).collect()}
    assert {a.attribute_name: a.value for a in got[1].attributes} == {"manufacturer": "SKF", "bearing_type": "DEEP GROOVE BALL", "series": "6205", "bore_diameter": "25", "seal_type": "ZZ", "note": "x"}
    assert (got[1].category, got[1].manufacturer, got[2].category, got[2].subcategory, got[2].manufacturer) == ("Bearings", "SKF", "Motors", "kept", "ACME")
    assert got[3].category is None and got[3].normalized == "" and got[3].attributes == []


def test_mirror_adds_runs(spark, tmp_path):
    for n in (1, 2):
        E.mirrored(spark.createDataFrame([(n, 0.5)], "run int, accuracy double"), str(tmp_path / "runs"))
    assert sorted(r.run for r in spark.read.json(str(tmp_path / "runs")).collect()) == [1, 2]
