"""Codes of a procurement file count whole."""

from orelink.sources import imports as I


def test_codes_that_only_begin_like_stored_ones_are_unknown(spark):
    cells = list(I.PROCUREMENT_HEADERS)
    base = {"organization": "ABCDEFGHIJKL", "material_code": "M" * 60, "supplier": "S", "purchase_date": "2024-01-02", "quantity": "1", "uom": "EA", "po": "P"}
    files = [base, base | {"organization": "ABCDEFGHIJKLZZZ"}, base | {"material_code": "M" * 61}, base | {"cmi_code": "C" * 41}]
    rows = spark.createDataFrame([(i, *[f.get(c) for c in cells]) for i, f in enumerate(files)], "row_number long, " + ", ".join(f"{c} string" for c in cells))
    organizations = spark.createDataFrame([(1, "ABCDEFGHIJKL")], "org_id int, org_code string")
    materials = spark.createDataFrame([(1, 1, "M" * 60, "C" * 40)], "material_id long, org_id int, code string, cmi string")
    suppliers = spark.createDataFrame([(1, "S", "S")], "supplier_id long, code string, supplier string")
    cmis = spark.createDataFrame([("C" * 40, True)], "cmi string, active boolean")
    got = {r.row_number: [p.rule for p in r.problems] for r in I.checked_procurement(rows, organizations, materials, suppliers, cmis).collect()}
    assert got == {0: [], 1: ["unknown_organization"], 2: ["unknown_material"], 3: ["unknown_cmi"]}
