"""Feeds in several splits against a reader of the whole text."""

import random

import pytest

from orelink.sources import feeds


def plain(text, most):
    """(number, record or None) by one pass over the text."""
    out, cur, inside = [], "", False
    for ch in text + ("" if text.endswith("\n") else "\n"):
        inside ^= ch == '"'
        if ch == "\n" and not inside:
            out.append(cur[:-1] if cur.endswith("\r") else cur)
            cur = ""
        else:
            cur += ch
    if cur:
        out.append(cur.rstrip("\n"))
    out = [r.replace("\r\n", "\n") for r in out if r.strip()]
    return {(i, None if len(r) > most else r) for i, r in enumerate(out, 1)}


def text_of(rng, rows, open_end=False):
    cells = lambda: rng.choice(["a", "", "x y", '"q,1"', '"two\nlines"', '"with ""quotes"""', '"\n\n three\r\n"', "é" * rng.randrange(9)])
    lines = ["code,name,note"]
    for i in range(rows):
        lines.append(rng.choice(["", "", "  ", "\r"]) if rng.random() < 0.1 else f"{i}," + ",".join(cells() for _ in range(2)))
        if rng.random() < 0.02:
            lines.append(f'{i},"{"long " * 60}",z' if rng.random() < 0.5 else f'{i},"{("w" * 20 + chr(10)) * 15}",z')
    return rng.choice(["\n", "\r\n"]).join(lines) + (',"never closed\n1,2,3\n' if open_end else "\n")


@pytest.mark.parametrize("seed,open_end", [(1, False), (2, False), (3, True)])
def test_records_of_split_files(spark, tmp_path, seed, open_end):
    rng = random.Random(seed)
    texts = {name: text_of(rng, n, open_end) for name, n in (("a", 400), ("b", 30))}
    texts["c"] = "code,name,note\n" + "".join(f"{i},plain,row\n" for i in range(500))
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("700", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = feeds.records(spark, str(tmp_path), 200)
            if size == "700":
                assert feeds._lines(spark, str(tmp_path)).select("file", "block").distinct().count() > 5
            rows = got.collect()
            for name, text in texts.items():
                here = [(r.row_number, r.record) for r in rows if r.file.endswith(f"/{name}.csv")]
                assert len(here) == len(set(here)) and set(here) == plain(text, 200)
            assert {r.error for r in rows if r.record is None} == {"record_too_long"} and {r.error for r in rows if r.record is not None} == {None}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def test_cells(spark, tmp_path):
    (tmp_path / "f.csv").write_text('﻿MAT CODE,"Name, full",\nA1, b ,1\n\n"A""2","x\ny",\n' + "B," + "z" * 70000 + ",\nC\n")
    got = [(r.row_number, r["MAT CODE"], r["Name, full"], r.error) for r in feeds.read_feed(spark, str(tmp_path / "f.csv")).orderBy("row_number").collect()]
    assert got == [(2, "A1", "b", None), (3, 'A"2', "x\ny", None), (4, None, None, "record_too_long"), (5, "C", None, None)]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError):
        feeds.read_feed(spark, str(tmp_path / "empty.csv"))
