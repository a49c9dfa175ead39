"""Chunked imports: replays, failures and first occurrences."""

import pytest

from orelink.sources import jobs as J

SCHEMA = "row_number long, key string, note string"


def rows(spark, n=40):
    """Keys repeat over chunks: row i has key i % 15, every eleventh row is an error."""
    return spark.createDataFrame([(i, None if i % 11 == 0 else f"k{i % 15}", f"row {i}") for i in range(1, n + 1)], SCHEMA)


def want(n, stored=()):
    seen, out = set(stored), {}
    for i in range(1, n + 1):
        key = None if i % 11 == 0 else f"k{i % 15}"
        outcome = "error" if key is None else "duplicate" if key in seen else "imported"
        seen |= {key} if key else set()
        c = out.setdefault((i - 1) // 8, {"imported": 0, "duplicate": 0, "error": 0})
        c[outcome] += 1
    return out


def counted(spark, folder):
    return {r.chunk: {"imported": r.imported, "duplicate": r.duplicate, "error": r.error} for r in J.ledger(spark, folder).collect()}


def stored(spark, store):
    return sorted(r.note for r in spark.read.parquet(store).where("note is not null").collect())


def test_a_job_stops_at_a_fault_and_goes_on(spark, tmp_path):
    folder, store = str(tmp_path / "job"), str(tmp_path / "store")
    spark.createDataFrame([("k3", None)], "key string, note string").write.parquet(f"{store}/run=base/chunk=0")
    J.stage(rows(spark), folder, 8)
    assert J.progress(spark, folder).first().state == "STAGED"

    def fault(_, number):
        if number == 2:
            raise RuntimeError("lost")

    with pytest.raises(Exception):
        J.run(spark, folder, store, "one", 1, fault)
    half = J.progress(spark, folder).first()
    assert (half.state, half.done, half.chunks) == ("RUNNING", 2, 5)
    J.run(spark, folder, store, "one", 2)
    assert counted(spark, folder) == want(40, {"k3"})
    row = J.progress(spark, folder).first()
    assert row.state == "COMPLETED" and row.processed_rows == row.staged_rows == 40 and row.imported == sum(c["imported"] for c in want(40, {"k3"}).values())
    notes = stored(spark, store)
    assert len(notes) == row.imported and "row 1" in notes and "row 16" not in notes

    # every chunk once more, from a new checkpoint and in another order: nothing changes
    for chunk in (4, 0, 3, 1, 2):
        J.load(spark.read.parquet(f"{folder}/staged").where(f"chunk = {chunk}"), folder, store, "one")
    assert counted(spark, folder) == want(40, {"k3"}) and stored(spark, store) == notes
    J.run(spark, folder, store, "one")  # nothing left to do
    assert stored(spark, store) == notes

    # a second run of the same rows finds them all stored
    again = str(tmp_path / "again")
    J.stage(rows(spark), again, 8)
    J.run(spark, again, store, "two")
    assert sum(c["imported"] for c in counted(spark, again).values()) == 0 and stored(spark, store) == notes


def test_small_chunks_share_files_and_batches(spark, tmp_path):
    folder, store, batches = str(tmp_path / "job"), str(tmp_path / "store"), []
    J.stage(rows(spark, 120), folder, 4, 10)
    J.run(spark, folder, store, "one", before=lambda _, number: batches.append(number))
    state = J.progress(spark, folder).first()
    assert batches == [0] and state.state == "COMPLETED" and state.done == state.chunks == 30
    assert {c: sum(v.values()) for c, v in counted(spark, folder).items()} == {c: 4 for c in range(30)}
    files = lambda path: [len(list(c.glob("*.parquet"))) for c in path.glob("chunk=*")]
    assert files(tmp_path / "job" / "ledger") == files(tmp_path / "job" / "staged") == [1, 1, 1] and set(files(tmp_path / "store" / "run=one")) == {1}
