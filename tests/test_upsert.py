"""The upsert table: last wins, replays, failures between file and list, folding."""

from claimloom.session import fresh_path
from claimloom.sources.upsert import UpsertTable


def test_upserts(spark):
    table = UpsertTable(spark, fresh_path(spark, "upsert"), ("title",), ("nr",))
    frame = lambda *r: spark.createDataFrame(list(r), "title string, nr long, text string")
    assert table.read() is None
    assert table.upsert(frame(("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b"), (None, 1, "none")), 0)
    want = [("a", 2, "new"), ("b", 1, "b")]
    assert sorted((r["title"] or "", r["nr"], r["text"]) for r in table.read().collect()) == [("", 1, "none"), *want]
    # a later batch wins whatever its order column says; a replay changes nothing
    assert table.upsert(frame(("a", 1, "late")), 1)
    for _ in range(2):
        assert not table.upsert(frame(("a", 9, "replayed otherwise")), 1)
        assert {r["title"]: r["text"] for r in table.read().collect()} == {"a": "late", "b": "b", None: "none"}
    # written but not listed: not seen, and written again
    frame(("c", 1, "torn")).write.parquet(f"{table.path}/data/batch-2")
    assert table.read().count() == 3
    assert table.upsert(frame(("c", 1, "whole")), 2)
    table.compact()
    assert len(table.versions()) == 1 and table.read().count() == 4
    assert not table.upsert(frame(("c", 1, "again")), 2)
    assert table.upsert(frame(("d", 1, "d")), 3)
    table.compact()
    table.vacuum()
    again = UpsertTable(spark, table.path, ("title",), ("nr",))
    assert {r["title"]: r["text"] for r in again.read().collect()} == {"a": "late", "b": "b", None: "none", "c": "whole", "d": "d"}
    assert table.upsert(frame(), 4) and table.read().count() == 5
