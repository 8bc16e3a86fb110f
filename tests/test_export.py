import pytest

from millrace.operators.export import Exports, ForeignKey, orphans, parents_first

KEYS = [ForeignKey("chat", "user", "users", "id"), ForeignKey("message", "chat", "chat", "id"), ForeignKey("message", "reply_to", "message", "id"), ForeignKey("vote", "message", "message", "id"), ForeignKey("vote", "user", "users", "id"), ForeignKey("audit", "run", "runs", "id")]


@pytest.fixture
def tables(spark):
    return {
        "users": spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id long, name string"),
        "chat": spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 99)], "id long, user long"),
        "message": spark.createDataFrame([(100, 10, None), (101, 11, None), (102, 12, 100), (103, 13, None), (104, None, None)], "id long, chat long, reply_to long"),
        "vote": spark.createDataFrame([(100, 1), (100, 2), (101, 1), (102, None), (104, 1)], "message long, user long"),
        "runs": spark.createDataFrame([(1,)], "id long"),
        "audit": spark.createDataFrame([(1, "x"), (None, "y")], "run long, note string"),
    }


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_closure_has_no_orphan_and_nothing_too_few(spark, tmp_path, tables):
    own = Exports(spark, f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="nothing"):
        own.read()
    first = own.export(tables, KEYS, {"users": "id IS NULL OR id <> 2"}, ("runs",))
    kept = own.read()
    assert rows(kept["users"]) == [(1, "a"), (None, "c")]
    assert rows(kept["chat"]) == [(10, 1), (12, None)]  # 11 belonged to user 2, 13 to nobody
    assert rows(kept["message"]) == [(100, 10, None), (102, 12, 100), (104, None, None)]
    assert rows(kept["vote"]) == [(100, 1), (102, None), (104, 1)]
    assert rows(kept["runs"]) == [] and rows(kept["audit"]) == [(None, "y")]
    assert all(orphans(kept[k.child], kept[k.parent], k).count() == 0 for k in KEYS)
    assert {r.table: r.rows for r in own.manifest().collect()} == {n: t.count() for n, t in kept.items()}
    second = own.export(tables, KEYS)
    assert rows(own.read()["audit"]) == rows(tables["audit"]) and rows(own.read(first)["audit"]) == [(None, "y")]
    own.drop(first)
    assert own.revisions() == [second] and len(list((tmp_path / "x/exports").iterdir())) == 1


def test_what_cannot_be_published(spark, tmp_path, tables):
    own = Exports(spark, f"file://{tmp_path}/x")
    with pytest.raises(ValueError, match="not among"):
        own.export({"chat": tables["chat"]}, KEYS[:1])
    with pytest.raises(ValueError, match="orphans in .'message.reply_to'"):
        own.export(tables, KEYS, {"message": "id <> 100"})
    assert own.revisions() == []
    circle = [ForeignKey("a", "x", "b", "x"), ForeignKey("b", "x", "a", "x")]
    with pytest.raises(ValueError, match="circle"):
        parents_first(["a", "b", "c"], circle)
    assert parents_first(["message", "users", "chat"], KEYS[:3]) == ["users", "chat", "message"]
    none = {n: t.where("false") for n, t in tables.items()}
    own.export(none, KEYS)
    assert all(t.count() == 0 for t in own.read().values())
