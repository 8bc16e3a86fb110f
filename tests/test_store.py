from millrace.sources import store
from millrace.sources.store import Store

ROWS = "owner string, key long, content string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_equal_contents_are_stored_once_and_swept_when_unnamed(spark, tmp_path):
    own = Store(spark, f"file://{tmp_path}/s")
    assert own.names().count() == own.contents().count() == 0
    own.put(spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "x"), ("b", 3, "y"), (None, 1, "z"), ("a", None, "z"), ("a", 9, None), ("a", 4, "")], ROWS))
    assert own.names().count() == 5 and own.contents().count() == 3
    own.put(spark.createDataFrame([("a", 1, "y"), ("c", 7, "w")], ROWS))  # a's first key gets another content, one that is there
    assert own.contents().count() == 4
    asked = spark.createDataFrame([("a", 1), ("a", 3), ("b", 1), ("b", 8), ("a", 1)], "owner string, key long")
    found = [(r.owner, r.key, bytes(r.content) if r.content is not None else None, r.reason) for r in own.find(asked).collect()]
    assert sorted(found, key=str) == sorted([("a", "1", b"y", None), ("a", "3", None, "foreign"), ("b", "1", b"x", None), ("b", "8", None, "missing")], key=str)
    own.delete(spark.createDataFrame([("c", 7), ("b", 99), ("b", 2)], "owner string, key long"))
    live = rows(own.names())
    assert own.contents().count() == 4 and own.sweep() == 1  # w
    assert rows(own.names()) == live and sorted(bytes(r.content) for r in own.contents().collect()) == [b"", b"x", b"y"]
    assert all(len(list((tmp_path / "s" / kind).iterdir())) == 1 for kind in ("contents", "names", "manifests"))
    own.delete(own.names())
    assert own.sweep() == 3 and own.contents().count() == 0


def test_many_changes_sweep_first(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_PARTS", 4)
    own = Store(spark, f"file://{tmp_path}/s")
    for k in range(4):
        own.put(spark.createDataFrame([("a", k % 3, f"v{k}")], ROWS))
    assert len(own.parts()) <= 4
    assert sorted((r.key, bytes(r.content)) for r in own.find(own.names()).collect()) == [("0", b"v3"), ("1", b"v1"), ("2", b"v2")]
