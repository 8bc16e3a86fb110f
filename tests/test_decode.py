import pytest

from millrace.operators import decode

FIELDS = {"k": ("$.k", "long"), "d": ("$.d", "double"), "s": ("$.s", "string"), "b": ("$.in.b", "boolean"), "a": ("$.a", "array<long>")}
ROWS = [
    (1, '{"k": 5, "d": 1.5, "s": "x", "in": {"b": true}, "a": [1, 2]}', (5, 1.5, "x", True, [1, 2]), []),
    (2, '{"k": "5", "d": 7, "s": 3, "in": {"b": 0}, "a": {}}', (None, 7.0, None, None, None), ["k:kind", "s:kind", "b:kind", "a:kind"]),
    (3, '{"k": null, "d": 2e3, "in": []}', (None, 2000.0, None, None, None), ["k:null", "s:missing", "b:missing", "a:missing"]),
    (4, '{"k": 5', (None,) * 5, ["j:malformed"]),
    (5, None, (None,) * 5, ["j:missing"]),
    (6, "", (None,) * 5, ["j:malformed"]),
    (7, '{"k": 1.5, "d": "1.5", "s": "", "in": {"b": false}, "a": []}', (None, None, "", False, []), ["k:kind", "d:kind"]),
    (8, "[1]", (None,) * 5, ["k:missing", "d:missing", "s:missing", "b:missing", "a:missing"]),
    (None, '{"k": 9223372036854775808}', (None,) * 5, ["k:kind", "d:missing", "s:missing", "b:missing", "a:missing"]),
]


def test_each_field_degrades_for_itself(spark):
    rows = spark.createDataFrame([(i, j) for i, j, _, _ in ROWS], "id long, j string")
    found = {r.id: r for r in decode.decoded(rows, "j", FIELDS).collect()}
    for i, _, values, reasons in ROWS:
        assert tuple(found[i][c] for c in FIELDS) == values, i
        assert found[i].reasons == reasons, i
    with pytest.raises(ValueError, match="exist"):
        decode.decoded(rows, "j", {"id": ("$.id", "long")})
    assert decode.decoded(rows.where("id > 99"), "j", FIELDS).count() == 0
