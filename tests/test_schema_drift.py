import json

import pytest

from claimloom.operators import schema_drift as sd

SCHEMA = "record_id long, feed_id string, file_no int, payload string"


def frame(spark, *files):
    """(feed, file number, list of records or texts)"""
    rows, n = [], 0
    for feed, no, records in files:
        for r in records:
            n += 1
            rows.append((n, feed, no, r if isinstance(r, (str, type(None))) else json.dumps(r)))
    return spark.createDataFrame(rows, SCHEMA)


def changes(df):
    return {tuple(r) for r in sd.schema_changes(df).collect()}


def rec(ref, **fields):
    return {"external_reference_id": ref, **fields}


def test_added_removed_renamed_retyped(spark):
    df = frame(
        spark,
        ("f", 1, [rec("a", num="10", city="X", amt=1.5), rec("b", num="11", city="Y", amt=2), rec("z", num=None)]),
        ("f", 2, [rec("a", Num=10, town="Q", amt="1.5"), rec("c", Num=12, town="R", amt=None)]),
        ("f", 4, [rec("a", other=1)]),
        ("g", 2, [rec("a", x=1)]),
    )
    assert changes(df) == {
        ("f", 2, "renamed", "num", "Num"), ("f", 2, "retyped", "num", "Num"), ("f", 2, "removed", "city", ""), ("f", 2, "added", "", "town"), ("f", 2, "retyped", "amt", "amt"),
    }


def test_value_missing_in_one_copy_is_no_renaming(spark):
    df = frame(spark, ("f", 1, [rec("a", x="1"), rec("b", x="2")]), ("f", 2, [rec("a", y="1"), rec("b", y=None)]))
    assert changes(df) == {("f", 2, "removed", "x", ""), ("f", 2, "added", "", "y")}
    both_null = frame(spark, ("f", 1, [rec("a", x="1"), rec("b", x=None)]), ("f", 2, [rec("a", y="1"), rec("b")]))
    assert changes(both_null) == {("f", 2, "renamed", "x", "y")}


def test_two_candidates_give_one_renaming(spark):
    df = frame(spark, ("f", 1, [rec("a", x="1")]), ("f", 2, [rec("a", y="1", w="1")]))
    assert changes(df) == {("f", 2, "renamed", "x", "w"), ("f", 2, "added", "", "y")}


def test_broken_and_null_payloads_and_repeated_records(spark):
    df = frame(spark, ("f", 1, [rec("a", x="1")] * 3 + ["{not json", None, "[1]", '"t"']), ("f", 2, [rec("a", x="1", n=[1]), {"x": "5"}]))
    assert changes(df) == {("f", 2, "added", "", "n")}
    assert changes(frame(spark)) == set()


@pytest.mark.parametrize(
    ("value", "kind", "text"),
    [("1", sd.INTEGER, "1"), ("1.50", sd.DECIMAL, "1.50"), ("true", sd.BOOLEAN, "true"), ('"a"', sd.TEXT, "a"), ("null", 0, None), ('{"b": [1.0, "x"]}', sd.OBJECT, '{"b":[1.0,"x"]}'), ("[null]", sd.ARRAY, "[null]"), ("-3e5", sd.INTEGER, "-3e5")],
)
def test_types_and_texts_of_values(value, kind, text):
    assert sd.record_fields(f'{{"k": 0, "k": {value}}}') == [("k", kind, text)]


PAYLOADS = [
    '{"a":1.50,"b":1,"c":"x","d":true,"e":null}', '{"a":{"z":1.0, "y":[1, 2]},"g":[1,{"q":"é"}]}', '{"h":1e3,"i":12345678901234567890123,"j":"1.50","k":1.0,"l":-0.0,"m":2E-3}', '{"a":1,"a":2}', "not json", "[1]",
    '{"a":NaN}', '{"a":1} trailing', '{"a":1.123456789012345678901234567890123456789012345}', '{"a":"\\u00e9\\n"}', "{}", " { } ", None, "", "{'a':1}", '{"a":01}', '{"a":Infinity}', '  {"a" : 2 ,\t"b":\n"x: \\"y\\", {"}  ',
    '{"a":"b:\'c\',{d}"}', '{"a":1,}', '{"a"}', '{"":""}', '{"a":"tab\there"}', '{"a":tru}', '{"a":-}', '{"A":1,"a":2}', "{" + ",".join(f'"k{i}":{i}' for i in range(400)) + "}", "{" + ",".join(f'"k{i}":"{"v" * 40}"' for i in range(4000)) + "}",
    '{"a":"\u00a0"}', '{"a":1\u00a0}',
]


def test_expressions_and_python_read_alike(spark):
    df = spark.createDataFrame([(i, "f", 1, p) for i, p in enumerate(PAYLOADS)], SCHEMA)
    got = {r.record_id: [tuple(c) for c in r._cells] for r in sd.parsed_records(df, keep=("record_id",)).collect()}
    assert got == {i: sd.record_fields(p) for i, p in enumerate(PAYLOADS)}
    flat = sd._flat_cells(df, "payload").filter("_cells is not null")
    assert {r.record_id for r in flat.collect()} == {0, 2, 8, 10, 11, 18, 21, 25, 26, 28}


def test_lattice(spark):
    masks = [0, sd.INTEGER, sd.INTEGER | sd.DECIMAL, sd.BOOLEAN | sd.INTEGER, sd.ARRAY, sd.ARRAY | sd.OBJECT, sd.TEXT | sd.DECIMAL]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(masks)], "i int, m int")
    assert [r[0] for r in df.orderBy("i").select(sd.promoted(df.m)).collect()] == [None, "integer", "decimal", "text", "array", "text", "text"]


def test_consistent_table(spark):
    df = frame(
        spark,
        ("f", 1, [rec("a", num="10", amt=1), rec("b", num="11", amt=2)]),
        ("f", 2, [rec("a", Num=10, amt=1.5), "broken"]),
        ("f", 3, [rec("a", Num=10, num="new", record_id="clash")]),
    )
    out = sd.consistent_table(df)
    rows = {r.record_id: r.asDict() for r in out.collect()}
    assert len(rows) == 5 and rows[4]["amt"] is None
    assert rows[3]["num"] == "10" and float(rows[3]["amt"]) == 1.5 and rows[5]["num"] == "10" and rows[5]["num~2"] == "new" and rows[5]["record_id__2"] == "clash"
    with pytest.raises(ValueError):
        sd.union_schema(sd.field_names(sd.parsed_records(df)), 2)


def test_no_number_loses_digits(spark):
    """Precision and scale follow the data; where no number type holds all values, the column is text."""
    rows = [
        '{"external_reference_id":"a","d":1.123456789,"i":99999999999999999999,"s":5,"e":1e3,"w":123456789012345678901234567890123456.5}',
        '{"external_reference_id":"b","d":-12345678.5,"i":-7,"s":-6,"e":20,"w":1.123456789}',
        '{"external_reference_id":"c","d":25e-11,"i":1,"s":999999999999999999,"e":-4,"w":0}',
    ]
    out = sd.consistent_table(frame(spark, ("f", 1, rows)))
    assert {f.name: f.dataType.simpleString() for f in out.schema if len(f.name) == 1} == {"d": "decimal(38,11)", "i": "decimal(38,0)", "s": "bigint", "e": "bigint", "w": "string"}
    got = {r.external_reference_id: r for r in out.collect()}
    assert [str(got[k].d.normalize()) for k in "abc"] == ["1.123456789", "-12345678.5", "2.5E-10"]
    assert [int(got[k].i) for k in "abc"] == [99999999999999999999, -7, 1] and [got[k].s for k in "abc"] == [5, -6, 999999999999999999]
    assert [got[k].e for k in "abc"] == [1000, 20, -4] and [got[k].w for k in "abc"] == ["123456789012345678901234567890123456.5", "1.123456789", "0"]


def test_changes_come_in_order(spark):
    df = frame(spark, *[(f, n, [rec("a", **{f"x{n}{k}": k for k in range(3)})]) for f in ("g", "f") for n in (2, 1, 3)])
    rows = [tuple(r) for r in sd.schema_changes(df).collect()]
    assert rows == sorted(rows) and len(rows) == 12
