import re
from datetime import datetime
from decimal import Decimal
from random import Random

from hypothesis import given, settings
from hypothesis import strategies as st

from claimloom.operators import landing

GOOD = "id1;p;;claim-opened;2024-02-05T09:22:46Z;12.50;SP;v;s;note"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_id long, raw_value string")


CASES = [
    (GOOD, None), ("﻿" + GOOD + "\r", None), ('"id1";p;;claim-updated;"2024-02-05T09:22:46.5-03:00";;;v;s;"a;b ""c""\nd"', None),
    (GOOD + "\r\r", None), (GOOD.replace("note", 'no"te'), "broken_quoting"), (GOOD.replace("note", '"note'), "broken_quoting"), (GOOD.replace("note", '"no"te'), "broken_quoting"),
    (GOOD + '";x', "broken_quoting"), ("", "column_count"), (None, "column_count"), (GOOD + ";", "column_count"), (GOOD[:-5], "column_count"),
    (GOOD.replace("id1", "  "), "invalid_value"), (GOOD.replace("claim-opened", "Claim-opened"), "invalid_value"), (GOOD.replace("2024-02-05", "2023-02-29"), "invalid_value"),
    (GOOD.replace("09:22", "24:22"), "invalid_value"), (GOOD.replace("46Z", "46"), "invalid_value"), (GOOD.replace("12.50", "12.505"), "invalid_value"),
    (GOOD.replace("12.50", "-1"), "invalid_value"), (GOOD.replace(";SP;", ";sp;"), "invalid_value"), (GOOD.replace("note", "\u0001"), None), ('""' + GOOD[3:], "invalid_value"),
    (GOOD.replace("12.50", "12\n"), "invalid_value"), ('"' * 7, "broken_quoting"), (";" * 9, "invalid_value"),
]


def test_reasons(spark):
    df = frame(spark, [t for t, _ in CASES])
    got = {r.line_id: r._reason for r in landing.rejected_rows(df).collect()}
    wrong = [(CASES[i], got.get(i)) for i in range(len(CASES)) if got.get(i) != CASES[i][1]]
    assert not wrong
    loaded = {r.line_id for r in landing.loaded_rows(df).collect()}
    # A valid record with the sign that marks delimiters is read in Python and not lost among the rejected.
    assert loaded | {20} == {i for i, (_, reason) in enumerate(CASES) if reason is None}


def test_records_with_the_marking_characters_load(spark):
    """Every record is in exactly one of the results, whatever characters stand in it."""
    notes = ["\u0001", "\u0002", "\u0002a\u0001\u0002b", "\u0001;\u0002", 'x"\u0001";', "\u0002\u0001a;b"]
    quoted = [GOOD.replace("note", '"' + n.replace('"', '""') + '"') for n in notes]
    plain = [GOOD.replace("note", n) for n in notes[:3]]
    broken = [GOOD.replace("note", '"\u0001'), GOOD + ";\u0001", GOOD.replace("12.50", '"1\u00012"')]
    df = frame(spark, [*quoted, *plain, *broken])
    got = {r.line_id: (r.claim_id, r.source, r.note) for r in landing.loaded_rows(df).collect()}
    assert got == {i: ("id1", "s", n) for i, n in enumerate([*notes, *notes[:3]])}
    assert [r._reason for r in landing.rejected_rows(df).orderBy("line_id").collect()] == ["broken_quoting", "column_count", "invalid_value"]


def test_columns_read_as_python_reads(spark):
    """On random fields, a record loads if and only if the reading in Python finds no fault, and with the same fields."""
    random = Random(7)
    cell = lambda: "".join(random.choices('";ab\u0001\u0002', (3, 1, 2, 2, 3, 3), k=random.randrange(7)))
    spelled = lambda c: random.choice((c, '"' + c.replace('"', '""') + '"', '"' + c + '"'))
    texts = [";".join([spelled(cell() + "i"), spelled(cell()), *GOOD.split(";")[2:9], spelled(cell())]) for _ in range(2000)]
    valid = {i: [landing._plain_value(f) for f in landing.fields_of(t)] for i, t in enumerate(texts) if landing.diagnose(t)[0] is None}
    assert 100 < sum("\u0001" in texts[i] for i in valid) and len(valid) < len(texts)
    df = frame(spark, texts)
    assert {r.line_id: [r.claim_id, r.policy_id or "", r.note or ""] for r in landing.loaded_rows(df).collect()} == {i: [f[0], f[1], f[9]] for i, f in valid.items()}
    assert {r.line_id for r in landing.rejected_rows(df).collect()} == set(range(len(texts))) - set(valid)


def test_a_line_break_after_the_time_is_no_part_of_it(spark):
    stamp = GOOD.split(";")[4]
    texts = [GOOD.replace(stamp, f'"{stamp}{end}"') for end in ("", "\n", "\r", "\r\n", "\u0085", "\u2028", "\u2029")]
    df = frame(spark, texts)
    assert [(r.line_id, r._reason) for r in landing.rejected_rows(df).orderBy("line_id").collect()] == [(i, "invalid_value") for i in range(1, 7)]
    assert [r.line_id for r in landing.loaded_rows(df).collect()] == [0]


def test_typed_rows(spark):
    row = landing.loaded_rows(frame(spark, [CASES[2][0], GOOD])).orderBy("line_id").collect()
    assert row[0].note == 'a;b "c"\nd' and row[0].amount is None and row[0].region is None
    assert row[0].event_timestamp == datetime(2024, 2, 5, 12, 22, 46, 500000) and row[1].amount == Decimal("12.50")


def test_edits_state_what_was_wrong(spark):
    texts = [GOOD.replace("note", '"note'), GOOD.replace(";claim-opened;", ";claim-opened"), GOOD.replace(";SP;", ";S;P;"), GOOD.replace("12.50", "x")]
    got = [r._edits for r in landing.rejected_rows(frame(spark, texts)).orderBy("line_id").collect()]
    assert "quote" in got[0] and got[1].startswith("insert delimiter") and got[2].startswith("delete delimiter") and got[3] == "invalid amount"


def test_all_delimiter_edits_are_stated(spark):
    edits = landing.rejected_rows(frame(spark, [GOOD + ";" * 30, GOOD + ";" * 5000])).orderBy("line_id").collect()
    for row, n in zip(edits, (30, 5000)):
        stated = row._edits.split("; ")
        assert row._reason == "column_count" and len(stated) == len(set(stated)) == n
        assert all(re.fullmatch("delete delimiter at field [0-9]+", s) for s in stated)


def test_long_records_and_empty_table(spark):
    assert landing.rejected_rows(frame(spark, [])).count() == landing.loaded_rows(frame(spark, [])).count() == 0
    long = ['"' + "a" * 300_000, GOOD.replace("note", '"' + 'x""' * 100_000 + '"'), ";" * 20_000]
    got = {r.line_id: r._reason for r in landing.rejected_rows(frame(spark, long)).collect()}
    assert got == {0: "broken_quoting", 2: "column_count"}


def grammar(text):
    """The grammar of a record, one character at a time."""
    fields, i = 0, 0
    while True:
        if text[i : i + 1] == '"':
            i += 1
            while True:
                j = text.find('"', i)
                if j < 0:
                    return None
                i = j + 1
                if text[i : i + 1] != '"':
                    break
                i += 1
            if text[i : i + 1] not in ("", ";"):
                return None
        else:
            j = text.find(";", i)
            j = len(text) if j < 0 else j
            if '"' in text[i:j]:
                return None
            i = j
        fields += 1
        if i >= len(text):
            return fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.text('";ab', max_size=14))
def test_quote_edits_against_the_grammar(text):
    cost, edits, mended = landing.quote_edits(text)
    assert (cost == 0) == (grammar(text) is not None)
    assert grammar(mended) is not None and len(edits) == cost
    if cost == 0:
        assert mended == text and len(landing.fields_of(text)) == grammar(text)


@settings(max_examples=60, deadline=None)
@given(st.text('";a', max_size=6))
def test_quote_edits_are_fewest(text):
    """No smaller number of quote edits gives a well-formed record: all edits of one quote are tried."""
    cost, _, _ = landing.quote_edits(text)
    seen, level = {text}, 0
    while not any(grammar(t) is not None for t in seen):
        seen |= {t[:i] + '"' + t[i:] for t in seen for i in range(len(t) + 1)} | {t[:i] + t[i + 1 :] for t in seen for i in range(len(t)) if t[i] == '"'}
        level += 1
    assert cost == level


@settings(max_examples=150, deadline=None)
@given(st.text('";a', max_size=6), st.integers(1, 3))
def test_all_edits_are_fewest_together(text, columns):
    """Of all readings with the fewest quote edits, none is nearer to the number of columns: all of them are tried."""
    quotes, delimiters, edits, mended = landing.record_edits(text, columns)
    seen = {text}
    for _ in range(quotes):
        assert not any(grammar(t) for t in seen)
        seen = {t[:i] + '"' + t[i:] for t in seen for i in range(len(t) + 1)} | {t[:i] + t[i + 1 :] for t in seen for i in range(len(t)) if t[i] == '"'}
    assert delimiters == min(abs(grammar(t) - columns) for t in seen if grammar(t))
    assert len(edits) == quotes and mended in seen and abs(grammar(mended) - columns) == delimiters


def test_the_reading_with_the_right_columns_wins(spark):
    """One quote too many: deleting it leaves ten columns, closing it at the end of the record would hide some."""
    text = GOOD.replace(";SP;", ';"SP;')
    reason, edits = landing.diagnose(text)
    assert reason == "broken_quoting" and edits in (f"delete quote at {text.index(chr(34))}", f"insert quote at {text.index(';', text.index('SP'))}")


def test_columns_may_have_any_names(spark):
    df = frame(spark, [GOOD, "x"]).selectExpr("line_id as id", "raw_value", "1 as _fields", "2 as _ok", "3 as _cells", "4 as _text")
    assert [r.id for r in landing.rejected_rows(df, keep=("id",)).collect()] == [1]
    assert [r.id for r in landing.loaded_rows(df, keep=("id",)).collect()] == [0]
