"""Delimited records that fail to parse: load the valid ones, give the reason for the others.

A record is read at minimum cost, where an edit inserts or deletes a quote or a delimiter. A quote edit outweighs any
number of delimiter edits, which outweigh values that don't suit the types of their columns: with equal weights a surplus
delimiter would rather be hidden in quotes than deleted, and the reason would be wrong. One dynamic program over tokens,
quoting states and columns finds the reading of least cost. Records of cost zero with valid values load; otherwise the
edits state the reason.

Cost zero is decided by column expressions, so only suspicious records travel to Python, in Arrow batches. Tokens are
quotes, delimiters and runs of other text, and the work is linear in the record. The states of the full program are
cut by a bound: the cost of the reading with the fewest quote edits, which a smaller program finds first and which is
itself the best one if it has the right number of columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a record and the values allowed in them.
COLUMNS = ("claim_id", "policy_id", "customer_id", "event_type", "event_timestamp", "amount", "region", "vehicle_type", "source", "note")
EVENT_TYPES = ("claim-opened", "claim-updated")
REGIONS = ("SP", "RJ", "MG", "BA", "RS", "PR", "SC", "PE", "CE", "GO", "DF", "AM")
_STAMP = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})T(?:[01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](?:\.[0-9]+)?(?:Z|[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])$"
_AMOUNT = r"^(?:[0-9]+(?:\.[0-9]{1,2})?)?$"

BROKEN, COUNT, INVALID = "broken_quoting", "column_count", "invalid_value"
#: Stands for a delimiter outside quotes while a record is taken apart. Where a record holds it, it is written as
#: ``_ESCAPE`` and a letter until then, and so is ``_ESCAPE`` itself.
_CUT, _ESCAPE = "\u0001", "\u0002"


def record_text(raw: Column) -> Column:
    """Without a byte-order mark at the start and one carriage return at the end."""
    return F.regexp_replace(F.regexp_replace(raw, "^\ufeff", ""), "\r\\z", "")


def _zero_cost_fields(text: Column) -> Column:
    """The raw fields of a well-formed record, else null. Pieces between quotes alternate outside and inside."""
    taken = text.contains(_CUT)
    swap = lambda c, *pairs: reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)
    pieces = F.split(F.when(taken, swap(text, (_ESCAPE, _ESCAPE + "b"), (_CUT, _ESCAPE + "a"))).otherwise(text), '"', -1)
    n = F.size(pieces)

    def sound(piece: Column, i: Column) -> Column:
        left = (i == 0) | piece.startswith(";")
        right = (i == n - 1) | piece.endswith(";")
        return (i % 2 == 1) | (piece == "") | (left & right)

    well_formed = (n % 2 == 1) & F.size(F.filter(pieces, lambda p, i: ~sound(p, i))).eqNullSafe(0)
    marked = F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.translate(p, ";", _CUT)).otherwise(p)), '"')
    cells = F.split(marked, _CUT, -1)
    back = F.transform(cells, lambda c: swap(c, (_ESCAPE + "a", _CUT), (_ESCAPE + "b", _ESCAPE)))
    return F.when(n == 1, F.split(text, ";", -1)).when(well_formed, F.when(taken, back).otherwise(cells))


def _unquoted(field: Column) -> Column:
    inner = F.replace(F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))
    return F.when(field.startswith('"'), inner).otherwise(field)


def _values_valid(f: list[Column]) -> Column:
    claim, kind, stamp, amount, region = f[0], f[3], f[4], f[5], f[6]
    year, month, day = (F.substring(stamp, a, b) for a, b in ((1, 4), (6, 2), (9, 2)))
    exists = F.try_make_timestamp(year.try_cast("int"), month.try_cast("int"), day.try_cast("int"), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")).isNotNull()
    return (
        (F.trim(F.regexp_replace(claim, r"\s", " ")) != "")
        & kind.isin(*EVENT_TYPES)
        & stamp.rlike(_STAMP.replace("$", r"\z"))
        & exists
        & amount.rlike(_AMOUNT.replace("$", r"\z"))
        & ((region == "") | region.isin(*REGIONS))
    )


def assessed(df: DataFrame, raw: str = "raw_value") -> DataFrame:
    """Adds ``_text``, ``_fields`` (unquoted values, null unless ten well-formed fields) and ``_ok``."""
    out = df.withColumn("_text", record_text(F.col(raw)))
    # One-element explodes hold back the optimizer, which would otherwise repeat the parse for each field.
    out = out.withColumn("_cells", F.explode(F.array(_zero_cost_fields(F.col("_text")))))
    ten = F.when(F.size("_cells") == len(COLUMNS), F.transform("_cells", _unquoted))
    out = out.withColumn("_fields", F.explode(F.array(ten))).drop("_cells")
    cells = [F.get(F.col("_fields"), F.lit(i)) for i in range(len(COLUMNS))]
    return out.withColumn("_ok", F.coalesce(_values_valid(cells), F.lit(False)))


def loaded_rows(df: DataFrame, raw: str = "raw_value", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """The valid records as typed rows; empty optional fields are null."""
    cell = lambda i: F.nullif(F.get(F.col("_fields"), F.lit(i)), F.lit(""))
    typed = {n: cell(i) for i, n in enumerate(COLUMNS)}
    typed["event_timestamp"] = cell(4).try_cast("timestamp")
    typed["amount"] = cell(5).try_cast("decimal(18,2)")
    return assessed(df, raw).filter("_ok").select(*keep, *[c.alias(n) for n, c in typed.items()])


# --- minimum-cost reading in Python -----------------------------------------------------------------------------------

_TOKEN = re.compile(r'[";]|[^";]+')
_STAMP_RE, _AMOUNT_RE = re.compile(_STAMP.replace("$", r"\Z")), re.compile(_AMOUNT.replace("$", r"\Z"))
_START, _PLAIN, _QUOTED, _CLOSED = range(4)
_FAR = 1 << 60


def _step(state: int, token: str) -> int | None:
    """The next state of the record grammar, or None."""
    if token == '"':
        return {_START: _QUOTED, _QUOTED: _CLOSED, _CLOSED: _QUOTED}.get(state)
    if state == _QUOTED:
        return _QUOTED
    if token == ";":
        return _START
    return None if state == _CLOSED else _PLAIN


def quote_edits(text: str) -> tuple[int, list[tuple[str, int]], str]:
    """Fewest insertions and deletions of quotes that make ``text`` well-formed: cost, edits with offsets, new text."""
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text)]
    cost, trail = [0, _FAR, _FAR, _FAR], []
    for token, _ in [*tokens, ("", len(text))]:
        # At most one quote may be inserted before a token: two in a row never help.
        opened = [(cost[s], s, False) for s in range(4)]
        for s in range(4):
            to = _step(s, '"')
            if to is not None and cost[s] + 1 < opened[to][0]:
                opened[to] = (cost[s] + 1, s, True)
        after, back = [_FAR] * 4, [None] * 4
        for s in range(4):
            c, origin, inserted = opened[s]
            if c >= _FAR:
                continue
            if not token:
                moves = [(s, c, False)] if s != _QUOTED else []
            else:
                moves = [(to, c, False)] if (to := _step(s, token)) is not None else []
                if token == '"':
                    moves.append((s, c + 1, True))
            for to, total, deleted in moves:
                if total < after[to]:
                    after[to], back[to] = total, (origin, inserted, deleted)
        cost = after
        trail.append(back)
    state = min(range(4), key=lambda s: cost[s])
    total, edits, parts = cost[state], [], []
    for (token, at), back in zip(reversed([*tokens, ("", len(text))]), reversed(trail)):
        state, inserted, deleted = back[state]
        if deleted:
            edits.append(("delete quote", at))
        parts.append("" if deleted else token)
        if inserted:
            edits.append(("insert quote", at))
            parts.append('"')
    return total, edits[::-1], "".join(reversed(parts))


def fields_of(text: str) -> list[str]:
    """Raw fields of a well-formed record."""
    fields, current, state = [], [], _START
    for token in _TOKEN.findall(text):
        state = _step(state, token)
        if token == ";" and state == _START:
            fields.append("".join(current))
            current = []
        else:
            current.append(token)
    return [*fields, "".join(current)]


_QUOTE = 1 << 40  # a quote edit, counted in delimiter edits


def record_edits(text: str, columns: int = len(COLUMNS)) -> tuple[int, int, list[tuple[str, int]], str]:
    """The reading of least cost: its quote edits, its delimiter edits, the quote edits with offsets, and the text with
    sound quoting. Each delimiter outside quotes ends a column; those beyond the last column, and columns that are missing
    at the end, cost an edit each."""
    quotes, edits, mended = quote_edits(text)
    last, apart = columns - 1, abs(len(fields_of(mended)) - columns)
    if not quotes or not apart:
        return quotes, apart, edits, mended
    most = quotes * _QUOTE + apart
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(text)] + [("", len(text))]
    # States are (quoting, column); each holds its cost and the trail of edits that lead to it.
    held: dict[tuple[int, int], tuple[int, tuple | None]] = {(_START, 0): (0, None)}

    def reach(states: dict, state: tuple[int, int], cost: int, trail) -> None:
        if cost <= most and (state not in states or states[state][0] > cost):
            states[state] = cost, trail

    for token, at in tokens:
        opened = dict(held)
        for (s, j), (cost, trail) in held.items():
            to = _step(s, '"')
            if to is not None:
                reach(opened, (to, j), cost + _QUOTE, ("insert quote", at, trail))
        if not token:
            held = opened
            break
        held = {}
        for (s, j), (cost, trail) in opened.items():
            to = _step(s, token)
            if token == ";" and s != _QUOTED:
                reach(held, (_START, min(j + 1, last)), cost + (j == last), trail)
            elif to is not None:
                reach(held, (to, j), cost, trail)
            if token == '"':
                reach(held, (s, j), cost + _QUOTE, ("delete quote", at, trail))
    cost, trail = min(((c + last - j, t) for (s, j), (c, t) in held.items() if s != _QUOTED), key=lambda x: x[0])
    found = []
    while trail:
        what, at, trail = trail
        found.append((what, at))
    found.reverse()
    parts, done = [], 0
    for what, at in found:
        parts += [text[done:at], '"' if what == "insert quote" else ""]
        done = at + (what == "delete quote")
    return *divmod(cost, _QUOTE), found, "".join([*parts, text[done:]])


def _plain_value(field: str) -> str:
    return field[1:-1].replace('""', '"') if field.startswith('"') else field


def value_valid(column: int, value: str) -> bool:
    name = COLUMNS[column]
    if name == "claim_id":
        return bool(value.strip())
    if name == "event_type":
        return value in EVENT_TYPES
    if name == "event_timestamp":
        m = _STAMP_RE.match(value)
        try:
            return bool(m) and bool(date(int(m[1]), int(m[2]), int(m[3])))
        except ValueError:
            return False
    if name == "amount":
        return bool(_AMOUNT_RE.match(value))
    if name == "region":
        return value == "" or value in REGIONS
    return True


def delimiter_edits(values: list[str]) -> tuple[int, list[tuple[str, int]], list[int]]:
    """Fewest delimiter edits that turn the fields into the columns, and of those the one with the most valid values.

    Returns the number of edits, the edits with the number of the field or column, and the columns left invalid.
    """
    n, m = len(COLUMNS), len(values)
    best = [[(_FAR, _FAR)] * (n + 1) for _ in range(m + 1)]
    back: list[list] = [[None] * (n + 1) for _ in range(m + 1)]
    best[0][0] = (0, 0)
    for i in range(m + 1):
        for j in range(n + 1):
            edits, wrong = best[i][j]
            if edits >= _FAR:
                continue
            moves = []
            if i < m and j < n:
                moves.append((i + 1, j + 1, (edits, wrong + (not value_valid(j, values[i]))), "take"))
            if j < n and m < n:
                moves.append((i, j + 1, (edits + 1, wrong), "insert delimiter"))
            if i < m and j > 0 and m > n:
                moves.append((i + 1, j, (edits + 1, wrong), "delete delimiter"))
            for a, b, cost, what in moves:
                if cost < best[a][b]:
                    best[a][b], back[a][b] = cost, (i, j, what)
    i, j, ops, wrong = m, n, [], []
    while (i, j) != (0, 0):
        a, b, what = back[i][j]
        if what == "take":
            if not value_valid(b, values[a]):
                wrong.append(b)
        else:
            ops.append((what, b if what.startswith("insert") else a))
        i, j = a, b
    return best[m][n][0], ops[::-1], wrong[::-1]


def diagnose(text: str | None) -> tuple[str | None, str]:
    """The reason why a record fails (None: it doesn't) and the edits of its cheapest reading."""
    if text is None:
        return COUNT, "no record"
    quotes, _, quoting, mended = record_edits(text)
    values = [_plain_value(f) for f in fields_of(mended)]
    cost, edits, wrong = delimiter_edits(values)
    stated = [*[f"{what} at {at}" for what, at in quoting], *[f"{what} at field {at + 1}" for what, at in edits]]
    if stated:
        return BROKEN if quotes else COUNT, "; ".join(stated)
    if wrong:
        return INVALID, "; ".join(f"invalid {COLUMNS[c]}" for c in wrong)
    return None, ""


def _diagnose_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [diagnose(t) for t in batch.column(batch.schema.get_field_index("_text")).to_pylist()]
        keep = [i for i, n in enumerate(batch.schema.names) if n != "_text"]
        arrays = [batch.column(i) for i in keep] + [pa.array([r for r, _ in found], pa.string()), pa.array([e for _, e in found], pa.string())]
        yield pa.RecordBatch.from_arrays(arrays, names=[*[batch.schema.names[i] for i in keep], "_reason", "_edits"])


def rejected_rows(df: DataFrame, raw: str = "raw_value", keep: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """``keep`` columns, ``_reason`` and ``_edits`` of every record that doesn't load. A null record has no fields and
    fails by ``column_count``; an empty one has a single field."""
    suspicious = assessed(df, raw).filter(~F.col("_ok")).select(*keep, "_text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in suspicious.schema if f.name != "_text") + ", _reason string, _edits string"
    return suspicious.mapInArrow(_diagnose_batches, schema).filter(F.col("_reason").isNotNull())
