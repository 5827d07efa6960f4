"""Schemas that drift between files: one consistent table and a report of each change.

The header of a file is the set of its fields with their types. Headers are read in parallel, one partial aggregate
per file and field; types are bit sets folded by ``bit_or`` and read through a promotion lattice:

    null < integer < decimal < text,   null < boolean | object | array < text

so any two kinds that have no common number type meet in text. Consecutive files of a feed are compared header by
header. A field that vanished and one that appeared are the same field renamed if all records that both files hold
carry equal values; this is decided by counting equal values, through an equality join on record and value.

Payloads are read once and stored as cells. Flat objects, which are nearly all, are taken apart by column expressions
that keep numbers as they are written, which the JSON functions of Spark don't; nested ones, escaped strings and whatever
is no JSON object are read in Python, in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import dealt, salted_join, stored

# One bit per type of a value.
TEXT, INTEGER, DECIMAL, BOOLEAN, OBJECT, ARRAY = 1, 2, 4, 8, 16, 32
#: Columns of the consistent table beyond which it must be read in parts.
MAX_COLUMNS = 2_000


class _Number(str):
    """Text of a number as it stands in the file."""

    __slots__ = ()


class _Float(_Number):
    __slots__ = ()


_decode = json.JSONDecoder(object_pairs_hook=lambda pairs: ("{", pairs), parse_int=_Number, parse_float=_Float, parse_constant=str).decode


def _text(value) -> str | None:
    """A value as text: strings as they are, numbers as written, containers as compact JSON."""
    if value is None or isinstance(value, str):
        return value if value is None else str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, tuple):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json(v)}" for k, v in value[1]) + "}"
    return "[" + ",".join(map(_json, value)) + "]"


def _json(value) -> str:
    if value is None:
        return "null"
    return json.dumps(value, ensure_ascii=False) if isinstance(value, str) and not isinstance(value, _Number) else _text(value)


def _kind(value) -> int:
    if value is None:
        return 0
    if isinstance(value, bool):
        return BOOLEAN
    if isinstance(value, _Float):
        return DECIMAL if "." in value else INTEGER if "-" not in value.lower().partition("e")[2] else DECIMAL
    if isinstance(value, _Number):
        return INTEGER
    return TEXT if isinstance(value, str) else OBJECT if isinstance(value, tuple) else ARRAY


def record_fields(payload: str | None) -> list[tuple[str, int, str | None]]:
    """Name, type bit and text of each field; of a repeated key the last counts. No object: no fields."""
    try:
        value = _decode(payload)
    except (TypeError, ValueError, RecursionError):
        return []
    if not isinstance(value, tuple):
        return []
    return [(k, _kind(v), _text(v)) for k, v in dict(value[1]).items()]


_CELLS = pa.list_(pa.struct([("field", pa.string()), ("kind", pa.int32()), ("value", pa.string())]))
_CELLS_SQL = "array<struct<field:string,kind:int,value:string>>"

# A JSON object without nesting and escapes. All repetitions are possessive, so no text is tried twice.
_BLANK, _PLAIN_STRING, _NUMBER = r"[ \t\r\n]*+", r'"[^"\\\x00-\x1f]*+"', r"-?(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_PAIR = rf"{_BLANK}{_PLAIN_STRING}{_BLANK}:{_BLANK}(?:{_PLAIN_STRING}|{_NUMBER}|true|false|null){_BLANK}"
_FLAT = rf"\A{_BLANK}\{{(?:{_PAIR}(?:,{_PAIR})*+|{_BLANK})\}}{_BLANK}\z"
_FIELD = rf'"([^"]*+)"{_BLANK}:{_BLANK}("[^"]*+"|[^", \t\r\n{{}}]++)'
#: Characters of a payload that the expressions read; matching one pair takes a frame of the stack. Longer ones are read in Python.
_FLAT_CHARS = 8_000


def _flat_cells(df: DataFrame, payload: str) -> DataFrame:
    """Adds ``_cells`` of flat objects with distinct keys; null for other payloads.

    The one-element explodes keep the optimizer from repeating a step for every use of its result.
    """
    fields, raws = (F.regexp_extract_all(payload, F.lit(_FIELD), F.lit(i)).alias(n) for i, n in ((1, "fields"), (2, "raws")))
    flat = (F.length(payload) <= _FLAT_CHARS) & F.col(payload).rlike(_FLAT)

    def cell(name: Column, raw: Column) -> Column:
        text = raw.startswith('"')
        number = F.when(raw.contains(".") | raw.rlike("[eE]-"), DECIMAL).otherwise(INTEGER)
        kind = F.when(text, TEXT).when(raw.isin("true", "false"), BOOLEAN).when(raw == "null", 0).otherwise(number)
        value = F.when(text, F.substr(raw, F.lit(2), F.length(raw) - 2)).when(raw != "null", raw)
        return F.struct(name.alias("field"), kind.alias("kind"), value.alias("value"))

    taken = df.withColumn("_taken", F.explode(F.array(F.when(flat, F.struct(fields, raws)))))
    distinct = F.size(F.array_distinct("_taken.fields")) == F.size("_taken.fields")
    cells = F.when(distinct, F.zip_with("_taken.fields", "_taken.raws", cell)).cast(_CELLS_SQL)
    return taken.withColumn("_cells", F.explode(F.array(cells))).drop("_taken")


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        i = batch.schema.get_field_index("_payload")
        found = [record_fields(p) for p in batch.column(i).to_pylist()]
        ends = [0]
        for cells in found:
            ends.append(ends[-1] + len(cells))
        columns = list(zip(*[c for cells in found for c in cells])) or [[], [], []]
        flat = pa.StructArray.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _CELLS.value_type)], fields=[*_CELLS.value_type])
        names = [n for n in batch.schema.names if n != "_payload"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=[*names, "_cells"])


def parsed_records(df: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ("feed_id", "file_no")) -> DataFrame:
    """``keep`` columns and ``_cells``, the fields of the record as (field, kind, value). Payloads are read once and stored."""
    rows = df.select(*keep, F.col(payload).alias("_payload"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_payload") + f", _cells {_CELLS_SQL}"
    read = _flat_cells(dealt(rows), "_payload")
    read = stored(read.withColumn("_payload", F.when(F.col("_cells").isNull(), F.col("_payload"))).withColumn("_rest", F.col("_cells").isNull()))
    rest = read.filter("_rest").select(*keep, "_payload").mapInArrow(_parse_batches, schema)
    return read.filter(~F.col("_rest")).select(*keep, "_cells").unionByName(stored(rest))


def promoted(mask: Column) -> Column:
    """The name of the least type above all types in a bit set; null if there are only nulls."""
    return (
        F.when(mask == 0, F.lit(None).cast("string"))
        .when(mask == INTEGER, "integer")
        .when(mask.isin(DECIMAL, DECIMAL | INTEGER), "decimal")
        .when(mask == BOOLEAN, "boolean")
        .when(mask == OBJECT, "object")
        .when(mask == ARRAY, "array")
        .otherwise("text")
    )


def file_headers(records: DataFrame) -> DataFrame:
    """``feed_id``, ``file_no``, ``field``, ``mask`` of every field of every file."""
    return records.select("feed_id", "file_no", F.explode("_cells").alias("c")).groupBy("feed_id", "file_no", F.col("c.field").alias("field")).agg(F.bit_or("c.kind").alias("mask"))


def _number_size(value: Column) -> tuple[Column, Column]:
    """Digits of a number before and after the point, its exponent applied."""
    part = lambda i: F.regexp_extract(value, r"\A-?([0-9]+)(?:\.([0-9]+))?(?:[eE]([+-]?[0-9]+))?\z", i)
    power = F.when(part(3) == "", 0).otherwise(F.coalesce(part(3).try_cast("int"), F.lit(1_000_000)))
    power = F.greatest(F.least(power, F.lit(1_000_000)), F.lit(-1_000_000))
    return F.greatest(F.length(part(1)) + power, F.lit(1)), F.greatest(F.length(part(2)) - power, F.lit(0))


def sized_headers(records: DataFrame) -> DataFrame:
    """``file_headers`` with ``whole`` and ``fraction``, the most digits of a number on either side of the point."""
    number = F.col("c.kind").isin(INTEGER, DECIMAL)
    whole, fraction = _number_size(F.col("c.value"))
    return (
        records.select("feed_id", "file_no", F.explode("_cells").alias("c"))
        .groupBy("feed_id", "file_no", F.col("c.field").alias("field"))
        .agg(F.bit_or("c.kind").alias("mask"), F.coalesce(F.max(F.when(number, whole)), F.lit(0)).alias("whole"), F.coalesce(F.max(F.when(number, fraction)), F.lit(0)).alias("fraction"))
    )


def _steps(records: DataFrame) -> DataFrame:
    """One row for each file that has one before it: ``fields`` of either as (field, was, now), masks or -1 if absent.

    Each record also counts for a field without name, which tells that a file exists, whatever its records hold.
    """
    named = F.transform("_cells", lambda c: F.struct(c["field"].alias("field"), c["kind"].alias("kind")))
    exists = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.lit(0).alias("kind")))
    known = records.filter(F.col("feed_id").isNotNull() & F.col("file_no").isNotNull())
    headers = file_headers(known.select("feed_id", "file_no", F.concat(exists, named).alias("_cells")))
    sides = F.array(F.struct("file_no", F.col("mask").alias("now"), F.lit(-1).alias("was")), F.struct((F.col("file_no") + 1).alias("file_no"), F.lit(-1).alias("now"), F.col("mask").alias("was")))
    masks = headers.select("feed_id", "field", F.explode(sides).alias("s")).groupBy("feed_id", "s.file_no", "field").agg(F.max("s.was").alias("was"), F.max("s.now").alias("now"))
    steps = masks.groupBy("feed_id", "file_no").agg(F.collect_list(F.struct("field", "was", "now")).alias("fields"))
    both = steps.filter(F.exists("fields", lambda f: f["field"].isNull() & (f["was"] >= 0) & (f["now"] >= 0)))
    return both.withColumn("fields", F.filter("fields", lambda f: f["field"].isNotNull()))


def _gone(fields: str) -> Column:
    return F.filter(fields, lambda f: f["now"] == -1)


def _came(fields: str) -> Column:
    return F.filter(fields, lambda f: f["was"] == -1)


def _renames(records: DataFrame, steps: DataFrame) -> DataFrame:
    """``feed_id``, ``file_no`` and ``pairs`` (old_field, new_field) of fields whose values agree in all shared records.

    Each record is the older side of one pair of files and the newer side of another. Of the copies of a record in one
    file the least one counts (cell by cell), so a record sent any number of times stays small.
    """
    at = ["feed_id", "file_no"]
    place = F.struct(*at).alias("_place")
    names = lambda fields: F.transform(fields, lambda f: f["field"])
    candidates = steps.select(place, names(_gone("fields")).alias("gone"), names(_came("fields")).alias("came")).filter((F.size("gone") > 0) & (F.size("came") > 0))
    known = records.filter(F.col("ref").isNotNull() & F.col("feed_id").isNotNull() & F.col("file_no").isNotNull())
    sides = known.select("feed_id", "ref", "_cells", F.explode(F.array(*[F.struct((F.col("file_no") + i).alias("file_no"), F.lit(bool(i)).alias("older")) for i in (0, 1)])).alias("s"))
    # A file may hold most of the records.
    sides = salted_join(sides.select("feed_id", "s.file_no", "s.older", "ref", "_cells").withColumn("_place", place), candidates, "_place", F.col("ref")).filter(F.col("gone").isNotNull())
    wanted = F.when(F.col("older"), F.col("gone")).otherwise(F.col("came"))
    cells = F.transform(
        F.filter("_cells", lambda c: c["value"].isNotNull() & F.array_contains(wanted, c["field"])),
        lambda c: F.struct(c["field"].alias("field"), c["value"].alias("value")),
    )
    least = lambda side, name: F.min(F.when(side, F.col("cells"))).alias(name)
    compared = sides.select(*at, "ref", "older", cells.alias("cells")).groupBy(*at, "ref").agg(least(F.col("older"), "old"), least(~F.col("older"), "new"))
    old, new, none = F.col("old"), F.col("new"), F.lit(None).cast("string")
    pair = lambda o, n: F.struct(o.alias("old_field"), n.alias("new_field"))
    met = F.flatten(F.transform(old, lambda o: F.transform(F.filter(new, lambda n: n["value"] == o["value"]), lambda n: pair(o["field"], n["field"]))))
    # Counts of a field alone stand beside the counts of its pairs.
    counted = (
        compared.filter("old is not null and new is not null")
        .select(*at, F.explode(F.concat(met, F.transform(old, lambda o: pair(o["field"], none)), F.transform(new, lambda n: pair(none, n["field"])))).alias("p"))
        .groupBy(*at, "p.old_field", "p.new_field")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*at)
        .agg(F.collect_list(F.struct("old_field", "new_field", "n")).alias("all"))
    )
    same = lambda p, q, field: q[field] == p[field]
    alone = lambda p, field, other: F.exists("all", lambda q: same(p, q, field) & q[other].isNull() & (q["n"] == p["n"]))
    agreed = F.filter("all", lambda p: p["old_field"].isNotNull() & p["new_field"].isNotNull() & alone(p, "old_field", "new_field") & alone(p, "new_field", "old_field"))
    # A field is renamed once: of several candidates, the first by name on either side.
    first = lambda p, field, other: ~F.exists("agreed", lambda q: same(p, q, field) & (q[other] < p[other]))
    once = F.filter("agreed", lambda p: first(p, "old_field", "new_field") & first(p, "new_field", "old_field"))
    pairs = F.transform(once, lambda p: pair(p["old_field"], p["new_field"]))
    return counted.withColumn("agreed", agreed).select(*at, pairs.alias("pairs")).filter(F.size("pairs") > 0)


def drift(records: DataFrame, record_key: str) -> tuple[DataFrame, DataFrame]:
    """The steps between consecutive files and the renamings among them. Both have the size of the headers; steps are
    stored, as several results read them."""
    steps = stored(_steps(records))
    return steps, _renames(records.withColumn("ref", _cell("_cells", record_key)), steps)


def schema_changes(df: DataFrame, record_key: str = "external_reference_id", payload: str = "payload") -> DataFrame:
    """``feed_id``, ``file_no``, ``change``, ``old_field``, ``new_field`` for each file against the one before.

    Rows come in the order of feeds, files and names. Records without ``record_key`` take no part in recognising renamings.
    A field with only nulls has no type, and no change of type is reported for it. Payloads that are no JSON object hold
    no fields; their file still exists.
    """
    at = ["feed_id", "file_no"]
    steps, renamed = drift(parsed_records(df, payload), record_key)
    no_pairs = F.array().cast("array<struct<old_field:string,new_field:string>>")
    joined = steps.join(renamed, at, "left").withColumn("pairs", F.coalesce("pairs", no_pairs))
    row = lambda change, old, new: F.struct(F.lit(change).alias("change"), old.alias("old_field"), new.alias("new_field"))
    unpaired = lambda f, side: ~F.exists("pairs", lambda p: p[side] == f["field"])
    of = lambda name, side, mask: F.get(F.filter("fields", lambda f: (f["field"] == name) & (f[side] == -1)), F.lit(0))[mask]
    other_type = lambda was, now: F.coalesce(promoted(was) != promoted(now), F.lit(False))
    kept = F.filter("fields", lambda f: (f["was"] >= 0) & (f["now"] >= 0) & other_type(f["was"], f["now"]))
    moved = F.filter("pairs", lambda p: other_type(of(p["old_field"], "now", "was"), of(p["new_field"], "was", "now")))
    changes = F.concat(
        F.transform("pairs", lambda p: row("renamed", p["old_field"], p["new_field"])),
        F.transform(F.filter(_gone("fields"), lambda f: unpaired(f, "old_field")), lambda f: row("removed", f["field"], F.lit(""))),
        F.transform(F.filter(_came("fields"), lambda f: unpaired(f, "new_field")), lambda f: row("added", F.lit(""), f["field"])),
        F.transform(kept, lambda f: row("retyped", f["field"], f["field"])),
        F.transform(moved, lambda p: row("retyped", p["old_field"], p["new_field"])),
    )
    return joined.select(*at, F.explode(changes).alias("c")).select(*at, "c.*").orderBy(*at, "change", "old_field", "new_field")


def _cell(cells: str, field: str) -> Column:
    return F.get(F.filter(F.col(cells), lambda c: c["field"] == field), F.lit(0))["value"]


# --- the consistent table ---------------------------------------------------------------------------------------------


def _follow_feed(key, headers, renames):
    """Name under which each field of each file goes: the first name of its chain of renamings within the feed."""
    import pandas as pd

    moved = {(r.file_no, r.new_field): r.old_field for r in renames.itertuples()}
    rows, before = [], {}
    for file_no, part in headers.sort_values("file_no").groupby("file_no"):
        now = {}
        for r in part.sort_values("field").itertuples():
            old = moved.get((file_no, r.field))
            if old is not None or r.field in before:
                now[r.field] = before.get(old, old) if old is not None else before[r.field]
        # A new field may bear the first name of one that goes under another name by now.
        for r in part.sort_values("field").itertuples():
            if r.field not in now:
                taken, name, k = {*now.values()}, r.field, 1
                while name in taken:
                    k += 1
                    name = f"{r.field}~{k}"
                now[r.field] = name
        rows += [(key[0], file_no, r.field, now[r.field], r.mask, r.whole, r.fraction) for r in part.itertuples()]
        before = {f: n for f, n in before.items() if n not in {*now.values()}} | now
    return pd.DataFrame(rows, columns=["feed_id", "file_no", "field", "name", "mask", "whole", "fraction"])


def field_names(records: DataFrame, record_key: str = "external_reference_id") -> DataFrame:
    """``feed_id``, ``file_no``, ``field``, ``name``, ``mask``, ``whole`` and ``fraction`` for every field of every file.
    Only headers are grouped by feed."""
    headers = stored(sized_headers(records).filter(F.col("feed_id").isNotNull() & F.col("file_no").isNotNull()))
    _, renamed = drift(records, record_key)
    renamed = renamed.select("feed_id", "file_no", F.explode("pairs").alias("p")).select("feed_id", "file_no", "p.*")
    schema = "feed_id string, file_no int, field string, name string, mask int, whole int, fraction int"
    return stored(headers.groupBy("feed_id").cogroup(renamed.groupBy("feed_id")).applyInPandas(_follow_feed, schema))


#: Digits of the widest decimal.
_DIGITS = 38


def column_type(kind: str, whole: int, fraction: int) -> str:
    """The Spark type that holds every value of a column: numbers as narrow as their digits allow, and text where no
    number type holds them all."""
    if kind == "integer" and whole <= 18:
        return "bigint"
    if kind in ("integer", "decimal") and whole + fraction <= _DIGITS:
        return f"decimal({_DIGITS},{fraction})"
    return "boolean" if kind == "boolean" else "string"


def union_schema(names: DataFrame, max_columns: int = MAX_COLUMNS) -> list[tuple[str, str]]:
    """Name and Spark type of each column over all files, by name. It has the size of a schema and is read by the driver;
    beyond ``max_columns`` it raises."""
    folded = names.groupBy("name").agg(F.bit_or("mask").alias("mask"), F.max("whole").alias("whole"), F.max("fraction").alias("fraction"))
    rows = folded.select("name", F.coalesce(promoted(F.col("mask")), F.lit("text")).alias("kind"), "whole", "fraction").orderBy("name").limit(max_columns + 1).collect()
    if len(rows) > max_columns:
        raise ValueError(f"the union schema has more than {max_columns} columns")
    return [(r["name"], column_type(r["kind"], r["whole"], r["fraction"])) for r in rows]


def _typed(value: Column, kind: str) -> Column:
    # Whole numbers may be written with an exponent, which decimals read.
    return value.cast("decimal(38,0)").cast("bigint") if kind == "bigint" else value.cast(kind)


def consistent_table(df: DataFrame, record_key: str = "external_reference_id", payload: str = "payload", keep: tuple[str, ...] = ("record_id",)) -> DataFrame:
    """All records under the union schema, renamed fields under their first name, values cast to the promoted type.

    Types are chosen from the digits of all values, so every value is held exactly. Names that differ only in case get a
    number appended from the second on, as do names that clash with ``keep``. Records without fields keep their row.
    """
    identity = ("feed_id", "file_no", *keep)
    records = parsed_records(df, payload, identity)
    names = field_names(records, record_key)
    columns = union_schema(names)
    chains = names.groupBy(F.struct("feed_id", "file_no").alias("_place")).agg(F.map_from_entries(F.collect_list(F.struct("field", "name"))).alias("_names"))
    # A file may hold most of the records.
    named = salted_join(records.withColumn("_place", F.struct("feed_id", "file_no")), chains, "_place", F.struct(*keep)).withColumn(
        "_values", F.map_from_entries(F.transform("_cells", lambda c: F.struct(F.element_at("_names", c["field"]), c["value"])))
    )
    used = {c.lower() for c in identity}
    out = []
    for name, kind in columns:
        label, k = name, 1
        while label.lower() in used:
            k += 1
            label = f"{name}__{k}"
        used.add(label.lower())
        out.append(_typed(F.element_at("_values", F.lit(name)), kind).alias(label))
    return named.select(*identity, *out)
