"""Texts that were cut off by a field limit or during transfer.

The words of the whole corpus form a trie, kept as its nodes in sorted order. A text whose end isn't finished is cut

* by its ``word``, if its final token is no known word but a proper prefix of one,
* else by its ``length``, if it lies at a length at which unfinished texts of its source pile up,
* else by its ``structure``, if the end leaves markup open or a running sentence without its end and no mark says so.

The word and the length are looked up for every unfinished end; the structure tells which ends are finished, and decides
alone only what falls between words at no common length. Ends that may be natural, such as list items, single words or
prose before an ellipsis, are no case without word or length. A sentence mark inside markup that the last line leaves
open may end the sentence only: there the length decides alone.

In sorted order the words below a node of the trie follow it directly. Tokens and words are brought into that order by
one range partitioning, whose parts are of even size however many words share a beginning, and a single pass from the
end gives each token the next word. A token at the end of a part looks at the first word of the parts behind it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import dealt, salted_join, stored

#: Marks that sources set where they cut.
MARKS = (" [...]", "[...]", "…", "...")
#: A length is a limit of its source if so many unfinished texts have it, and so large a share of its unfinished texts.
LIMIT_TEXTS, LIMIT_SHARE = 5, 0.05
#: Characters that trimming may take off a text cut at a limit.
TRIMMED = 3

_TERMINALS = frozenset(".!?…。！？؟۔")
_CLOSERS = "\"”»“'’)]）」』 \t\r\n\u00a0"
_WORD = re.compile(r"[^\W_]+")
_OPEN_TAG = regex.compile(r"<(?:/?[a-zA-Z][^<>]*|/|!-{0,2})?$")
_TRAILER = regex.compile(r"(?:<ref\b[^<>]*/>|<ref\b[^<>]*>(?:(?!<ref\b).)*?</ref>|\{\{[^{}]*\}\}|\{\{\{[^{}]*\}\}\})\s*$", regex.S)
_TABLE_END = regex.compile(r"(?:^|\n)\|\}(?!\})")
_NOTE = regex.compile(r"<ref\b[^<>]*(?<!/)>")
_ENTITY = regex.compile(r"&#?\w{0,8}$")
_HEADING = regex.compile(r"^(=+)[^=].*?(=+)$")
_BEHIND_HEADING = regex.compile(r"^(={2,6})[^=]+\1(?!=)\s*(\S.*)$")
_LINKS = regex.compile(r"^(?:\[\[[^\[\]]*\]\]\s*)+$")
_CLOSED = regex.compile(r"(?:<[^<>]*/>|</\w+>|-->|~{3,5}|\|\})$")
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]")
_PARENS = {")": "(", "）": "（"}

FINISHED, OPEN, PROSE, BARE, INSIDE = "finished", "open", "prose", "bare", "inside"


def _closes(text: str) -> bool:
    """Whether ``text`` ends a sentence; quotes and brackets may follow."""
    return text.rstrip(_CLOSERS)[-1:] in _TERMINALS


def _last_word(text: str) -> str | None:
    """The letters and digits that touch the end of ``text``."""
    at = len(text)
    while at and text[at - 1].isalnum():
        at -= 1
    return text[at:] or None


def ending(text: str) -> str:
    """How ``text`` ends: ``finished``, ``open`` (markup), ``prose`` (running sentence) or ``bare`` (may be natural)."""
    s = text.rstrip()
    if not s:
        return FINISHED
    line = s[s.rfind("\n") + 1 :].lstrip()
    terminal = _closes(s)
    if s[-1] in "�[{<" or ("&" in line[-10:] and _ENTITY.search(line)) or s.rfind("<!--") > s.rfind("-->") or _OPEN_TAG.search(line):
        return OPEN
    if "<" in line:
        low = line.lower()
        note = max((m.start() for m in _NOTE.finditer(low)), default=-1)
        if note > low.rfind("</ref"):
            return OPEN
    if not terminal and (line.rfind("[[") > line.rfind("]]") or line.rfind("{{") > line.rfind("}}")):
        return OPEN
    if line[0] in "|!" or line.startswith("{|"):
        closed = max((m.start() for m in _TABLE_END.finditer(s)), default=-1)
        if s.rfind("{|") > closed or (s.rfind("{{") > s.rfind("}}")):
            return OPEN
    whole = line
    while True:
        cut = _TRAILER.sub("", line).rstrip() if line[-1:] in "}>" else line
        if cut == line:
            break
        line = cut
    if not line or not _WORD.search(line) or _CLOSED.search(line):
        return FINISHED
    if line[0] == "=":
        m = _HEADING.match(line)
        if m and m[1] == m[2]:
            return FINISHED
        # Words may stand behind a heading on its line.
        behind = _BEHIND_HEADING.match(line)
        if not behind:
            return OPEN
        return FINISHED if _closes(behind[2]) or not _WORD.search(behind[2]) else PROSE
    if _closes(line) or _LINKS.match(line) or (line[0] == "#" and line.endswith("]]")):
        return FINISHED
    if line[-1] in _PARENS:
        before = line[: line.rfind(_PARENS[line[-1]])].rstrip() if _PARENS[line[-1]] in line else ""
        before = _TRAILER.sub("", before).rstrip()
        if not before or _closes(before):
            return FINISHED
    if line[0] in "*#:;|!":
        return FINISHED if line.endswith("]]") else BARE
    # A single word opens a sentence where other lines stand before it; alone it may be all there is.
    return PROSE if len(_WORD.findall(line)) > 1 or _UNSPACED.search(line) or "\n" in s.strip() or line != whole else BARE


def _inside(text: str) -> bool:
    """Whether the last line of ``text`` leaves a link or template open."""
    s = text.rstrip()
    line = s[s.rfind("\n") + 1 :]
    return any(line.rfind(a) > line.rfind(b) or line.count(a) > line.count(b) for a, b in (("[[", "]]"), ("{{", "}}")))


def _mark(text: str) -> str:
    return next((m for m in MARKS if text.endswith(m)), "")


def described(text: str) -> tuple[str, bool, str | None, int, int]:
    """Ending, whether a mark of a cut stands there, final token, and length before the mark in characters and bytes."""
    mark = _mark(text)
    body = text[: len(text) - len(mark)]
    plain = html.unescape(html.unescape(body)) if "&" in body else body
    end = ending(plain)
    return INSIDE if end == FINISHED and _inside(plain) else end, bool(mark), _last_word(plain), len(body), len(body.encode())


_PARTS = "_id {id}, _source {source}, _ending string, _marked boolean, _token string, _chars int, _bytes int, _word string"
_KINDS = (pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32())


def _words_before_end(text: str) -> list[str]:
    """The words of a text without the one that touches its end, or the mark there: it is no evidence for itself."""
    body = text[: len(text) - len(_mark(text))]
    words = _WORD.findall(body)
    return words[:-1] if words and body.endswith(words[-1]) else words


def _take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for the end of each text, and one for each distinct word of a batch."""
    for batch in batches:
        texts = batch.column("_text").to_pylist()
        columns = list(zip(*map(described, texts))) or [[]] * 5
        words = list({w for t in texts for w in _words_before_end(t)})
        n, m = len(texts), len(words)
        both = lambda c: pa.concat_arrays([c, pa.nulls(m, c.type)])
        ends = [batch.column("_id"), batch.column("_source"), *[pa.array(list(c), t) for c, t in zip(columns, _KINDS)]]
        known = pa.array([None] * n + words, pa.string())
        yield pa.RecordBatch.from_arrays([*map(both, ends), known], names=["_id", "_source", "_ending", "_marked", "_token", "_chars", "_bytes", "_word"])


def unknown_prefixes(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """The ``_token`` values that are no ``_word`` but a proper prefix of one. Words and tokens may repeat; null and empty
    tokens are left out."""
    both = words.select(F.col("_word").alias("_s"), F.lit(True).alias("w")).unionByName(tokens.select(F.col("_token").alias("_s"), F.lit(False).alias("w")))
    nodes = both.filter(F.length("_s") > 0).groupBy("_s").agg(F.bool_or("w").alias("_known"), F.bool_or(~F.col("w")).alias("_asked"))
    # Stored, since another run of the range partitioning might draw other borders.
    placed = stored(nodes.repartitionByRange("_s").withColumn("_part", F.spark_partition_id()))
    word = F.when(F.col("_known"), F.col("_s"))
    from_end = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    following = F.last(word, ignorenulls=True).over(from_end(Window.partitionBy("_part").orderBy(F.col("_s").desc())))
    # One row a part: the number of parts bounds what is ordered in one task and broadcast.
    parts = placed.groupBy("_part").agg(F.min(word).alias("_first"))
    behind = F.last("_first", ignorenulls=True).over(Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", behind.alias("_behind"))
    open_tokens = placed.withColumn("_following", following).filter(F.col("_asked") & ~F.col("_known"))
    longer = open_tokens.join(F.broadcast(parts), "_part").filter(F.coalesce("_following", "_behind").startswith(F.col("_s")))
    return longer.select(F.col("_s").alias("_token"))


def source_limits(ends: DataFrame) -> DataFrame:
    """``_source``, ``_unit`` (chars or bytes) and ``_limit``: lengths at which unfinished texts of a source pile up."""
    unfinished = ends.filter(~F.col("_ending").isin(FINISHED, INSIDE))
    lengths = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(f"_{u}").alias("n")) for u in ("chars", "bytes")])
    counted = unfinished.select("_source", F.explode(lengths).alias("l")).groupBy("_source", F.col("l.unit").alias("_unit"), F.col("l.n").alias("_limit")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("_source", "_unit"))
    return counted.withColumn("total", total).filter((F.col("n") >= LIMIT_TEXTS) & (F.col("n") >= LIMIT_SHARE * F.col("total"))).select("_source", "_unit", "_limit")


WORD, LENGTH, STRUCTURE = "word", "length", "structure"


def _evidence(end: Column, marked: Column, cut_word: Column, at_limit: Column) -> Column:
    """What shows that a text was cut; null if nothing does."""
    running = (end == OPEN) | ((end == PROSE) & ~marked)
    return F.when(end == FINISHED, F.lit(None).cast("string")).when(cut_word, WORD).when(at_limit, LENGTH).when(running, STRUCTURE)


def assessed(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """``_id``, ``_source``, ``_ending``, ``_at_limit``, ``_cut_word``, ``_evidence`` and ``_truncated`` of every non-empty text.

    Null and empty texts were not cut and have no row. Texts without source share one. Repeated rows each give a row.
    """
    texts = documents.select(F.col(id_column).alias("_id"), F.col(source_column).alias("_source"), F.col(text_column).alias("_text"))
    texts = dealt(texts).filter(F.length("_text") > 0)
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    # Texts are read once; their ends and the distinct words of each batch are stored, as several steps read them.
    parts = stored(texts.mapInArrow(_take_apart, _PARTS.format(id=kinds["_id"], source=kinds["_source"])))
    ends = parts.filter(F.col("_ending").isNotNull()).drop("_word")
    unfinished = ends.filter(F.col("_ending") != FINISHED)
    cut = unknown_prefixes(parts.select("_word"), unfinished).withColumn("_cut", F.lit(True))
    limits = source_limits(ends).groupBy("_source").agg(
        F.collect_set(F.when(F.col("_unit") == "chars", F.col("_limit"))).alias("_c"), F.collect_set(F.when(F.col("_unit") == "bytes", F.col("_limit"))).alias("_b")
    )
    # A source or a final token may have most of the rows.
    row = F.struct("_id", "_chars", "_bytes")
    named = F.struct(F.col("_source"))
    joined = salted_join(unfinished, cut, "_token", row).withColumn("_named", named)
    joined = salted_join(joined, limits.select(named.alias("_named"), "_c", "_b"), "_named", row)
    near = lambda limits, n: F.coalesce(F.exists(limits, lambda x: (n <= x) & (n >= x - TRIMMED)), F.lit(False))
    flags = joined.withColumns({"_at_limit": near(F.col("_c"), F.col("_chars")) | near(F.col("_b"), F.col("_bytes")), "_cut_word": F.coalesce("_cut", F.lit(False))})
    evidence = _evidence(F.col("_ending"), F.col("_marked"), F.col("_cut_word"), F.col("_at_limit"))
    out = ["_id", "_source", "_ending", "_at_limit", "_cut_word", "_evidence"]
    no = F.lit(False)
    finished = ends.filter(F.col("_ending") == FINISHED).select("_id", "_source", "_ending", no.alias("_at_limit"), no.alias("_cut_word"), F.lit(None).cast("string").alias("_evidence"))
    return flags.withColumn("_evidence", evidence).select(*out).unionByName(finished).withColumn("_truncated", F.col("_evidence").isNotNull())


def source_rates(documents: DataFrame, source_column: str = "source", **columns) -> DataFrame:
    """Per source: texts, cut texts, how many of them each kind of evidence shows, and the share of cut texts among all rows."""
    all_rows = documents.groupBy(F.col(source_column).alias("source")).agg(F.count(F.lit(1)).alias("texts"))
    cut = assessed(documents, source_column=source_column, **columns).groupBy("_source").agg(
        F.count_if("_truncated").alias("truncated"), *[F.count_if(F.col("_evidence") == e).alias(f"by_{e}") for e in (WORD, LENGTH, STRUCTURE)]
    )
    n = F.coalesce("truncated", F.lit(0))
    joined = all_rows.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left")
    shown = [F.coalesce(f"by_{e}", F.lit(0)).alias(f"by_{e}") for e in (WORD, LENGTH, STRUCTURE)]
    return joined.select("source", "texts", n.alias("truncated"), *shown, (n / F.col("texts")).alias("share"))
