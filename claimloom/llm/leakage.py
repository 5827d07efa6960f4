"""Evaluation passages that stand in a training corpus.

The test items form an inverted index with BM25 weights: sorted postings of each term, and the largest weight of the term
in each block of items that it occurs in. Every passage of the corpus, a window of its words, is a query. The threshold
of an item is the least score that any run of ``RUN`` consecutive words of its passage can have; weights are divided by
it, so one bound of 1 retrieves every window that can hold such a run, and none is missed.

Retrieval is block-max WAND. The terms of a window are cursors on their postings. Ordered by item, their largest weights
are summed until they reach the bound; the item there is the pivot, and all items before it are skipped unread. Where the
maxima of the pivot's block stay below the bound the cursors leap over the block; else the pivot is scored. All windows
of a batch make these steps together, each by one binary search over the postings. Retrieved pairs are verified word by
word, and the overlap of the passage's surroundings with question and answer is measured.

Items are a stated query set. They are indexed on the executors in shards of bounded size; as many shards as fit the
bound on broadcasts are searched in one scan of the corpus, which is never shuffled.
"""

from __future__ import annotations

import html
import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.session import dealt, stored

#: Consecutive words that make a leak.
RUN = 13
#: Words of a window; windows start every ``WINDOW - RUN + 1`` words, so each run lies in one.
WINDOW = 26
#: Items of one index shard, and of one block of its postings.
SHARD, BLOCK = 4_096, 8
#: Bytes of index shards that are broadcast for one scan of the corpus.
INDEX_BYTES = 64 << 20
#: Words on either side of a window among which question and answer are looked for.
CONTEXT = 64
#: Windows of a text that are scored at once; bounds the memory of very long texts.
AT_ONCE = 4_096
#: Words of texts that are searched together.
TOKENS_AT_ONCE = 1_000_000
# The usual parameters of BM25.
K1, B = 1.2, 0.75

_COMMENT = re.compile(r"<!--.*?-->", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)*([^\[\]|]*)\]\]")
_SITE = re.compile(r"\[(?:https?:)?//[^\s\]]+\s*([^\]]*)\]")
_QUOTES = re.compile(r"'{2,}")
_COMBINING = regex.compile(r"\p{M}+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
# Markup that sets words apart becomes one sign each: template open and close, note open and close, bar and equals sign.
_OPEN, _CLOSE, _NOTE, _NOTE_END, _BAR, _EQUALS = SIGNS = "\ue000\ue001\ue002\ue003\ue004\ue005"
_PIECES = re.compile(f"[^\\W_]+|[{SIGNS}]")


def _tag_sign(m: re.Match) -> str:
    tag = m[0].lower()
    if tag.startswith("</ref"):
        return _NOTE_END
    return _NOTE if tag.startswith("<ref") and tag[4:5] in " >\t\n" and not tag.endswith("/>") else ""


def pieces(text: str) -> list[str]:
    """Words, folded (without case and diacritics), and signs of a wiki text. A link stands for its visible words, an
    entity for its character."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = _TAG.sub(_tag_sign, _COMMENT.sub("", text))
    if "[" in text:
        text = _SITE.sub(r"\1", _LINK.sub(r"\1", text))
    if "{{" in text:
        text = text.replace("{{", _OPEN).replace("}}", _CLOSE).replace("|", _BAR).replace("=", _EQUALS)
    if "''" in text:
        text = _QUOTES.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _INVISIBLE.sub("", text))
        text = _COMBINING.sub("", text)
    return _PIECES.findall(text.lower())


def plain_words(text: str) -> list[str]:
    return [w for w in pieces(text) if w not in SIGNS]


def _dropped(signs: list[tuple[int, str]], arguments: bool) -> list[tuple[int, int]]:
    """Ranges of pieces to leave out: notes, and templates up to their last argument or, without ``arguments``, whole.
    Markup that isn't closed is left in."""
    out, stack, note = [], [], None
    for at, sign in signs:
        if sign == _OPEN:
            stack.append([at, None])
        elif sign == _CLOSE and stack:
            start, keep = stack.pop()
            out += [(start, at + 1)] if keep is None or not arguments else [(start, keep + 1)]
        elif sign == _BAR and stack:
            stack[-1][1] = at
        elif sign == _EQUALS and stack and stack[-1][1] is not None and arguments:
            stack[-1][1] = at
        elif sign == _NOTE:
            note = at
        elif sign == _NOTE_END and note is not None:
            out.append((note, at + 1))
            note = None
    return out


def readings(tokens: np.ndarray, signs: list[tuple[int, str]]) -> Iterator[np.ndarray]:
    """Token sequences of a text: with the words of templates and notes; and, where there are any, without them, and
    with each template standing for its last argument. A passage may stand in a template or be interrupted by one."""
    if not signs:
        yield tokens
        return
    plain = np.ones(len(tokens), bool)
    plain[[at for at, _ in signs]] = False
    yield tokens[plain]
    seen: list = []
    for arguments in (False, True):
        ranges = _dropped(signs, arguments)
        if ranges and ranges not in seen:
            seen.append(ranges)
            mask = plain.copy()
            for start, end in ranges:
                mask[start:end] = False
            yield tokens[mask]


def _spot(haystack: bytes, needle: bytes) -> bool:
    """Whether the numbers packed in ``needle`` stand in a row in ``haystack``, four bytes each."""
    at = haystack.find(needle)
    while at % 4 > 0:  # -1 counts as 3: there is none
        if at < 0:
            return False
        at = haystack.find(needle, at + 1)
    return at >= 0


class Index:
    """Items as postings with block maxima; small enough to send to every executor."""

    def __init__(self, items: list[tuple[int, str | None, str | None, str | None]]):
        texts = [(i, plain_words(p or ""), plain_words(q or ""), plain_words(a or "")) for i, p, q, a in sorted(items, key=lambda x: x[0])]
        texts = [x for x in texts if len(x[1]) >= RUN]
        self.items = [x[0] for x in texts]
        frequency = Counter(w for x in texts for w in {*x[1]})
        self.terms = {w: k for k, w in enumerate(frequency)}
        #: Terms below this number have postings; those above stand in questions and answers only.
        self.posted = len(self.terms)
        for x in texts:
            for w in (*x[2], *x[3]):
                self.terms.setdefault(w, len(self.terms))
        numbers = lambda words: np.array([self.terms[w] for w in words], "<i4")
        self.passages = [numbers(x[1]).tobytes() for x in texts]
        self.questions = [frozenset(numbers(x[2]).tolist()) for x in texts]
        self.answers = [numbers(x[3]).tobytes() for x in texts]
        n, mean = len(texts), sum(len(x[1]) for x in texts) / max(len(texts), 1)
        idf = {w: math.log(1 + (n - f + 0.5) / (f + 0.5)) for w, f in frequency.items()}
        postings = []
        for d, (_, words, _, _) in enumerate(texts):
            norm = K1 * (1 - B + B * len(words) / mean)
            weight = {w: idf[w] * f * (K1 + 1) / (f + norm) for w, f in Counter(words).items()}
            # The bound is lowered by more than rounding may take from a sum.
            threshold = min(sum(weight[w] for w in {*words[k : k + RUN]}) for k in range(len(words) - RUN + 1)) * (1 - 1e-4)
            postings += [(self.terms[w], d, x / threshold) for w, x in weight.items()]
        postings.sort()
        # A posting is keyed by term and item in one number, so one binary search finds the next item of any term.
        self.span = n + BLOCK
        term, item, weight = (np.array(c, t) for c, t in zip(zip(*postings) if postings else ([], [], []), (np.int64, np.int64, np.float32)))
        self.keys, self.weights = term * self.span + item, weight
        blocks = term * self.span + item // BLOCK
        first = np.flatnonzero(np.diff(blocks, prepend=-1))
        self.block_keys = blocks[first]
        self.block_most = np.maximum.reduceat(weight, first) if len(first) else weight
        starts = np.searchsorted(term, np.arange(self.posted))
        #: The largest weight of each term; the last one stands for words without postings.
        self.most = np.append(np.maximum.reduceat(weight, starts) if len(starts) else weight, np.float32(0)).astype(np.float32)

    def _next(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The first item of each term from ``at`` on; ``span`` if there is none."""
        k = np.searchsorted(self.keys, terms * self.span + at)
        found = self.keys[np.minimum(k, len(self.keys) - 1)] - terms * self.span
        return np.where((k < len(self.keys)) & (found < self.span), found, self.span)

    @staticmethod
    def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        k = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[k] == wanted, values[k], np.float32(0))

    def _wand(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``terms`` (distinct terms of a window; ``posted`` where there is none) and the items that they retrieve."""
        rows, items = [], []
        row = np.arange(len(terms))
        most = self.most[terms]
        cursor = np.where(terms < self.posted, self._next(np.minimum(terms, self.posted - 1), np.zeros_like(terms)), self.span)
        while len(row):
            order = np.argsort(cursor, axis=1)
            ahead = np.take_along_axis(cursor, order, 1)
            sums = np.cumsum(np.where(ahead < self.span, np.take_along_axis(most, order, 1), 0), axis=1)
            live = sums[:, -1] >= 1
            if not live.all():
                row, terms, most, cursor, ahead, sums = (x[live] for x in (row, terms, most, cursor, ahead, sums))
                if not len(row):
                    break
            pivot = ahead[np.arange(len(row)), np.argmax(sums >= 1, axis=1)]
            upto = cursor <= pivot[:, None]
            i, j = np.nonzero(upto)
            bound = np.zeros(len(row), np.float32)
            np.add.at(bound, i, self._at(self.block_keys, self.block_most, terms[i, j] * self.span + pivot[i] // BLOCK))
            scored = bound >= 1
            # Where the block stays below the bound, nothing is found before its end or before the next cursor.
            beyond = np.where(upto, self.span, cursor).min(axis=1)
            target = np.where(scored, pivot + 1, np.minimum((pivot // BLOCK + 1) * BLOCK, beyond))
            score = np.zeros(len(row), np.float32)
            of = scored[i]
            np.add.at(score, i[of], self._at(self.keys, self.weights, terms[i[of], j[of]] * self.span + pivot[i[of]]))
            hit = score >= 1
            rows.append(row[hit])
            items.append(pivot[hit])
            cursor[i, j] = self._next(terms[i, j], target[i])
        none = np.zeros(0, np.int64)
        return (np.concatenate(rows), np.concatenate(items)) if rows else (none, none)

    def retrieve(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """(start of window, item) of all pairs that score 1 or more and have a run of words of the item."""
        if not self.items:
            return []
        n, step, found = len(tokens), WINDOW - RUN + 1, []
        terms = np.minimum(tokens, self.posted).astype(np.int64)
        starts = np.arange(0, max(n - RUN + 1, 1), step)
        # Words of a match lie in a run of words with postings whose largest weights reach the bound, and only such words
        # are asked for. A repeated word only raises these sums.
        total, unposted = np.zeros(n + 1), np.zeros(n + 1, np.int64)
        np.cumsum(self.most[terms], out=total[1:])
        np.cumsum(terms == self.posted, out=unposted[1:])
        covered = np.zeros(n + 1, np.int64)
        if n >= RUN:
            run = ((total[RUN:] - total[:-RUN] >= 1) & (unposted[RUN:] == unposted[:-RUN])).astype(np.int64)
            covered[: n - RUN + 1] += run
            covered[RUN:] -= run
        terms[np.cumsum(covered)[:n] == 0] = self.posted
        np.cumsum(self.most[terms], out=total[1:])
        starts = starts[total[np.minimum(starts + WINDOW, n)] - total[starts] >= 1]
        padded = np.concatenate([terms, np.full(WINDOW, self.posted)])
        for at in range(0, len(starts), AT_ONCE):
            windows = padded[starts[at : at + AT_ONCE, None] + np.arange(WINDOW)]
            words = np.sort(windows, axis=1)
            words[:, 1:][words[:, 1:] == words[:, :-1]] = self.posted
            window, item = self._wand(words)
            # A run of an item consists of words that the item has.
            has = np.zeros((len(item), WINDOW + 1), np.int8)
            np.cumsum(self._at(self.keys, self.weights, windows[window] * self.span + item[:, None]) > 0, axis=1, out=has[:, 1:])
            run = (has[:, RUN:] - has[:, :-RUN] == RUN).any(axis=1)
            found += zip(starts[at + window[run]].tolist(), item[run].tolist())
        return found

    def _overlap(self, d: int, around: np.ndarray) -> tuple[float, bool]:
        """Share of the question's words among the words ``around``, and whether the answer stands there."""
        asked, answer = self.questions[d], self.answers[d]
        return len(asked.intersection(around.tolist())) / len(asked) if asked else 0.0, bool(answer) and _spot(around.tobytes(), answer)

    def numbered(self, text: str | None) -> list[np.ndarray]:
        """The readings of a text as term numbers; words that no item has share one number."""
        found = pieces(text) if text else []
        if len(found) < RUN:
            return []
        none, get = len(self.terms), self.terms.get
        tokens = np.array([get(w, none) for w in found], "<i4")
        signs = [(k, w) for k, w in enumerate(found) if w in SIGNS] if _OPEN in text or "{{" in text or "<" in text or "&" in text else []
        return [*readings(tokens, signs)]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, float, bool]]:
        """(text, item, question overlap, answer stands) of every text in which a run of an item stands.

        The readings of many texts are laid end to end, with an unknown word between them, and searched at once. Of the
        places where an item stands in a text the largest overlap counts.
        """
        out: dict[tuple[int, int], tuple[float, bool]] = {}
        sequences: list[np.ndarray] = []
        owners: list[int] = []
        held, gap = 0, np.array([len(self.terms)], "<i4")
        for i, text in enumerate([*texts, None]):
            for seq in self.numbered(text):
                sequences += (seq, gap)
                owners.append(i)
                held += len(seq)
            if sequences and (held >= TOKENS_AT_ONCE or i == len(texts)):
                for i_, d, asked, stands in self._verified(sequences, owners):
                    a, b = out.get((i_, d), (0.0, False))
                    out[i_, d] = max(a, asked), b or stands
                sequences, owners, held = [], [], 0
        return [(*k, *v) for k, v in sorted(out.items())]

    def _verified(self, sequences: list[np.ndarray], owners: list[int]) -> Iterator[tuple[int, int, float, bool]]:
        tokens = np.concatenate(sequences)
        firsts = np.cumsum([0, *[len(a) + 1 for a in sequences[::2]]])
        for start, d in self.retrieve(tokens):
            passage = self.passages[d]
            if self._holds(tokens[start : start + WINDOW], passage):
                k = int(np.searchsorted(firsts, start, "right")) - 1
                # A window may begin in the text before.
                while start + WINDOW > firsts[k + 1] and not self._holds(tokens[max(start, firsts[k]) : min(firsts[k + 1], start + WINDOW)], passage):
                    k += 1
                around = tokens[max(firsts[k], start - CONTEXT) : min(firsts[k + 1] - 1, start + WINDOW + CONTEXT)]
                yield owners[k], d, *self._overlap(d, around)

    @staticmethod
    def _holds(tokens: np.ndarray, passage: bytes) -> bool:
        """Whether a run of the passage stands in ``tokens``."""
        packed = tokens.tobytes()
        return any(_spot(passage, packed[4 * k : 4 * (k + RUN)]) for k in range(len(tokens) - RUN + 1))


def _build(key, rows):
    """One shard of the index, packed."""
    import pandas as pd

    packed = pickle.dumps(Index([*rows[["item_id", "passage", "question", "answer"]].itertuples(index=False, name=None)]), protocol=5)
    return pd.DataFrame({"shard": [f"{key[0]}.{key[1]}"], "packed": [packed], "bytes": [len(packed)]})


def index_shards(items: DataFrame, shard: int = SHARD) -> DataFrame:
    """``shard``, ``packed`` and ``bytes``: the index in shards of at most ``shard`` items each. Items without id are left
    out; of several rows of an item the least counts."""
    row = F.struct("passage", "question", "answer")
    known = items.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min(row).alias("r")).select("item_id", "r.*")
    buckets = max(1, math.ceil(known.count() / shard))
    placed = known.withColumn("bucket", F.pmod(F.xxhash64("item_id"), F.lit(buckets)))
    number = F.row_number().over(Window.partitionBy("bucket").orderBy("item_id"))
    cut = placed.withColumn("part", F.floor((number - 1) / F.lit(shard)).cast("int"))
    return cut.groupBy("bucket", "part").applyInPandas(_build, "shard string, packed binary, bytes long")


def _scans(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Shards that are searched together: at most ``most`` bytes, but one shard at least."""
    scans, room = [], 0
    for name, size in sizes:
        if size > room or not scans:
            scans.append([])
            room = most
        scans[-1].append(name)
        room -= size
    return scans


def _searcher(packed):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[Index] = [pickle.loads(p) for p in packed.value]
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for index in ready:
                found = index.search(texts)
                rows, items, asked, answered = zip(*found) if found else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").take(pa.array(rows, pa.int64())),
                        pa.array([index.items[d] for d in items], pa.int64()),
                        pa.array(asked, pa.float64()),
                        pa.array(answered, pa.bool_()),
                    ],
                    names=["_id", "item_id", "question_overlap", "answer_stands"],
                )

    return search


def leaked(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", shard: int = SHARD, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``id_column``, ``item_id``, ``question_overlap``, ``answer_stands`` of every document that holds a run of an item.

    ``question_overlap`` is the share of the question's words, and ``answer_stands`` tells whether the answer stands,
    among the words of the passage's place and ``CONTEXT`` words around it. They grade a case and drop none.

    Empty and null texts hold none; items with fewer than ``RUN`` words are in none; an item without id is left out.
    Repeated rows each give their cases; of repeated items the least row counts. Shards of up to ``index_bytes`` in all
    are searched in one scan of the corpus; a larger index takes further scans.
    """
    texts = dealt(documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))).filter(F.length("_text") > 0)
    schema = f"_id {texts.schema['_id'].dataType.simpleString()}, item_id long, question_overlap double, answer_stands boolean"
    shards = stored(index_shards(items, shard))
    # One row a shard; the shards themselves come to the driver within the bound.
    sizes = [(r["shard"], r["bytes"]) for r in shards.select("shard", "bytes").orderBy("shard").collect()]
    out = documents.sparkSession.createDataFrame([], schema) if not sizes else None
    for names in _scans(sizes, index_bytes):
        packed = documents.sparkSession.sparkContext.broadcast([bytes(r["packed"]) for r in shards.filter(F.col("shard").isin(names)).collect()])
        found = texts.mapInArrow(_searcher(packed), schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("_id", id_column)
