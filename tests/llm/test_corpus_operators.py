import html
import pickle
import random
import time
import unicodedata
from pathlib import Path

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimloom.llm import encode, leakage, queries, truncation
from claimloom.session import read_table

pytestmark = pytest.mark.skipif(not Path(encode.VOCABULARY).exists(), reason="no vocabulary files")

TEXTS = [
    "Hello world, it's  2024!\n\n  Ünïcode — 東京 🎉", "", None, " ", "\n\n\n", "a" * 5000, "<|endoftext|> is text", "l'été\tÇa va?  ", "x\u0000y", "don't we'll ''s 'S", " 　  z",
    "नमस्ते दुनिया", "العربية ١٢٣", "word " * 300,
]


def direct(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(encode.VOCABULARY)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t) for i, t in enumerate(texts)], "doc_id long, text string")


# --- encoding


@pytest.mark.parametrize(("block", "hot"), [(1, 10_000), (1, 1), (50, 2), (1_000_000, 10_000)])
def test_ids_equal_the_tokenizer(spark, monkeypatch, block, hot):
    monkeypatch.setattr(encode, "BLOCK_WORDS", block)
    monkeypatch.setattr(encode, "HOT_BLOCKS", hot)
    monkeypatch.setattr(encode, "HOT_WORDS", 3)
    df = documents(spark, TEXTS).withColumn("_block", F.lit(1)).withColumn("ids", F.lit("clash")).repartition(3)
    got = {r.doc_id: list(r.ids) for r in encode.encoded(df).collect()}
    assert got == dict(enumerate(direct(TEXTS)))


def test_repeated_and_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d")], "doc_id long, text string")
    got = sorted((str(r.doc_id), list(r.ids)) for r in encode.encoded(df).collect())
    want = direct(["a b", "c", "d"])
    assert got == sorted([("1", want[0]), ("1", want[0]), ("1", want[1]), ("None", want[2])])
    assert encode.encoded(documents(spark, [])).count() == 0
    assert [list(r.ids) for r in encode.encoded(documents(spark, ["", None])).collect()] == [[], []]


def test_blocks_of_empty_texts_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(encode, "BLOCK_TEXTS", 7)
    df = documents(spark, [None, ""] * 50).coalesce(1)
    assert {tuple(r.ids) for r in encode.encoded(df).collect()} == {()} and encode.encoded(df).count() == 100
    parts = df.mapInArrow(encode._into_blocks(1_000_000, 7), encode._PARTS.format(id="long"))
    assert max(r["count"] for r in parts.groupBy("_block").count().collect()) == 7


def test_round_trip(spark):
    back = {r.doc_id: r.text for r in encode.decoded(encode.encoded(documents(spark, TEXTS))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    odd = spark.createDataFrame([(1, [0xFFFF % 50000]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert encode.decoded(odd).count() == 3


def test_corpus_of_the_test_tables(spark, small):
    docs = {r.doc_id: r.text for r in read_table(spark, small, "documents").select("doc_id", "text").collect()}
    ids = {r.doc_id: list(r.ids) for r in queries.p8_ids(spark, small).collect()}
    assert ids == dict(zip(docs, direct(list(docs.values()))))
    assert {r.doc_id: r.text for r in queries.p8_decoded(spark, small).collect()} == {k: v or "" for k, v in docs.items()}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_cover_the_text(text):
    assert "".join(encode.SPLIT.findall(text)) == text


# --- leaked passages

WORDS = [f"w{k}" for k in range(400)]
RNG = random.Random(5)
PASSAGES = [" ".join(RNG.choices(WORDS, k=60)) for _ in range(30)] + ["too short to leak"]
ITEMS = [(i, f"what is {p.split()[0]}", p, f"answer{i} word") for i, p in enumerate(PASSAGES)]


def items(spark, rows=ITEMS):
    return spark.createDataFrame(rows, "item_id long, question string, passage string, answer string")


def plain_words(text):
    """Words by the definition, without regard to markup."""
    text = unicodedata.normalize("NFKD", html.unescape(text))
    return regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"\p{M}", "", text).lower())


def brute(texts, passages):
    runs = {i: {tuple(w[k : k + 13]) for k in range(len(w) - 12)} for i, w in enumerate(map(plain_words, passages))}
    out = set()
    for d, t in enumerate(texts):
        w = plain_words(t or "")
        grams = {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
        out |= {(d, i) for i, r in runs.items() if grams & r}
    return out


def filler(n):
    return " ".join(RNG.choices(WORDS, k=n))


def test_every_run_is_found_wherever_it_stands(spark):
    texts = []
    for n in range(60):
        p = PASSAGES[n % 30].split()
        at, length = RNG.randrange(0, 45), RNG.choice([12, 13, 14, 40])
        texts.append(f"{filler(n)} {' '.join(p[at : at + length])} {filler(RNG.randrange(90))}")
    texts += [None, "", PASSAGES[0], PASSAGES[3] + " " + PASSAGES[4], filler(3000) + " " + PASSAGES[7]]
    found = {(r.doc_id, r.item_id) for r in leakage.leaked(documents(spark, texts), items(spark)).collect()}
    assert found == brute(texts, PASSAGES) and len(found) > 30
    sharded = {(r.doc_id, r.item_id) for r in leakage.leaked(documents(spark, texts), items(spark), shard=7).collect()}
    assert sharded == found


@pytest.mark.parametrize(
    "around",
    [
        lambda w: " ".join(w), lambda w: " ".join(w).upper(), lambda w: "\n\n".join(w), lambda w: ", ".join(f"'''{x}'''" for x in w), lambda w: " ".join(f"[[Page ({x})|{x}]]" for x in w),
        lambda w: " ".join(f"[[{x}]]" for x in w), lambda w: " ".join(f"[https://x.y/z {x}]" for x in w), lambda w: " ".join(f"<b class='q'>{x}</b>" for x in w), lambda w: "&nbsp;".join(w),
        lambda w: "{{quote|text=" + " ".join(w) + "|author=Someone}}", lambda w: " ".join(w[:6]) + "{{citation needed|date=May 2001}} " + " ".join(w[6:]),
        lambda w: " ".join(w[:6]) + "<ref name='a'>Some, ''Source'', p. 3.</ref> " + " ".join(w[6:]), lambda w: " ".join(w[:6]) + " <!-- no --> " + " ".join(w[6:]),
        lambda w: " ".join(w[:6]) + " {{lang|pt|" + w[6] + "}} " + " ".join(w[7:]), lambda w: " ".join(w[:6]) + '<ref name="x" /> ' + " ".join(w[6:]), lambda w: html.escape("<i>" + " ".join(w) + "</i>"),
        lambda w: " ".join(x[0] + "́" + x[1:] for x in w), lambda w: " ".join(x[0] + "­" + x[1:] for x in w),
    ],
)
def test_markup_does_not_hide_a_passage(around):
    index = leakage.Index([(i, p, q, a) for i, q, p, a in ITEMS])
    words = PASSAGES[2].split()[10:23]
    assert [(i, d) for i, d, _, _ in index.search(["nothing here", f"Start. {around(words)}. End of it."])] == [(1, 2)]
    assert not index.search([f"Start. {around(words[:12])}. End of it."])


def test_known_runs_of_the_test_tables(spark, small):
    docs = {r.doc_id: r.text for r in read_table(spark, small, "documents").collect()}
    known = {r.item_id: r.passage for r in read_table(spark, small, "eval_items").collect()}
    keys, names = list(docs), list(known)
    found = {(r.doc_id, r.item_id) for r in queries.p9_found(spark, small).collect()}
    assert {(keys[d], names[i]) for d, i in brute(list(docs.values()), list(known.values()))} <= found


def test_overlap_and_odd_items(spark):
    rows = [*ITEMS[:3], (3, None, None, None), (None, "q", PASSAGES[5], "a"), ITEMS[0]]
    text = f"what is {PASSAGES[0]} answer0 word"
    df = documents(spark, [text, text]).withColumn("item_id", F.lit(9)).withColumn("_id", F.lit("x"))
    got = [(r.doc_id, r.item_id, r.question_overlap, r.answer_stands) for r in leakage.leaked(df, items(spark, rows)).collect()]
    assert sorted(got) == [(0, 0, 1.0, True), (1, 0, 1.0, True)]
    assert leakage.leaked(documents(spark, []), items(spark)).count() == 0 and leakage.leaked(df, items(spark, [])).count() == 0


def test_bound_never_exceeds_a_run():
    """The least score of a run reaches the bound, so retrieval can't miss it."""
    index = leakage.Index([(i, p, "", "") for i, p in enumerate(PASSAGES)])
    weight = dict(zip(index.keys.tolist(), index.weights.tolist()))
    for d, p in enumerate(PASSAGES[:30]):
        w = [index.terms[x] for x in p.split()]
        for k in range(len(w) - 12):
            assert sum(weight[t * index.span + d] for t in {*w[k : k + 13]}) >= 1
            assert d in {i for _, i in index.retrieve(np.array(w[k : k + 13], "<i4"))}


def test_pivots_retrieve_what_a_full_evaluation_retrieves():
    rng = random.Random(11)
    passages = [" ".join(rng.choices(WORDS[:60], k=40)) for _ in range(50)]
    index = leakage.Index([(i, p, "", "") for i, p in enumerate(passages)])
    weight = dict(zip(index.keys.tolist(), index.weights.tolist()))
    rows = np.array([sorted(rng.sample(range(index.posted), 26)) for _ in range(300)])
    want = {(r, d) for r, terms in enumerate(rows.tolist()) for d in range(50) if sum(weight.get(t * index.span + d, 0) for t in terms) >= 1}
    assert {*zip(*(x.tolist() for x in index._wand(rows)))} == want and len(want) > 50


def test_many_items_take_one_scan_and_shards_are_bounded(spark):
    many = spark.range(10_000).selectExpr("id AS item_id", "'' AS question", "concat_ws(' ', transform(sequence(0, 19), k -> concat('t', id * 20 + k))) AS passage", "'' AS answer")
    df = documents(spark, ["x " + " ".join(f"t{k}" for k in range(9_999 * 20 + 3, 9_999 * 20 + 17)), None, " ".join(f"t{k}" for k in range(5, 17))])
    out = leakage.leaked(df, many)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert [(r.doc_id, r.item_id) for r in out.collect()] == [(0, 9_999)]
    sizes = [len(pickle.loads(r.packed).items) for r in leakage.index_shards(many, shard=900).collect()]
    assert max(sizes) <= 900 and sum(sizes) == 10_000
    assert leakage._scans([("a", 5), ("b", 9), ("c", 2), ("d", 3)], 10) == [["a"], ["b"], ["c", "d"]]
    small = items(spark)
    several = leakage.leaked(documents(spark, [PASSAGES[0], PASSAGES[9]]), small, shard=7, index_bytes=1)
    assert {(r.doc_id, r.item_id) for r in several.collect()} == {(0, 0), (1, 9)}


def test_question_and_answer_count_near_the_passage_only(spark):
    far = filler(400)
    text = f"what is answer0 word {far} {PASSAGES[0]}"
    near = leakage.leaked(documents(spark, [text]), spark.createDataFrame([(0, "what zebra", PASSAGES[0], "answer0 word")], "item_id long, question string, passage string, answer string")).first()
    assert (near.question_overlap, near.answer_stands) == (0.0, False)


# --- truncation


@pytest.mark.parametrize(
    ("text", "end"),
    [
        ("It was built in 1900.", "finished"), ("It was built in 1900", "prose"), ("He said “it was.”", "finished"), ("A\n\n[[Category:X]]", "finished"), ("A\n\n[[Categ", "open"), ("A near [[Foo", "open"),
        ("A near [[Foo]]", "prose"), ("A.\n* [[Foo]]", "finished"), ("A.\n* Foo, quar", "bare"), ("A.{{cn|date=May}}", "finished"), ("See {{main|X}}", "prose"), ("A. {{conver", "open"),
        ("A.<ref>Foo, p. 3.</ref>", "finished"), ("A.<ref>Foo, p.", "open"), ("A.</re", "open"), ("{| class=x\n|-\n| a || b", "open"), ("{| class=x\n|-\n| a || b\n|}", "finished"),
        ("{{Infobox\n| a = 1", "open"), ("{{Infobox\n| a = 1\n}}", "finished"), ("A.\n== Notes ==", "finished"), ("A.\n== Not", "open"), ("A.\n== Notes =", "open"), ("#REDIRECT [[X]]", "finished"),
        ("A. ~~~~", "finished"), ("A. (seen 2 June 2016)", "finished"), ("call it (pronounced X)", "prose"), ("The [[Osta] page and {{unclosed were never tidied.", "finished"), ("   \n", "finished"), ("", "finished"),
        ("A.\n\nTh", "prose"), ("word", "bare"), ("人口は約1613人。", "finished"), ("人口は約1613", "prose"), ("wie �", "open"), ("A.<!-- note", "open"), ("A &am", "open"), ("A.\n<references />", "finished"),
        ("A!  ", "finished"), ("هل بنى الجسر؟", "finished"), ("هل بنى", "prose"),
    ],
)
def test_endings(text, end):
    assert truncation.ending(text) == end


def test_evidence_is_combined(spark):
    long = "The quarry was closed and the harbour opened again. "
    rows = [(f"{long * 3}The harb", "s1")] + [(f"{long}{'x' * k} was closed and the harbour op"[-60:], "s2") for k in range(6)]
    rows += [(f"{long}\n* item, quar", "s1"), (f"{long}\n* item, quarry", "s1"), (f"{long}The matter was never settled…", "s1"), (f"{long}The matter was never sett…", "s1")]
    rows += [(long, "s1"), (None, "s1"), ("", None), ("quarr", None), ("zzz", None), ("the settled q", None), ("q", None)]
    df = spark.createDataFrame([(i, t, s, "extra") for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string, _ending string")
    got = {r._id for r in truncation.assessed(df).filter("_truncated").collect()}
    assert got == {0, *range(1, 7), 7, 10, 14, 16, 17}
    rates = {r.source: (r.texts, r.truncated, r.by_word, r.by_length, r.by_structure) for r in truncation.source_rates(df).collect()}
    assert rates["s2"] == (6, 6, 6, 0, 0) and rates["s1"] == (7, 3, 3, 0, 0) and rates[None] == (5, 3, 3, 0, 0)


def test_each_kind_of_evidence_decides_alone(spark):
    """A cut word in a list, which may end anywhere; whole words at one length; and a sentence without end."""
    word = [("The quarry shut.\n* item, quar", "a"), ("The quarry shut.\n* item, quarry", "a")]
    length = [(f"The quarry shut.\n* {'y' * k} item, quarry shut item"[-30:].replace("\n", " * "), None) for k in range(5)]
    structure = [("The quarry was shut and", "b"), ("Was shut and The quarry", "b")]
    rows = [*word, *[("* " + t[-28:].rjust(28, "x"), s) for t, s in length], *structure]
    df = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    got = {r._id: r._evidence for r in truncation.assessed(df).collect()}
    assert got == {0: "word", 1: None, **{k: "length" for k in range(2, 7)}, 7: "structure", 8: "structure"}


def test_a_sentence_mark_in_open_markup_leaves_it_to_the_limit(spark):
    cut = [f"The quarry was closed and the harbour {'x' * k} opened ag"[-40:] for k in range(5)]
    ends = ["{{quote|text=The quarry was closed.", "near [[St.", "{{quote|text=The {{lang|pt|cais}} shut.", "{{quote|text=The quarry}} shut.", "The quarry was closed."]
    rows = [*cut, *[e.rjust(40, "y") for e in ends], *[e.rjust(50, "y") for e in ends]]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(rows)], "doc_id long, text string, source string")
    assert {r._id for r in truncation.assessed(df).filter("_truncated").collect()} == {*range(5), 5, 6, 7}


@pytest.mark.parametrize("parts", [1, 7])
def test_prefixes_against_a_plain_search(spark, parts):
    rng = random.Random(3)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 6))) for _ in range(60)]
    tokens = ["".join(rng.choices("abcd", k=rng.randrange(1, 5))) for _ in range(300)]
    known = set(words)
    want = {t for t in tokens if t not in known and any(w.startswith(t) for w in known)}
    asked = spark.createDataFrame([(t,) for t in [*tokens, None, ""]], "_token string")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r._token for r in truncation.unknown_prefixes(spark.createDataFrame([(w,) for w in words], "_word string"), asked).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == want and len(got) > 5


def test_words_of_one_beginning_take_time_in_proportion(spark):
    took = {}
    for n in (20_000, 20_000, 200_000):
        words = spark.range(n).selectExpr("concat('co', lpad(id, 7, '0')) AS _word")
        tokens = spark.range(0, n, 100).selectExpr("concat('co', substr(lpad(id, 7, '0'), 1, 6)) AS _token")
        began = time.perf_counter()
        assert truncation.unknown_prefixes(words, tokens).count() == n // 100
        took[n] = time.perf_counter() - began
    assert took[200_000] < 15 * max(took[20_000], 0.5)


def test_empty_corpus(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert truncation.assessed(empty).count() == truncation.source_rates(empty).count() == 0


def test_queries_have_their_columns(spark, small):
    assert queries.p8_ids(spark, small).dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    assert queries.p9_found(spark, small).dtypes == [("doc_id", "bigint"), ("item_id", "bigint")]
    assert queries.p10_found(spark, small).dtypes == [("doc_id", "bigint")]
