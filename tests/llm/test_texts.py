"""Problems 7 and 9 against a public encoder, brute force, and odd texts."""

import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from flowmill.llm import tokenize
from flowmill.llm.bpe import DEFAULT_DIR, SPLIT, BytePairEncoder, _ranks
from flowmill.llm.shared_spans import Hashed, SentenceRuns, SharedSpans, sentences

ODD = ["", " ", "a", "a" * 3000, "ab" * 900, "日本語のテキスト、検出。" * 5, "<|endoftext|> and <|startoftext|>", "don't we'll I'M\n\n\t  x  ", " 　 ​\x00\x07", "é 😀👩‍👩‍👧 ﷺ", "0123456789" * 50]


@pytest.fixture(scope="module")
def enc():
    return BytePairEncoder(tokenize.VOCABULARY)


@pytest.fixture(scope="module")
def other():
    path = f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken"
    return tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks={t: i for i, t in enumerate(_ranks(path))}, special_tokens={})


def test_encoder_equals_the_public_one(enc, other):
    rng = random.Random(3)
    alphabets = ["ab", "etaoin shrdlu", "äöüéñ日本の 語", "0123.,:;-_/ \n", "aA'sS tT"]
    texts = ODD + ["".join(rng.choice(a) for _ in range(rng.randint(1, 80))) for a in alphabets for _ in range(400)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == other.encode_ordinary(t), t
        assert enc.decode(ids) == t


def test_rank_file_and_vocabulary_agree(enc):
    ranked = BytePairEncoder(f"{DEFAULT_DIR}/byte_bpe_50k.tiktoken")
    assert all(ranked.encode(t) == enc.encode(t) for t in ODD)


def test_every_token_encodes_to_itself(enc):
    assert all(enc.is_own(i) for i in range(len(enc.tokens)))
    assert not enc.compatible(enc.id_of[b"t"], enc.id_of[b"he"])  # "the" is one token


def test_null_and_empty_texts_have_no_ids(spark, other):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *ODD])], "doc_id bigint, _text string, ids string").repartition(3)
    got = {r["doc_id"]: r["ids"] for r in tokenize.encode(df, F.col("_text"), {"doc_id": F.col("doc_id")}).collect()}
    assert got[0] == [] and got[1] == [] and all(got[i + 1] == other.encode_ordinary(t) for i, t in enumerate(ODD))
    counted = {r[0]: r[1] for r in tokenize.count_tokens(df, F.col("_text"), {"doc_id": F.col("doc_id")}).collect()}
    assert counted == {k: len(v) for k, v in got.items()}
    ids = spark.createDataFrame([(k, v) for k, v in got.items()] + [(99, None)], "doc_id bigint, ids array<int>")
    back = {r[0]: r[1] for r in tokenize.decode(ids, F.col("ids"), {"doc_id": F.col("doc_id")}).collect()}
    assert back[99] is None and back[0] == "" and all(back[i + 1] == t for i, t in enumerate(ODD))


def test_encoding_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert tokenize.encode(df, F.col("text"), {"doc_id": F.col("doc_id")}).collect() == []


# --- 9 ------------------------------------------------------------------------


def _brute(docs, length):
    windows = {}
    for i, t in docs:
        for p in range(len(t or "") - length + 1):
            windows.setdefault(t[p : p + length], set()).add(i)
    pairs = {(a, b) for s in windows.values() for a in s for b in s if a < b}
    covered = {}
    for i, t in docs:
        hit = set()
        for p in range(len(t or "") - length + 1):
            if len(windows[t[p : p + length]]) > 1:
                hit.update(range(p, p + length))
        covered[i] = len(hit)
    return pairs, covered


def _docs():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghé日😀") for _ in range(rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    core, phrase = text(60), text(12)[:45]
    docs = [(i, text(30) + phrase + text(20)) for i in range(25)]
    for k, (a, n) in enumerate([(0, 160), (3, 60), (10, 59), (10, 61), (40, 200), (100, 90), (17, 60)]):
        docs.append((100 + k, text(9) + core[a : a + n] + text(7)))
    docs += [(200, "=" * 400), (201, "=" * 100 + "x" + "=" * 90), (202, "ab" * 200), (203, None), (204, ""), (205, " \n ")]
    docs += [(300, docs[3][1]), (301, docs[3][1]), (302, docs[3][1][5:]), (303, core), (304, core + core)]
    return docs


@pytest.mark.parametrize("length,gram", [(60, 24), (60, 59), (30, 1)])
def test_shared_spans_match_brute_force(spark, length, gram):
    docs = _docs()
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id bigint, text string, rep int, anchor string").repartition(5)
    s = SharedSpans(df, "doc_id", "text", length, gram)
    pairs, covered = _brute(docs, length)
    got = [tuple(r) for r in s.pairs().collect()]
    assert len(got) == len(set(got)) and set(got) == pairs and len(pairs) > 10
    report = {r["doc"]: r for r in s.report().collect()}
    assert {i: report[i]["shared_chars"] for i, _ in docs} == covered
    assert all(report[i]["repeated_chars"] <= report[i]["shared_chars"] for i, _ in docs)
    assert report[301]["repeated_chars"] == report[301]["n_chars"] and report[203]["n_chars"] == 0


def test_shared_spans_of_nothing_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    s = SharedSpans(empty, "doc_id", "text")
    assert s.pairs().collect() == [] and s.report().collect() == []
    twice = spark.createDataFrame([(1, "q" * 300), (1, "q" * 300), (None, "q" * 300), (2, "q" * 170)], "doc_id bigint, text string")
    assert [tuple(r) for r in SharedSpans(twice, "doc_id", "text").pairs().collect()] == [(1, 2)]


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdef ") for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, "x" + long[200_000:200_160]), (3, long[5:164])], "doc_id bigint, text string")
    assert [tuple(r) for r in SharedSpans(df, "doc_id", "text").pairs().collect()] == [(1, 2)]


def test_sentences():
    texts = ["One. Two!  Three? v1.2 stays.\nNext line", "", " \n ", "日本語。次の文。", "no stop"]
    t = Hashed(texts)
    text, begin, end = sentences(t)
    got = [(int(i), t.joined[a:b]) for i, a, b in zip(text, begin, end, strict=True)]
    assert got == [(0, "One."), (0, "Two!"), (0, "Three?"), (0, "v1.2 stays."), (0, "Next line"), (3, "日本語。"), (3, "次の文。"), (4, "no stop")]


def test_repeated_sentence_runs_are_removed_once(spark):
    a, b, c = "Alpha host sent forty bytes to the sink.", "Beta host saw nothing at all today.", "Gamma closed the ticket without comment."
    docs = [(1, f"Head one. {a} {b} {c} Tail one."), (2, f"Head two. {a}  {b} {c}"), (3, f"{a} {b} {c} And more. {a} {b} {c}"), (4, f"{a} Only this."), (5, None), (6, ""), (7, f"x {b} {c}")]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs] + [(None, docs[0][1], "z")], "doc_id bigint, text string, doc string").repartition(3)
    r = SentenceRuns(df, "doc_id", "text", 70)
    got = {x["doc"]: x for x in r.cleaned().collect()}
    assert set(got) == {i for i, _ in docs} and got[1]["text"] == docs[0][1] and got[1]["removed"] == 0
    assert got[2]["text"] == f"Head two. {a}  " and got[2]["removed"] == 2  # two blanks stand inside the first run
    assert got[3]["text"] == "And more. " and got[3]["removed"] == 6
    assert got[4]["text"] == docs[3][1] and got[5]["text"] is None and got[6]["text"] == ""
    assert got[7]["text"] == docs[6][1]  # its run begins with another sentence
    assert sorted(tuple(x) for x in r.pairs().collect()) == [(1, 2), (1, 3), (2, 3)]
    assert {tuple(x) for x in r.pairs().collect()} <= {tuple(x) for x in SharedSpans(df, "doc_id", "text", 70, 30).pairs().collect()}


def test_sentence_runs_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    r = SentenceRuns(empty, "doc_id", "text")
    assert r.cleaned().collect() == [] and r.pairs().collect() == []
