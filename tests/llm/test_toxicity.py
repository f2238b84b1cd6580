"""Toxicity grammar: composed transducers, learnt words, held-out figures and awkward rows."""

import itertools
import random
import zlib

import numpy as np
import pytest

from tabvet.llm import toxicity as T

from .data import LONG, documents, nothing

SF = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3


def marks(text):
    return [m for _, _, m in T.clauses(text, T.Lexicon(), T.grammar())]


@pytest.mark.parametrize(
    "text, want",
    [
        ("You are an idiot.", ["insult aimed"]),
        ("What a moron!", ["insult"]),
        ("A moron, they are.", ["insult aimed"]),
        ("It was not stupid at all.", ["denied"]),
        ("It is not that simple, moron.", ["insult"]),
        ("Not one of all things here is stupid.", ["insult"]),
        ("The judge said it was pathetic. It rained.", ["insult reported"]),
        ('One wrote: "What a clown! A loser." Then a scum came.', ["insult reported", "insult reported", "insult"]),
        ('One wrote: "What a clown!"\nA scum came.', ["insult reported", "insult"]),
        ("We will destroy you.", ["threat meant"]),
        ("Go and hurt them.", ["threat"]),
        ("You saw how they beat time.", []),
        ("I will not kill you.", ["denied"]),
        ("You idiot, I will kill you.", ["insult aimed", "threat meant"]),
        ("Du bist ein Trottel!", ["insult aimed"]),
        ("Isn't stupid", ["denied"]),
        ("A fine day. You are here.", []),
        ("idiot", ["insult"]),
        ("", []),
    ],
)
def test_marks_of_clauses(text, want):
    assert marks(text) == want


def test_spans_hold_their_clauses():
    text = "İt was fine. You utter moron! Then İ slept; no fool here."
    found = T.clauses(text, T.Lexicon(), T.grammar())
    assert [(text[a:b], m) for a, b, m in found] == [("You utter moron!", "insult aimed"), ("no fool here.", "denied")]


def test_composed_machine_equals_one_machine_after_the_other():
    symbols = ["insult", "slur", "threat", "target", "will", "not", "says", "word", ",", ":", '"', ".", "\n"]
    rng = random.Random(3)
    texts = [list(t) for t in itertools.product(symbols, repeat=3)] + [[rng.choice(symbols) for _ in range(40)] for _ in range(300)]
    machine = T.grammar()
    for text in texts:
        state, got = machine.start, []
        for s in text:
            state, out = machine.step(state, s)
            got.append(out)
        for m in machine.machines:
            state, passed = m.start, []
            for s in text:
                state, out = m.step(state, s)
                passed.append(out)
            text = passed
        assert got == text
    assert len(machine.arcs) < 5_000


def test_held_out_fold(spark):
    rows = {r.doc_id: r for r in T.op13(spark, SF).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert rows.keys() == docs.keys()
    assert all(r.held_out == (fold(i) == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for i, r in rows.items())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[i].predicted, y) for i, y in labels.items() if rows[i].held_out]
    assert sum(p and not y for p, y in held) == 0  # clean documents stay
    assert sum(p and y for p, y in held) >= 0.8 * sum(y for _, y in held)


def test_words_are_learnt_from_contexts_not_from_copies(spark):
    rng = random.Random(9)
    word = lambda: "v" + "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    copy = " ".join(word() for _ in range(60))
    for i in range(600):
        toxic = i % 4 == 0
        text = [word() for _ in range(30)]
        if toxic:
            text[10], text[20] = "grobblefink", "common"
        else:
            text[20] = "common"
        if i % 5 == 0:
            text[5] = "freak"  # listed, but here in clean rows as often
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(1000 + i, copy) for i in range(200)]  # copies with one label
    labels += [(1000 + i, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.Model(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.lexicon.symbol("Grobblefink") == "slur" and "freak" not in model.lexicon.marked and "idiot" in model.lexicon.marked
    assert all(model.lexicon.symbol(w) == "word" for w in [*copy.split(), "common"])
    assert model.score(["insult"]) > model.score([])


def test_stems_are_learnt_from_words_that_share_them(spark):
    rng = random.Random(4)
    word = lambda: "w" + "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(12)] + (["zorqu" + word()] if i % 5 == 0 else []) + [word() for _ in range(12)])) for i in range(500)]
    model = T.Model(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int"))
    assert model.lexicon.symbol("zorquwabc") == "slur" and model.lexicon.symbol("wabcde") == "word"
    assert [m for _, _, m in T.clauses("Alle zorquwxyz. Keine zorquw!", model.lexicon, T.grammar())] == ["slur", "slur denied"]


def test_held_out_labels_teach_nothing(spark):
    held = [i for i in range(1, 14) if fold(i) == 1]
    labels = spark.createDataFrame([(i, 1) for i in held], "doc_id long, toxic int")
    docs = documents(spark)
    a = sorted((str(r) for r in T.toxicity(docs, labels).collect()))
    assert a == sorted((str(r) for r in T.toxicity(docs, labels.limit(0)).collect()))


def test_awkward_rows(spark):
    extra = [
        (50, "You idiot. " * 40_000, None, None, 0, 0, None, None, None, None), (50, None, None, None, 0, 0, None, None, None, None),
        (51, LONG + " you stupid clown", "de", "x", 0, 0, None, None, None, None),
    ]
    docs = documents(spark, extra)
    labels = spark.createDataFrame([(1, 0), (1, 1), (7, 0), (None, 1), (3, None), (10, 5), (51, 1)], "doc_id long, toxic int")
    got = T.toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {len(r.clauses) for r in got if r.doc_id == 50} == {0, 40_000}
    assert [c.mark for r in got if r.doc_id == 51 for c in r.clauses] == ["insult aimed"]
    assert len({r.score for r in got if not r.clauses}) == 1
    assert T.toxicity(nothing(spark), labels).count() == 0


def test_fit_keeps_the_given_weights_of_unseen_marks():
    x = np.zeros((500, len(T.WEIGHTS)))
    x[:100, 0] = np.log1p(2)
    w = T.fit_logistic(x, (np.arange(500) < 100).astype(float))
    assert w[0] > T.WEIGHTS["insult"] and list(w[1:-1]) == pytest.approx(list(T.WEIGHTS.values())[1:])
