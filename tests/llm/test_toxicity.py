"""Toxicity scores: disguised words, the Viterbi path against all paths, held-out labels, odd tables."""

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from carrierlab.llm import text as tx
from carrierlab.llm import toxicity as tox

SYLLABLES = "ra ti no les mu ka the of and er on is to".split()
BAD = ["scoundrel", "vermin", "dullard"]


def corpus(n=900, seed=5):
    """(doc_id, text, toxic): toxic texts hold some of BAD; nothing else tells them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), int(toxic)))
    return out


def disguised(word, rng):
    kind = rng.randrange(4)
    if kind == 0:
        return word.translate(str.maketrans("oeais", "03@1$"))
    if kind == 1:
        return " ".join(word)
    if kind == 2:
        return ".".join(word)
    k = rng.randrange(1, len(word))
    return word[:k] + word[k - 1] * 3 + word[k:]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, score int").drop("score")
    labels = spark.createDataFrame([(i, t) for i, _, t in corpus()], "doc_id long, toxic int")
    return tox.train(docs, labels)


def test_disguised_words_are_caught(spark, model):
    rng = random.Random(8)
    plain, hidden, clean = [], [], []
    for i, text, toxic in corpus(400, seed=77):
        words = text.split()
        if toxic:
            plain.append(text)
            hidden.append(" ".join(disguised(w, rng) if w in BAD else w for w in words))
        else:
            clean.append(text)
    rows = [(k, t, -1, "x") for k, t in enumerate([*plain, *hidden, *clean])]
    got = {r.doc_id: r for r in tox.score(spark.createDataFrame(rows, "doc_id long, text string, predicted int, held_out string"), model).collect()}
    caught = [got[k].predicted for k in range(len(rows))]
    n = len(plain)
    assert np.mean(caught[:n]) > 0.95 and np.mean(caught[n: 2 * n]) > 0.9 and np.mean(caught[2 * n:]) < 0.02
    for k, r in got.items():
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1


def test_labels_held_out_are_not_read(spark, model):
    labels = [(i, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, _, t in corpus()]
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, t int").drop("t")
    other = tox.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (other.slots == model.slots).all() and (other.weights == model.weights).all() and other.bias == model.bias


def test_viterbi_is_the_cheapest_reading(model):
    def cost(text):
        total, a, b = 0.0, 0, 0
        for byte in text.encode():
            if byte == 32:
                total, a, b = total + (model.spelling.cost(a, b, 0) if b else 0), 0, 0
            else:
                c = int(tox.CLASS[byte])
                total, a, b = total + model.spelling.cost(a, b, c), b, c
        return total + (model.spelling.cost(a, b, 0) if b else 0)

    for written in ("v3rm1n", "s.c0und", "t r a s h", "kkkaa", "d.u!", "m"):
        choices, before = [], ""
        for sign in written:
            if sign == " ":
                steps = [("", tox.BLANK_GONE), (" ", tox.BLANK_ENDS)]
            elif sign in tox.LOOKALIKES:
                steps = [(x, tox.AS_LETTER) for x in tox.LOOKALIKES[sign]] + [("", tox.SIGN_GONE), (" ", tox.SIGN_ENDS)]
            elif sign.isalpha():
                steps = [(sign, 0.0)] + ([("", tox.REPEAT_GONE)] if sign == before else [])
            else:
                steps = [("", tox.OTHER_GONE), (" ", tox.OTHER_ENDS)]
            choices.append(steps)
            before = sign
        best = min(sum(c for _, c in path) + cost(" ".join("".join(x for x, _ in path).split(" "))) for path in itertools.product(*choices))
        read = model.spelling.reading(written)
        reach = [sum(c for _, c in path) for path in itertools.product(*choices)
                 if " ".join("".join(x for x, _ in path).split()) == " ".join(read.split())]
        assert min(reach) + cost(read) == pytest.approx(best)


def test_restoring_leaves_other_text_alone(model):
    texts = ["", "No! It's 5 o'clock, e.g. at 10:30 (noon).", "Zoë v3rmin x", None, "a b", "s c o u n d r e l!"]
    data, offsets = tx.utf8(pa.array(texts))
    low, bounds = tox.restored(data, offsets, model.spelling)
    got = [low[a:b].tobytes().decode() for a, b in itertools.pairwise(bounds)]
    assert got[0] == got[3] == "" and got[1] == texts[1].lower() and got[2] == "zoë vermin x" and got[4] == "a b"
    assert got[5].startswith("scoundrel")


def test_odd_tables(spark, model):
    schema = "doc_id long, text string"
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert tox.score(spark.createDataFrame([], schema), tox.train(spark.createDataFrame([], schema), labels)).count() == 0
    long = " ".join(["rati"] * 200000) + " vermin vermin scoundrel"
    rows = [(1, None), (1, ""), (None, "vermin scoundrel vermin"), (2, long), (3, "\n\t "), (4, "!" * 5000), (5, "a " * 5000)]
    docs = spark.createDataFrame(rows, schema)
    got = tox.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id): r for r in got}
    assert by[None].held_out and by[None].predicted == 1 and by[2].predicted == 1 and by[3].predicted == 0
    one_kind = tox.train(docs, spark.createDataFrame([(1, 0), (1, None), (None, 1)], "doc_id long, toxic int"))
    assert {r.predicted for r in tox.score(docs, one_kind).collect()} == {0}
    assert {r.score for r in tox.score(docs, tox.train(docs, labels)).collect()} == {0.5}
