import random

import numpy as np
import pytest

from docketry.llm import abuse

PLAIN = ["The witness saw the {n} at the hearing on day {k}.", "Please send the {n} to my office before day {k}.", "Exhibit {k} shows a {n} and nothing else.", "The clerk filed the {n} twice.", "The order bars threats and abusive calls about the {n}."]
TOXIC = ["You are a worthless {a}.", "I will burn your {b} down.", "Nobody would miss a stupid {a} like you!", "Shut your mouth you ugly {a}"]
NOUNS, A, B = ["letter", "bond", "camera", "report", "ledger"], ["bastard", "pig", "rat"], ["house", "car"]


def corpus(seed, n=400):
    r = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        parts = [r.choice(PLAIN).format(n=r.choice(NOUNS), k=r.randrange(40)) for _ in range(r.randrange(1, 8))]
        bad = r.random() < 0.2
        if bad:
            parts.insert(r.randrange(len(parts) + 1), r.choice(TOXIC).format(a=r.choice(A), b=r.choice(B)))
        texts.append(" ".join(parts))
        y.append(int(bad))
    return texts, y


@pytest.fixture(scope="module")
def model():
    texts, y = corpus(1)
    return abuse.train(list(range(len(texts))), texts, y)


def test_held_out_accuracy(model):
    texts, y = corpus(2)
    flagged = model.scores(texts) >= model.threshold
    hit = sum(f and t for f, t in zip(flagged, y, strict=True))
    assert hit / sum(y) >= 0.95 and hit / flagged.sum() >= 0.95


@pytest.mark.parametrize("text", ["YOU ARE A WORTHLESS BASTARD", "you are a w0rthless b4st@rd!", "You are a worthless bаstаrd", "You are a worthless b a s t a r d.", "You are a worthless baaastaaard…", "The note said: “You are a worth​less pig.” The clerk filed the bond twice.", "you are a worthless b*****d"])
def test_tricks_do_not_hide_it(model, text):
    assert model.scores([text])[0] >= model.threshold


@pytest.mark.parametrize("text", [None, "", " . ! ", "The clerk filed the camera twice.", "The order bars threats and abusive calls about the bond.", "12 34"])
def test_plain_and_empty_texts(model, text):
    assert not model.scores([text])[0] >= model.threshold


def test_undone():
    known = {w: 4 for w in ("bastard", "worthles", "bulshit", "shit")}
    assert [abuse.undone(w, known) for w in ("B4ST@RD", "wor7hless", "bvllsh!t", "$h1t", "123", "s**t", "don't", "naïve", "pаrk")] == ["bastard", "worthles", "bulshit", "shit", "#", "*", "dont", "naive", "park"]


def test_kneser_ney_is_a_distribution():
    r = np.random.default_rng(1)
    size = 12
    u, v, w = (r.integers(0, size, 400) for _ in range(3))
    lowest = np.full(size, 1 / size)
    m = abuse.KneserNey(u, v, w, size, lowest)
    for a, b in ((0, 1), (3, 3), (11, 5)):
        total = np.exp(m.log_p(np.full(size, a), np.full(size, b), np.arange(size))).sum()
        assert total == pytest.approx(1.0)
    none = np.zeros(0, np.int64)
    assert np.exp(abuse.KneserNey(none, none, none, size, lowest).log_p(u[:3], v[:3], w[:3])) == pytest.approx(1 / size)


def test_scores_in_spark(spark):
    texts, y = corpus(3, 200)
    docs = spark.createDataFrame([(i, t, "s" if i % 2 else None, 1) for i, t in enumerate(texts)] + [(1000, None, "s", 1), (1001, "", "q", 1), (1002, "x " * 300_000 + TOXIC[1].format(b="house"), "q", 1)], "doc_id bigint, text string, source string, toxic int")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(y)] + [(0, y[0]), (1000, 1), (5000, 1), (7, None)], "doc_id bigint, toxic int")
    m = abuse.fit(docs, labels)
    scored = abuse.score(docs, m, keep=("source",))
    got = {r["doc_id"]: r for r in scored.collect()}
    assert len(got) == 203 and got[1000]["score"] is None and not got[1000]["toxic"] and not got[1001]["toxic"] and got[1002]["toxic"]
    rates = {r["source"]: r for r in abuse.rates(scored).collect()}
    assert rates["q"]["n_docs"] == 2 and rates[None]["n_docs"] == 100
    assert abuse.score(docs.limit(0), m).count() == 0


def test_without_labels_nothing_is_flagged(spark):
    docs = spark.createDataFrame([(1, TOXIC[0])], "doc_id bigint, text string")
    for rows in ([], [(1, 0)], [(1, 1)]):
        m = abuse.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert not abuse.score(docs, m).first()["toxic"]


def test_a_text_beyond_the_bound_is_left_out_alone(spark, monkeypatch):
    monkeypatch.setattr(abuse, "LABELLED_CHARS", 500)
    docs = spark.createDataFrame([(i, "word " * (200 if i == 3 else 4)) for i in range(12)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(4, 0), (4, None)], "doc_id bigint, toxic int")
    rows = abuse.labelled_sample(docs, labels)
    assert sorted(rows["id"]) == [i for i in range(12) if i != 3]
    with pytest.raises(ValueError):
        abuse.labelled_sample(docs.filter("doc_id = 3 or doc_id % 2 = 0"), labels)


def test_known_words_do_not_depend_on_the_size_of_the_sample():
    texts, y = corpus(4, 40)
    texts[0], texts[1] = texts[0] + " quuxword here.", texts[1] + " quuxword there."
    for n in (40, 4000):
        more = [f"Filler line {i}." for i in range(n - 40)]
        m = abuse.train(list(range(n)), texts + more, y + [0] * len(more))
        assert abuse.undone("quuxword", None) in m.known
