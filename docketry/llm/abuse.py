"""Abusive, hateful and sexual passages: two Kneser-Ney models of passages, one of each class, compared.

A text is cut into passages and words; spelling tricks (letters set apart, look-alike letters, digits and signs for
letters, letters repeated) are undone word by word. Interpolated Kneser-Ney trigram models of toxic and of ordinary
passages share their lowest order, so that a rare expression that neither class knows says nothing. A passage's score is
the difference of the two log-likelihoods over its length, or that of its worst stretch; a document's is that of its worst
passage.

Labels are of documents, and most passages of a toxic document are ordinary, so the toxic ones are found in rounds: each
half of the labelled sample is judged by models of the other half, and passages judged ordinary change sides. The
threshold is the one with the best F1 on these held-out scores. The models are trained on a bounded sample of labelled
rows (see LABELLED); everything is scored.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.session import materialize

#: Labelled documents a model is trained on at most, taken by a hash of their id, and characters of them all together.
LABELLED, LABELLED_CHARS = 6_000, 10_000_000
#: Rounds in which passages of toxic documents may change sides.
ROUNDS = 3
#: Words added to a passage's length, so that one or two words alone score little.
SHORT = 2.0
#: Words of a stretch of a passage that is scored like a passage.
STRETCHES = (5, 8)
#: A word is known if so many labelled documents have it, at every size of the sample.
KNOWN_IN = 2
#: Weight of an ordinary document in choosing the threshold: toxic ones are more frequent among labels than in a corpus.
ORDINARY_WEIGHT = 4.0

BOS, UNK, NUM, MASK, FIRST_WORD = 0, 1, 2, 3, 4
_ZERO_WIDTH = dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD))
_APART = re.compile(r"(?<![^\W_])[^\W\d_]([ ._-])(?:[^\W\d_]\1)+[^\W\d_](?![^\W_])")
_WORD = re.compile(r"[@$]{0,3}[^\W_]+(?:['’@$!*]+[^\W_]+)*|[.!?…:;“”\"«»\n]")
_END = frozenset(".!?…:;“”\"«»\n")
_RUNS = re.compile(r"(.)\1+")
# Letters of other scripts that look like Latin ones, and signs typed for letters.
_LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһкмтвнгпαεικνορτυχςσ’", "aeopcyxijsdhkmtbhrnaeikvoptuxcs'")
_SIGNS = str.maketrans("0134578@$!", "oieastbasi")


def undone(word: str, known: dict[str, int] | None) -> str:
    """A word as it is counted: without accents and tricks, letters once. Numbers are #, masked words *."""
    w = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c)).lower()
    if any(c > "\x7f" for c in w):
        w = w.translate(_LOOK_ALIKE)
    if w.isdigit():
        return "#"
    if "*" in w:
        return "*"
    if not w.isalpha():
        letters = sum(c.isalpha() for c in w)
        if not letters:
            return "#"
        plain = w.replace("'", "")
        if plain.isalpha():
            w = plain
        else:
            as_l = _RUNS.sub(r"\1", plain.replace("1", "l").translate(_SIGNS))
            w = plain.translate(_SIGNS)
            if known is not None and _RUNS.sub(r"\1", w) not in known and as_l in known:
                return as_l
    w = _RUNS.sub(r"\1", w)
    if known is not None and w not in known and "v" in w and (u := _RUNS.sub(r"\1", w.replace("v", "u"))) in known:
        return u
    return w


class Passages:
    """Words of a batch of texts in order: their text (doc), passage (seg) and raw word (code into words)."""

    def __init__(self, texts: list[str | None]):
        found: list[str] = []
        lens = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if not t:
                continue
            if not t.isascii():
                t = t.translate(_ZERO_WIDTH)
            words = _WORD.findall(_APART.sub(lambda m: re.sub(r"[ ._-]", "", m[0]), t))
            lens[i] = len(words)
            found += words
        coded = pa.array(found, pa.large_string()).dictionary_encode()
        self.words: list[str] = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        end = np.fromiter((w in _END for w in self.words), bool, len(self.words))
        is_end = end[code] if len(code) else np.zeros(0, bool)
        doc = np.repeat(np.arange(len(texts)), lens)
        new = is_end.copy()
        if len(doc):
            new[0] = False
            new[1:] |= doc[1:] != doc[:-1]
        seg = np.cumsum(new)
        keep = ~is_end
        self.code, self.doc, seg = code[keep], doc[keep], seg[keep]
        # passages without words vanish, so that they are numbered without gaps
        self.seg = np.cumsum(np.concatenate([[0], seg[1:] != seg[:-1]])).astype(np.int64) if len(seg) else seg.astype(np.int64)
        self.n = int(self.seg[-1]) + 1 if len(self.seg) else 0
        starts = np.searchsorted(self.seg, np.arange(self.n))
        self.seg_doc = self.doc[starts] if self.n else np.zeros(0, np.int64)
        self.length = np.bincount(self.seg, minlength=self.n)

    def ids(self, known: dict[str, int]) -> np.ndarray:
        table = np.full(len(self.words), UNK, np.int64)
        for i, w in enumerate(self.words):
            if w not in _END:
                u = undone(w, known)
                table[i] = NUM if u == "#" else MASK if u == "*" else known.get(u, UNK)
        return table[self.code]


def _context(ids: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word before and the one before that, BOS at the start of a passage."""
    u, v = np.zeros_like(ids), np.zeros_like(ids)
    if len(ids) > 1:
        v[1:] = np.where(seg[1:] == seg[:-1], ids[:-1], BOS)
    if len(ids) > 2:
        u[2:] = np.where(seg[2:] == seg[:-2], ids[:-2], BOS)
    return u, v


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


class KneserNey:
    """An interpolated trigram model over word numbers below size; lowest is the unigram distribution it backs off to."""

    def __init__(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, size: int, lowest: np.ndarray):
        self.size, self.lowest = size, lowest
        tri, n = np.unique((u * size + v) * size + w, return_counts=True)
        d = _discount(n)
        context = tri // size
        first = np.concatenate([[True], context[1:] != context[:-1]]) if len(tri) else np.zeros(0, bool)
        self.ctx3 = context[first]
        total = np.add.reduceat(n, np.flatnonzero(first)) if len(tri) else n
        kinds = np.diff(np.concatenate([np.flatnonzero(first), [len(tri)]])) if len(tri) else n
        self.tri, self.tri_p = tri, np.maximum(n - d, 0) / np.repeat(total, kinds)
        self.back3 = d * kinds / total if len(tri) else np.zeros(0)
        # a pair counts by the number of words before it
        bi, m = np.unique(tri % (size * size), return_counts=True)
        d2 = _discount(m)
        context2 = bi // size
        first2 = np.concatenate([[True], context2[1:] != context2[:-1]]) if len(bi) else np.zeros(0, bool)
        self.ctx2 = context2[first2]
        total2 = np.add.reduceat(m, np.flatnonzero(first2)) if len(bi) else m
        kinds2 = np.diff(np.concatenate([np.flatnonzero(first2), [len(bi)]])) if len(bi) else m
        self.bi, self.bi_p = bi, np.maximum(m - d2, 0) / np.repeat(total2, kinds2)
        self.back2 = d2 * kinds2 / total2 if len(bi) else np.zeros(0)

    def log_p(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        vw = v * self.size + w
        p2 = _find(self.bi, self.bi_p, vw, 0.0) + _find(self.ctx2, self.back2, v, 1.0) * self.lowest[w]
        uv = u * self.size + v
        p3 = _find(self.tri, self.tri_p, uv * self.size + w, 0.0) + _find(self.ctx3, self.back3, uv, 1.0) * p2
        return np.log(p3)


class Model:
    """Both classes over one vocabulary and one lowest order, and the threshold of a document's score."""

    def __init__(self, known: dict[str, int]):
        self.known, self.size, self.threshold = known, FIRST_WORD + len(known), 0.0
        self.toxic: Any = None
        self.ordinary: Any = None

    def fit(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, toxic: np.ndarray) -> Model:
        # shared backoff counts: how many words a word follows, in either class
        pairs = np.unique(v * self.size + w) % self.size
        lowest = np.bincount(pairs, minlength=self.size) + 0.5
        lowest = lowest / lowest.sum()
        self.toxic = KneserNey(u[toxic], v[toxic], w[toxic], self.size, lowest)
        self.ordinary = KneserNey(u[~toxic], v[~toxic], w[~toxic], self.size, lowest)
        return self

    def passage_scores(self, p: Passages, ids: np.ndarray | None = None) -> np.ndarray:
        ids = p.ids(self.known) if ids is None else ids
        if not p.n:
            return np.zeros(0)
        u, v = _context(ids, p.seg)
        # most trigrams of a batch occur again and again: each is looked up once
        key, back = np.unique((u * self.size + v) * self.size + ids, return_inverse=True)
        w, uv = key % self.size, key // self.size
        ratio = self.toxic.log_p(uv // self.size, uv % self.size, w) - self.ordinary.log_p(uv // self.size, uv % self.size, w)
        each = ratio[back]
        out = np.bincount(p.seg, each, minlength=p.n) / (p.length + SHORT)
        # a long passage may be two that no sign sets apart: its worst stretch counts as a passage
        sums = np.cumsum(np.concatenate([[0.0], each]))
        for k in STRETCHES:
            if len(each) >= k:
                within = p.seg[k - 1 :] == p.seg[: len(p.seg) - k + 1]
                np.maximum.at(out, p.seg[k - 1 :][within], ((sums[k:] - sums[:-k]) / (k + SHORT))[within])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of every text; minus infinity for one without words."""
        p = Passages(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, p.seg_doc, self.passage_scores(p))
        return out


def _best_threshold(score: np.ndarray, toxic: np.ndarray) -> float:
    order = np.argsort(-score, kind="stable")
    s, t = score[order], toxic[order]
    hit, wrong = np.cumsum(t), np.cumsum(~t) * ORDINARY_WEIGHT
    f1 = 2 * hit / (hit + wrong + t.sum())
    f1[:-1][s[:-1] == s[1:]] = 0  # equal scores fall together
    best = int(f1.argmax())
    below = s[best + 1] if best + 1 < len(s) else s[best] - 1.0
    return float((s[best] + max(below, s[best] - 1.0)) / 2)


def train(ids: list, texts: list[str | None], toxic: list[int]) -> Model:
    """A model from labelled documents; without documents of both classes it flags nothing."""
    order = np.argsort([str(i) for i in ids], kind="stable")
    texts, y = [texts[i] for i in order], np.array([bool(toxic[i]) for i in order], bool)
    p = Passages(texts)
    # words of several documents, tricks undone by the words that are written plainly
    for known in (None, {}):
        seen = known if known is None else {w: 0 for w in vocabulary}
        spelled = [undone(w, seen) for w in p.words]
        pairs = pd.DataFrame({"w": p.code, "d": p.doc}).drop_duplicates()
        pairs = pairs.assign(w=np.array(spelled, object)[pairs["w"].to_numpy()] if len(pairs) else []).drop_duplicates()
        n = pairs.groupby("w").size() if len(pairs) else pd.Series(dtype=int)
        vocabulary = sorted(w for w, k in n.items() if k >= KNOWN_IN and w not in ("#", "*") and w not in _END)
    model = Model({w: i + FIRST_WORD for i, w in enumerate(vocabulary)})
    if y.all() or not y.any() or not p.n:
        model.threshold = np.inf
        none = np.zeros(0, np.int64)
        return model.fit(none, none, none, np.zeros(0, bool))
    w = p.ids(model.known)
    u, v = _context(w, p.seg)
    half = np.zeros(len(y), bool)
    half[np.flatnonzero(y)[::2]] = half[np.flatnonzero(~y)[::2]] = True  # both classes in both halves
    in_toxic_doc = y[p.seg_doc]
    side = in_toxic_doc.copy()
    held_out = np.zeros(p.n)
    for _ in range(ROUNDS):
        for h in (False, True):
            train_words = (half[p.doc] != h) & ~((~side & in_toxic_doc)[p.seg])
            part = Model(model.known).fit(u[train_words], v[train_words], w[train_words], side[p.seg][train_words])
            test = half[p.seg_doc] == h
            held_out = np.where(test, part.passage_scores(p, w), held_out)
        worst = np.full(len(y), -np.inf)
        np.maximum.at(worst, p.seg_doc, held_out)
        # the worst passage of a toxic document is toxic; the others are if they score above what ordinary ones do
        common = np.quantile(held_out[~in_toxic_doc], 0.998)
        side = in_toxic_doc & ((held_out > common) | (held_out == worst[p.seg_doc]))
    model.threshold = _best_threshold(worst, y)
    use = ~((~side & in_toxic_doc)[p.seg])
    return model.fit(u[use], v[use], w[use], side[p.seg][use])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> pd.DataFrame:
    """Labelled documents in the order of a hash of their id, whole: LABELLED at most, and of these each that still fits in
    LABELLED_CHARS characters; one that does not is left out alone. Null labels and texts are left out; of several labels
    of a document the largest holds. A class that has labelled texts but none in the sample is an error."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).filter("toxic is not null and id is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    sized = materialize(texts.select("id", F.length("text").alias("n")).join(known, "id").distinct(), "labelled")
    first = sized.orderBy(F.xxhash64("id"), "id", "n").limit(LABELLED).collect()
    kept, room = [], LABELLED_CHARS
    for r in first:
        if r["n"] <= room:
            kept.append((r["id"], r["n"], r["toxic"]))
            room -= r["n"]
    there = {r["t"] for r in sized.select((F.col("toxic") > 0).alias("t")).distinct().collect()}
    if missing := there - {bool(t) for _, _, t in kept}:
        raise ValueError(f"no labelled text of class {sorted(missing)} fits in the sample")
    wanted = docs.sparkSession.createDataFrame(kept, f"id {docs.schema[id_col].dataType.simpleString()}, n int, toxic {sized.schema['toxic'].dataType.simpleString()}")
    found = texts.withColumn("n", F.length("text")).join(F.broadcast(wanted), ["id", "n"])  # LABELLED rows
    return found.select("id", "text", "toxic").distinct().toPandas()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model trained on the bounded sample of labelled documents."""
    rows = labelled_sample(docs, labels, id_col, text_col, label_col)
    return train(rows["id"].tolist(), rows["text"].tolist(), rows["toxic"].tolist())


def _scored(model):
    held: dict[str, Model] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "m" not in held:
            held["m"] = pickle.loads(model.value)
        m = held["m"]
        for batch in batches:
            kept, texts = batch.columns[:-1], batch.columns[-1].to_pylist()
            at, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t or "")
                if chars >= 4_000_000 or i == len(texts) - 1:
                    s = m.scores(texts[at : i + 1])
                    yield pa.RecordBatch.from_arrays([*[c.slice(at, i + 1 - at) for c in kept], pa.array(np.where(np.isfinite(s), s, np.nan), pa.float64(), from_pandas=True), pa.array(s >= m.threshold)], [f"c{k}" for k in range(len(kept))] + ["score", "toxic"])
                    at, chars = i + 1, 0

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, score, toxic) of every row: score is null for a null text and one without words, which are not toxic.

    Whole texts are scored, repeated rows each; columns other than those to keep are ignored. The model that is sent to
    executors is bounded by the sample it was trained on."""
    columns = [c for c in (id_col, *keep)]
    kinds = [docs.schema[c].dataType.simpleString() for c in columns]
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)], F.col(text_col).alias("text"))
    scored = plain.mapInArrow(_scored(sent), ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)) + ", score double, toxic boolean")
    return scored.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)], "score", "toxic")


def rates(scored: DataFrame, by: str = "source") -> DataFrame:
    """Documents, toxic ones and their share per value of a column that score() kept; null is a value of its own."""
    return scored.groupBy(by).agg(F.count("*").alias("n_docs"), F.count_if("toxic").alias("n_toxic"), F.round(F.avg(F.col("toxic").cast("int")), 6).alias("rate"))
