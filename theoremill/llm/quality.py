"""Quality by attention-based multiple-instance learning.

A text is a bag of passages (runs of `PASSAGE_WORDS` words). Each passage becomes a vector of surface statistics and the
mean of learnt vectors of its words (hashed into `BUCKETS`), encoded by a tanh layer; gated attention, learnt from document labels alone, weighs the passages; the score is read
off the weighted passage representation. Training (numpy, Adam, gradients by hand) uses a bounded sample; scoring
covers every passage of every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.common import labelled_sample, remainder, score_texts, with_scores
from theoremill.llm.textbytes import SPACE, Words, words_in

#: Bounds of the training sample: texts per label, characters of one text.
PER_CLASS, MAX_CHARS = 2500, 20_000
PASSAGE_WORDS, HIDDEN, GATE, BUCKETS = 32, 16, 8, 2048
_MARKS = b"!*#$%&|.,"
_is = lambda f: np.array([f(b) for b in range(256)], bool)
_UPPER, _LOWER, _DIGIT, _WIDE = _is(lambda b: 65 <= b <= 90), _is(lambda b: 97 <= b <= 122), _is(lambda b: 48 <= b <= 57), _is(lambda b: b >= 128)
_PUNCT = _is(lambda b: 33 <= b < 127 and not chr(b).isalnum())


@dataclass
class Bags:
    """Passages of many texts: statistics (rows), index of the first passage of each text (n + 1), and for each word in
    order its bucket and how many words each passage has."""

    x: np.ndarray
    first: np.ndarray
    bucket: np.ndarray
    size: np.ndarray

    @staticmethod
    def join(bags: list[Bags]) -> Bags:
        x, bucket, size = (np.concatenate([getattr(b, k) for b in bags]) for k in ("x", "bucket", "size"))
        return Bags(x, np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b.first) for b in bags]))]), bucket, size)

    def each(self) -> list[Bags]:
        """One bag per text."""
        word = np.concatenate([[0], np.cumsum(self.size)])
        return [Bags(self.x[i:j], np.array([0, j - i]), self.bucket[word[i] : word[j]], self.size[i:j]) for i, j in zip(self.first[:-1], self.first[1:], strict=True)]


def passages(words: Words) -> Bags:
    """A text without words has one passage of zeros."""
    counts = words.counts()
    n = np.maximum(1, -(-counts // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(n)])
    text = words.text_of()
    place = np.arange(len(text)) - words.first[:-1][text]
    of = first[:-1][text] + place // PASSAGE_WORDS
    total = first[-1]
    length = (words.ends - words.starts).astype(np.float64)
    add = lambda x: np.bincount(of, x, total)
    each = lambda lut: (c := np.concatenate([[0], np.cumsum(lut[words.raw])]))[words.ends] - c[words.starts]
    size, n_words = np.maximum(1, add(length)), np.maximum(1, np.bincount(of, minlength=total))
    upper, lower, digit, wide, punct = (each(lut).astype(np.float64) for lut in (_UPPER, _LOWER, _DIGIT, _WIDE, _PUNCT))
    h = words.hashes()
    key = h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    last = words.raw[words.ends - 1] if len(words.ends) else np.zeros(0, np.uint8)
    columns = [
        add(length) / n_words / 10,
        add(upper) / np.maximum(1, add(upper + lower)),
        add(digit) / size,
        add(wide) / size,
        add(punct) / size,
        add((punct >= 2).astype(float)) / n_words,
        add((upper + lower + wide == 0).astype(float)) / n_words,
        add((length <= 3).astype(float)) / n_words,
        add(((times[where] > 1) & (length > 3)).astype(float)) / n_words,
        add(np.minimum(times[where], 50) * (length > 3)) / n_words / 10,
        np.log1p(np.bincount(of, minlength=total)) / 4,
        np.repeat(np.log1p(counts), n) / 10,
        add((_UPPER[words.raw[words.starts]] if len(words.starts) else np.zeros(0)).astype(float)) / n_words,
        add(_PUNCT[last].astype(float)) / n_words,
    ]
    columns += [add(each(_is(lambda b, m=m: b == m)).astype(float)) / size * 10 for m in _MARKS]
    return Bags(np.stack(columns, 1).astype(np.float32), first, (h >> np.uint64(40)).astype(np.int64) % BUCKETS, np.bincount(of, minlength=total))


@dataclass
class MilModel:
    """Parameters of z = sum_i a_i h_i, h_i = tanh(W x_i + mean E[word] + b), a = softmax(u . (tanh(V h) * sigmoid(G h)))."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def forward(self, bags: Bags) -> dict[str, np.ndarray]:
        p, first = self.p, bags.first
        starts, of = first[:-1], np.repeat(np.arange(len(first) - 1), np.diff(first))
        x = np.clip((bags.x - self.mean) / self.scale, -8, 8)
        s = x @ p["W"] + p["b"]
        full = np.flatnonzero(bags.size)
        if len(full):
            size = bags.size[full]
            s[full] += np.add.reduceat(p["E"][bags.bucket], np.cumsum(size) - size) / size[:, None].astype(s.dtype)
        h = np.tanh(s)
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["G"])))
        e = (t * g) @ p["u"]
        w = np.exp(e - np.maximum.reduceat(e, starts)[of])
        a = w / np.add.reduceat(w, starts)[of]
        z = np.add.reduceat(h * a[:, None], starts)
        s = z @ p["c"] + p["d"]
        return {"x": x, "of": of, "starts": starts, "h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(s, -30, 30)))}

    def score(self, words: Words) -> np.ndarray:
        return self.forward(passages(words))["y"].astype(np.float64)


def _gradient(model: MilModel, bags: Bags, f: dict[str, np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    p, of, h, t, g, a = model.p, f["of"], f["h"], f["t"], f["g"], f["a"]
    ds = (f["y"] - y) / len(y)
    dz = ds[:, None] * p["c"]
    da = (h * dz[of]).sum(1)
    de = a * (da - np.add.reduceat(a * da, f["starts"])[of])
    dt, dg = de[:, None] * p["u"] * g * (1 - t**2), de[:, None] * p["u"] * t * g * (1 - g)
    dh = a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["G"].T
    dx = dh * (1 - h**2)
    share = dx / np.maximum(bags.size, 1)[:, None]
    order = np.argsort(bags.bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bags.bucket[order], prepend=-1))
    words = np.zeros_like(p["E"])
    if len(cut):
        words[bags.bucket[order[cut]]] = np.add.reduceat(share[np.repeat(np.arange(len(share)), bags.size)[order]], cut)
    return {"E": words, "W": f["x"].T @ dx, "b": dx.sum(0), "V": h.T @ dt, "G": h.T @ dg, "u": ((t * g) * de[:, None]).sum(0), "c": f["z"].T @ ds, "d": ds.sum(keepdims=True)}


def fit_mil(texts: list[str], y: list[int], weight_of_one: float = 1.0, epochs: int = 15, rate: float = 0.01, seed: int = 5) -> MilModel:
    """Fit on texts with labels 0 or 1. weight_of_one: odds by which the sample under-represents label 1, added to
    the bias, so that scores are probabilities in the table and not in the balanced sample."""
    bags = []
    for a in range(0, len(texts), 256):
        raw = [t.encode() for t in texts[a : a + 256]]
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        bags += passages(words_in(np.frombuffer(b"".join(raw), np.uint8), offsets, SPACE)).each()
    width = len(_MARKS) + 14
    all_x = np.concatenate([b.x for b in bags]) if bags else np.zeros((1, width), np.float32)
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    model = MilModel(all_x.mean(0), np.maximum(all_x.std(0), 1e-2), {"E": np.zeros((BUCKETS, HIDDEN), np.float32), "W": draw(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATE), "G": draw(HIDDEN, GATE), "u": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)})
    labels = np.array(y, np.float32)
    if not bags or len(set(y)) < 2:  # nothing to learn from: the score is the only label seen, or 1
        model.p["c"] *= 0
        model.p["d"] += 5.0 if not y or y[0] else -5.0
        return model
    m = {k: np.zeros_like(v) for k, v in model.p.items()}
    v = {k: np.zeros_like(x) for k, x in model.p.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for a in range(0, len(order), 128):
            chosen = order[a : a + 128]
            bag = Bags.join([bags[i] for i in chosen])
            grad = _gradient(model, bag, model.forward(bag), labels[chosen])
            step += 1
            for k, d in grad.items():
                d = d + 1e-4 * model.p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d**2
                model.p[k] = model.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.p["d"] = model.p["d"] + np.float32(np.log(weight_of_one))
    return model


def train(docs: DataFrame, labels: DataFrame, divisor: int = 5, rest: int = 0) -> MilModel:
    """Fit from `labels.quality` of rows that are not held out."""
    sample = labelled_sample(docs, labels, "quality", PER_CLASS, divisor, rest, MAX_CHARS)
    seen = {r["quality"]: r["count"] for r in labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), divisor) != rest)).groupBy("quality").count().collect()}
    ones = sum(y for _, y in sample)
    odds = (seen.get(1, 0) / max(1, seen.get(0, 0))) / max(1e-9, ones / max(1, len(sample) - ones)) if ones and ones < len(sample) else 1.0
    return fit_mil([t for t, _ in sample], [y for _, y in sample], odds)


def score(docs: DataFrame, model: MilModel) -> DataFrame:
    """doc_id, score (double, 0 to 1: label 1 likelier) of every whole text; null texts score as empty ones. Rows that
    repeat an id, or have none, are each returned; equal texts have equal scores; texts have any length; an empty
    table gives an empty result; other columns are dropped."""
    return score_texts(docs, model.score, SPACE)


def keep_good(docs: DataFrame, model: MilModel, threshold: float = 0.3) -> DataFrame:
    """The rows whose text scores at least threshold (null texts: as empty ones), all columns kept; a narrow step."""
    name = "score"
    while name in docs.columns:
        name = f"_{name}"
    return with_scores(docs, model.score, SPACE, name).where(F.col(name) >= threshold).select(*(f"`{c}`" for c in docs.columns))
