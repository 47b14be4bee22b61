"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, other texts are unlabelled (they hide more toxic ones). With class prior p
the risk of a linear classifier is  p * R_pos(+1) + max(0, R_unl(-1) - p * R_pos(-1)); where the bracket turns
negative the step goes against it (the non-negative correction). Features: presence of all words and beginnings of
words (PREFIXES bytes), hashed, that are significantly more frequent in positives than in unlabelled texts; a beginning
stands for words of one family that the sample does not hold. Everything is numpy; the fit takes a bounded sample,
scoring reads whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.common import lowest_keys, read_short, remainder, score_texts, text_sample, texts_by_id
from theoremill.llm.textbytes import NOT_ALNUM, Words, mix, words_in

#: Bounds of the training sample: positives, unlabelled texts, characters of one text.
POSITIVES, UNLABELLED, MAX_CHARS = 3000, 9000, 20_000
#: Bytes of the beginnings of longer words that are features too.
PREFIXES = (5, 7)
#: Share of chance words accepted among the chosen ones (Benjamini and Hochberg).
FALSE_WORDS = 0.05


def words_of(texts: list[str]) -> Words:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return words_in(np.frombuffer(b"".join(raw), np.uint8), offsets, NOT_ALNUM)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every word and of the beginnings of longer ones."""
    text, size = words.text_of(), words.ends - words.starts
    found, of = [words.hashes()], [text]
    for k in PREFIXES:
        longer = np.flatnonzero(size > k)
        part = replace(words, starts=words.starts[longer], ends=words.starts[longer] + k)
        found.append(mix(part.hashes() + np.uint64(k)))
        of.append(text[longer])
    return np.concatenate(found), np.concatenate(of)


def _distinct(texts: list[str]) -> list[np.ndarray]:
    out = []
    for a in range(0, len(texts), 256):
        words = words_of(texts[a : a + 256])
        h, of = features(words)
        order = np.argsort(of, kind="stable")
        cut = np.searchsorted(of[order], np.arange(len(words.first)))
        out += [np.unique(h[order[i:j]]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return out


@dataclass
class PuModel:
    words: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, words: Words) -> np.ndarray:
        """Probability per text; a text without any known word gets the bias alone, and so do empty texts."""
        n = len(words.first) - 1
        h, of = features(words)
        at = np.searchsorted(self.words, h) if len(self.words) else np.zeros(len(h), int)
        at = np.minimum(at, max(0, len(self.words) - 1))
        hit = np.flatnonzero(self.words[at] == h) if len(self.words) else np.zeros(0, int)
        pairs = np.unique(of[hit] * max(1, len(self.words)) + at[hit])
        total = np.bincount(pairs // max(1, len(self.words)), self.weights[pairs % max(1, len(self.words))], n) if len(pairs) else np.zeros(n)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -30, 30)))


def _chance(k: int, n: int, p: float) -> float:
    """Probability of k or more of n texts being positive if each is with probability p."""
    j = np.arange(k, n + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in j]) + j * math.log(p) + (n - j) * math.log1p(-p)
    return float(min(1.0, np.exp(log).sum()))


def significant(in_pos: np.ndarray, in_all: np.ndarray, p: float, share: float = FALSE_WORDS) -> np.ndarray:
    """Which words, seen in in_pos positives among in_all texts, are more frequent in positives than chance gives, with
    at most `share` of them by chance. p: share of positives among the texts."""
    pairs, at = np.unique(np.stack([in_pos, in_all], 1), axis=0, return_inverse=True)
    chance = np.array([_chance(int(k), int(n), p) if k > n * p else 1.0 for k, n in pairs])[at.ravel()]
    order = np.sort(chance)
    passed = np.flatnonzero(order <= share * np.arange(1, len(order) + 1) / max(1, len(order)))
    return chance <= order[passed[-1]] if len(passed) else np.zeros(len(chance), bool)


class Presence:
    """Which of the chosen features (sorted) texts hold, as (row, column) pairs: a sparse matrix of ones."""

    def __init__(self, texts: list[np.ndarray], chosen: np.ndarray):
        found = [np.flatnonzero(np.isin(chosen, t, assume_unique=True)) for t in texts]
        self.n, self.width, self.column = len(texts), len(chosen), np.concatenate([np.zeros(0, int), *found]).astype(int)
        self.row = np.repeat(np.arange(len(texts)), [len(f) for f in found])

    def scores(self, w: np.ndarray) -> np.ndarray:
        """Sigmoids of x . w + b, the last of w being b."""
        return 1 / (1 + np.exp(-np.clip(np.bincount(self.row, w[self.column], self.n) + w[-1], -30, 30)))

    def slope(self, s: np.ndarray) -> np.ndarray:
        """Gradient of the mean of the sigmoids s by w."""
        g = s * (1 - s) / self.n
        return np.append(np.bincount(self.column, g[self.row], self.width), g.sum())


def risks(positive: Presence, unlabelled: Presence, w: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Risks of label 1 and label 0 under the sigmoid loss, each with its gradient by w. The second is that of the unlabelled
    texts less what the positives among them add; where this is negative, the estimate has overfitted."""
    sp, su = positive.scores(w), unlabelled.scores(w)
    on_pos, on_unl = positive.slope(sp), unlabelled.slope(su)
    return prior * (1 - sp).mean(), su.mean() - prior * sp.mean(), -prior * on_pos, on_unl - prior * on_pos


def fit_nnpu(positive: list[str], unlabelled: list[str], prior: float, steps: int = 600, rate: float = 0.05, decay: float = 1e-6) -> PuModel:
    """Fit on texts. Without positives or unlabelled texts the model is the prior for every text."""
    prior = float(np.clip(prior, 1e-4, 0.9))
    if not positive or not unlabelled:
        return PuModel(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
    sets = [_distinct(positive), _distinct(unlabelled)]
    values, seen = zip(*(np.unique(np.concatenate(s), return_counts=True) for s in sets), strict=True)
    n_pos, n_unl = len(positive), len(unlabelled)
    vocabulary = values[0]
    at = np.minimum(np.searchsorted(values[1], vocabulary), len(values[1]) - 1)
    in_unl = np.where(values[1][at] == vocabulary, seen[1][at], 0) if len(values[1]) else np.zeros(len(vocabulary), int)
    tried = np.flatnonzero(seen[0] >= min(3, n_pos))
    chosen = vocabulary[tried[significant(seen[0][tried], (seen[0] + in_unl)[tried], n_pos / (n_pos + n_unl))]]
    xp, xu = Presence(sets[0], chosen), Presence(sets[1], chosen)
    w = np.append(np.zeros(len(chosen)), np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        _, negative, up, down = risks(xp, xu, w, prior)
        grad = up + down if negative >= 0 else -down
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)  # presence of a word is evidence for toxicity or none
    return PuModel(chosen, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, divisor: int = 5, rest: int = 0) -> PuModel:
    """Fit from `labels.toxic` = 1 of rows that are not held out, unlabelled texts of such rows, and the share of
    toxic ones among their labels as class prior."""
    read_short(docs.sparkSession)
    fair = labels.where(remainder(F.col("doc_id"), divisor) != rest)
    prior = fair.where(F.col("toxic").isin(0, 1)).agg(F.avg("toxic")).first()[0]
    marked = texts_by_id(docs, lowest_keys(fair.where("toxic = 1"), "doc_id", POSITIVES), MAX_CHARS)
    positive = [t for _, t in sorted(marked.items())]
    return fit_nnpu(positive, text_sample(docs, UNLABELLED, divisor, rest, MAX_CHARS), 0.1 if prior is None else prior)


def score(docs: DataFrame, model: PuModel) -> DataFrame:
    """doc_id, score (double, 0 to 1) of every whole text; null texts score as empty ones. Rows that repeat an id, or have
    none, are each returned; equal texts have equal scores; texts have any length; an empty table gives an empty
    result; other columns are dropped."""
    read_short(docs.sparkSession)
    return score_texts(docs, model.score, NOT_ALNUM)
