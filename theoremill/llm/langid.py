"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads every byte of a whole text (A-Z lowered) in both directions and labels each position with a
distribution over languages; a text's distribution is the mean over all its positions. Training is backpropagation
through time with Adam, on windows drawn from anywhere in the texts of a bounded sample.

Reading is done in windows side by side, as lanes of one matrix, so that a long text is no long loop. A window begins
with the state that the bytes before it give (behind it, for the way back): the network first runs over `WARM` of
them. Where the state so reached differs from the one with which the neighbouring window really ended, the window is
read again from that one, until all of them agree. So states are carried through the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremill.llm.common import bounded_text, lowest_by, prepare, remainder
from theoremill.llm.textbytes import LOWER, byte_chunks

#: Bounds of training: labelled texts per language; texts of more characters are represented by pieces of that many.
PER_LANGUAGE, MAX_CHARS = 300, 20_000
#: Values of a state; bytes of a window in training; bytes of a window when reading, and of its run-up.
HIDDEN, TRAIN_WINDOW, WINDOW, WARM = 8, 64, 512, 64
#: Windows read side by side (fewer with more than four languages); largest difference of a state that counts as the same.
LANES, SAME_STATE = 8192, 0.05
#: Bytes of texts that are read at once.
CHUNK = 4 << 20
#: Share of a state that is kept at most per byte, so that the run-up decides it.
KEEP = 0.8
UNKNOWN = "und"

_sigmoid = lambda x: 1 / (1 + np.exp(-x))


@dataclass
class Gru:
    """One direction: gates z and r and candidate n from a byte's row of `x` (256, 3 H) and the prior state."""

    x: np.ndarray
    u: np.ndarray  # (H, 3 H)
    parts: tuple = field(default=(), repr=False)

    def step(self, byte: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, tuple]:
        k = h.shape[1]
        a = self.x[byte]
        g = _sigmoid(a[:, : 2 * k] + h @ self.u[:, : 2 * k])
        z, r = KEEP * g[:, :k], g[:, k:]
        rh = r * h
        n = np.tanh(a[:, 2 * k :] + rh @ self.u[:, 2 * k :])
        return (1 - z) * n + z * h, (byte, h, z, r, rh, n)

    def back(self, kept: tuple, dh: np.ndarray, du: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients by the prior state and by the byte's row; adds to du."""
        _, h, z, r, rh, n = kept
        k = h.shape[1]
        dn = dh * (1 - z) * (1 - n**2)
        drh = dn @ self.u[:, 2 * k :].T
        dg = np.concatenate([dh * (h - n) * z * (1 - z / KEEP), drh * h * r * (1 - r)], 1)
        du[:, : 2 * k] += h.T @ dg
        du[:, 2 * k :] += rh.T @ dn
        return dh * z + drh * r + dg @ self.u[:, : 2 * k].T, np.concatenate([dg, dn], 1)

    def read(self, byte: np.ndarray, h: np.ndarray) -> np.ndarray:
        """step without what training needs, in few passes over contiguous arrays."""
        if not self.parts:
            k = h.shape[1]
            cut = lambda w, i, sign: np.ascontiguousarray(w[:, i * k : i * k + k] * sign, np.float32)
            self.parts = tuple(cut(w, i, sign) for w in (self.x, self.u) for i, sign in ((0, -1), (1, -1), (2, 1)))
        xz, xr, xn, uz, ur, un = self.parts
        r = np.take(xr, byte, axis=0)
        r += h @ ur
        np.exp(r, out=r)
        r += 1
        np.divide(h, r, out=r)
        n = np.take(xn, byte, axis=0)
        n += r @ un
        np.tanh(n, out=n)
        z = np.take(xz, byte, axis=0)
        z += h @ uz
        np.exp(z, out=z)
        z += 1
        np.divide(np.float32(KEEP), z, out=z)
        np.subtract(h, n, out=r)
        r *= z
        r += n
        return r


@dataclass
class LanguageModel:
    languages: list[str]
    forth: Gru
    back: Gru
    out: np.ndarray  # (2 H, L)
    bias: np.ndarray
    hidden: int = field(default=HIDDEN)

    def positions(self, data: np.ndarray) -> np.ndarray:
        """(T, L) label probabilities of all bytes of one text, read byte by byte."""
        t = len(data)
        both = np.zeros((t, 2 * self.hidden), np.float32)
        for gru, order, at in ((self.forth, range(t), slice(None, self.hidden)), (self.back, reversed(range(t)), slice(self.hidden, None))):
            h = np.zeros((1, self.hidden), np.float32)
            for i in order:
                h, _ = gru.step(data[i : i + 1], h)
                both[i, at] = h[0]
        s = both @ self.out + self.bias
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _lanes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, into: np.ndarray, outof: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows start to end, the longest first, read from the states `into` (way forth) and `outof` (way back): sums of
        their probabilities (L, n), and the states at which they end (forth) and begin (back)."""
        size = end - start
        steps, k = int(size[0]), self.hidden
        active = np.searchsorted(-size, -np.arange(steps), "left")  # windows longer than t bytes
        out_f, out_b = (np.ascontiguousarray(w.T, np.float32) for w in (self.out[:k], self.out[k:]))
        scores = np.empty((steps, len(out_f), len(start)), np.float32)
        forth, total = into.copy(), np.zeros((len(out_f), len(start)), np.float32)
        for t in range(steps):
            n = active[t]
            h = self.forth.read(data[start[:n] + t], forth[:n])
            forth[:n] = h
            scores[t, :, :n] = out_f @ h.T
        back, bias = outof.copy(), self.bias.astype(np.float32)[:, None]
        for t in reversed(range(steps)):
            n = active[t]
            h = self.back.read(data[start[:n] + t], back[:n])
            back[:n] = h
            s = out_b @ h.T
            s += scores[t, :, :n]
            s += bias
            s -= s.max(0)
            np.exp(s, out=s)
            s /= s.sum(0)
            total[:, :n] += s
        return total, forth, back

    def _run_up(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States at the two ends of windows, from the WARM bytes of the same text (low to high) before and behind them."""
        into, outof = (np.zeros((len(start), self.hidden), np.float32) for _ in range(2))
        led, followed = np.minimum(start - low, WARM), np.minimum(high - end, WARM)
        for j in reversed(range(1, WARM + 1)):  # a window whose text has fewer bytes there waits at nothing
            into = self.forth.read(data[np.maximum(start - j, 0)], into)
            into *= (j <= led)[:, None]
            outof = self.back.read(data[np.minimum(end + j, len(data)) - 1], outof)
            outof *= (j <= followed)[:, None]
        return into, outof

    def sums(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(n, L) sums of the position probabilities of each text; the states are carried through whole texts."""
        n = len(offsets) - 1
        result = np.zeros((n, len(self.languages)))
        each = -(-np.diff(offsets) // WINDOW)
        total = int(each.sum())
        if not total:
            return result
        text = np.repeat(np.arange(n), each)
        start = offsets[:-1][text] + (np.arange(total) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
        low, high = offsets[:-1][text], offsets[1:][text]
        end = np.minimum(start + WINDOW, high)
        into, outof, forth, back = (np.zeros((total, self.hidden), np.float32) for _ in range(4))
        sums = np.zeros((total, len(self.languages)), np.float32)
        order = np.argsort(start - end, kind="stable")
        again, first = order, True
        lanes = max(64, LANES * 4 // max(4, len(self.languages)))
        with np.errstate(over="ignore"):
            while len(again):
                for a in range(0, len(again), lanes):
                    some = again[a : a + lanes]
                    if first:
                        into[some], outof[some] = self._run_up(data, start[some], end[some], low[some], high[some])
                    found, forth[some], back[some] = self._lanes(data, start[some], end[some], into[some], outof[some])
                    sums[some] = found.T
                first = False
                # The state that the window before (behind) really ended with, where there is one.
                led = np.flatnonzero(start > low)
                followed = np.flatnonzero(end < high)
                changed = np.zeros(total, bool)
                changed[led] = np.abs(into[led] - forth[led - 1]).max(1) > SAME_STATE
                changed[followed] |= np.abs(outof[followed] - back[followed + 1]).max(1) > SAME_STATE
                again = order[changed[order]]
                led, followed = again[start[again] > low[again]], again[end[again] < high[again]]
                into[led], outof[followed] = forth[led - 1], back[followed + 1]
        for k in range(len(self.languages)):
            result[:, k] = np.bincount(text, sums[:, k], n)
        return result


def label_texts(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, mean probability) per text; `und` with 0 for texts without a letter."""
    n = len(texts)
    languages, scores = [UNKNOWN] * n, np.zeros(n)
    if not model.languages:
        return languages, scores
    share = model.sums(data, offsets) / np.maximum(np.diff(offsets), 1)[:, None]
    running = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    ascii_letter = running[offsets[1:]] > running[offsets[:-1]]
    for i, text in enumerate(texts):
        if ascii_letter[i] or text and any(c.isalpha() for c in text):
            best = int(share[i].argmax())
            languages[i] = model.languages[best]
            scores[i] = min(1.0, float(share[i, best]))
    return languages, scores


def gradients(model: LanguageModel, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy of all positions of windows x (n, T) with labels y (n), and its gradients by backpropagation
    through time: forth from the last byte to the first, back from the first to the last."""
    n, t = x.shape
    k, kind = model.hidden, model.out.dtype
    states, kept_f, kept_b = np.zeros((t, n, 2 * k), kind), [None] * t, [None] * t
    h = np.zeros((n, k), kind)
    for i in range(t):
        h, kept_f[i] = model.forth.step(x[:, i], h)
        states[i, :, :k] = h
    h = np.zeros((n, k), kind)
    for i in reversed(range(t)):
        h, kept_b[i] = model.back.step(x[:, i], h)
        states[i, :, k:] = h
    s = states @ model.out + model.bias
    e = np.exp(s - s.max(2, keepdims=True))
    e /= e.sum(2, keepdims=True)
    loss = float(-np.log(np.maximum(e[:, np.arange(n), y], 1e-30)).mean())
    e[:, np.arange(n), y] -= 1
    e /= n * t
    grad = {"o": states.reshape(t * n, -1).T @ e.reshape(t * n, -1), "b": e.sum((0, 1)), "fu": np.zeros_like(model.forth.u), "bu": np.zeros_like(model.back.u)}
    d = e @ model.out.T
    byte = x.T.ravel()
    order = np.argsort(byte, kind="stable")
    cut = np.flatnonzero(np.diff(byte[order], prepend=-1))
    for name, gru, kept, part, way in (("f", model.forth, kept_f, slice(None, k), reversed(range(t))), ("b", model.back, kept_b, slice(k, None), range(t))):
        rows, dh = np.zeros((t, n, 3 * k), kind), np.zeros((n, k), kind)
        for i in way:
            dh, rows[i] = gru.back(kept[i], dh + d[i, :, part], grad[name + "u"])
        grad[name + "x"] = np.zeros_like(gru.x)
        grad[name + "x"][byte[order][cut]] = np.add.reduceat(rows.reshape(t * n, -1)[order], cut)
    return loss, grad


def fit(texts: list[str], languages: list[str], hidden: int = HIDDEN, steps: int = 500, batch: int = 128, rate: float = 0.015, seed: int = 3, window: int = TRAIN_WINDOW) -> LanguageModel:
    """Train on texts with their language; every position of a window carries its text's label. Windows are drawn evenly
    over languages, then texts, then places; a shorter text is read again behind its end. Empty texts are left out."""
    pairs = [(LOWER[np.frombuffer(t.encode(), np.uint8)], y) for t, y in zip(texts, languages, strict=True) if t]
    names = sorted({y for _, y in pairs})
    rng = np.random.default_rng(seed)
    draw = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
    p = {"fx": draw(256, 3 * hidden), "fu": draw(hidden, 3 * hidden), "bx": draw(256, 3 * hidden), "bu": draw(hidden, 3 * hidden), "o": draw(2 * hidden, max(1, len(names))), "b": np.zeros(max(1, len(names)), np.float32)}
    model = lambda: LanguageModel(names, Gru(p["fx"], p["fu"]), Gru(p["bx"], p["bu"]), p["o"], p["b"], hidden)
    if len(names) < 2:
        return model()
    pools = [[data for data, y in pairs if y == name] for name in names]
    m = {k: np.zeros_like(x) for k, x in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), batch)
        chosen = [pools[i][rng.integers(len(pools[i]))] for i in y]
        x = np.stack([np.take(data, np.arange(a := int(rng.integers(max(1, len(data) - window + 1))), a + window), mode="wrap") for data in chosen])
        _, grad = gradients(model(), x, y)
        norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
            p[k] = (p[k] - rate * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model()


def train(docs: DataFrame, divisor: int = 3, rest: int = 1) -> LanguageModel:
    """Fit from text and lang of rows that are not held out: per language a bounded sample by keyed hash of the id.

    At most PER_LANGUAGE texts per language reach the driver, one per id, each of MAX_CHARS characters at most. Rows
    with a null id, text or lang are not used; without two languages the model knows one or none.
    """
    fair = docs.where(F.col("lang").isNotNull() & (remainder(F.col("doc_id"), divisor) != rest))
    fair = fair.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = lowest_by(fair.select("doc_id", "lang"), "doc_id", "lang", PER_LANGUAGE, 2)
    if not chosen:
        return fit([], [])
    ids = docs.sparkSession.createDataFrame(chosen, fair.select("doc_id", F.col("lang").alias("chosen")).schema)
    found = fair.join(F.broadcast(ids), "doc_id").where("lang = chosen and text is not null")  # at most PER_LANGUAGE ids per language
    piece = bounded_text(F.col("text"), F.col("doc_id"), MAX_CHARS)
    one = found.select("doc_id", "lang", piece.alias("text")).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    rows = sorted(one.select("doc_id", "lang", "text").collect())
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (double, 0 to 1) of every whole text.

    Null texts and texts without a letter: `und`, 0. Rows that repeat an id, or have none, are each returned; equal texts
    have equal results; texts have any length; an empty table gives an empty result; other columns are dropped.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, z, raw, offsets in byte_chunks(batch.column(1), CHUNK):
                languages, scores = label_texts(model, LOWER[raw], offsets, batch.column(1).slice(a, z - a).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a), pa.array(languages, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
