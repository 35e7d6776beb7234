"""Toxicity (operator 2): a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the sum of a word vector and the mean vector of its character
trigrams, both found by hash.  A network with gated recurrent units runs over a
window of words in both directions, attention pools its states, and the window
gets a logit.  Windows overlap by half and cover the whole text; a text's logit is
the log of the summed exponentials over its windows, so one toxic window is
enough.  Training sees texts' labels only and follows the gradient through that
sum.  A logistic curve fitted on texts kept apart calibrates the score.

Defined cases: a null text, an empty one and one without words score 0; without
labels of both kinds every other score is the share of toxic labels (0 without any); a
text of any length is scored whole, some thousand windows at a time; equal texts have
equal scores, so ties and repeated rows are scored each by itself; an empty table gives
no rows.  Of several labels of an id the largest holds; null ids and labels teach
nothing.  New columns replace old ones of their names, others stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._labels import labelled_sample, logistic
from ._text import Block, Words, mix64, slices, with_text_columns

#: The bounds of the sample to learn from: texts of each label, and characters of a text.
PER_CLASS, MAX_CHARS = 1000, 6_000
WINDOW, STRIDE = 32, 16
WORD_ROWS, TRIGRAM_ROWS = 1 << 14, 1 << 12
WIDTH, UNITS, ATTENTION = 12, 12, 8
EPOCHS, BATCH_TEXTS, RATE = 6, 24, 0.004
#: Windows scored at a time, so that a long text takes no more memory than its words.
WINDOWS_AT_ONCE = 4096


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Input:
    """The windows of a block: distinct words with their hashed rows, and each window's words among them."""

    def __init__(self, block: Block):
        words = Words(block)
        hashes = words.hashes()
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        self.words = (unique % np.uint64(WORD_ROWS)).astype(np.int64)
        starts, ends = words.starts[first], words.ends[first]
        sizes = ends - starts
        self.tri_of = np.repeat(np.arange(len(unique)), sizes)
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        data = np.concatenate([words.data, [0]]).astype(np.uint64)
        before = np.where(at > np.repeat(starts, sizes), data[at - 1], 1)
        after = np.where(at + 1 < np.repeat(ends, sizes), data[at + 1], 2)
        self.tri = (mix64(before << np.uint64(16) | data[at] << np.uint64(8) | after) % np.uint64(TRIGRAM_ROWS)).astype(np.int64)
        self.tri_starts = np.cumsum(sizes) - sizes
        self.tri_counts = sizes
        # A text of n words has windows at 0, STRIDE, … until one reaches its end.
        n = words.counts
        count = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1), 0)
        self.text_of = np.repeat(np.arange(block.n), count)
        rank = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        begin = np.repeat(words.first[:-1], count) + rank * STRIDE
        end = np.repeat(words.first[1:], count)
        grid = begin[None, :] + np.arange(WINDOW)[:, None]
        self.mask = (grid < end[None, :]).astype(np.float32)  # (WINDOW, windows)
        self.index = np.where(self.mask > 0, np.append(back, 0)[np.minimum(grid, len(back))], 0)
        self.bounds = np.concatenate([[0], np.cumsum(count)])


class Network:
    """The weights, the forward pass and its gradient."""

    NAMES = ("word", "tri", "wx", "bx", "uf", "ub", "wa", "ba", "va", "out", "bias")

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        f = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "word": (r.standard_normal((WORD_ROWS, WIDTH)) * 0.1).astype(np.float32),
            "tri": (r.standard_normal((TRIGRAM_ROWS, WIDTH)) * 0.1).astype(np.float32),
            "wx": f(WIDTH, 6 * UNITS),
            "bx": np.zeros(6 * UNITS, np.float32),
            "uf": f(UNITS, 3 * UNITS),
            "ub": f(UNITS, 3 * UNITS),
            "wa": f(2 * UNITS, ATTENTION),
            "ba": np.zeros(ATTENTION, np.float32),
            "va": f(ATTENTION),
            "out": f(2 * UNITS),
            "bias": np.full(1, -2.0, np.float32),
        }

    def embed(self, x: Input) -> np.ndarray:
        """Vectors of the distinct words."""
        if not len(x.words):
            return np.zeros((1, WIDTH), np.float32)
        chars = np.add.reduceat(self.p["tri"][x.tri], x.tri_starts, axis=0) / x.tri_counts[:, None].astype(np.float32)
        return self.p["word"][x.words] + chars

    @staticmethod
    def _run(gates: np.ndarray, u: np.ndarray, mask: np.ndarray, order: range, kept: list | None) -> np.ndarray:
        """States after each step; gates (steps, n, 3 units) hold what the inputs give to update, reset and candidate."""
        steps, n, _ = gates.shape
        states = np.zeros((steps, n, UNITS), np.float32)
        h = np.zeros((n, UNITS), np.float32)
        uzr, uc = np.ascontiguousarray(u[:, : 2 * UNITS]), np.ascontiguousarray(u[:, 2 * UNITS :])
        for t in order:
            zr = _sigmoid(gates[t, :, : 2 * UNITS] + h @ uzr)
            z, r = zr[:, :UNITS], zr[:, UNITS:]
            rh = r * h
            c = np.tanh(gates[t, :, 2 * UNITS :] + rh @ uc)
            m = mask[t][:, None]
            new = (h + z * (c - h)) * m  # padding leaves the state at nought
            if kept is not None:
                kept.append((t, h, z, r, rh, c, m))
            states[t] = h = new
        return states

    def logits(self, x: Input) -> np.ndarray:
        """Each window's logit."""
        fed = self.embed(x) @ self.p["wx"] + self.p["bx"]
        n = len(x.text_of)
        parts = [slice(k, k + WINDOWS_AT_ONCE) for k in range(0, n, WINDOWS_AT_ONCE)]
        return np.concatenate([self._pool(fed[x.index[:, k]], x.mask[:, k], None, None)[0] for k in parts]) if n else np.zeros(0, np.float32)

    def forward(self, x: Input, keep: bool = False):
        e = self.embed(x)
        kf, kb = ([], []) if keep else (None, None)
        logit, held = self._pool((e @ self.p["wx"] + self.p["bx"])[x.index], x.mask, kf, kb)
        return logit, (e, kf, kb, *held) if keep else None

    def _pool(self, gates: np.ndarray, mask: np.ndarray, kf: list | None, kb: list | None):
        p = self.p
        hf = self._run(gates[:, :, : 3 * UNITS], p["uf"], mask, range(WINDOW), kf)
        hb = self._run(gates[:, :, 3 * UNITS :], p["ub"], mask, range(WINDOW - 1, -1, -1), kb)
        h = np.concatenate([hf, hb], axis=2)
        a = np.tanh(h @ p["wa"] + p["ba"])
        s = np.where(mask > 0, a @ p["va"], np.float32(-1e9))
        w = np.exp(s - s.max(axis=0, keepdims=True))
        w /= w.sum(axis=0, keepdims=True)
        pooled = np.einsum("tn,tnh->nh", w, h)
        return pooled @ p["out"] + p["bias"][0], (h, a, w, pooled)

    @staticmethod
    def _back(kept: list, dh_all: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        uzr, uc = u[:, : 2 * UNITS], u[:, 2 * UNITS :]
        dgates = np.zeros(dh_all.shape[:2] + (3 * UNITS,), np.float32)
        du = np.zeros_like(u)
        carry = np.zeros(dh_all.shape[1:], np.float32)
        for t, h, z, r, rh, c, m in reversed(kept):
            d = (dh_all[t] + carry) * m
            dz = d * (c - h) * z * (1 - z)
            dc = d * z * (1 - c * c)
            drh = dc @ uc.T
            dr = drh * h * r * (1 - r)
            dzr = np.concatenate([dz, dr], axis=1)
            carry = d * (1 - z) + drh * r + dzr @ uzr.T
            dgates[t, :, : 2 * UNITS], dgates[t, :, 2 * UNITS :] = dzr, dc
            du[:, : 2 * UNITS] += h.T @ dzr
            du[:, 2 * UNITS :] += rh.T @ dc
        return dgates, du

    def gradient(self, x: Input, dlogit: np.ndarray, held) -> dict[str, np.ndarray]:
        p = self.p
        e, kf, kb, h, a, w, pooled = held
        g = {"out": pooled.T @ dlogit, "bias": dlogit.sum(keepdims=True)}
        dpooled = dlogit[:, None] * p["out"][None, :]
        dh = w[:, :, None] * dpooled[None]
        dw = np.einsum("tnh,nh->tn", h, dpooled)
        ds = w * (dw - (w * dw).sum(axis=0, keepdims=True))
        g["va"] = np.einsum("tn,tna->a", ds, a)
        da = ds[:, :, None] * p["va"] * (1 - a * a)
        flat, flat_h = da.reshape(-1, ATTENTION), h.reshape(-1, 2 * UNITS)
        g["wa"], g["ba"] = flat_h.T @ flat, flat.sum(axis=0)
        dh += (flat @ p["wa"].T).reshape(h.shape)
        df, g["uf"] = self._back(kf, dh[:, :, :UNITS], p["uf"])
        db, g["ub"] = self._back(kb, dh[:, :, UNITS:], p["ub"])
        dgates = (np.concatenate([df, db], axis=2) * x.mask[:, :, None]).reshape(-1, 6 * UNITS)
        at = x.index.ravel()
        order = np.argsort(at, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
        per_word = np.zeros((len(e), 6 * UNITS), np.float32)
        per_word[at[order][new]] = np.add.reduceat(dgates[order], new, axis=0)
        g["wx"], g["bx"] = e.T @ per_word, per_word.sum(axis=0)
        de = per_word @ p["wx"].T
        g["word"], g["tri"] = np.zeros_like(p["word"]), np.zeros_like(p["tri"])
        if len(x.words):
            np.add.at(g["word"], x.words, de)
            np.add.at(g["tri"], x.tri, (de / x.tri_counts[:, None])[x.tri_of])
        return g


def text_logits(logit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The log of the summed exponentials of each text's windows; -30 for none."""
    out = np.full(len(bounds) - 1, -30.0)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        top = np.maximum.reduceat(logit, bounds[full])
        total = np.add.reduceat(np.exp(logit - np.repeat(top, np.diff(bounds)[full])), bounds[full])
        out[full] = top + np.log(total)
    return out


def train(texts: list[str], marks: list[int], epochs: int = EPOCHS, seed: int = 5) -> Network:
    """Adam on the logistic loss of whole texts; as many toxic as other texts in a batch."""
    net, r = Network(seed), np.random.default_rng(seed)
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    by = [np.array([i for i, y in enumerate(marks) if y == k]) for k in (0, 1)]
    half = BATCH_TEXTS // 2
    steps = max(40, epochs * max(map(len, by)) // half)
    for step in range(1, steps + 1):
        chosen = np.concatenate([r.choice(b, half, replace=len(b) < half) for b in by])
        x = Input(Block(pa.array([texts[i] for i in chosen], pa.string())))
        if not len(x.text_of):
            continue
        logit, held = net.forward(x, keep=True)
        whole = text_logits(logit, x.bounds)
        y = np.array([marks[i] for i in chosen])
        d = (_sigmoid(np.clip(whole, -30, 30)) - y) / len(y)
        share = np.exp(logit - whole[x.text_of])  # of each window in its text's sum
        g = net.gradient(x, (d[x.text_of] * share).astype(np.float32), held)
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for k, v in g.items():
            mean[k] += 0.1 * (v - mean[k])
            square[k] += 0.01 * (v * v - square[k])
            net.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7) + rate * 0.01 * net.p[k] * (k in ("word", "tri"))
    return net


class ToxicityModel:
    def __init__(self, weights: dict | None, slope: float, shift: float, prior: float):
        self.weights, self.slope, self.shift, self.prior = weights, slope, shift, prior

    def scorer(self):
        if self.weights is None:
            return lambda block: np.where(Words(block).counts > 0, self.prior, 0.0)
        net = Network()
        net.p = self.weights

        def score(block: Block) -> np.ndarray:
            x = Input(block)
            if not len(x.text_of):
                return np.zeros(block.n)
            whole = text_logits(net.logits(x).astype(np.float64), x.bounds)
            return np.where(np.diff(x.bounds) > 0, _sigmoid(np.clip(self.slope * whole + self.shift, -30, 30)), 0.0)

        return score


def learn(documents: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, max_chars: int = MAX_CHARS, **columns) -> ToxicityModel:
    """A network trained on four fifths of the sample, calibrated on the rest at the labels' own shares."""
    rows, (n_clean, n_toxic) = labelled_sample(documents, labels, label, per_class, max_chars, **columns)
    prior = n_toxic / (n_clean + n_toxic) if n_clean + n_toxic else 0.0
    texts, marks = [t for t, _ in rows], [y for _, y in rows]
    apart = [i % 5 == 0 for i in range(len(rows))]
    if len({y for y, a in zip(marks, apart, strict=True) if not a}) < 2:
        return ToxicityModel(None, 0.0, 0.0, prior)
    net = train([t for t, a in zip(texts, apart, strict=True) if not a], [y for y, a in zip(marks, apart, strict=True) if not a])
    model = ToxicityModel(net.p, 1.0, 0.0, prior)
    test = [(t, y) for t, y, a in zip(texts, marks, apart, strict=True) if a]
    if len({y for _, y in test}) == 2:
        batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in test], pa.string())], names=["t"])
        logits = []
        for part in slices(batch, 0):
            x = Input(Block(part.column(0)))
            logits.append(text_logits(net.logits(x).astype(np.float64), x.bounds))
        y = np.array([y for _, y in test])
        weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
        # A mark at either end keeps the curve finite where the sample is told apart without error.
        z = np.clip(np.concatenate(logits), -12, 12)
        (slope,), shift = logistic(np.append(z, [-6.0, 6.0]), np.append(y, [1, 0]), np.append(weight, [0.02, 0.02]))
        if slope > 0:
            model.slope, model.shift = slope, shift
    return model


def score(documents: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``documents`` with the score of each whole text and whether it reaches ``threshold``; one pass, no shuffle."""
    sent = documents.sparkSession.sparkContext.broadcast((model.weights, model.slope, model.shift, model.prior))

    def make():
        one = ToxicityModel(*sent.value).scorer()

        def run(block: Block) -> dict:
            found = one(block).astype(float)
            return {"score": found, "predicted": (found >= threshold).astype(np.int32)}

        return run

    return with_text_columns(documents, text, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make, keep)
