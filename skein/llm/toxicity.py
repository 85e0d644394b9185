"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained here in numpy.

A word's input is its own embedding (words of the training sample; others share one) and the mean of the embeddings of its
hashed character trigrams. A text is scored on overlapping windows that cover all of its words; its score is that of its worst
window, calibrated on the training texts. Training is multiple-instance: the label of a text trains its currently worst window.
The fitted sample holds at most ``SAMPLE`` labelled documents of each label, the first by hash of doc_id, one text of each; of a text of
more than ``SAMPLE_WORDS`` words it holds that many, in whole windows at even distances from its first word to its last. So at most
2 * SAMPLE * SAMPLE_WORDS words come to the driver, cut on the executors.

Defined cases: a null or wordless text scores 0; rows without a label, or with a null one, teach nothing; several labels of one
doc_id count as toxic if any is; with no labelled row of one of the labels every score is 0; a null doc_id counts as the empty
string in the train/held-out rule and joins no label; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .langid import held_out

SAMPLE = 1500  # labelled documents of each label that training takes at most
SAMPLE_WORDS = 4096  # of a longer text training takes this many words, in windows spread evenly over the whole text; scoring takes every text whole
WINDOW, STRIDE = 32, 24
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
VOCABULARY, BUCKETS = 20_000, 1 << 12
LIMIT = 0.3

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def trigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character trigrams of each word, marked at its ends, and each word's first."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(found) + "\x03").encode("utf-32-le"), np.uint32).astype(np.uint64)
    lens = np.array([len(w) for w in found], np.int64)
    first = np.concatenate(([0], np.cumsum(lens)))[:-1]
    at = np.arange(int(lens.sum())) + 2 * np.repeat(np.arange(len(found)), lens)
    with np.errstate(over="ignore"):
        h = common.mix((codes[at] * np.uint64(1_000_003) + codes[at + 1]) * np.uint64(1_000_033) + codes[at + 2])
    return (h % np.uint64(BUCKETS)).astype(np.int64), first


def windows(n: int) -> list[int]:
    """Starts of the windows over n words: they overlap by WINDOW - STRIDE and leave no word out."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)) if n else []


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _add_rows(total: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds each row to the row of ``total`` that ``at`` names; equal ones add up."""
    if len(at):
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        total[own] += np.add.reduceat(rows[order], first)


class Network:
    """Parameters in ``p``; ``forward`` keeps what ``backward`` needs."""

    def __init__(self, vocabulary: list[str], weights: np.ndarray):
        rng = np.random.default_rng(0)
        self.index = {w: i for i, w in enumerate(vocabulary, 1)}
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        r = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.p = {"word": r(len(vocabulary) + 1, WORD_DIM) * 0.3, "char": r(BUCKETS, CHAR_DIM) * 0.3, "wa": r(2 * h, ATTENTION), "va": r(ATTENTION), "wo": r(2 * h), "bo": np.zeros(1, np.float32)}
        self.p["word"][1:, 0] = weights
        for side in "fb":
            self.p |= {f"w{side}": r(d, 3 * h), f"u{side}": r(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.scale, self.shift = 1.0, 0.0

    def inputs(self, found: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vectors of distinct words; a first row of zeros stands for padding."""
        ids = np.array([self.index.get(w, 0) for w in found], np.int64)
        grams, first = trigrams(found)
        n = np.diff(np.append(first, len(grams)))
        x = np.zeros((len(found) + 1, WORD_DIM + CHAR_DIM), np.float32)
        x[1:, :WORD_DIM] = self.p["word"][ids]
        x[1:, WORD_DIM:] = np.add.reduceat(self.p["char"][grams], first) / n[:, None]
        return x, (ids, grams, n)

    def run(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows: rows of places in x, 0 for padding at the end."""
        n, t = at.shape
        mask = (at > 0).astype(np.float32)
        states, kept = np.zeros((2, t, n, HIDDEN), np.float32), []
        for s, side in enumerate("fb"):
            gates = x @ self.p["w" + side] + self.p["b" + side]
            u, h = self.p["u" + side], np.zeros((n, HIDDEN), np.float32)
            for i in range(t) if side == "f" else range(t - 1, -1, -1):
                g, m, q = gates[at[:, i]], mask[:, i : i + 1], h @ u
                z, r = np.split(_sigmoid(g[:, : 2 * HIDDEN] + q[:, : 2 * HIDDEN]), 2, 1)
                c = np.tanh(g[:, 2 * HIDDEN :] + r * q[:, 2 * HIDDEN :])
                if keep:
                    kept.append((s, i, h, z, r, c, q[:, 2 * HIDDEN :]))
                h = h + m * (1 - z) * (c - h)
                states[s, i] = h
        hs = np.concatenate((states[0], states[1]), 2)
        u = np.tanh(hs @ self.p["wa"])
        e = (u @ self.p["va"]) + (mask.T - 1) * 1e4
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * hs).sum(0)
        logit = pooled @ self.p["wo"] + self.p["bo"][0]
        return (logit, (x, at, mask, hs, u, a, pooled, kept)) if keep else logit

    def gradients(self, cache: tuple, extra: tuple, d: np.ndarray) -> dict[str, np.ndarray]:
        """Of the sum of logits weighted by d."""
        x, at, mask, hs, u, a, pooled, kept = cache
        p, g = self.p, {k: np.zeros_like(v) for k, v in self.p.items()}
        g["wo"], g["bo"][0] = pooled.T @ d, d.sum()
        dp = d[:, None] * p["wo"]
        dh = a[:, :, None] * dp
        da = (hs * dp).sum(2)
        de = a * (da - (a * da).sum(0))
        g["va"] = np.einsum("tn,tnk->k", de, u)
        du = de[:, :, None] * p["va"] * (1 - u * u)
        g["wa"] = np.einsum("tnh,tnk->hk", hs, du)
        dh = dh + du @ p["wa"].T
        dx = np.zeros_like(x)
        late = [np.zeros((at.shape[0], HIDDEN), np.float32) for _ in range(2)]
        dgates = np.empty((2, *at.T.shape, 3 * HIDDEN), np.float32)
        for s, i, h, z, r, c, qn in reversed(kept):
            side, m = "fb"[s], mask[:, i : i + 1]
            now = late[s] + dh[i, :, s * HIDDEN : (s + 1) * HIDDEN]
            dc = now * m * (1 - z) * (1 - c * c)
            dz = now * m * (h - c) * z * (1 - z)
            dr = dc * qn * r * (1 - r)
            dgates[s, i] = np.concatenate((dz, dr, dc), 1)
            dq = np.concatenate((dz, dr, dc * r), 1)
            g["u" + side] += h.T @ dq
            late[s] = now * (1 - m * (1 - z)) + dq @ p["u" + side].T
        places = at.T.ravel()
        for s, side in enumerate("fb"):  # the places of a word share its input: their gate gradients are summed once per word
            sums = np.zeros((len(x), 3 * HIDDEN), np.float32)
            _add_rows(sums, places, dgates[s].reshape(-1, 3 * HIDDEN))
            g["b" + side] += sums.sum(0)
            g["w" + side] += x.T @ sums
            dx += sums @ p["w" + side].T
        ids, grams, n = extra
        _add_rows(g["word"], ids, dx[1:, :WORD_DIM])
        _add_rows(g["char"], grams, np.repeat(dx[1:, WORD_DIM:] / n[:, None], n, 0))
        return g

    def logits(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Of the windows of each text."""
        known: dict[str, int] = {}
        ids = [np.array([known.setdefault(w, len(known) + 1) for w in t], np.int64) for t in texts]
        if not known:
            return [np.zeros(0, np.float32) for _ in texts]
        x, _ = self.inputs(list(known))
        starts = [windows(len(t)) for t in texts]
        every = [(i, s) for i, own in enumerate(starts) for s in own]
        out = np.empty(len(every), np.float32)
        for b in range(0, len(every), 4096):
            at = np.zeros((len(every[b : b + 4096]), WINDOW), np.int64)
            for row, (i, s) in zip(at, every[b : b + 4096], strict=True):
                got = ids[i][s : s + WINDOW]
                row[: len(got)] = got
            out[b : b + len(at)] = self.run(x, at)
        cut = np.cumsum([len(own) for own in starts])[:-1]
        return np.split(out, cut)

    def scores(self, texts: list[str | None]) -> list[float]:
        found = self.logits([words(t) for t in texts])
        return [float(_sigmoid(self.scale * x.max() + self.shift)) if len(x) else 0.0 for x in found]


def train(rows: list[tuple[str, int]], rounds: int = 2, epochs: int = 5, batch: int = 128) -> Network | None:
    """A network from (text, label) rows; None if a label is missing."""
    texts, labels = [words(t) for t, _ in rows], np.array([y for _, y in rows], np.float32)
    if not (labels == 1).any() or not (labels == 0).any():
        return None
    # starting weights of words: smoothed log-odds of texts with the word
    counts = [Counter(), Counter()]
    for t, y in zip(texts, labels, strict=True):
        counts[int(y)].update(set(t))
    n = [int((labels == k).sum()) for k in (0, 1)]
    vocabulary = [w for w, c in (counts[0] + counts[1]).most_common(VOCABULARY) if c >= 3]
    odds = {w: np.log((counts[1][w] + 0.5) / (n[1] + 1)) - np.log((counts[0][w] + 0.5) / (n[0] + 1)) for w in vocabulary}
    net = Network(vocabulary, np.array([odds[w] for w in vocabulary], np.float32) * 0.5)
    rng = np.random.default_rng(0)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def weight(t, s):
        return max(odds.get(w, 0.0) for w in t[s : s + WINDOW])

    for again in range(rounds):
        found = net.logits(texts) if again else [np.array([weight(t, s) for s in windows(len(t))]) for t in texts]
        picked = []
        for i, (t, f) in enumerate(zip(texts, found, strict=True)):
            if len(f):
                own = windows(len(t))
                chosen = {int(f.argmax())} | (set() if labels[i] else {int(k) for k in rng.integers(len(own), size=2)})
                picked += [(t[own[k] : own[k] + WINDOW], labels[i]) for k in sorted(chosen)]
        for _ in range(epochs):
            order = rng.permutation(len(picked))
            for b in range(0, len(order), batch):
                some = [picked[i] for i in order[b : b + batch]]
                known: dict[str, int] = {}
                at = np.zeros((len(some), WINDOW), np.int64)
                for row, (t, _) in zip(at, some, strict=True):
                    row[: len(t)] = [known.setdefault(w, len(known) + 1) for w in t]
                x, extra = net.inputs(list(known))
                logit, cache = net.run(x, at, keep=True)
                g = net.gradients(cache, extra, (_sigmoid(logit) - np.array([y for _, y in some], np.float32)) / len(some))
                step += 1
                for k, (m, v) in moments.items():
                    m += 0.1 * (g[k] - m)
                    v += 0.001 * (g[k] * g[k] - v)
                    net.p[k] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # calibration on whole texts: one logistic regression on the worst window's logit
    worst = np.array([f.max() if len(f) else -5.0 for f in net.logits(texts)], np.float64)
    a, c = 1.0, 0.0
    for _ in range(500):
        d = _sigmoid(a * worst + c) - labels
        a, c = max(0.05, a - 0.05 * (d * worst).mean() - 0.0005 * (a - 1)), c - 0.05 * d.mean()
    net.scale, net.shift = a, c
    return net


def shortened(text: str | None) -> str | None:
    """A text of at most SAMPLE_WORDS words; of a longer one, windows at even distances, with all words between one's first and its last."""
    found = list(_WORD.finditer(text or ""))
    if len(found) <= SAMPLE_WORDS:
        return text
    n = SAMPLE_WORDS // WINDOW
    starts = [i * (len(found) - WINDOW) // (n - 1) for i in range(n)]
    return "\n".join(text[found[s].start() : found[s + WINDOW - 1].end()] for s in starts)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> list[tuple[str, int]]:
    """At most ``most`` labelled training texts of each label; only their ids, a bounded number, are broadcast."""
    spark = docs.sparkSession
    marked = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(~held_out())
    first = F.xxhash64("doc_id")
    ids = [tuple(r) for y in (0, 1) for r in marked.filter(F.col("toxic") == y).orderBy(first, "doc_id").limit(most).select("doc_id", "toxic").collect()]
    if not ids:
        return []
    chosen = F.broadcast(spark.createDataFrame(ids, "doc_id long, toxic int"))

    def cut(batches):
        for part in common.chunks(batches):
            texts = pa.array([shortened(t) for t in part.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), texts], ["doc_id", "toxic", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", "toxic", "text")
    short = rows.mapInArrow(common.tidy(cut), "doc_id long, toxic int, text string").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    return [(r.text, r.toxic) for r in sorted(short.collect())]


def scored(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    net = train(sample(docs, labels))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for part in common.chunks(batches, size=1 << 20):
            texts = part.column("text").to_pylist()
            got = shared.value.scores(texts) if shared.value else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(got, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(run), "doc_id long, score double")
    return rows.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= limit).cast("int").alias("predicted"))
