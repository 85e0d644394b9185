"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability under a language sums over
all segmentations into pieces (a forward pass); a text's is the product over its words, so distinct words are scored once and
their log-probabilities are summed. The pieces' probabilities come from expectation-maximisation over the words of all labelled
training texts, counted per language before the shuffle; the expectation step runs on the executors and only sums per
(language, piece) come to the driver, at most languages x vocabulary numbers.

Words are the lower-cased runs of letters. Defined cases: a null text, or one without a letter, is ``und`` with score 0; rows with
null lang teach nothing; with no labelled row at all every text is ``und``; a null doc_id counts as the empty string in the
train/held-out rule; repeated rows each get a prediction; equal languages in score go to the first in order; further columns are
ignored by ``identified`` and pass through ``accepted``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 2
BATCHED_WORD = 40  # words up to here go through the passes many at a time, longer ones one by one with the same sums
BATCH_BYTES = 24 << 20  # sums and lattices of the words that a pass takes at once
UNKNOWN = 1e-6  # probability of a character that no piece holds, in every language
SMOOTHING = 0.1
MIN_SCORE = 0.5  # under it, ``accepted`` rejects a text
E_STEP_WORDS = 60_000  # distinct words of a language that an expectation step takes at once
FLUSH = 200_000  # distinct (language, word) pairs that a worker holds
CHUNK = 4 << 20  # text scored at once: distinct words go through the passes together
CACHE = 100_000  # words whose log-probabilities a task remembers

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    return found if any(c.isalpha() for w in found for c in w) else []


class Pieces:
    """The vocabulary's pieces that can occur in a lower-case word. Their prefixes are found by rolling hash and verified by key, so a
    stretch of text is followed only as far as some piece goes on."""

    def __init__(self, names: list[str]):
        self.names = sorted({x for x in names if x and x == x.lower()})
        self.longest = max(map(len, self.names), default=1)
        nodes: dict[str, int] = {"": 0}
        keys, before = [0], [0]
        for x in self.names:
            for k in range(1, len(x) + 1):
                if x[:k] not in nodes:
                    parent = nodes[x[: k - 1]]
                    nodes[x[:k]] = len(nodes)
                    keys.append(((keys[parent] if k > 1 else 7) * 0x9E3779B97F4A7C15 + ord(x[k - 1]) + 1) & 0xFFFFFFFFFFFFFFFF)
                    before.append(parent)
        self.keys = np.array(keys, np.uint64)
        self.more = np.zeros(len(keys), bool)
        self.more[before[1:]] = True
        self.piece = np.zeros(len(keys), np.int32)
        self.piece[[nodes[x] for x in self.names]] = np.arange(1, len(self.names) + 1)
        singles = {ord(x): i for x, i in nodes.items() if len(x) == 1}
        self.first = np.zeros(max(singles, default=0) + 2, np.int32)  # the last place stands for all characters beyond
        self.first[list(singles)] = list(singles.values())
        rng = np.random.default_rng(1)
        left, self.tables = np.arange(1, len(self.keys)), []
        while len(left):
            m, shift = np.uint64(int(rng.integers(1 << 62)) * 2 + 1), np.uint64(64 - max(8, int(16 * len(left)).bit_length()))
            with np.errstate(over="ignore"):
                slot = (self.keys[left] * m >> shift).astype(np.int64)
            table = np.zeros(1 << 64 - int(shift), np.int32)
            table[slot] = left  # of equal slots the last stays; a minus says that others are in the next table
            lost = table[slot] != left
            table[slot[lost]] = -np.abs(table[slot[lost]])
            self.tables.append((m, shift, table))
            left = left[lost]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The prefix of each hash, 0 for none."""
        out, left = None, None
        for m, shift, table in self.tables:
            now = h if left is None else h[left]
            with np.errstate(over="ignore"):
                got = table[(now * m >> shift).view(np.int64)]
            shared = got < 0
            again = np.flatnonzero(shared) if shared.any() else shared[:0]
            got = np.abs(got)
            got[self.keys[got] != now] = 0
            if left is None:
                out = got
            else:
                out[left] = got
            again = again[got[again] == 0] if len(again) else again
            if not len(again):
                break
            left = again if left is None else left[again]
        return out

    def lattice(self, codes: np.ndarray) -> list[list[tuple]]:
        """Of words of one length, for each start and number of characters: (words, pieces). The first of a start has every word, with piece 0
        where the character is none."""
        n, t = codes.shape
        out = []
        with np.errstate(over="ignore"):
            for i in range(t):
                rows, h, steps = np.arange(n), np.full(n, 7, np.uint64), []
                for k in range(min(self.longest, t - i)):
                    code = codes[rows, i + k] if k else codes[:, i]
                    h = h * np.uint64(0x9E3779B97F4A7C15) + code + np.uint64(1)
                    node = self.find(h) if k else self.first[np.minimum(code, np.uint64(len(self.first) - 1)).view(np.int64)]
                    piece = self.piece[node]
                    if k:
                        has = np.flatnonzero(piece)
                        steps.append((rows[has], piece[has]))
                    else:
                        steps.append((slice(None), piece))
                    on = np.flatnonzero(self.more[node])
                    if not len(on):
                        break
                    rows, h = rows[on], h[on]
                out.append(steps)
        return out


def vocabulary(path: str) -> list[str]:
    """The normal pieces of a sentencepiece model; a word begins with U+2581."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


def _by_length(found: list[str], longest: int, langs: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, code points with the word mark in front) of the words of each length up to BATCHED_WORD, as many as BATCH_BYTES hold."""
    lens = np.array([len(w) for w in found])
    for t in np.unique(lens[lens <= BATCHED_WORD]).tolist():
        at = np.flatnonzero(lens == t)
        most = max(1, BATCH_BYTES // ((t + 2) * (8 * langs + 4 * min(longest, t + 1) + 8)))
        for i in range(0, len(at), most):
            some = at[i : i + most]
            raw = np.frombuffer("".join([found[j] for j in some.tolist()]).encode("utf-32-le"), np.uint32).reshape(-1, t)
            codes = np.empty((len(some), t + 1), np.uint64)
            codes[:, 0], codes[:, 1:] = 0x2581, raw
            yield some, codes


def _alphas(lattice: list, prob: np.ndarray, longest: int) -> tuple[list[np.ndarray], dict[int, np.ndarray]]:
    """Forward sums at each place, and the sums by which those from a place on are divided, every ``longest`` places (a piece crosses one
    such place at most). prob: (piece, language), row 0 zero."""
    n, t = len(lattice[0][0][1]), len(lattice)
    alpha, scale = [np.zeros((n, prob.shape[1])) for _ in range(t + 1)], {}
    alpha[0][:] = 1
    for i in range(t):
        if i and i % longest == 0:
            s = scale[i] = alpha[i]
            for j in range(i, min(i + longest, t + 1)):
                alpha[j] = alpha[j] / s
        for k, (who, ids) in enumerate(lattice[i]):
            use = prob[ids]
            if not k:
                use[ids == 0] = UNKNOWN
            use *= alpha[i][who]
            alpha[i + k + 1][who] += use
    return alpha, scale


def log_probs(pieces: Pieces, prob: np.ndarray, found: list[str]) -> np.ndarray:
    """Log-probability of each word under each language, over all segmentations."""
    out = np.zeros((len(found), prob.shape[1]))
    for at, codes in _by_length(found, pieces.longest, prob.shape[1]):
        alpha, scale = _alphas(pieces.lattice(codes), prob, pieces.longest)
        out[at] = sum(map(np.log, scale.values()), np.log(alpha[-1]))
    index = None
    for j, w in enumerate(found):
        if len(w) > BATCHED_WORD:
            index = index or {x: i for i, x in enumerate(pieces.names, 1)}
            out[j] = _long(index, prob, "▁" + w, pieces.longest)
    return out


def _long(index: dict[str, int], prob: np.ndarray, w: str, longest: int) -> np.ndarray:
    """The same for one long word: a ring of forward sums, rescaled at each place."""
    ring, log = [np.ones(prob.shape[1])], np.zeros(prob.shape[1])
    for j in range(1, len(w) + 1):
        now = np.zeros(prob.shape[1])
        for k in range(1, min(longest, j) + 1):
            i = index.get(w[j - k : j], 0)
            if i:
                now = now + ring[-k] * prob[i]
            elif k == 1:
                now = now + ring[-1] * UNKNOWN
        ring = [x / now for x in (ring[-longest + 1 :] if longest > 1 else [])] + [np.ones(prob.shape[1])]
        log += np.log(now)
    return log


def _long_uses(index: dict[str, int], prob: list[float], w: str, longest: int) -> Iterator[tuple[int, float]]:
    """(piece, expected uses) of one long word: each place's shares of what ends there, then the places' own chances from the end back."""
    ring, shares = [1.0], [[]]
    for j in range(1, len(w) + 1):
        ways = []
        for k in range(1, min(longest, j) + 1):
            i = index.get(w[j - k : j], 0)
            if i:
                ways.append((k, i, ring[-k] * prob[i]))
            elif k == 1:
                ways.append((1, 0, ring[-1] * UNKNOWN))
        now = sum(x for _, _, x in ways)
        shares.append([(k, i, x / now) for k, i, x in ways])
        ring = [x / now for x in (ring[-longest + 1 :] if longest > 1 else [])] + [1.0]
    chance = [0.0] * len(w) + [1.0]
    for j in range(len(w), 0, -1):
        for k, i, share in shares[j]:
            x = chance[j] * share
            chance[j - k] += x
            if i:
                yield i, x


def expected(pieces: Pieces, prob: np.ndarray, found: list[str], times: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur ``times`` times, by forward and backward sums. prob: (piece,)."""
    total = np.zeros(len(prob))
    column = prob[:, None]
    for at, codes in _by_length(found, pieces.longest, 1):
        lattice = pieces.lattice(codes)
        alpha, scale = _alphas(lattice, column, pieces.longest)
        t = len(lattice)
        beta = [np.zeros(len(at)) for _ in range(t)] + [times[at] / alpha[t][:, 0]]
        for i in range(t - 1, -1, -1):
            turn = (i // pieces.longest + 1) * pieces.longest  # sums from here on have another scale
            for k, (who, ids) in enumerate(lattice[i]):
                after = beta[i + k + 1][who]
                if turn in scale and i + k + 1 >= turn:
                    after = after / scale[turn][who, 0]
                use = prob[ids]
                if not k:
                    use[ids == 0] = UNKNOWN
                use *= after
                beta[i][who] += use
                total += np.bincount(ids, alpha[i][who, 0] * use, len(prob))
    long = [j for j, w in enumerate(found) if len(w) > BATCHED_WORD]
    if long:
        index, p = {x: i for i, x in enumerate(pieces.names, 1)}, prob.tolist()
        for j in long:
            for i, x in _long_uses(index, p, "▁" + found[j], pieces.longest):
                total[i] += x * times[j]
    total[0] = 0
    return total


def held_out(doc_id="doc_id"):
    """Whether a row is kept from learning: crc32 of doc_id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    def __init__(self, pieces: Pieces, langs: list[str], prior: np.ndarray, prob: np.ndarray):
        self.pieces, self.langs, self.prior, self.prob = pieces, langs, prior, prob


class Scorer:
    """Predictions by a model; up to CACHE words' log-probabilities are kept from one call to the next."""

    def __init__(self, model: Model):
        self.model, self.known, self.per_word = model, {}, np.zeros((0, len(model.langs)))

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its probability) of each text."""
        m = self.model
        if len(self.known) > CACHE:
            self.known, self.per_word = {}, self.per_word[:0]
        known, n_before = self.known, len(self.known)
        ids, counts = [], []
        for t in texts:
            own = [known.setdefault(w, len(known)) for w in words(t)]
            ids.append(np.array(own, np.int32))
            counts.append(len(own))
        if not m.langs or not any(counts):
            self.known, self.per_word = {}, self.per_word[:0]
            return [("und", 0.0)] * len(texts)
        if len(known) > n_before:
            self.per_word = np.concatenate((self.per_word, log_probs(m.pieces, m.prob, list(islice(known, n_before, None)))))
        who, at = np.repeat(np.arange(len(texts)), counts), np.concatenate(ids)
        total = np.stack([np.bincount(who, self.per_word[at, k], len(texts)) for k in range(len(m.langs))], 1) + m.prior
        best = total.argmax(1)
        with np.errstate(under="ignore"):
            score = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        return [(m.langs[b], float(s)) if n else ("und", 0.0) for b, s, n in zip(best.tolist(), score, counts, strict=True)]


def learn(docs: DataFrame, vocabulary_path: str, rounds: int = ROUNDS) -> Model:
    """From the texts and languages of all rows that aren't held out."""
    spark = docs.sparkSession
    pieces = Pieces(vocabulary(vocabulary_path))
    shared = spark.sparkContext.broadcast(pieces)

    def count(batches):
        found, texts = Counter(), Counter()

        def out():
            keys = list(found.items()) + [((k, ""), v) for k, v in texts.items()]  # the empty word counts texts
            found.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in keys], pa.string()), pa.array([k[1] for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.int64())],
                ["lang", "word", "n"],
            )

        for part in common.chunks(batches):
            own: dict[str, list] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                texts[lang] += 1
                own.setdefault(lang, []).extend(words(text))
            for lang, some in own.items():
                for w, n in Counter(some).items():
                    found[lang, w] += n
            if len(found) > FLUSH:
                yield out()
        yield out()

    train = docs.select("lang", "text").filter(~held_out() & F.col("lang").isNotNull())
    counted = common.cut(train.mapInArrow(common.tidy(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    priors = {r.lang: r.n for r in counted.filter("word = ''").collect()}
    langs = sorted(priors)
    size = len(pieces.names) + 1
    prob = np.full((size, len(langs)), 1.0 / (size - 1))
    prob[0] = 0
    for _ in range(rounds if langs else 0):
        now = spark.sparkContext.broadcast((langs, prob))

        def estimate(batches, now=now):
            known, p = now.value
            total = np.zeros_like(p)
            held: dict[str, tuple[list, list]] = {x: ([], []) for x in known}

            def take(name):
                some, times = held[name]
                if some:
                    total[:, known.index(name)] += expected(shared.value, p[:, known.index(name)], some, np.array(times, float))
                held[name] = ([], [])

            for b in batches:  # words meet in large groups: the passes work on all words of one length at once
                for lang, w, n in zip(b.column("lang").to_pylist(), b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                    held[lang][0].append(w)
                    held[lang][1].append(n)
                for name in known:
                    if len(held[name][0]) >= E_STEP_WORDS:
                        take(name)
            for name in known:
                take(name)
            i, k = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(i, pa.int32()), "k": pa.array(k, pa.int32()), "n": pa.array(np.round(total[i, k] * 1024).astype(np.int64))})

        got = counted.filter("word != ''").mapInArrow(common.tidy(estimate), "piece int, k int, n long").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        uses = np.full_like(prob, SMOOTHING)
        uses[got.column("piece").to_numpy(), got.column("k").to_numpy()] += got.column("n").to_numpy() / 1024
        uses[0] = 0
        prob = uses / uses.sum(0)
        now.unpersist()
    shared.unpersist()
    total = sum(priors.values())
    return Model(pieces, langs, np.log(np.array([priors[x] / total for x in langs])), prob)


def _predicted(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = Scorer(shared.value)
        for part in common.chunks(batches, size=CHUNK):
            got = predict(part.column("text").to_pylist())
            names = [*part.schema.names, "lang_pred", "score"]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(common.tidy(run), ", ".join([*fields, "lang_pred string, score double"]))


def identified(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(rows, vocabulary_path)
    return _predicted(rows.drop("lang"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, vocabulary_path: str, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs`` whose language can be told, with their columns as they are."""
    model = learn(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), vocabulary_path)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = Scorer(shared.value)
        for part in common.chunks(batches, size=CHUNK):
            got = predict(part.column("text").to_pylist())
            yield part.filter(pa.array([x[0] != "und" and x[1] >= min_score for x in got], pa.bool_()))

    return docs.mapInArrow(common.tidy(run), docs.schema)
