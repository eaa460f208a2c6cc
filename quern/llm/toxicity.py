"""Toxicity by a subsequence string kernel with Nyström landmarks.

Two words are alike as far as they share subsequences of letters, gaps counting
less the longer they are, so a gapped insult or one with inserted characters stays
close to the plain one. A word's kernel values with a few landmark words give its
features; a linear SVM on them is trained on sentences, each represented by its
worst word. Labels are known for documents only, so which sentences of a toxic
document are toxic is settled by training, choosing and training again. A
document's score is a logistic function of its worst word's margin.

Training reads a sample of labelled documents, at most SAMPLE_TOXIC and SAMPLE_CLEAN
of them; scoring reads all words of all texts.

Null and empty texts, and texts without letters, score as the lowest margin does.
Without labelled examples of both classes every score is zero. Rows are scored one by
one, so ties and repeated rows get equal scores; an empty table gives none.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, held_out, keep, text_or_empty

THRESHOLD = 0.3
#: Most documents of a class, and the longest text among them, that training reads.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 600, 1_200, 50_000
ORDERS, GAPS, DECAY = (2, 3, 4), 2, 0.6
LANDMARKS = 160
#: Letters of a word that are compared at once; longer words are compared in overlapping windows.
LETTERS, STRIDE = 20, 10
#: Toxic words that training also sees with an inserted letter.
DISGUISED = 200
CACHE_WORDS = 300_000
LOWEST = -3.0

SENTENCE = re.compile(r"[.!?\n]+")
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(token: str) -> str:
    """What is left of a lower-case token without digits and marks."""
    return token if token.isalpha() else NOT_LETTERS.sub("", token)


def tokens_of(text: str) -> list[str]:
    """Words of letters; single letters in a row are one word besides."""
    words = [w for w in map(letters, text.lower().split()) if w]
    out, run = [], []
    for w in [*words, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        if len(run) > 2:
            out.append("".join(run))
        run = []
        out.append(w)
    return out[:-1]


def windows(word: str) -> list[str]:
    if len(word) <= LETTERS:
        return [word]
    return [word[a : a + LETTERS] for a in range(0, len(word) - LETTERS + STRIDE, STRIDE)]


def encode(words: list[str]) -> np.ndarray:
    """Letters as numbers below 32: a-z are 1 to 26, others share 27 to 31, 0 is none. One blank column at least follows."""
    out = np.zeros((len(words), max(map(len, words), default=0) + ORDERS[-1] + GAPS), dtype=np.int32)
    for k, w in enumerate(words):
        out[k, : len(w)] = [o - 96 if 97 <= (o := ord(c)) <= 122 else 27 + o % 5 for c in w]
    return out


#: For each order, the places (from the first letter on) of subsequences with at most GAPS letters skipped.
SHAPES = {k: [(0, *c) for c in combinations(range(1, k + GAPS), k - 1)] for k in ORDERS}


def sizes(lengths: np.ndarray) -> dict[int, np.ndarray]:
    """The norm of a word's subsequence weights, by order, each taken as a different one."""
    out = {}
    for k, shapes in SHAPES.items():
        spans = np.array([s[-1] + 1 for s in shapes])
        out[k] = np.sqrt((np.maximum(lengths[:, None] - spans + 1, 0) * DECAY ** (2.0 * spans)).sum(1))
    return out


def subsequences(codes: np.ndarray) -> Iterator[tuple[int, float, np.ndarray, np.ndarray]]:
    """Order, weight, numbers (words, places), and where they are real, of all subsequences of one shape at a time."""
    width = codes.shape[1] - ORDERS[-1] - GAPS
    for k, shapes in SHAPES.items():
        for shape in shapes:
            number = np.zeros((len(codes), width), dtype=np.int32)
            for step in shape:
                number = number * 32 + codes[:, step : step + width]
            yield k, DECAY ** (shape[-1] + 1), number, codes[:, shape[-1] : shape[-1] + width] > 0


@dataclass
class Landmarks:
    """Landmark words; :meth:`features` maps words so that inner products approximate the kernel.

    The kernel of two words is the mean over orders of the inner product of their
    normed subsequence weights. The landmarks' weights are tables by subsequence, so a
    word's kernel values are sums of table rows.
    """

    words: list[str]

    def __post_init__(self) -> None:
        codes, norms = encode(self.words), sizes(np.array([len(w) for w in self.words]))
        self.index = {k: np.zeros(32**k, dtype=np.int32) for k in ORDERS}  # 0: in no landmark
        self.table = {}
        found: dict[int, dict[int, np.ndarray]] = {k: {} for k in ORDERS}
        for k, weight, numbers, real in subsequences(codes):
            for w, at in zip(*np.nonzero(real), strict=True):
                found[k].setdefault(int(numbers[w, at]), np.zeros(len(self.words)))[w] += weight / norms[k][w]
        for k in ORDERS:
            self.index[k][list(found[k])] = np.arange(1, len(found[k]) + 1)
            self.table[k] = np.vstack([np.zeros((1, len(self.words))), *(v[None] for v in found[k].values())]).astype(np.float32) / len(ORDERS)
        values, vectors = np.linalg.eigh(self.kernel(self.words).astype(np.float64))
        keep = values > 1e-4
        self.project = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)

    def _sums(self, words: list[str], tables: dict[int, np.ndarray]) -> np.ndarray:
        codes, norms = encode(words), sizes(np.array([len(w) for w in words]))
        parts = {k: np.zeros((len(words), *tables[k].shape[1:]), dtype=np.float32) for k in ORDERS}
        for k, weight, numbers, real in subsequences(codes):
            rows = self.index[k][numbers]
            rows[~real] = 0
            some = np.flatnonzero(rows.any(0))
            parts[k] += np.float32(weight) * tables[k][rows[:, some]].sum(1)
        total = 0
        for k in ORDERS:
            own = norms[k].reshape(-1, *[1] * (parts[k].ndim - 1)).astype(np.float32)
            total = total + np.divide(parts[k], own, out=np.zeros_like(parts[k]), where=own > 0)
        return total

    def _by_length(self, words: list[str], tables: dict[int, np.ndarray], at_once: int) -> np.ndarray:
        out = np.zeros((len(words), *tables[ORDERS[0]].shape[1:]), dtype=np.float32)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        for a in range(0, len(order), at_once):
            rows = order[a : a + at_once]
            out[rows] = self._sums([words[k] for k in rows], tables)
        return out

    def kernel(self, words: list[str]) -> np.ndarray:
        """Of each word with each landmark."""
        return self._by_length(words, self.table, 512)

    def features(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), self.project.shape[1]), dtype=np.float32)
        for a in range(0, len(words), 8_192):
            out[a : a + 8_192] = self.kernel(words[a : a + 8_192]) @ self.project
        return out

    def weigh(self, weights: np.ndarray) -> None:
        """Prepare :meth:`margins` for a weight of each feature."""
        self.weighed = {k: t @ (self.project @ weights.astype(np.float32)) for k, t in self.table.items()}

    def margins(self, words: list[str]) -> np.ndarray:
        return self._by_length(words, self.weighed, 4096)


@dataclass
class Model:
    landmarks: Landmarks
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def margins(self, words: list[str]) -> np.ndarray:
        """Of whole words: the largest of their windows."""
        pieces, owner = [], []
        for k, w in enumerate(words):
            if len(w) >= 2:
                some = windows(w)
                pieces += some
                owner += [k] * len(some)
        out = np.full(len(words), LOWEST)
        if pieces:
            np.maximum.at(out, owner, self.landmarks.margins(pieces) + self.bias)
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def fit_svm(x: np.ndarray, toxic_cost: np.ndarray, clean_cost: np.ndarray, ridge: float = 1.0, rounds: int = 30, at_once: int = 8_192) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by Newton steps on the rows inside the margin.

    A row counts as a toxic and as a clean example, each at its cost; it is read in blocks.
    """
    size = x.shape[1] + 1
    penalty = np.append(np.full(size - 1, ridge), 1e-6)
    w = np.zeros(size)
    for _ in range(rounds):
        gram, target = np.diag(penalty), np.zeros(size)
        for a in range(0, len(x), at_once):
            z = np.hstack([x[a : a + at_once], np.ones((len(x[a : a + at_once]), 1), dtype=x.dtype)]).astype(np.float64)
            m = z @ w
            up, down = toxic_cost[a : a + at_once] * (m < 1), clean_cost[a : a + at_once] * (m > -1)
            gram += z.T @ (z * (up + down)[:, None])
            target += z.T @ (up - down)
        new = np.linalg.solve(gram, target)
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    return w[:-1].astype(np.float32), float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's scaling: a logistic function of the margin, with his smoothed targets."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    z = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), z.T @ (p - t) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -2, 2)
    return max(float(w[0]), 1e-3), float(w[1])


def surprise(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """How far counts in toxic documents exceed what the clean ones let expect, in deviations."""
    expected = n_toxic * (clean + 1) / (n_clean + 2)
    return (toxic - expected) / np.sqrt(expected + 1)


def grams(word: str, size: int = 4) -> list[str]:
    return [word[a : a + size] for a in range(max(1, len(word) - size + 1))]


def spread(ranked: list[str], size: int, most: float) -> list[str]:
    """The first ``size`` words none of which is alike an earlier one."""
    left, chosen = list(ranked), []
    while left and len(chosen) < size:
        chosen.append(left[0])
        alike = Landmarks([left[0][:LETTERS]]).kernel([w[:LETTERS] for w in left])[:, 0]
        left = [w for w, a in zip(left[1:], alike[1:].tolist(), strict=True) if a < most]
    return chosen


def highest(words: list[str], value: np.ndarray, allowed: np.ndarray, count: int = 600) -> list[str]:
    some = np.flatnonzero(allowed & np.array([len(w) > 2 for w in words]))
    return [words[k] for k in some[np.argsort(-value[some], kind="stable")[:count]]]


def landmarks_of(*groups: list[str]) -> Landmarks:
    return Landmarks(list(dict.fromkeys(w[:LETTERS] for g in groups for w in g)))


def disguise(word: str) -> str:
    """The word with a letter put in near its middle, another for each word."""
    k = max(1, len(word) // 2)
    return word[:k] + "xqzj"[sum(map(ord, word)) % 4] + word[k:]


def train(texts: list[str], toxic: list[int], rounds: int = 4) -> Model | None:
    """A model of labelled documents; None if only one class is there."""
    y = np.array(toxic) > 0
    if not y.any() or y.all():
        return None
    at: dict[str, int] = {}  # each word once: sentences are arrays of numbers
    bags: list[list[np.ndarray]] = []
    counts, of_grams = (Counter(), Counter()), (Counter(), Counter())
    for text, bad in zip(texts, y, strict=True):
        sentences = [s for s in map(tokens_of, SENTENCE.split(text)) if s]
        own = {w for s in sentences for w in s}
        counts[int(bad)].update(at.setdefault(w, len(at)) for w in own)
        of_grams[int(bad)].update({g for w in own for g in grams(w)})
        bags.append([np.array([at[w] for w in s], dtype=np.int32) for s in sentences])
    n1, n0 = int(y.sum()), int((~y).sum())
    known = list(at)
    clean = np.array([counts[0][k] for k in range(len(known))])
    names = list(of_grams[0] | of_grams[1])
    odd = dict(zip(names, surprise(np.array([of_grams[1][g] for g in names]), np.array([of_grams[0][g] for g in names]), n1, n0).tolist(), strict=True))
    # A first guess: a word is as suspect as the oddest four letters in it.
    margin = np.array([max(odd[g] for g in grams(w)) for w in known])
    del odd, names, of_grams
    few = LANDMARKS // 4
    bad_marks, common = spread(highest(known, margin, margin > 0), few, 0.45), spread(highest(known, clean.astype(float), clean > 0), few, 0.5)
    marks = landmarks_of(bad_marks, common)
    pieces, first = [], []  # the windows that scoring sees; a word is as toxic as its worst one
    for w in known:
        first.append(len(pieces))
        pieces += windows(w)
    long_words = [(k, first[k], b) for k, b in enumerate([*first[1:], len(pieces)]) if b - first[k] > 1]
    chosen = np.array(first)
    pieces += [""] * DISGUISED  # room for disguised words
    x = marks.features(pieces)
    weights, bias = np.zeros(x.shape[1], dtype=np.float32), 0.0
    for k in range(rounds):
        if k in (1, 2):  # what was mistaken for toxic so far gets landmarks of its own
            common = common + spread([w for w in highest(known, margin, clean > 0) if w not in common], few, 0.6)
            marks = landmarks_of(bad_marks, common)
            del x
            x = marks.features(pieces)
        good, bad = [], []
        for sentences, is_bad in zip(bags, y, strict=True):
            worst = [s[np.argmax(margin[s])] for s in sentences]
            if is_bad and worst:
                top = max(margin[worst])
                bad += [w for w in worst if margin[w] >= (0.6 * top if top > 0 else top)]
            else:
                good += worst
        # Clean examples: the worst of each clean sentence, and each clean word once.
        share = lambda some: np.bincount(np.array(some, dtype=int), minlength=len(known)) / max(1, len(some))
        clean_cost = 0.5 * share(good) + 0.5 * (clean > 0) / max(1, (clean > 0).sum())
        cost = share(bad)
        # The words that count most as toxic count again with a letter put in.
        chief = np.argsort(-cost, kind="stable")[:DISGUISED]
        chief = chief[cost[chief] > 0]
        room = len(pieces) - DISGUISED
        x[room : room + len(chief)] = marks.features([disguise(known[k])[:LETTERS] for k in chief])
        up, down = np.zeros(len(pieces)), np.zeros(len(pieces))
        up[chosen], down[chosen] = cost, clean_cost
        up[room : room + len(chief)] = 0.3 * cost[chief]
        weights, bias = fit_svm(x, up * 7.0 * len(y), down * 7.0 * len(y))
        of_pieces = x[:room] @ weights + bias
        for k, a, b in long_words:
            chosen[k] = a + int(np.argmax(of_pieces[a:b]))
        margin = of_pieces[chosen]
    marks.weigh(weights)
    model = Model(marks, bias)
    worst = np.array([max((margin[s].max() for s in sentences), default=LOWEST) for sentences in bags])
    model.slope, model.shift = fit_logistic(np.maximum(worst, LOWEST), y.astype(float))
    return model


def training_sample(docs: DataFrame, labels: DataFrame) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample; which rows is settled by a hash of their ids."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"), 4, 2)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = None
    for label, size in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        some = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        picked = some if picked is None else picked.union(some)
    texts = docs.select("doc_id", text_or_empty(F.col("text")).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    # Of an id's texts the first in order is read, so reruns train alike.
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").collect()
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


class Worst:
    """The worst margin of each of many texts; words are scored once, a bounded number of them is kept."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[str, float] = {}

    def words(self, words: list[str]) -> np.ndarray:
        new = list({w for w in words if w not in self.known})
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = list(set(words))
        self.known.update(zip(new, self.model.margins(new).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.float64, count=len(words))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        split = pc.split_pattern_regex(pc.utf8_lower(texts), r"\s+")
        bounds, flat = split.offsets.to_numpy(), split.flatten()
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        forms = [letters(w) for w in coded.dictionary.to_pylist()]
        index = coded.indices.to_numpy()
        out = np.full(len(texts), LOWEST)
        margins = self.words(forms)[index]
        some = np.flatnonzero(np.diff(bounds) > 0)
        if len(some):
            out[some] = np.maximum.reduceat(margins, bounds[some])
        lengths = np.array([len(f) for f in forms])[index]
        for d, word in spelled_out(lengths, index, forms, bounds):
            out[d] = max(out[d], self.words([word])[0])
        return out


def spelled_out(lengths: np.ndarray, index: np.ndarray, forms: list[str], bounds: np.ndarray) -> Iterator[tuple[int, str]]:
    """Words whose letters stand alone, three or more in a row (tokens without letters don't count): (text, word)."""
    at = np.flatnonzero(lengths > 0)
    doc = np.searchsorted(bounds, at, side="right") - 1
    single = lengths[at] == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])) | np.concatenate([[True], doc[1:] != doc[:-1], [True]]))
    for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
        if b - a > 2 and single[a]:
            yield int(doc[a]), "".join(forms[k] for k in index[at[a:b]])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, held_out, score, predicted, margin) of every row."""
    model = train(*training_sample(docs, labels))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = keep(model.name, lambda: Worst(model)) if model else None
        for batch, _ in by_bytes(batches, "text"):
            margin = worst(batch.column("text")) if worst else np.full(len(batch), LOWEST)
            score = model.score(margin) if model else np.zeros(len(batch))
            columns = [*(batch.column(c) for c in ("doc_id", "text_hash", "held_out")), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(margin)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "held_out", "score", "predicted", "margin"])

    body = text_or_empty(F.col(text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), F.xxhash64(body).alias("text_hash"), held_out(F.col(doc_id), 4, 2).alias("held_out"))
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, held_out boolean, score double, predicted int, margin double")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with their columns as they are.

    Null texts are empty and stay, as do all rows if labels are missing for a class; rows
    are judged one by one, so equal rows go or stay together.
    """
    model = train(*training_sample(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worst = keep(model.name, lambda: Worst(model))
        for batch, _ in by_bytes(batches, "text"):
            yield batch.filter(pa.array(model.score(worst(pc.fill_null(batch.column("text"), ""))) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema) if model else docs
