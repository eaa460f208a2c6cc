"""Log-bilinear language model, trained by noise-contrastive estimation in numpy.

Tokens are words by white space and one end a text. The model predicts a token's
class from the two before it: a class is one of the most frequent words, the end, or
a bin of rarer words with like endings. Each place before the token has a matrix that
turns a class's context vector; their sum times a class's vector, plus the class's
bias, is the class's energy. Energies are sums of one term a place, so one product of
two matrices gives the normaliser of all pairs of classes, and log-probabilities are
normalised exactly. Within a bin a word has its smoothed share of the bin's counts,
unseen words together half a count, so a text's probabilities are proper.

All counts, of words and of pairs of classes, cover all training texts. Training has
two steps. The first place's weights are fitted to the pairs' counts, with the noise's
expectation instead of samples. Then each task goes on from there over all tokens of
its texts, with both places and sampled noise, and the tasks' weights are averaged by
their tokens, block by block on the executors. The number of frequent words that are
classes grows with the root of the number of words. Other frequent words are looked up
in a table of bounded size; the rest of each text are joined to the word counts by
Spark. Words are told apart by 64-bit hashes.

Null and empty texts are their end token alone; a null id is never held out. Rows are
scored one by one, so ties and repeated rows score equally. Without training texts all
counts are zero; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import LOWER, by_bytes, held_out, materialize, settled, text_or_empty
from quern.llm.simhash import word_spans, xxh64_many

#: Fewest and most words that are classes of their own, and bins of the others.
SHORTLIST, BINS = (256, 1_024), 64
PLACES = 2
#: Words whose counts are sent to the executors; rarer ones are joined.
FREQUENT = 1_000_000
DIMENSIONS, NOISE, STEPS, RATE = 32, 10.0, 200, 0.05
#: Of the second step: tokens and noise classes of a batch, the rate, and blocks and groups in which weights are averaged.
BATCH, SAMPLES, SECOND_RATE, BLOCKS, GROUPS = 2_048, 64, 0.02, 64, 64
TEXT_BYTES = 4 << 20


@dataclass
class Tokens:
    """The words of some texts: hashes and bins, and where each text's begin."""

    hashes: np.ndarray
    bins: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Tokens:
        data, starts, ends, bounds = word_spans([t.encode().translate(LOWER) for t in texts])
        hashes = xxh64_many(data, starts, ends - starts).view(np.int64)
        last = data[ends - 1].astype(np.int32) if len(ends) else np.zeros(0, dtype=np.int32)
        before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0) if len(ends) else last
        return cls(hashes, (last * 31 + before) % BINS, bounds)


@dataclass
class Classes:
    """Classes 0.. are shortlisted words, then the bins, then the end, which also stands before a text."""

    shortlist: np.ndarray  # hashes, sorted

    @property
    def size(self) -> int:
        return len(self.shortlist) + BINS + 1

    def of(self, hashes: np.ndarray, bins: np.ndarray) -> np.ndarray:
        if not len(self.shortlist):
            return bins
        at = np.minimum(np.searchsorted(self.shortlist, hashes), len(self.shortlist) - 1)
        return np.where(self.shortlist[at] == hashes, at, len(self.shortlist) + bins)

    def with_ends(self, tokens: Tokens) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Each token's class, ends included; the classes one and two before each; where each text begins."""
        n = np.diff(tokens.bounds)
        doc = np.repeat(np.arange(len(n)), n)
        end, begins = self.size - 1, tokens.bounds[:-1] + np.arange(len(n))
        out = np.full(len(doc) + len(n), end)
        out[np.arange(len(doc)) + doc] = self.of(tokens.hashes, tokens.bins)
        before = [np.concatenate([[end], out[:-1]])[: len(out)]]
        for _ in range(PLACES - 1):
            further = np.concatenate([[end], before[-1][:-1]])[: len(out)]
            further[begins] = end
            before.append(further)
        return out, before, begins


def count_words(texts: DataFrame) -> DataFrame:
    """(hash, bin, c) over all texts; the row with bin -1 counts the texts themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, n = [], 0, 0
        table = lambda h, b, c: pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(b, pa.int32()), pa.array(c, pa.int64())], ["hash", "bin", "c"])

        def merged() -> pa.RecordBatch:
            hashes, bins, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            h, first, where = np.unique(hashes, return_index=True, return_inverse=True)
            return table(h, bins[first], np.bincount(where, weights=counts).astype(np.int64))

        for _, some in by_bytes(batches, "text", TEXT_BYTES):
            tokens = Tokens.of(some)
            n += len(some)
            h, first, c = np.unique(tokens.hashes, return_index=True, return_counts=True)
            parts.append((h, tokens.bins[first], c))
            held += len(h)
            if held > 4_000_000:
                yield merged()
                parts, held = [], 0
        if held:
            yield merged()
        if n:
            yield table([0], [-1], [n])

    return texts.mapInArrow(run, "hash long, bin int, c long").groupBy("hash", "bin").agg(F.sum("c").alias("c"))


def count_pairs(texts: DataFrame, classes: Classes) -> np.ndarray:
    """How often each class follows each: (before, class), at most the square of the classes' number."""
    size = classes.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for _, some in by_bytes(batches, "text", TEXT_BYTES):
            now, before, _ = classes.with_ends(Tokens.of(some))
            total += np.bincount(before[0] * size + now, minlength=size * size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    out = np.zeros(size * size, dtype=np.int64)
    rows = texts.mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[rows.column("pair").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(size, size)


@dataclass
class Model:
    """Context vectors, a matrix for each place before, class vectors and biases."""

    words: np.ndarray
    links: list[np.ndarray]
    outputs: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.words, *self.links, self.outputs, self.bias)]).astype(np.float32)

    @classmethod
    def of_flat(cls, x: np.ndarray, size: int) -> Model:
        shapes = [(size, DIMENSIONS), *[(DIMENSIONS, DIMENSIONS)] * PLACES, (size, DIMENSIONS), (size,)]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        words, *links, outputs, bias = (p.reshape(s).copy() for p, s in zip(np.split(x, ends[:-1]), shapes, strict=True))
        return cls(words, links, outputs, bias)

    def tables(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Per place the energies (class before, class), and the normaliser (first before, second before); in log10."""
        terms = [(self.words.astype(np.float64) @ link) @ self.outputs.T.astype(np.float64) for link in self.links]
        terms[0] = terms[0] + self.bias
        tops = [t.max(1, keepdims=True) for t in terms]
        first, second = (np.exp(t - top) for t, top in zip(terms, tops, strict=True))
        total = np.log(first @ second.T) + tops[0] + tops[1].T
        return [(t / np.log(10)).astype(np.float32) for t in terms], (total / np.log(10)).astype(np.float32)


def noise_of(counts: np.ndarray) -> np.ndarray:
    return (counts + 0.5) / (counts.sum() + 0.5 * len(counts))


def train(pairs: np.ndarray, steps: int = STEPS, seed: int = 0) -> Model:
    """A model of the pairs (before, class); further places begin as a weak echo of the first.

    Noise-contrastive estimation with NOISE unigram samples a pair; as all pairs are
    at hand, the noise's expectation takes the samples' place.
    """
    size = len(pairs)
    rng = np.random.default_rng(seed)
    n = pairs.astype(np.float64)
    total = max(1.0, n.sum())
    noise = noise_of(n.sum(0))
    context = n.sum(1)
    data, false = n / total, NOISE * np.outer(context, noise) / total
    log_noise = np.log(NOISE * noise)
    weights = [rng.normal(0, 0.1, (size, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, DIMENSIONS)), rng.normal(0, 0.1, (size, DIMENSIONS)), np.log(noise)]
    first, second = ([np.zeros_like(w) for w in weights] for _ in range(2))
    for step in range(1, (steps if n.sum() else 0) + 1):
        words, link, outputs, bias = weights
        predicted = words @ link
        energy = predicted @ outputs.T + bias
        p = 1 / (1 + np.exp(-np.clip(energy - log_noise, -40, 40)))
        slope = p * (data + false) - data  # of the loss, by energy
        back = slope @ outputs
        grads = [back @ link.T, words.T @ back, slope.T @ predicted, slope.sum(0)]
        rate = RATE * (1 - step / (steps + 1)) ** 0.5
        for k, g in enumerate(grads):
            g = g * size
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    words, link, outputs, bias = weights
    return Model(words, [link * 0.1**k for k in range(PLACES)], outputs, bias)


def summed(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places, and the sum of values at each."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
    return places[first], np.add.reduceat(values[order], first, axis=0)


class Descent:
    """Steps of noise-contrastive estimation over batches of tokens, by Adagrad; noise classes are drawn once a batch."""

    def __init__(self, model: Model, noise: np.ndarray, seed: int) -> None:
        self.model, self.rng, self.cumulated = model, np.random.default_rng(seed), np.cumsum(noise)
        self.log_noise = np.log(SAMPLES * noise).astype(np.float32)
        size = len(noise)
        self.words, self.outputs, self.bias, self.links = np.ones(size, np.float32), np.ones(size, np.float32), np.ones(size, np.float32), [100.0] * PLACES

    def learn(self, now: np.ndarray, before: list[np.ndarray]) -> None:
        starts = range(0, len(now), BATCH)
        for k in self.rng.permutation(len(starts)).tolist():
            part = slice(starts[k], starts[k] + BATCH)
            self.step(now[part], [b[part] for b in before])

    def step(self, now: np.ndarray, before: list[np.ndarray]) -> None:
        m = self.model
        predicted = sum(m.words[b] @ link for b, link in zip(before, m.links, strict=True))
        drawn = np.minimum(np.searchsorted(self.cumulated, self.rng.random(SAMPLES)), len(self.cumulated) - 1)
        real, false = m.outputs[now], m.outputs[drawn]
        up = 1 / (1 + np.exp(np.clip((predicted * real).sum(1) + m.bias[now] - self.log_noise[now], -30, 30)))
        down = -1 / (1 + np.exp(-np.clip(predicted @ false.T + m.bias[drawn] - self.log_noise[drawn], -30, 30)))
        back = up[:, None] * real + down @ false
        both = np.concatenate([now, drawn])
        at, outputs = summed(both, np.concatenate([up[:, None] * predicted, down.T @ predicted]))
        _, bias = summed(both, np.concatenate([up, down.sum(0)]))
        for k, b in enumerate(before):
            where, words = summed(b, back @ m.links[k].T)
            link = m.words[b].T @ back
            self.words[where] += (words * words).mean(1)
            self.links[k] += float((link * link).mean())
            m.words[where] += SECOND_RATE * words / np.sqrt(self.words[where])[:, None]
            m.links[k] += 0.3 * SECOND_RATE * link / self.links[k] ** 0.5
        self.outputs[at] += (outputs * outputs).mean(1)
        self.bias[at] += bias * bias
        m.outputs[at] += SECOND_RATE * outputs / np.sqrt(self.outputs[at])[:, None]
        m.bias[at] += SECOND_RATE * bias / np.sqrt(self.bias[at])


def refine(texts: DataFrame, classes: Classes, model: Model, noise: np.ndarray) -> Model:
    """The model after each task learnt from all its tokens; weights are averaged by the tasks' tokens."""
    start = texts.sparkSession.sparkContext.broadcast(model.flat())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        descent, n = Descent(Model.of_flat(start.value, classes.size), noise, part), 0
        for _, some in by_bytes(batches, "text", TEXT_BYTES):
            now, before, _ = classes.with_ends(Tokens.of(some))
            descent.learn(now, before)
            n += len(now)
        if n:
            blocks = np.array_split(descent.model.flat().astype(np.float64) * n, BLOCKS)
            columns = [pa.array(np.arange(BLOCKS, dtype=np.int32)), pa.array(np.full(BLOCKS, part % GROUPS, dtype=np.int32)), pa.array(np.full(BLOCKS, n)), pa.array([b.tobytes() for b in blocks], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "part", "n", "weights"])

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        weights = np.sum([np.frombuffer(w) for w in rows["weights"]], axis=0)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "part": [0], "n": [rows["n"].sum()], "weights": [weights.tobytes()]})

    schema = "block int, part int, n long, weights binary"
    learnt = texts.mapInArrow(run, schema).groupBy("block", "part").applyInPandas(total, schema).groupBy("block").applyInPandas(total, schema).toArrow().to_pylist()
    if not learnt:
        return model
    return Model.of_flat(np.concatenate([np.frombuffer(r["weights"]) / r["n"] for r in sorted(learnt, key=lambda r: r["block"])]), classes.size)


def shortlist_size(types: int) -> int:
    """The root of the number of words, as a power of two within bounds."""
    least, most = SHORTLIST
    return min(most, max(least, 1 << int(np.log2(max(1, types)) / 2)))


def columns_of(words: DataFrame) -> list[np.ndarray]:
    """Words, of a bounded number, on the driver: hashes, bins and counts."""
    rows = words.select("hash", "bin", "c").toArrow()
    return [rows.column(c).to_numpy() for c in ("hash", "bin", "c")]


def least_count(words: DataFrame, most: int) -> int:
    """The least power of two that at most ``most`` words reach in count; a row per power is gathered."""
    power = F.floor(F.log2("c")).cast("int").alias("power")
    total = 0
    for r in sorted(words.groupBy(power).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > most:
            return 2 ** (r["power"] + 1)
    return 1


@settled("lm")
def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: its tokens, the unigram base score and the model's score, in log10."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(F.col(text)).alias("text"), held_out(F.col(doc_id), 5, 1).alias("held_out"))
    training = rows.where(~F.col("held_out")).select("text")
    counts = materialize(count_words(training), "lm-counts")
    words = counts.where("bin >= 0")
    spark = docs.sparkSession

    texts = int(counts.where("bin < 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0])
    sums = words.groupBy("bin").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("c")).toArrow().to_pydict()
    types, total = sum(sums["v"]) + (texts > 0), sum(sums["c"]) + texts
    best_hash, best_bin, best_count = columns_of(words.orderBy(F.desc("c"), "hash").limit(shortlist_size(sum(sums["v"]))))
    classes = Classes(np.sort(best_hash))
    in_bin, types_in = np.zeros(BINS), np.zeros(BINS)
    in_bin[sums["bin"]], types_in[sums["bin"]] = sums["c"], sums["v"]
    np.subtract.at(in_bin, best_bin, best_count)
    np.subtract.at(types_in, best_bin, 1)
    bin_log = np.log10(in_bin + 0.5 * (types_in + 1))
    pairs = count_pairs(training, classes)
    model = refine(training, classes, train(pairs), noise_of(pairs.sum(0).astype(np.float64)))
    del pairs

    t_hash, _, t_count = columns_of(words.where(F.col("c") >= least_count(words, FREQUENT)))
    order = np.argsort(t_hash)
    table = spark.sparkContext.broadcast((t_hash[order], t_count[order], *model.tables()))
    base_log = float(np.log10(total + 0.5 * (types + 1)))
    end_log, end_known = float(np.log10(texts + 0.5)), int(texts > 0)
    short = len(classes.shortlist)
    fields = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, rare array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, (near, far), normaliser = table.value
        row = TaskContext.get().partitionId() << 40
        for batch, some in by_bytes(batches, "text", TEXT_BYTES):
            tokens = Tokens.of(some)
            now, before, begins = classes.with_ends(tokens)
            n = np.diff(tokens.bounds)
            h, where = np.unique(tokens.hashes, return_inverse=True)
            at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
            found = hashes[at] == h if len(hashes) else np.zeros(len(h), dtype=bool)
            c = np.where(found, counts[at], 0) if len(hashes) else np.zeros(len(h), dtype=np.int64)
            looked = found[where]
            logs = np.where(looked, np.log10(c + 0.5)[where], 0.0)  # the rare words' come later
            own_class = classes.of(tokens.hashes, tokens.bins)
            inside = np.where(own_class < short, 0.0, logs - bin_log[tokens.bins])
            word_at = np.arange(len(tokens.hashes)) + np.repeat(np.arange(len(n)), n)
            base, known = np.full(len(now), end_log), np.full(len(now), end_known)
            score = near[before[0], now].astype(np.float64) + far[before[1], now] - normaliser[before[0], before[1]]
            base[word_at], known[word_at] = logs, looked
            score[word_at] += inside
            rare = np.split(tokens.hashes[~looked], np.cumsum([(~looked[a:b]).sum() for a, b in zip(tokens.bounds, tokens.bounds[1:], strict=False)])[:-1])
            columns = [
                np.arange(row, row + len(n)), batch.column("doc_id"), batch.column("held_out"), n + 1, np.add.reduceat(known, begins), np.full(len(n), total),
                np.add.reduceat(base, begins) - (n + 1) * base_log, np.add.reduceat(score, begins), pa.array(rare, pa.list_(pa.int64())),
            ]
            row += len(n)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [f.split(" ")[0] for f in fields.split(", ")])

    partly = materialize(rows.mapInArrow(run, fields), "lm-partly")
    rare = partly.select("row", F.explode("rare").alias("hash")).groupBy("row", "hash").agg(F.count(F.lit(1)).alias("m"))
    rare = rare.join(words.select("hash", "c"), "hash", "left")
    seen = F.col("c").isNotNull()
    more = rare.groupBy("row").agg(
        F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log"), F.sum(F.when(seen, F.col("m")).otherwise(0)).alias("known")
    )
    both = partly.drop("rare").join(more, "row", "left")
    add = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return both.select("doc_id", "held_out", "n_tokens", add("n_known", "known"), "train_tokens", add("base_score", "log"), add("score", "log"))
