"""Toxicity scores from subword-bag embeddings and a linear softmax.

Every run of characters within a word, 3 to 6 long with the word's ends marked,
is a feature; features share a hashed embedding table.  The bag of a window of
words is averaged and goes through a linear layer and a softmax, so a misspelt
word still shares most of its features with the word it stands for.  A text is
as toxic as its most toxic window: labels belong to texts, and a few words in a
long text must count.  Embeddings and softmax are learnt jointly (numpy, Adam)
on a bounded sample of labelled texts: first every word with its text's label,
then each text's most toxic window.

Scoring reads whole texts in slices, all in numpy; the broadcast model has a
fixed size (one float per feature bucket).

Defined cases: null and empty texts have no features and get the score of the
bias alone; repeated rows get equal scores; unlabelled texts are scored alike;
without both labels in the sample every score is the share of label 1 (0
without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrank.llm.common import documents, map_slices, text_bytes

BITS = 17
DIM = 4
GRAMS = (3, 4, 5)
WINDOW = 2
THRESHOLD = 0.3
#: Labelled texts that the classifier is fitted on at most, by label; longer texts than FIT_CHARS are not drawn.
FIT_ROWS = {1: 1_500, 0: 1_500}
FIT_CHARS = 8_000
SEED = 13
#: Bytes of text scored in one numpy pass, small enough for a core's cache.
SLICE = 256 << 10


def _is_letter() -> np.ndarray:
    """Bytes that belong to words: ASCII letters, digits and all bytes of other scripts."""
    table = np.zeros(256, bool)
    for a, b in (("a", "z"), ("A", "Z"), ("0", "9")):
        table[ord(a):ord(b) + 1] = True
    table[128:] = True
    return table


_LETTER = _is_letter()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _marked(flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts between two marks each, where each word starts (and the end), and each text's first word."""
    if not len(flat):
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(len(ends), np.int64)
    inside = _LETTER[flat]
    cut = np.zeros(len(flat) + 1, bool)
    cut[ends] = True
    first = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate([[False], inside[:-1]])))
    last = np.flatnonzero(inside & (cut[1:] | ~np.concatenate([inside[1:], [False]])))
    at = np.concatenate([[0], np.cumsum(last - first + 3)])
    marked = np.ones(at[-1], np.uint32)
    bare = np.ones(at[-1], bool)
    bare[at[:-1]] = False
    bare[at[1:] - 1] = False
    marked[bare] = _LOWER[flat[inside]]
    return marked, at, np.searchsorted(first, ends)


def _grams(marked: np.ndarray, at: np.ndarray):
    """For each gram length: the bucket at each place, and whether the gram ends within its word."""
    left = (np.repeat(at[1:], np.diff(at)) - np.arange(len(marked))).astype(np.int32)
    h = np.full(len(marked), 2166136261, np.uint32)
    for n in range(1, max(GRAMS) + 1):
        h = h[:len(marked) - n + 1]
        h = (h ^ marked[n - 1:]) * np.uint32(16777619)
        if n in GRAMS:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519)
            yield n, x >> np.uint32(32 - BITS), left[:len(h)] >= n


def _features(marked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature buckets of all words, in word order, and how many each word has."""
    places, buckets = [], []
    for _, bucket, whole in _grams(marked, at):
        place = np.flatnonzero(whole)
        places.append(place)
        buckets.append(bucket[place])
    order = np.argsort(np.concatenate(places), kind="stable")
    return np.concatenate(buckets)[order].astype(np.int64), _sizes(at)


def _sizes(at: np.ndarray) -> np.ndarray:
    size = np.diff(at)
    return sum(np.maximum(0, size - n + 1) for n in GRAMS)


@dataclass
class Model:
    """``feature``: what each bucket adds to the margin of label 1 over label 0, from embeddings and softmax weights."""
    feature: np.ndarray
    bias: float
    window: int = WINDOW

    def margins(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The largest window margin of each text; the bias for texts without words."""
        marked, at, first_word = _marked(flat, ends)
        out = np.full(len(ends) - 1, np.float64(self.bias))
        if len(at) < 2:
            return out
        value = np.zeros(len(marked))
        for _, bucket, whole in _grams(marked, at):
            value[:len(bucket)] += self.feature[bucket] * whole
        best = _windows(np.add.reduceat(value, at[:-1]), _sizes(at), first_word, self.window)
        texts = np.flatnonzero(np.diff(first_word))
        out[texts] = np.maximum.reduceat(best, first_word[:-1][texts]) + self.bias
        return out

    def scores(self, flat, ends):
        return 1 / (1 + np.exp(-np.clip(self.margins(flat, ends), -40, 40)))


def _windows(total, sizes, first_word, width):
    """The mean over the features of the ``width`` words from each word on, cut at its text's end."""
    a, n = total.copy(), sizes.astype(np.float64)
    left = np.repeat(first_word[1:], np.diff(first_word)) - np.arange(len(total))
    for k in range(1, width):
        more = left[:-k] > k
        a[:-k] += total[k:] * more
        n[:-k] += sizes[k:] * more
    return a / n


class _Adam:
    def __init__(self, shape, rate):
        self.m, self.v, self.t, self.rate = np.zeros(shape), np.zeros(shape), 0, rate

    def step(self, value, grad):
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        value -= self.rate * (self.m / (1 - 0.9 ** self.t)) / (np.sqrt(self.v / (1 - 0.999 ** self.t)) + 1e-8)


def _distinct_words(marked, at, step: int = 100_000):
    """The words' numbers and, for each distinct word, one place where it stands (words are equal if two hashes are)."""
    keys = []
    for w in range(0, len(at) - 1, step):  # in runs of words, for the driver's memory
        ends = at[w:w + step + 1]
        size = np.diff(ends)
        place = np.arange(ends[-1] - ends[0]) - np.repeat(ends[:-1] - ends[0], size)
        with np.errstate(over="ignore"):
            x = (marked[ends[0]:ends[-1]] + np.uint64(256) * place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append(np.add.reduceat(x ^ (x >> np.uint64(29)), ends[:-1] - ends[0]))
    _, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return first, number


def fit(texts: list[str], labels: list[int], window: int = WINDOW, warm: int = 15, epochs: int = 60,
        rate: float = 0.1, decay: float = 1e-3) -> Model:
    """Learn embeddings and softmax jointly; the arithmetic and its order are fixed, so equal input gives an equal model."""
    y = np.asarray(labels, np.float64)
    marked, at, first_word = _marked(*text_bytes(pa.array(texts, pa.string())))
    if not len(y) or y.min() == y.max() or len(at) < 2:
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-9), 1 - 1e-9)
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))), window)
    first, number = _distinct_words(marked, at)
    # Features of the distinct words alone: the others share them.
    length = np.diff(at)[first]
    v_end = np.concatenate([[0], np.cumsum(length)])
    feats, v_size = _features(marked[np.repeat(at[first] - v_end[:-1], length) + np.arange(v_end[-1])], v_end)
    v_at = np.concatenate([[0], np.cumsum(v_size)])
    sizes = v_size[number]
    used, own = np.unique(feats, return_inverse=True)
    del marked, at, feats
    n_words = np.diff(first_word)
    text_of = np.repeat(np.arange(len(y)), n_words)
    texts_in = np.flatnonzero(n_words)
    rng = np.random.default_rng(SEED)
    E, W, b = rng.normal(0, 0.1, (len(used), DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    opt = [_Adam(x.shape, rate) for x in (E, W, b)]
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))

    def descend(rows, of, size, target):
        """A step on bags: ``rows`` are features, ``of`` their bags, ``target`` the bags' weight by label."""
        bag = np.stack([np.bincount(of, E[rows, d], len(size)) for d in range(DIM)], 1) / size[:, None]
        z = bag @ W + b
        e = np.exp(z - z.max(1, keepdims=True))
        dz = e / e.sum(1, keepdims=True) * target.sum(1, keepdims=True) - target
        back = dz @ W.T / size[:, None]
        dE = np.stack([np.bincount(rows, back[of, d], len(used)) for d in range(DIM)], 1) + 1e-3 * decay * E
        for o, value, g in zip(opt, (E, W, b), (dE, bag.T @ dz + decay * W, dz.sum(0))):
            o.step(value, g)

    # First every distinct word, with the weight of the texts of either label that it stands in.
    share = (weight / np.maximum(1, n_words))[text_of]
    mass = np.stack([np.bincount(number, share * (y[text_of] == k), len(first)) for k in (0, 1)], 1)
    v_of = np.repeat(np.arange(len(first)), v_size)
    for _ in range(warm):
        descend(own, v_of, v_size, mass)
    # Then each text's most toxic window.
    word_end = np.repeat(first_word[1:], n_words)
    for _ in range(epochs):
        f = E @ (W[:, 1] - W[:, 0])
        score = _windows(np.add.reduceat(f[own], v_at[:-1])[number], sizes, first_word, window)
        top = np.repeat(np.maximum.reduceat(score, first_word[:-1][texts_in]), n_words[texts_in])
        hit = np.flatnonzero(score == top)
        hit = hit[np.unique(text_of[hit], return_index=True)[1]]
        take = hit[:, None] + np.arange(window)
        ok = take < word_end[hit][:, None]
        word = number[take[ok]]
        n = v_size[word]
        rows = own[np.repeat(v_at[word] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        of = np.repeat(np.repeat(np.arange(len(hit)), ok.sum(1)), n)
        label = y[text_of[hit]]
        descend(rows, of, np.bincount(of, minlength=len(hit)).astype(float),
                weight[text_of[hit]][:, None] * np.stack([label == 0, label == 1], 1))
    feature = np.zeros(1 << BITS, np.float32)
    feature[used] = E @ (W[:, 1] - W[:, 0])
    return Model(feature, float(b[1] - b[0]), window)


def held_out(doc_id):
    """Rows that the classifier never learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, window: int = WINDOW, fit_rows: dict[int, int] | None = None,
          fit_chars: int = FIT_CHARS) -> Model:
    """Fit on labelled rows that are not held out, of texts no longer than ``fit_chars``: the first ``fit_rows``
    of each label by a hash of doc_id.  The driver gets these whole texts and no more.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = docs.select("doc_id", "text").where(F.length("text") <= fit_chars)
    sizes = known.join(rows.groupBy("doc_id").agg(F.lit(1)), "doc_id", "left_semi")
    picked = None
    for label, n in sorted((fit_rows or FIT_ROWS).items()):
        some = sizes.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        picked = some if picked is None else picked.unionAll(some)
    picked = [(r["doc_id"], r["toxic"]) for r in picked.collect()]
    if not picked:
        return fit([], [])
    chosen = docs.sparkSession.createDataFrame(picked, "doc_id bigint, toxic int")
    got = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    got = sorted(got.collect(), key=lambda r: r["doc_id"])
    return fit([r["text"] for r in got], [r["toxic"] for r in got], window)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``score`` of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = shared.value.scores(*text_bytes(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    return map_slices(docs.select("doc_id", "text"), run, "doc_id bigint, score double", limit=SLICE)


def toxicity_filter(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(shared.value.scores(*text_bytes(batch.column("text"))) < threshold))

    return map_slices(docs, run, docs.schema, limit=SLICE)


def op5(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
