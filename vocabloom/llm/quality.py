"""Quality classifier: supervised embeddings of hashed words and character n-grams, averaged over a document."""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, slices, with_columns, written

BUCKETS = 1 << 16
_KEPT_WORDS = 200_000
#: Words of more bytes are taken in blocks by numpy, and aren't kept.
_LONG, _BLOCK = 128, 1 << 16
_CRC = np.array([zlib.crc32(bytes([i ^ 255])) ^ 0xFF000000 for i in range(256)], np.uint32)


def word_features(word: bytes) -> list[int]:
    """Buckets of a word and of its n-grams of 2 to 4 bytes, with marks at both ends."""
    marked = b"<" + word + b">"
    grams = [marked[i : i + n] for n in (2, 3, 4) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(word, 7) % BUCKETS] + [zlib.crc32(g) % BUCKETS for g in grams]


def long_features(word: bytes) -> Iterator[np.ndarray]:
    """The same buckets, block by block."""
    yield np.array([zlib.crc32(word, 7) % BUCKETS])
    marked = np.frombuffer(b"<" + word + b">", np.uint8)
    for start in range(0, len(marked), _BLOCK):
        part = marked[start : start + _BLOCK + 3]
        state = np.full(len(part), 0xFFFFFFFF, np.uint32)
        for n in range(1, min(4, len(part)) + 1):
            state = state[: len(part) - n + 1]
            state = _CRC[(state ^ part[n - 1 :]) & 255] ^ (state >> 8)
            if n > 1:
                yield ((state ^ 0xFFFFFFFF) % BUCKETS)[:_BLOCK].astype(np.int64)


def repeats(words: list[bytes]) -> int:
    """How many word pairs are a word and itself."""
    return sum(map(operator.eq, words, words[1:]))


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a whole text, with their counts. Bucket BUCKETS stands for the end and is in every text; the next one stands for each repeated word."""
    totals = np.zeros(BUCKETS + 2, np.int64)
    flat, times = [], []
    words = (text or b"").split()
    for word, n in Counter(words).items():
        if len(word) > _LONG:
            for found in long_features(word):
                totals[:BUCKETS] += n * np.bincount(found, minlength=BUCKETS)
            continue
        found = word_features(word)
        flat += found
        times += [n] * len(found)
    if flat:
        totals[:BUCKETS] += np.bincount(flat, times, minlength=BUCKETS).astype(np.int64)
    totals[BUCKETS:] = 1, 10 * repeats(words)
    at = np.flatnonzero(totals)
    return at, totals[at]


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray

    def fit(self, rows: pa.ChunkedArray, labels: list[int], epochs: int, rate: float) -> None:
        """Stochastic gradient descent on the log loss; the rate falls to nothing in a straight line."""
        order, step, steps = np.random.default_rng(8), 0, epochs * len(rows)
        for _ in range(epochs):
            for i in order.permutation(len(rows)).tolist():
                at, n = np.frombuffer(rows[i].as_buffer(), "<u4").reshape(2, -1)
                share = n / n.sum()
                mean = share @ self.vectors[at]
                error = _softmax(self.output @ mean)
                error[labels[i]] -= 1
                pace = rate * (1 - step / steps)
                back = error @ self.output
                self.output -= pace * np.outer(error, mean)
                self.vectors[at] -= pace * share[:, None] * back * 30.0  # a bucket's share is small, so its own rate is larger
                step += 1


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


class Scorer:
    """Scores texts; keeps the summed vectors of at most _KEPT_WORDS words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.known: dict[bytes, int] = {}
        self.sums = np.zeros((_KEPT_WORDS, model.vectors.shape[1] + 1), np.float32)

    def sums_of(self, words: list[bytes]) -> np.ndarray:
        """For each word, the sum of its buckets' vectors and their number."""
        out = np.zeros((len(words), self.sums.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= _LONG]
        if len(short) < len(words):
            for i, word in enumerate(words):
                if len(word) > _LONG:
                    for found in long_features(word):
                        out[i, :-1] += self.model.vectors[found].sum(axis=0, dtype=float)
                        out[i, -1] += len(found)
            if short:
                out[short] = self.sums_of([words[i] for i in short])
            return out
        features = [word_features(w) for w in words]
        sizes = np.array([len(f) for f in features])
        flat = np.fromiter((x for f in features for x in f), np.int64, sizes.sum())
        return np.column_stack([np.add.reduceat(self.model.vectors[flat], np.cumsum(sizes) - sizes), sizes])

    def score(self, texts: list[bytes | None]) -> list[float]:
        lists = [(t or b"").split() for t in texts]
        counters = [Counter(words) for words in lists]
        new = list({w for c in counters for w in c if w not in self.known})
        fresh: dict[bytes, int] = {}
        extra = np.zeros((0, self.sums.shape[1]))
        if new:
            extra = np.concatenate([self.sums_of(new[i : i + 2_000]) for i in range(0, len(new), 2_000)])
            fresh = {w: i for i, w in enumerate(new)}
        out = []
        for words, each in zip(counters, lists, strict=True):
            n_repeats = 10 * repeats(each)  # a word has about ten n-grams
            total = np.append(self.model.vectors[BUCKETS] + n_repeats * self.model.vectors[BUCKETS + 1], 1.0 + n_repeats)
            if words:
                at = np.fromiter((self.known.get(w, -1) for w in words), np.int64, len(words))
                n = np.fromiter(words.values(), np.float64, len(words))
                old = at >= 0
                total = total + n[old] @ self.sums[at[old]]
                if not old.all():
                    own = np.fromiter((fresh[w] for w, k in zip(words, old, strict=True) if not k), np.int64, int((~old).sum()))
                    total = total + n[~old] @ extra[own]
            out.append(float(_softmax(self.model.output @ (total[:-1] / total[-1]))[1]))
        kept = [i for i, w in enumerate(new) if len(w) <= _LONG][: _KEPT_WORDS - len(self.known)]
        if kept:
            self.sums[len(self.known) : len(self.known) + len(kept)] = extra[kept]
            self.known |= {new[j]: len(self.known) + i for i, j in enumerate(kept)}
        return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    per_label: int = 2_500,
    dim: int = 12,
    epochs: int = 5,
    rate: float = 0.5,
    most_bytes: int = 64 << 20,
) -> Model:
    """Fit a model on a sample of about `per_label` rows of each label, chosen by a hash of the id, and fewer of each if
    their features have more than `most_bytes` (eight for each bucket of a row).

    Ids with several labels take the least; null ids or labels are left out. Without any label the scores are all 0.5.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).dropna().filter("_label in (0, 1)").groupBy("_id").agg(F.min("_label").alias("_label"))
    counts = {r._label: r["count"] for r in marked.groupBy("_label").count().collect()}
    model = Model(np.random.default_rng(5).uniform(-1 / dim, 1 / dim, (BUCKETS + 2, dim)).astype(np.float32), np.zeros((2, dim), np.float32))
    if not counts:
        return model
    share = F.create_map(*(F.lit(x) for label, n in counts.items() for x in (label, min(1.0, per_label / n))))
    unit = F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(1 << 30)) / (1 << 30) / share[F.col("_label")]
    sample = marked.withColumn("_unit", unit).filter("_unit < 1")

    def features():
        def work(batch):
            found = [document_features(None if t is None else t.encode()) for t in batch.column("_text").to_pylist()]
            return [[at.astype("<u4").tobytes() + n.astype("<u4").tobytes() for at, n in found]]

        return work

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")  # about 2 * per_label ids
    made = bounded(written(with_columns(rows, [T.StructField("_row", T.BinaryType())], features, ["_text"]), "features"), most_bytes)
    got = made.select("_label", "_id", "_row").orderBy("_id", "_row").toArrow()
    model.fit(got.column("_row"), got.column("_label").to_pylist(), epochs, rate)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with score: how likely the label is 1, from 0 to 1. Null and empty texts get the score of no words.

    Repeated rows and null ids pass through; a column of `docs` named score is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def work(batch):
            return [[s for _, texts in slices(batch.column(text_col), 2 << 20) for s in scorer.score(texts)]]

        return work

    return with_columns(docs, [T.StructField("score", T.DoubleType())], make)
