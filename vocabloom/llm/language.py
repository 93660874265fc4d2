"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, with_columns, written

BUCKETS = 1 << 15
ORDERS = 3
_MIX = 0x9E3779B97F4A7C15
_SPACE = (32 * _MIX & 0xFFFFFFFFFFFFFFFF) >> 49


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of 1 to ORDERS characters of a whole text; None without a letter. What isn't a letter counts as a space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = _letters()[points]
    if not letters.any():
        return None
    points = np.where(letters, points, 32).astype(np.uint64)
    grams, out = points, np.zeros(BUCKETS, np.int64)
    for n in range(ORDERS):
        if n:
            grams = grams[:-1] * np.uint64(0x10001) + points[n:] + np.uint64(n)
        out += np.bincount((grams * np.uint64(_MIX) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    out[_SPACE] = 0
    return out


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def row(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        return at, self.scaled(at, counts[at])

    def scaled(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.sqrt(x @ x), 1e-12)

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = None if text is None or not self.langs else ngram_counts(text)
        if counts is None:
            return "und", 0.0
        p = _softmax(self.logits(*self.row(counts)) / self.temperature)
        return self.langs[int(p.argmax())], float(p.max())


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """In how many of all texts each bucket occurs, and in the last place the number of texts."""

    def count(batches):
        totals = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py())
                if counts is not None:
                    totals[:-1] += counts > 0
                    totals[-1] += 1
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for r in texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS + 1 rows at most
        out[r.bucket] = r.n
    return out


class Rows:
    """Labelled feature rows as bytes, two for each bucket's number and four for its count; a row is taken apart when it is read."""

    def __init__(self, rows: pa.ChunkedArray, labels: list[int], model: Model) -> None:
        self.rows, self.labels, self.model = rows, labels, model

    def __len__(self) -> int:
        return len(self.labels)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        raw = self.rows[i].as_buffer()
        n = raw.size // 6
        at = np.frombuffer(raw, "<u2", n).astype(np.int64)
        return at, self.model.scaled(at, np.frombuffer(raw, "<u4", n, 2 * n))


def packed(counts: np.ndarray | None) -> bytes:
    at = np.zeros(0, int) if counts is None else np.flatnonzero(counts)
    return at.astype("<u2").tobytes() + (b"" if counts is None else counts[at].astype("<u4").tobytes())


def _ftrl(model: Model, rows: Rows, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> None:
    """Follow-the-regularised-leader (proximal) with elastic-net penalties; sets the weights and the bias."""
    k = len(model.langs)
    z, n = np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1))
    order = np.random.default_rng(4)

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) > l1, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for i in order.permutation(len(rows)).tolist():
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            p = _softmax(w @ x)
            p[rows.labels[i]] -= 1
            g = p[:, None] * x
            squares = ns + g * g
            z[:, at] = zs + g - (np.sqrt(squares) - np.sqrt(ns)) / alpha * w
            n[:, at] = squares
    whole = weights(z, n)
    model.weights, model.bias = whole[:, :-1], whole[:, -1]


def _calibrate(model: Model, rows: Rows) -> None:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    if not len(rows):
        return
    logits = np.array([model.logits(*rows[i]) for i in range(len(rows))])

    def loss(log_t: float) -> float:
        x = logits / np.exp(log_t)
        x -= x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x).sum(axis=1)) - x[np.arange(len(x)), rows.labels]).mean())

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    model.temperature = float(np.exp((low + high) / 2))


def train(
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_lang: int = 1_500,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    most_bytes: int = 48 << 20,
) -> Model:
    """Fit a model. Rows without text, letter or language are left out; an empty table gives a model without languages.

    Document frequencies are counted over all labelled rows. The regression is fitted on a sample of about `per_lang` rows
    of each language, chosen by a hash of the text, and fewer of each if their features have more than `most_bytes` (six
    bytes for each n-gram of a row); a fifth of it, chosen alike, sets the temperature instead.
    """
    rows = labelled.select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang")).dropna()
    counts = {r._lang: r["count"] for r in rows.groupBy("_lang").count().collect()}  # a row for each language
    langs = sorted(counts)
    if not langs:
        return Model([], np.zeros(BUCKETS), np.zeros((0, BUCKETS)), np.zeros(0), 1.0)
    frequencies = document_frequencies(rows.select("_text"))
    idf = np.log((1 + frequencies[-1]) / (1 + frequencies[:-1])) + 1
    shares = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, per_lang / counts[lang]))))

    def features():
        return lambda batch: [[packed(ngram_counts(text.as_py())) for text in batch.column("_text")]]

    unit = F.pmod(F.xxhash64("_text"), F.lit(1 << 30)) / (1 << 30) / shares[F.col("_lang")]
    sample = rows.withColumns({"_unit": unit, "_rest": F.pmod(F.xxhash64("_text", F.lit(1)), F.lit(5)) == 0}).filter("_unit < 1")
    made = bounded(written(with_columns(sample, [T.StructField("_row", T.BinaryType())], features, ["_text"]), "ngrams").filter(F.octet_length("_row") > 0), most_bytes)
    model = Model(langs, idf, np.zeros((len(langs), BUCKETS)), np.zeros(len(langs)), 1.0)
    got = made.select("_lang", "_rest", "_row").orderBy("_lang", "_row").toArrow()
    rest, labels = (np.array(x) for x in (got.column("_rest").to_pylist(), [langs.index(x) for x in got.column("_lang").to_pylist()]))
    learned, held = (Rows(got.column("_row").take(pa.array(at)), labels[at].tolist(), model) for at in (np.flatnonzero(~rest.astype(bool)), np.flatnonzero(rest.astype(bool))))
    _ftrl(model, learned, epochs, alpha, beta, l1, l2)
    _calibrate(model, held)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` with lang_pred (a learned language; 'und' if the text is null or has no letter) and score (calibrated; 0 for 'und').

    Repeated rows and null ids pass through; columns of `docs` named as a result column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def work(batch):
            found = [model.predict(t.as_py()) for t in batch.column(text_col)]
            return [[x[0] for x in found], [x[1] for x in found]]

        return work

    return with_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def held_out(id_col: str, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is never learned from: the CRC-32 of its id as text, modulo `folds`, is `fold`. Rows with a null id may be."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))
