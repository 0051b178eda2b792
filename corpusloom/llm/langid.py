"""Language identification by a byte convolutional network, trained in numpy.

Texts are lower-cased, runs of anything but letters become one space, and the UTF-8 bytes are cut into
windows of fixed length, all of them. Filters of widths 2, 3 and 4 over the bytes, a maximum over each
window and a softmax give a window's languages; a text's is the softmax of its windows' mean log
probabilities, weighted by their bytes. As inputs are bytes, a filter is a table row for each of its
places, so a convolution is a sum of look-ups, and the gradient touches only each maximum's own bytes.

Training takes a bounded sample of rows: about ``DOCS_PER_LANGUAGE`` labelled ones of each language, chosen
by a hash, with all windows of their whole texts. On demand a further class, ``NOISE``, is learned from the
same windows with their letters in random order; a text for which it is the likeliest is of no learned language.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if no
row is labelled. With one label all others get it, with score 1. Rows without doc_id are neither trained
on nor held out. Repeated rows repeat their result; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table

DOCS_PER_LANGUAGE = 150
WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 16
UNKNOWN, NOISE = "und", "?"
#: Windows convolved at once.
BATCH = 256
_PAD = 256


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")


@dataclass
class ByteCnn:
    """tables[k]: for the k-th byte of a filter, (257, filters that are wider than k); wider filters come first."""

    languages: list[str]
    tables: list[np.ndarray]
    dense: np.ndarray
    bias: np.ndarray

    @staticmethod
    def blank(languages: list[str], rng: np.random.Generator) -> ByteCnn:
        wide = sorted((w for w in WIDTHS for _ in range(FILTERS)), reverse=True)
        tables = [rng.normal(0, 0.3, (257, sum(w > k for w in wide))).astype(np.float32) for k in range(max(WIDTHS))]
        for t in tables:
            t[_PAD] = 0
        return ByteCnn(languages, tables, rng.normal(0, 0.1, (len(wide), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))

    def pooled(self, x: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest activation, at least 0, of each filter in each window (rows of byte numbers), and its place."""
        n = x.shape[1] - len(self.tables) + 1
        out = self.tables[0][x[:, :n]]
        for k, t in enumerate(self.tables[1:], 1):
            out[:, :, : t.shape[1]] += t[x[:, k : k + n]]
        if where:
            at = out.argmax(1)
            return np.maximum(np.take_along_axis(out, at[:, None, :], 1)[:, 0], 0), at
        return np.maximum(out.max(1), 0), None

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate([self.pooled(x[i : i + BATCH])[0] for i in range(0, len(x), BATCH)]) @ self.dense + self.bias
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, by tables, dense and bias."""
        h, at = self.pooled(x, where=True)
        z = h @ self.dense + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ self.dense.T) * (h > 0)
        grads = []
        for k, t in enumerate(self.tables):
            g, m = np.zeros_like(t), t.shape[1]
            np.add.at(g, (np.take_along_axis(x, at[:, :m] + k, 1), np.arange(m)[None, :]), back[:, :m])
            g[_PAD] = 0
            grads.append(g)
        return [*grads, h.T @ p, p.sum(0)]

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, epochs: int = 5, rate: float = 0.004, batch: int = 64) -> ByteCnn:
        """Adam over shuffled batches."""
        params = [*self.tables, self.dense, self.bias]
        mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                for q, g, a, b in zip(params, self.gradients(x[order[i : i + batch]], y[order[i : i + batch]]), mean, square):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text's bytes, the last one padded, and their weights in bytes."""
    n = max(1, -(-len(data) // WINDOW))
    x = np.full(n * WINDOW, _PAD, np.int16)
    x[: len(data)] = np.frombuffer(data, np.uint8)
    weights = np.full(n, WINDOW, np.float32)
    weights[-1] = max(1, len(data) - (n - 1) * WINDOW)
    return x.reshape(n, WINDOW), weights


def train_model(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", seed: int = 11, noise: bool = False) -> ByteCnn | None:
    """A model of the languages in ``label_col``, and of NOISE on demand; None without labelled texts that hold a letter."""
    t = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"), F.col(text_col).alias("t"))
    counts = {r["y"]: r["n"] for r in t.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return None
    share = F.element_at(F.create_map(*(F.lit(v) for y, n in counts.items() for v in (y, min(1.0, DOCS_PER_LANGUAGE / n)))), F.col("y"))
    drawn = t.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30)).select("y", letters(F.col("t")).alias("t"))
    rows = sorted((r["t"], r["y"]) for r in drawn.collect())  # DOCS_PER_LANGUAGE rows a language, about
    languages = sorted(counts)
    rng = np.random.default_rng(seed)
    model = ByteCnn.blank(languages + [NOISE] * noise, rng)
    if len(model.languages) > 1 and rows:
        parts = [(windows(text.encode())[0], languages.index(y)) for text, y in rows]
        if noise:
            scrambled = ["".join(rng.permutation(list(text))) for text, _ in rows[:: len(languages)]]
            parts += [(windows(text.encode())[0], len(languages)) for text in scrambled]
        model.train(np.concatenate([x for x, _ in parts]), np.repeat([y for _, y in parts], [len(x) for x, _ in parts]), rng)
    return model


def predict(docs: DataFrame, model: ByteCnn | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and its score, by ``names``; texts travel as letters only, in an extra column that is dropped."""
    if model is None:
        return docs.withColumns(dict(zip(names, (F.lit(UNKNOWN), F.lit(0.0)))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def classify(texts):
        import pandas as pd

        own = shared.value
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        size = 0

        def settle() -> None:
            nonlocal held, size
            if not held:
                return
            logs = own.log_probabilities(np.concatenate([x for _, x, _ in held]))
            weights = np.concatenate([w for _, _, w in held])
            starts = np.cumsum([0, *(len(w) for _, _, w in held)])[:-1]
            mean = np.add.reduceat(logs * weights[:, None], starts) / np.add.reduceat(weights, starts)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for (i, _, _), row in zip(held, p):
                out[i] = own.languages[int(row.argmax())], min(1.0, float(row.max()))
            held, size = [], 0

        for i, text in enumerate(texts):
            if text is not None and text.strip(" "):
                x, w = windows(text.encode())
                held.append((i, x, w))
                size += len(x)
                if size >= 4 * BATCH:
                    settle()
        settle()
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    made = docs.withColumn("_guess", classify(letters(F.col(text_col))))
    return made.withColumns(dict(zip(names, (F.col("_guess.lang_pred"), F.col("_guess.score"))))).drop("_guess")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def trained_on(docs: DataFrame, noise: bool = False) -> ByteCnn | None:
    """The model of all labelled documents that aren't held out."""
    return train_model(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), noise=noise)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = trained_on(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")
