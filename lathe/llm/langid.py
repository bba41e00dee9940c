"""Language identification by a byte convolutional network.

A text is cut into fixed-length windows of its UTF-8 bytes. A window's bytes, each
of 256 values, pass convolution filters of widths 2, 3 and 4, whose largest response
over the window is kept (max pooling), a ReLU and a softmax layer. As a filter
over one-hot bytes is a sum of table entries, convolution is a few table
look-ups per byte; in training, max pooling leaves one position per filter to
update. Trained in numpy on a bounded sample of labelled windows; applied to
all windows of every text in batches, whose log-probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.common import as_bytes, checkpoint

WINDOW = 128
WIDTHS, FILTERS = (2, 3, 4), 12
CLASSES = 256
#: Windows put through the network at once.
BATCH = 4096
#: Bounds of the training sample: documents per language, windows per document, documents in all.
DOCS_PER_LANG, WINDOWS_PER_DOC, SAMPLE_DOCS = 600, 3, 120_000


class Model(NamedTuple):
    langs: list[str]
    conv: list[np.ndarray]  # per width: (width, CLASSES, FILTERS)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS, langs)
    out_bias: np.ndarray


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes of the whole text; the last window is padded with zeros. Runs of blanks are one blank."""
    data = np.frombuffer(b" ".join(text.split()), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, WINDOW)


def respond(model_conv: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest response of each filter in each window, and its position; for training."""
    tops, places = [], []
    for w, width in zip(model_conv, WIDTHS):
        span = WINDOW - width + 1
        r = w[0][x[:, :span]]
        for j in range(1, width):
            r += w[j][x[:, j : j + span]]
        tops.append(r.max(axis=1))
        places.append(r.argmax(axis=1))
    return np.concatenate(tops, axis=1), np.concatenate(places, axis=1)


def pooled(conv: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """What ``respond`` gives, position by position for many windows at once, so that only the running maxima are kept."""
    at = np.ascontiguousarray(x.T)
    pair = at[:-1].astype(np.int32) * CLASSES + at[1:]
    out = []
    for w, width in zip(conv, WIDTHS):
        head = (w[0][:, None, :] + w[1][None, :, :]).reshape(CLASSES * CLASSES, -1)
        rest, index = (None, None) if width == 2 else (w[2], at[2:]) if width == 3 else ((w[2][:, None, :] + w[3][None, :, :]).reshape(CLASSES * CLASSES, -1), pair[2:])
        best = None
        for t in range(WINDOW - width + 1):
            r = head.take(pair[t], axis=0)
            if rest is not None:
                r += rest.take(index[t], axis=0)
            best = r if best is None else np.maximum(best, r, out=best)
        out.append(best)
    return np.concatenate(out, axis=1)


def log_probs(model: Model, x: np.ndarray) -> np.ndarray:
    h = np.maximum(pooled(model.conv, x) + model.bias, 0)
    z = h @ model.out + model.out_bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = 12, rate: float = 0.01, seed: int = 1) -> Model:
    """Cross-entropy by Adam on mini-batches of 64 windows."""
    rng = np.random.default_rng(seed)
    n_filters = len(WIDTHS) * FILTERS
    conv = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
    params = [*conv, np.zeros(n_filters, np.float32), rng.normal(0, 0.3, (n_filters, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            b = order[lo : lo + 64]
            xb, yb = x[b], y[b]
            top, at = respond(params[: len(WIDTHS)], xb)
            pre = top + params[-3]
            h = np.maximum(pre, 0)
            z = h @ params[-2] + params[-1]
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), yb] -= 1
            p /= len(b)
            dh = (p @ params[-2].T) * (pre > 0)
            grads = []
            for k, width in enumerate(WIDTHS):
                g = np.zeros_like(params[k])
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                f = np.broadcast_to(np.arange(FILTERS), (len(b), FILTERS))
                for j in range(width):
                    np.add.at(g[j], (xb[np.arange(len(b))[:, None], at[:, cols] + j], f), dh[:, cols])
                grads.append(g)
            grads += [dh.sum(axis=0), h.T @ p, p.sum(axis=0)]
            t += 1
            for i, g in enumerate(grads):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                params[i] -= (rate * 0.5 ** (epoch / 4) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(langs, params[: len(WIDTHS)], params[-3], params[-2], params[-1])


def held_out() -> Column:
    """True for documents of which nothing is learnt: crc32 of the id's digits mod 4 is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """Distinct (lang, window binary): about ``docs_per_lang`` documents of each language, drawn by a hash of id and text, and three windows of each.

    Labels are counted first; then a row is drawn if its hash lies below its
    language's rate, so texts are neither shuffled nor ranked. With very many
    languages each gets fewer documents, for about ``sample_docs`` in all; more
    languages than that are an error.
    """
    usable = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = checkpoint(usable.groupBy("lang").agg(F.count("*").alias("_n")))
    langs = counts.count()
    if langs > sample_docs:
        raise ValueError(f"{langs} languages for a sample of {sample_docs} documents")
    docs_per_lang = min(docs_per_lang, sample_docs / max(1, langs))
    draw = F.xxhash64(F.lit(11), F.coalesce("doc_id", F.lit(-1)), "text")
    share = F.pmod(draw, F.lit(1 << 30)) / F.lit(1 << 30)

    def cut(batches):
        for batch in batches:
            langs, out = [], []
            for lang, text, draw in zip(batch.column("lang").to_pylist(), as_bytes(batch.column("text")), batch.column("_draw").to_pylist()):
                if any(map(str.isalpha, text.decode("utf-8"))):
                    w = windows(text)
                    for i in sorted(np.random.default_rng(abs(draw)).permutation(len(w))[:WINDOWS_PER_DOC]):
                        langs.append(lang)
                        out.append(w[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], ["lang", "window"])

    drawn = usable.withColumn("_draw", draw).join(F.broadcast(counts), "lang").where(share < docs_per_lang / F.col("_n"))
    return drawn.select("lang", "text", "_draw").mapInArrow(cut, "lang string, window binary").distinct()


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Model | None:
    """A model of the languages labelled in ``docs``; None if nothing is labelled. Only the bounded sample reaches the driver."""
    rows = sorted((r.lang, bytes(r.window)) for r in training_sample(docs, docs_per_lang).collect())
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    x = np.stack([np.frombuffer(w, np.uint8) for _, w in rows])
    y = np.array([langs.index(lang) for lang, _ in rows])
    return train(x, y, langs)


PREDICTION = "struct<lang_pred:string,score:double>"


def predictor(model: Model | None, spark) -> Column:
    """Arrow UDF text -> PREDICTION; the model (some tens of KB) is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(PREDICTION)
    def predict(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for array in arrays:
            langs, scores = [], []
            texts = as_bytes(array)
            blocks, owners, held = [], [], 0
            sums = np.zeros((len(texts), len(model.langs) if model else 0))
            counts = np.zeros(len(texts))

            def flush():
                if blocks:
                    x, own = np.concatenate(blocks), np.concatenate(owners)
                    for lo in range(0, len(x), BATCH):
                        np.add.at(sums, own[lo : lo + BATCH], log_probs(model, x[lo : lo + BATCH]))
                    blocks.clear()
                    owners.clear()

            for i, text in enumerate(texts):
                if model and text and any(map(str.isalpha, text.decode("utf-8"))):
                    w = windows(text)
                    blocks.append(w)
                    owners.append(np.full(len(w), i))
                    counts[i] = len(w)
                    held += len(w)
                    if held >= BATCH:
                        flush()
                        held = 0
            flush()
            for total, n in zip(sums, counts):
                if not n:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                p = np.exp((total - total.max()) / n)
                best = int(total.argmax())
                langs.append(model.langs[best])
                scores.append(float(p[best] / p.sum()))
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict.asNondeterministic()


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The columns of ``docs`` and a struct column ``language`` of lang_pred and score.

    Without a model, one is fitted on the labelled documents that are not held
    out. A null text, or one without a letter, is ``und`` with score 0, as is
    every text when no document is labelled. ``score`` is the softmax of the mean
    log-probabilities over the text's windows. A language is predicted from the
    text alone. Repeated rows each get the same answer; an existing column named
    ``language`` is replaced.
    """
    model = model or fit(docs)
    return docs.withColumn("language", predictor(model, docs.sparkSession)(F.col("text").cast("string")))


def keep_identified(docs: DataFrame, least_score: float = 0.35) -> DataFrame:
    """``docs`` without those whose language is undetermined or hardly above chance."""
    found = identify(docs)
    return found.where((F.col("language.lang_pred") != "und") & (F.col("language.score") >= least_score)).select(*docs.columns)
