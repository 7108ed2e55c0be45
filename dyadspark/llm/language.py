"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is folded to lower-case ASCII letters and other letters' bytes; everything else is a word border. Its
subwords are the byte runs of a few lengths, borders included; each is hashed to a row of an embedding table.
The text's vector is the mean of its rows, and a linear softmax reads it. Training is stochastic gradient
descent in numpy on a bounded, documented sample of labelled rows. Since mean and layer are both linear, the
table and the layer are multiplied once after training, and scoring a whole text is one gather and one sum.

Confidence is calibrated on rows kept from training: a temperature makes the probabilities honest, and the
reject threshold is the lowest at which accepted rows reach the wanted accuracy.

Defined results: ``und`` and score 0 for a null text or one without a letter; null or repeated ids are passed
through, one row out for every row in; of equal probabilities the first language by name wins; very long texts are
scored whole, one to a step; an empty table gives an empty result; without labelled rows every text is ``und``; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.llm._common import as_bytes, by_group, steps, trained
from dyadspark.operators.checkpoints import cut

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_BITS = 16
#: Lengths of the subwords in bytes.
_GRAMS = (2, 3, 4)


def subwords(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Table rows of the subwords of each length at every byte; a text's last bytes are padded with borders."""
    text = _FOLD[data]
    n = len(text)
    pad = np.full(n + 4, 0x20, np.uint32)
    pad[:n] = text
    code = pad[:-1] << np.uint32(8) | pad[1:]
    # subwords that would reach into the next text see a border instead
    ends, sizes = offsets[1:], np.diff(offsets)
    out = []
    for size in _GRAMS:
        own = code[:n].copy()
        if size > 2:
            own = own << np.uint32(8) | pad[2 : n + 2]
        if size > 3:
            own = own << np.uint32(8) | pad[3 : n + 3]
        for j in range(1, size):  # the byte j places from the end of its text misses size - j bytes
            at = ends[sizes >= j] - j
            keep = np.uint32(8 * (size - j))
            own[at] = own[at] >> keep << keep | np.uint32(0x20202020 & ((1 << 8 * (size - j)) - 1))
        out.append(((own * np.uint32(0x9E3779B1) + np.uint32(size * 0x61C88647 & 0xFFFFFFFF)) >> np.uint32(32 - _BITS)).astype(np.int32))
    return out


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    folded = _FOLD[data]
    ascii_letter = np.concatenate([[0], np.cumsum((folded >= 97) & (folded < 123))])[offsets]
    out = np.diff(ascii_letter) > 0
    high = np.concatenate([[0], np.cumsum(folded >= 128)])[offsets]
    for i in np.flatnonzero(~out & (np.diff(high) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # [row, language] = embedding @ layer
    bias: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total = np.zeros((len(offsets) - 1, len(self.langs)), np.float64)
        for rows in subwords(data, offsets):
            total += by_group(np.add, self.table[rows], offsets, 0.0)
        return total / np.maximum(np.diff(offsets), 1)[:, None] / len(_GRAMS) + self.bias

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(language or und, probability)``."""
        if not self.langs:
            return np.full(len(offsets) - 1, "und", object), np.zeros(len(offsets) - 1)
        p = _softmax(self.logits(data, offsets) / self.temperature)
        best = p.argmax(axis=1)
        ok = has_letter(data, offsets)
        return np.where(ok, np.array(self.langs, object)[best], "und"), np.where(ok, p[np.arange(len(p)), best], 0.0)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], langs: list[str], *, dim: int = 16, epochs: int = 6, rate: float = 2.0, accuracy: float = 0.99, seed: int = 11) -> LanguageModel:
    """Stochastic gradient descent, one text at a step; a tenth of the rows calibrates."""
    names = sorted(set(langs))
    if len(names) < 1:
        return LanguageModel([], np.zeros((1 << _BITS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    texts, y = [texts[i] for i in order], np.array([names.index(langs[i]) for i in order])
    data, offsets = as_bytes(pa.array(texts, pa.large_string()))
    grams = subwords(data, offsets)
    n, n_cal = len(texts), len(texts) // 10
    emb = rng.uniform(-1 / dim, 1 / dim, (1 << _BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    bags = []
    for i in range(n_cal, n):
        rows, counts = np.unique(np.concatenate([g[offsets[i] : offsets[i + 1]] for g in grams]), return_counts=True)
        bags.append((rows, (counts / max(counts.sum(), 1)).astype(np.float32)[:, None], y[i]))
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            rows, share, want = bags[i]
            lr = rate * (1 - done / (epochs * len(bags))) + 0.01
            done += 1
            mean = (emb[rows] * share).sum(axis=0)
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[want] -= 1
            pull = layer @ p
            layer -= lr * np.outer(mean, p)
            bias -= 0.1 * lr * p
            emb[rows] -= lr * share * pull
    model = LanguageModel(names, (emb @ layer).astype(np.float32), bias.astype(np.float64))
    _calibrate(model, data[: offsets[n_cal]], offsets[: n_cal + 1], y[:n_cal], accuracy)
    return model


def _calibrate(model: LanguageModel, data: np.ndarray, offsets: np.ndarray, y: np.ndarray, accuracy: float) -> None:
    if not len(y):
        return
    z = model.logits(data, offsets)
    loss = lambda t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.02, 5, 60), key=loss))
    p = _softmax(z / model.temperature)
    top, right = p.max(axis=1), p.argmax(axis=1) == y
    rank = np.argsort(-top)
    good = np.flatnonzero(np.cumsum(right[rank]) / np.arange(1, len(y) + 1) >= accuracy)
    model.reject = float(top[rank][good[-1]]) if len(good) else 1.0


def labelled_sample(docs: DataFrame, learn: Column, *, per_lang: int = 800, most_rows: int = 8000, most_chars: int = 20_000) -> DataFrame:
    """At most ``per_lang`` rows of each language among those that ``learn`` allows, in hash order of the id.

    ``most_rows`` bounds all languages together: many languages get fewer rows each, one at least, so none is left
    out. Languages are counted first; a row comes into question only if its hash is below a share that leaves about
    twice the rows wanted, so what is ranked of a language does not grow with it. Only ids are ranked.
    """
    able = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars)).select("doc_id", "text", "lang")
    counts = cut(able.groupBy("lang").agg(F.count("*").alias("_n")))
    langs = counts.count()
    per_lang = max(1, min(per_lang, most_rows // max(1, langs)))
    counts = F.broadcast(counts) if langs <= 10_000 else counts
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    near = able.select("doc_id", "lang").join(counts, "lang").where(draw * F.col("_n") < 2 * per_lang + 100).select("doc_id", "lang").distinct()
    rank = W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), "doc_id")
    ids = near.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= per_lang).select("doc_id").distinct()
    ids = cut(ids)
    return able.join(F.broadcast(ids) if langs <= most_rows else ids, "doc_id", "left_semi")  # most_rows ids at most, or one for each language


def fit(docs: DataFrame, learn: Column, *, per_lang: int = 800, most_chars: int = 20_000, **options) -> LanguageModel:
    """Train on the sample of :func:`labelled_sample`, on an executor."""

    def learn_from(rows):
        rows = rows.sort_values(["doc_id", "text"])
        return train(rows.text.tolist(), rows.lang.tolist(), **options)

    return trained(labelled_sample(docs, learn, per_lang=per_lang, most_chars=most_chars), learn_from)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``(doc_id, lang_pred, score, accepted)`` of every row; rows under the reject threshold are not accepted."""
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        for part, data, offsets in steps(batches):
            lang, p = own.predict(data, offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(lang, pa.string()), pa.array(p), pa.array((lang != "und") & (p >= own.reject), pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return given.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, accepted boolean")
