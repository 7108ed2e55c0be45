"""Toxicity: a small convolutional text classifier over hashed words.

Words are runs of letters (ASCII letters in lower case, and every byte from 0x80 up). A word's embedding is
the sum of a few rows, found by the 64-bit hashes of the word and of its first bytes (its stems), through a
direct-mapped table that also holds a 32-bit fingerprint; so what training has not seen adds nothing and
never takes another word's row, while an unseen form of a known stem keeps the row of the stem. Filters of several
widths run over the embeddings, a maximum over the whole text pools each filter, and a logistic unit reads
the pooled values. Training is plain numpy in the tasks that hold the labelled rows, all of which it reads
(:func:`fit`); scoring streams every whole text through Arrow batches without a shuffle.

Defined results: a null or empty text (or one without letters) scores as a text in which no filter fires;
null or repeated ids are passed through, one row out for every row in; an empty table gives an empty result;
without both labels every score is 0; a repeated id with both labels counts as toxic; very long texts
are scored whole; equal scores need no order. Further columns of the input, whatever their names, are ignored by
:func:`score` and carried by :func:`clean`. Cut-offs are calibrated from 100 labelled rows of each label on (20 for a
language's own); below that they are one half.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark.llm._common import as_bytes, by_group, fold, ranges, steps, trained, unused
from dyadspark.operators.checkpoints import release, scratch, stored

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 20
#: Bytes from the front of a word that make its stems.
STEMS = (7, 6, 5, 4)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text and of their stems, ``[n, 1 + len(STEMS)]``, and the offsets of the texts in them."""
    if not len(data):
        return np.zeros((0, 1 + len(STEMS)), np.uint64), np.zeros(len(offsets), np.int64)
    letter = _LETTER[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[first] = letter[first]  # words never cross texts
    starts = np.flatnonzero(begins)
    # sums of lower-cased bytes times powers that depend on the place in the word
    at = np.flatnonzero(letter)
    place = at - starts[np.cumsum(begins[at]) - 1] if len(at) else at
    powers = np.cumprod(np.full(64, _MULT, np.uint64))
    terms = (_LOWER[data[at]].astype(np.uint64) + np.uint64(1)) * powers[place & 63] + place.astype(np.uint64)
    first_of = np.searchsorted(at, starts)
    hashes = np.zeros((len(starts), 1 + len(STEMS)), np.uint64)
    if len(starts):
        hashes[:, 0] = np.add.reduceat(terms, first_of)
        for i, stem in enumerate(STEMS, 1):
            terms[place >= stem] = 0
            hashes[:, i] = np.add.reduceat(terms, first_of) + np.uint64(0x5851F42D4C957F2D * i & (1 << 64) - 1)
    hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    return hashes, np.searchsorted(starts, offsets)


@dataclass
class ToxicityModel:
    """Arrays of the trained network; ``thresholds`` holds the cut-off of each language and, under None, of the rest."""

    fingerprint: np.ndarray
    row: np.ndarray
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict = field(default_factory=dict)
    constant: float | None = None

    def __getstate__(self) -> dict:
        """Taken slots of the table and embeddings other than zero: what travels through the driver and to executors."""
        slot, kept = np.flatnonzero(self.row).astype(np.int32), np.flatnonzero(self.embedding.any(1)).astype(np.int32)
        packed = (self.fingerprint.shape, slot, self.fingerprint[slot], self.row[slot]), (self.embedding.shape, kept, self.embedding[kept])
        return {k: v for k, v in self.__dict__.items() if k not in ("fingerprint", "row", "embedding")} | {"packed": packed}

    def __setstate__(self, state: dict) -> None:
        (size, slot, fingerprint, row), (shape, kept, values) = state.pop("packed")
        self.__dict__.update(state)
        self.fingerprint, self.row, self.embedding = np.zeros(size, np.uint32), np.zeros(size, np.int32), np.zeros(shape, values.dtype)
        self.fingerprint[slot], self.row[slot], self.embedding[kept] = fingerprint, row, values

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        slot = (hashes & np.uint64(_SLOTS - 1)).astype(np.int64)
        return np.where(self.fingerprint[slot] == (hashes >> np.uint64(32)).astype(np.uint32), self.row[slot], 0)

    def score(self, hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offsets) - 1, self.constant)
        rows = self.rows(hashes)
        emb = self.embedding[rows[:, 0]]
        for i in range(1, rows.shape[1]):
            emb += self.embedding[rows[:, i]]
        pooled = []
        for w, b in zip(self.filters, self.biases, strict=True):
            out = emb @ w[0]
            for j in range(1, len(w)):
                out[:-j] += (emb @ w[j])[j:]
            out += b
            pooled.append(_pool(out, offsets, len(rows), len(w)))
        z = np.hstack(pooled) @ self.out + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _valid(offsets: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts at which a filter of this width stays in its text, and the offsets of the texts in them."""
    lengths = np.maximum(np.diff(offsets) - width + 1, 0)
    return ranges(offsets[:-1], lengths), np.concatenate([[0], np.cumsum(lengths)])


def _pool(values: np.ndarray, offsets: np.ndarray, n: int, width: int) -> np.ndarray:
    if width > 1:
        at, offsets = _valid(offsets, n, width)
        values = values[at]
    return by_group(np.maximum, np.maximum(values, 0), offsets, 0.0)


class _Fitter:
    """Mini-batch Adam on the arrays of a model, in place."""

    def __init__(self, model: ToxicityModel):
        self.model, self.state, self.step = model, {}, 0
        self.bias = np.full(1, model.bias, np.float32)
        self.moved = np.zeros(len(model.embedding), bool)  # embeddings that a gradient reached

    def _adam(self, key, value, grad, lr):
        m, v = self.state.setdefault(key, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= lr * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)

    def batch(self, rows: np.ndarray, offsets: np.ndarray, part: np.ndarray, labels: np.ndarray, weight: np.ndarray, lr: float) -> None:
        """One step on the texts ``part``; all of ``rows`` and ``offsets`` are as :meth:`ToxicityModel.rows` gives them."""
        model, f32 = self.model, np.float32
        n_filters, dim = model.filters[0].shape[2], model.embedding.shape[1]
        self.step += 1
        lengths = offsets[part + 1] - offsets[part]
        own, at = rows[ranges(offsets[part], lengths)], np.concatenate([[0], np.cumsum(lengths)])
        emb = model.embedding[own[:, 0]]
        for i in range(1, own.shape[1]):
            emb += model.embedding[own[:, i]]
        pooled, best = [], []
        for w, b in zip(model.filters, model.biases, strict=True):
            width = w.shape[0]
            ok, sub = _valid(at, len(own), width)
            resp = sum(emb[ok + j] @ w[j] for j in range(width)) + b if len(ok) else np.zeros((0, n_filters), f32)
            top = by_group(np.maximum, resp, sub, -1.0)
            g = np.repeat(np.arange(len(part)), np.diff(sub))
            hit = resp == top[g]
            arg = np.full((len(part), n_filters), -1, np.int64)
            r, c = np.nonzero(hit)
            arg[g[r], c] = ok[r]
            arg[top <= 0] = -1
            pooled.append(np.maximum(top, 0))
            best.append(arg)
        x = np.hstack(pooled)
        p = 1 / (1 + np.exp(-np.clip(x @ model.out + self.bias[0], -30, 30)))
        dz = ((p - labels[part]) * weight[part] / len(part)).astype(f32)
        dx = dz[:, None] * model.out
        seen, pulls = [], []
        for k, arg in enumerate(best):
            d, c = np.nonzero(arg >= 0)
            if not len(d):
                continue
            g = dx[d, k * n_filters + c]
            dw = np.zeros_like(model.filters[k])
            for j in range(dw.shape[0]):
                tok = own[arg[d, c] + j]
                np.add.at(dw[j].T, c, g[:, None] * emb[arg[d, c] + j])
                pull = g[:, None] * model.filters[k][j][:, c].T
                seen.append(tok.ravel())
                pulls.append(np.repeat(pull, tok.shape[1], axis=0))
            db = np.zeros(n_filters, f32)
            np.add.at(db, c, g)
            self._adam(("w", k), model.filters[k], dw, lr)
            self._adam(("b", k), model.biases[k], db, lr)
        if seen:  # only rows that took part move
            touched, place = np.unique(np.concatenate(seen), return_inverse=True)
            grad = np.zeros((len(touched), dim), f32)
            np.add.at(grad, place, np.concatenate(pulls))
            m, v = self.state.setdefault("e", (np.zeros_like(model.embedding), np.zeros_like(model.embedding)))
            m[touched] += 0.1 * (grad - m[touched])
            v[touched] += 0.01 * (grad * grad - v[touched])
            model.embedding[touched] -= lr * m[touched] / (np.sqrt(v[touched]) + 1e-6)
            model.embedding[0] = 0
            self.moved[touched] = True
        self._adam("o", model.out, x.T @ dz + 1e-5 * model.out, lr)
        self._adam("z", self.bias, np.array([dz.sum()], f32), lr)
        model.bias = float(self.bias[0])


def _hashed(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(fingerprint, row)`` tables of the words, the most frequent first."""
    fingerprint, row = np.zeros(_SLOTS, np.uint32), np.zeros(_SLOTS, np.int32)
    slot = (words & np.uint64(_SLOTS - 1)).astype(np.int64)[::-1]  # the more frequent word keeps a slot
    fingerprint[slot] = (words >> np.uint64(32)).astype(np.uint32)[::-1]
    row[slot] = np.arange(1, len(words) + 1, dtype=np.int32)[::-1]
    return fingerprint, row


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], *, words: np.ndarray | None = None, widths=(1, 2, 3), dim=12, n_filters=8, epochs=5, rate=0.05, most_words=1 << 17, least_steps=120, seed=7) -> ToxicityModel:
    """Fit the network by mini-batch Adam, on rows that one task holds.

    A fifth of the rows calibrates scores and thresholds, if both labels have a hundred rows; else all rows are
    fitted and the cut-off stays at one half. ``words`` are the hashes with a row of their own, the most frequent first;
    without them they are counted in these texts.
    """
    labels = np.asarray(labels, np.float32)
    order = np.random.default_rng(seed).permutation(len(labels))
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel(np.zeros(_SLOTS, np.uint32), np.zeros(_SLOTS, np.int32), np.zeros((1, dim), np.float32), [], [], np.zeros(0), 0.0, constant=0.0)
    texts, langs, labels = [texts[i] for i in order], [langs[i] for i in order], labels[order]
    # a few texts at a time, so that the task never holds the texts many times over
    found = [word_hashes(*as_bytes(pa.array(texts[a : a + 128], pa.large_string()))) for a in range(0, len(texts), 128)]
    hashes, offsets = np.concatenate([h for h, _ in found]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(at) for _, at in found]))])
    del found

    given = words is not None
    if not given:  # words in at least two texts, the most frequent first
        words, counts = np.unique(np.concatenate([np.unique(hashes[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]), return_counts=True)
        words = words[np.argsort(-counts, kind="stable")][: min(most_words, int((counts > 1).sum()))]
    fingerprint, row = _hashed(words)

    rng = np.random.default_rng(seed)
    f32 = np.float32
    model = ToxicityModel(fingerprint, row, rng.normal(0, 0.1, (len(words) + 1, dim)).astype(f32), [rng.normal(0, 0.3, (w, dim, n_filters)).astype(f32) for w in widths], [np.zeros(n_filters, f32) for _ in widths], rng.normal(0, 0.3, len(widths) * n_filters).astype(f32), 0.0)
    model.embedding[0] = 0
    rows = np.concatenate([model.rows(hashes[a : a + (1 << 16)]) for a in range(0, max(1, len(hashes)), 1 << 16)])
    if given:  # what these texts do not hold adds nothing before it is learned
        model.embedding[np.bincount(rows.ravel(), minlength=len(model.embedding)) < 2] = 0
    n_cal = len(labels) // 5 if min((labels == 0).sum(), (labels == 1).sum()) >= 100 else 0
    cal, fit = np.arange(n_cal), np.arange(n_cal, len(labels))
    weight = np.where(labels == 1, 0.5 / max(labels[fit].mean(), 1e-3), 0.5 / max(1 - labels[fit].mean(), 1e-3))
    fitter = _Fitter(model)
    batches = max(1, len(fit) // min(128, max(16, len(fit) // 8)))
    epochs = max(epochs, -(-least_steps // batches))  # small tables are read more often
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(fit), batches):
            fitter.batch(rows, offsets, part, labels, weight, rate * (1 - epoch / epochs) + 0.002)
    sub = np.concatenate([[0], np.cumsum(offsets[cal + 1] - offsets[cal])])
    _calibrate(model, model.score(hashes[: offsets[n_cal]], sub), labels[cal], [langs[i] for i in cal])
    return model


def _cut(scores: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the range of cut-offs with the best F1."""
    order = np.argsort(-scores)
    s, y = scores[order], labels[order]
    hit = np.cumsum(y)
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    i = int(np.argmax(f1))
    return float((s[i] + (s[i + 1] if i + 1 < len(s) else 0)) / 2)


def _calibrate(model: ToxicityModel, scores: np.ndarray, labels: np.ndarray, langs: list[str | None]) -> None:
    """Shift the logits so that 0.5 is the best cut-off over all rows; then a cut-off for each language."""
    if len(scores) and labels.min() != labels.max():
        cut = min(max(_cut(scores, labels), 1e-4), 1 - 1e-4)
        model.shift = -float(np.log(cut / (1 - cut)))
        scores = 1 / (1 + np.exp(-(np.log(np.clip(scores, 1e-9, 1 - 1e-9) / np.clip(1 - scores, 1e-9, 1)) + model.shift)))
    model.thresholds = {None: 0.5}
    for lang in {x for x in langs if x is not None}:
        own = np.array([x == lang for x in langs])
        y = labels[own]
        if y.sum() >= 20 and (1 - y).sum() >= 20:
            model.thresholds[lang] = _cut(scores[own], y)


def labelled_sample(docs: DataFrame, labels: DataFrame, *, mod: int = 5, out: int = 0, per_class: int = 1500, most_chars: int = 20_000) -> DataFrame:
    """At most ``per_class`` rows of each label, in hash order, with texts up to ``most_chars`` characters.

    Training starts from these where one task cannot hold all rows; see :func:`fit`. Ids are chosen among those whose
    text may be used, so long or absent texts never shrink the sample; only ids are shuffled for it.
    """
    able = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= most_chars))
    ids = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", mod) != out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.join(able.select("doc_id"), "doc_id", "left_semi")
    chosen = [ids.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # 2 x per_class rows at most: fit to broadcast
    return able.join(F.broadcast(sample), "doc_id")


def labelled(docs: DataFrame, labels: DataFrame, *, mod: int = 5, out: int = 0) -> DataFrame:
    """``(doc_id, text, lang, toxic)`` of every row with a label and a text outside fold ``out``, whatever its length.

    Both sides are dealt out by the id, so the rows of a task do not follow the order of the files.
    """
    able = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & (fold("doc_id", mod) != out))
    ids = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", mod) != out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return able.join(ids.hint("merge"), "doc_id")


def _vocabulary(rows: DataFrame, most_words: int, held: int = 1 << 20) -> np.ndarray:
    """Hashes of the words and stems that at least two texts of ``rows`` hold, those of most texts first."""

    def counted(parts):
        found, place = np.unique(np.concatenate([w for w, _ in parts]), return_inverse=True)
        return found, np.bincount(place, np.concatenate([n for _, n in parts]), len(found)).astype(np.int64)

    def record(words, times):
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(times)], ["word", "times"])

    def run(batches):
        parts, size = [], 0
        for _, data, offsets in steps(batches, most=1 << 20):
            hashes, at = word_hashes(data, offsets)
            own, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *[np.unique(hashes[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]]), return_counts=True)
            parts.append((own, times))
            size += len(own)
            if size > held:
                parts = [counted(parts)]
                size = len(parts[0][0])
                if size > held // 2:
                    yield record(*parts[0])
                    parts, size = [], 0
        if parts:
            yield record(*counted(parts))

    several = stored(rows.select("text").mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).where("times > 1"))
    # the least number of texts is found first, so that no task sends the driver more words than are kept
    sizes = several.groupBy("times").agg(F.count("*").alias("n")).toPandas().sort_values("times", ascending=False)
    whole = int((sizes.n.cumsum() <= most_words).sum())  # numbers of texts whose words all fit
    at = F.lit(False)
    if whole < len(sizes):  # of the next number, a share by hash
        least, n = (int(x) for x in sizes[["times", "n"]].iloc[whole])
        free = most_words - int(sizes.n.iloc[:whole].sum())
        at = (F.col("times") == least) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < (free << 20) // n)
    if whole:
        at |= F.col("times") >= int(sizes.times.iloc[whole - 1])
    found = several.where(at).toPandas().sort_values(["times", "word"], ascending=[False, True])
    return found["word"].to_numpy(np.int64).view(np.uint64)


def _refined(rows: DataFrame, start: ToxicityModel, share: float, *, tasks: int, rate: float = 0.01, epochs: int = 2, seed: int = 7, block: int = 1 << 14) -> ToxicityModel:
    """``start`` after training on all of ``rows``, of which ``share`` are toxic: every task goes on from it with its own
    rows, a few megabytes of text at a time, and moves the model by the mean of what the tasks changed; an embedding by
    the mean of the tasks that reached it."""
    shared = rows.sparkSession.sparkContext.broadcast(start)
    dense = lambda model: [*model.filters, *model.biases, model.out]

    def run(batches):
        before = shared.value
        own = copy.deepcopy(before)
        fitter, rng = _Fitter(own), np.random.default_rng(seed)
        for part, data, offsets in steps(batches, most=2 << 20):
            hashes, at = word_hashes(data, offsets)
            found = own.rows(hashes)
            del hashes
            labels = part.column("toxic").to_numpy(zero_copy_only=False).astype(np.float32)
            weight = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
            for epoch in range(epochs):
                for few in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // 128)):
                    fitter.batch(found, at, few, labels, weight, (rate * (1 - epoch / epochs) + 0.002) * min(1, len(few) / 128))
        if fitter.step:
            flat = np.concatenate([(y - x).ravel() for x, y in zip(dense(before), dense(own), strict=True)] + [[own.bias - before.bias]]).astype(np.float32)
            moved = np.flatnonzero(fitter.moved[1:]) + 1
            cuts = np.searchsorted(moved, np.arange(0, len(own.embedding), block))
            parts = [x for x in np.split(moved, cuts[1:]) if len(x)]
            at = [np.zeros(1, np.int64), *parts]
            delta = [flat, *[own.embedding[x] - before.embedding[x] for x in parts]]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *[int(x[0]) // block for x in parts]], pa.int32()), pa.array([x.tobytes() for x in at], pa.binary()), pa.array([x.tobytes() for x in delta], pa.binary())], ["block", "at", "delta"])

    def mean(frame):
        found = [(np.frombuffer(a, np.int64), np.frombuffer(d, np.float32)) for a, d in zip(frame["at"], frame["delta"], strict=True)]
        at, place, times = np.unique(np.concatenate([a for a, _ in found]), return_inverse=True, return_counts=True)
        values = np.concatenate([d.reshape(len(a), -1) for a, d in found])
        order = np.lexsort((*values.T[:1], place))  # a sum does not depend on the order of the tasks
        total = np.zeros((len(at), values.shape[1]))
        np.add.at(total, place[order], values[order])
        return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "at": [at.tobytes()], "delta": [(total / times[:, None]).astype(np.float32).tobytes()]})

    kind = "block int, at binary, delta binary"
    changes = rows.select("text", "toxic").coalesce(tasks).mapInArrow(run, kind).groupBy("block").applyInPandas(mean, kind)
    model = copy.deepcopy(start)
    for r in changes.collect():  # as many values as the model has
        at, delta = np.frombuffer(r.at, np.int64), np.frombuffer(r.delta, np.float32)
        if r.block >= 0:
            model.embedding[at] += delta.reshape(len(at), -1)
            continue
        ends = np.cumsum([x.size for x in dense(model)])
        for value, own in zip(dense(model), np.split(delta[:-1], ends[:-1]), strict=True):
            value += own.reshape(value.shape)
        model.bias += float(delta[-1])
    shared.destroy()
    return model


def _set_cuts(model: ToxicityModel, rows: DataFrame, grain: int = 200) -> None:
    """The cut-offs of :func:`_calibrate` from all of ``rows``; logits are counted in steps of ``1 / grain``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part, data, offsets in steps(batches, most=1 << 20):
            p = np.clip(shared.value.score(*word_hashes(data, offsets)).astype(np.float64), 1e-9, 1 - 1e-9)
            yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(np.rint(np.log(p / (1 - p)) * grain).astype(np.int32)), part.column("toxic").cast(pa.int64())], ["lang", "step", "toxic"])

    def cut(frame):
        frame = frame.groupby("step", as_index=False)[["n", "hit"]].sum().sort_values("step", ascending=False)
        hit, n, at = frame.hit.to_numpy().cumsum(), frame.n.to_numpy().cumsum(), frame.step.to_numpy(np.int64)
        i = int(np.argmax(2 * hit / (n + hit[-1])))
        return float((at[i] + (at[i + 1] if i + 1 < len(at) else -30 * grain)) / 2 / grain)

    kind = rows.schema["lang"].dataType.simpleString()
    counts = rows.select("text", "lang", "toxic").mapInArrow(run, f"lang {kind}, step int, toxic long").groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("toxic").alias("hit"))
    counts = stored(counts)
    shared.destroy()
    all_ = counts.groupBy("step").agg(F.sum("n").alias("n"), F.sum("hit").alias("hit")).toPandas()
    model.thresholds = {None: 0.5}
    if not len(all_) or not 0 < all_.hit.sum() < all_.n.sum():
        return
    model.shift = -min(max(cut(all_), -9.21), 9.21)

    def own_cut(frame):
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "cut": [cut(frame)]})

    able = counts.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).where("hit >= 20 AND n - hit >= 20").select("lang")
    for r in counts.join(able, "lang").groupBy("lang").applyInPandas(own_cut, f"lang {kind}, cut double").collect():  # a row for each language
        model.thresholds[r.lang] = float(1 / (1 + np.exp(-np.clip(r.cut + model.shift, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, *, mod: int = 5, out: int = 0, whole_rows: int = 8192, whole_chars: int = 1 << 24, per_class: int = 1500, most_chars: int = 20_000, most_words: int = 1 << 17, most_tasks: int = 24, **options) -> ToxicityModel:
    """Train on every labelled row outside fold ``out``, on executors.

    Up to ``whole_rows`` rows and ``whole_chars`` characters are one task's. With more, words are counted in all rows; a
    first model, from :func:`labelled_sample`, is only where training starts; four fifths of all rows train on from there
    in ``most_tasks`` tasks at most, and the other fifth sets all cut-offs.
    """

    def learn(rows, words=None):
        rows = rows.sort_values(["doc_id", "text"])
        return train(rows.text.tolist(), rows.toxic.to_numpy(), [x if isinstance(x, str) else None for x in rows.lang], words=words, most_words=most_words, **options)

    with scratch(docs.sparkSession):
        rows = stored(labelled(docs, labels, mod=mod, out=out), free=True)
        size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.sum("toxic").alias("toxic")).first()
        if size.n <= whole_rows and (size.chars or 0) <= whole_chars or size.toxic in (0, size.n):
            return trained(rows if size.toxic not in (0, size.n) else rows.limit(1), learn)
        kept = F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.lit(5)) == 0 if min(size.toxic, size.n - size.toxic) >= 100 else F.lit(False)
        fitted = rows.where(~kept)
        words = _vocabulary(rows, most_words)
        release(docs.sparkSession)  # what the driver has passed on goes before more comes, so its heap stays small
        start = trained(labelled_sample(fitted, fitted, mod=mod, out=out, per_class=per_class, most_chars=most_chars), lambda found: learn(found, words))
        if start.constant is not None:  # no text short enough of one of the labels
            start = trained(labelled_sample(fitted, fitted, mod=mod, out=out, per_class=per_class, most_chars=(1 << 31) - 1), lambda found: learn(found, words))
        start.shift, start.thresholds = 0.0, {}
        release(docs.sparkSession)
        model = _refined(fitted, start, size.toxic / size.n, tasks=int(min(most_tasks, max(1, size.chars >> 22))))
        release(docs.sparkSession)
        _set_cuts(model, rows.where(kept))
        release(docs.sparkSession)
        return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``(doc_id, score)`` of every row: the probability of label 1, from the text alone.

    :func:`flag` compares it with the cut-off of the row's language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select("doc_id", "text")
    kind = given.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = shared.value
        for part, data, offsets in steps(batches, most=1 << 20):
            scores = own.score(*word_hashes(data, offsets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return given.mapInArrow(run, f"doc_id {kind}, score double")


def flag(docs: DataFrame, model: ToxicityModel, *, score_name: str = "toxicity", flag_name: str = "toxic") -> DataFrame:
    """All columns of ``docs``, the score, and whether it reaches the cut-off of the row's language.

    The two names must be new to ``docs``.
    """
    if {score_name.lower(), flag_name.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"{score_name} or {flag_name} is a column already; name others")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wide = docs.withColumns({score_name: F.lit(0.0), flag_name: F.lit(False)})

    def run(batches):
        own = shared.value
        for part, data, offsets in steps(batches, most=1 << 20):
            scores = own.score(*word_hashes(data, offsets))
            cut = np.array([own.thresholds.get(x, own.thresholds.get(None, 0.5)) for x in part.column("lang").to_pylist()], np.float64)
            cols = {name: part.column(name) for name in docs_columns} | {score_name: pa.array(scores, pa.float64()), flag_name: pa.array(scores >= cut, pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))

    docs_columns = docs.columns
    return wide.mapInArrow(run, wide.schema)


def clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of ``docs`` whose score is under the cut-off of their language, with all their columns."""
    score_name, flag_name = unused(docs, "_score", "_toxic")
    return flag(docs, model, score_name=score_name, flag_name=flag_name).where(~F.col(flag_name)).drop(score_name, flag_name)
