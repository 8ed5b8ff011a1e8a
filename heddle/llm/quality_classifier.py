"""Document quality from random-indexing word vectors and a small calibrated network."""

from __future__ import annotations

import io
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import small_batches, written


@dataclass(frozen=True)
class Settings:
    """``rows`` bounds the labelled documents that the model is fitted on, ``bytes`` the sum of their
    texts' bytes (texts that would go beyond it are left out), ``words`` the model's vocabulary."""

    rows: int = 6000
    bytes: int = 24 << 20
    words: int = 20_000
    dim: int = 48
    signs: int = 32
    reach: int = 2
    hidden: int = 32
    epochs: int = 40
    rate: float = 0.01
    decay: float = 1e-4
    seed: int = 11


#: Words of which a worker keeps the place and signs, in each of two generations.
CACHED_WORDS = 100_000
_RUNS = [(re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"(?:[a-z]|[\x80-\xff])+"), b"a"), (re.compile(rb"[0-9]+"), b"9")]


def shapes(words: list[bytes]) -> list[bytes]:
    """Each word with each run of capitals, other letters and digits as one character, marked so as
    not to be a word; at most 12 characters."""
    lines = b"\n".join(words)  # no word holds white space
    for pattern, sign in _RUNS:
        lines = pattern.sub(sign, lines)
    return [b"\x00" + x[:12] for x in lines.split(b"\n")] if words else []


def index_vector(word: bytes, dim: int, nonzero: int = 8) -> np.ndarray:
    """The word's random index vector: sparse, ternary, from its hash alone."""
    rng = np.random.default_rng(xxhash.xxh64_intdigest(word))
    out = np.zeros(dim, dtype=np.float32)
    at = rng.choice(dim, nonzero, replace=False)
    out[at] = rng.choice(np.array([-1.0, 1.0], dtype=np.float32), nonzero)
    return out


def sign_vectors(words: list[bytes], signs: int) -> np.ndarray:
    """Dense index vector of every word, known or not; its pooled length tells how words repeat."""
    digests = np.array([xxhash.xxh64_intdigest(w, 3) for w in words], dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(digests, axis=1)[:, :signs].astype(np.float32) * 2 - 1


def context_vectors(texts: list[list[bytes]], s: Settings) -> dict[bytes, np.ndarray]:
    """Random indexing: each frequent word's vector, and each shape's, is the sum of the index
    vectors of the words around it, scaled to length 1."""
    counts: dict[bytes, int] = {}
    for w in texts:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    form_of = dict(zip(counts, shapes(list(counts)), strict=True))
    known = [x for x, n in sorted(counts.items(), key=lambda p: (-p[1], p[0]))[: s.words] if n >= 3]
    names = known + sorted(set(form_of.values()))
    place = {x: i for i, x in enumerate(names)}
    index = np.stack([index_vector(x, s.dim) for x in names]) if names else np.zeros((0, s.dim), dtype=np.float32)
    total = np.zeros((len(names), s.dim), dtype=np.float32)
    for w in texts:
        form = np.array([place[form_of[x]] for x in w], dtype=np.int64)
        word = np.array([place.get(x, -1) for x in w], dtype=np.int64)
        own = np.where(word >= 0, word, form)
        near = index[own] if len(w) else np.zeros((0, s.dim), dtype=np.float32)
        around = np.zeros_like(near)
        for o in range(1, s.reach + 1):
            around[o:] += near[:-o] if len(near) > o else 0
            around[:-o] += near[o:] if len(near) > o else 0
        for ids, ok in ((form, np.ones(len(w), dtype=bool)), (word, word >= 0)):
            ids, rows = ids[ok], around[ok]
            if len(ids):
                order = np.argsort(ids, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
                total[ids[order][starts]] += np.add.reduceat(rows[order], starts, axis=0)
    total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)
    return dict(zip(names, total, strict=True))


class Pooler:
    """Features of texts: the means of their words' vectors and shapes' vectors, the length of their
    mean sign vector, and the number of words.

    The model's vectors are one table, with a row of zeros for what it doesn't know.  A worker keeps
    which rows a word and its shape have, and its signs, of the words of one generation; new words of
    a batch are looked up together, and when a generation is full, another begins.
    """

    def __init__(self, vectors: dict[bytes, np.ndarray], s: Settings):
        self.s = s
        self.row = {w: i + 1 for i, w in enumerate(vectors)}
        # half precision numbers, added as doubles: sums are exact, whatever order words were met in
        known = np.stack(list(vectors.values())).astype(np.float16) if vectors else np.zeros((0, s.dim))
        self.table = np.concatenate([np.zeros((1, s.dim)), known.astype(np.float64)])
        self.begin()

    def begin(self) -> None:
        self.place: dict[bytes, int] = {}
        self.own = np.zeros((0, 2), dtype=np.int32)
        self.signs = np.zeros((0, self.s.signs), dtype=np.int8)

    def learn(self, words: set[bytes]) -> None:
        fresh = list(words - self.place.keys())
        if len(self.place) + len(fresh) > CACHED_WORDS and self.place:
            self.begin()
            fresh = list(words)
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
        rows = [(self.row.get(w, 0), self.row.get(x, 0)) for w, x in zip(fresh, shapes(fresh), strict=True)]
        self.own = np.concatenate([self.own, np.array(rows, dtype=np.int32).reshape(-1, 2)])
        self.signs = np.concatenate([self.signs, sign_vectors(fresh, self.s.signs).astype(np.int8)])

    def sums(self, words: list[bytes]) -> np.ndarray:
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        if len(words) > 64:
            at, times = np.unique(at, return_counts=True)
        else:
            times = np.ones(len(at), dtype=np.int64)
        times = times.astype(np.float64)
        return np.concatenate([times @ self.table[self.own[at, 0]], times @ self.table[self.own[at, 1]], times @ self.signs[at].astype(np.float64)])

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """One row for each text.  Texts are looked at in parts, so that very long ones need no more memory."""
        out, i = np.zeros((len(texts), 2 * self.s.dim + self.s.signs)), 0
        parts = [(i, w[a : a + 8192]) for i, w in enumerate(texts) for a in range(0, len(w), 8192)]
        while i < len(parts):
            j, n = i, 0
            while j < len(parts) and (j == i or n + len(parts[j][1]) <= CACHED_WORDS // 2):
                n += len(parts[j][1])
                j += 1
            self.learn(set().union(*[w for _, w in parts[i:j]]))
            for at, w in parts[i:j]:
                out[at] += self.sums(w)
            i = j
        n = np.array([[len(w)] for w in texts], dtype=np.float64).reshape(-1, 1)
        out /= np.maximum(n, 1)
        signs = (out[:, 2 * self.s.dim :] ** 2).mean(axis=1, keepdims=True)
        return np.concatenate([out[:, : 2 * self.s.dim], np.log(signs + 1e-4), np.log1p(n), np.log(signs * np.maximum(n, 1) + 1e-2)], axis=1)


def trained(x: np.ndarray, y: np.ndarray, s: Settings) -> dict[str, np.ndarray]:
    """Two-layer network by Adam, and the temperature that best fits a fifth kept apart."""
    rng = np.random.default_rng(s.seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    apart = np.arange(len(z)) % 5 == 4
    if apart.sum() < 5 or len(set(y[~apart].tolist())) < 2:
        apart[:] = False
    w = {"w1": rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], s.hidden)), "b1": np.zeros(s.hidden), "w2": rng.normal(0, 1 / np.sqrt(s.hidden), s.hidden), "b2": np.zeros(1)}
    m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    fit, step = np.flatnonzero(~apart), 0
    for _ in range(s.epochs):
        for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 64)):
            a = np.tanh(z[batch] @ w["w1"] + w["b1"])
            p = 1 / (1 + np.exp(-np.clip(a @ w["w2"] + w["b2"], -30, 30)))
            d = (p - y[batch]) / len(batch)
            da = np.outer(d, w["w2"]) * (1 - a * a)
            g = {"w1": z[batch].T @ da + s.decay * w["w1"], "b1": da.sum(axis=0), "w2": a.T @ d + s.decay * w["w2"], "b2": np.array([d.sum()])}
            step += 1
            for k in w:
                u, v = m[k]
                u *= 0.9
                u += 0.1 * g[k]
                v *= 0.999
                v += 0.001 * g[k] ** 2
                w[k] = w[k] - s.rate * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    temperature = 1.0
    if apart.any():
        logit = np.tanh(z[apart] @ w["w1"] + w["b1"]) @ w["w2"] + w["b2"]
        grid = np.exp(np.linspace(-2, 3, 101))
        loss = [np.logaddexp(0, np.where(y[apart] > 0, -1, 1) * logit / t).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    return w | {"mean": mean, "scale": scale, "temperature": np.array([temperature])}


def probabilities(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    logit = np.tanh((x - model["mean"]) / model["scale"] @ model["w1"] + model["b1"]) @ model["w2"] + model["b2"]
    return 1 / (1 + np.exp(-np.clip(logit / model["temperature"], -30, 30)))


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> bytes | None:
    """A model from at most ``settings.rows`` labelled documents that aren't held out (those least
    by a hash of the key) and ``settings.bytes`` bytes of their texts, as bytes; None if there are none.

    The sample is chosen from the labels alone, so only its texts are moved; the model is fitted in
    one task, and its size is bounded by the vocabulary.  Labels that are null or neither 0 nor 1,
    and null keys, count for nothing; of several labels of a key, the greatest counts.
    """
    small_batches(docs.sparkSession)
    s = settings
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_label"))
    chosen = written(usable.orderBy(F.xxhash64("_k"), "_k").limit(s.rows))  # the documented bound
    sample = docs.join(F.broadcast(chosen), F.col(key) == F.col("_k")).select(F.xxhash64(key).alias("_h"), F.col(text).alias("_t"), "_label")

    def run(batches):
        rows, size = [], 0
        for h, t, y in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            t = (t or "").encode("utf-8", "replace")
            if size + len(t) <= s.bytes:
                size += len(t)
                rows.append((h, t, y))
        if not rows:
            return
        texts = [t.split() for _, t, _ in rows]
        vectors = context_vectors(texts, s)
        pool = Pooler(vectors, s)
        model = trained(pool.features(texts), np.array([y for *_, y in rows], dtype=np.float64), s)
        out = io.BytesIO()
        np.savez_compressed(out, names=np.frombuffer(b"\n".join(vectors), dtype=np.uint8), vectors=np.stack(list(vectors.values())).astype(np.float16), **model)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    found = sample.repartition(1).sortWithinPartitions("_h", "_t", "_label").mapInArrow(run, "model binary").collect()  # a bounded number of rows; the scan stays parallel
    return bytes(found[0]["model"]) if found else None


def scorer(model: bytes | None, settings: Settings):
    """Function from texts to their scores, for a worker."""
    if model is None:
        return lambda texts: np.full(len(texts), 0.5)
    z = np.load(io.BytesIO(model))
    weights = {k: z[k] for k in z.files}
    names, vectors = weights.pop("names").tobytes().split(b"\n"), weights.pop("vectors").astype(np.float32)
    pool = Pooler(dict(zip(names, vectors, strict=True)), settings)
    return lambda texts: probabilities(weights, pool.features([(t or "").encode("utf-8", "replace").split() for t in texts])) if texts else np.empty(0)


def score(docs: DataFrame, model: bytes | None, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """key, score (probability of label 1) and predicted (1 if that is 0.5 or more) of every whole
    text.  Row-wise.  Null and empty texts are scored as having no words; without a model every
    score is 0.5.  Repeated rows have a row each; extra columns are left out."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        of = scorer(model, settings)
        for batch in batches:
            p = of(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[key, "score", "predicted"])

    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: bytes | None, text: str = "text", settings: Settings = Settings(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores ``least`` or more, as ``score`` has it."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches):
        of = scorer(model, settings)
        for batch in batches:
            yield batch.filter(pa.array(of(batch.column(at).to_pylist()) >= least))

    return docs.mapInArrow(run, docs.schema)
