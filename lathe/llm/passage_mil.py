"""Quality classifier by attention-based multiple-instance learning: documents are bags of encoded passages."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.session import materialise

#: Words in a passage, bytes of a text that are encoded at once, and of several texts; a longer text is cut at white space into such stretches.
PASSAGE, STRETCH, TOGETHER = 64, 1 << 20, 1 << 18
#: Hashed word features and measures of style of a passage.
HASHED, STYLE = 128, 12
#: Labelled documents that the model is fitted on at most, those of the smallest hashes, and passages of each, evenly spread over its text.
#: They bound what comes to the driver: 4,000 * 64 passages of 560 bytes, 143 MB.
MAX_LABELLED, MAX_PASSAGES = 4000, 64
#: Scores from here on predict label 1.
THRESHOLD = 0.3
#: Rows of the held-out fold: crc32 of the id's text leaves no remainder.
FOLDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_UPPER, _LOWER, _DIGIT, _HIGH = (np.isin(np.arange(256), list(r)) for r in (range(65, 91), range(97, 123), range(48, 58), range(128, 256)))
_MARK = ~(_SPACE | _UPPER | _LOWER | _DIGIT | _HIGH)
_PROSE = np.isin(np.arange(256), list(b".,;:'\"-?()"))
#: Weights of a word's bytes by place, for a polynomial hash that numpy adds up for all words at once.
_POWERS = np.cumprod(np.full(64, 0x100000001B3, dtype=np.uint64))


def _stretches(raw: bytes) -> Iterator[bytes]:
    start = 0
    while len(raw) - start > STRETCH:
        cut = max(raw.rfind(c, start + 1, start + STRETCH) for c in (b" ", b"\n", b"\t"))
        cut = cut if cut > start else start + STRETCH
        yield raw[start:cut]
        start = cut
    yield raw[start:]


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32, HASHED + STYLE columns) and the number of passages of each text, one at least."""
    rows, counts, held, size = [], np.zeros(len(texts), dtype=np.int64), [], 0
    for i, text in enumerate(texts):
        for part in _stretches((text or "").encode("utf-8", "surrogatepass")):
            held.append((i, part))
            size += len(part)
            if size >= TOGETHER:
                rows.append(_encode(held, counts))
                held, size = [], 0
    if held:
        rows.append(_encode(held, counts))
    return (np.concatenate(rows) if rows else np.zeros((0, HASHED + STYLE), np.float32)), counts


def _encode(parts: list[tuple[int, bytes]], counts: np.ndarray) -> np.ndarray:
    """Features of the passages of some stretches, in order; adds their numbers to counts."""
    data = np.frombuffer(b" " + b" ".join(p for _, p in parts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1) + 1, np.flatnonzero(edge == 1) + 1
    bounds = np.cumsum([1] + [len(p) + 1 for _, p in parts])
    first = np.searchsorted(starts, bounds)
    per_part = np.diff(first)
    passages = np.maximum(1, -(-per_part // PASSAGE))
    np.add.at(counts, [i for i, _ in parts], passages)
    base = np.concatenate([[0], np.cumsum(passages)])
    out = np.zeros((base[-1], HASHED + STYLE), np.float32)
    if not len(starts):
        return out
    part = np.repeat(np.arange(len(parts)), per_part)
    passage = base[part] + (np.arange(len(starts)) - first[part]) // PASSAGE
    length = ends - starts
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    with np.errstate(over="ignore"):
        value = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[place & 63])
        hashes = np.add.reduceat(value, starts)
        hashes ^= hashes >> np.uint64(29)
        hashes *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (hashes >> np.uint64(40)).astype(np.int64) % HASHED
    n = np.bincount(passage, minlength=len(out)).astype(np.float32)
    full = np.maximum(n, 1)
    out[:, :HASHED] = np.bincount(passage * HASHED + bucket, minlength=len(out) * HASHED).reshape(-1, HASHED) / full[:, None]

    def of(table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[data].astype(np.int32), starts)

    upper, lower, digit, high, mark, prose = (of(t) for t in (_UPPER, _LOWER, _DIGIT, _HIGH, _MARK, _PROSE))
    per = lambda w: np.bincount(passage, weights=w, minlength=len(out))
    held = per(length)
    chars = np.maximum(held, 1)
    again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])])
    order = np.lexsort((hashes, passage))
    new = np.concatenate([[True], (hashes[order][1:] != hashes[order][:-1]) | (passage[order][1:] != passage[order][:-1])])
    distinct = np.bincount(passage[order], weights=new, minlength=len(out))
    odd = mark - prose
    style = [per(upper) / chars, per(digit) / chars, per(odd) / chars, per(prose) / chars, per(high) / chars, held / full / 10, per(again) / full, distinct / full, per((upper > 1) & (lower == 0)) / full, per((upper + lower + high) == 0) / full, per(odd > 0) / full, np.log1p(n) / 4]
    out[:, HASHED:] = np.stack(style, axis=1)
    return out


@dataclass
class Model:
    """Weights: standardised passages to hidden units, gated attention over them, and the linear output."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return forward(self.weights, (x - self.mean) / self.scale, counts)[5].astype(float) if len(counts) else np.zeros(0)


def forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> tuple:
    """Hidden units, both branches of the gate, attention weights, weighted sum and score of bags of standardised passages; starts of the bags."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    e = (t * g) @ w["a"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
    alpha = e / np.repeat(np.add.reduceat(e, starts), counts)
    z = np.add.reduceat(alpha[:, None] * h, starts)
    return h, t, g, alpha, z, 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30))), starts


def gradients(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray, decay: float) -> dict[str, np.ndarray]:
    """Of the mean log loss of the bags plus decay / 2 times the squares of W and c."""
    h, t, g, alpha, z, p, starts = forward(w, x, counts)
    out = (p - y) / len(y)
    dz = np.repeat(out[:, None] * w["c"], counts, axis=0)
    dalpha = (dz * h).sum(axis=1)
    de = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, starts), counts))
    dt, dg = de[:, None] * w["a"] * g * (1 - t * t), de[:, None] * w["a"] * t * g * (1 - g)
    dh = (alpha[:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    return {"W": x.T @ dh + decay * w["W"], "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (de[:, None] * t * g).sum(axis=0), "c": z.T @ out + decay * w["c"], "d": out.sum(keepdims=True)}


def start_weights(features: int, hidden: int = 16, gate: int = 8, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    drawn = {"W": rng.normal(0, 0.1, (features, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)), "a": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
    return {k: v.astype(np.float32) for k, v in drawn.items()}


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8, steps: int = 200, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Model:
    """Adam on the log loss of whole bags, in single precision; rerun on equal input, it gives equal weights."""
    w = start_weights(x.shape[1], hidden, gate, seed)
    model = Model(x.mean(axis=0).astype(np.float32), (x.std(axis=0) + 1e-2).astype(np.float32), w)
    x, y = ((x - model.mean) / model.scale).astype(np.float32), y.astype(np.float32)
    m, v = ({k: np.zeros_like(p) for k, p in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        for k, grad in gradients(w, x, counts, y, decay).items():
            m[k] = (0.9 * m[k] + 0.1 * grad).astype(np.float32)
            v[k] = (0.999 * v[k] + 0.001 * grad**2).astype(np.float32)
            w[k] = (w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == 0


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, passages: int = MAX_PASSAGES) -> Model | None:
    """A model of labels.quality from at most `most` labelled documents outside the held-out fold; None if there are none.

    The sample is the smallest by hash of doc_id, its id list is bounded and so may be broadcast. Of rows that repeat an id
    one is learnt from, that with the smallest hash of its encoded text, and of a document up to `passages` evenly spread passages, so that what
    comes to the driver is bounded in rows and bytes. Conflicting labels of an id count as 0.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("label_id"), "quality", F.xxhash64("doc_id").alias("h"))
    n = max(1, usable.count())
    low = -(2**63) + min(2**64 - 1, int(2**64 * min(1.0, 1.2 * most / n)))
    sample = materialise(usable.where(F.col("h") <= low).groupBy("label_id", "h").agg(F.min("quality").alias("quality")).orderBy("h").limit(most), "mil-sample")
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample.select("label_id", "quality")), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "quality")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, counts = encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            spread = (np.unique(np.linspace(e - c, e - 1, min(c, passages)).round().astype(int)) for c, e in zip(counts, ends, strict=True))
            bags = [x[i].astype("<f4").tobytes() for i in spread]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("quality").cast(pa.int32()), pa.array(bags, pa.binary())], names=["doc_id", "quality", "bag"])

    encoded_rows = materialise(chosen.mapInArrow(encoded, "doc_id long, quality int, bag binary"), "mil-bags")
    rows = sorted(encoded_rows.groupBy("doc_id").agg(F.min_by(F.struct("quality", "bag"), F.xxhash64("bag")).alias("r")).select("doc_id", "r.*").collect())
    if not rows:
        return None
    bags = [np.frombuffer(r.bag, dtype="<f4").reshape(-1, HASHED + STYLE) for r in rows]
    return fit(np.concatenate(bags), np.array([len(b) for b in bags]), np.array([float(r.quality) for r in rows]))


def scored(docs: DataFrame, model: Model | None, column: str = "score") -> DataFrame:
    """docs with the score of text (0 to 1, higher: label 1 is likelier); 0.5 for all without a model. Reads nothing but text."""
    if model is None:
        return docs.withColumn(column, F.lit(0.5))

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = []
            for start in range(0, len(texts), 256):
                out.append(model.scores(*encode(texts.slice(start, 256).to_pylist())))
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(column, F.arrow_udf(over, "double")(F.col("text")))


def classify(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) with held_out, score and predicted (1 from threshold on).

    Every passage of every text is scored. Null, empty and wordless texts are one empty passage. Null labels are no labels.
    A null doc_id is never learnt from. Repeated rows get equal scores. Empty docs: empty result. Columns named like those
    added are replaced; other extra columns stay.
    """
    out = scored(docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out(F.col("doc_id"))), learn(docs, labels, most))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
