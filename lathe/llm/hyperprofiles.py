"""Language identification by hyperdimensional profiles: random letter vectors, bound into n-grams and bundled."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.text import fresh
from lathe.session import materialise

#: Components of a vector, and the seed of the letters' vectors.
DIMENSIONS, SEED = 2048, 12
#: Languages whose prototypes are held in a task at most, each of DIMENSIONS doubles.
MOST_LANGUAGES = 1024
#: Code points that are counted at once (two at least), texts whose vectors are held at once, and n-grams whose vectors are.
STRETCH, TOGETHER, BOUND = 1 << 20, 256, 4096
#: Largest component of a prototype, so that products with document vectors stay whole numbers under 2 ** 53.
LARGEST = 32767
#: The prediction for a text without letters.
UNDETERMINED = "und"
#: Rows of the held-out fold: crc32 of the id's text leaves this remainder.
FOLDS, HELD_OUT = 4, 2

_EDGE, _CUT = 0, -1


@functools.cache
def _letters() -> np.ndarray:
    """Code point to that of its lower-case letter, _EDGE for what is no letter."""
    table = np.zeros(0x110000, np.int32)
    known = [c for c in range(0x110000) if chr(c).isalpha()]
    table[known] = [ord(chr(c).lower()[0]) for c in known]
    return table


@functools.lru_cache(maxsize=8192)
def letter_vector(code: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """The random vector of +1 and -1 of a letter, or of a word's edge: bits of a hash of its code point, so that every task has the same."""
    bits = np.frombuffer(hashlib.shake_256(f"{seed}:{code}".encode()).digest(-(-dimensions // 8)), np.uint8)
    return np.unpackbits(bits, count=dimensions).astype(np.int8) * 2 - 1


def _pieces(texts: Sequence[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(text's number, letters and edges) of stretches of texts; a cut inside a word is marked and repeats two letters, so that every n-gram is in one stretch."""
    table = _letters()
    for i, text in enumerate(texts):
        for start in range(0, len(text or ""), STRETCH):
            codes = table[np.frombuffer(text[max(0, start - 2) : start + STRETCH].encode("utf-32-le", "surrogatepass"), np.int32)]
            yield i, np.concatenate([[_CUT if start else _EDGE], codes, [_CUT if start + STRETCH < len(text) else _EDGE]]).astype(np.int32)


def bundle(texts: Sequence[str | None], owners: np.ndarray, count: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    """(count, dimensions): for each owner the sum of the vectors of all three-letter runs of its texts, whole numbers.

    Words are runs of letters, lower-cased one by one, with an edge on either side; a run's vector is the product of its letters' vectors, the first rotated by two places
    and the second by one. owners[i] is the row that texts[i] adds to. Texts of any length are taken whole, a stretch at a time.
    """
    out, held, size = np.zeros((count, dimensions)), [], 0
    for i, codes in _pieces(texts):
        held.append((owners[i], codes))
        size += len(codes)
        if size >= STRETCH:
            _add(held, out, dimensions, seed)
            held, size = [], 0
    if held:
        _add(held, out, dimensions, seed)
    return out


def _add(pieces: list[tuple[int, np.ndarray]], out: np.ndarray, dimensions: int, seed: int) -> None:
    codes = np.concatenate([c for _, c in pieces])
    owner = np.repeat([o for o, _ in pieces], [len(c) for _, c in pieces])
    kept = codes != _EDGE
    kept[0] = True
    kept[1:] |= codes[:-1] != _EDGE
    codes, owner = codes[kept], owner[kept]
    x, y, z = codes[:-2], codes[1:-1], codes[2:]
    whole = (y > 0) & (x != _CUT) & (z != _CUT)
    x, y, z, owner = x[whole], y[whole], z[whole], owner[1:-1][whole]
    if not len(y):
        return
    seen = np.zeros(0x110000, bool)
    for letters in (x, y, z):
        seen[letters] = True
    alphabet = np.flatnonzero(seen)
    rank = np.zeros(0x110000, np.int64)
    rank[alphabet] = np.arange(len(alphabet))
    n = len(alphabet)
    key = (rank[x] * n + rank[y]) * n + rank[z]
    if n**3 <= 1 << 22:
        grams = np.flatnonzero(np.bincount(key, minlength=n**3))
        at = np.zeros(n**3, np.int64)
        at[grams] = np.arange(len(grams))
        key = at[key]
    else:
        grams, key = np.unique(key, return_inverse=True)
    rows, owner = np.unique(owner, return_inverse=True)
    places, counts = _counted(owner * len(grams) + key, len(rows) * len(grams))
    owner, gram = np.divmod(places, len(grams))
    last = np.array([letter_vector(int(c), dimensions, seed) for c in alphabet])
    first, second = np.roll(last, 2, axis=1), np.roll(last, 1, axis=1)
    order = np.argsort(gram, kind="stable")
    owner, gram, counts = owner[order], gram[order], counts[order]
    for start in range(0, len(grams), BOUND):
        some = grams[start : start + BOUND]
        low, high = np.searchsorted(gram, [start, start + BOUND])
        table = np.zeros((len(rows), len(some)), np.float32)
        table[owner[low:high], gram[low:high] - start] = counts[low:high]
        bound = first[some // (n * n)] * second[some // n % n] * last[some % n]
        # Counts of a stretch are under 2 ** 24, so single precision sums them exactly.
        out[rows] += table @ bound.astype(np.float32)


def _counted(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (under most) and how often each comes."""
    if most <= 1 << 23:
        counts = np.bincount(keys, minlength=most)
        places = np.flatnonzero(counts)
        return places, counts[places]
    return np.unique(keys, return_counts=True)


def held_out(doc_id: Column, folds: int = FOLDS, remainder: int = HELD_OUT) -> Column:
    """Whether a document is never learnt from; true for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == remainder, F.lit(True))


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """lang to its prototype, the bundle of all texts of all rows with that lang (columns text, lang), scaled to whole numbers up to LARGEST.

    Each task bundles its texts by language and gives dimensions numbers for each; these whole numbers are added up, so that no order of tasks changes a
    prototype. Null languages and languages without a letter are not learnt. The prototypes come to the driver: at most MOST_LANGUAGES * dimensions numbers, else an error.
    """

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").to_pylist()
            langs = sorted(set(names))
            if len(sums.keys() | set(langs)) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
            places = {lang: o for o, lang in enumerate(langs)}
            owners = np.array([places[n] for n in names])
            for start in range(0, len(names), TOGETHER):
                some = owners[start : start + TOGETHER]
                here = np.unique(some)
                vectors = bundle(batch.column("text").slice(start, TOGETHER).to_pylist(), np.searchsorted(here, some), len(here), dimensions, seed)
                for o, vector in zip(here, vectors, strict=True):
                    sums[langs[o]] = sums.get(langs[o], 0) + vector
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(vector.astype(np.int64))], names=["lang", "place", "total"])

    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    totals = known.mapInArrow(bundled, "lang string, place int, total long").groupBy("lang", "place").agg(F.sum("total").alias("total"))
    totals = materialise(totals, "hyper-prototypes")
    if totals.select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums: dict[str, np.ndarray] = {}
    for row in totals.collect():
        sums.setdefault(row.lang, np.zeros(dimensions))[row.place] = row.total
    return {lang: np.rint(v * (LARGEST / np.abs(v).max())) for lang, v in sorted(sums.items()) if v.any()}


def cosines(vectors: np.ndarray, prototypes: np.ndarray) -> np.ndarray:
    """Cosine of each vector with each prototype, 0 for a null vector. Products and lengths are whole numbers, so no order of adding changes them."""
    lengths = np.sqrt((vectors**2).sum(axis=1))[:, None] * np.sqrt((prototypes**2).sum(axis=1))[None, :]
    return np.divide(vectors @ prototypes.T, lengths, out=np.zeros_like(lengths), where=lengths > 0)


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """docs with lang_pred, the language of the largest cosine with text (ties to the first name), and score, that cosine, 0 at least.

    Reads nothing but text. UNDETERMINED and score 0 for null and letterless texts, and for all where nothing was learnt.
    """
    names = list(prototypes)
    table = np.array([prototypes[n] for n in names]) if names else np.zeros((0, dimensions))

    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            langs, scores = [], []
            for start in range(0, len(texts), TOGETHER):
                some = texts.slice(start, TOGETHER).to_pylist()
                vectors = bundle(some, np.arange(len(some)), len(some), dimensions, seed)
                near = cosines(vectors, table)
                lettered = [bool(names) and _has_letter(t) for t in some]
                best = near.argmax(axis=1) if names else np.zeros(len(some), int)
                langs += [names[b] if ok else UNDETERMINED for b, ok in zip(best, lettered, strict=True)]
                scores += [min(1.0, max(0.0, near[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered, strict=True))]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    rest = docs.drop("lang_pred", "score")
    held = fresh([*rest.columns, "lang_pred", "score"], "predicted")
    found = rest.withColumn(held, F.arrow_udf(over, "lang_pred string, score double")(F.col("text")))
    return found.select(*rest.columns, F.col(f"{held}.lang_pred"), F.col(f"{held}.score"))


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, lang) with held_out, lang_pred and score, learnt from the documents that aren't held out.

    Null and letterless texts are UNDETERMINED. Null ids and null languages are predicted but never learnt from. Repeated rows count each and are predicted
    alike. Empty docs: empty result. Columns named like those added are replaced; other extra columns stay.
    """
    marked = docs.drop("held_out").withColumn("held_out", held_out(F.col("doc_id")))
    prototypes = learn(marked.where(~F.col("held_out")), dimensions, seed)
    return predict(marked, prototypes, dimensions, seed)
