"""Packing by concatenating all documents' tokens and cutting the stream into windows of equal length."""

from __future__ import annotations

import base64
import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.llm.text import slices
from lathe.session import materialise

#: Tokens of a sequence and the id that ends a document.
WINDOW, END = 2048, 1
#: Words whose ids a task keeps, and characters of the longest it does, which bound the cache's bytes; once full, others are encoded again each time they come.
CACHED, LONGEST = 50_000, 64
#: Bytes of texts or ids that a task has as Python's objects at a time; what they become is handed on before the next.
TOGETHER = 1 << 20
_RUN = re.compile(r"\s\s")
#: White space that the pattern takes as one piece; runs from here on are cut out, as the pattern's engine gives up on a million characters.
_LONG = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


class _WordIds(dict):
    """Ids of a space and the word that follows it, as 16-bit bytes, encoded when first asked for."""

    def __init__(self, encode: Callable[[str], list[int]], most: int):
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        ids = array("H", self.encode(" " + word)).tobytes()
        if len(self) < self.most and len(word) <= LONGEST:
            self[word] = ids
        return ids


def encoder(ranks_path: str, pattern: str, cached: int = CACHED, added: Mapping[str, int] | None = None) -> Callable[[str], bytes]:
    """text to its ids as native 16-bit bytes, for a byte-level BPE vocabulary under 65,536 ids given as ranks.

    Pre-tokens never reach across a space between two non-space characters, except that they start with it. A text without
    two white spaces in a row is therefore the concatenation of its words' ids, each with its leading space; others are
    encoded whole, but for long runs of white space, which are pieces by themselves. An added token is its own id, and what is around it is encoded apart.
    """
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode, tokens = encoding.encode_ordinary, dict(added or {})
    names = re.compile("|".join(map(re.escape, sorted(tokens, key=len, reverse=True)))) if tokens else None
    ids = _WordIds(encode, cached)

    def plain(text: str) -> bytes:
        if not _RUN.search(text):
            first, *rest = text.split(" ")
            return array("H", encode(first)).tobytes() + b"".join(map(ids.__getitem__, rest))
        out, at = [], 0
        for run in _LONG.finditer(text):
            # A run is one piece but for its last character where something follows, which that may take along.
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += [encode(text[at : run.start()]), encoding._encode_single_piece(text[run.start() : end])]
            at = end
        out.append(encode(text[at:]))
        return b"".join(array("H", x).tobytes() for x in out)

    def of(text: str) -> bytes:
        if names is None or not names.search(text):
            return plain(text)
        out, at = [], 0
        for name in names.finditer(text):
            out += [plain(text[at : name.start()]) if name.start() > at else b"", array("H", [tokens[name.group()]]).tobytes()]
            at = name.end()
        return b"".join(out) + (plain(text[at:]) if at < len(text) else b"")

    return of


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the default vocabulary's ranks; a parameter of pack()."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def public_added() -> dict[str, int]:
    """The tokens that byte_bpe_50k.json adds to the ranks, which `tokenizers` finds in texts with add_special_tokens=False too."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as whole:
        return {t["content"]: t["id"] for t in json.load(whole)["added_tokens"]}


def tokenise(docs: DataFrame, vocabulary: tuple[str, str] | None = None, end: int = END, added: Mapping[str, int] | None = None, cached: int = CACHED) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids (16-bit binary, with the end id), part (task) and at (ids of the task before it)."""
    path, pattern = vocabulary or public_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("at", pa.int64())])
    last = array("H", [end]).tobytes()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = encoder(path, pattern, cached, added), 0
        for batch in batches:
            for some in slices(batch, "text", TOGETHER):
                ids = [of(text or "") + last for text in some.column("text").to_pylist()]
                starts = []
                for x in ids:
                    starts.append(at)
                    at += len(x) // 2
                yield pa.RecordBatch.from_arrays([some.column("doc_id").cast(pa.int64()), pa.array(ids, pa.binary()), some.column("part"), pa.array(starts, pa.int64())], schema=schema)

    marked = docs.select("doc_id", "text", F.spark_partition_id().alias("part"))
    return marked.mapInArrow(encoded, "doc_id long, ids binary, part int, at long")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: tuple[str, str] | None = None, end: int = END, added: Mapping[str, int] | None = None, cached: int = CACHED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (16-bit binary), ids_crc32, doc_tokens, sequence_id, offset.

    First pass: each task encodes its documents and counts ids; the result is a table in the shared scratch folder, so that
    numbers hold even if a task runs again. Second pass: running sums over the tasks' totals (one row a task) give each task's
    offset in the stream of all ids, and each document is cut where the stream passes a multiple of window; a document over a
    boundary gives a record on either side. Every id is in exactly one piece, and only the last sequence is not full.

    Null and empty texts are the end id alone. Names in added become its ids wherever a text holds them; without it they are
    plain text. cached words, some 160 bytes each, are kept by a task. A null doc_id and repeated rows are documents like others. No rows: no pieces. Extra columns are left out. The order of documents is that of the input's partitions.
    """
    encoded = materialise(tokenise(docs, vocabulary, end, added, cached), "pack-ids")
    totals = encoded.groupBy("part").agg(F.max(F.col("at") + F.expr("octet_length(ids) div 2")).alias("tokens"))
    before = W.Window.orderBy("part").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = materialise(totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before")), "pack-offsets")
    placed = encoded.join(offsets, "part").select("doc_id", "ids", (F.col("before") + F.col("at")).alias("at"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some for whole in batches for some in slices(whole, "ids", TOGETHER)):
            rows = []
            for doc_id, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "at")), strict=True):
                n, start = len(ids) // 2, 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[2 * start : 2 * (start + length)]
                    rows.append((doc_id, start, length, piece, zlib.crc32(array("I", array("H", piece)).tobytes()), n, sequence, offset))
                    start += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
