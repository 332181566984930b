"""Merkle proofs, language profiles and importance resampling against plain versions, and on rows that are odd."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from edges import documents, empty
from pyspark.sql import functions as F

from lathe.llm import crc_ring, hyperprofiles, merkle, queries

# Merkle manifest


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*values):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        run = i // 3 * 3
        path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        i //= 3
    return path


def plain_manifest(rows, tamper=lambda row: row[1]):
    """doc_id, leaf, subroot, root, proof, folded of rows (doc_id, text, lang, source, n_chars)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r, plain_leaf(r[0], r[3], r[2], r[4], r[1]), plain_leaf(r[0], r[3], r[2], r[4], tamper(r))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[name] = plain_levels([x[1] for x in groups[name]])
    over = plain_levels([trees[n][-1][0] for n in names])
    out = []
    for g, name in enumerate(names):
        for i, (row, own, claimed) in enumerate(groups[name]):
            path = plain_path(trees[name], i) + plain_path(over, g)
            folded = claimed
            for before, after in path:
                folded = sha(before, folded, after)
            out.append((row[0], own, trees[name][-1][0], over[-1][0], sha(*[b + a for b, a in path]), folded, folded == over[-1][0]))
    return out


MERKLE = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def by_text(rows):
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("sizes", [[1], [2], [4, 1], [82, 81, 3], [250, 10, 1, 1, 1]])
def test_proofs_against_plain_trees(spark, sizes):
    rows = [(n, f"text {n}\nmore" if n % 5 else None, "en", f"s{g}" if g else None, n % 7) for g, size in enumerate(sizes) for n in range(g * 1000, g * 1000 + size)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.verified(df, F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))).select(*MERKLE).collect()
    want = plain_manifest(rows, lambda r: r[1].replace("\n", "") if r[1] and r[0] % 2 == 0 else r[1])
    assert by_text(map(tuple, got)) == by_text(want)


def test_proofs_of_odd_rows(spark):
    rows = [tuple(r[:5]) for r in documents(spark).collect()]
    got = merkle.verified(documents(spark, clashing=True)).select(*MERKLE).collect()
    assert by_text(map(tuple, got)) == by_text(plain_manifest(rows)) and all(r.verified for r in got)
    assert merkle.verified(empty(spark)).count() == 0


def test_a_hundred_groups_have_a_tree_of_their_own(spark):
    rows = [(n, "x", None, f"é{n}" if n % 2 else f"z{n}", 1) for n in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert by_text(map(tuple, merkle.verified(df).select(*MERKLE).collect())) == by_text(plain_manifest(rows))


# Language


def plain_bundle(text, dimensions):
    out = np.zeros(dimensions)
    for word in re.findall(r"[^\W\d_]+", text or ""):
        codes = [0, *[ord(c.lower()[0]) for c in word], 0]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            v = [hyperprofiles.letter_vector(x, dimensions).astype(int) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
    return out


TEXTS = ["The cat, the hat!", "", None, "Über 3 Straßen", "a", "12 34", "x_y", "漢字 かな 漢字", "İstanbul Σας"]


@pytest.mark.parametrize("stretch", [1 << 20, 7, 4, 2])
def test_bundles_against_plain_version(monkeypatch, stretch):
    monkeypatch.setattr(hyperprofiles, "STRETCH", stretch)
    monkeypatch.setattr(hyperprofiles, "BOUND", 5)
    got = hyperprofiles.bundle(TEXTS, np.arange(len(TEXTS)), len(TEXTS), 256)
    for text, vector in zip(TEXTS, got, strict=True):
        assert (vector == plain_bundle(text, 256)).all(), text
    assert (hyperprofiles.bundle(TEXTS, np.zeros(len(TEXTS), int), 1, 256)[0] == sum(plain_bundle(t, 256) for t in TEXTS)).all()


def test_large_alphabets_and_long_words():
    text = "".join(chr(0x4E00 + (i * i) % 3000) for i in range(4000)) + " " + "ab" * 700_000
    assert hyperprofiles.bundle([text], np.zeros(1, int), 1, 64)[0].sum() == plain_bundle(text[:4000], 64).sum() + plain_bundle(text[4001:4401], 64).sum() + _middle(text[4001:], 400)


def _middle(word, known):
    """What the rest of a repeating word adds to the sum: its two inner runs, as often as they come more."""
    inner = plain_bundle("ab" * 3, 64).sum() - plain_bundle("ab" * 2, 64).sum()
    return inner * (len(word) - known) / 2


def test_languages_are_told_apart(spark):
    made = {"en": "the house and the garden with this thing", "de": "das haus und der garten mit diesem ding", "fr": "la maison et le jardin avec cette chose"}
    rows = [(i, " ".join(random.Random(i).choices(made[lang].split(), k=12)), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)]
    rows += [(500, None, "en"), (501, "", "en"), (502, "12 :-) 7", "de"), (None, made["fr"], None), (503, made["de"], None), (503, made["de"], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    got = hyperprofiles.identify(df, 1024)
    assert got.columns == ["doc_id", "text", "lang", "held_out", "lang_pred", "score"]
    for r in got.collect():
        assert 0 <= r.score <= 1 and (r.doc_id is None and r.held_out or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2))
        if not re.search(r"[^\W\d_]", r.text or ""):
            assert r.lang_pred == "und" and r.score == 0
        elif r.lang or r.doc_id in (None, 503):
            assert r.lang_pred == (r.lang or ("de" if r.doc_id else "fr"))
    again = hyperprofiles.identify(df.repartition(7, "text"), 1024)
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_nothing_of_the_held_out_rows_is_learnt(spark):
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "abc abd", "xx" if i in held else "en") for i in range(60)]
    got = hyperprofiles.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 256)
    assert {r.lang_pred for r in got.collect()} == {"en"}


def test_language_of_odd_rows(spark):
    assert hyperprofiles.identify(empty(spark)).count() == 0
    none = hyperprofiles.identify(documents(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)}
    odd = hyperprofiles.identify(documents(spark, clashing=True))
    assert odd.count() == documents(spark).count() and {"host", "tie", "lang_pred"} <= set(odd.columns)


def test_more_languages_than_a_task_holds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(hyperprofiles, "MOST_LANGUAGES", 2)
    df = spark.createDataFrame([(i, "ab", f"l{i}") for i in range(9)], "doc_id long, text string, lang string").coalesce(1)
    with pytest.raises(Exception, match="more than 2 languages"):
        hyperprofiles.learn(df, 64)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    right = hyperprofiles.identify(docs).where("held_out AND length(text) > 20").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


# Importance resampling


def plain_features(text, grams):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, [" ".join(words[i : i + n]) for n in range(1, grams + 1) for i in range(len(words) - n + 1)]


def plain_resampling(rows, target, grams, buckets, least, percent, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in plain_features(x, grams)[1]) for texts in ([r[1] for r in rows], target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        words, features = plain_features(text, grams)
        h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in features)
        out.append([doc_id, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    may = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    drawn = len(may) * percent // 100
    return [(*r, i + 1 if i < drawn else None) for i, r in enumerate(may)] + [(*r, None) for r in out if r[1] < least]


RESAMPLED = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize(("grams", "stretch"), [(1, 1 << 20), (1, 16), (2, 1 << 20), (3, 16)])
def test_resampling_against_plain_version(spark, monkeypatch, grams, stretch):
    monkeypatch.setattr(crc_ring, "STRETCH", stretch)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [(100 + i, f"Target words No{i} und Ähnliches" if i % 3 else "other things, mostly") for i in range(40)] * 2
    target = ["target WORDS", None, "", "ähnliches? No7-no8"]
    df, wanted = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    got = crc_ring.draw(crc_ring.weigh(df, wanted, grams, 97), 4, 30).select(*RESAMPLED).collect()
    assert by_text(map(tuple, got)) == by_text(plain_resampling(rows, target, grams, 97, 4, 30))


def test_states_go_on_over_stretches(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + "-" * 60 + "x" * 100 + "-" + "y" * 100
    whole = np.concatenate([s for _, s in crc_ring.states(text, 3)])
    monkeypatch.setattr(crc_ring, "STRETCH", 32)
    parts = list(crc_ring.states(text, 3))
    assert len(parts) > 20 and sum(n for n, _ in parts) == 502 and (np.concatenate([s for _, s in parts]) == whole).all()
    assert sorted(whole) == sorted(zlib.crc32(f.encode()) for f in plain_features(text, 3)[1])


def test_resampling_of_odd_rows(spark):
    target = spark.createDataFrame([], "text string")
    assert crc_ring.draw(crc_ring.weigh(empty(spark), target).drop("text")).count() == 0
    odd = crc_ring.draw(crc_ring.weigh(documents(spark, clashing=True), target).drop("text"))
    assert odd.count() == documents(spark).count() and {"row", "size", "tie", "rank"} <= set(odd.columns)
    with pytest.raises(ValueError, match="buckets"):
        crc_ring.gains(empty(spark), target, 1, 1 << 21)


@pytest.mark.parametrize("name", ["op11_merkle_proofs", "op13_crc_resampling"])
def test_whole_tables_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = con.execute(f"SELECT {', '.join(out.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert by_text(map(tuple, out.collect())) == by_text(want)
