"""The operators on documents against plain versions, and on the edge rows."""

import collections
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from edges import ROWS, documents, empty, prose
from pyspark.sql import functions as F

from lathe.llm import fair_mix, feistel, ngram_rules, packing, passage_mil, simhash
from lathe.llm.text import slices

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 0), (7, 0, 0), (8, 1, 0), (10, 0, None), (12, None, 0), (99, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


# op5


def test_mix_targets_fill_by_weight(spark):
    def targets(sizes):
        df = spark.createDataFrame(sizes, "source string, source_size long")
        return {r.source: r.target for r in fair_mix.source_targets(df).collect()}

    assert targets([("a", 100), ("b", 100), ("c", 100)]) == {"a": 50.0, "b": 100.0, "c": 150.0}
    got = targets([("a", 1000), ("b", 10), ("c", 10), (None, 0)])
    assert got["b"] == got["c"] == 30.0 and got[None] == 0.0 and math.isclose(got["a"], 960.0)


def test_mix_on_edges(spark):
    out = fair_mix.fair_queue(documents(spark, True)).collect()
    assert len(out) == len(ROWS) and "keep_key" in out[0].__fields__
    for r in out:
        assert r["size"] == len(WORD.findall(r.text or "")) and r.taken == r.times * r["size"] and 0 <= r.times <= 3
    assert sum(r.taken for r in out) <= sum(r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, fair_mix.fair_queue(documents(spark, True).repartition(5)).collect()))
    assert fair_mix.fair_queue(empty(spark)).count() == 0


def test_mix_comes_near_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 10 == 0], 0) for i in range(3000)]
    out = fair_mix.fair_queue(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    for r in out.groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.01 * r.target + 20


def plain_mix(rows, targets):
    """doc index to epochs taken, by sorting all items of all sources; rows: (doc_id, size, source). Each row has a place of its own; rows of one id and text are interchangeable."""
    md5 = lambda i: __import__("hashlib").md5(f"mix|{'null' if i is None else i}".encode()).hexdigest()
    text_hash = lambda n: int(np.uint64(xxhash.xxh64_intdigest("w " * n, 42)).astype(np.int64))
    total, items = collections.Counter(), []
    for s in {r[2] for r in rows}:
        own = sorted((md5(r[0]), text_hash(r[1]), k) for k, r in enumerate(rows) if r[2] == s and r[1])
        size, cum = sum(rows[k][1] for *_, k in own), 0
        for *_, k in own:
            cum += rows[k][1]
            items += [((e * size + cum) / targets[s], "unnamed" if s is None else f"s{s}", e, cum, k) for e in range(3)]
    upto, budget = 0, sum(r[1] for r in rows)
    for *_, k in sorted(items):
        upto += rows[k][1]
        if upto > budget:
            break
        total[k] += 1
    return total


@pytest.mark.parametrize("ids", ["NULL", "CAST(id % 2 AS BIGINT)", "id div 10"])
@pytest.mark.parametrize("text", ["repeat('word ', 100)", "concat(repeat('word ', 99), id)"])
def test_mix_comes_near_targets_whatever_the_ids(spark, ids, text):
    docs = spark.range(2000).selectExpr(f"CAST({ids} AS BIGINT) AS doc_id", f"{text} AS text", "'en' AS lang", "if(id % 2 = 0, 'a', 'b') AS source", "id AS n_chars")
    out = fair_mix.fair_queue(docs.repartition(3)).groupBy("source").agg(F.min("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert sum(r.taken for r in out) <= 200_000 and all(r.n == 1000 and abs(r.target - r.taken) <= 100 for r in out)


@pytest.mark.parametrize("digits", [1, 3])
def test_mix_against_plain_version(spark, digits):
    rng = np.random.default_rng(digits)
    sources = ["a", "a", "a", "b", "c", None, "d"]
    rows = [(int(rng.integers(0, 300)) if rng.random() < 0.8 else None, int(rng.integers(0, 6)), sources[rng.integers(7)]) for _ in range(900)]
    rows += [(1000 + i, 500, "big") for i in range(3)] + [(5, 3, "a")] * 40
    docs = spark.createDataFrame([(i, "w " * n, s, k) for k, (i, n, s) in enumerate(rows)], "doc_id long, text string, source string, mix_key long").withColumn("Mix_Plan", F.lit(1))
    out = fair_mix.fair_queue(docs.repartition(5), hex_digits=digits).collect()
    want = plain_mix(rows, {r.source: r.target for r in out})
    alike = lambda times: sorted((str(rows[k]), n) for k, n in times)
    assert alike((r.mix_key, r.times) for r in out) == alike((k, want[k]) for k in range(len(rows)))
    assert len(out) == len(rows) and all(r.taken == r.times * r["size"] for r in out) and {r.times for r in out} >= {0, 1, 2}


# op6


def counted(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rule_counts(spark, labels):
    extra = [(20, "a b c d e f g h " * 3 + "x\nx\n x\n\n#<&", "en", "a", 1), (21, "z " * 40, "en", "a", 1), (22, "1 2 3 4 5 6 7 8 9 1 2 3 4 5 6 7 8", "en", "a", 1)]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, documents(spark).schema))
    out = ngram_rules.judge(docs, labels).collect()
    assert len(out) == len(ROWS) + len(extra)
    texts = collections.defaultdict(list)
    for r in ROWS + extra:
        texts[r[0]].append(r[1])
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counted(texts[r.doc_id][0])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and (r.ratio is None) == (r.n_words == 0)
    assert ngram_rules.judge(empty(spark), labels).count() == 0
    assert ngram_rules.keep(documents(spark, True), labels).columns == documents(spark, True).columns


def plain_rules(rows, good, buckets, uniform=0.2, rejected=0.002):
    """(ratio of each row, threshold) by loops; good: the trusted ids."""

    def grams(text):
        h = [xxhash.xxh64_intdigest(w, 42) for w in (text or "").encode().split()]
        pair = lambda a, b: xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        return [x % buckets for x in h + [pair(a, b) for a, b in zip(h, h[1:], strict=False)]]

    def fold(i):
        x = xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)
        return (x - (1 << 64) if x >> 63 else x) % 5

    def table(target):
        probability = lambda n: (1 - uniform) * n / n.sum() + uniform / buckets
        return np.round(np.log(probability(target) / probability(raw)) * 10_000) if target.sum() else np.zeros(buckets)

    raw, folds, all_grams = np.zeros(buckets), np.zeros((5, buckets)), [grams(r[1]) for r in rows]
    for r, g in zip(rows, all_grams, strict=True):
        np.add.at(raw, g, 1)
        if r[0] in good:
            np.add.at(folds[fold(r[0])], g, 1)
    full = table(folds.sum(axis=0))
    less = [table(folds.sum(axis=0) - folds[k]) for k in range(5)]
    passed = [i for i, r in enumerate(rows) if len((r[1] or "").split()) >= 20 and 100 * counted(r[1])[4] <= 30 * counted(r[1])[0]]
    scores = sorted(math.floor(less[fold(rows[i][0])][all_grams[i]].mean() / 10_000 * 1000) for i in passed if rows[i][0] in good)
    least = max((s for s in scores if sum(x < s for x in scores) <= rejected * len(scores)), default=None)
    return [full[g].mean() / 10_000 if g else None for g in all_grams], least


def test_ratio_against_plain_version(spark, labels):
    rng = np.random.default_rng(1)
    rows = [*ROWS, *[(100 + i, " ".join(f"w{int(x)}" for x in rng.geometric(0.02 + 0.02 * (i % 3 == 0), 30 + i)), "en", "a", 1) for i in range(60)]]
    rows += [(200 + i, " ".join(f"q{int(x)}" for x in rng.integers(0, 9, 60)), "en", "a", 1) for i in range(8)]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    ids = [1, 2, 6, 8, *range(100, 140)]
    named = labels.where("quality = 0").unionByName(spark.createDataFrame([(i, 1, 0) for i in ids], labels.schema))
    want, least = plain_rules(rows, set(ids), 64, rejected=0.1)
    got = sorted(map(tuple, ngram_rules.judge(docs, named, 0.1, buckets=64).select("doc_id", "text_hash", "ratio", "kept", "base_failed").collect()), key=str)
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    by = {(r[0], hashed[r[1]]): w for r, w in zip(rows, want, strict=True)}
    assert len(got) == len(rows) and {False, True} == {g[3] for g in got if not g[4]}
    for i, h, ratio, kept, failed in got:
        assert (ratio is None) == (by[i, h] is None) and (ratio is None or abs(ratio - by[i, h]) < 1e-9)
        assert kept == (not failed and ratio >= least / 1000)


def test_verdicts_hang_on_shares_alone(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    once = {r.doc_id: (r.ratio, r.kept) for r in ngram_rules.judge(docs, labels).collect()}
    twice = ngram_rules.judge(docs.unionByName(docs), labels.unionByName(labels)).collect()
    assert len(twice) == 2 * len(once) and all((r.ratio, r.kept) == once[r.doc_id] for r in twice)


def test_target_counts_every_trusted_document(spark):
    n = 24_000
    labels = spark.range(2 * n).selectExpr("id AS doc_id", "CAST(id < %d AS INT) AS quality" % n)
    ids = ngram_rules.trusted(labels.unionByName(labels))
    assert ids.count() == n
    docs = spark.range(2 * n).selectExpr("nullif(id, 0) AS doc_id", "'w' || id AS text")
    got = {r.bucket: r.ratio for r in ngram_rules.ratios(docs, ngram_rules.trusted_docs(docs, ids), buckets=2).collect()}
    buckets = [xxhash.xxh64_intdigest(f"w{i}", 42) % 2 for i in range(2 * n)]
    raw, good = np.bincount(buckets, minlength=2), np.bincount(buckets[1:n], minlength=2)
    assert good.sum() == n - 1
    want = np.log((0.8 * good / good.sum() + 0.1) / (0.8 * raw / raw.sum() + 0.1))
    assert all(abs(got[b] - 1e4 * want[b]) <= 0.51 for b in (0, 1))


def test_rules_without_trusted_documents(spark, labels):
    out = ngram_rules.judge(documents(spark), labels.where("false")).collect()
    assert all(r.kept != r.base_failed and r.ratio in (0, None) for r in out) and any(r.kept for r in out)
    clash = documents(spark, True).withColumns({"_h1": F.lit(1), "ratio": F.lit(2), "_doc": F.lit(3), "n_words": F.lit(4), "_row": F.lit(5)})
    kept = ngram_rules.keep(clash, labels)
    assert kept.columns == clash.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in ngram_rules.judge(clash, labels).where("kept").collect())


def test_rules_keep_clean_and_drop_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = ngram_rules.judge(docs, labels).where("NOT base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    kept = {r.quality: r.k for r in out.collect()}
    assert kept[1] > 0.99 and kept[0] < 0.1


# op2


def test_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = passage_mil.classify(docs, labels).select("doc_id", "held_out", "score", "predicted").join(labels, "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 40 and np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_classifier_edges(spark, labels):
    out = passage_mil.classify(documents(spark, True), labels).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    one, two = (r.score for r in out if r.doc_id == 10)
    assert one == two
    assert passage_mil.classify(empty(spark), labels).count() == 0
    nothing = passage_mil.classify(documents(spark), labels.where("false"))
    assert {r.score for r in nothing.collect()} == {0.5}


def test_encoding_does_not_hang_on_company():
    texts = [r[1] for r in ROWS]
    together, counts = passage_mil.encode(texts)
    alone = [passage_mil.encode([t])[0] for t in texts]
    assert [len(a) for a in alone] == list(counts) and np.allclose(together, np.concatenate(alone))
    assert len(passage_mil.encode(["w " * 130])[0]) == 3


def plain_scores(w, x, counts):
    """The score of each bag by loops over its passages, and the mean log loss with its penalty given labels."""
    out, at = [], 0
    for n in counts:
        h = [np.tanh(row @ w["W"] + w["b"]) for row in x[at : at + n]]
        e = [float(np.sum(w["a"] * np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"]))))) for v in h]
        share = [math.exp(v) / sum(map(math.exp, e)) for v in e]
        z = sum(s * v for s, v in zip(share, h, strict=True))
        out.append(1 / (1 + math.exp(-float(z @ w["c"] + w["d"][0]))))
        at += n
    return np.array(out)


def test_attention_forward_and_gradient():
    rng = np.random.default_rng(0)
    x, counts, y = rng.normal(size=(60, 5)), np.array([1, 2, 3] * 10), (np.arange(30) % 2).astype(float)
    w = {k: v.astype(float) + rng.normal(0, 0.2, v.shape) for k, v in passage_mil.start_weights(5, 4, 3).items()}
    assert np.allclose(passage_mil.forward(w, x, counts)[5], plain_scores(w, x, counts))

    def loss(w):
        p = plain_scores(w, x, counts)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) + 0.05 * (np.sum(w["W"] ** 2) + np.sum(w["c"] ** 2))

    for k, grad in passage_mil.gradients(w, x, counts, y, 0.1).items():
        for place in np.ndindex(w[k].shape):
            step = [{**w, k: w[k].copy()} for _ in range(2)]
            step[0][k][place] += 1e-5
            step[1][k][place] -= 1e-5
            assert abs((loss(step[0]) - loss(step[1])) / 2e-5 - grad[place]) < 1e-7
    x[np.cumsum(counts) - 1, 0] += 3 * (2 * y - 1)
    model = passage_mil.fit(x, counts, y, steps=150)
    assert np.mean((model.scores(x, counts) > 0.5) == y) > 0.9


def test_what_is_learnt_from_is_bounded(spark, labels, monkeypatch):
    rows = [(i, prose(i, 64 * 300), "en", "a", 1) for i in (6, 7)] + [(6, prose(6, 64 * 300), "en", "a", 1)] * 30 + [(1, "x y", "en", "a", 1)]
    seen = []
    monkeypatch.setattr(passage_mil, "fit", lambda x, counts, y: seen.append((counts.tolist(), y.tolist())))
    passage_mil.learn(spark.createDataFrame(rows, documents(spark).schema), labels, passages=10)
    usable = [i for i in (1, 6, 7) if zlib.crc32(str(i).encode()) % 5]
    assert seen == [([{1: 1}.get(i, 10) for i in usable], [float(i != 7) for i in usable])]


def test_long_texts_are_encoded_in_stretches(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(3000))
    whole, counts = passage_mil.encode([text, "a b"])
    monkeypatch.setattr(passage_mil, "STRETCH", 2000)
    cut, parts = passage_mil.encode([text, "a b", "x" * 9000])
    assert counts[0] == 47 and parts[0] >= counts[0] and parts[2] == 5 and len(cut) == sum(parts)
    words = lambda x, n: sum(np.expm1(4 * row[-1]) for row in x[:n])
    assert round(words(whole, counts[0])) == round(words(cut, parts[0])) == 3000


# op10


def test_fingerprint_by_hand():
    text = "Ab  cd\nEF gh ab CD ef"
    words = re.findall("[^\x20\x09-\x0d]+", text.lower())
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("x y") == xxhash.xxh64_intdigest("x y", 42) and simhash.fingerprint(None) == simhash.fingerprint(" ") == 0


def brute_components(fps):
    values = sorted(set(fps))
    up = {v: v for v in values}

    def find(v):
        while up[v] != v:
            v = up[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    return {v: find(v) for v in values}


@pytest.mark.parametrize("direct", [64, 3])
def test_links_and_components(spark, monkeypatch, direct):
    monkeypatch.setattr(simhash, "DIRECT", direct)
    rng = np.random.default_rng(4)
    values = {int(v) for v in rng.integers(0, 1 << 63, 40)}
    for v in list(values)[:12]:
        for _ in range(8):
            w = v
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                w ^= 1 << int(b)
            values.add(w)
            v = w if rng.random() < 0.5 else v
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    want = {(max(a, b), min(a, b)) for a in signed for b in signed if a != b and (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= 3}
    assert {(r.a, r.b) for r in edges.collect()} == want and len(want) > 40
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    groups = brute_components(values)
    by_brute, by_ours = collections.defaultdict(set), collections.defaultdict(set)
    for v in values:
        s = v - (1 << 64) if v >> 63 else v
        by_brute[groups[v]].add(s)
        by_ours[roots.get(s, s)].add(s)
    assert sorted(map(sorted, by_brute.values())) == sorted(map(sorted, by_ours.values()))


def broadcast(df):
    """What the planner broadcasts in df, each with all below it, before anything has run."""
    found = []

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.initialPlan())
        if node.getClass().getSimpleName() == "BroadcastExchangeExec":
            found.append(node.toString())
        return [walk(node.children().apply(i)) for i in range(node.children().size())]

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_no_side_that_an_explode_has_grown_is_broadcast(spark, monkeypatch):
    """The planner takes such a side for as large as the table below, so one that fits below the limit came to fill the driver."""
    written = []
    monkeypatch.setattr(simhash, "materialise", lambda df, name, real=simhash.materialise: (written.append((name, broadcast(df))), real(df, name))[1])
    many = spark.range(400).select(F.xxhash64("id").alias("fp"))
    sides = broadcast(simhash.links(many))
    wide = many.select(F.col("fp").alias("id"), *[F.xxhash64("fp", F.lit(k)).alias(f"f{k}") for k in range(2)])
    simhash.similar(wide, 20, 2, 12).collect()
    assert {"simhash-neighbours", "simhash-members", "simhash-targets"} <= {name for name, _ in written}
    assert not [x for x in sides + [x for _, some in written for x in some] if "Generate explode" in x]
    assert any(some for _, some in written)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_near_duplicates_on_edges(spark):
    out = simhash.near_duplicates(documents(spark, True)).collect()
    assert len(out) == len(ROWS)
    by = {r.doc_id: r for r in out}
    assert by[1].component_id == by[2].component_id == 1 and by[3].component_id == by[4].component_id == by[5].component_id == 3
    assert by[3].fingerprint == "0" * 16 and by[None].component_id is None
    assert simhash.near_duplicates(empty(spark)).count() == 0
    kept = simhash.keep_one(documents(spark, True))
    assert kept.columns == documents(spark, True).columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({r.component_id or -1 for r in out})


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    one, two, three, four = (prose(s, 60) for s in (1, 4, 9, 16))
    rows = [(None, one), (None, two), (None, two), (7, one + " tail"), (7, three), (7, three), (8, three), (9, four), (7, four), (None, None), (None, ""), (10, prose(25, 60)), (10, prose(36, 60))]
    docs = spark.createDataFrame([(i, text, "en", "a", n) for n, (i, text) in enumerate(rows)], documents(spark).schema)
    fps = {text: simhash.fingerprint(text) for _, text in rows}
    groups = brute_components(fps.values())
    kept = simhash.keep_one(docs.repartition(3)).collect()
    assert sorted(groups[fps[r.text]] for r in kept) == sorted(set(groups.values()))
    for r in kept:
        ids = [i for i, text in rows if groups[fps[text]] == groups[fps[r.text]]]
        assert r.doc_id == min((i for i in ids if i is not None), default=None) and (r.doc_id, r.text) == rows[r.n_chars]
    assert len(kept) > 6 and sum(r.doc_id is None for r in kept) == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_groups_against_brute_force(spark, seed):
    """Words of 64 bits, segments of 12: families that hang together by chains, with most links not through a smallest id."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(14):
        x = rng.integers(0, 1 << 63, 2, dtype=np.uint64)
        for _ in range(12):
            y = x.copy()
            for b in rng.choice(128, rng.integers(1, 16), replace=False):
                y[b // 64] ^= np.uint64(1 << int(b % 64))
            rows.append(y)
            x = y if rng.random() < 0.4 else x
    rows = list({tuple(map(int, r)): r for r in rows}.values())
    cut = lambda r: [(int(w) >> h) & 0xFFF for w in r for h in (0, 32)]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    linked = 0
    for i in range(len(rows)):
        for j in range(i):
            near = any((p ^ q).bit_count() <= 1 for p, q in zip(cut(rows[i]), cut(rows[j]), strict=True))
            if near and sum(int(p ^ q).bit_count() for p, q in zip(rows[i], rows[j], strict=True)) <= 12:
                linked += 1
                up[find(i)] = find(j)
    signed = lambda v: int(v) - (1 << 64) if int(v) >> 63 else int(v)
    ids = [int(i) for i in rng.permutation(len(rows))]
    classes = spark.createDataFrame([(ids[i], signed(r[0]), signed(r[1])) for i, r in enumerate(rows)], "id long, f0 long, f1 long")
    roots = {r.node: r.root for r in simhash.similar(classes, 12, words=2, segment=12).collect()}
    ours, brute = collections.defaultdict(set), collections.defaultdict(set)
    for i, own in enumerate(ids):
        ours[roots.get(own, own)].add(own)
        brute[find(i)].add(own)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, brute.values())) and len(rows) > len(brute) + 20 and linked > 100


def test_minwise_fingerprint_by_hand():
    text = "Ab  cd\nEF gh ab CD ef gh AB cd"
    words = text.lower().split()
    hashes = {xxhash.xxh32_intdigest(" ".join(words[i : i + 5]), 42) for i in range(len(words) - 4)}
    found = simhash.shingle_set(text)
    assert sorted(hashes) == found.tolist() and len(hashes) < len(words) - 4
    factor, mask = simhash._permutations(6)
    least = [min(((h ^ int(m)) * int(f)) & 0xFFFFFFFF for h in hashes) for f, m in zip(factor, mask, strict=True)]
    bits = [((x * 0x9E3779B1) & 0xFFFFFFFF) >> 31 for x in least]
    want = [sum(bits[64 * w + b] << b for b in range(64)) for w in range(6)]
    assert [int(w) for w in simhash.minwise_fingerprint(found)] == want
    assert not simhash.minwise_fingerprint(simhash.shingle_set(None)).any() and simhash.minwise_fingerprint(simhash.shingle_set("x")).any()
    for some in (found, found[:1], found[:0], np.unique(np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype="u4"))):
        assert (simhash._unpacked(simhash._packed(some)) == some).all()


def shingles_of(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_pairs_at_the_threshold(spark):
    """Of 300 pairs in each band of similarity from 0.8 on 0.95 lose one at least, and of those below none: every link is verified."""
    rng, bands = np.random.default_rng(9), {(0.7, 0.8): [], (0.8, 0.825): [], (0.825, 0.85): [], (0.85, 0.9): []}
    rows, n = [], 0
    while any(len(v) < 300 for v in bands.values()):
        text = [f"w{x}" for x in rng.integers(0, 100_000, 200)]
        other = list(text)
        for at in rng.choice(200, rng.integers(1, 9), replace=False):
            other[at] = f"v{n}"
        one, two = (shingles_of(" ".join(t)) for t in (text, other))
        alike = len(one & two) / len(one | two)
        band = next((b for b in bands if b[0] <= alike < b[1]), None)
        if band and len(bands[band]) < 300:
            bands[band].append(n)
            rows += [(n, " ".join(text)), (n + 1, " ".join(other))]
            n += 2
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows if i % 2 == 0} <= kept
    for band, firsts in bands.items():
        gone = sum(i + 1 not in kept for i in firsts) / len(firsts)
        assert gone == 0 if band[1] <= 0.8 else gone >= 0.95, (band, gone)


def test_groups_of_near_copies_against_brute_force(spark):
    """Families of hundreds that hang together by verified links: one of each stays, and none that no link reaches goes."""
    rng, rows = np.random.default_rng(4), []
    for family in range(4):
        text = [f"f{family}w{x}" for x in rng.integers(0, 400, 120)]
        for _ in range(120):
            own = list(text)
            for at in rng.choice(120, rng.integers(0, 4), replace=False):
                own[at] = f"x{rng.integers(0, 9)}"
            rows.append(" ".join(own))
            text = own if rng.random() < 0.1 else text
    sets, up = [shingles_of(t) for t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    groups = {find(i) for i in range(len(rows))}
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)).collect()}
    assert groups <= kept and len(kept - groups) <= 0.02 * len(groups) and len(groups) < len(rows) / 4


def test_texts_just_below_the_threshold_are_not_listed_by_pairs(spark, monkeypatch):
    """Half of a family are alike to its first text, half just aren't: what is asked grows with the rows, not with their pairs."""
    rng, words, asked = np.random.default_rng(8), [f"w{x}" for x in range(150)], []
    rows = [" ".join(words)]
    for i in range(400):
        own = list(words)
        for at in rng.choice(np.arange(5, 145, 6), 1 if i % 2 else 4, replace=False):
            own[at] = f"x{rng.integers(0, 10**6)}"
        rows.append(" ".join(own))
    plain = simhash.materialise

    def told(df, name, by=()):
        out = plain(df, name, by)
        asked.extend([out.count()] if name == "simhash-asked" else [])
        return out

    monkeypatch.setattr(simhash, "materialise", told)
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(5)).collect()}
    sets, groups = [shingles_of(t) for t in rows], {0}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    for i, some in enumerate(sets[1:], 1):
        if not any(alike(some, other) for other in sets[:i]):
            groups.add(i)
    assert groups <= kept and len(kept - groups) <= 2 and len(groups) > 150
    assert 0 < sum(asked) < 8 * len(rows), asked


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_likely_links_lose_none(spark, similarity):
    """Members that share changes, some alike to the centre, some to each other alone, some to none; roots as stars might leave them."""
    rng, rows = np.random.default_rng(5), []
    for family in range(6):
        base = {int(x) for x in rng.choice(10**6, [1, 3, 9, 40, 40, 90][family], replace=False)}
        other = {x for x in base if rng.random() < 0.7} | {int(x) for x in rng.choice(10**6, len(base) // 4)}
        shared = [int(x) for x in rng.choice(10**6, 12)]
        for _ in range(40):
            own = set(base if rng.random() < 0.6 else other)
            own -= set(rng.choice(sorted(own), rng.integers(0, 1 + len(own) // 5), replace=False).tolist())
            own |= set(rng.choice(shared, rng.integers(0, 6)).tolist()) | {int(x) for x in rng.choice(10**6, rng.integers(0, 1 + len(base) // 6))}
            if own not in [r[3] for r in rows]:
                rows.append((len(rows), family, len(rows), own))
    alike = {(a[0], b[0]) for a in rows for b in rows if a[0] > b[0] and a[1] == b[1] and len(a[3] & b[3]) / len(a[3] | b[3]) >= similarity}
    first = {a: b for a, b in sorted(alike) if rng.random() < 0.2}
    roots = {}
    for i in range(len(rows)):
        roots[i] = roots[first[i]] if i in first else i
    sets = spark.createDataFrame([(i, f, sum(r[1] == f for r in rows), roots[i], sorted(own)) for i, f, _, own in rows], "id long, family long, of long, root long, items array<int>")
    links, pairs = simhash.likely(sets, similarity)
    up = {i: i for i in range(len(rows))}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links.collect():
        up[find(a)] = find(b)
    assert all(find(r.root) != find(r.to_root) for r in pairs.collect())
    told = {(r.a, r.b) for r in pairs.collect()}
    assert all((a, b) in told or find(roots[a]) == find(roots[b]) for a, b in alike)
    assert len(alike) > 100 and any((a, b) in told for a, b in alike) and len(told) < 0.6 * 6 * 40 * 39 / 2


def test_near_copies_by_shingles_go(spark):
    """Of copies with a Jaccard similarity of five-word shingles from 0.85 on nine in ten go at least; unlike texts all stay."""
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows, near = [], 0
    for i in range(60):
        text = list(rng.choice(vocabulary, 200))
        rows.append((2 * i, " ".join(text)))
        for at in rng.choice(200, 1 + i % 3, replace=False):
            text[at] = "changed"
        rows.append((2 * i + 1, " ".join(text)))
        near += 1
    half = list(rng.choice(vocabulary, 200))
    rows += [(1000 + i, " ".join([*half[:60], *rng.choice(vocabulary, 140)])) for i in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], documents(spark).schema)
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert {2 * i for i in range(60)} <= kept and {1000 + i for i in range(10)} <= kept
    assert len(kept) - 70 <= 6


# op7


@pytest.mark.parametrize("unit", [" ", "\n", " \n\t"])
def test_long_white_space_is_encoded(unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of = packing.encoder(*packing.public_vocabulary(), added=packing.public_added())
    space = (unit * 2_000_000)[:2_000_000]
    for text in (space, f"it's{space}9 x", f"{space[:1001]}<|endoftext|>{space[:1000]} y <|endoftext|>", f"a{space[:999]}b{space[:1000]}c  d"):
        assert np.frombuffer(of(text), "u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    docs = documents(spark, True).unionByName(spark.createDataFrame([(30, "it's <|endoftext|> 12 345\r\n\tx  \n y ", "en", "a", 1)], documents(spark).schema), allowMissingColumns=True)
    pieces = packing.pack(docs, window=100).collect()
    texts = collections.defaultdict(list)
    for i, text, *_ in [*ROWS, (30, "it's <|endoftext|> 12 345\r\n\tx  \n y ")]:
        texts[i].append(np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4"))
    whole, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        ids = texts[p.doc_id][0]
        assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        whole[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert {i: sum(n for _, n in v) for i, v in whole.items()} == {i: sum(map(len, t)) for i, t in texts.items()}
    for i, spans in sequences.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 100 or i == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack(empty(spark)).count() == 0


class _Task:
    """Stands for a table; gives back the function of its tasks."""

    def select(self, *columns):
        return self

    def mapInArrow(self, over, schema):  # noqa: N802
        return over


def test_tasks_of_packing_hand_on_parts_of_a_batch(spark):
    texts = ["", None, "word " * 300_000, *(prose(n, 1000) for n in range(200))] * 5
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "part": pa.array([3] * len(texts), pa.int32())})
    parts = list(packing.tokenise(_Task())(iter([batch, batch.slice(7, 400), batch.slice(0, 0)])))
    assert [i for b in parts for i in b.column("doc_id").to_pylist()] == [*range(len(texts)), *range(7, 407)]
    assert max(b.nbytes for b in parts) < 1 << 20 and all(b.column("part").unique().to_pylist() == [3] for b in parts)
    sizes = [len(x) // 2 for b in parts for x in b.column("ids").to_pylist()]
    assert [x for b in parts for x in b.column("at").to_pylist()] == [sum(sizes[:i]) for i in range(len(sizes))]


def test_slices_are_bounded_and_whole():
    batch = pa.RecordBatch.from_pydict({"n": list(range(6)), "x": ["aaa", None, "a", "aaaaaaaaa", "", "aa"]})
    assert [s.column("n").to_pylist() for s in slices(batch, "x", 4)] == [[0, 1, 2], [3], [4, 5]]
    assert [s.column("n").to_pylist() for s in slices(batch.slice(1), "x", 100)] == [[1, 2, 3, 4, 5]] and list(slices(batch.slice(0, 0), "x", 4)) == []


@pytest.mark.parametrize("stage", ["op7_concat_pack", "pipeline"])
def test_added_tokens_are_found_as_the_tokenizer_finds_them(spark, tmp_path, stage):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    from lathe.llm import queries

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "it's  x\n<|endoftext|><|endoftext|>\t y", "<|endoftext|", "z " * 50 + "q<|endoftext|>é  ", "plain"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], documents(spark).schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    run = queries.QUERIES[stage](spark, str(tmp_path)) if stage in queries.QUERIES else corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in run.collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (50256 in ids) == ("<|endoftext|>" in t)
        if got[i][0] == len(ids) < 2048:
            assert got[i][1] == zlib.crc32(ids.tobytes())
        assert got[i][0] == len(ids)


# op8


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 65, 1000])
def test_permutation(n):
    got = feistel.permute(np.arange(n), n, seed=3)
    assert sorted(got) == list(range(n))
    assert int(feistel.permute(np.array([n - 1]), n, seed=3)[0]) == got[-1], "a row's place is computable alone"


def test_shards_on_edges(spark):
    out = feistel.shard(documents(spark, True), shards=4).collect()
    again = feistel.shard(documents(spark, True).repartition(7), shards=4).collect()
    key = lambda rows: sorted((str(r.doc_id), r.shard, r.slot) for r in rows)
    assert key(out) == key(again)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(out) == len(ROWS)
    assert feistel.shard(empty(spark)).count() == 0


def plain_place(row, total, seed):
    """One row's place by whole numbers, round by round."""
    full = (1 << 64) - 1
    half = max(1, ((max(total, 2) - 1).bit_length() + 1) // 2)

    def mix(x, key):
        x = ((x + key) * 0x9E3779B97F4A7C15) & full
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & full
        return x ^ (x >> 32)

    while True:
        left, right = divmod(row, 1 << half)
        for r in range(6):
            left, right = right, left ^ (mix(right, seed * 6 + r + 1) % (1 << half))
        row = (left << half) + right
        if row < total:
            return row


@pytest.mark.parametrize("seed", [0, 5])
def test_shards_against_plain_version(spark, seed):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    out = {r.doc_id: r for r in feistel.shard(docs.repartition(6), shards=7, seed=seed).collect()}
    rows = sorted((r.doc_id, len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in docs.collect())
    assert len(out) == len(rows) > 150
    for number, (doc_id, size, crc) in enumerate(rows):
        slot, shard = divmod(plain_place(number, len(rows), seed), 7)
        assert (out[doc_id].shard, out[doc_id].slot, out[doc_id]["size"], out[doc_id].text_crc32) == (shard, slot, size, crc)
