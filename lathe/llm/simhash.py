"""SimHash near-duplicates: one-wildcard segment variants find fingerprints that are close, stars find the groups.

near_duplicates() links 64-bit fingerprints within three bits, exactly; keep_one() finds pairs by longer ones and verifies their sets of shingles.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from lathe.llm.text import fresh
from lathe.session import discard, materialise, materialise_at

#: Words in a shingle, seed of its hash, bits that linked fingerprints may differ in.
SHINGLE, SEED, BITS_APART = 3, 42, 3
#: Fingerprints with one value of a half up to which they are compared directly; beyond, rows of a salt of a hot value.
DIRECT, SPLIT = 64, 4096
#: Values of a segment meet by chance in proportion to rows ** 2 / 2 ** SEGMENT: give it about six bits more than the logarithm of the rows, and as many words as segments() says.
#: keep_one(): words in a shingle, least similarity (Jaccard, of the sets of shingles), 64-bit words of its fingerprint, bits of each half of these that are indexed.
WIDE_SHINGLE, SIMILARITY, WORDS, SEGMENT = 5, 0.8, 6, 24


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64 bits, unsigned: a bit is 1 if set in over half of the hashes of the shingles of a text, repeats included."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    grams = zip(*(tokens[i:] for i in range(shingle)), strict=False) if len(tokens) >= shingle else [tokens]
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), seed) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[start : start + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


@functools.cache
def _permutations(words: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of 64 * words bits an odd factor and a mask of 32 bits, from a hash, so that every task has the same."""
    raw = np.frombuffer(hashlib.shake_256(f"{SEED}".encode()).digest(512 * words), dtype="<u4").reshape(2, -1)
    return raw[0] | np.uint32(1), raw[1]


def shingle_set(text: str | None, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes of 32 bits; none for a wordless one, the whole for one of fewer words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype="<u4")
    grams = zip(*(tokens[i:] for i in range(shingle)), strict=False) if len(tokens) >= shingle else [tokens]
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(b" ".join(g), SEED) for g in grams), dtype="<u4"))


def minwise_fingerprint(shingles: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64 * words bits as unsigned 64-bit words: each is one bit of the least of all shingles' hashes under a permutation of its own.

    Bits of two texts are equal where the least is a shared shingle, which has the probability of their Jaccard similarity, and else by chance.
    """
    if not len(shingles):
        return np.zeros(words, dtype="<u8")
    factor, mask = _permutations(words)
    least = np.full(64 * words, 0xFFFFFFFF, dtype="<u4")
    for start in range(0, len(shingles), 1 << 10):
        some = (shingles[start : start + (1 << 10), None] ^ mask) * factor
        np.minimum(least, some.min(axis=0), out=least)
    # The least hash is small: a bit that all of its bits decide is one of its product's upper half.
    return np.packbits(((least * np.uint32(0x9E3779B1)) >> np.uint32(31)).astype(np.uint8), bitorder="little").view("<u8")


def _packed(shingles: np.ndarray) -> bytes:
    """A sorted set as its differences, byte by byte of all, so that high zero bytes compress."""
    return np.diff(shingles, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def _minwise(shingle: int, words: int):
    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            sets, bits = [], []
            for text in texts:
                found = shingle_set(text.as_py(), shingle)
                sets.append(_packed(found))
                bits.append(minwise_fingerprint(found, words))
            flat = np.concatenate(bits).view("<i8") if bits else np.zeros(0, "<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1) * words, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.StructArray.from_arrays([lists, pa.array(sets, pa.binary())], names=["fp", "shingles"])

    return over


def _jaccard(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for ones, twos in batches:
        out = np.zeros(len(ones))
        for i, (a, b) in enumerate(zip(ones.to_pylist(), twos.to_pylist(), strict=True)):
            one, two = _unpacked(a), _unpacked(b)
            both = np.sort(np.concatenate([one, two]))
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = shared / (len(both) - shared) if len(both) else 1.0
        yield pa.array(out)


def bits_apart(similarity: float, bits: int) -> int:
    """Bits within which the fingerprints of all but some 3 in 100,000 pairs of this similarity are: four deviations over the mean."""
    p = (1 - similarity) / 2
    return math.ceil(bits * p + 4 * math.sqrt(bits * p * (1 - p)))


def segments(width: int, similarity: float = SIMILARITY, recall: float = 0.98) -> int:
    """Segments of `width` bits of which one differs by one bit at most for this share of the pairs of this similarity."""
    p = (1 - similarity) / 2
    one = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    return math.ceil(math.log(1 - recall) / math.log(1 - one))


def _fingerprints(shingle: int, seed: int):
    def over(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t, shingle, seed) for t in texts.to_pylist()], dtype="<u8").view("<i8"), pa.int64())

    return over


def with_fingerprint(docs: DataFrame, column: str = "fingerprint", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs with the fingerprint of text as a signed long."""
    return docs.withColumn(column, F.arrow_udf(_fingerprints(shingle, seed), "long")(F.col("text")))


def _wiped(value: str, width: int, one: int) -> Column:
    """Index keys of a segment's value with one bit wiped, for each bit that is `one`: bit number above, what is left below."""
    return F.explode(F.expr(f"transform(filter(sequence(0, {width - 1}), b -> (shiftright({value}, b) & 1) = {one}), b -> (CAST(b AS BIGINT) << 32) | ({value} & ~(1L << b)))"))


def neighbours(values: DataFrame, width: int) -> DataFrame:
    """(side, low, high, low_n, high_n): pairs of values of a segment that are equal or differ in one bit.

    values: side (which segment), value (of `width` bits) and n (how many fingerprints have it), one row each. A value is
    indexed once for each of its bits, with that bit wiped; values that had a 0 there meet by equality those that had a 1. An entry has
    one of each at most, so no key is hot however many fingerprints share a value.
    """
    zero, one = (values.select("side", _wiped("value", width, bit).alias("key"), F.col("n").alias(name)) for bit, name in ((0, "low_n"), (1, "high_n")))
    wiped = F.col("key").bitwiseAND(F.lit((1 << 32) - 1))
    # Both sides are many rows for each of values, by whose size the planner would broadcast one.
    apart = zero.hint("merge").join(one, ["side", "key"]).select("side", wiped.alias("low"), F.expr("(key & 4294967295L) | (1L << CAST(shiftright(key, 32) AS INT))").alias("high"), "low_n", "high_n")
    same = values.where("n > 1").select("side", F.col("value").alias("low"), F.col("value").alias("high"), F.col("n").alias("low_n"), F.col("n").alias("high_n"))
    return apart.unionByName(same)


def _parts() -> Column:
    """32 keys of the other half: its quarters with each bit wiped, for pairs of values that many fingerprints have."""
    other = "shiftrightunsigned(fp, 32 * (1 - side)) & 4294967295L"
    one = f"(CAST(v AS BIGINT) << 16) | (shiftrightunsigned({other}, 16 * (v DIV 16)) & 65535L & ~(1L << (v % 16)))"
    return F.explode(F.expr(f"transform(sequence(0, 31), v -> {one})"))


def links(fingerprints: DataFrame) -> DataFrame:
    """All pairs (a > b) of distinct fingerprints (one row each, column fp) that differ in BITS_APART bits or fewer.

    Of three differing bits one half has one at most, so the one-wildcard index of that half brings both values together
    (neighbours()); only then fingerprints meet. Pairs of values that over DIRECT fingerprints share on a side are indexed again by the
    other half's quarters, of which again one differs by one bit at most, and one side is salted by its number. No pair is lost and
    none is listed unverified.
    """
    halves = fingerprints.select("fp", F.explode(F.expr("array(struct(0 AS side, fp & 4294967295L AS value), struct(1 AS side, shiftrightunsigned(fp, 32) AS value))")).alias("h")).select("fp", "h.*")
    values = materialise(halves.groupBy("side", "value").agg(F.count("*").alias("n")), "simhash-values")
    near = materialise(neighbours(values, 32).withColumn("most", F.greatest("low_n", "high_n")), "simhash-neighbours")

    def members(pairs: DataFrame, end: str, name: str) -> DataFrame:
        # Not by the planner's size of halves, which leaves out that a fingerprint has two and what Parquet packs.
        return pairs.withColumn("value", F.col(end)).join(halves.hint("merge"), ["side", "value"]).withColumnRenamed("fp", name).drop("value")

    few = near.where(F.col("most") <= DIRECT).select("side", "low", "high")
    direct = members(members(few, "low", "a"), "high", "b")
    many = near.where(F.col("most") > DIRECT).select("side", "low", "high", (1 + F.floor(F.col("most") / SPLIT)).cast("int").alias("salts"))
    one, two = (members(many, end, "fp").select("side", "low", "high", "salts", "fp", _parts().alias("part")) for end in ("low", "high"))
    left = one.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int")).drop("salts").withColumnRenamed("fp", "a")
    right = two.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts").withColumnRenamed("fp", "b")
    again = left.hint("merge").join(right, ["side", "low", "high", "part", "salt"])
    close = (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS_APART) & ((F.col("low") != F.col("high")) | (F.col("a") > F.col("b")))
    found = [df.where(close).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")) for df in (direct, again)]
    return found[0].unionByName(found[1]).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges with a > b to (node, root): every node of an edge with the smallest node it reaches.

    Alternates large-star and small-star steps until nothing changes, a logarithmic number of rounds. Each round is written
    to the shared scratch folder. Minima are aggregated map-side before they are joined back; where a hub's edges meet its
    minimum, Spark's skew join splits them.
    """
    spark = edges.sparkSession
    mark = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    now, path = materialise_at(edges, "simhash-edges")
    was = None
    while (state := tuple(now.agg(*mark).first())) != was:
        was = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large, between = materialise_at(both.join(least, "a").where("b > a AND b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "simhash-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, after_path = materialise_at(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "simhash-small")
        for done in (path, between):
            discard(spark, done)
        now, path = after, after_path
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Equal fingerprints are one class from the start; only class representatives are indexed and linked, so copies are never
    expanded into pairs. Null or wordless texts have fingerprint zero and are linked like any other. A null doc_id is a document
    like others but never the smallest; component_id is null where a group has no other. Repeated rows each get a row. Extra
    columns of docs are left out. Empty input: empty result.
    """
    marked = materialise(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "simhash-docs")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    grouped = materialise(components(links(classes.select("fp"))), "simhash-components")
    known = grouped.join(classes, grouped["node"] == classes["fp"]).select("node", "root", "first_id")
    roots = known.groupBy("root").agg(F.min("first_id").alias("component_id"))
    joined = materialise(grouped.join(roots, "root").select("node", "component_id"), "simhash-roots")
    ids = materialise(
        classes.join(joined, classes["fp"] == joined["node"], "left").select(F.col("fp").alias("of_fp"), F.when(F.col("node").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id")), "simhash-ids"
    )
    return marked.join(ids, marked["fp"] == ids["of_fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _far(words: int, one: str, two: str) -> Column:
    return sum((F.bit_count(F.col(f"{one}{k}").bitwiseXOR(F.col(f"{two}{k}"))) for k in range(1, words)), F.bit_count(F.col(f"{one}0").bitwiseXOR(F.col(f"{two}0"))))


def families(classes: DataFrame, apart: int, words: int = WORDS, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """similar(), and the pairs (a, b) of which its stars consist."""
    f = [f"f{k}" for k in range(words)]
    cut = ", ".join(f"struct({2 * k + h} AS side, shiftrightunsigned(f{k}, {32 * h}) & {(1 << segment) - 1}L AS value)" for k in range(words) for h in range(2))
    places = classes.select("id", F.explode(F.expr(f"array({cut})")).alias("s")).select("id", "s.side", "s.value")
    values = materialise(places.groupBy("side", "value").agg(F.count("*").alias("n"), F.min("id").alias("first")), "simhash-values")
    near = materialise(neighbours(values.drop("first"), segment).select("side", "low", "high"), "simhash-neighbours")
    ways = near.select("side", F.col("low").alias("value"), F.col("high").alias("other")).unionByName(near.where("low < high").select("side", F.col("high").alias("value"), F.col("low").alias("other")))
    targets = ways.join(values.select("side", F.col("value").alias("other"), F.col("first")), ["side", "other"]).groupBy("side", "value").agg(F.min("first").alias("to"))
    seen = classes.select(F.col("id").alias("to"), *[F.col(f"f{k}").alias(f"t{k}") for k in range(words)])
    targets = materialise(targets.join(seen, "to"), "simhash-targets")
    # The planner takes places for as large as classes, of which each has 2 * words.
    members = materialise(places.join(ways.select("side", "value"), ["side", "value"], "left_semi").join(classes.hint("merge"), "id"), "simhash-members")
    stars = members.join(targets, ["side", "value"]).where((F.col("id") != F.col("to")) & (_far(words, "f", "t") <= apart))
    asked = materialise(stars.select(F.greatest("id", "to").alias("a"), F.least("id", "to").alias("b")).distinct(), "simhash-asked")
    groups = materialise(components(asked), "simhash-stars")

    of = members.join(groups, members["id"] == groups["node"], "left").select("id", *f, "side", "value", F.coalesce("root", "id").alias("root"))
    shares = of.groupBy("side", "value", "root").agg(F.count("*").alias("n"))
    mains = materialise(shares.groupBy("side", "value").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.max_by("root", "n").alias("main")), "simhash-mains")
    low, high = (mains.select("side", *[F.col(c).alias(f"{end}_{c}" if c != "value" else end) for c in ("value", "roots", "n", "main")]) for end in ("low", "high"))
    open_pairs = near.join(low, ["side", "low"]).join(high, ["side", "high"])
    open_pairs = open_pairs.where("NOT (low_main = high_main AND low_roots = 1 AND high_roots = 1)").withColumn("main", F.expr("if(low_main = high_main, low_main, -1)"))
    open_pairs = materialise(open_pairs.select("side", "low", "high", "main"), "simhash-open")
    one = open_pairs.withColumn("value", F.col("low")).join(of, ["side", "value"]).drop("value")
    two = open_pairs.withColumn("value", F.col("high")).join(of, ["side", "value"]).drop("value", "main")
    two = two.withColumnsRenamed({"id": "to", "root": "to_root"} | {f"f{k}": f"t{k}" for k in range(words)})
    close = (F.col("root") != F.col("to_root")) & (_far(words, "f", "t") <= apart)
    rest = two.join(open_pairs, ["side", "low", "high"]).where("to_root != main").drop("main")
    keys = ["side", "low", "high"]
    others = one.where("root != main").join(two, keys).unionByName(one.where("root = main").join(rest, keys))
    more = others.where(close).select(F.greatest("root", "to_root").alias("a"), F.least("root", "to_root").alias("b")).distinct()
    joined = groups.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    return components(joined), asked


def similar(classes: DataFrame, apart: int, words: int = WORDS, segment: int = SEGMENT) -> DataFrame:
    """(node, root) of the groups of distinct wide fingerprints (id, f0, f1, ...) that are linked; ids without a link are left out.

    Linked are fingerprints that differ in `apart` bits or fewer and in one bit at most of some segment: the low `segment` bits of
    a half of a word. Values of segments meet in the one-wildcard index (neighbours()). First each fingerprint is compared with
    the smallest id of its own and all neighbouring values, at most one for each segment, which joins nearly all of a group however large by few rows each. Then only
    fingerprints whose groups still differ are compared, all with all but for those of a value's largest group with each other, so that
    groups are exactly those of all links though the pairs of a group are never listed.
    """
    return families(classes, apart, words, segment)[0]


def _listed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for packed in batches:
        for start in range(0, len(packed), 256):
            some = [_unpacked(x).view("<i4") for x in packed[start : start + 256].to_pylist()]
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, some)]), pa.int32()), pa.array(np.concatenate(some), pa.int32()))


def likely(sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Links of texts of a family, and the pairs that may be further ones: (a, b) of roots, and (a, b, root, to_root) of ids.

    sets: id, family, of (its members), root (what is linked already) and items, distinct numbers. Every pair of one family and different roots whose sets have `similarity` (Jaccard) or more
    is joined by the links or among the pairs; nothing is lost. A family has a centre, the member nearest to what over half of the members have, and a member is what it
    differs in from that: sets differ in as many items as these differences do. Two members that are alike but not both like the centre share over half of the smaller
    difference, so they share one of its first items, rarest first: of texts that each have changes of their own none meet, however many they are.
    """
    counts = sets.where("of > 2").select("family", "of", F.explode("items").alias("item")).groupBy("family", "item").agg(F.count("*").alias("n"), F.any_value("of").alias("of"))
    common = materialise(counts.where("2 * n > of").groupBy("family").agg(F.collect_list("item").alias("common")), "simhash-common")
    off = F.size("items") + F.size("common") - 2 * F.size(F.array_intersect("items", "common"))
    offs = sets.join(common, "family", "left").withColumn("common", F.coalesce("common", F.array().cast("array<int>"))).select("id", "family", off.alias("off"))
    middle = materialise(offs, "simhash-off").groupBy("family").agg(F.min(F.struct("off", "id")).alias("m"))
    centres = sets.join(middle.select(F.col("m.id").alias("id")), "id").select("family", F.col("root").alias("centre"), F.col("items").alias("there"))
    centres = materialise(centres, "simhash-centres")
    apart = F.concat(F.array_except("items", "there"), F.array_except("there", "items"))
    told = sets.join(centres, "family").select("id", "family", "of", "root", "centre", F.size("items").alias("n"), F.size("there").alias("m"), apart.alias("apart"))
    alike = F.expr("(n + m - size(apart)) / greatest(n + m + size(apart), 1)") >= similarity
    told = materialise(told.withColumn("near", alike | (F.col("root") == F.col("centre"))), "simhash-differences")
    links = materialise(told.where("near AND root != centre").select("root", F.col("centre").alias("main")).distinct(), "simhash-central")
    told = told.join(links, "root", "left").withColumn("main", F.coalesce("main", "root"))

    # Alike sets of n and m items differ in (n + m) * share items at most, and m is n / similarity at most.
    share = (1 - similarity) / (1 + similarity)
    # The two members of a family of two are compared by then.
    items = told.where("of > 2").select("id", "family", "main", "n", F.size("apart").alias("d"), F.explode("apart").alias("item"))
    items = materialise(items, "simhash-items")
    have = materialise(items.groupBy("family", "item").agg(F.count("*").alias("have")).where("have > 1"), "simhash-have")
    ranked = items.join(have, ["family", "item"], "left")
    ranked = ranked.withColumn("at", F.row_number().over(W.Window.partitionBy("id").orderBy(F.col("have").asc_nulls_first(), "item")) - 1)
    most = F.col("n") * ((1 - similarity) / similarity) + 1e-6
    first = materialise(ranked.where((F.col("at") <= most) & (F.col("have") > 1)).withColumn("short", F.col("at") <= most / 2).drop("have"), "simhash-first")
    shares = first.groupBy("family", "item", "main").agg(F.count("*").alias("n"))
    mains = shares.groupBy("family", "item").agg(F.count("*").alias("mains"), F.max_by("main", "n").alias("most")).where("mains > 1").drop("mains")
    mains = materialise(mains, "simhash-mains")
    met = materialise(first.join(mains, ["family", "item"]), "simhash-met")
    one = met.where("short").drop("short")
    two = met.drop("short", "most").withColumnsRenamed({c: f"to_{c}" for c in ("id", "main", "n", "d", "at")})
    fewer = met.where("main != most").drop("short", "most").withColumnsRenamed({c: f"to_{c}" for c in ("id", "main", "n", "d", "at")})
    bound = f"((n + to_n) * {share!r} + 1e-6)"
    able = F.expr(f"main != to_main AND (d < to_d OR d = to_d AND id < to_id) AND at <= ({bound} - (to_d - d)) / 2 AND to_at <= ({bound} + (to_d - d)) / 2")
    keys = ["family", "item"]
    pairs = one.where("main != most").join(two, keys).where(able).select("id", "to_id", "main", "to_main")
    pairs = pairs.unionByName(one.where("main = most").join(fewer, keys).where(able).select("id", "to_id", "main", "to_main"))
    ends = [F.greatest("id", "to_id").alias("a"), F.least("id", "to_id").alias("b")]
    links = links.select(F.greatest("root", "main").alias("a"), F.least("root", "main").alias("b"))
    return links, pairs.groupBy(*ends).agg(F.any_value("main").alias("root"), F.any_value("to_main").alias("to_root"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = WIDE_SHINGLE, words: int = WORDS, segment: int = SEGMENT) -> DataFrame:
    """docs without near-duplicates: exactly one row of each group stays, with all its columns.

    Texts are linked if the Jaccard similarity of their sets of shingles, of `shingle` lower-cased words, is `similarity` or more. Every link is
    verified on the whole sets (of 32-bit hashes), so nothing goes for a text less alike; texts of one fingerprint, whose bits would agree by a chance of 1e-17 below
    the similarity, are one class without it. Pairs to verify are those of which one of 2 * words segments of the fingerprint differs in one bit at
    most (see similar()): 98 in 100 of the pairs at the similarity itself, and more of those above, and as other texts link the same group. segments()
    gives the number of segments that keeps this for another width, so more documents, which need wider ones, lose no more.

    The row that stays is the one with the smallest doc_id, of those the one with the smallest text hash; a null doc_id comes
    last. Groups are told apart by their fingerprints and rows by a number of their own, so null and repeated ids lose nothing. Null and
    wordless texts are equal. Minima are taken by fingerprint first, then by group, so that copies are folded before rows
    meet. Extra columns stay, whatever their names. Empty input: empty result.
    """
    row, fp, sets = (fresh(docs.columns, n) for n in ("keep_row", "keep_fp", "keep_sets"))
    found = docs.withColumns({fp: F.arrow_udf(_minwise(shingle, words), "fp array<long>, shingles binary")(F.col("text")), row: F.monotonically_increasing_id()})
    numbered = materialise(found.withColumns({sets: F.col(f"{fp}.shingles"), fp: F.col(f"{fp}.fp")}), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), F.col(row).alias("row"))
    best = numbered.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("best"))
    best = materialise(best.select("best", F.monotonically_increasing_id().alias("id"), *[F.get("fp", F.lit(k)).alias(f"f{k}") for k in range(words)]), "simhash-classes")

    def verify(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
        held = best.select("id", F.col("best.row").alias("of")).join(ends, "id", "left_semi")
        held = materialise(held.join(numbered.select(F.col(row).alias("of"), F.col(sets).alias("shingles")), "of").select("id", "shingles"), "simhash-sets")
        one, two = (held.select(F.col("id").alias(end), F.col("shingles").alias(f"of_{end}")) for end in "ab")
        alike = F.arrow_udf(_jaccard, "double")(F.col("of_a"), F.col("of_b")) >= similarity
        return materialise(pairs.join(one, "a").join(two, "b").where(alike).select(*pairs.columns), "simhash-verified")

    loose, stars = families(best.drop("best"), bits_apart(similarity, 64 * words), words, segment)
    loose = materialise(loose, "simhash-families")
    groups = materialise(components(verify(stars)), "simhash-groups")
    parts = loose.join(groups.withColumnRenamed("root", "known"), "node", "left").select(F.col("node").alias("id"), F.col("root").alias("family"), F.coalesce("known", "node").alias("root"))
    open_ones = parts.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("of")).where("low < high").select("family", "of")
    open_ones = materialise(open_ones, "simhash-open-families")
    parts = parts.join(open_ones, "family").join(best.select("id", F.col("best.row").alias("first")), "id")
    held = parts.join(numbered.select(F.col(row).alias("first"), F.col(sets).alias("shingles")), "first")
    held = materialise(held.select("id", "family", "of", "root", F.arrow_udf(_listed, "array<int>")("shingles").alias("items")), "simhash-parts")
    links, pairs = likely(held, similarity)
    roots = [F.greatest("root", "to_root").alias("a"), F.least("root", "to_root").alias("b")]
    more = links.unionByName(verify(materialise(pairs, "simhash-asked")).select(*roots)).distinct()
    joined = groups.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)
    grouped = materialise(components(joined), "simhash-components")
    rooted = best.join(grouped, best["id"] == grouped["node"], "left").groupBy(F.coalesce("root", "id")).agg(F.min("best").alias("best"))
    kept = rooted.select(F.col("best.row").alias(row))
    dropped = materialise(numbered.select(row).join(kept, row, "left_anti"), "simhash-dropped")
    return numbered.join(dropped, row, "left_anti").select(*docs.columns)
