"""The corpus operators over whole tables: one query opN_<name> each, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import bit_sliced, crc_ring, fair_mix, feistel, hyperprofiles, merkle, ngram_rules, packing, passage_mil, role_repair, simhash, warc, wrapper
from lathe.session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages"))).drop("html", "url")


def warc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derivatives of responses that were written as WARC files and read again, counted by target and type."""
    path = scratch_folder(spark, "warc")
    warc.write_warc(warc.responses(table(spark, sf_dir, "pages").select("url", "html")), path)
    made = warc.derive(warc.read_warc(spark, path))
    return made.groupBy("target_uri", "record_type").agg(F.count("*").alias("records"), F.count_distinct("refers_to").alias("sources"), F.count_distinct("payload_digest").alias("payloads"))


WARC_FILES_SQL = """
SELECT url AS target_uri, record_type, count(*) AS records, count(DISTINCT coalesce(html, '')) AS sources, count(DISTINCT coalesce(html, '')) AS payloads
FROM pages, (VALUES ('metadata'), ('conversion')) AS t(record_type) GROUP BY ALL
"""


def op9_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return role_repair.repair(table(spark, sf_dir, "conversations"))


def op2_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = passage_mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "held_out", "score", "predicted")


def op6_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = ngram_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "kept")


def op4_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP4_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM whole q, whole c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 10
"""


def op5_fair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix.fair_queue(table(spark, sf_dir, "documents"), texts=False).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sizes),
filling AS (
  SELECT *, 3 * source_size / weight AS fills_at, sum(source_size) OVER () AS budget,
         coalesce(sum(3 * source_size) OVER w, 0) AS filled,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM weighed
  WINDOW w AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, CAST(budget - filled AS DOUBLE) / open_weight AS level FROM filling),
targets AS (
  SELECT source, source_size,
         least(3.0::DOUBLE * source_size,
               (SELECT min_by(level, fills_at) FROM levels WHERE level <= fills_at) * weight) AS target
  FROM levels),
queued AS (
  SELECT s.*, t.source_size, t.target,
         CAST(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
items AS (
  SELECT q.*, e.epoch, (e.epoch * source_size + cum) / target AS finish
  FROM queued q, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0),
cut AS (
  SELECT *, sum(size) OVER (ORDER BY finish, coalesce('s' || source, 'unnamed'), epoch, cum ROWS UNBOUNDED PRECEDING) AS upto,
         (SELECT sum(source_size) FROM sizes) AS budget
  FROM items),
taken AS (SELECT source, h, doc_id, cum, count(*) AS times FROM cut WHERE upto <= budget GROUP BY ALL)
SELECT q.doc_id, CAST(q.size AS BIGINT) AS size, q.source_size, q.target,
       CAST(CASE WHEN q.size > 0 THEN coalesce(t.times, 0) * q.size ELSE 0 END AS BIGINT) AS taken
FROM queued q LEFT JOIN taken t
  ON q.source IS NOT DISTINCT FROM t.source AND q.h = t.h AND q.doc_id IS NOT DISTINCT FROM t.doc_id AND q.cum = t.cum
"""


def op10_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))



def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feistel.place(feistel.measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op7_concat_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), added=packing.public_added(), cached=400_000)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    halved = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(halved, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    out = merkle.verified(table(spark, sf_dir, "documents"), tampered)
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: CRC-32 of a list of byte values, unsigned.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes}), lambda c, x:
  list_reduce(list_prepend(xor(c, x), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))))"""
_DIGITS = "list_transform(range(1, len(CAST({0} AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST({0} AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))"

_FIELD = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{text}")) + ")"
_GROWN = """{name}(level, grp, n, idx, digest) AS (
  SELECT 0, {grp}, CAST(n AS BIGINT), CAST(idx AS BIGINT), digest FROM {base}
  UNION ALL
  SELECT level + 1, grp, (n + 2) // 3, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY level, grp, n, idx // 3)"""
_SIDES = """{name} AS (
  SELECT l.level, l.grp, l.idx, coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx < l.idx), '') AS before,
         coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (s.idx > l.idx), '') AS after
  FROM {nodes} l JOIN {nodes} s ON s.level = l.level AND s.grp = l.grp AND s.idx // 3 = l.idx // 3 WHERE l.n > 1 GROUP BY ALL)"""
OP11_SQL = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, source, {_LEAF.format(text="text")} AS digest,
         {_LEAF.format(text="CASE WHEN " + _CRC.format(bytes=_DIGITS.format("doc_id")) + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS claimed
  FROM documents),
grouped AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM hashed),
leaves AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM grouped),
{_GROWN.format(name="nodes", grp="g", base="leaves")},
tops AS (SELECT 0 AS g, grp AS idx, digest, count(*) OVER () AS n FROM nodes WHERE n = 1),
{_GROWN.format(name="upper", grp="g", base="tops")},
{_SIDES.format(name="sides", nodes="nodes")},
{_SIDES.format(name="upsides", nodes="upper")},
climbed(k, upward, level, g, spot, doc_id, idx, digest, claimed, subroot, proof, folded) AS (
  SELECT 0, false, 0, l.g, l.idx, doc_id, l.idx, l.digest, claimed, t.digest, '', claimed FROM leaves l JOIN tops t ON t.idx = l.g
  UNION ALL
  SELECT k + 1, turned OR upward, CASE WHEN turned THEN 0 ELSE level + 1 END, g, CASE WHEN turned THEN g ELSE spot // 3 END, doc_id, idx, digest, claimed, subroot,
         CASE WHEN turned THEN proof ELSE proof || before || after END, CASE WHEN turned THEN folded ELSE sha256(before || folded || after) END
  FROM (SELECT c.*, NOT upward AND s.before IS NULL AS turned, coalesce(s.before, u.before) AS before, coalesce(s.after, u.after) AS after
        FROM climbed c
        LEFT JOIN sides s ON NOT upward AND s.level = c.level AND s.grp = c.g AND s.idx = c.spot
        LEFT JOIN upsides u ON upward AND u.level = c.level AND u.idx = c.spot)
  WHERE turned OR before IS NOT NULL),
done AS (SELECT *, row_number() OVER (PARTITION BY g, idx ORDER BY k DESC) AS last FROM climbed)
SELECT doc_id, digest AS leaf, subroot, (SELECT digest FROM upper WHERE n = 1) AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = (SELECT digest FROM upper WHERE n = 1) AS verified
FROM done WHERE last = 1
"""


def op12_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperprofiles.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op13_crc_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = crc_ring.weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text", "lang", "source", "n_chars")
    return crc_ring.draw(weighed).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS_13 = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BYTES = "list_transform(range(0, strlen(word)), lambda i: CAST(16 * (instr('0123456789ABCDEF', substr(hex(word), CAST(2 * i + 1 AS INTEGER), 1)) - 1) + instr('0123456789ABCDEF', substr(hex(word), CAST(2 * i + 2 AS INTEGER), 1)) - 1 AS BIGINT))"
OP13_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS place, {_WORDS_13} AS words FROM documents),
raw AS (SELECT place, word, count(*) AS n FROM (SELECT place, unnest(words) AS word FROM docs) GROUP BY ALL),
target AS (SELECT word, count(*) AS n FROM (SELECT unnest({_WORDS_13}) AS word FROM benchmark) GROUP BY word),
words AS (SELECT word, {_CRC.format(bytes=_BYTES)} % 10000 AS bucket FROM (SELECT word FROM raw UNION SELECT word FROM target)),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM raw JOIN words USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS n FROM target JOIN words USING (word) GROUP BY bucket),
totals AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS all_s, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS all_t),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (all_s + 10000) / ((s.n + 1)::DOUBLE * (all_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT place, CAST(sum(n * gain) AS BIGINT) AS weight FROM raw JOIN words USING (word) JOIN gains USING (bucket) GROUP BY place),
hashed AS (SELECT *, substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS h FROM docs),
scored AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || h AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM hashed LEFT JOIN weights USING (place)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS r FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_features >= 20 AND r <= (SELECT count(*) * 10 // 100 FROM scored WHERE n_features >= 20) THEN r END AS rank
FROM ranked
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_wrapper_text": op1_wrapper_text,
    "op2_attention_mil": op2_attention_mil,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_bit_sliced_top_k": op4_bit_sliced_top_k,
    "op5_fair_mix": op5_fair_mix,
    "op6_ngram_ratio": op6_ngram_ratio,
    "op7_concat_pack": op7_concat_pack,
    "op8_feistel_shards": op8_feistel_shards,
    "op9_role_repair": op9_role_repair,
    "op10_simhash_variants": op10_simhash_variants,
    "op11_merkle_proofs": op11_merkle_proofs,
    "op12_hyperdimensional_language": op12_hyperdimensional_language,
    "op13_crc_resampling": op13_crc_resampling,
    "warc_files": warc_files,
}
ORACLES: dict[str, str] = {"warc_files": WARC_FILES_SQL, "op4_bit_sliced_top_k": OP4_SQL, "op5_fair_mix": OP5_SQL, "op11_merkle_proofs": OP11_SQL, "op13_crc_resampling": OP13_SQL}
