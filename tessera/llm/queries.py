"""The thin queries of this subpackage over the fixture tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tessera.llm import ann, arc, ball_tree, bpe, gru_lm, merkle, packing, pu_quality, substring, tiling, toxicity, url_cascade, weighted_minhash
from tessera.llm.common import prepare, read


def op1_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs, digest_only=True)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_minhash.classes(read(spark, sf_dir, "documents"))


def op5_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = pu_quality.score(docs, labels, train=~pu_quality.held_out())
    return found.select("doc_id", pu_quality.held_out().alias("held_out"), "score", "predicted")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gru_lm.score(read(spark, sf_dir, "documents"), ~gru_lm.held_out())
    return found.select("doc_id", gru_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = arc.archive(read(spark, sf_dir, "pages"))
    return found.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def op9_knn_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    found = toxicity.score(docs, labels, train=~toxicity.held_out())
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "neighbours")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_cascade.judge(url_cascade.urls_of(read(spark, sf_dir, "pages"))).drop("url")


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(read(spark, sf_dir, "embeddings"), k=40, rounds=5)


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=0, limits=packing.Limits(tokens=2048))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = read(spark, sf_dir, "documents").select(*fields)
    return merkle.manifest(docs, fields, "doc_id", "source", altered=merkle.without_newlines())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_collision_ann, op2_decontaminate, op3_substring_dedup, op4_minhash_near_dedup, op5_pu_quality, op6_byte_bpe, op7_gru_lm, op8_arc_to_warc, op9_knn_toxicity, op10_url_filter, op11_ball_tree_clusters, op12_vector_packing, op13_merkle_manifest)}


def _clusters_sql(k: int, rounds: int) -> str:
    nearest = """
d{n} AS (SELECT v.vec_id, v.row, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance FROM v JOIN c{n} c USING (dim) GROUP BY ALL),
a{n} AS (SELECT vec_id, row, cluster, distance FROM d{n} QUALIFY row_number() OVER (PARTITION BY row ORDER BY distance, cluster) = 1),"""
    moved = """
m{n} AS (SELECT cluster, dim, sum(x)::BIGINT AS s, count(*) AS n FROM a{n} JOIN v USING (row) GROUP BY ALL),
c{m} AS (SELECT cluster, dim, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} c LEFT JOIN m{n} USING (cluster, dim)),"""
    steps = "".join((nearest + moved).format(n=n, m=n + 1) for n in range(rounds)) + nearest.format(n=rounds)
    return f"""
WITH k AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS (SELECT vec_id, row, unnest(q) AS x, generate_subscripts(q, 1) AS dim FROM k),
i AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS cluster, q FROM k QUALIFY cluster < {k}),
c0 AS (SELECT cluster::INT AS cluster, unnest(q) AS x, generate_subscripts(q, 1) AS dim FROM i),{steps}
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (cluster)"""


ORACLES: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS p, w FROM d),
k AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 12], ' ')) AS h FROM g),
f AS (SELECT h, min(doc_id) AS first_doc FROM k GROUP BY h),
bad AS (SELECT DISTINCT k.doc_id, unnest(range(k.p, k.p + 13)) AS q FROM k JOIN f USING (h) WHERE f.first_doc < k.doc_id),
b AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM bad GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN qs IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN b USING (doc_id)""",
    "op8_arc_to_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(octet_length(encode(html)), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
         row_number() OVER () AS n, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_page FROM pages),
q AS (
  SELECT *, CASE WHEN page_id IS NULL OR first_page < page_id THEN first_page END AS refers_to FROM p),
d AS (
  SELECT q.*, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(h, ((i // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM d""",
    "op10_url_filter": r"""
WITH s AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN split_part(split_part(substr(url, strpos(url, '://') + 3), '?', 1), '#', 1) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path FROM s),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m AS (
  SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC) AS n
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m ON u.page_id = m.page_id AND m.n = 1""",
    "op11_ball_tree_clusters": _clusters_sql(40, 5),
    "op13_merkle_manifest": r"""
WITH RECURSIVE
enc AS (
  SELECT doc_id, source, row_number() OVER () AS row, text,
    concat(coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-'), coalesce(octet_length(encode(source)) || ':' || source, '-'),
      coalesce(octet_length(encode(lang)) || ':' || lang, '-'), coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-')) AS head,
    list_reduce(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1))::BIGINT),
      lambda c, x: list_reduce(range(8), lambda y, z: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(c, x)), 4294967295::BIGINT) AS crc
  FROM documents),
lf AS (
  SELECT doc_id, source, row, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN crc % 2 = 1 AND text IS NOT NULL THEN sha256(head || octet_length(encode(replace(text, chr(10), ''))) || ':' || replace(text, chr(10), '')) END AS altered FROM enc),
n AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS idx,
    count(*) OVER (PARTITION BY source) AS total FROM lf),
up(level, tree, idx, total, h) AS (
  SELECT 0, tree, idx, total, leaf FROM n UNION ALL
  SELECT level + 1, tree, idx // 3, (total + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE total > 1 GROUP BY level, tree, idx // 3, total),
sub AS (SELECT tree, h AS subroot, count(*) OVER () AS total FROM up WHERE total = 1),
top(level, tree, total, h) AS (
  SELECT 0, tree, total, subroot FROM sub UNION ALL
  SELECT level + 1, tree // 3, (total + 2) // 3, sha256(string_agg(h, '' ORDER BY tree)) FROM top WHERE total > 1 GROUP BY level, tree // 3, total),
r AS (SELECT h AS root FROM top WHERE total = 1),
fold(level, row, tree, idx, total, proof, folded) AS (
  SELECT 0, row, tree, idx, total, '', coalesce(altered, leaf) FROM n UNION ALL
  SELECT f.level + 1, f.row, f.tree, f.idx // 3, (f.total + 2) // 3, f.proof || s.before || s.after, sha256(s.before || f.folded || s.after)
  FROM fold f JOIN (
    SELECT a.level, a.tree, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
    FROM up a JOIN up b ON a.level = b.level AND a.tree = b.tree AND a.idx // 3 = b.idx // 3 WHERE a.total > 1 GROUP BY ALL) s
  ON f.level = s.level AND f.tree = s.tree AND f.idx = s.idx),
low AS (SELECT row, tree, proof, folded FROM fold WHERE total = 1),
climb(level, row, idx, total, proof, folded) AS (
  SELECT 0, row, tree, (SELECT count(*) FROM sub), proof, folded FROM low UNION ALL
  SELECT c.level + 1, c.row, c.idx // 3, (c.total + 2) // 3, c.proof || s.before || s.after, sha256(s.before || c.folded || s.after)
  FROM climb c JOIN (
    SELECT a.level, a.tree AS idx, coalesce(string_agg(b.h, '' ORDER BY b.tree) FILTER (b.tree < a.tree), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.tree) FILTER (b.tree > a.tree), '') AS after
    FROM top a JOIN top b ON a.level = b.level AND a.tree // 3 = b.tree // 3 WHERE a.total > 1 GROUP BY ALL) s
  ON c.level = s.level AND c.idx = s.idx)
SELECT n.doc_id, n.leaf, sub.subroot, r.root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = r.root AS verified
FROM n JOIN sub ON n.tree = sub.tree JOIN climb c ON c.row = n.row AND c.total = 1, r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: f(prepare(spark), sf_dir)

    return {name: shipped(f) for name, f in QUERIES.items()}
