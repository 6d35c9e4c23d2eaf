"""The registered queries of this package, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import (
    cube_mix,
    host_reputation,
    license_index,
    line_dedup,
    merkle_manifest,
    simhash_decontam,
    source_divergence,
    tensor_minhash,
    token_store,
    toxicity,
    trie_dedup,
    vafile,
    warc,
)
from .host_reputation import UrlRule
from .shared import scratch, ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

RULES = (
    UrlRule("allow", "org"), UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def query(name: str, sql: str | None = None):
    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return register


@query("op1_warc_normalise")
def op1_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    mono, single = scratch(spark, "warc-mono-files"), scratch(spark, "warc-record-files")
    archives = warc.write_monolithic(warc.planned(table(spark, sf_dir, "pages")), mono)
    found = warc.records(warc.normalise(archives, single), single)
    return found.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"), "verified")


@query("op2_vafile", """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 10
""")
def op2_vafile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")


@query("op3_cube_mix")
def op3_cube_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = cube_mix.mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies")


@query("op4_license_index")
def op4_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_index.scan(table(spark, sf_dir, "documents"))
    base = [t.name for t in license_index.BASE]
    found = found.withColumn("base", F.filter("matches", lambda m: m["template"].isin(base)))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").alias("first_word"), F.array_max("base.start").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"), joined(F.col("matches.label")).alias("labels"),
        F.coalesce(F.array_max("matches.score"), F.lit(0.0)).alias("score"))


@query("op5_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS pos, l[i] AS line,
           translate(regexp_replace(l[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
          FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT doc_id, pos, line, r.key IS NOT NULL AND doc_id <> keeper AS goes
    FROM lines LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return kept.select(
        F.col("id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2(F.array_join("kept", "\n"), 256).alias("kept_sha256"))


@query("op6_tensor_minhash")
def op6_tensor_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensor_minhash.duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query("op7_token_store")
def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = token_store.store_folder(spark)
    manifest = token_store.write(
        table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read(manifest, folder, with_ids=False).withColumnRenamed("n_ids", "n_tokens")


@query("op8_host_reputation", r"""
WITH parsed AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
    FROM pages
), rules(verdict, rule_host, rule_path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
    SELECT DISTINCT host, path, rule_host || rule_path AS rule, rules.verdict AS ruled
    FROM (SELECT DISTINCT host, path FROM parsed) p JOIN rules
      ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, rule_host || rule_path) = 1
), judged AS (
    SELECT page_id, host, path, rule, ruled FROM parsed LEFT JOIN fitting USING (host, path)
), hosts AS (
    SELECT host, suffix, CASE WHEN host = suffix THEN host ELSE
             string_split(host[:length(host) - length(suffix) - 1], '.')[-1] || '.' || suffix END AS domain,
           coalesce(sum(CASE WHEN ruled = 'block' THEN 1 ELSE 0 END) FILTER (WHERE ruled IS NOT NULL), 0)::DOUBLE AS bad,
           count(ruled)::DOUBLE AS n
    FROM (SELECT host, ruled, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN (SUFFIXES)
                 THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix
          FROM judged)
    GROUP BY host, suffix
), domains AS (
    SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM hosts GROUP BY domain, suffix
), suffixes AS (
    SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY suffix
), levels AS (
    SELECT 's' AS level, bad, n FROM suffixes UNION ALL SELECT 'd', bad, n FROM domains UNION ALL SELECT 'h', bad, n FROM hosts
), sums AS (
    SELECT level, CASE WHEN sum(n) > 0 THEN sum(bad) / sum(n) ELSE 0 END AS m, sum(n) AS n, sum(n * n) AS nn,
           sum(bad * bad / n) FILTER (WHERE n > 0) AS q, count(*) FILTER (WHERE n > 0) AS k
    FROM levels GROUP BY level
), moments AS (
    SELECT level, m, n, q - n * m * m - m * (1 - m) * (k - 1) AS above, m * (1 - m) * (n - nn / n - (k - 1)) AS room FROM sums
), priors AS (
    SELECT level, m, greatest(2.0, least(1000.0, CASE WHEN n > 0 AND room > 0 AND above > 0 THEN room / above - 1 ELSE 1000 END)) AS s
    FROM moments
), of_suffix AS (
    SELECT suffix, (bad + m * s) / (n + s) AS mean FROM suffixes, priors WHERE level = 's'
), of_domain AS (
    SELECT domain, d.suffix, (bad + f.mean * s) / (n + s) AS mean
    FROM domains d JOIN of_suffix f USING (suffix), priors WHERE level = 'd'
), of_host AS (
    SELECT host, (bad + f.mean * s) / (h.n + s) AS mean, h.n + s AS total
    FROM hosts h JOIN of_domain f USING (domain, suffix), priors WHERE level = 'h'
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE
           WHEN mean - 1.645 * sqrt(mean * (1 - mean) / (total + 1)) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN of_host USING (host)
""".replace("SUFFIXES", ", ".join(f"'{s}'" for s in host_reputation.SUFFIXES)))
def op8_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_reputation.judge(table(spark, sf_dir, "pages"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op9_simhash_decontam")
def op9_simhash_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_decontam.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "start",
                        "common", "total", (F.col("common") / F.col("total")).alias("similarity"))


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), toxicity.crc_held_out()
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), held)
    return toxicity.score(docs, model).select(
        "doc_id", held(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op11_trie_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op11_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_dedup.owners(table(spark, sf_dir, "documents"), keep="largest").withColumnRenamed("id", "doc_id")


@query("op12_merkle_manifest", r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, source, text,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           -- crc32 of the decimal id: eight shifts a byte; inverting all bits turns odd into even
           list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
               lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y:
                   CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) % 2 = 1 AS even
    FROM documents
), leaves AS (
    SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(cut) || ':' || cut, '-')) AS altered,
           row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n
    FROM (SELECT *, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS cut FROM docs)
), nodes AS (
    SELECT source, 0 AS level, pos AS idx, n, leaf AS digest FROM leaves
    UNION ALL
    SELECT source, level + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
    FROM nodes WHERE n > 1 GROUP BY source, level, idx // 3
), subroots AS (
    SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
    SELECT 0 AS level, tree AS idx, n, digest FROM subroots
    UNION ALL
    SELECT level + 1, idx // 3, (max(n) + 2) // 3, sha256(string_agg(digest, '' ORDER BY idx))
    FROM tops WHERE n > 1 GROUP BY level, idx // 3
), near AS (
    SELECT doc_id, level AS step, digest, idx, pos // (3 ** level)::BIGINT AS own
    FROM leaves d JOIN nodes s ON d.source IS NOT DISTINCT FROM s.source
     AND s.n > 1 AND s.idx // 3 = d.pos // (3 ** (level + 1))::BIGINT
    UNION ALL
    SELECT doc_id, 1000 + level, s.digest, idx, tree // (3 ** level)::BIGINT
    FROM leaves d JOIN subroots t ON d.source IS NOT DISTINCT FROM t.source
    JOIN tops s ON s.n > 1 AND s.idx // 3 = tree // (3 ** (level + 1))::BIGINT
), steps AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) AS k,
           coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx < own), '') AS before,
           coalesce(string_agg(digest, '' ORDER BY idx) FILTER (WHERE idx > own), '') AS after
    FROM near GROUP BY doc_id, step
), folded AS (
    SELECT doc_id, 0 AS k, altered AS digest FROM leaves
    UNION ALL
    SELECT f.doc_id, s.k, sha256(before || f.digest || after) FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.k = f.k + 1
), proofs AS (
    SELECT doc_id, sha256(coalesce(string_agg(before || after, '' ORDER BY k), '')) AS proof_sha256
    FROM leaves LEFT JOIN steps USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, proof_sha256, f.digest AS folded_root, f.digest = r.digest AS verified
FROM leaves JOIN proofs USING (doc_id) JOIN subroots t ON leaves.source IS NOT DISTINCT FROM t.source
JOIN (SELECT digest FROM tops WHERE n = 1) r ON true
JOIN (SELECT doc_id, arg_max(digest, k) AS digest FROM folded GROUP BY doc_id) f USING (doc_id)
""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    leaves = docs.select(
        F.col("source"), F.col("doc_id").alias("id"), merkle_manifest.leaf_digest(*columns, F.col("text")).alias("digest"),
        F.when(even, merkle_manifest.leaf_digest(*columns, F.replace("text", F.lit("\n"), F.lit("")))).alias("altered"))
    proofs = merkle_manifest.audit(leaves)
    return proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_source_divergence", r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
    FROM documents
), words AS (
    SELECT row, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM docs
), terms AS (
    SELECT lang, term, count(*) AS total FROM words GROUP BY lang, term HAVING count(DISTINCT row) >= 3
), counts AS (
    SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN terms USING (lang, term) GROUP BY lang, source, term
), langs AS (
    SELECT lang, count(*) AS v, sum(total) AS n FROM terms GROUP BY lang
), groups AS (
    SELECT lang, source, coalesce(v, 0) AS v, coalesce(own, 0) AS own, coalesce(langs.n, 0) AS all_n
    FROM (SELECT DISTINCT lang, source FROM docs)
    LEFT JOIN (SELECT lang, source, sum(n) AS own FROM counts GROUP BY lang, source) USING (lang, source)
    LEFT JOIN langs USING (lang)
), rates AS (
    SELECT lang, source, term, coalesce(c.n, 0) AS n,
           1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (own + v) AS p,
           1 + 1000000000::HUGEINT * (total + 1) // (all_n + v) AS q
    FROM groups JOIN terms USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN rates x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN rates y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source
), above AS (
    SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM rates WHERE n > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
FROM (FROM pairs UNION ALL FROM above) QUALIFY part = 'pair' OR rank <= 200
""")
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
