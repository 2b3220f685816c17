"""The registered queries of this subpackage: thin calls of the operators with
production parameters over whole tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, masked_lm, maxscore, merkle, minhash, packing, quality, repeats, runs, secrets, toxicity, urlrules
from .frames import held_out

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op1_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), n_words=2, percent=80)


def op2_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 3, 1)
    net = langid.fit(docs, ~out)
    return langid.predict(docs.select("doc_id", out.alias("held_out"), "text"), net)


def op3_interval_tree_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.scaled_vectors(_table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, F.col("id") % 20 == 0, 20)


def op5_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = masked_lm.hashed(_table(spark, sf_dir, "documents"), "doc_id")
    return masked_lm.score(docs, masked_lm.fit(docs))


def op6_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality.fit(docs, _table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.contamination(_table(spark, sf_dir, "documents"),
                                                   _table(spark, sf_dir, "benchmark")))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_table(spark, sf_dir, "documents"), tokenizer_file())


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.url_verdicts(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    doc_id, lang, n_chars = F.col("doc_id"), F.col("lang"), F.col("n_chars")
    parts = [doc_id, F.col("source"), lang, n_chars, F.col("text")]
    touched = F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0
    more = F.when(touched, n_chars.cast("decimal(20,0)") + 1).otherwise(n_chars.cast("decimal(20,0)"))
    made = merkle.manifest(docs, parts, lang, doc_id, keep={"doc_id": doc_id, "tampered": F.when(
        touched, merkle.digest(*parts[:3], more, F.col("text"))).otherwise(merkle.digest(*parts))})
    folded = made.select("doc_id", "leaf", "subroot", "root", merkle.siblings_digest(F.col("proof")).alias("proof_sha256"),
                         merkle.fold(F.col("tampered"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def planted_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a tail that repeats, in the documents whose crc32(doc_id
    as text) is divisible by 10; a document without an id stays as it is."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(_table(spark, sf_dir, "documents"), rewrite=planted_tail)
    # runs come by start and period, so the first of equal exponents stays
    best = F.aggregate("runs", F.try_element_at("runs", F.lit(1)), lambda b, r: F.when(
        r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n")))).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))


def op13_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, machine).select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "unit")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_circulant_minhash, op2_byte_cnn_language, op3_interval_tree_repeats, op4_maxscore_topk, op5_masked_lm, op6_random_indexing_quality, op7_secret_links, op8_decontaminate, op9_harmonic_packing, op10_url_rules,
    op11_merkle_manifest, op12_periodic_runs, op13_string_kernel_toxicity,
)}

ORACLES: dict[str, str] = {
    "op11_merkle_manifest": """
        WITH RECURSIVE d AS (
          SELECT doc_id, lang, n_chars, source, text,
            xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
                  range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: list_transform(range(0, 8), lambda k:
                    (ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS BIGINT), 1))::BIGINT >> k::INTEGER) & 1)))),
                lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc
          FROM documents),
        e AS (
          SELECT doc_id, lang, n_chars, crc,
            coalesce(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
              || coalesce(octet_length(encode(source)) || ':' || source, '-')
              || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
            coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail FROM d),
        leaf AS (
          SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
            CASE WHEN crc % 7 = 0
              THEN sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail)
              ELSE sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) END AS tampered
          FROM e),
        g AS (SELECT lang, CAST(row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS BIGINT) AS grp
              FROM (SELECT DISTINCT lang FROM documents) x),
        placed AS (
          SELECT l.doc_id, l.leaf, l.tampered, g.grp,
            CAST(row_number() OVER (PARTITION BY g.grp ORDER BY l.doc_id NULLS FIRST, l.leaf) - 1 AS BIGINT) AS pos
          FROM leaf l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang),
        sizes AS (SELECT grp, count(*) AS n FROM placed GROUP BY grp),
        lev AS (
          SELECT p.grp, 0 AS level, p.pos, s.n, p.leaf AS digest FROM placed p JOIN sizes s USING (grp)
          UNION ALL
          SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
          FROM lev WHERE n > 1 GROUP BY grp, level, pos // 2, n),
        subroots AS (SELECT grp, digest FROM lev WHERE n = 1),
        top AS (
          SELECT 0 AS level, grp AS pos, (SELECT count(*) FROM g) AS n, digest FROM subroots
          UNION ALL
          SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
          FROM top WHERE n > 1 GROUP BY level, pos // 2, n),
        heights AS (SELECT grp, max(level) AS h FROM lev GROUP BY grp),
        total AS (SELECT max(level) AS h FROM top),
        walk AS (
          SELECT p.doc_id, p.leaf, p.grp, p.pos, 0 AS step, p.tampered AS acc, '' AS proof, h.h + t.h AS steps, h.h AS low
          FROM placed p JOIN heights h USING (grp), total t
          UNION ALL
          SELECT w.doc_id, w.leaf, w.grp, w.pos, w.step + 1,
            sha256(CASE WHEN s.digest IS NULL THEN w.acc WHEN w.place % 2 = 1 THEN s.digest || w.acc ELSE w.acc || s.digest END),
            w.proof || coalesce(s.digest, ''), w.steps, w.low
          FROM (SELECT *, CASE WHEN step < low THEN pos // CAST(pow(2, step) AS BIGINT)
                          ELSE grp // CAST(pow(2, step - low) AS BIGINT) END AS place FROM walk WHERE step < steps) w
          LEFT JOIN (SELECT grp, level, pos, digest FROM lev UNION ALL SELECT -1, level, pos, digest FROM top) s
            ON s.grp = CASE WHEN w.step < w.low THEN w.grp ELSE -1 END
              AND s.level = CASE WHEN w.step < w.low THEN w.step ELSE w.step - w.low END AND s.pos = xor(w.place, 1))
        SELECT w.doc_id, w.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
          w.acc AS folded_root, w.acc = r.digest AS verified
        FROM walk w JOIN subroots s USING (grp), (SELECT digest FROM top WHERE n = 1) r WHERE w.step = w.steps""",
    "op4_maxscore_topk": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
          WHERE embedding IS NOT NULL AND len(embedding) > 0
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op10_url_rules": """
        WITH rules(verdict, rhost, rpath) AS (VALUES
          ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
          ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        u AS (
          SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
          FROM pages),
        p AS (
          SELECT page_id, url, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
          FROM u)
        SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, coalesce(r.verdict, 'allow') AS verdict
        FROM p LEFT JOIN LATERAL (
          SELECT * FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
          ORDER BY length(rhost || rpath) DESC LIMIT 1) r ON true""",
}
