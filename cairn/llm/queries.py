"""The corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.decontam import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), width=4)


def op3_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.langid import language

    return language(_table(spark, sf_dir, "documents"))


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.license import licenses

    return licenses(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.sentencepiece import encode

    out = encode(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")
    return out.select("doc_id", "ids", "n_ids", F.sha2("decoded", 256).alias("decoded_sha256"), "exact")


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op7_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.warc import archive

    return archive(_table(spark, sf_dir, "pages"))


def op9_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import quality

    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.fingerprint import fingerprints

    return fingerprints(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and "_" in name}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE_OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS z FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.z)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id, d.doc_id = coalesce(c.c, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(z) AS c FROM r GROUP BY doc_id) c USING (doc_id)
"""


_GROUPS = ", ".join(f"('0x' || substr(h, {5 * k + 1}, 5))::INTEGER" for k in range(8))

ORACLE_OP8 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, [{_GROUPS}] AS g FROM p),
t AS (
  SELECT page_id, payload_bytes, list_reduce(list_transform(g, lambda x: concat(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1),
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1))), lambda a, b: concat(a, b)) AS payload_digest
  FROM d
),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM t)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_minmax_near_dedup": ORACLE_OP2, "op8_warc_round_trip": ORACLE_OP8}
