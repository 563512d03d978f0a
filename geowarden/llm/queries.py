"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_digests, vocabulary
from .common import sql_words
from .html import main_texts
from .licenses import BASE, COVER, GRAM, NEAR, NOTICES, STRETCH, scan_licenses
from .packing import pack
from .quality import judge
from .secrets import scan_secrets
from .simhash import simhash_groups
from .substrings import WINDOW, repeat_digests
from .tokens import token_counts
from .vectors import vector_groups


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("distance")


@query
def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


@query
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


@query
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


# -- SQL, for the operators that it can express ------------------------------------------------


def _licenses_sql() -> str:
    words = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    base = " UNION ALL ".join(f"SELECT k, CAST(i - 1 AS BIGINT) AS start, '{label}' AS label FROM d, range(1, len(ws) + 1) t(i) WHERE " + " AND ".join(f"ws[i + {j}] = '{w}'" for j, w in enumerate(phrase.split())) for phrase, label in BASE)
    grams = ", ".join(f"({t}, '{label}', {len(ws := text.split())}, {i}, '{' '.join(ws[i : i + GRAM])}')" for t, (label, text) in enumerate(NOTICES) for i in range(len(text.split()) - GRAM + 1))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {words} AS ws FROM documents),
    base AS MATERIALIZED ({base}),
    known(template, label, size, spot, gram) AS (VALUES {grams}),
    votes AS (SELECT k, template, label, size, i - 1 AS pos, spot, i - 1 - spot AS diagonal FROM d, range(1, len(ws) - {GRAM - 2}) t(i) JOIN known ON array_to_string(ws[i:i + {GRAM - 1}], ' ') = gram),
    steps AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > {NEAR} THEN 1 ELSE 0 END AS apart FROM votes WINDOW w AS (PARTITION BY k, template ORDER BY diagonal, pos)),
    runs AS (SELECT *, sum(apart) OVER (PARTITION BY k, template ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS run FROM steps),
    spans AS (SELECT k, label, count(DISTINCT spot) / CAST(size - {GRAM - 1} AS DOUBLE) AS cover, max(pos) + {GRAM} - min(pos) AS reach, size FROM runs GROUP BY k, template, label, size, run),
    own AS (SELECT * FROM spans WHERE cover >= {COVER} AND reach <= {STRETCH} * size),
    b AS (SELECT k, count(*) AS n, min(start) AS lo, max(start) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY k),
    every AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT k, label FROM base UNION ALL SELECT k, label FROM own) GROUP BY k),
    c AS (SELECT k, max(cover) AS cover FROM own GROUP BY k)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, lo AS first_word, hi AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
      CASE WHEN n > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(cover, CAST(0 AS DOUBLE)) END AS score
    FROM d LEFT JOIN b USING (k) LEFT JOIN every USING (k) LEFT JOIN c USING (k)"""


def _repeats_sql(window: int = WINDOW) -> str:
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {sql_words()} AS ws FROM documents),
    w AS MATERIALIZED (SELECT k, i, array_to_string(ws[i:i + {window - 1}], ' ') AS s FROM d, range(1, len(ws) - {window - 2}) t(i)),
    again AS (SELECT s FROM w GROUP BY s HAVING count(*) > 1),
    gone AS MATERIALIZED (SELECT DISTINCT k, i + j AS p FROM w JOIN again USING (s), range(0, {window}) r(j)),
    words AS (SELECT k, p, ws[p] AS word FROM d, range(1, len(ws) + 1) t(p)),
    kept AS (SELECT k, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (k, p) GROUP BY k),
    n AS (SELECT k, count(*) AS removed FROM gone GROUP BY k)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (k) LEFT JOIN n USING (k)"""


ORACLE["op4_licenses"] = _licenses_sql()
ORACLE["op9_substring_dedup"] = _repeats_sql()
ORACLE["op10_embedding_dedup"] = """WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    good AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
    reach(vec_id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, p.b FROM reach JOIN p ON p.a = reach.r),
    n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a),
    c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY vec_id)
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
