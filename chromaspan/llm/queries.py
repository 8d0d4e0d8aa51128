"""The training-data operators' queries over the test tables, and their SQL where there is one."""

from __future__ import annotations

import hashlib
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, line_dedup, lm_score, nndescent, packing, quality, runs, simhash, token_count, token_files, toxicity, vector_codes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(ids: bytes, text: str) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return bpe.encode_rows(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.search(_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def _repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by their id, repeat words from some place on; one without an id doesn't."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(words: list[bytes], found: list[runs.Run]) -> tuple:
        start, length, period = runs.most_periodic(found) or (None, None, None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        kept = b" ".join(runs.collapsed(words, found))
        return len(found), start, length, period, length and 1000 * length // period, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()

    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return runs.run_rows(_table(spark, sf_dir, "documents"), digests, schema, _repeated)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings")).drop("scans")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_lm_scoring, op3_line_dedup, op4_bpe, op5_toxicity, op6_embedding_near_dedup, op7_quality, op8_nearest_neighbours, op9_packing, op10_simhash_near_dedup, op11_periodic_runs, op12_vector_codes, op13_token_files)
}

BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

WORD = "'[^\\x20\\x09-\\x0D]+'"


def _vector_codes_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    out = f"""
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        cell AS (SELECT row, j // (len(v) // {parts}) AS p, j % (len(v) // {parts}) AS k, v[j + 1] AS x FROM (SELECT row, v, unnest(range(len(v))) AS j FROM kept)),
        book0 AS (SELECT row - 1 AS e, p, k, x AS c FROM cell WHERE row <= {entries}),"""
    for t in range(rounds + 1):
        out += f"""
        code{t} AS (SELECT row, p, m % {entries} AS e, m // {entries} AS d
            FROM (SELECT row, p, min(d * {entries} + e) AS m FROM (SELECT row, p, e, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM cell JOIN book{t} USING (p, k) GROUP BY row, p, e) GROUP BY row, p)),"""
        if t < rounds:
            out += f"""
        mean{t} AS (SELECT e, p, k, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM cell JOIN code{t} USING (row, p) GROUP BY e, p, k),
        book{t + 1} AS (SELECT e, p, k, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM book{t} LEFT JOIN mean{t} USING (e, p, k)),"""
    return out + f"""
        coded AS (SELECT row, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM code{rounds} GROUP BY row)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, k)) FROM book{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (row)"""


ORACLE_SQL = {
    "op3_line_dedup": f"""
        WITH line AS (
            SELECT row, doc_id, unnest(s) AS line, generate_subscripts(s, 1) AS i
            FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
        keyed AS (SELECT *, translate(trim(line, {BLANKS}), {AZ}) AS k FROM line),
        often AS (SELECT k, max(doc_id) AS last_id FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT row) >= 3),
        judged AS (SELECT keyed.*, often.k IS NOT NULL AND doc_id IS DISTINCT FROM last_id AS gone FROM keyed LEFT JOIN often ON keyed.k = often.k)
        SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY row""",
    "op6_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
        link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= CAST(0.9 AS DOUBLE)),
        reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
        class AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), links AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
        FROM embeddings LEFT JOIN class ON vec_id = id LEFT JOIN links ON vec_id = a""",
    "op11_periodic_runs": f"""
        WITH one AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), {WORD}) AS w,
                list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
                    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))) AS c
            FROM documents),
        hashed AS (SELECT row, doc_id, w, len(w) AS n, xor(c, 4294967295) AS h FROM one),
        planted AS (SELECT *, doc_id IS NOT NULL AND h % 10 = 0 AND n > 0 AS again, (h // 10) % greatest(n, 1) AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM hashed),
        word AS (SELECT row, n, i, w[CASE WHEN again AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS w FROM (SELECT *, unnest(range(n)) AS i FROM planted)),
        pair AS (SELECT x.row, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
        island AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS g FROM pair) GROUP BY row, q, g),
        run AS (SELECT row, start, length, min(q) AS period FROM island WHERE length >= greatest(6, 4 * q) GROUP BY row, start, length),
        best AS (SELECT row, count(*) AS n_runs, arg_min(r, o) AS r, string_agg(r.start || ',' || r.length || ',' || r.period || chr(10), '' ORDER BY r.start, r.period) AS lines
            FROM (SELECT row, {{'start': start, 'length': length, 'period': period}} AS r, {{'a': -(length / CAST(period AS DOUBLE)), 'b': start, 'c': period}} AS o FROM run) GROUP BY row),
        gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM run),
        kept AS (SELECT word.row, string_agg(w, ' ' ORDER BY word.i) AS kept FROM word LEFT JOIN gone ON word.row = gone.row AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.row)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period, 1000 * r.length // r.period AS exponent_milli,
            sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
        FROM hashed LEFT JOIN best ON hashed.row = best.row LEFT JOIN kept ON hashed.row = kept.row""",
    "op12_vector_codes": _vector_codes_sql(16, 64, 2, 256),
}
