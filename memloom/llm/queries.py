"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codebooks, decontam, divergence, fingerprints, langid, lines, minhash, mixing, packing, quality, secrets, substring
from .common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(docs, labels, carry=["doc_id"])


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digests(substring.remove_repeats(table(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedupe_lines(table(spark, sf_dir, "documents"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shuffle_key")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings")).drop("label")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language_id": op6_language_id,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_line_dedup": op8_line_dedup,
    "op9_document_fingerprints": op9_document_fingerprints,
    "op10_mix_sources": op10_mix_sources,
    "op11_vector_codes": op11_vector_codes,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_source_divergence": op13_source_divergence,
}


def _codes_sql(rounds: int = codebooks.ROUNDS) -> str:
    """The rounds of op11 one after another."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS (
  SELECT row, part, min(d * 16 + entry) AS best FROM (
    SELECT x.row, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} b ON b.part = x.part AND b.i = x.i GROUP BY ALL
  ) GROUP BY ALL
)""")
        if k < rounds:
            steps.append(f"""m{k} AS (
  SELECT x.part, a.best % 16 AS entry, x.i, ((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v FROM x JOIN a{k} a ON a.row = x.row AND a.part = x.part GROUP BY ALL
), b{k + 1} AS (
  SELECT b.part, b.entry, b.i, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry, i)
)""")
    return f"""
WITH usable AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0
), x AS (
  SELECT row, (j - 1) // (len(e) // 8) AS part, (j - 1) % (len(e) // 8) AS i, floor(4096 * e[j]::DOUBLE)::BIGINT AS v
  FROM (SELECT *, unnest(range(1, len(e) + 1)) AS j FROM usable)
), b0 AS (
  SELECT part, row - 1 AS entry, i, v FROM x WHERE row <= 16
), {", ".join(steps)}, coded AS (
  SELECT row, string_agg(printf('%02x', (best % 16)::BIGINT), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM a{rounds} GROUP BY row
), digest AS (
  SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, i)) AS h FROM b{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256
FROM coded JOIN usable USING (row), digest
"""


ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (
  SELECT d.doc_id, count(s.s) AS n FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN shingles s USING (doc_id) GROUP BY d.doc_id
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other
), least_id AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, s.n AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sizes s JOIN least_id USING (doc_id)
""",
    "op5_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, s AS start, sha256(array_to_string(w[s:s + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20)
), repeated AS (
  SELECT doc_id, start FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, start) AS k FROM windows) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + 20)) AS i FROM repeated
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words
), marked AS (
  SELECT e.doc_id, e.i, e.word, g.i IS NULL AS keep FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (NOT keep) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (keep), '') AS t
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
""",
    "op10_mix_sources": r"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), rates AS (
  SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM counts) * (SELECT sum(n) FROM counts)::DOUBLE / n AS rate FROM counts
), cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
), drawn AS (
  SELECT d.*, ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d
), copies AS (
  SELECT d.doc_id, d.source, count(*) AS n FROM drawn d JOIN cdf ON cdf.source IS NOT DISTINCT FROM d.source AND c <= u GROUP BY 1, 2
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, copy
FROM (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM copies) JOIN documents d USING (doc_id)
""",
    "op11_vector_codes": _codes_sql(),
    "op13_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), w AS (
  SELECT r, lang, source,
         unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d
), kept AS (
  SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v) AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), l AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + v) AS q FROM c JOIN v USING (lang) GROUP BY lang, term, v
), apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM rows)
WHERE part = 'pair' OR rank <= 200
""",
}
