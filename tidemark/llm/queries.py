"""The registered queries opN_<name> of the training-data operators, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import decode, encode
from .common import table
from .decontaminate import leaks
from .embedding_links import near_vectors
from .html_text import page_texts
from .language import languages
from .license_scan import scan
from .middle_fill import fill_middle, restored
from .mixing import label_domains, mix
from .near_dup import near_duplicates
from .phrases import collocations
from .quality import quality
from .repeats import remove_repeats
from .toxicity import toxicity


#: Wanted shares of tokens by the domains of the labels table.
TARGETS = {"clean": 0.8, "junk": 0.15, "toxic": 0.05}


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """``path`` is a tokenizer file; without one, the public word_bpe_49k.json."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_text, op2_toxicity, op3_embedding_near_dup, op4_license_scan, op5_minhash_near_dup, op6_decontamination, op7_language, op8_substring_dedup, op9_quality, op10_mixing,
        op11_collocations, op12_fill_middle, op13_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_dup": OP5_SQL, "op8_substring_dedup": OP8_SQL, "op11_collocations": OP11_SQL, "op12_fill_middle": OP12_SQL}


#: All pairs that share a shingle are counted, then the smallest reachable doc_id is walked out.
OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)
), e AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i : i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), starts AS (
  SELECT doc_id, list(i ORDER BY i) AS s FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM (SELECT doc_id, unnest(s) AS i FROM starts))
), words AS (
  SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w WHERE len(ws) > 0)
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, (len(w.ws) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

#: Every phrase of 1 to 5 words is counted.
OP11_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), s AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), g AS (
  SELECT lang, ws[i : i + k - 1] AS g FROM s, range(1, 6) AS t(k) WHERE i + k - 1 <= len(ws)
), f AS MATERIALIZED (
  SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS size, count(*) AS f FROM g GROUP BY ALL
), n AS MATERIALIZED (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), big AS MATERIALIZED (
  SELECT lang, phrase, size, f FROM f WHERE f >= 100
), c AS MATERIALIZED (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws FROM big WHERE size >= 2
), k AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, size)) AS k FROM c)
), cuts AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, n.n, ((1000::HUGEINT * k.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN big AS x ON x.lang = k.lang AND x.phrase = k.x JOIN big AS y ON y.lang = k.lang AND y.phrase = k.y JOIN n ON n.lang = k.lang
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), gone AS (
  SELECT s.lang, s.phrase FROM c AS s JOIN c AS b ON b.lang = s.lang AND b.size > s.size AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * b.a >= 100 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best ANTI JOIN gone USING (lang, phrase) QUALIFY rank <= 2000
"""

OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS ts, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT doc_id, text, ts, len(ts)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(ts) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(ts) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS cut, ('0x' || h[25:32])::BIGINT % 100 AS turn FROM t
), p AS (
  SELECT doc_id, text, n, array_to_string(ts[1 : least(x, y)], '') AS a, array_to_string(ts[least(x, y) + 1 : greatest(x, y)], '') AS b, array_to_string(ts[greatest(x, y) + 1 :], '') AS c,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR cut >= 90 THEN 'plain' WHEN turn < 20 THEN 'spm' ELSE 'psm' END AS form FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
