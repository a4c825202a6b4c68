"""The registered queries of this subpackage and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotline.llm import (fim, idfiles, kdtrees, licences, packing, pieces, shingles, simhash, suffixes, tiles, toxicity, unigram,
                          whitening)
from plotline.llm.vocabulary import tokenizer_path

WORD_BPE = ("word_bpe_49k.json", 49408)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.coded(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(_table(spark, folder, "documents"))


def op4_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return shingles.linked(_table(spark, folder, "documents"))


def op5_id_files(spark: SparkSession, folder: str) -> DataFrame:
    name, size = WORD_BPE
    return idfiles.through_files(_table(spark, folder, "documents"), tokenizer_path(name), end=1, vocab=size)


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return tiles.nearest(_table(spark, folder, "embeddings"), every=20, k=20)


def op7_exact_search(spark: SparkSession, folder: str) -> DataFrame:
    return kdtrees.search(_table(spark, folder, "embeddings"), every=100, k=10)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.sequences(_table(spark, folder, "documents"), tokenizer_path(WORD_BPE[0]), end=2)


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.token_counts(_table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op10_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeats(_table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """A deviation that fits no long is null; the operator itself returns up to 38 digits."""
    found = whitening.whitened(_table(spark, folder, "embeddings"), k=8)
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))


def op12_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim.digests(_table(spark, folder, "documents"))


def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.linked(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_toxicity, op3_licences, op4_ngram_join, op5_id_files, op6_nearest, op7_exact_search, op8_packing,
                            op9_token_counts, op10_suffix_dedup, op11_whitening, op12_fill_in_middle, op13_simhash)}

ORACLES: dict[str, str] = {
    "op6_nearest": """
        WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op7_exact_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
        u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
                     CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                     CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
                     greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
                     CASE WHEN h1 IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                          THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(units[1:a], '') AS head, array_to_string(units[a + 1:b], '') AS mid,
                     array_to_string(units[b + 1:n], '') AS tail FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || mid
                      ELSE '<S>' || tail || '<P>' || head || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
