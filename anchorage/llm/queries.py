"""Queries over whole tables, one per operator, and the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorage.llm import bpe, html_text, jpeg, minhash, mixing, ngram_lm, quality, sharding, substring, toxicity
from anchorage.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, by the stored map of 8,192 virtual slots; nulls, repeated rows and no rows as in ``shard_documents``."""
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as JPEG and read back; nulls, repeated rows and no rows as in ``media_digests``."""
    return jpeg.media_digests(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates at 85 percent; nulls, repeated rows and no rows as in ``near_duplicates``."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's scores; nulls, repeated rows and no rows as in ``scores``."""
    return ngram_lm.scores(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's share of the mix; nulls, repeated rows and no rows as in ``mixed``."""
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's statistics and verdict; nulls, repeated rows and no rows as in ``quality_rules``."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without what smaller documents have; nulls, repeated rows and no rows as in ``digests``."""
    return substring.digests(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's probabilities and verdicts by a chain trained on ``labels``; nulls, repeated rows and no rows as in ``train_on`` and ``predict``."""
    documents = table(spark, sf_dir, "documents")
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.train_on(documents, table(spark, sf_dir, "labels"), categories)
    return toxicity.predict(documents, chain, list(categories))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's token ids as digests; nulls, repeated rows and no rows as in ``encoded``."""
    ranks = public_tokenizers.path(VOCABULARY)
    return bpe.encoded(table(spark, sf_dir, "documents"), str(ranks), public_tokenizers.PATTERN)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text; nulls, repeated rows and no rows as in ``main_text``."""
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_media_columns": op2_media_columns,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_mixing": op5_mixing,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_html_extraction": op10_html_extraction,
}

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs with a common shingle, counted; components by closing the links.
_NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b)
SELECT r.a AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
FROM reach r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""

_SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
runs AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT h, min(doc_id) AS f FROM runs GROUP BY h),
gone AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 50)) AS k FROM runs JOIN firsts USING (h) WHERE f < doc_id)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT o.doc_id, count(*) AS n_words, count(g.k) AS n_removed, string_agg(o.word, ' ' ORDER BY o.k) FILTER (WHERE g.k IS NULL) AS text
         FROM words o LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.k = o.k GROUP BY o.doc_id)
SELECT d.doc_id, coalesce(k.n_words, 0) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""

#: The test pages mark their articles plainly and no line of one may be deleted, so regular expressions suffice for them.
_PAGES = r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, coalesce(array_to_string(list_filter(list_transform(
    regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '<br>', ' ', 'g'), '</?(?:p|h1)>'),
    lambda b: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(b, '</?b>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g'))), lambda b: b <> ''), chr(10)), '') AS text
  FROM pages)
"""

ORACLES: dict[str, str] = {
    "op3_minhash_near_dedup": _NEAR_DUPLICATES,
    "op7_substring_dedup": _SUBSTRINGS,
    "op10_html_extraction": _PAGES,
}
