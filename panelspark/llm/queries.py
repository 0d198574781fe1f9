"""Registered queries over the given tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, exact_dedup, katz_lm, license_scan, line_dedup, minhash, packing, phrases, quality_rules, sharding, token_align, tree_bpe, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its class of near-equal lines and its number of links."""
    return line_dedup.line_classes(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy that stays, by progressive refinement.

    The contract asks for the whole-text hash of every row; the operator itself
    hashes only texts that shorter keys could not tell apart.
    """
    sha = F.sha2(F.encode("t", "UTF-8"), 256)
    found = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), carry={"text_sha256": sha})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards whose row counts are at most one apart."""
    dealt = sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The rules (host, path, verdict) that the query is asked to apply.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


#: Hosts whose addresses are listed, with all their subdomains.
SPAM_HOSTS = ["casino-win.example.com", "free-bets.example.com", "cheap-pills.example.com", "spam-farm.example.com"]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules, and by a list of addresses on spam hosts.

    The list is made from the pages themselves: what was seen over ``http`` on a
    spam host.  It decides by the canonical address: other spellings of a listed
    page (``https``, tracking, a closing slash) are blocked, other pages of the host
    are not.
    """
    pages = _table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    host = url_filter.host_and_path(F.col("url"))[0]
    spam = F.lit(False)
    for name in SPAM_HOSTS:
        spam = spam | (host == name) | host.endswith("." + name)
    listed = pages.where(F.col("url").startswith("http://") & spam).select("url", F.lit("block").alias("verdict"))
    return url_filter.judge_urls(pages, rules, listed, carry=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://(.*)$', 1, 's') ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '&'), lambda p: p <> ''
           AND NOT regexp_matches(p, '^(utm_[a-z]+|gclid|fbclid|ref|ref_src|mc_cid|mc_eid|sessionid|sid)(=|$)', 'i'))) AS asked FROM u),
c AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), ':(80|443)?$', ''), '^www\.|\.$', '', 'g')
         || regexp_replace(path, '/+$', '') || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS canonical
  FROM h),
listed AS (
  SELECT DISTINCT canonical FROM c WHERE starts_with(url, 'http://') AND canonical <> ''
    AND regexp_matches(host, '(^|\.)(casino-win|free-bets|cheap-pills|spam-farm)\.example\.com$')),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN contains(url, '://') AND canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the licence that one of its lines states, if any."""
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.fit(docs))


def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under a model of the documents that are not held out."""
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return katz_lm.score_documents(_table(spark, sf_dir, "documents"), held_out)


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near duplicates."""
    return minhash.near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics, fixed verdict and learned verdict."""
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, _table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    pieces = packing.token_pieces(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return packing.pack(pieces, capacity=1024)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the ranks and decoded again."""
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens of two tokenizers, aligned, with the corpus-wide counts of their links."""
    return token_align.alignment_figures(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of two or three words of each language."""
    return phrases.collocations(_table(spark, sf_dir, "documents"), longest=3, least=10, most=2000)


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(list_slice(w, i, i + size - 1), ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS v(size)),
f AS (SELECT lang, size, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, phrase, max(f) AS longer
  FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, f FROM f WHERE size = 3) GROUP BY 1, 2),
c AS (
  SELECT f.lang, f.phrase, f.f AS a, size, w FROM f LEFT JOIN longer USING (lang, phrase)
  WHERE size > 1 AND 100 * coalesce(longer, 0) < 50 * f.f),
cut AS (
  SELECT lang, phrase, a, 1 AS k, w[1] AS part1, array_to_string(w[2:], ' ') AS part2 FROM c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE size = 3),
s AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = part1 JOIN f AS y ON y.lang = cut.lang AND y.phrase = part2),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM low JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the vocabulary's merges, long ones in leaves, and decoded again."""
    return tree_bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_license_scan": op5_license_scan,
    "op6_katz_lm": op6_katz_lm,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_align": op11_token_align,
    "op12_phrases": op12_phrases,
    "op13_tree_bpe": op13_tree_bpe,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op12_phrases": OP12_SQL,
}
