"""URL filter: a blocked Bloom filter of listed keys in front of an exact hash join.

Two kinds of keys are listed: canonical URLs with a verdict, and rules (host,
path) with a verdict.  A URL's candidate keys are its canonical form, and every
(host suffix, path prefix) that a rule could have.  The Bloom filter passes
candidates that may be listed; a join on the key itself removes false positives,
so the result is exact whatever the filter's size.

The filter is a table of blocks.  A key belongs to one block, by one hash, and
sets ``PROBES`` bits in its 256-bit word, by others; a lookup reads one row.
The number of blocks follows the list up to ``MOST_BLOCKS``, the bound under which
the filter is broadcast: a longer list only makes it pass more.

Rules: host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or
the end, A to Z lower-cased; path goes on up to ``?``, ``#`` or the end.  A rule
fits its host and all subdomains if the path starts with the rule's path.  The
longest rule wins; of rules as long, that with the longer host.  Rules come
before listed URLs; a URL that neither lists gets the default.

Defined results: a URL that is null or has no ``://`` has an empty host and path,
fits no rule and gets the default.  A canonical form that is empty (as of
``http://www./``) is never listed.  Repeated rows are judged one by one.  Of listed
keys that repeat, ``block`` wins.  Null hosts, paths or URLs in the lists are
ignored.  Columns of the pages that are named like a result are replaced by it.
An empty table of pages gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm._shared import written

#: Blocks of the filter, at most: 16 MB as a table of four longs a block.
MOST_BLOCKS = 1 << 18
#: Bits that a key sets in its block.
PROBES = 6
#: Listed keys that one block is meant to have.
BLOCK_KEYS = 16

#: Rules up to which they are broadcast; more go through the same hash join as listed URLs.
MOST_RULES = 10_000

#: Query parameters that only track visits.
TRACKING = r"(utm_[a-z]+|gclid|fbclid|ref|ref_src|mc_cid|mc_eid|sessionid|sid)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical_url(url: Column) -> Column:
    """One form for the spellings of an address.

    Without scheme, user, ``www.``, default port, fragment, tracking parameters
    and closing slash; host in lower case, other parameters in order.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)?$", "")
    host = F.regexp_replace(host, r"^www\.|\.$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"(?i)^{TRACKING}(=|$)")))
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.concat(host, F.regexp_replace(path, r"/+$", ""), asked)


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, F.lit(" "), path)


def _blocks(keys: DataFrame) -> tuple[DataFrame, int]:
    """The filter as ``block, w0 .. w3``, and its number of blocks."""
    n = max(1, min(MOST_BLOCKS, keys.count() // BLOCK_KEYS))
    words = [F.bit_or(F.expr("aggregate({}, 0L, (m, b) -> m | if(b div 64 = {}, shiftleft(1L, cast(b % 64 as int)), 0L))".format("bits", i))).alias(f"w{i}") for i in range(4)]
    placed = keys.select(_block(F.col("key"), n).alias("block"), _bits(F.col("key")).alias("bits"))
    return placed.groupBy("block").agg(*words), n


def _block(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def _bits(key: Column) -> Column:
    """The places of a key's bits in its 256-bit block."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(256)) for i in range(PROBES)])


def judge_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, default: str = "allow", url_col: str = "url", carry: list[str] | None = None) -> DataFrame:
    """One row per page: ``carry`` columns, ``host, path, canonical, rule, verdict``.

    ``rules``: ``host, path, verdict``.  ``listed``: ``url, verdict``.
    """
    carry = [c for c in (pages.columns if carry is None else carry) if c not in ("host", "path", "canonical", "rule", "verdict")]
    url = F.col(url_col)
    host, path = host_and_path(url)
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), url.alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", F.when(F.instr("url", "://") > 0, canonical_url(F.col("url"))).alias("canonical"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows.drop("url"), "url-rows")

    rule = rules.where("host is not null and path is not null")
    by_rule = rule.select(_rule_key(F.col("host"), F.col("path")).alias("key"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_chars"), "verdict")
    urls = listed.where((F.instr("url", "://") > 0) & (canonical_url(F.col("url")) != "")).select(F.concat(F.lit("url "), canonical_url(F.col("url"))).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("host_chars"), "verdict")
    keys = by_rule.unionByName(urls).groupBy("key").agg(F.first("rule").alias("rule"), F.first("host_chars").alias("host_chars"), F.max("verdict").alias("verdict"))
    keys = written(keys, "url-keys")
    blocks, n = _blocks(keys.select("key"))
    blocks = written(blocks, "url-blocks")

    # lengths of the rules' paths, the only prefixes worth trying: one small row
    lengths = rule.agg(F.collect_set(F.length("path")).alias("lengths"))
    tried = rows.crossJoin(F.broadcast(lengths)).withColumn("labels", F.split("host", r"\."))
    suffixes = F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, i, size(labels)), '.'))")
    prefixes = F.expr("transform(filter(lengths, n -> n <= length(path)), n -> substring(path, 1, n))")
    candidates = F.expr("flatten(transform(suffixes, h -> transform(prefixes, p -> concat('rule ', h, ' ', p))))")
    tried = tried.withColumn("suffixes", suffixes).withColumn("prefixes", prefixes)
    tried = tried.select("at", F.explode(F.array_append(F.when(F.col("host") != "", candidates).otherwise(F.array().cast("array<string>")), F.concat(F.lit("url "), F.col("canonical")))).alias("key")).where("key is not null")
    probed = tried.withColumn("block", _block(F.col("key"), n)).withColumn("bits", _bits(F.col("key"))).join(F.broadcast(blocks), "block")
    maybe = probed.where(F.expr("forall(bits, b -> (shiftright(element_at(array(w0, w1, w2, w3), cast(b div 64 as int) + 1), cast(b % 64 as int)) & 1) = 1)"))

    # a rule may fit most pages, so rules do not go through the shuffle by key if they are few
    of_rule = F.col("key").startswith("rule ")
    few = keys.where(of_rule).count() <= MOST_RULES
    by_rule, by_url = keys.where(of_rule), keys.where(~of_rule)
    hits = maybe.where(of_rule).select("at", "key").join(F.broadcast(by_rule) if few else by_rule, "key")
    hits = hits.unionByName(maybe.where(~of_rule).select("at", "key").join(by_url, "key"))
    rank = F.struct(F.col("rule").isNotNull().alias("by_rule"), F.length(F.coalesce("rule", F.lit(""))).alias("chars"), "host_chars", "key")
    best = hits.groupBy("at").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    out = rows.join(best, "at", "left")
    return out.select("row.*", "host", "path", "canonical", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
