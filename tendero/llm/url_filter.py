"""Rules over host and path, then a list of canonical URLs behind a blocked Bloom filter.

DataFrame functions only. The filter is a table of blocks of 256 bits; a URL sets one bit in each
of the eight words of its block, so one row answers for it. What passes goes to an exact
join with the list, which removes the false positives.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tendero.llm.tables import written

WORDS = 8
BLOCK_BITS = 256
BITS_PER_URL = 16
#: Bytes up to which the filter is sent to every executor; a larger one is joined by block.
BROADCAST_BYTES = 64 << 20

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), ascii_uppercase, ascii_lowercase)


def path(url: Column) -> Column:
    """After the host up to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for addresses of one page: no scheme, ``www.`` or ``m.``, query, fragment, closing ``/`` or ``.html``."""
    return F.concat(F.regexp_replace(host(url), r"^(www|m)\.", ""), F.regexp_replace(path(url), r"(\.html|/+)$", ""))


def rule_for(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits as ``struct(rule, verdict)``, else null.

    A rule (verdict, host, path) fits its host and all subdomains where the path starts
    with its own; of equally long rules the first given holds.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2]))[::-1]:
        fits = ((host_ == at) | host_.endswith("." + at)) & path_.startswith(start)
        found = F.when(fits, F.struct(F.lit(at + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bits(url: Column, blocks: int) -> list[Column]:
    """The block of a URL, and its bit in each word."""
    place = F.xxhash64(url, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(place, 5 * k).bitwiseAND(31).cast("int")).alias(f"b{k}") for k in range(WORDS)]
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *bits]


def bloom_filter(urls: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w7`` over the column ``canonical``."""
    words = [F.bit_or(f"b{k}").alias(f"w{k}") for k in range(WORDS)]
    return urls.where("canonical IS NOT NULL").select(*_bits(F.col("canonical"), blocks)).groupBy("block").agg(*words)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, canonical`` for each row of ``pages`` (``page_id``, ``url``).

    The longest fitting rule gives its verdict. Where none fits, a URL whose canonical form is in
    ``listed`` (column ``canonical``) is blocked, any other allowed. A null URL or one
    without ``://`` has empty host and path, fits no rule with a host and has the empty canonical form,
    which is never listed. Empty tables, repeated rows and null ids are carried through;
    other columns of either table are ignored.
    """
    listed = written(listed.select("canonical").where("canonical != ''").distinct(), "listed")
    blocks = listed.count() * BITS_PER_URL // BLOCK_BITS + 1
    bloom = bloom_filter(listed, blocks)
    if blocks * (8 + 4 * WORDS) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), canonical(url).alias("canonical"))
    rows = rows.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    ruled = rows.where("found IS NOT NULL").select("page_id", "host", "path", "found.rule", "found.verdict", "canonical")
    free = rows.where("found IS NULL").select("page_id", "host", "path", "canonical", *_bits(F.col("canonical"), blocks)).join(bloom, "block", "left")
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.col(f"w{k}").bitwiseAND(F.col(f"b{k}")) == F.col(f"b{k}"))
    free = free.withColumn("hit", F.coalesce(hit, F.lit(False)))
    none = F.lit(None).cast("string").alias("rule")
    hits = free.where("hit").join(listed.withColumn("listed", F.lit(True)), "canonical", "left")
    hits = hits.select("page_id", "host", "path", none, F.when(F.col("listed"), "block").otherwise("allow").alias("verdict"), "canonical")
    misses = free.where("NOT hit").select("page_id", "host", "path", none, F.lit("allow").alias("verdict"), "canonical")
    return ruled.unionByName(hits).unionByName(misses)


def tracked(pages: DataFrame) -> DataFrame:
    """A list to block: the canonical form of every URL that some page carries with a campaign mark."""
    url = F.col("url").cast("string")
    return pages.where(url.rlike(r"[?&]utm_source=")).select(canonical(url).alias("canonical"))
