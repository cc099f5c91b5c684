"""URL filter: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

Both sides are brought to one canonical form. The filter, sent to every worker, lets possible hits through; they alone are
joined with the list, which removes false positives. A filter of more than ``bloom.MOST_BYTES`` is cut by key range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import bloom
from sievemark.llm.common import table

#: Hosts whose pages the registered query lists; any table of URLs serves as a list.
LISTED_HOSTS = "^(spam-farm|cheap-pills|casino-win|free-bets|ads-track)[.]"
_TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid|session|sid)(=|$)"


def canonical(url: Column) -> Column:
    """Without scheme, user, default port, leading ``www.`` or ``m.``, fragment, tracking parameters, index file and trailing slashes;
    host in lower case; parameters sorted. Null stays null, blank becomes empty."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    before, query = F.regexp_replace(bare, "\\?.*$", ""), F.regexp_extract(bare, "\\?(.*)$", 1)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(before, "^([^/]*)", 1)), "^.*@", ""), ":(80|443)$", ""), "^(www|m)\\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(before, "^[^/]*(.*)$", 1), "/index\\.html?$", ""), "/+$", "")
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_TRACKING))), "&")
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def listed(pages: DataFrame, urls: DataFrame, bits_per_key: int = bloom.BITS_PER_KEY, most_bytes: int = bloom.MOST_BYTES) -> DataFrame:
    """(page_id, url, canonical_url, listed) for every row of ``pages``; ``urls`` has a column url.

    Null url: canonical_url null, not listed; null list entries are ignored, blank ones too. Repeated pages: a row each; repeated
    list entries count once. Empty pages: no rows; empty list: nothing is listed. URLs of any
    length are compared whole. Other columns are ignored.
    """
    bad = urls.select(canonical(F.col("url").cast("string")).alias("canonical_url")).filter("canonical_url <> ''").distinct()
    rows = pages.select("page_id", "url", canonical(F.col("url").cast("string")).alias("canonical_url"))
    made = bloom.build(bad.select(bloom.key("canonical_url")), bits_per_key, most_bytes)
    marked = bad.select("canonical_url", F.lit(True).alias("listed"))
    tested = bloom.tested(rows, bloom.key("canonical_url"), made, "maybe")
    exact = tested.filter("maybe").drop("maybe").join(marked.hint("shuffle_hash"), "canonical_url", "left").select("page_id", "url", "canonical_url", F.coalesce("listed", F.lit(False)).alias("listed"))
    return tested.filter("not maybe").drop("maybe").withColumn("listed", F.lit(False)).unionByName(exact)


def _from_hosts(pages: DataFrame) -> DataFrame:
    host = F.regexp_replace(F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#]*)", 1), "^(www|m)\\.", "")
    return pages.filter(host.rlike(LISTED_HOSTS) & F.lower("url").startswith("http://")).select("url")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the list of the plain-http URLs on LISTED_HOSTS: the other spellings of the same addresses are found too."""
    pages = table(spark, sf_dir, "pages")
    return listed(pages, _from_hosts(pages))


_SQL_CANON = """
SELECT page_id, url, CASE WHEN url IS NULL THEN NULL ELSE host || path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canonical_url FROM (
  SELECT page_id, url,
    regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(before, '^([^/]*)', 1)), '^.*@', ''), ':(80|443)$', ''), '^(www|m)\\.', '') AS host,
    regexp_replace(regexp_replace(regexp_extract(before, '^[^/]*(.*)$', 1), '/index\\.html?$', ''), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid|session|sid)(=|$)'))), '&') AS kept
  FROM (SELECT page_id, url, regexp_replace(bare, '\\?.*$', '') AS before, regexp_extract(bare, '\\?(.*)$', 1) AS query
    FROM (SELECT page_id, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages)))
"""
ORACLE = f"""
WITH c AS ({_SQL_CANON}), bad AS (SELECT DISTINCT canonical_url FROM c WHERE canonical_url <> '' AND starts_with(lower(url), 'http://') AND
  regexp_matches(regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '^(www|m)\\.', ''), '{LISTED_HOSTS}'))
SELECT page_id, url, canonical_url, coalesce(canonical_url IN (SELECT canonical_url FROM bad), false) AS listed FROM c
"""
