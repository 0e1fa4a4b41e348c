"""URL filters: rules by host and path, then a list of canonical URLs.

The list goes into a blocked Bloom filter: a URL's bits all lie in one block of eight 64-bit words,
built by bit_or over the list. Blocks are bounded in number, so they are broadcast; what they pass goes
to an exact join with the list, which removes false positives. A longer list than the filter is made
for passes more to that join, and loses nothing. A URL that a third of all pages share is counted first and meets
a broadcast of its verdict.

Defined results. A null url, or one without `://`, has an empty host and path, fits no rule and is never listed. Repeated
rows are judged alike, very long URLs whole, an empty table gives no row, and only page_id and url are read.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .common import settled, with_totals

#: Verdict, host and path of each rule. A few, so they stand in the plan itself.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: The query's list: canonical URLs of which the first 16 bits of the MD5 are divisible by this, and for each of
#: them one that no page has.
LISTED_ONE_IN = 16
#: URLs of a block of 512 bits, and blocks at most (64 MB, 32 million URLs at that filling).
URLS_PER_BLOCK, MOST_BLOCKS = 32, 1 << 20
WORDS = 8

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = r"^.*?://([^/?#]*)"
PATH = r"^.*?://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + PATH, 1)


def canonical(host: Column, path: Column) -> Column:
    """Host without www. or m., path without a last `/` or .html; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def parts(pages: DataFrame) -> DataFrame:
    df = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return df.withColumn("canonical", canonical(F.col("host"), F.col("path")))


def fitting(rules=RULES) -> Column:
    """The longest rule that fits, as a struct (size, rule, verdict); null if none does."""
    found = [F.when(((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path), F.struct(F.lit(len(host + path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, host, path in rules]
    return F.coalesce(*[c for _, c in sorted(zip((len(h + p) for _, h, p in rules), found, strict=True), key=lambda x: -x[0])])


def _bits(url: Column, blocks: int) -> list[Column]:
    """The block's number and one bit of each of its words."""
    spread = F.xxhash64(url, F.lit("bits"))
    masks = [F.expr("1L").cast("long")] * WORDS
    return [F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block"), *[F.call_function("shiftleft", m, F.shiftrightunsigned(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")).alias(f"m{i}") for i, m in enumerate(masks)]]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """listed(canonical) to at most `blocks` rows (block, w0..w7)."""
    return listed.select(*_bits(F.col("canonical"), blocks)).groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(WORDS)])


def block_count(listed_urls: int) -> int:
    return min(MOST_BLOCKS, max(1, -(-listed_urls // URLS_PER_BLOCK)))


def flagged(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """urls with `maybe`: whether the filter of listed(canonical) passes their canonical URL."""
    blocks = block_count(listed.count())
    keys = [f"m{i}" for i in range(WORDS)]
    found = urls.select("*", *_bits(F.col("canonical"), blocks)).join(F.broadcast(bloom(listed, blocks)), "block", "left")  # at most MOST_BLOCKS rows
    every = F.lit(True)
    for i, m in enumerate(keys):
        every = every & F.coalesce(F.col(f"w{i}").bitwiseAND(F.col(m)) == F.col(m), F.lit(False))
    return found.withColumn("maybe", every).select(*urls.columns, "maybe")


def judged(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict; listed(canonical) is what to block where no rule fits."""
    listed = settled(listed.select("canonical").distinct())
    urls = settled(flagged(parts(pages).withColumn("fit", fitting(rules)), listed))
    asked = F.col("maybe") & F.col("fit").isNull()
    hits = urls.filter(asked)
    found = hits.groupBy("canonical").agg(F.count("*").alias("n"))
    found = settled(found.join(listed.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False))))  # exact
    hits = with_totals(hits, found, "canonical").select(*urls.columns, "listed")
    out = urls.filter(~asked).withColumn("listed", F.lit(False)).unionByName(hits)
    return out.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """The query's list, drawn by hash, so that it has nothing to do with hosts, paths or rules."""
    share = F.conv(F.substring(F.md5("canonical"), 1, 4), 16, 10).cast("int") % LISTED_ONE_IN == 0
    drawn = parts(pages).filter(share & (F.col("canonical") != "")).select("canonical").distinct()
    return drawn.select(F.explode(F.array("canonical", F.concat("canonical", F.lit("/gone")))).alias("canonical"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judged(pages, listed_urls(pages))


OP8_SQL = rf"""
with parts as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path
  from pages),
ruled as (
  select *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') as canonical, case
      when ('.' || host) like '%.www.example.com' and starts_with(path, '/en/') then 'www.example.com/en/'
      when ('.' || host) like '%.example.com' and starts_with(path, '/en/') then 'example.com/en/'
      when ('.' || host) like '%.net' and starts_with(path, '/es/') then 'net/es/'
      when ('.' || host) like '%.net' and starts_with(path, '/fr/') then 'net/fr/'
      when ('.' || host) like '%.com' and starts_with(path, '/') then 'com/' end as rule
  from parts),
drawn as (select distinct canonical from ruled where canonical <> '' and ('0x' || substr(md5(canonical), 1, 4))::int % {LISTED_ONE_IN} = 0),
listed as (select canonical from drawn union select canonical || '/gone' from drawn)
select page_id, host, path, rule, case
    when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block'
    when canonical in (select canonical from listed) then 'block' else 'allow' end as verdict
from ruled
"""
