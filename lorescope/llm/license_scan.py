"""License scans in DataFrame functions alone: MinHash bands find windows like a template's, exact shingles verify.

Templates of 60 words or more (whole license texts) are looked for by windows of 28 words, that is 26 shingles of three
words, which start at every twentieth word of a document and at every word of a template; a band is two MinHash
values, and there are four. Windows with a similarity of s meet with probability 1 - (1 - s^2)^4: always if they
agree, 0.98 at s = 0.79 (one word changed in the middle), 0.87 at 0.63 (two), 0.67 at 0.49 (three), 0.08 at 0.14. With
every twentieth word changed one window of eight is missed, and a text of 100 words, which has four of them, less
often than once in a thousand.

Shorter templates (notices of one line) need windows of two shingles of five words, at every word, with two bands of one
value under an order and its reverse: of two shingles each comes first in one of them, so a window that shares a
shingle with a template always meets it.

Verification is exact. A template is in a document if at least 0.8 of the template's words lie in five-word
shingles that the document has. For windows of notices these are the windows' own shingles; a candidate for a whole text
is read again, and all its shingles count. So one word changed in a line of eleven, or one in twenty in a long
text, does not hide it.

What depends on the templates is counted: a bitmap of notices' MinHash values has 64 places a value and 2^20
at most (more values send more windows to the exact join, and lose none), and band keys meet windows in a join, by
broadcast if there are few enough.

Words are runs of ASCII letters, digits and other non-ASCII characters, in lower case. A template of fewer
than five words has no shingle; such a template is an error.

Defined results. A null, empty or short text has no match. Rows with one doc_id are one document; a row without one is
known by its text. Very long texts give as many windows as they need, and nothing is cut. An empty table gives no row.
Only doc_id and text are read.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import settled, small_or_not, text_or_empty
from .license_texts import NOTICES, TEXTS

SHINGLE = 5
CONTAINMENT = 0.8
#: Templates of so many words at least are whole texts.
LONG = 60
#: Notices: shingles of a window.
PER_WINDOW = 2
#: Whole texts: words of a shingle, shingles of a window, how far apart windows start, bands, and values of a band.
WIDE_SHINGLE, WIDE, STRIDE, WIDE_BANDS, WIDE_ROWS = 3, 26, 20, 4, 2
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPAN = SHINGLE + PER_WINDOW - 1
SHINGLES = [f"s{k}" for k in range(PER_WINDOW)]
PLACES_A_VALUE, MOST_PLACES = 64, 1 << 20
#: By these the 64 bits of shingles are turned over before the least is taken: an order of its own for each value.
#: A turn and its complement make an order and its reverse.
TURNS = [(0x9E3779B97F4A7C15 * (2 * k + 1) + (1 << 63)) % (1 << 64) - (1 << 63) for k in range(WIDE_BANDS * WIDE_ROWS)]


def hashed_words(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(text), BREAKS), ""), lambda w: F.xxhash64(w))


def once(c: Column) -> Column:
    """A column as the output of a generator: the optimizer copies it into no filter and no lambda, where it would be
    worked out again for each element."""
    return F.explode_outer(F.array(c))


def document() -> Column:
    """What tells documents apart."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(text_or_empty()))).alias("doc")


def windows(df: DataFrame, *keys: str) -> DataFrame:
    """keys and s0, s1: hashes of a window's shingles, null where the text has ended. df has keys and h, the hashed words."""
    ahead = F.arrays_zip(*[(F.col("h") if k == 0 else F.slice("h", k + 1, 2**30)).alias(f"w{k}") for k in range(SPAN)])
    df = df.select(*keys, F.inline_outer(ahead))
    return df.select(*keys, *[F.when(F.col(f"w{k + SHINGLE - 1}").isNotNull(), F.xxhash64(*[f"w{k + j}" for j in range(SHINGLE)])).alias(f"s{k}") for k in range(PER_WINDOW)]).filter("s0 is not null")


def shingled(h: Column, words: int = SHINGLE) -> Column:
    """Hashes of the shingles of hashed words, in order."""
    n = F.greatest(F.size(h) - (words - 1), F.lit(0))
    starts = F.slice(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), 1, n)
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))


def wide_windows(df: DataFrame, stride: int, *keys: str) -> DataFrame:
    """keys and win, the shingles of a window. df has keys and s, the shingles."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)), F.lit(stride))
    return df.select(*keys, F.explode_outer(F.transform(starts, lambda i: F.slice("s", i, WIDE))).alias("win")).filter(F.size("win") > 0)


def wide_bands(df: DataFrame, *keys: str) -> DataFrame:
    """keys and band, a hash of the band's number and values, for each band of a window."""
    least = [F.array_min(F.transform("win", lambda x, t=t: x.bitwiseXOR(F.lit(t)))) for t in TURNS]
    bands = [F.xxhash64(F.lit(b), *least[b * WIDE_ROWS : (b + 1) * WIDE_ROWS]) for b in range(WIDE_BANDS)]
    return df.select(*keys, F.explode_outer(F.array(*bands)).alias("band"))


def bands() -> list[Column]:
    """MinHash of a narrow window's shingles under an order and its reverse."""
    return [F.least(*[F.col(s).bitwiseXOR(F.lit(t)) for s in SHINGLES]) for t in (TURNS[0], ~TURNS[0])]


def _templates(spark, templates: dict[str, str]) -> DataFrame:
    """(license, h, words)"""
    df = spark.createDataFrame(list(templates.items()), "license string, text string").select("license", hashed_words(F.col("text")).alias("h"))
    df = settled(df.withColumn("words", F.size("h")))
    if short := [r["license"] for r in df.filter(F.col("words") < SHINGLE).select("license").take(5)]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    return df


def passing(minhashes: DataFrame) -> Column:
    """Whether a narrow window has a MinHash value of minhashes(band, minhash), by a bitmap for each band."""
    n = minhashes.groupBy("band").count().agg(F.max("count")).first()[0] or 1
    places = 64
    while places < min(MOST_PLACES, PLACES_A_VALUE * n):
        places *= 2
    place = lambda m: F.shiftrightunsigned(m, 20).bitwiseAND(F.lit(places - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    # at most 2 * 2^14 rows, whatever the number of templates
    found = minhashes.select("band", place(F.col("minhash")).alias("place")).groupBy("band", F.shiftrightunsigned("place", 6).alias("at")).agg(F.bit_or(one).alias("bits")).collect()
    maps = [[0] * (places // 64) for _ in bands()]
    for r in found:
        maps[r["band"]][r["at"]] = r["bits"]
    hits = []
    for b, m in enumerate(bands()):
        held = F.split(F.lit(",".join(map(str, maps[b]))), ",").cast("array<long>")
        hits.append(F.getbit(F.get(held, F.shiftrightunsigned(place(m), 6).cast("int")), place(m).bitwiseAND(F.lit(63)).cast("int")) == 1)
    return reduce(Column.__or__, hits)


def narrow_held(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc, license and shingle of what windows of two shingles share with notices."""
    index = windows(templates, "license")
    index = settled(index.union(index.select("license", "s0", F.lit(None).cast("long"))).distinct())
    minhashes = settled(index.select("license", F.posexplode(F.array(*bands())).alias("band", "minhash")).distinct())
    found = windows(docs.select(document(), "doc_id", once(hashed_words(text_or_empty())).alias("h")), "doc", "doc_id").filter(passing(minhashes.select("band", "minhash").distinct()))
    near = found.select("doc", "doc_id", F.array_compact(F.array(*SHINGLES)).alias("s"), F.posexplode(F.array(*bands())).alias("band", "minhash"))
    return near.join(small_or_not(minhashes), ["band", "minhash"]).select("doc", "doc_id", "license", F.explode("s").alias("shingle"))


def wide_candidates(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc, license) whose wide windows meet in a band."""
    index = settled(wide_bands(wide_windows(templates.select("license", shingled(F.col("h"), WIDE_SHINGLE).alias("s")), 1, "license"), "license").distinct())
    hashed = docs.select(document(), once(hashed_words(text_or_empty())).alias("h")).select("doc", once(shingled(F.col("h"), WIDE_SHINGLE)).alias("s"))
    return wide_bands(wide_windows(hashed, STRIDE, "doc"), "doc").join(small_or_not(index), "band").select("doc", "license").distinct()


def wide_held(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc, license and shingle of all shingles of candidate documents."""
    asked = settled(wide_candidates(docs, templates))
    texts = docs.select(document(), "doc_id", "text").join(small_or_not(asked), "doc")
    hashed = texts.select("doc", "doc_id", "license", once(hashed_words(text_or_empty())).alias("h"))
    return hashed.select("doc", "doc_id", "license", F.explode_outer(F.array_distinct(shingled(F.col("h")))).alias("shingle"))


def matches(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, matched (shingles of the template that the document has) and containment (share of the
    template's words in them)."""
    known = _templates(docs.sparkSession, NOTICES | TEXTS if templates is None else templates)
    shingles = settled(known.select("license", "words", F.posexplode(shingled(F.col("h"))).alias("place", "shingle")))
    held = narrow_held(docs, known.filter(F.col("words") < LONG)).unionByName(wide_held(docs, known.filter(F.col("words") >= LONG)))
    # in the scan itself: what no template has goes before anything is shuffled
    held = held.join(small_or_not(shingles), ["license", "shingle"])
    # a template's own places, so the sets are bounded by its length
    held = held.groupBy("doc", "doc_id", "license", "words").agg(F.collect_set("place").alias("places"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (SHINGLE - 1))))))
    out = held.select("doc_id", "license", F.size("places").cast("long").alias("matched"), (covered / F.col("words")).alias("containment"))
    return out.filter(F.col("containment") >= containment)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in (NOTICES | TEXTS).items())
    cut = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    shingles = f"list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' '))"
    return f"""
with known as (select license, {cut} as w from (values {rows}) v(license, text)),
templates as (select license, len(w) as words, unnest(range(len(w) - {SHINGLE - 1})) as place, unnest({shingles}) as shingle from known),
texts as (select distinct doc_id, shingle from (
  select doc_id, unnest(list_distinct({shingles})) as shingle from (select doc_id, {cut} as w from documents) where len(w) >= {SHINGLE})),
held as (select distinct doc_id, license, words, place from texts join templates using (shingle)),
covered as (
  select doc_id, license, words, count(distinct place) as matched, count(distinct place + k) as covered
  from held, (select unnest(range({SHINGLE})) as k) group by doc_id, license, words)
select doc_id, license, matched, covered::double / words::double as containment from covered where covered::double / words::double >= {CONTAINMENT}
"""


OP1_SQL = _sql()
