"""SpotSigs fingerprints in DataFrame functions only.

Words are runs of letters and digits of the lower-cased text. Common words are anchors; the ``chain`` content words that
follow an anchor (further anchors skipped, a run of anchors counting once) form a spot signature, shorter at the end of
the text. A fingerprint is the set of its signatures' CRC-32 values, written as sorted eight-digit hex numbers.

Likeness is the Jaccard coefficient of two sets, pruned by length first: sets whose sizes alone keep them below
``least`` get no intersection (``likeness`` with ``least`` = 0 is exact for all). ``near_pairs`` compares stated pairs
that way, within partitions of neighbouring set lengths.

Cases: null is empty; a text without an anchor, or with nothing after one, has one signature, the whole word sequence; a
text without words has the empty fingerprint; two empty
fingerprints have likeness 1, an empty and another 0. Equal texts have equal fingerprints. Very long texts are
fingerprinted whole, the set being one array of a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: common words of English, German, French and Spanish
ANCHORS = (
    "the of and to in a is that it for was on with be as by this are at from he or an not which you "
    "der die und den von das zu mit sich auf für ist des im dem nicht ein eine als auch es "
    "de la le et les en un du une que est pour qui dans par plus pas au sur ne se "
    "el los las y por con no su para al lo como del"
).split()
CHAIN = 3
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = "\x01"


def signatures(df: DataFrame, text: str, out: str, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> DataFrame:
    """``df`` with the array ``out``; every step is a column of its own, so none is computed twice."""
    anchors = list(dict.fromkeys(anchors))
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), _GAP)
    marked = F.transform(words, lambda w: F.when(w.isin(anchors), F.lit(_MARK)).otherwise(w))
    # parts between anchors, the first following none; every expression here is a plain scan, however long the text
    parts = F.split(F.array_join(marked, " "), _MARK)
    df = df.withColumn("_parts", F.filter(F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.trim(p)), lambda p: p != ""))

    def after(part: Column, i: Column) -> Column:
        return F.substring_index(F.concat_ws(" ", part, *[F.get("_parts", i + k) for k in range(1, chain)]), " ", chain)

    chains = F.transform("_parts", after)
    whole = F.filter(F.array(F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), _GAP, " "))), lambda c: c != "")
    df = df.withColumn("_chains", chains)
    chains = F.when(F.size("_chains") > 0, F.col("_chains")).otherwise(whole)
    return df.withColumn(out, F.sort_array(F.array_distinct(F.transform(chains, lambda c: F.crc32(c.cast("binary")))))).drop("_parts", "_chains")


def text_of(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda s: F.lower(F.lpad(F.hex(s), 8, "0"))), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    far = F.least(n, m) < least * F.greatest(n, m)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0) | far, F.lit(0.0)).otherwise(both / (n + m - both))


def length_class(sigs: Column, least: float) -> Column:
    """Partition of set lengths: sets of likeness ``least`` or more are in the same or in neighbouring classes."""
    return F.floor(F.log(F.greatest(F.size(sigs), F.lit(1)).cast("double")) / F.log(F.lit(1 / least)) + 1e-9).cast("int")


def near_pairs(pairs: DataFrame, a: str, b: str, least: float = 0.8) -> DataFrame:
    """Of the stated pairs (array columns ``a`` and ``b``) those with a likeness of at least ``least``, as ``near``."""
    close = F.abs(length_class(F.col(a), least) - length_class(F.col(b), least)) <= 1
    return pairs.filter(close).withColumn("near", likeness(F.col(a), F.col(b), least)).filter(F.col("near") >= least)


def with_next(docs: DataFrame, key: str, cols: list[str], slice_docs: int = 2048) -> DataFrame:
    """``docs`` with ``next_<col>`` of the document that follows in descending ``key``, the first following the last.

    Keys are cut into slices of about ``slice_docs`` documents: by up to 256 quantiles, and evenly by value between two of
    them where more are needed; rows without a key are cut by their hash. Every slice gets a copy of the last document of
    the slice before it, so neighbours meet in one shuffle. Ties follow the hash of the row.
    """
    k = F.col(key)
    at = [(i + 1) / 256 for i in range(255)]
    got = docs.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n"), F.count(key).alias("some"), F.percentile_approx(key, at, 20_000).alias("q")).first()
    n, some = got["n"], got["some"]
    quantiles = got["q"] or []
    step = max(1, 256 * slice_docs // max(some, 1))
    cuts = [got["low"] or 0, *sorted(set(quantiles[step - 1 :: step]) - {got["low"]})]
    ends = [*cuts[1:], (got["high"] or 0) + 1]
    parts = max(1, -(-some // (slice_docs * len(cuts))))
    index = F.lit(0)
    for i, c in enumerate(cuts[1:], 1):
        index = index + (k >= F.lit(c)).cast("int")
    low, width = (F.get(F.array(*[F.lit(float(x)) for x in v]), F.col("_i")) for v in (cuts, [max(e - c, 1) / parts for c, e in zip(cuts, ends, strict=True)]))
    inside = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((k.cast("double") - low) / width)))
    blank = max(1, -(-(n - some) // slice_docs))  # slices of rows without a key, which come first
    d = docs.withColumn("_h", F.xxhash64(*cols)).withColumn("_i", index)
    none = F.least(F.lit(blank - 1), F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * blank)) - blank
    d = d.withColumn("_b", F.when(k.isNull(), none).otherwise(F.col("_i") * parts + inside).cast("long")).drop("_i")
    last = d.groupBy("_b").agg(F.max(F.struct(F.col(key).isNotNull().alias("some"), F.col(key).alias("k"), F.col("_h").alias("h"))).alias("l"))
    w = Window.orderBy("_b")
    nxt = last.select(F.col("_b").alias("_lb"), "l", F.lead("_b").over(w).alias("to"), F.min("_b").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"))
    nxt = nxt.select("_lb", "l", F.coalesce("to", "first").alias("to"))
    cond = (F.col("_b") == F.col("_lb")) & F.col(key).eqNullSafe(F.col("l.k")) & (F.col("_h") == F.col("l.h"))
    if n // slice_docs <= 100_000:  # a row per slice: known to be small before it is sent to all
        nxt = F.broadcast(nxt)
    ghosts = d.join(nxt, cond).select(*[F.col(c) for c in docs.columns], F.col("to").alias("_b"), "_h", F.lit(0).alias("_real"))
    every = d.withColumn("_real", F.lit(1)).select(*docs.columns, "_b", "_h", "_real").unionByName(ghosts)
    by = Window.partitionBy("_b").orderBy("_real", F.col(key).asc_nulls_first(), "_h")
    return every.select(*docs.columns, "_real", *[F.lag(c).over(by).alias(f"next_{c}") for c in cols]).filter("_real = 1").drop("_real")


def op8(docs: DataFrame) -> DataFrame:
    """The query's digest."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = with_next(d, "doc_id", ["text"])  # texts alone are moved; signatures are cheaper made twice than moved
    d = signatures(signatures(d, "text", "sigs"), "next_text", "next_sigs")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    d = d.withColumn("edited", F.concat(F.substr(F.col("text"), F.lit(1), n - half), F.substr(F.col("next_text"), F.lit(1), half)))
    d = signatures(d, "edited", "edited_sigs")
    return d.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sigs")).alias("fingerprint"),
        text_of(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
