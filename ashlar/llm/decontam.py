"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of ``window`` consecutive words (an item with fewer words, but some, is one window).
A window is the set of its word shingles with their offsets. Shingles are ordered by rarity over the whole corpus, and
since containment must be whole, the necessary prefix of a window is its one rarest shingle: a document that holds the
window holds that shingle. Documents are scanned once for prefix shingles, behind a bitmap of fixed size (whatever the
benchmark's size, it costs false candidates only); a candidate carries the words around it, and after the join on the
shingle, the length bound (the window must fit the document), the positional bound (it must start where the shingle's
offset says) and an exact comparison of the item-sized window of words decide.

Results are exact. Per document: n_words, n_hit (words inside any occurrence of a window), n_items, items_sha256,
contaminated, and ``spans`` (merged word ranges, end exclusive).

Cases: null or wordless texts have no words and hit nothing; null item ids count as the empty string; repeated items
and documents are kept as rows (item ids are counted once); an empty benchmark leaves every document clean. Output
columns replace input columns of the same name only in ``digest``; ``decontaminate`` keeps the input's columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ashlar.llm import words as W
from ashlar.llm.store import staged


def _item_windows(window: int, shingle: int):
    def run(batches):
        for batch in batches:
            ids = W.column(batch, "item")
            data, off = W.buffers(W.column(batch, "t"))
            for lo, hi in W.chunks(off):
                d, o = W.slice_rows(data, off, lo, hi)
                w = W.Words(d, o, W.ALNUM)
                rows: list[tuple] = []
                for r in range(hi - lo):
                    a, b = w.first[r], w.first[r + 1]
                    size = min(window, b - a)
                    for i in range(a, b - size + 1 if size else a):
                        k = min(shingle, size)
                        rows.append((ids[lo + r].as_py(), b" ".join(map(w.text, range(i, i + size))).decode("utf-8", "replace"), int(size), k, W.windows(w.hash[i : i + size], k).view(np.int64).tolist()))
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.string()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32()), pa.array(c[4], pa.list_(pa.int64()))], ["item", "win", "wlen", "k", "hs"])

    return run


def _bitmap(hashes: DataFrame, col: str, n: int) -> tuple[np.ndarray, int]:
    """Bits of the hashes of ``col``; between 2**20 and 2**27 bits (16 MB), by their number ``n``."""
    bits = min(27, max(20, (16 * max(n, 1)).bit_length()))
    at = F.expr(f"{col} & {(1 << bits) - 1}L")
    rows = hashes.select(at.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("v")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy().astype(np.int64).view(np.uint64)
    return out, (1 << bits) - 1


def _has(bitmap: np.ndarray, mask: int, h: np.ndarray) -> np.ndarray:
    b = h & np.uint64(mask)
    return (bitmap[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1


def _matches(w: W.Words, sizes: list[int], bitmap, mask):
    """(first word, hash) of each shingle of the given sizes that the bitmap may hold; shingles don't cross rows."""
    end = np.repeat(w.first[1:], np.diff(w.first))
    at, hs = [], []
    for k in sizes:
        h = W.windows(w.hash, k)
        i = np.flatnonzero(_has(bitmap, mask, h))
        i = i[i + k <= end[i]]
        at.append(i)
        hs.append(h[i])
    return np.concatenate(at), np.concatenate(hs)


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, shingle: int = 5, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: the columns ``carry``, n_words, n_hit, items (sorted ids), spans."""
    spark = docs.sparkSession
    item = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    raw = items.select(item.alias("item"), F.col(item_text).alias("t")).mapInArrow(_item_windows(window, shingle), "item string, win string, wlen int, k int, hs array<long>")
    raw = staged(raw.distinct(), "windows")
    wins = raw.select("win", "wlen", "k", "hs").distinct()
    each = staged(wins.select("win", "wlen", "k", F.posexplode("hs").alias("off", "h")), "window-shingles")
    sizes = sorted(r[0] for r in each.select("k").distinct().collect())  # at most ``shingle`` rows

    seen = None
    if sizes:
        shared = spark.sparkContext.broadcast(_bitmap(each, "h", each.count()))

        def count(batches):
            bitmap, mask = shared.value
            for batch in batches:
                data, off = W.buffers(batch.column(0))
                for lo, hi in W.chunks(off):
                    _, h = _matches(W.Words(*W.slice_rows(data, off, lo, hi), W.ALNUM), sizes, bitmap, mask)
                    u, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], ["h", "n"])

        seen = docs.select(F.col(text).alias("t")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
        # a window without a single shingle that occurs can't occur; its rarest shingle is its necessary prefix
        rare = each.join(seen, "h", "left").groupBy("win", "wlen").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "off")).alias("p"), F.max("k").alias("k"))
        prefix = staged(rare.filter("p.n > 0").select("win", "wlen", "k", "p.h", "p.off"), "window-prefixes")
        sizes = sorted(r[0] for r in prefix.select("k").distinct().collect())
        probe = spark.sparkContext.broadcast(_bitmap(prefix, "h", prefix.count())) if sizes else None
    else:
        probe = None
        prefix = spark.createDataFrame([], "win string, wlen int, k int, h long, off int")

    def scan(batches):
        for batch in batches:
            col = W.column(batch, "_t")
            data, off = W.buffers(col)
            n_words, hits = [], [[] for _ in range(len(col))]
            for lo, hi in W.chunks(off):
                w = W.Words(*W.slice_rows(data, off, lo, hi), W.ALNUM, hashes=bool(sizes))
                n_words.append(np.diff(w.first))
                if not sizes:
                    continue
                bitmap, mask = probe.value
                at, h = _matches(w, sizes, bitmap, mask)
                rows = np.searchsorted(w.first, at, "right") - 1
                for i, x, r in zip(at.tolist(), h.view(np.int64).tolist(), rows.tolist(), strict=True):
                    a, b = int(w.first[r]), int(w.first[r + 1])
                    c0, c1 = max(a, i - window + 1), min(b, i + window)
                    hits[lo + r].append({"pos": i - a, "h": x, "c0": c0 - a, "ctx": b" ".join(map(w.text, range(c0, c1))).decode("utf-8", "replace")})
            n = np.concatenate(n_words).astype(np.int64) if n_words else np.zeros(0, np.int64)
            kind = pa.list_(pa.struct([("pos", pa.int32()), ("h", pa.int64()), ("c0", pa.int32()), ("ctx", pa.string())]))
            yield pa.RecordBatch.from_arrays([W.column(batch, "_rid"), W.column(batch, "_c"), pa.array(n), pa.array(hits, kind)], ["_rid", "_c", "n_words", "hits"])

    held = F.struct(*[F.col(c) for c in carry]) if carry else F.struct(F.lit(True).alias("_"))
    numbered = docs.select(F.monotonically_increasing_id().alias("_rid"), held.alias("_c"), F.col(text).alias("_t"))
    schema = StructType([*numbered.select("_rid", "_c").schema.fields, *StructType.fromDDL("n_words long, hits array<struct<pos:int,h:long,c0:int,ctx:string>>").fields])
    base = staged(numbered.mapInArrow(scan, schema), "scanned")  # the row numbers are fixed from here on
    hit = base.filter("size(hits) > 0").select("_rid", "n_words", F.inline("hits"))
    start = F.col("pos") - F.col("off")
    words = F.slice(F.split("ctx", " "), start - F.col("c0") + 1, F.col("wlen"))
    fits = (start >= F.col("c0")) & (start + F.col("wlen") <= F.col("n_words"))
    found = hit.join(prefix, "h").filter(fits).filter(F.array_join(words, " ") == F.col("win")).select("_rid", start.alias("s"), (start + F.col("wlen")).alias("e"), "win")
    found = staged(found.distinct(), "occurrences")

    def merge(acc, x):
        """Sorted ranges folded into (total, open start, open end, closed ranges)."""
        joins = x["s"] <= acc["e"]
        return F.struct(
            F.when(joins, acc["s"]).otherwise(x["s"]).alias("s"),
            F.greatest(acc["e"], x["e"]).alias("e"),
            F.when(joins, acc["done"]).otherwise(F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["e"].alias("e"))))).alias("done"),
        )

    cover = found.select("_rid", "s", "e").distinct().groupBy("_rid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("r"))
    none = F.expr("cast(array() as array<struct<s:int,e:int>>)")
    folded = F.aggregate("r", F.struct(F.col("r")[0]["s"].alias("s"), F.col("r")[0]["e"].alias("e"), none.alias("done")), merge, lambda a: F.concat(a["done"], F.array(F.struct(a["s"].alias("s"), a["e"].alias("e")))))
    cover = cover.select("_rid", folded.alias("spans"))
    names = found.select("_rid", "win").distinct().join(raw.select("win", "item"), "win").select("_rid", "item").distinct()
    names = names.groupBy("_rid").agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = base.select("_rid", "_c", "n_words").join(cover, "_rid", "left").join(names, "_rid", "left")
    return out.select(
        *[F.col(f"_c.{c}").alias(c) for c in carry],
        "n_words",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", none).alias("spans"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark window, with the columns they had. The decision follows the text."""
    key = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    found = find(docs.select(key.alias("_key"), F.col(text).alias("_text")), items, text="_text", carry=("_key",), **options)
    return docs.withColumn("_key", key).join(found.filter("n_hit > 0").select("_key").distinct(), "_key", "left_anti").drop("_key")


def op4(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The query's digest."""
    return find(docs.select("doc_id", "text"), items, carry=("doc_id",)).select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower_az, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az FROM documents)),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
ks AS (SELECT DISTINCT k FROM v),
p AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
o AS (SELECT doc_id, item_id, i, v.k FROM p JOIN v USING (k, win)),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM o) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM o) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
