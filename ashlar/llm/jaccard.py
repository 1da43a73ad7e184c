"""Exact Jaccard join of documents on word shingles, by the size-aware heavy-light method.

A document's set holds its distinct ``k``-word shingles (64-bit hashes); equal sets are one entity from the start.

* Light sets (at most x shingles) enumerate fixed-size subsets: a pair of sizes (a, b) links exactly if it shares
  c = ceil(t(a+b)/(100+t)) shingles, so both emit all their subsets of c shingles under a key that names the two sizes.
  A set of the smaller size is linked with whoever it meets in a key; no verification is needed.
* Heavy sets scan inverted lists. Lists are kept for the prefix of each set only, in an order that puts rare shingles
  first (their counts in 2**24 hash cells, a table of fixed size); light sets that can link with a heavy one join in.
* x minimises the summed cost of both sides over the sizes that occur: subsets against list entries times ``verify_cost``.

Links are wanted as components, so a list isn't expanded into pairs: in a few rounds every member is checked against one
pivot of a list (the pivot with which it shares most lists), found links are contracted, and lists whose members are
all in one component are done. What then still crosses components is checked pair by pair, so no link is lost.
Identical sets, and near copies of one text, therefore cost one check each, however many they are.

Cases: a text with fewer than k words, but some, has one shingle, the whole sequence; without words, or null, the set is
empty, links with nothing and is its own component. Very long texts are shingled whole. Repeated rows share a component.
Null doc_ids take part but never name a component unless all of its ids are null.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ashlar.llm import words as W
from ashlar.llm.decontam import _bitmap, _has
from ashlar.llm.graph import components
from ashlar.llm.store import drop, release, staged

CELLS, BLOCK, LARGEST = 24, 16, 24  # log2 of count cells and of cells a row; the largest boundary tried
STAR_ROUNDS = 1


def shingles(data: np.ndarray, off: np.ndarray, k: int):
    """(row, sorted distinct shingle hashes) of every row with words."""
    w = W.Words(data, off, W.SPACED)
    g = W.windows(w.hash, k)
    for r in range(len(off) - 1):
        a, b = int(w.first[r]), int(w.first[r + 1])
        if b - a >= k:
            yield r, np.unique(g[a : b - k + 1])
        elif b > a:
            yield r, W.windows(w.hash[a:b], b - a)


def digest(s: np.ndarray) -> int:
    h = W.mix(np.array([s.sum(), np.bitwise_xor.reduce(W.mix(s)), len(s)], np.uint64))
    return int(W.combine(h[:1], h[1:2], h[2:]).view(np.int64)[0])


def overlap(a: int, b: int, t: int) -> int:
    """Fewest common shingles of linked sets of these sizes."""
    return -(-t * (a + b) // (100 + t))


def partners(a: int, t: int) -> range:
    return range(-(-t * a // 100), 100 * a // t + 1)


def subsets(a: int, x: int, t: int) -> int:
    return sum(comb(a, overlap(a, b, t)) for b in partners(a, t) if 0 < b <= x)


def prefix(a: int, t: int) -> int:
    return a - -(-t * a // 100) + 1


def boundary(sizes: np.ndarray, t: int, verify_cost: float) -> int:
    """The size up to which sets are light: the cheapest, given how many sets have each size up to LARGEST."""
    n = range(1, len(sizes))

    def cost(x: int) -> float:
        light = sum(sizes[a] * subsets(a, x, t) for a in n if a <= x)
        return light + sum(sizes[a] * prefix(a, t) * (1 + verify_cost) for a in n if 100 * a // t > x)

    return min(range(LARGEST + 1), key=cost)


def _count(k: int):
    def run(batches):
        cells, sizes = np.zeros(1 << CELLS, np.uint32), np.zeros(LARGEST * 2, np.int64)
        for batch in batches:
            data, off = W.buffers(batch.column(0))
            for lo, hi in W.chunks(off):
                w = W.Words(*W.slice_rows(data, off, lo, hi), W.SPACED)
                np.add.at(cells, (W.windows(w.hash, k) >> np.uint64(64 - CELLS)).astype(np.int64), 1)
                n = np.diff(w.first)
                n = np.where(n >= k, n - k + 1, np.minimum(n, 1))
                sizes += np.bincount(n[(n > 0) & (n < len(sizes))], minlength=len(sizes))
        rows = np.minimum(cells, 65535).astype(np.uint16).reshape(-1, 1 << BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(rows), dtype=np.int32)), pa.array([zlib.compress(x.tobytes(), 1) for x in (sizes, *rows)], pa.binary())], ["block", "v"])

    return run


def _add(t: pa.Table) -> pa.Table:
    b = t.column("block")[0].as_py()
    total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.uint16 if b >= 0 else np.int64).astype(np.int64) for x in t.column("v"))
    v = np.frexp(total.astype(float))[1].astype(np.uint8) if b >= 0 else total  # bit lengths: 0 to 63
    return pa.table({"block": pa.array([b], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})


def _signatures(k: int, t: int, shared):
    def run(batches):
        level, x = shared.value
        for batch in batches:
            data, off = W.buffers(W.column(batch, "_t"))
            n = len(off) - 1
            size, dig, light, heavy = np.zeros(n, np.int64), [None] * n, [None] * n, [None] * n
            for lo, hi in W.chunks(off):
                for r, s in shingles(*W.slice_rows(data, off, lo, hi), k):
                    a, i = len(s), lo + r
                    size[i], dig[i] = a, digest(s)
                    if a <= x:
                        keys = []
                        for b in partners(a, t):
                            if 0 < b <= x:
                                c = overlap(a, b, t)
                                sub = s[np.array(list(combinations(range(a), c)))].reshape(-1, c)
                                tag = np.uint64(min(a, b) * 1000 + max(a, b))
                                key = W.mix(W.mix(sub).sum(1) ^ W.mix(sub * np.uint64(3)).sum(1) + tag)
                                keys.append(key & ~np.uint64(1) | np.uint64(a <= b))  # the last bit: of the smaller size
                        light[i] = np.concatenate(keys).view(np.int64)
                    if 100 * a // t > x:
                        o = (level[s >> np.uint64(64 - CELLS)].astype(np.uint64) << np.uint64(57)) | (s >> np.uint64(7))
                        o = np.sort(o)[: prefix(a, t)]
                        heavy[i] = o.view(np.int64)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([W.column(batch, "_c"), pa.array(size), pa.array(dig, pa.int64()), pa.array(light, longs), pa.array(heavy, longs)], ["_c", "n", "e", "light", "heavy"])

    return run


def _sets(k: int, shared):
    def run(batches):
        bitmap, mask = shared.value
        seen: set[int] = set()
        for batch in batches:
            data, off = W.buffers(batch.column(0))
            for lo, hi in W.chunks(off):
                es, sets = [], []
                for _, s in shingles(*W.slice_rows(data, off, lo, hi), k):
                    e = digest(s)
                    if e not in seen and _has(bitmap, mask, np.array([e], np.int64).view(np.uint64))[0]:
                        seen.add(e)
                        es.append(e)
                        sets.append(s.tobytes())
                if es:
                    yield pa.RecordBatch.from_arrays([pa.array(es, pa.int64()), pa.array(sets, pa.binary())], ["e", "s"])

    return run


def _verify(t: int):
    def run(batches):
        for batch in batches:
            sa, sb = W.column(batch, "sa"), W.column(batch, "sb")
            ok = np.zeros(len(sa), bool)
            for i in range(len(sa)):
                a, b = np.frombuffer(sa[i].as_buffer(), np.uint64), np.frombuffer(sb[i].as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                ok[i] = np.count_nonzero(b[at] == a) >= overlap(len(a), len(b), t)
            yield pa.RecordBatch.from_arrays([W.column(batch, "a"), W.column(batch, "b"), pa.array(ok)], ["a", "b", "ok"])

    return run


def _relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Component per entity (e, c) after ``links`` (a, b); entities without a label are their own."""
    if labels is not None:
        for end in ("a", "b"):
            links = links.join(labels.select(F.col("e").alias(end), F.col("c").alias("_" + end)), end, "left").select(*[F.coalesce(F.col("_" + end), F.col(end)).alias(end) if x == end else F.col(x) for x in ("a", "b")])
    comp = components(links).select(F.col("node").alias("e"), F.col("comp").alias("c"))
    if labels is not None:
        moved = labels.join(comp.select(F.col("e").alias("c"), F.col("c").alias("_c")), "c", "left").select("e", F.coalesce("_c", "c").alias("c"))
        comp = moved.unionByName(comp.join(labels.select("e"), "e", "left_anti"))
    return staged(comp, "labels")


def _possible(t: int):
    """Keep the pairs that can still have the overlap of a link, by the m tokens that their prefixes share.

    All common tokens up to the earlier end of the two prefixes are among the m; beyond it no more can be common than
    that side has left. And after the last shared token neither side can add more than it has left.
    """

    def tokens(batch, x):
        t = W.column(batch, "t" + x)
        off, v = np.array(t.offsets), t.values
        return off, np.array(v.field("i")), np.array(v.field("w"))

    def run(batches):
        for batch in batches:
            na, nb, za, zb = (np.array(W.column(batch, c)) for c in ("na", "nb", "za", "zb"))
            (oa, ia, wa), (ob, ib, wb) = tokens(batch, "a"), tokens(batch, "b")
            keep = np.zeros(batch.num_rows, bool)
            for r in range(batch.num_rows):
                _, pa_, pb_ = np.intersect1d(wa[oa[r] : oa[r + 1]], wb[ob[r] : ob[r + 1]], True, True)
                if len(pa_):
                    n, m = int(na[r]), int(nb[r])
                    after = n - prefix(n, t) if za[r] <= zb[r] else m - prefix(m, t)
                    rest = min(n - 1 - int(ia[oa[r] + pa_].max()), m - 1 - int(ib[ob[r] + pb_].max()))
                    keep[r] = len(pa_) + min(after, rest) >= overlap(n, m, t)
            if keep.any():
                k = pa.array(keep)
                yield pa.RecordBatch.from_arrays([W.column(batch, "a").filter(k), W.column(batch, "b").filter(k)], ["a", "b"])

    return run


def _members(shared):
    """(token, entity, size, position, end of prefix) for the prefix tokens that the bitmap of shared tokens may hold."""

    def run(batches):
        bitmap, mask = shared.value
        for batch in batches:
            h = W.column(batch, "heavy")
            off, w = np.array(h.offsets), np.array(h.values)
            own = np.repeat(np.arange(len(h)), np.diff(off))
            w = w[off[0] : off[-1]]
            pos = (np.arange(len(w)) + off[0] - off[own]).astype(np.int32)
            k = np.flatnonzero(_has(bitmap, mask, w.view(np.uint64)))
            e, n = np.array(W.column(batch, "e")), np.array(W.column(batch, "n"))
            z = w[off[1:] - 1 - off[0]]
            o = own[k]
            yield pa.RecordBatch.from_arrays([pa.array(w[k]), pa.array(e[o]), pa.array(n[o]), pa.array(pos[k]), pa.array(z[o])], ["w", "e", "n", "i", "z"])

    return run


def _spread(rows: DataFrame, table: DataFrame, key: str, size: str, most: int = 256) -> DataFrame:
    """``rows`` left joined to the one row of ``table`` per key, whose column ``size`` says how many rows have it.

    Keys of more rows than a thousandth of all (at least ``most``), at most a thousand, are sent to all; their rows and
    those without a key are dealt by chance, so no task gets all rows of a key.
    """
    n = table.agg(F.sum(size)).first()[0] or 0
    hot = table.filter(F.col(size) > max(most, n // 1000))
    cold = table.filter(F.col(size) <= max(most, n // 1000))
    rest = [c for c in table.columns if c not in rows.columns]
    a = F.broadcast(hot.select(F.col(key).alias("_hot"), *[F.col(c).alias("_" + c) for c in rest]))
    b = cold.select(F.col(key).alias("_cold"), F.lit(0).alias("_deal"), *rest)
    r = rows.join(a, F.col(key) == F.col("_hot"), "left")
    away = F.col("_hot").isNotNull() | F.col(key).isNull()
    r = r.withColumn("_own", F.when(away, F.xxhash64(*rows.columns, F.monotonically_increasing_id())).otherwise(F.col(key))).withColumn("_is", away.cast("int"))
    r = r.join(b, (F.col("_own") == F.col("_cold")) & (F.col("_is") == F.col("_deal")), "left")
    return r.select(*rows.columns, *[F.coalesce(c, "_" + c).alias(c) for c in rest])


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, t: int = 80, verify_cost: float = 8.0) -> DataFrame:
    """(key, n_shingles, component_id) per row of ``docs``; two rows link when t% of their union is common.

    The result reads tables of the shared folder, its ``_ashlar_reads``; who has written what it needs may drop them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.struct(F.col(key).alias("k")).alias("_c"), F.col(text).alias("_t"))
    counted = texts.select("_t").mapInArrow(_count(k), "block int, v binary").groupBy("block").applyInArrow(_add, "block int, v binary").collect()  # 257 rows, 16 MB
    got = {r["block"]: r["v"] for r in counted}
    level = np.concatenate([np.frombuffer(got[b], np.uint8) for b in range(1 << (CELLS - BLOCK))]) if got else np.zeros(1 << CELLS, np.uint8)
    x = boundary(np.frombuffer(got[-1], np.int64), t, verify_cost) if got else 0
    shared = spark.sparkContext.broadcast((level, x))
    schema = StructType([texts.schema["_c"], *StructType.fromDDL("n long, e long, light array<long>, heavy array<long>").fields])
    sigs = staged(texts.mapInArrow(_signatures(k, t, shared), schema), "signatures")

    # under a key of sizes (a, b) a set of the smaller size links with all others, two of the greater size need not
    keyed = sigs.select("e", F.explode("light").alias("key")).select("e", F.shiftright("key", 1).alias("w"), F.expr("key & 1L = 1").alias("small"))
    hubs = keyed.groupBy("w").agg(F.min(F.when(F.col("small"), F.col("e"))).alias("lo"), F.min("e").alias("e0"), F.max("e").alias("e1"))
    hubs = hubs.filter("lo is not null and e0 < e1").select("w", "lo")
    light = keyed.join(hubs, "w").filter("e <> lo").select(F.col("e").alias("a"), F.col("lo").alias("b")).distinct()
    labels = _relabel(None, light)
    # inverted lists with more than one member, turned back into one row per entity: its shared tokens with their positions
    shared_w = sigs.select("e", F.explode("heavy").alias("w")).groupBy("w").agg(F.min("e").alias("lo"), F.max("e").alias("hi")).filter("lo < hi").select("w")
    shared_w = staged(shared_w, "shared-tokens")
    bits = spark.sparkContext.broadcast(_bitmap(shared_w, "w", shared_w.count()))
    rows = sigs.filter("heavy is not null").select("e", "n", "heavy").mapInArrow(_members(bits), "w long, e long, n long, i int, z long").join(shared_w, "w")
    ents = rows.groupBy("e").agg(F.max("n").alias("n"), F.max("z").alias("z"), F.sort_array(F.collect_set(F.struct("i", "w"))).alias("t"))
    ents = staged(ents, "entities")
    spent = [shared_w, ents]  # read by the rounds only
    release(spark)
    if ents.limit(1).count():
        same = lambda a, b: F.least(a, b) * 100 >= F.greatest(a, b) * t

        def verified(pairs: DataFrame) -> DataFrame:
            """Only the sets of this round's pairs are made, moved and, for the round, kept."""
            need = pairs.select(F.col("a").alias("e")).union(pairs.select("b")).distinct()
            bits = spark.sparkContext.broadcast(_bitmap(need, "e", need.count()))
            sets = texts.select("_t").mapInArrow(_sets(k, bits), "e long, s binary").groupBy("e").agg(F.first("s").alias("s"))
            sets = staged(sets, "sets")
            p = pairs.join(sets.select(F.col("e").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("e").alias("b"), F.col("s").alias("sb")), "b")
            out = staged(p.select("a", "b", "sa", "sb").mapInArrow(_verify(t), "a long, b long, ok boolean"), "verified")
            drop(sets)
            return out

        done = None
        for turn in range(STAR_ROUNDS + 1):
            # members whose prefix is shared most, relative to its length, make the best pivots: the text that copies vary
            first = F.size("t") / F.col("n") if turn == 0 else F.xxhash64("e", F.lit(turn)).cast("double")
            here = ents.join(labels, "e", "left").select("e", "n", F.coalesce("c", "e").alias("c"), first.alias("first"), F.inline("t"))
            pivot = F.max(F.struct("first", "e", "n", "c")).alias("p")
            mixed = here.groupBy("w").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), pivot).filter("c0 < c1").select("w", "p.e", "p.n", "p.c")
            here = here.join(mixed.toDF("w", "pe", "pn", "pc"), "w")
            here = here if turn < STAR_ROUNDS else staged(here.drop("pe", "pn", "pc", "first"), "mixed")
            if turn >= STAR_ROUNDS:
                spent.append(here)
            if turn < STAR_ROUNDS:
                pairs = here.filter((F.col("c") != F.col("pc")) & same(F.col("n"), F.col("pn"))).groupBy(F.col("e").alias("a"), F.col("pe").alias("b")).agg(F.count(F.lit(1)).alias("m"))
            else:  # whatever still crosses components, pair by pair: the first shared token must leave room for the rest
                end = lambda x: here.select("w", F.col("e").alias(x), *[F.col(c).alias(c + x) for c in ("c", "n", "i")])
                room = lambda x: (F.col("n" + x) - F.col("i" + x)) * (100 + t) >= (F.col("na") + F.col("nb")) * t
                cross = (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & same(F.col("na"), F.col("nb")) & room("a") & room("b")
                pairs = end("a").join(end("b"), "w").filter(cross).select("a", "b").distinct()
            if done is not None:
                pairs = pairs.join(done, (F.least(pairs.a, pairs.b) == done.x) & (F.greatest(pairs.a, pairs.b) == done.y), "left_anti")
            if turn < STAR_ROUNDS:
                pairs = pairs.groupBy("a").agg(F.max(F.struct("m", "b")).alias("m")).select("a", "m.b")
            side = lambda x: ents.select(F.col("e").alias(x), *[F.col(c).alias(c + x) for c in ("n", "z", "t")])  # noqa: E731,B023
            pairs = staged(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_possible(t), "a long, b long"), "pairs")
            spent.append(pairs)
            if not pairs.limit(1).count():
                if turn < STAR_ROUNDS:
                    continue
                break
            v = verified(pairs)
            spent.append(v)
            now = v.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
            done = now if done is None else done.union(now)
            links = v.filter("ok").select("a", "b")
            if links.limit(1).count():
                spent.append(labels)
                labels = _relabel(labels, links)
            release(spark)

    for old in spent:
        drop(old)
    # names go to entities first: a row per entity meets its component, and only then rows meet their entity
    per = sigs.filter("e is not null").groupBy("e").agg(F.min("_c.k").alias("least"), F.count(F.lit(1)).alias("rows"))
    per = per.join(labels, "e", "left").select("e", "least", "rows", F.coalesce("c", "e").alias("c"))
    total = per.groupBy("c").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    names = staged(_spread(per, total, "c", "members").select("e", "rows", "component_id"), "names")
    drop(labels)
    release(spark)
    out = _spread(sigs.select("_c", "n", "e"), names, "e", "rows")
    out = out.select(F.col("_c.k").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_c.k")).alias("component_id"))
    out._ashlar_reads = [sigs, names]
    return out


def op7(docs: DataFrame) -> DataFrame:
    return join(docs.select("doc_id", "text"))
