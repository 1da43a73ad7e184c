"""Exact substring deduplication by blockwise suffix sorting over a difference cover.

Every byte covered by a string of ``length`` bytes that starts at least twice in the corpus is removed (all occurrences
of it; matches never cross documents, overlaps count, and strings are judged on the input). Suffixes need an order to
that depth only, and of the order only its ties, so suffixes are ordered by 64-bit fingerprints of their first bytes.

1. Documents are packed into rows of about 4 MB of UTF-8, the unit that every later step works on.
2. Cover sample: a difference cover D modulo v holds, for any two positions i and j, a shift d < v that takes both into
   the cover. So two equal strings of ``length`` bytes hold, at equal shift, two cover positions that agree on
   length - v + 1 bytes. These sample suffixes (16 in 181) are ranked first, as groups of equals; for a short ``length``,
   whose sample's fingerprints are larger than the text, a range of fingerprints at a time.
3. Only a suffix that has, within v bytes, a sample suffix with an equal can be tied to depth ``length``; all others are
   out. What is left is sorted one suffix bucket (range of fingerprints) at a time, so that what a pass shuffles stays
   below the size of the text, whatever share of it repeats.
4. Ties go back to their packs as bits, and runs of covered bytes are cut out.

Equal strings within a pack are merged before the shuffle, so a passage that a third of all documents share sends a row
a pack. Fingerprints are 64 bits wide, with no exact check after: two different strings collide with a chance of 2**-63,
and then only where both lie in text that repeats.

Cases: null is empty; texts shorter than ``length`` lose nothing; repeated rows of at least ``length`` bytes are removed
whole; very long texts are packs of their own; cutting bytes out may split a character, whose rest ``dedup`` drops.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from ashlar.llm import words as W
from ashlar.llm.store import drop, release, staged

PACK, BUCKET = 4 << 20, 32 << 20  # bytes of text a pack, of fingerprints a bucket


def cover(length: int) -> tuple[int, np.ndarray]:
    """(v, D): the Colbourn-Ling difference cover with the largest period up to about half of ``length``."""
    best = (1, np.array([0]))
    for r in range(64):
        v = 24 * r * r + 36 * r + 13
        if v > length // 2:
            break
        steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
        best = (v, np.unique(np.concatenate([[0], np.cumsum(steps)]) % v))
    return best


def fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the ``length`` bytes from each of the rising positions ``at``."""
    out = np.empty(len(at), np.uint64)
    i = 0
    while i < len(at):
        j = int(np.searchsorted(at, at[i] + (1 << 20)))
        a = int(at[i])
        p = W.prefix_hash(data[a : int(at[j - 1]) + length])
        k = at[i:j] - a
        out[i:j] = W.mix((p[k + length] - p[k]) * W.powers(len(p))[1][k])
        i = j
    return out


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _pack():
    def run(batches):
        made, held, texts, rows = 0, 0, [], []

        def row():
            nonlocal made, held, texts, rows
            blob = np.concatenate([d for d, _ in texts])
            sizes = np.concatenate([np.diff(o) for _, o in texts])
            off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            docs = pa.concat_arrays(rows)
            name = f"{TaskContext.get().partitionId()}-{made}"
            made, held, texts, rows = made + 1, 0, [], []
            lists = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([blob.tobytes()], pa.binary()), pa.array([off], pa.list_(pa.int64())), lists], ["pack", "blob", "off", "docs"])

        for batch in batches:
            data, off = W.buffers(W.column(batch, "_t"))
            for lo, hi in W.chunks(off):
                d, o = W.slice_rows(data, off, lo, hi)
                if texts and held + len(d) > PACK:
                    yield row()
                texts.append((d.copy(), o))
                rows.append(W.column(batch, "_c").slice(lo, hi - lo))
                held += len(d)
        if texts:
            yield row()

    return run


def _sample(data: np.ndarray, off: np.ndarray, length: int):
    """Positions of the cover sample (rising) and the length of their strings."""
    v, d = cover(length)
    ell = length - v + 1
    within = np.zeros(v, bool)
    within[d] = True
    at = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        n = int(b - a) - ell + 1
        if n > 0:
            at.append(a + np.flatnonzero(np.resize(within, n)))
    return (np.concatenate(at) if at else np.zeros(0, np.int64)), ell


def _bits(parts) -> np.ndarray:
    """The flags of a pack's distinct fingerprints, from its buckets in order."""
    flags = [np.unpackbits(np.frombuffer(p["bits"], np.uint8), count=p["n"]) for p in sorted(parts or [], key=lambda p: p["bucket"])]
    return np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)


def _candidates(data, off, parts, length: int) -> np.ndarray:
    """Starts of strings that may have an equal, given which sample strings have one."""
    at, ell = _sample(data, off, length)
    if not len(at):
        return at
    _, inv = np.unique(fingerprints(data, at, ell), return_inverse=True)
    at = at[_bits(parts)[inv]]
    if not len(at):
        return at
    v, _ = cover(length)
    doc = np.searchsorted(off, at, "right") - 1
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, np.maximum(at - v + 1, off[doc]), 1)
    np.add.at(step, at + 1, -1)
    s = np.flatnonzero(np.cumsum(step[:-1], dtype=np.int32))
    doc = np.searchsorted(off, s, "right") - 1
    return s[s + length <= off[doc + 1]]


def _runs(s: np.ndarray) -> np.ndarray:
    """Rising positions as alternating first and end of their runs."""
    if not len(s):
        return s
    cut = np.flatnonzero(np.diff(s) != 1)
    return np.stack([np.concatenate([s[:1], s[cut + 1]]), np.concatenate([s[cut], s[-1:]]) + 1], 1).ravel()


def _starts(batch: pa.RecordBatch, i: int) -> np.ndarray:
    r = np.array(W.column(batch, "runs")[i].values, dtype=np.int64)
    return np.concatenate([np.arange(a, b) for a, b in zip(r[::2], r[1::2], strict=True)]) if len(r) else r


def _mark(length: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                _, data, off = _read(one, 0)
                runs = _runs(_candidates(data, off, W.column(one, "f1")[0].as_py(), length))
                yield pa.RecordBatch.from_arrays([*[W.column(one, c) for c in ("pack", "blob", "off", "docs")], pa.array([runs], pa.list_(pa.int64()))], ["pack", "blob", "off", "docs", "runs"])

    return run


_OUT = ["bucket", "pack", "hs", "many"]


def _emit(pack: str, h: np.ndarray, n: int, lo: int, hi: int) -> pa.RecordBatch:
    """A row per bucket in lo..hi: the pack's distinct fingerprints and which it holds more than once."""
    u, c = np.unique(h, return_counts=True)
    cut = np.searchsorted(_bucket(u, n), np.arange(lo, hi + 1))
    keep = [i for i in range(hi - lo) if cut[i] < cut[i + 1]]
    hs = [u[cut[i] : cut[i + 1]].tobytes() for i in keep]
    many = [np.packbits(c[cut[i] : cut[i + 1]] > 1).tobytes() for i in keep]
    return pa.RecordBatch.from_arrays([pa.array([lo + i for i in keep], pa.int32()), pa.array([pack] * len(keep), pa.string()), pa.array(hs, pa.binary()), pa.array(many, pa.binary())], _OUT)


def _read(batch: pa.RecordBatch, i: int):
    data = np.frombuffer(W.column(batch, "blob")[i].as_buffer(), np.uint8)
    return W.column(batch, "pack")[i].as_py(), data, np.array(W.column(batch, "off")[i].values)


def _between(h: np.ndarray, n: int, lo: int, hi: int) -> np.ndarray:
    b = _bucket(h, n)
    return h[(b >= lo) & (b < hi)]


def _rank_samples(length: int, n: int, lo: int, hi: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pack, data, off = _read(batch, i)
                at, ell = _sample(data, off, length)
                yield _emit(pack, _between(fingerprints(data, at, ell), n, lo, hi), n, lo, hi)

    return run


def _sort_bucket(length: int, n: int, lo: int, hi: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                pack, data, off = _read(batch, i)
                yield _emit(pack, _between(fingerprints(data, _starts(batch, i), length), n, lo, hi), n, lo, hi)

    return run


def _ties(t: pa.Table) -> pa.Table:
    """Of one bucket: for each pack, which of its fingerprints occur more than once anywhere."""
    hs = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("hs")]
    every = np.sort(np.concatenate(hs))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    bits = []
    for h, m in zip(hs, t.column("many"), strict=True):
        f = np.unpackbits(np.frombuffer(m.as_buffer(), np.uint8), count=len(h)).astype(bool)
        if len(twice):
            f |= twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
        bits.append((len(h), int(f.sum()), np.packbits(f).tobytes()))
    return pa.table({"pack": t.column("pack"), "bucket": t.column("bucket"), "n": pa.array([b[0] for b in bits], pa.int32()), "tied": pa.array([b[1] for b in bits], pa.int64()), "bits": pa.array([b[2] for b in bits], pa.binary())})


_TIES = "pack string, bucket int, n int, tied long, bits binary"


def _long_runs(s: np.ndarray, data: np.ndarray, off: np.ndarray, length: int, words: int, whole: int) -> np.ndarray:
    """Of the tied starts those whose run of consecutive starts covers ``words`` whole words or ``whole`` bytes."""
    cut = np.flatnonzero(np.diff(s) != 1)
    a, b = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(s) - 1]])
    begin, end = s[a], s[b] + length
    w = W.Words(data, off, W.SPACED, hashes=False)
    n = np.searchsorted(w.ends, end, "right") - np.searchsorted(w.starts, begin)
    return s[np.repeat((n >= words) | (end - begin >= whole), b - a + 1)]


def _cut(length: int, make, words: int = 0, whole: int = 400):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, off = _read(batch, i)
                s = _starts(batch, i)
                if len(s):
                    _, inv = np.unique(fingerprints(data, s, length), return_inverse=True)
                    s = s[_bits(W.column(batch, "f2")[i].as_py())[inv]]
                if words and len(s):
                    s = _long_runs(s, data, off, length, words, whole)
                step = np.zeros(len(data) + 1, np.int32)
                step[s] += 1
                step[s + length] -= 1
                gone = np.cumsum(step[:-1], dtype=np.int32) > 0
                docs = W.column(batch, "docs")[i].values
                results = [make(data[a:b], gone[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]
                for lo in range(0, len(results), 1000):
                    part = results[lo : lo + 1000]
                    cols = [pa.array(c, t) for c, t in zip(zip(*part, strict=True), make.types, strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.slice(lo, len(part)), *cols], ["_c", *make.names])

    return run


class _Digest:
    """n_bytes, n_removed, n_spans, kept_sha256 of a document."""

    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    names, types = ["n_bytes", "n_removed", "n_spans", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def __call__(self, data, gone):
        runs = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(gone) else 0
        return len(data), int(gone.sum()), runs, hashlib.sha256(data[~gone].tobytes()).hexdigest()


class _Kept:
    """The text that is left and the number of bytes removed."""

    ddl = "kept string, n_removed long"
    names, types = ["kept", "n_removed"], [pa.string(), pa.int64()]

    def __call__(self, data, gone):
        return data[~gone].tobytes().decode("utf-8", "ignore"), int(gone.sum())


def _apply(docs: DataFrame, text: str, carry: list[str], length: int, make, words: int = 0) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_c"), F.col(text).cast("string").alias("_t"))
    kind = rows.schema["_c"].dataType
    schema = StructType([StructField("pack", StringType()), StructField("blob", BinaryType()), StructField("off", ArrayType(LongType())), StructField("docs", ArrayType(kind))])
    release(spark)  # of what came before
    packs = staged(rows.mapInArrow(_pack(), schema), "packs")
    size = packs.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    v, d = cover(length)
    cores = spark.sparkContext.defaultParallelism

    def buckets(nbytes: float) -> int:
        return max(2 * cores, -(-int(nbytes) // BUCKET))

    blobs = "bucket int, pack string, hs binary, many binary"

    def ties(rows: DataFrame, emit, nbytes: float, most: int, name: str) -> DataFrame:
        """Of about ``nbytes`` of fingerprints, sorted in passes of about ``most`` bytes."""
        n = buckets(nbytes)
        passes = min(n, max(1, -(-int(nbytes) // max(most, 1))))
        out = None
        for g in range(passes):
            one = staged(rows.mapInArrow(emit(length, n, n * g // passes, n * (g + 1) // passes), blobs).groupBy("bucket").applyInArrow(_ties, _TIES), name)
            out = one if out is None else out.union(one)
            release(spark)
        return out

    f1 = ties(packs.select("pack", "blob", "off"), _rank_samples, 8 * size * len(d) / v, size, "cover-ranks")

    def per_pack(f: DataFrame, name: str) -> DataFrame:
        return f.groupBy("pack").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(name))

    maybe = (f1.agg(F.sum("tied")).first()[0] or 0) * v / len(d) * 8  # bytes of fingerprints to sort, about
    marked = packs.join(per_pack(f1, "f1"), "pack", "left").mapInArrow(_mark(length), StructType([*schema.fields, StructField("runs", ArrayType(LongType()))]))
    marked = staged(marked, "marked-packs")
    drop(packs)
    release(spark)
    tied = ties(marked.filter("size(runs) > 0").select("pack", "blob", "off", "runs"), _sort_bucket, maybe, size // 2, "ties")
    out = StructType([StructField("_c", kind), *StructType.fromDDL(make.ddl).fields])
    return marked.join(per_pack(tied, "f2"), "pack", "left").mapInArrow(_cut(length, make, words), out)


def dedup(docs: DataFrame, text: str = "text", length: int = 400, words: int = 0) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; documents of which nothing is left keep an empty text.

    With ``words``, runs of repeated strings are cut only where they cover that many whole words or 400 bytes.
    A null text stays null, a column ``n_chars`` is set to the new text's length where it was set before.
    """
    rest = [c for c in docs.columns if c != text]
    out = _apply(docs.withColumn("_null", F.col(text).isNull()), text, [*rest, "_null"], length, _Kept(), words)
    kept = F.when(~F.col("_c._null"), F.col("kept"))
    size = F.when(F.col("_c.n_chars").isNotNull(), F.char_length(F.coalesce(kept, F.lit("")))).cast("long") if "n_chars" in rest else None
    return out.select(*[kept.alias(c) if c == text else size.alias(c) if c == "n_chars" else F.col(f"_c.`{c}`").alias(c) for c in docs.columns])


def op6(docs: DataFrame) -> DataFrame:
    """The query's digest."""
    out = _apply(docs.select("doc_id", "text"), "text", ["doc_id"], 400, _Digest())
    return out.select("_c.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
