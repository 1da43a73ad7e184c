"""Language identification by word-first backoff.

A word that the model knows scores its log frequency in each language; any other word falls back to the longest order
of character n-grams of which the model knows one, down to single characters, and scores the mean of those. A text's
score per language is the sum over its words; the softmax over languages is its probability.

Training counts words and n-grams over a bounded sample of labelled rows: at most ``per_lang`` rows a language in
expectation, chosen by a hash of the text and, if given, a ``key``, so that copies enter one by one. The counting is distributed; the ``top_words`` words and ``top_grams``
n-grams of each order a language keeps are what reaches the driver, and so bound the model.

Cases: a null text or one without a letter has language ``und`` and score 0.0; a text whose letters the model has never
seen takes the first language in alphabetical order at probability 1/L. Very long texts are scored whole. Rows with a
null language don't train; repeated rows count repeatedly. Without any labelled row every text is ``und``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ashlar.llm import words as W
from ashlar.llm.store import staged

ORDERS = (5, 4, 3, 2, 1)


def _words(col: pa.Array):
    """Chunks of (rows lo, hi, Words) of the lower-cased texts; a word is a run of letters in the wide sense."""
    data, off = W.buffers(pc.utf8_lower(col.fill_null("")))
    for lo, hi in W.chunks(off):
        d, o = W.slice_rows(data, off, lo, hi)
        yield lo, hi, W.Words(d, o, LETTER)


LETTER = W.ALNUM.copy()
LETTER[0x30:0x3A] = False


def _grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int):
    """(index of word, hash) of every n-gram of code points, bounded by a mark at either end of the word."""
    mark = np.uint8(0x20)
    length = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(length)])
    own = np.repeat(np.arange(len(starts)), length)
    k = np.arange(first[-1]) - first[own]
    buf = np.where((k == 0) | (k == length[own] - 1), mark, data[np.clip(starts[own] + k - 1, 0, max(len(data) - 1, 0))])
    lead = np.flatnonzero((buf & 0xC0) != 0x80)  # first bytes of code points
    if len(lead) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    stop = np.append(lead[1:], len(buf))
    p = W.prefix_hash(buf)
    a, b = lead[: len(lead) - n + 1], stop[n - 1 :]
    keep = own[a] == own[b - 1]
    if n == 1:
        keep &= buf[a] != mark
    a, b = a[keep], b[keep]
    return own[a], W.mix((p[b] - p[a]) * W.powers(len(buf))[1][a] + np.uint64(n))


def _count(lang_col: str, text_col: str):
    def run(batches):
        for batch in batches:
            langs = W.column(batch, lang_col).to_pylist()
            names = sorted(set(langs))
            code = np.array([names.index(x) for x in langs])
            for lo, hi, w in _words(W.column(batch, text_col)):
                who = code[lo:hi][w.row()]
                for c in np.unique(who):
                    h, at, n = np.unique(w.hash[who == c], return_index=True, return_counts=True)
                    at = np.flatnonzero(who == c)[at]
                    out = [(0, h, n)]
                    for order in ORDERS:
                        own, g = _grams(w.data, w.starts[at], w.ends[at], order)
                        u, inv = np.unique(g, return_inverse=True)
                        out.append((order, u, np.bincount(inv, n[own], len(u)).astype(np.int64)))
                    for order, u, n2 in out:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([names[c]] * len(u), pa.string()), pa.array(np.full(len(u), order, np.int32)), pa.array(u.view(np.int64)), pa.array(n2.astype(np.int64))],
                            ["lang", "ord", "h", "n"],
                        )

    return run


class Model:
    """langs; for words (order 0) and each n-gram order, sorted hashes and a row of log frequencies per hash."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs, self.tables = langs, tables

    def lookup(self, order: int, h: np.ndarray):
        keys, rows = self.tables[order]
        if not len(keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return i, keys[i] == h

    def word_scores(self, data, starts, ends, h) -> np.ndarray:
        out = np.zeros((len(h), len(self.langs)), np.float64)
        i, known = self.lookup(0, h)
        out[known] = self.tables[0][1][i[known]]
        left = np.flatnonzero(~known)
        for order in ORDERS:
            if not len(left):
                break
            own, g = _grams(data, starts[left], ends[left], order)
            i, ok = self.lookup(order, g)
            own, i = own[ok], i[ok]
            n = np.bincount(own, minlength=len(left))
            got = n > 0
            if got.any():
                rows = self.tables[order][1][i]
                s = np.stack([np.bincount(own, rows[:, k], len(left)) for k in range(rows.shape[1])], 1)
                out[left[got]] = s[got] / n[got, None]
            left = left[~got]
        return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str | None = None, per_lang: int = 4000, top_words: int = 40_000, top_grams: int = 20_000) -> Model:
    """Fit on the rows of ``docs`` that have a language; see the module's text for the bounds."""
    rows = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.xxhash64(text, *([key] if key else [])).alias("_h")).filter("l is not null and t is not null")
    share = rows.groupBy("l").agg(F.least(F.lit(1.0), F.lit(float(per_lang)) / F.count(F.lit(1))).alias("p"))
    share = staged(share, "language-shares")
    if share.count() <= 10_000:  # a row per language: known to be small before it is sent to all, so that texts stay where they are
        share = F.broadcast(share)
    picked = rows.join(share, "l").filter(F.pmod(F.col("_h"), F.lit(1 << 30)) < F.col("p") * (1 << 30)).select("l", "t")
    counts = picked.mapInArrow(_count("l", "t"), "lang string, ord int, h long, n long").groupBy("lang", "ord", "h").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "ord").orderBy(F.desc("n"), "h"))
    kept = counts.withColumn("r", rank).filter(F.col("r") <= F.when(F.col("ord") == 0, top_words).otherwise(top_grams)).drop("r").toPandas()
    langs = sorted(kept["lang"].unique())
    tables = {}
    for order in (0, *ORDERS):
        part = kept[kept["ord"] == order]
        keys, inv = np.unique(part["h"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        m = np.zeros((len(keys), len(langs)))
        if len(part):
            m[inv, part["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = part["n"].to_numpy()
            total = m.sum(0, keepdims=True)
            m = np.log((m + 0.5) / (total + 0.5 * (len(keys) + 1)))
        tables[order] = (keys, m)
    return Model(langs, tables)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; clashing columns of that name are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    schema = StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches):
        m: Model = shared.value
        for batch in batches:
            col = W.column(batch, text)
            pred, score = [], np.zeros(len(col))
            for lo, hi, w in _words(col):
                u, at, inv = np.unique(w.hash, return_index=True, return_inverse=True)
                s = np.zeros((hi - lo, max(1, len(m.langs))))
                if len(u) and m.langs:
                    per = m.word_scores(w.data, w.starts[at], w.ends[at], u)[inv]
                    p = np.concatenate([np.zeros((1, per.shape[1])), np.cumsum(per, 0)])
                    s = p[w.first[1:]] - p[w.first[:-1]]
                e = np.exp(s - s.max(1, keepdims=True))
                e /= e.sum(1, keepdims=True)
                best = s.argmax(1)
                some = np.diff(w.first) > 0
                texts = col.slice(lo, hi - lo)
                plain = np.bincount(w.row()[w.data[w.starts] < 0x80], minlength=hi - lo) > 0  # has an ASCII letter
                for i in range(hi - lo):
                    if m.langs and some[i] and (plain[i] or any(c.isalpha() for c in texts[i].as_py() or "")):
                        pred.append(m.langs[best[i]])
                        score[lo + i] = e[i, best[i]]
                    else:
                        pred.append("und")
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1))], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def op1(docs: DataFrame) -> DataFrame:
    """The query's digest: doc_id, held_out, lang_pred, score."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    model = fit(docs.filter(~held), key="doc_id")
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
