"""Quality classifier: histogram gradient-boosted trees over statistics of a text.

Features are counts and ratios of the whole text (``FEATURES``), computed in numpy from UTF-8 bytes. The trees are
grown on the driver by second-order logistic boosting over at most 64 quantile bins a feature, on at most ``max_rows``
labelled rows in expectation (chosen by a hash of doc_id and thinned evenly beyond the bound); scoring walks all trees at once in
flattened arrays.

Cases: a null or empty text has all features zero and is scored like any other; repeated labels of a document are
averaged; null labels and null doc_ids don't train; without any label the score is 0.5 for every text; one class only
gives a constant score. Extra columns stay, clashing ``score`` and ``predicted`` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ashlar.llm import words as W

#: share of bytes per class, then the rest
CLASSES = ["other", "lower", "upper", "digit", "space", "newline", "stop", "comma", "bang", "pipe", "symbol", "bracket", "colon", "lead", "tail", "control"]
FEATURES = [
    *CLASSES, "log_bytes", "log_words", "word_len", "word_len_sd", "short_words", "upper_letters", "unique_words", "repeated_next", "marked_words",
    "capital_words", "unique_lines", "words_a_line", "unique_3grams", "log_lines", "words_a_stop",
]
_CLASS = np.zeros(256, np.int64)
_CLASS[:32] = 15
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9]] = 4
_CLASS[10] = 5
for _c, _k in ((".", 6), (",", 7), ("!?", 8), ("|", 9), ("*#$%&@^~_=+\\/", 10), ("()[]{}<>\"'`", 11), (":;-", 12)):
    _CLASS[[ord(x) for x in _c]] = _k
_CLASS[0x80:0xC0] = 14
_CLASS[0xC0:] = 13
_LINE = np.ones(256, bool)
_LINE[10] = False


def _distinct(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per row."""
    u, at = np.unique(W.combine(rows.astype(np.uint64), h), return_index=True)
    return np.bincount(rows[at], minlength=n)


def features(col: pa.Array) -> np.ndarray:
    """A row of FEATURES per text."""
    data, off = W.buffers(col)
    out = np.zeros((len(col), len(FEATURES)))
    k = len(CLASSES)
    for lo, hi in W.chunks(off):
        d, o = W.slice_rows(data, off, lo, hi)
        n = hi - lo
        size = np.diff(o).astype(float)
        cls = _CLASS[d]
        counts = np.bincount(np.repeat(np.arange(n) * k, np.diff(o)) + cls, minlength=n * k).reshape(n, k)
        w, lines = W.Words(d, o, W.SPACED), W.Words(d, o, _LINE)
        row, lrow = w.row(), lines.row()
        nw, nl = np.diff(w.first).astype(float), np.diff(lines.first).astype(float)
        one, line1 = np.maximum(nw, 1), np.maximum(nl, 1)
        length = (w.ends - w.starts).astype(float)
        per = lambda x: np.bincount(row, x, n) / one  # noqa: E731,B023
        same = np.zeros(len(row), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
        last = cls[w.ends - 1] if len(row) else np.zeros(0, np.int64)
        g = W.windows(w.hash, 3)
        grow = row[: len(g)]
        inside = np.arange(len(g)) + 3 <= w.first[1:][grow] if len(g) else np.zeros(0, bool)
        f = out[lo:hi]
        f[:, :k] = counts / np.maximum(size, 1)[:, None]
        mean = per(length)
        letters = counts[:, 1] + counts[:, 2]
        rest = [
            np.log1p(size), np.log1p(nw), mean, np.sqrt(np.maximum(per(length**2) - mean**2, 0)), per(length <= 3), counts[:, 2] / np.maximum(letters, 1),
            _distinct(row, w.hash, n) / one, per(same), per((last == 10) | (last == 8)), per(cls[w.starts] == 2) if len(row) else np.zeros(n),
            _distinct(lrow, lines.hash, n) / line1, nw / line1, _distinct(grow[inside], g[inside], n) / np.maximum(nw - 2, 1), np.log1p(nl), nw / (counts[:, 6] + 1),
        ]
        f[:, k:] = np.stack(rest, 1)
    return out


class Trees:
    """All trees in flat arrays: a node's feature (-1: leaf), threshold, left child (right is next to it) and value."""

    def __init__(self, base: float):
        self.base, self.roots = base, []
        self.feature, self.threshold, self.left, self.value = [], [], [], []
        self.depth = 0

    def frozen(self) -> Trees:
        for k, t in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("value", float), ("roots", np.int32)):
            setattr(self, k, np.array(getattr(self, k), t))
        return self

    def score(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        out = np.full(len(x), self.base)
        for s in range(0, len(x), block) if len(self.roots) else ():
            part = x[s : s + block]
            at = np.repeat(self.roots[:, None], len(part), 1)
            rows = np.arange(len(part))[None, :]
            for _ in range(self.depth):
                f = self.feature[at]
                right = part[rows, np.maximum(f, 0)] > self.threshold[at]
                at = np.where(f < 0, at, self.left[at] + right)
            out[s : s + block] += self.value[at].sum(0)
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 1.0, least: float = 2.0) -> Trees:
    if not len(y):
        return Trees(0.0).frozen()
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    t = Trees(float(np.log(p / (1 - p))))
    t.depth = depth
    if y.min() == y.max():
        return t.frozen()
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)  # x <= edges[c] iff code <= c
    out = np.full(n, t.base)
    flat = (code + np.arange(m) * bins).ravel()
    for _ in range(trees):
        pr = 1 / (1 + np.exp(-out))
        g, h = pr - y, pr * (1 - pr)
        node = np.zeros(n, np.int64)
        t.roots.append(len(t.feature))
        ids = [len(t.feature)]
        for a in (t.feature, t.threshold, t.left, t.value):
            a.append(0)
        t.feature[ids[0]] = -1
        for level in range(depth + 1):
            k = len(ids)
            G, H = np.bincount(np.maximum(node, 0), g * (node >= 0), k), np.bincount(np.maximum(node, 0), h * (node >= 0), k)
            for i, at in enumerate(ids):
                t.value[at] = -rate * G[i] / (H[i] + l2)
            if level == depth:
                break
            live = node >= 0
            cell = (np.repeat(node[live] * m * bins, m) + flat.reshape(n, m)[live].ravel())
            hg = np.bincount(cell, np.repeat(g[live], m), k * m * bins).reshape(k, m, bins).cumsum(2)
            hh = np.bincount(cell, np.repeat(h[live], m), k * m * bins).reshape(k, m, bins).cumsum(2)
            Gk, Hk = G[:, None, None], H[:, None, None]
            gain = hg**2 / (hh + l2) + (Gk - hg) ** 2 / (Hk - hh + l2) - Gk**2 / (Hk + l2)
            gain[(hh < least) | (Hk - hh < least)] = 0
            nxt, new = np.full(n, -1, np.int64), []
            for i, at in enumerate(ids):
                j, c = np.unravel_index(gain[i].argmax(), (m, bins))
                if gain[i, j, c] <= 1e-6 or c >= len(edges[j]):
                    continue
                t.feature[at], t.threshold[at], t.left[at] = j, float(edges[j][c]), len(t.feature)
                for _side in range(2):
                    new.append(len(t.feature))
                    for a, v in ((t.feature, -1), (t.threshold, 0.0), (t.left, 0), (t.value, 0.0)):
                        a.append(v)
                mine = node == i
                nxt[mine] = len(new) - 2 + (code[mine, j] > c)
            done = live & (nxt < 0)
            if done.any():
                out[done] += np.array(t.value)[np.array(ids)[node[done]]]
            node, ids = nxt, new
            if not ids:
                break
        live = node >= 0
        if live.any():
            out[live] += np.array(t.value)[np.array(ids)[node[live]]]
    return t.frozen()


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = 20_000, **options) -> Trees:
    """Fit on the labelled rows; see the module's text for the bound."""
    lab = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.avg(F.col(label).cast("double")).alias("_y"))
    n = lab.count()
    if n > max_rows:
        lab = lab.filter(F.pmod(F.xxhash64("_k"), F.lit(1 << 40)) < int(max_rows / n * (1 << 40)))

    def run(batches):
        for batch in batches:
            x = features(W.column(batch, "t"))
            yield pa.RecordBatch.from_arrays([W.column(batch, "_y"), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    # the labels are bounded by max_rows, so they are the side to broadcast
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("t")).join(F.broadcast(lab), "_k").select("_y", "t").mapInArrow(run, "y double, x array<double>").toPandas()
    x = np.stack(rows["x"].to_numpy()) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, rows["y"].to_numpy())) if len(rows) else []  # the fit doesn't depend on the order of rows
    return fit_trees(x[order], rows["y"].to_numpy()[order], **options)


def classify(docs: DataFrame, model: Trees, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    docs = docs.drop("score", "predicted")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.score(features(W.column(batch, text)))
            arrays = [batch.column(i) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(s), pa.array((s >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def held_out(key):
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def op9(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's digest: doc_id, held_out, score, predicted."""
    model = fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    return classify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
