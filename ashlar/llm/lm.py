"""Language-model scoring by a hashed maximum-entropy model with a class-factored softmax, dealt by context.

Tokens are words (runs of bytes other than white space, A-Z lowered) and one end a text. Token counts over all training
texts order the vocabulary, and nested classes of equal mass split it (frequency binning): the share of all mass that
comes before a token, written in base 16, is its path of classes, as long as it takes to be alone. So
P(token | history) is a product of softmaxes over 16 classes each, and depth and number of classes grow with the
vocabulary. The most frequent tokens, up to ``head``, are leaves of their own. Every other token belongs to one of up to
2**16 leaves by its hash, as many as the tail needs; within such a leaf it has its share of the leaf's counts.

A softmax starts from the classes' masses and adds a row of 16 weights per feature and node of the path, named by their
hash. Features are the previous token, the two previous (n-grams), the token before the previous alone, and the previous
with the third back (skips). The weights are never in one place: occurrences go to blocks by their previous token, so
a block holds all occurrences of its n-grams, learns their rows, and scores what it holds. The number of blocks grows
with the text, so rows grow with the n-grams of the corpus; only the skip without the previous token is learned from the
block's own contexts. Training is gradient steps, block by block: a row moves by its gradient over all training
occurrences of the block, divided by an estimate of the curvature and a prior; features follow each other, ``sweeps`` times.

An occurrence that is learned from is left out of the rows that it is scored with, and that later features see. So a
corpus can be scored by a model of itself: what only a text itself tells does not count for it, and texts that were
learned from score like others. (Equal texts therefore score equally where both are learned from, or neither is.)

Hot previous tokens are dealt further by the token before, then by the third back, then by the text, so no key holds
more than half of a block's mean share, but for one text that repeats three hot tokens throughout.

Between tasks move packs: the occurrences of about 2**20 tokens for one block, as compressed byte planes, and back their
summed scores a text. Counts reach tokens in two ways: the head by a broadcast table of bounded size, the others by a
join; both are exact (up to 64-bit hashes of tokens).

Cases: null and empty texts are one end token; an empty training set gives every token the uniform unseen share;
repeated rows count and are scored repeatedly, equally; very long texts are scored whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ashlar.llm import words as W
from ashlar.llm.store import staged

BITS, DIGITS = 4, 15
BRANCH = 1 << BITS
#: tokens dealt at once by a task, bytes of text split into words at once, bytes of text a block has on average, rows of weights handled at once
FLUSH, PIECE, BLOCK_BYTES, ROWS, STEP = 1 << 20, 1 << 19, 1 << 22, 1 << 14, 1 << 18
#: parts of a power of ten that sums of scores are rounded to on their way back
FINE = 1 << 14
#: bits of a tail token's hash that name it in histories; the first of them choose its leaf
TAIL = 24
#: hash of the end token; no word has it but by collision
END = np.uint64(0x1F83D9ABFB41BD6B)
_U = np.uint64


def tokens(data: np.ndarray, off: np.ndarray):
    """(token hashes with an end per row, first token of each row)."""
    w = W.Words(data, off, W.SPACED)
    n = len(off) - 1
    first = w.first + np.arange(n + 1)
    out = np.empty(first[-1], np.uint64)
    out[first[1:] - 1] = END
    if len(w.hash):
        out[np.arange(len(w.hash)) + w.row()] = w.hash
    return out, first


def _count(batches):
    hs: list[np.ndarray] = []
    ns: list[np.ndarray] = []

    def merged():
        u, inv = np.unique(np.concatenate(hs), return_inverse=True)
        return u, np.bincount(inv, np.concatenate(ns), len(u)).astype(np.int64)

    def rows():
        u, n = merged()
        for i in range(0, len(u), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 200_000].view(np.int64)), pa.array(n[i : i + 200_000])], ["h", "n"])

    held = 0
    for batch in batches:
        data, off = W.buffers(batch.column(0))
        for lo, hi in W.chunks(off, PIECE):
            u, n = np.unique(tokens(*W.slice_rows(data, off, lo, hi))[0], return_counts=True)
            hs.append(u)
            ns.append(n)
            held += len(u)
            if held > 3_000_000:
                u, n = merged()
                hs, ns, held = [u], [n], len(u)
                if held > 1_500_000:
                    yield from rows()
                    hs, ns, held = [], [], 0
    if hs:
        yield from rows()


class Lookup:
    """Hash -> rank for a fixed set of hashes: three direct-addressed tables; what fits none of them is not found."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(10, len(keys).bit_length())
        self.keys, self.tables = keys, []
        left = np.arange(len(keys))
        for shift in (0, 21, 42):
            slot = self._slot(keys[left], shift)
            t = np.full(1 << self.bits, -1, np.int32)
            t[slot[::-1]] = left[::-1]  # the first, more frequent, wins
            self.tables.append((shift, t))
            left = left[t[slot] != left]
        self.found = np.ones(len(keys), bool)
        self.found[left] = False

    def _slot(self, h, shift):
        return ((h >> _U(shift)) & _U((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        todo = np.arange(len(h))
        for shift, t in self.tables:
            i = t[self._slot(h[todo], shift)]
            ok = (i >= 0) & (self.keys[np.maximum(i, 0)] == h[todo])
            out[todo[ok]] = i[ok]
            todo = todo[~ok]
            if not len(todo):
                break
        return out


class Tree:
    """Nested classes of leaves by their masses: a leaf's path is its place in the falling order of mass, in base 16.

    Per level: each leaf's node and digit in one number (-1 below its end), and each node's log shares.
    """

    def __init__(self, mass: np.ndarray):
        order = np.argsort(-mass, kind="stable")
        m = mass[order]
        end = np.cumsum(m)
        code = ((end - m) / end[-1] * 2.0 ** (BITS * DIGITS)).astype(np.uint64)
        gap = np.concatenate([[_U(1) << _U(63)], code[1:] ^ code[:-1], [_U(1) << _U(63)]])
        near = np.minimum(gap[1:], gap[:-1])  # the nearer neighbour shares more digits
        self.at, self.bias = [], []
        for level in range(DIGITS):
            on = np.flatnonzero((near >> _U(BITS * (DIGITS - level))) == 0).astype(np.int32)
            if not len(on):
                break
            c = code[on]
            prefix = c >> _U(BITS * (DIGITS - level))
            at = np.cumsum(np.concatenate([[False], prefix[1:] != prefix[:-1]]), dtype=np.int32)
            at *= BRANCH
            at += ((c >> _U(BITS * (DIGITS - level - 1))) & _U(BRANCH - 1)).astype(np.int32)
            share = np.bincount(at, m[on], (at[-1] // BRANCH + 1) * BRANCH).reshape(-1, BRANCH)
            with np.errstate(divide="ignore"):
                self.bias.append(np.maximum(np.log(share / share.sum(1, keepdims=True)), -60).astype(np.float32))
            where = np.full(len(m), -1, np.int32)
            where[order[on]] = at
            self.at.append(where)


def _bits(n: int) -> int:
    return max(1, int(n - 1).bit_length())


def _grouped(node: np.ndarray, bits: int, h: np.ndarray):
    """(order by node and feature, first position of each group); groups are told apart by the hash bits that fit."""
    low = _bits(len(node))
    k = (h >> _U(bits)) & ~_U((1 << low) - 1) | np.arange(len(node), dtype=np.uint64)
    if bits:
        k |= node.astype(np.uint64) << _U(64 - bits)
    k.sort()
    order = (k & _U((1 << low) - 1)).astype(np.int32)
    k >>= _U(low)
    return order, _first(k)


def _first(*keys: np.ndarray) -> np.ndarray:
    """Positions at which one of the keys changes."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _sums(y: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of groups of rows; small groups, which are most, all at once."""
    out = np.empty((len(starts), y.shape[1]), np.float32)
    for size in range(1, 7):
        at = np.flatnonzero(sizes == size)
        if len(at):
            s = starts[at]
            total = y.take(s, axis=0)
            for j in range(1, size):
                total += y.take(s + j, axis=0)
            out[at] = total
    at = np.flatnonzero(sizes > 6)
    if len(at):
        ends = np.stack([starts[at], starts[at] + sizes[at]], 1).ravel()
        out[at] = np.add.reduceat(y, ends[:-1] if ends[-1] == len(y) else ends, axis=0)[::2]
    return out


def _step(x: np.ndarray, order: np.ndarray | None, starts: np.ndarray, digit: np.ndarray, learn: np.ndarray, prior: float) -> None:
    """One gradient step of every group's row, added to the logits ``x`` of its occurrences (in ``order``, if given).

    The gradient is observed less expected counts; the curvature of a class is estimated by their mean. A training
    occurrence is left out of the gradient of the row that is added to it, so a group's only one changes nothing.
    """
    sizes = np.diff(np.append(starts, len(x)))
    some = (sizes > 1) & (np.add.reduceat(learn if order is None else learn[order], starts) > 0)
    held = int(sizes[some].sum())
    if not held:
        return
    if order is None and held > 0.6 * len(x):  # in place; what changes nothing comes along
        rows, starts = None, np.append(starts, len(x))
    else:
        rows = np.flatnonzero(np.repeat(some, sizes))
        sizes = sizes[some]
        rows = rows if order is None else order[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
    g = 0
    while g < len(sizes):
        last = max(g + 1, int(np.searchsorted(starts, starts[g] + ROWS, "right")) - 1)
        s, e, n = starts[g], starts[last], last - g
        at = slice(s, e) if rows is None else rows[s:e]
        z = x[at] if rows is None else x.take(at, axis=0)
        lr, d = learn[at], digit[at]
        y = np.exp(z)
        y *= (lr / (y @ _ONES))[:, None]
        group = np.repeat(np.arange(n), sizes[g:last])
        seen = np.bincount(group * BRANCH + d, lr, n * BRANCH).astype(np.float32).reshape(-1, BRANCH)
        expected = _sums(y, starts[g:last] - s, sizes[g:last])
        scale = 1 / ((seen + expected) / 2 + prior)
        y.ravel()[np.arange(0, (e - s) * BRANCH, BRANCH) + d] -= lr
        y *= scale.take(group, axis=0)
        seen -= expected
        seen *= scale
        y += seen.take(group, axis=0)
        z += y
        if rows is not None:  # whole rows as single items move faster
            x.view(_ROW).ravel()[at] = z.view(_ROW).ravel()
        g = last


_ONES = np.ones(BRANCH, np.float32)
_ROW = np.dtype(f"V{4 * BRANCH}")


class Model:
    """Counts of the head, leaves of all tokens, and how contexts are dealt; the weights live in the blocks."""

    def __init__(self, keys, counts, n: int, v: int, cells, blocks: int = 1, sweeps: int = 1, prior: float = 0.3):
        """keys and counts: the head, by falling count; n tokens, v distinct ones in training; cells: masses of the tail's leaves."""
        counts = np.asarray(counts, float)
        self.given = keys, counts, n, v, cells, blocks, sweeps, prior
        self.keys, self.counts, self.n, self.v = keys, counts, n, v
        self.total = n + 0.1 * (v + 1)
        self.head, self.cell_bits = len(keys), int(len(cells) - 1).bit_length()
        self.cells = np.array(cells, float)
        self.lookup = Lookup(keys)
        self.lost = np.flatnonzero(~self.lookup.found)  # the few that the table can't hold count as tail
        np.add.at(self.cells, self.cell(keys[self.lost] >> _U(64 - TAIL)), self.counts[self.lost] + 0.1)
        self.tree = None
        self.blocks, self.sweeps, self.prior = blocks, sweeps, prior
        self.hot = int(np.searchsorted(-self.counts, -n / (2 * blocks), "left")) if blocks > 1 else 0

    def __reduce__(self):
        return Model, self.given  # tables are made where they are used

    def leaves(self) -> Tree:
        if self.tree is None:
            mass = np.append(self.counts + 0.1, self.cells)
            mass[self.lost] = 0.1  # never asked for
            self.tree = Tree(mass)
            self.lookup = None  # a worker that learns asks for no more tokens
        return self.tree

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ranks of the head's tokens, -1 for others."""
        if self.lookup is None:
            self.lookup = Lookup(self.keys)
        return self.lookup(h)

    def cell(self, name: np.ndarray) -> np.ndarray:
        return (name.astype(np.uint64) >> _U(TAIL - self.cell_bits)).astype(np.int64)

    def ids(self, h: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Names of tokens in histories: ranks of the head, then hash bits; one more than the last stands for no token."""
        return np.where(rank >= 0, rank, self.head + (h >> _U(64 - TAIL)).astype(np.int64)).astype(np.uint32)

    def history(self, ids: np.ndarray, first: np.ndarray):
        pos = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
        none = self.head + (1 << TAIL)

        def back(k):
            out = np.full(len(ids), none, np.uint32)
            out[k:] = ids[: len(ids) - k]
            out[pos < k] = none
            return out

        return back(1), back(2), back(3)

    def block(self, a, b, c, salt) -> np.ndarray:
        """The block of each context; ``salt`` is a hash of the text."""
        none = self.head + (1 << TAIL)
        key = W.mix(a.astype(np.uint64))
        at = np.arange(len(a))
        for more in (b, c, None):
            last = a if more is b else b if more is c else c
            at = at[(last[at] < self.hot) | (last[at] == none)]
            if not len(at):
                break
            key[at] = W.combine(key[at], (salt if more is None else more)[at].astype(np.uint64))
        return (key % _U(self.blocks)).astype(np.int64)

    def learn_and_score(self, a, b, c, w, learn) -> np.ndarray:
        """log10 probability of each token's leaf; rows are learned from the occurrences marked ``learn``, each left out of its own."""
        n, tree = len(a), self.leaves()
        low = _bits(n)
        k = (a.astype(np.uint64) << _U(39)) | (W.mix(b.astype(np.uint64)) >> _U(25 + low) << _U(low)) | np.arange(n, dtype=np.uint64)
        k.sort()
        order = (k & _U((1 << low) - 1)).astype(np.int32)  # by previous token and the one before it
        two = np.cumsum(np.concatenate([[False], (k[1:] >> _U(low)) != (k[:-1] >> _U(low))]), dtype=np.int32)
        a, b, c = a[order], b[order].astype(np.uint64), c[order].astype(np.uint64)
        second, third = W.mix(b + _U(2 << 40)), W.combine(a.astype(np.uint64), c)
        del k, b, c
        name = w[order].astype(np.int32)
        leaf = np.where(name < self.head, name, self.head + self.cell(np.maximum(name - self.head, 0)).astype(np.int32)).astype(np.int32)
        out, at, learn = np.zeros(n), np.arange(n, dtype=np.int32), learn[order].astype(np.float32)
        for where, bias in zip(tree.at, tree.bias, strict=True):
            on = where[leaf]
            bits = int(len(bias) - 1).bit_length()
            if bits or on.min() < 0:  # by node, and as before within one; ended paths go
                k = ((on >> BITS).astype(np.uint64) << _U(32)) | np.arange(len(on), dtype=np.uint64)
                k = k[on >= 0]
                if not len(k):
                    break
                k.sort()
                o = (k & _U((1 << 32) - 1)).astype(np.int32)
                at, leaf, on, a, two, second, third, learn = (v[o] for v in (at, leaf, on, a, two, second, third, learn))
                del k, o
            node, d = on >> BITS, on & (BRANCH - 1)
            x = bias.take(node, axis=0)
            for _ in range(self.sweeps):
                _step(x, None, _first(node, a), d, learn, self.prior)
                _step(x, *_grouped(node, bits, second), d, learn, self.prior)
                _step(x, None, _first(node, two), d, learn, self.prior)
                _step(x, *_grouped(node, bits, third), d, learn, self.prior)
            for s in range(0, len(x), ROWS):
                y = x[s : s + ROWS]
                out[at[s : s + ROWS]] += y[np.arange(len(y)), d[s : s + ROWS]] - np.log(np.exp(y) @ _ONES)
        back = np.empty(n)
        back[order] = out / np.log(10)
        return back


def _squeeze(raw: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _planes(*cols: np.ndarray) -> np.ndarray:
    """Byte planes of 32-bit columns, one row a plane."""
    return np.concatenate([np.ascontiguousarray(c.astype(np.uint32)).view(np.uint8).reshape(-1, 4).T for c in cols])


def _columns(blob: bytes, n: int, k: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.Codec("zstd").decompress(blob, n * k * 4), np.uint8).reshape(k, 4, n)
    return [np.ascontiguousarray(x.T).view(np.uint32).ravel() for x in raw]


def _table(rows: list, schema) -> pa.Table:
    return pa.table([list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in schema], schema=schema)


_DEALT = pa.schema([("block", pa.int64()), ("p", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])
_SQL_DEALT = "block long, p long, n int, blob binary"


def _deal(shared):
    """Per pack of texts: one row of the texts' own values (n = -1, block < 0), and per block one of its occurrences."""

    def run(batches):
        m: Model = shared.value
        with np.errstate(divide="ignore"):
            base, cells = np.log10(m.counts + 0.1), np.log10(m.cells)
        held: list = []
        size = 0

        def flush():
            rid = int(held[0][0]["_rid"][0].as_py())
            w, bags, counts, learn = (np.concatenate([x[i] for x in held]) for i in range(1, 5))
            first = np.concatenate([[0], np.cumsum(counts)])
            row = np.repeat(np.arange(len(counts), dtype=np.uint32), counts)
            a, b, c = m.history(w, first)
            block = np.concatenate([m.block(a[s : s + STEP], b[s : s + STEP], c[s : s + STEP], bags[row[s : s + STEP]]) for s in range(0, len(w), STEP)])
            if len(w) < 1 << 22 and m.blocks <= 1 << 22:
                k = block.astype(np.uint64) << _U(42)
                k |= np.minimum(a, (1 << 20) - 1).astype(np.uint64) << _U(22)
                k |= np.arange(len(w), dtype=np.uint64)
                k.sort()
                order = (k & _U((1 << 22) - 1)).astype(np.int32)
                del k
            else:
                order = np.lexsort((a, block))
            row = 2 * row + learn.astype(np.uint32)[row]
            planes = np.empty((20, len(w)), np.uint8)
            for i, x in enumerate((a, b, c, w, row)):
                planes[4 * i : 4 * i + 4] = _planes(x[order])
            block = block[order]
            del a, b, c, w, row, order
            cut = _first(block)
            ends = np.append(cut[1:], len(block))
            sink = pa.BufferOutputStream()
            own = pa.Table.from_batches([x[0] for x in held])
            with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(own)
            yield pa.RecordBatch.from_pylist([{"block": -1 - rid % m.blocks, "p": rid, "n": -1, "blob": sink.getvalue().to_pybytes()}], schema=_DEALT)
            for i in range(0, len(cut), 64):
                rows = [(int(block[s]), rid, int(e - s), _squeeze(planes[:, s:e].tobytes())) for s, e in zip(cut[i : i + 64], ends[i : i + 64], strict=True)]
                yield _table(rows, _DEALT).to_batches()[0]

        for batch in batches:
            data, off = W.buffers(W.column(batch, "_t"))
            learn = W.column(batch, "_learn").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in W.chunks(off, PIECE):
                h, first = tokens(*W.slice_rows(data, off, lo, hi))
                i = m.find(h)
                seen = i >= 0
                n = np.diff(first)
                row = np.repeat(np.arange(hi - lo), n)
                lp = np.zeros(len(h))
                lp[seen] = base[i[seen]]
                t = np.flatnonzero(~seen)
                share = np.zeros(len(h))
                share[t] = cells[m.cell(h[t] >> _U(64 - TAIL))]
                cut = np.searchsorted(t, first).astype(np.int32)
                own = pa.RecordBatch.from_arrays(
                    [
                        W.column(batch, "_rid").slice(lo, hi - lo), W.column(batch, "_c").slice(lo, hi - lo), pa.array(n.astype(np.int64)),
                        pa.array(np.bincount(row[seen], minlength=hi - lo).astype(np.int64)), pa.array(np.bincount(row, lp, hi - lo) - n * np.log10(m.total)),
                        pa.array(-np.bincount(row, share, hi - lo)), pa.ListArray.from_arrays(pa.array(cut), pa.array(h[t].view(np.int64))),
                    ],
                    ["_rid", "_c", "n_tokens", "known", "base", "score", "tail"],
                )
                held.append((own, m.ids(h, i), np.add.reduceat(W.mix(h), first[:-1]), n, learn[lo:hi]))
                size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def _work(shared):
    """A block: learn the rows of its contexts, and sum the scores of its occurrences a text."""

    def run(t: pa.Table) -> pa.Table:
        if not t.num_rows or t["block"][0].as_py() < 0:
            return t.cast(_DEALT)
        m: Model = shared.value
        t = t.take(pa.array(np.argsort(t["p"].to_numpy(), kind="stable")))  # so that sums don't hang on arrival
        n = t["n"].to_numpy()
        a, b, c, w, doc = (np.concatenate(x) for x in zip(*(_columns(x.as_buffer(), k, 5) for x, k in zip(t["blob"], n, strict=True)), strict=True))
        lp = m.learn_and_score(a, b, c, w, (doc & 1).astype(np.float32))
        rows, s, block = [], 0, t["block"][0].as_py()
        for p, k in zip(t["p"].to_pylist(), n, strict=True):
            i, at = np.unique(doc[s : s + k] >> 1, return_inverse=True)
            total = np.rint(np.bincount(at, lp[s : s + k]) * -FINE).astype(np.uint32)
            rows.append((block, p, len(i), _squeeze(_planes(i, total).tobytes())))
            s += k
        return _table(rows, _DEALT)

    return run


def _gather(t: pa.Table) -> pa.Table:
    """A pack of texts with the scores that all blocks summed for them."""
    t = t.take(pa.array(np.argsort(t["block"].to_numpy(), kind="stable")))
    n = t["n"].to_numpy()
    own = pa.ipc.open_stream(t["blob"][int(np.flatnonzero(n < 0)[0])].as_buffer()).read_all()
    total = own["score"].to_numpy().copy()
    for blob, k in zip(t["blob"], n, strict=True):
        if k > 0:
            i, x = _columns(blob.as_buffer(), k, 2)
            total[i] -= x / FINE
    at = own.schema.get_field_index("score")
    return own.set_column(at, "score", pa.array(total)).drop_columns(["_rid"])


def fit(docs: DataFrame, text: str = "text", head: int = 1 << 19, blocks: int = 1, sweeps: int = 1, prior: float = 0.3) -> tuple[Model, DataFrame]:
    """(model, counts): the vocabulary of ``docs``, its classes, and (h, n) of every token."""
    t = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    counts = staged(t.mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    # the head: all tokens of the highest powers of two of counts that fit
    level = F.floor(F.log2("n")).cast("int")
    levels = counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).orderBy(F.desc("l")).collect()  # 63 rows at most
    n, v, least, held = sum(r["n"] for r in levels), sum(r["v"] for r in levels), 62, 0
    for r in levels:
        if held + r["v"] > head:
            break
        held += r["v"]
        least = r["l"]
    top = counts.filter(F.col("n") >= (1 << least)).toArrow()
    h, c = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((h, -c))
    bits = min(16, max(0, int((v - held) // 16).bit_length()))
    cells = np.full(1 << bits, 0.1)
    if held < v:
        cell = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)
        got = counts.filter(F.col("n") < (1 << least)).groupBy(cell.alias("cell")).agg(F.sum(F.col("n") + 0.1).alias("m")).toArrow()  # 2**16 rows at most
        cells[got["cell"].to_numpy()] += got["m"].to_numpy()
    return Model(h[order], c[order], n, v, cells, blocks, sweeps, prior), counts


def score(docs: DataFrame, learn: Column | None = None, text: str = "text", carry: tuple[str, ...] = (), **options) -> DataFrame:
    """Per row of ``docs``: carry, n_tokens, n_known, train_tokens, base_score, score.

    ``learn`` marks the rows to learn from (all where it is not given, null is no); all rows are scored. To score other
    texts than those learned from, give both with a mark.
    """
    spark = docs.sparkSession
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    size = docs.agg(F.sum(F.octet_length(text).cast("long")).alias("n")).first()["n"] or 0
    model, counts = fit(docs.filter(learn), text, blocks=max(1, -(-size // BLOCK_BYTES)), **options)
    shared = spark.sparkContext.broadcast(model)
    held = F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry])
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), held.alias("_c"), learn.alias("_learn"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    dealt = rows.mapInArrow(_deal(shared), _SQL_DEALT).repartition(min(model.blocks, 1 << 15), "block")
    schema = StructType([*rows.select("_c").schema.fields, *StructType.fromDDL("n_tokens long, known long, base double, score double, tail array<long>").fields])
    worked = dealt.groupBy("block").applyInArrow(_work(shared), _SQL_DEALT)
    first = staged(worked.groupBy("p").applyInArrow(_gather, schema).withColumn("_rid", F.monotonically_increasing_id()), "scored")
    shared.unpersist()  # the blocks' tables need not outlive them
    missing = len(model.lost) > 0
    floor = float(model.counts.min()) if len(model.counts) else float("inf")
    tail = counts if missing else counts.filter(F.col("n") < floor)
    c = first.filter("size(tail) > 0").select("_rid", F.explode("tail").alias("h")).join(tail, "h", "left").select("_rid", F.coalesce("n", F.lit(0)).alias("n"))
    c = c.groupBy("_rid").agg(F.sum(F.log10(F.col("n") + 0.1)).alias("more"), F.sum((F.col("n") > 0).cast("long")).alias("k"))
    out = first.drop("tail").join(c, "_rid", "left")
    more, k = F.coalesce("more", F.lit(0.0)), F.coalesce("k", F.lit(0))
    return out.select(
        *[F.col(f"_c.{x}").alias(x) for x in carry],
        "n_tokens",
        (F.col("known") + k).alias("n_known"),
        F.lit(int(model.n)).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def op3(docs: DataFrame) -> DataFrame:
    """The query's digest."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    docs = docs.select("doc_id", "text")
    out = score(docs, ~held, carry=("doc_id",))
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
