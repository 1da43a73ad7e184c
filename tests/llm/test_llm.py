"""The ten operators on small fixtures: brute force, edge cases (nulls, empty, ties, repeats, long texts, clashing columns)."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import chat, decontam, graph, jaccard, langid, lm, mixing, quality, queries, spots, suffixes, warc, words

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "tu", "vo", "re") for b in ("ra", "s", "lin", "do", "pe", "")]
EDGE = [None, "", " \n\t", "one", "Two words", "x" * 5000, "the " * 700, "é ü ñ", "12 34 !!"]


def texts(n, seed=1):
    """Random texts, exact and near copies, a shared passage, and the edge cases."""
    r = random.Random(seed)
    out = [" ".join(r.choices(WORDS, k=r.randint(1, 90))) for _ in range(n)]
    base = " ".join(r.choices(WORDS, k=120))
    for _ in range(n // 3):
        w = base.split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = r.choice(WORDS)
        out.append(" ".join(w))
    passage = " ".join(r.choices(WORDS, k=60))
    out += [f"{a} {passage} {b}" for a, b in zip(out[:8], out[8:16], strict=True)] + [base] * 4
    return out + EDGE + EDGE


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], f"src{i % 4}" if i % 5 else None, len(t or ""), 1.5, "y") for i, t in enumerate(texts(60))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string").repartition(3).cache()


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def spaced(t):
    return re.findall(r"[^\x20\x09-\x0D]+", low(t))


def test_tokenising_agrees_with_patterns():
    import pyarrow as pa

    col = pa.array(texts(30), pa.string())
    data, off = words.buffers(col)
    for kind, pattern in ((words.SPACED, r"[^\x20\x09-\x0D]+"), (words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        got = []
        for lo, hi in words.chunks(off, 1000):
            w = words.Words(*words.slice_rows(data, off, lo, hi), kind)
            got += [[w.text(i).decode() for i in range(w.first[k], w.first[k + 1])] for k in range(hi - lo)]
        assert got == [re.findall(pattern, low(t.as_py())) for t in col]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8), (7, 8)], "a long, b long")
    assert sorted(map(tuple, graph.components(e).collect())) == [(3, 3), (4, 3), (5, 3), (7, 7), (8, 7), (9, 3)]
    assert graph.components(e.limit(0)).count() == 0


# -- 1 language identification
def test_langid_learns_and_backs_off(spark):
    r = random.Random(3)
    make = {"aa": ["kra", "kro", "krim", "skrat"], "bb": ["lulu", "luma", "ullu", "malu"]}
    rows = [(lang, " ".join(r.choices(ws, k=20))) for lang, ws in make.items() for _ in range(50)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    d = spark.createDataFrame([(1, "Kra, krim!"), (2, "lumalu ullulu"), (3, "krokra"), (4, None), (5, "12 !?"), (6, ""), (7, "жжж")], "doc_id long, text string")
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.predict(d, model).collect()}
    assert [got[i][0] for i in range(1, 8)] == ["aa", "bb", "aa", "und", "und", "und", "aa"]
    assert got[4][1] == 0 and 0.5 < got[1][1] <= 1 and got[7][1] == 0.5
    none = langid.predict(d, langid.fit(spark.createDataFrame([], "lang string, text string"))).collect()
    assert {x["lang_pred"] for x in none} == {"und"}


def test_op1(docs, spark, sf):
    out = langid.op1(docs)
    assert out.count() == docs.count() and out.filter("score < 0 or score > 1 or lang_pred is null").count() == 0
    real = spark.read.parquet(f"{sf}/documents.parquet")
    j = langid.op1(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert j.filter("lang = lang_pred").count() >= 0.95 * j.count()
    assert langid.op1(docs.limit(0)).count() == 0


# -- 2 mixing
def test_budgets_redistribute_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10, 1), ("a", "y", 1000, 1), ("b", "x", 1000, 1)], "d string, l string, n_tokens long, n_docs long")
    got = {(r["d"], r["l"]): r["budget"] for r in mixing.budgets(leaves, ["d", "l"], F.lit(200).cast("long"), {}, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 90, ("b", "x"): 100}
    got = {(r["d"], r["l"]): r["budget"] for r in mixing.budgets(leaves, ["d", "l"], F.lit(1900).cast("long"), {"d": {"a": 5}}, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 890}


def test_budgets_pass_on_what_unweighted_leaves_leave(spark):
    leaves = spark.createDataFrame([("a", "x", 100, 1), ("a", "y", 100, 1), ("b", "x", 1000, 1)], "d string, l string, n_tokens long, n_docs long")
    got = {(r["d"], r["l"]): r["budget"] for r in mixing.budgets(leaves, ["d", "l"], F.lit(400).cast("long"), {"l": {"y": 0}}, 1).collect()}
    assert got == {("a", "x"): 100, ("b", "x"): 300}


def test_mix_meets_budgets(docs):
    lv = {"lang": F.col("lang"), "source": F.col("source")}
    out = mixing.mix(docs, lv, share=2.2, max_epochs=3, slice_docs=4).cache()
    want = docs.select(*lv.values(), mixing.tokens(F.col("text")).alias("n")).groupBy("lang", "source").agg(F.sum("n").alias("n")).filter("n > 0")
    total = want.agg(F.sum("n")).first()[0]
    assert int(2.2 * total) - 20 <= out.agg(F.sum("tokens_taken")).first()[0] <= int(2.2 * total)
    over = out.groupBy("lang", "source").agg(F.sum("tokens_taken").alias("t")).join(want.select(F.col("lang").alias("l"), F.col("source").alias("s"), "n"), F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")))
    assert over.filter("t > 3 * n").count() == 0
    assert out.groupBy("doc_id", "epoch").count().filter("count > 1").count() == 0
    again = mixing.mix(docs.repartition(5), lv, share=2.2, max_epochs=3, slice_docs=1000)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    assert mixing.mix(docs.limit(0), lv).count() == 0


# -- 3 language model
def test_op3_counts_and_score(docs):
    toks = {d: [*spaced(t), "\0end"] for d, t in pairs(docs)}
    c = Counter(w for d, ws in toks.items() if zlib.crc32(str(d).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lm.op3(docs).collect():
        ws = toks[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) and r["score"] < 0


def lm_values(out):
    return {r["doc_id"]: (r["n_known"], round(r["base_score"], 6), round(r["score"], 4)) for r in out.collect()}


def test_lm_tail_goes_through_the_join(docs):
    a, b = (lm_values(lm.score(docs, head=h, carry=("doc_id",))) for h in (8, 1 << 20))
    assert {d: x[:2] for d, x in a.items()} == {d: x[:2] for d, x in b.items()}
    none = lm.score(docs, F.lit(False))
    assert none.count() == docs.count() and none.filter("n_known > 0 or score != 0").count() == 0  # base and model: the one unseen share
    assert lm.score(docs.limit(0)).count() == 0


def test_lm_blocks_agree_with_direct_scoring(docs, monkeypatch):
    """Dealt over many blocks and packs, every text has the score that its contexts have when each block is run by hand."""
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2000)
    rows = pairs(docs)
    got = {d: x[2] for d, x in lm_values(lm.score(docs, F.col("doc_id") % 10 != 0, carry=("doc_id",))).items()}
    import pyarrow as pa

    data, off = words.buffers(pa.array([t for _, t in rows], pa.string()))
    h, first = lm.tokens(data, off)
    row = np.repeat(np.arange(len(rows)), np.diff(first))
    learn = np.array([d % 10 != 0 for d, _ in rows])[row]
    keys, counts = np.unique(h[learn], return_counts=True)
    order = np.lexsort((keys, -counts))
    m = lm.Model(keys[order], counts[order], int(counts.sum()), len(keys), np.array([0.1]), -(-len(data) // 2000))
    ids = m.ids(h, m.find(h))
    a, b, c = m.history(ids, first)
    block = m.block(a, b, c, np.add.reduceat(words.mix(h), first[:-1])[row])
    assert m.hot and len(set(block)) > 5
    total = np.zeros(len(rows))
    for k in set(block.tolist()):
        at = np.flatnonzero(block == k)
        p = m.learn_and_score(a[at], b[at], c[at], ids[at], learn[at].astype(np.float32))
        np.add.at(total, row[at], p)  # an unseen token has all of its leaf's mass here: 0.1 of 0.1
    assert max(abs(total[i] - got[d]) / max(1, abs(total[i])) for i, (d, _) in enumerate(rows)) < 1e-3
    same = {}
    for d, t in rows:
        assert same.setdefault((t or "", d % 10 != 0), got[d]) == pytest.approx(got[d], rel=1e-3)


def lm_model(n=40, cells=(0.1,), **options):
    keys, counts = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(2 * n, n, -1)
    return lm.Model(keys, counts, int(counts.sum()), n, np.array(cells), **options)


def test_lm_is_a_distribution():
    """In any context the leaves' probabilities sum to 1, and a leaf's masses are its tokens' and one unseen one's."""
    m = lm_model(cells=(5.1, 0.1, 3.3, 2.0))
    r = np.random.default_rng(1)
    train = r.integers(0, 40, (500, 4))
    train[:250, 3] = train[:250, 0]
    leaves = 40 + 4
    ask = np.repeat(train[:1], leaves, 0)
    ask[:, 3] = np.r_[0:40, 40 + (np.arange(4) << (lm.TAIL - 2))]
    x = np.concatenate([train, ask]).astype(np.uint32)
    p = m.learn_and_score(x[:, 2], x[:, 1], x[:, 0], x[:, 3], np.r_[np.ones(500), np.zeros(leaves)].astype(np.float32))[500:]
    assert (10**p).sum() == pytest.approx(1, abs=1e-5)
    # with nothing to learn from, a leaf has its share of the mass
    p = m.learn_and_score(*(ask[:, k].astype(np.uint32) for k in (2, 1, 0, 3)), np.zeros(leaves, np.float32))
    mass = np.r_[m.counts + 0.1, m.cells]
    assert 10**p == pytest.approx(mass / mass.sum(), rel=1e-4)


@pytest.mark.parametrize("back", [1, 2, 3])
def test_lm_learns_from_each_token_back(back):
    """A token that only the one ``back`` before it tells is likelier after that one, for rare tokens as for frequent ones."""
    r = np.random.default_rng(2)
    for base in (0, 900):
        m = lm_model(1000, blocks=1)
        x = r.integers(0, 1000, (20_000, 4))
        x[:, 2] = r.integers(100, 120, len(x))
        x[:, 3 - back] = base + r.integers(0, 4, len(x))
        x[:, 3] = x[:, 3 - back]
        ask = np.array([[500, 600, 110, 0]] * 2)
        ask[:, 3 - back], ask[:, 3] = base, (base, base + 1)
        y = np.concatenate([x, ask]).astype(np.uint32)
        same, other = m.learn_and_score(y[:, 2], y[:, 1], y[:, 0], y[:, 3], np.r_[np.ones(len(x)), 0, 0].astype(np.float32))[-2:]
        assert same > other + 1


def test_lm_leaves_an_occurrence_out_of_its_own_rows():
    """What is seen once scores as if it were not learned from; what is seen twice does not."""
    m = lm_model(1000)
    r = np.random.default_rng(4)
    x = r.integers(0, 900, (300, 4)).astype(np.uint32)
    once = np.array([[950, 951, 952, 901]], np.uint32)

    def score(y, learn):
        return m.learn_and_score(y[:, 2], y[:, 1], y[:, 0], y[:, 3], learn.astype(np.float32))

    y = np.concatenate([x, once])
    a, b = score(y, np.ones(301))[-1], score(y, np.r_[np.ones(300), 0])[-1]
    assert a == pytest.approx(b, abs=1e-4)
    assert score(np.concatenate([x, once, once]), np.ones(302))[-1] > a + 1
    z = np.zeros((5, lm.BRANCH), np.float32)
    # a group of one, one of three of which two are learned from, and one that is not
    lm._step(z, None, np.array([0, 1, 4]), np.array([2, 5, 5, 5, 7]), np.array([1, 1, 1, 0, 0], np.float32), 0.3)
    assert (z[0] == 0).all() and (z[4] == 0).all()
    step = lambda n: (n - n / lm.BRANCH) / ((2 + 2 / lm.BRANCH) / 2 + 0.3)
    assert z[1:4, 5] == pytest.approx([step(1), step(1), step(2)], rel=1e-5)


def test_lm_rows_grow_and_hot_contexts_are_dealt():
    """No key of a block holds more than half a block's mean share, though one token is half of all."""
    r = np.random.default_rng(3)
    n, blocks = 200_000, 50
    ids = np.where(r.random(n) < 0.5, 0, r.integers(1, 5000, n)).astype(np.uint32)
    counts = np.bincount(ids)
    order = np.argsort(-counts, kind="stable")
    rank = np.argsort(order)
    keys = words.mix(np.arange(len(counts), dtype=np.uint64))
    m = lm.Model(keys, counts[order], n, len(counts), np.array([0.1]), blocks)
    first = np.arange(0, n + 1, 100)
    a, b, c = m.history(rank[ids].astype(np.uint32), first)
    block = m.block(a, b, c, np.repeat(words.mix(first[:-1].astype(np.uint64)), 100))
    assert np.bincount(block, minlength=blocks).max() < 2 * n / blocks
    cold = a >= m.hot
    at = {}
    for x, k in zip(a[cold].tolist(), block[cold].tolist(), strict=True):
        if x < len(counts):
            assert at.setdefault(x, k) == k  # all occurrences of a context token are in one block


# -- 4 decontamination
def test_op4_against_brute_force(docs, spark):
    src = [t for _, t in pairs(docs) if t and len(t.split()) > 40][:5]
    items = [(1, " ".join(src[0].split()[5:30])), (2, " ".join(src[1].split()[:10]).upper()), (10, "Two, words"), (11, "one"), (12, None), (13, " "), (2, " ".join(src[1].split()[:10])), (14, "never seen at all")]
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wins = defaultdict(set)
    for i, t in items:
        w = alnum(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1) if k else ():
            wins[tuple(w[a : a + k])].add(str(i))
    sizes = {len(w) for w in wins}
    got = {r["doc_id"]: r for r in decontam.op4(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, t in pairs(docs):
        w, hit, ids = alnum(t), set(), set()
        for k in sizes:
            for a in range(len(w) - k + 1):
                if (x := tuple(w[a : a + k])) in wins:
                    hit |= set(range(a, a + k))
                    ids |= wins[x]
        assert (got[d]["n_words"], got[d]["n_hit"], got[d]["n_items"], got[d]["items_sha256"], got[d]["contaminated"]) == (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    clean = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == docs.columns and clean.count() == sum(not r["contaminated"] for r in got.values())
    assert decontam.op4(docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0


# -- 5 WARC
def test_op5_round_trip(spark):
    rows = [(4, "http://a/\r\nb", "same"), (2, None, "same"), (7, "u", None), (8, "u", ""), (9, "v", "WARC/1.0\r\n\r\n\r\nWARC/1.0 é"), (2, "w", "other"), (None, "n", "alone")]
    got = warc.op5(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["payload_digest"]): r for r in got}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert by[(4, digest("same"))]["record_type"] == "revisit" and by[(4, digest("same"))]["refers_to"] == 2 and by[(4, digest("same"))]["payload_bytes"] == 4
    assert by[(2, digest("same"))]["record_type"] == "response" and by[(8, digest(""))]["refers_to"] == 7
    assert by[(9, digest(rows[4][2]))]["payload_bytes"] == len(rows[4][2].encode()) and by[(None, digest("alone"))]["record_type"] == "response"


def test_warc_assembly_and_damage(spark):
    rec = lambda i, kind, to="": f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{i}>\r\n{''.join(f'WARC-Concurrent-To: <{t}>' + chr(13) + chr(10) for t in to)}Content-Length: 1\r\n\r\nx\r\n\r\n".encode()
    data = rec("r", "response") + rec("q", "request", "r") + rec("m", "metadata", "q") + rec("s", "response", "t") + rec("t", "request") + rec("o", "metadata", "z") + b"WARC/1.0\r\nContent-Length: 99\r\n\r\nshort"
    rows = list(warc.parse(data, True))
    assert [r[1] for r in rows][-1] == "malformed" and len(rows) == 7 and list(warc.parse(b"", True)) == []
    df = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "record_id string, rec_type string, concurrent_to array<string>")
    got = {r["capture_id"]: r for r in warc.captures(df).collect()}
    assert set(got) == {"<r>", "<s>", "<z>"} and got["<r>"]["request"]["record_id"] == "<q>" and got["<r>"]["metadata"][0]["record_id"] == "<m>" and got["<s>"]["request"]["record_id"] == "<t>" and got["<z>"]["response"] is None and got["<z>"]["metadata"][0]["record_id"] == "<o>"


# -- 6 suffixes
@pytest.mark.parametrize("length", [400, 60])
def test_op6_against_brute_force(docs, length):
    enc = {d: (t or "").encode() for d, t in pairs(docs)}
    seen = Counter(b[i : i + length] for b in enc.values() for i in range(len(b) - length + 1))
    got = {r["_c"]["doc_id"]: tuple(r)[1:] for r in suffixes._apply(docs, "text", ["doc_id"], length, suffixes._Digest()).collect()}
    for d, b in enc.items():
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert got[d] == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())


def test_cover_and_dedup(docs):
    for length in (26, 60, 400, 2000):
        v, d = suffixes.cover(length)
        assert len({(a - b) % v for a in d for b in d}) == v and v <= max(1, length // 2)
    out = suffixes.dedup(docs)
    assert out.columns == docs.columns and out.count() == docs.count() and suffixes.dedup(docs.limit(0)).count() == 0
    assert out.filter("text is null").count() == docs.filter("text is null").count()


# -- 7 Jaccard
def brute_jaccard(rows, k=5):
    sets = {}
    for d, t in rows:
        w = spaced(t)
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


@pytest.mark.parametrize("cost", [8.0, 1e9, 0.0])
def test_op7_against_brute_force(docs, cost, monkeypatch):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs, verify_cost=cost).collect()}
    assert got == brute_jaccard(pairs(docs))


def test_op7_small_sets(spark):
    r = random.Random(5)
    rows = []
    for i in range(150):
        w = [f"w{j}" for j in range(r.randint(5, 24))]
        if r.random() < 0.7:
            w[r.randrange(len(w))] = r.choice("pq")
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.op7(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_jaccard(rows)
    assert jaccard.op7(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# -- 8 SpotSigs
def spot_print(t):
    """Word by word: each anchor that starts a run of anchors, with the content words that follow it."""
    ws = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    anchors, chains = set(spots.ANCHORS), []
    for i, w in enumerate(ws):
        if w in anchors and i + 1 < len(ws) and ws[i + 1] not in anchors:
            chains.append(" ".join([x for x in ws[i + 1 :] if x not in anchors][: spots.CHAIN]))
    return {zlib.crc32(c.encode()) for c in chains or ([" ".join(ws)] if ws else [])}


def test_op8(docs):
    rows = sorted(((d, t or "") for d, t in pairs(docs)), reverse=True)
    got = {r["doc_id"]: r for r in spots.op8(docs).collect()}
    prints = {}
    for i, (d, t) in enumerate(rows):
        nxt = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        g = got[d]
        assert g["n_chars"] == len(t) and g["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert prints.setdefault(t, g["fingerprint"]) == g["fingerprint"] and 0 <= g["near_edited"] <= 1
        if nxt == t:
            assert g["near_next"] == 1.0
    plan = spots.op8(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for i, (d, t) in enumerate(rows):
        nxt, g = rows[(i + 1) % len(rows)][1], got[d]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        a, b, c = spot_print(t), spot_print(edited), spot_print(nxt)
        near = [1.0 if x == y else len(x & y) / len(x | y) for x, y in ((a, b), (a, c))]
        assert (g["fingerprint"], g["edited_fingerprint"]) == ("".join(f"{v:08x}" for v in sorted(a)), "".join(f"{v:08x}" for v in sorted(b)))
        assert [g["near_edited"], g["near_next"]] == pytest.approx(near)


def test_op8_edges(spark):
    schema = "doc_id long, text string, next_text string"
    assert spots.op8(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "the cat sat on the mat", "x"), (3, "the dog", None), (3, "the dog", None), (3, None, "y"), (10**15, "of mice and men", "z"), (-(10**15), "", None)]
    got = spots.op8(spark.createDataFrame(rows, schema)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows) and all(0 <= r["near_next"] <= 1 for r in got)
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 3}) == 2


def test_near_pairs_prune(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1], [1, 2]), ([], [])], "a array<long>, b array<long>")
    assert [(r["a"], round(r["near"], 3)) for r in spots.near_pairs(df, "a", "b").collect()] == [([1, 2, 3, 4], 0.8), ([], 1.0)]


# -- 9 quality
def test_trees_learn_and_bounds():
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    m = quality.fit_trees(x[:2000], y[:2000])
    assert ((m.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert quality.fit_trees(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert quality.fit_trees(np.zeros((4, 3)), np.ones(4)).score(np.zeros((1, 3)))[0] > 0.99


def test_op9(docs, spark, sf):
    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.op9(real, labels).join(labels, "doc_id")
    assert out.filter("quality = predicted").count() >= 0.9 * out.count()
    edge = quality.op9(docs, spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0)], "doc_id long, quality int"))
    assert edge.count() == docs.count() and edge.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(docs, quality.fit(docs, labels.limit(0))).columns[-2:] == ["score", "predicted"]


# -- 10 chats
def test_chat_round_trip_and_machine(spark):
    bad = "a <| b <\\| c <\\\\|im_end|>\n<|im_start|>user\n<x"
    rows = [(1, 0, "system", bad), (1, 1, "user", None), (1, 2, "assistant", bad), (2, 1, "assistant", "late"), (2, 0, "user", "first"), (3, 0, "assistant", "alone"), (None, 0, None, "x"), (4, 0, "we\nird%0A", "x")]
    out = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("segments"))).collect()}
    for r in out.values():
        assert r["back"] == r["turns"] and "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert out[1]["loss"] == bad and out[1]["valid"] and out[2]["valid"] and not out[3]["valid"] and out[3]["bad_turn"] == 0 and out[2]["loss"] == "late"
    assert out[4]["turns"][0]["role"] == "we\nird%0A" and not out[None]["valid"]


# -- plain versions of the learned operators -----------------------------------------------------------------------
def plain_features(t):
    """The statistics of one text, one at a time."""
    b = (t or "").encode()
    cls = [int(quality._CLASS[x]) for x in b]
    ws = re.findall(rb"[^\x20\x09-\x0D]+", low(t).encode()) if t else []
    raw = re.findall(rb"[^\x20\x09-\x0D]+", b)
    lines = [x for x in re.findall(rb"[^\n]+", low(t).encode())]
    n, one = len(ws), max(len(ws), 1)
    length = [len(w) for w in ws]
    letters = sum(c in (1, 2) for c in cls)
    mean = sum(length) / one
    # words and lines are looked at in lower case, upper letters in the text itself
    last, first = [int(quality._CLASS[w[-1]]) for w in raw], [int(quality._CLASS[w[0]]) for w in raw]
    grams = {tuple(ws[i : i + 3]) for i in range(n - 2)}
    out = [cls.count(c) / max(len(b), 1) for c in range(len(quality.CLASSES))]
    return out + [
        math.log1p(len(b)), math.log1p(n), mean, math.sqrt(max(sum(x * x for x in length) / one - mean**2, 0)), sum(x <= 3 for x in length) / one, cls.count(2) / max(letters, 1),
        len(set(ws)) / one, sum(x == y for x, y in zip(ws, ws[1:], strict=False)) / one, sum(c in (8, 10) for c in last) / one, sum(c == 2 for c in first) / one,
        len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), len(grams) / max(n - 2, 1), math.log1p(len(lines)), n / (cls.count(6) + 1),
    ]


def test_quality_against_plain_scoring(docs):
    import pyarrow as pa

    ts = [t for _, t in pairs(docs)] + ["A.\nb!\nb!\nA.", "One two. One two! THREE #"]
    x = quality.features(pa.array(ts, pa.string()))
    for got, t in zip(x, ts, strict=True):
        assert got.tolist() == pytest.approx(plain_features(t), abs=1e-9)
    r = np.random.default_rng(3)
    m = quality.fit_trees(x, (x[:, 16] + r.normal(size=len(x)) > np.median(x[:, 16])).astype(float), trees=30)
    for row, score in zip(x, m.score(x), strict=True):
        total = m.base
        for at in m.roots:
            while m.feature[at] >= 0:
                at = m.left[at] + (row[m.feature[at]] > m.threshold[at])
            total += m.value[at]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


def test_language_against_plain_scoring(docs, spark):
    r = random.Random(8)
    train = [(lang, " ".join(r.choices(ws, k=12))) for lang, ws in (("aa", WORDS[:20]), ("bb", WORDS[15:])) for _ in range(40)]
    m = langid.fit(spark.createDataFrame(train, "lang string, text string"))
    tables = {o: {int(k): row for k, row in zip(keys, rows, strict=True)} for o, (keys, rows) in m.tables.items()}

    def digest(raw, plus=0):
        p = words.prefix_hash(np.frombuffer(raw, np.uint8))
        return int(words.mix(p[-1:] + np.uint64(plus))[0])

    def plain(t):
        total, some = np.zeros(len(m.langs)), False
        for w in re.findall(r"[^\x00-\x60\x7B-\x7F]+", t.lower()):
            some = some or any(c.isalpha() for c in w)
            if (row := tables[0].get(digest(w.encode()))) is not None:
                total += row
                continue
            s = f" {w} "
            for n in langid.ORDERS:
                grams = [s[i : i + n] for i in range(len(s) - n + 1)]
                known = [tables[n][h] for g in grams if not (n == 1 and g == " ") for h in [digest(g.encode(), n)] if h in tables[n]]
                if known:
                    total += np.mean(known, 0)
                    break
        e = np.exp(total - total.max())
        return (m.langs[int(total.argmax())], float((e / e.sum()).max())) if some else ("und", 0.0)

    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "kramitu lopes, vomi 12 xyz"), (-2, "éra ßlin")], "doc_id long, text string"))
    for x in langid.predict(d, m).collect():
        assert (x["lang_pred"], pytest.approx(x["score"], abs=1e-6)) == plain(x["text"] or "")


# -- registered SQL, pipeline
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    r = c.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    at = [names.index(x) for x in cols]
    assert sorted(str(tuple(x[k] for k in cols)) for x in df.collect()) == sorted(str(tuple(x[i] for i in at)) for x in r.fetchall())


def test_pipeline_stages_take_effect(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = p.quality_stage(spark, docs, sf)
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    second = p.staged(p.near_duplicate_stage(spark, first, sf), "t")
    want = {d for d, (n, c) in brute_jaccard(pairs(first)).items() if d == c}
    assert {r[0] for r in second.select("doc_id").collect()} == want
    third = p.staged(p.repeated_passage_stage(spark, second, sf), "t")
    assert {r["doc_id"]: r["text"] for r in third.collect()} == without_passages({r["doc_id"]: r["text"] for r in second.collect()})
    fourth = p.staged(p.benchmark_stage(spark, third, sf), "t")
    assert third.columns == fourth.columns == docs.columns and fourth.count() <= third.count() <= second.count()
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    wins = {tuple(w[a : a + min(10, len(w))]) for (t,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect() for w in [alnum(t)] for a in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in wins}
    hit = lambda w: any(tuple(w[a : a + k]) in wins for k in sizes for a in range(len(w) - k + 1))
    assert {r["doc_id"] for r in fourth.collect()} == {r["doc_id"] for r in third.collect() if not hit(alnum(r["text"]))}
    c = duckdb.connect()
    c.register("documents", fourth.toPandas())
    got = p.mixture_stage(spark, fourth, sf)
    r = c.execute(queries.mixing.SQL)
    at = [[d[0] for d in r.description].index(x) for x in got.columns]
    assert Counter(str(tuple(x)) for x in got.collect()) == Counter(str(tuple(x[i] for i in at)) for x in r.fetchall())


def without_passages(texts, length=150, words_least=51, whole=400):
    """The stage by brute force: starts of strings that occur elsewhere, their runs, and what is cut."""
    enc = {d: (t or "").encode() for d, t in texts.items()}
    seen = Counter(b[i : i + length] for b in enc.values() for i in range(len(b) - length + 1))
    out = {}
    for d, b in enc.items():
        gone, starts = bytearray(len(b)), [i for i in range(len(b) - length + 1) if seen[b[i : i + length]] > 1]
        runs = []
        for i in starts:
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        for i, j in runs:
            end = j - 1 + length
            n = sum(m.start() >= i and m.end() <= end for m in re.finditer(rb"[^\x20\x09-\x0D]+", b))
            if n >= words_least or end - i >= whole:
                gone[i:end] = b"\1" * (end - i)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        if texts[d] is None or not any(gone) or re.search(r"[^\x20\x09-\x0D]", left):
            out[d] = texts[d] if texts[d] is None else left
    return out


def test_pipeline_keeps_rows_without_or_with_repeated_ids(spark):
    import corpus_pipeline as p

    r = random.Random(5)
    a, b, c, d, e = (" ".join(r.choices(WORDS, k=40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, ""), (None, None), (7, c), (7, d), (8, d), (9, e), (9, e), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in p.near_duplicate_stage(spark, docs, "").collect()]
    assert Counter(got) == Counter([(None, a), (None, b), (None, ""), (None, None), (7, c), (7, d), (9, e), (3, "")])
    # nothing is cut from a text that was blank on input, so it stays
    blank = spark.createDataFrame([(1, ""), (2, " \n"), (3, None), (4, a)], "doc_id long, text string")
    assert sorted(x[0] for x in p.repeated_passage_stage(spark, blank, "").collect()) == [1, 2, 3, 4]


def test_pipeline_cuts_passages_of_51_words(spark):
    import corpus_pipeline as p

    r = random.Random(6)
    passage, short = (" ".join(f"{r.choice(WORDS)}{r.randrange(10)}" for _ in range(n)) for n in (51, 40))
    assert 200 < len(passage) < 350 and len(short) > 150
    other = [" ".join(f"{r.choice(WORDS)}{r.randrange(1000)}" for _ in range(30)) for _ in range(6)]
    texts = [f"A1 {other[0]} {passage} {other[1]}", f"B2 {other[2]} {passage} {other[3]}", f"C3 {other[4]} {short} D4", f"E5 {short} {other[5]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["text"] for x in p.repeated_passage_stage(spark, docs, "").collect()}
    assert [passage[5:-5] in got[i] for i in (0, 1)] == [False, False] and other[0] in got[0] and other[3] in got[1]
    assert got[2] == texts[2] and got[3] == texts[3]


def test_pipeline_leaves_no_spent_tables_and_sorts_the_cover_sample_in_passes(spark, monkeypatch):
    import corpus_pipeline as p
    from ashlar.llm import store

    def left(names, frame):
        paths = [spark._jvm.org.apache.hadoop.fs.Path(x._ashlar_path) for n, x in names if n in frame]
        return [x.getFileSystem(spark._jsc.hadoopConfiguration()).exists(x) for x in paths]

    made = []

    def staged(df, name, codec="zstd"):
        made.append((name, store.staged(df, name, codec)))
        return made[-1][1]

    for module in (p, jaccard, suffixes):
        monkeypatch.setattr(module, "staged", staged)
    r = random.Random(7)
    texts = [" ".join(f"{r.choice(WORDS)}{r.randrange(10**6)}" for _ in range(400)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, *texts[:5]])), "doc_id long, text string")
    out = p.near_duplicate_stage(spark, docs, "")
    tables = left(made, {"signatures", "names"})
    assert len(tables) == 2 and not any(tables)
    assert sorted(map(tuple, out.collect())) == sorted(enumerate(texts))
    made.clear()
    assert sorted(map(tuple, p.repeated_passage_stage(spark, out, "").collect())) == sorted(enumerate(texts))
    sizes = [8 * x.agg(F.sum("n")).first()[0] for n, x in made if n == "cover-ranks"]
    size = sum(len(t) for t in texts)
    assert sum(sizes) > size > max(sizes)


def test_release_frees_the_shuffle_of_the_last_query(spark):
    import time

    from ashlar.llm import store

    def shuffles():
        time.sleep(0.5)
        return spark._jsc.sc().env().mapOutputTracker().shuffleStatuses().size()

    def same(t):
        return t

    for _ in range(3):
        store.release(spark)
    before = shuffles()
    for _ in range(2):
        out = store.staged(spark.range(1000).selectExpr("id", "id % 7 k").groupBy("k").applyInArrow(same, "id long, k long"), "t")
        store.release(spark)
        assert shuffles() <= before
    assert out.count() == 1000
