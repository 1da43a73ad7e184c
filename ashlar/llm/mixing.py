"""Mixing sources to target weights by hierarchical budgeting.

The levels (domain, language, source) form a tree; its leaves are what occurs in the corpus. The budget of tokens goes
down the tree: a node shares its budget among its children in proportion to their weights, no child taking more than
its leaves can give in ``max_epochs`` passes; what such a child can't take goes to its siblings by weight, and only what
no sibling can take stays unspent above, where the parent's siblings have had the same offer. At each node the shares
are min(capacity, level * weight) for the one level that spends the budget, found in closed form from running sums over
the children sorted by capacity / weight.

A leaf then takes whole epochs while its budget lasts, and of the next epoch the shortest prefix, in an order seeded by
epoch and document, that reaches the budget (the last document counts with its remaining tokens, ``tokens_taken``).
Orders are md5 values; prefixes are found over slices of the order that hold about ``slice_docs`` documents, so the one
slice in which a prefix ends is all that is ever sorted, however large the leaf.

Weights are integers by node name; nodes without one weigh ``default_weight``; a weight of 0 or less takes nothing.
Cases: null levels are a node of their own (name null, weighing the default); null or wordless texts have no tokens and
are never taken; repeated rows count repeatedly and are taken in either order; an empty corpus gives no rows; budgets
are rounded down at every node. Extra columns are ignored, clashing names too.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ashlar.llm.store import staged

_WORD = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def _weight(name: Column, weights: dict[str, int], default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    table = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (k, int(w))])
    return F.coalesce(F.try_element_at(table, F.coalesce(name, F.lit("\x00"))), F.lit(default)).cast("long")


def _share(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """``nodes`` (cap, weight, budget of the parent) with ``got``, the node's own budget."""
    by = Window.partitionBy(*parent).orderBy((F.col("cap") / F.greatest("weight", F.lit(1))), "weight", "cap") if parent else Window.orderBy((F.col("cap") / F.greatest("weight", F.lit(1))), "weight", "cap")
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    n = nodes.filter("weight > 0").withColumn("_c", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = n.withColumn("_w", F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")).withColumn("_all", F.sum("weight").over(whole))
    # this child and all before it saturate if what the earlier ones leave, shared by weight, is at least its capacity
    left = F.col("budget") - (F.col("_c") - F.col("cap"))
    fits = left.cast("double") * F.col("weight") >= F.col("cap").cast("double") * (F.col("_all") - F.col("_w"))
    n = n.withColumn("_full", F.min(fits.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) == 1)
    spent = F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(whole)
    open_ = F.sum(F.when(~F.col("_full"), F.col("weight")).otherwise(0)).over(whole)
    part = F.floor((F.col("budget") - spent).cast("double") * F.col("weight") / open_)
    return n.withColumn("got", F.when(F.col("_full"), F.col("cap")).otherwise(F.least(F.col("cap"), part)).cast("long")).drop("_c", "_w", "_all", "_full")


def _with(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on equal keys, null equal to null; the keys come from the left."""
    r = right.select(*[F.col(c).alias("_r_" + c) if c in keys else F.col(c) for c in right.columns])
    cond = [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys]
    return left.join(r, cond).drop(*["_r_" + k for k in keys])


def budgets(leaves: DataFrame, levels: list[str], total: Column, weights: dict[str, dict[str, int]], max_epochs: int, default_weight: int = 1) -> DataFrame:
    """Leaves (levels, n_docs, n_tokens) with ``budget``."""
    down = leaves.withColumn("cap", F.col("n_tokens") * max_epochs)
    for level in levels:  # what a node without weight holds is no capacity of the nodes above it
        down = down.filter(_weight(F.col(level), weights.get(level, {}), default_weight) > 0)
    have: DataFrame | None = None
    for i, level in enumerate(levels):
        parent, keys = levels[:i], levels[: i + 1]
        nodes = down.groupBy(*keys).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(level), weights.get(level, {}), default_weight))
        if have is None:
            nodes = nodes.withColumn("budget", total)
        else:
            nodes = _with(nodes, have, parent)
        have = _share(nodes, parent).select(*keys, F.col("got").alias("budget"))
    return _with(leaves, have, levels)


def mix(docs: DataFrame, levels: dict[str, Column], share: float = 0.5, weights: dict[str, dict[str, int]] | None = None, text: str = "text", key: str = "doc_id", max_epochs: int = 3, seed: int = 17, slice_docs: int = 512, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and epoch taken: key, levels, carry, n_tokens, epoch, tokens_taken.

    ``levels`` names the columns of the tree from the root down; the budget is ``share`` of the corpus' tokens.
    """
    names = list(levels)
    d = docs.select(F.col(key).alias("_k"), *[c.cast("string").alias(n) for n, c in levels.items()], tokens(F.col(text)).alias("n_tokens"), F.struct(F.lit(0).alias("_"), *[F.col(c) for c in carry]).alias("_c"))
    d = staged(d.filter("n_tokens > 0"), "tokens")
    leaves = d.groupBy(*names).agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    total = leaves.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = staged(budgets(leaves, names, F.lit(int(total * share)).cast("long"), weights or {}, max_epochs), "budgets")
    at = leaves.select(*names, F.floor(F.col("budget") / F.col("n_tokens")).cast("int").alias("full"), (F.col("budget") % F.col("n_tokens")).alias("rest"), F.ceil(F.col("n_docs") / slice_docs).alias("slices"))
    d = _with(d, at, names)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("_k").cast("string"), F.lit(""))).cast("binary"))
    d = d.withColumn("_o", order)
    d = d.withColumn("_s", F.floor(F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") * F.col("slices") / float(1 << 32)))
    sums = d.filter("rest > 0").groupBy(*names, "_s", "rest").agg(F.sum("n_tokens").alias("t"))
    run = F.sum("t").over(Window.partitionBy(*names).orderBy("_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = sums.withColumn("before", run - F.col("t")).filter("before < rest and before + t >= rest").select(*names, F.col("_s").alias("edge"), "before")
    cut = _with(d.filter("rest > 0"), edge, names)
    inside = cut.filter("_s < edge").withColumn("tokens_taken", F.col("n_tokens"))
    w = Window.partitionBy(*names, "_s").orderBy("_o", "_k", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = cut.filter("_s = edge").withColumn("_b", F.col("before") + F.sum("n_tokens").over(w) - F.col("n_tokens")).filter("_b < rest").withColumn("tokens_taken", F.least("n_tokens", F.col("rest") - F.col("_b")))
    part = inside.unionByName(last.drop("_b")).withColumn("epoch", F.col("full"))
    whole = d.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("full") - 1))).withColumn("tokens_taken", F.col("n_tokens"))
    cols = [F.col("_k").alias(key), *names, *[F.col(f"_c.{c}").alias(c) for c in carry], "n_tokens", "epoch", F.col("tokens_taken").cast("long").alias("tokens_taken")]
    return whole.select(*cols).unionByName(part.select(*cols))


#: production parameters: three domains told by source, with weights at every level
DOMAIN = "CASE WHEN source IN ('src0', 'src1', 'src2', 'src3', 'src4') THEN 'web' WHEN source IN ('src5', 'src6', 'src7', 'src8', 'src9') THEN 'books' ELSE 'forums' END"
WEIGHTS = {"domain": {"web": 5, "books": 3, "forums": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2, "src7": 3}}


def levels() -> dict[str, Column]:
    return {"domain": F.expr(DOMAIN), "lang": F.col("lang"), "source": F.col("source")}


def op2(docs: DataFrame) -> DataFrame:
    return mix(docs, levels(), weights=WEIGHTS)


def _sql() -> str:
    def weight(level: str) -> str:
        return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"

    out = f"""WITH d AS (SELECT doc_id, {DOMAIN} AS domain, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL),
t AS (SELECT * FROM d WHERE n_tokens > 0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS n_tokens, 3 * sum(n_tokens)::BIGINT AS cap FROM t GROUP BY ALL)"""
    keys: list[str] = []
    for i, level in enumerate(("domain", "lang", "source")):
        parent = keys[:]
        keys.append(level)
        k = ", ".join(keys)
        by = f"PARTITION BY {', '.join(parent)} " if parent else ""
        budget = "(SELECT CAST(floor(sum(n_tokens) * 0.5) AS BIGINT) FROM t)" if not parent else f"b{i - 1}.got"
        join = "" if not parent else f" JOIN b{i - 1} ON " + " AND ".join(f"n.{p} IS NOT DISTINCT FROM b{i - 1}.{p}" for p in parent)
        run = f"OVER ({by}ORDER BY cap::DOUBLE / weight, weight, cap ROWS UNBOUNDED PRECEDING)"
        whole = f"OVER ({by})"
        out += f""",
n{i} AS (SELECT {", ".join("n." + x for x in keys)}, n.cap, n.weight, {budget} AS budget FROM (SELECT {k}, sum(cap)::BIGINT AS cap, {weight(level)} AS weight FROM leaves GROUP BY {k}) n{join}),
r{i} AS (SELECT *, sum(cap) {run} AS c, sum(weight) {run} - weight AS w, sum(weight) {whole} AS al FROM n{i}),
f{i} AS (SELECT *, min(CASE WHEN (budget - (c - cap))::DOUBLE * weight >= cap::DOUBLE * (al - w) THEN 1 ELSE 0 END) {run} = 1 AS fu FROM r{i}),
s{i} AS (SELECT *, sum(CASE WHEN fu THEN cap ELSE 0 END) {whole} AS spent, sum(CASE WHEN fu THEN 0 ELSE weight END) {whole} AS op FROM f{i}),
b{i} AS (SELECT {k}, CAST(CASE WHEN fu THEN cap ELSE least(cap, floor((budget - spent)::DOUBLE * weight / op)) END AS BIGINT) AS got FROM s{i})"""
    return out + """,
a AS (SELECT t.*, l.n_tokens AS av, b2.got AS budget, b2.got // l.n_tokens AS fullp, b2.got % l.n_tokens AS rest FROM t
  JOIN leaves l ON t.domain = l.domain AND t.lang IS NOT DISTINCT FROM l.lang AND t.source IS NOT DISTINCT FROM l.source
  JOIN b2 ON t.domain = b2.domain AND t.lang IS NOT DISTINCT FROM b2.lang AND t.source IS NOT DISTINCT FROM b2.source),
o AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || fullp || ':' || doc_id), doc_id ROWS UNBOUNDED PRECEDING) - n_tokens AS before FROM a),
w AS (SELECT *, unnest(range(fullp)) AS e FROM a WHERE fullp > 0)
SELECT doc_id, domain, lang, source, n_tokens, e::INT AS epoch, n_tokens AS tokens_taken FROM w
UNION ALL SELECT doc_id, domain, lang, source, n_tokens, fullp::INT AS epoch, least(n_tokens, rest - before)::BIGINT AS tokens_taken FROM o WHERE rest > 0 AND before < rest
"""


SQL = _sql()
