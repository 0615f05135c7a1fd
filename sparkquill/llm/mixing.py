"""Operator 2, mixing sources to target weights: hierarchical budgets over a domain-language-source tree.

Weights pass from the root to the leaves. What a child cannot supply goes to its siblings first,
and to the siblings of an ancestor only when these are full. Each leaf then gives whole epochs and
a token-prefix of one more, in an order that the seed and the epoch's number decide.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, stage

#: Parts of a leaf's order, and how many of them are a range. Only the part in which the prefix ends is sorted.
PARTS, RANGE = 4096, 64
#: The tree is a setting that the driver holds; more leaves than this are an error.
MAX_LEAVES = 100_000
PATH = ["domain", "language", "origin"]


def share_out(budget: int, nodes: list[tuple[object, Fraction, int]]) -> dict:
    """Divides budget among (name, weight, capacity) by weight; what one cannot take the others do. Whole tokens, largest remainders first."""
    given, left, free = {}, min(budget, sum(n[2] for n in nodes)), [n for n in nodes if n[1] > 0 and n[2] > 0]
    spare = [n for n in nodes if not (n[1] > 0 and n[2] > 0)]
    while free:
        total = sum(n[1] for n in free)
        full = [n for n in free if left * n[1] / total >= n[2]]
        if not full:
            exact = {n[0]: left * n[1] / total for n in free}
            given |= {k: int(v) for k, v in exact.items()}
            rest = left - sum(int(v) for v in exact.values())
            for k in sorted(exact, key=lambda k: (int(exact[k]) - exact[k], str(k)))[:rest]:
                given[k] += 1
            break
        for n in full:
            given[n[0]] = n[2]
            left -= n[2]
        free = [n for n in free if n not in full]
    return {n[0]: 0 for n in spare} | given


def budgets(leaves: dict[tuple, int], weight: Callable[[tuple], float], total: int, max_epochs: int) -> dict[tuple, int]:
    """Tokens for each leaf. leaves: path to tokens there are; weight: of a node's path among its siblings."""
    below = defaultdict(set)
    capacity = defaultdict(int)
    for path, tokens in leaves.items():
        for i in range(len(path) + 1):
            capacity[path[:i]] += tokens * max_epochs
            if i < len(path):
                below[path[:i]].add(path[: i + 1])
    given, todo = {(): min(total, capacity[()])}, [()]
    for node in todo:
        kids = sorted(below[node], key=str)
        given |= share_out(given[node], [(k, Fraction(weight(k)).limit_denominator(10**6), capacity[k]) for k in kids]) if kids else {}
        todo += kids
    return {p: given[p] for p in leaves}


def order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), epoch.cast("int"), key)


def cuts(docs: DataFrame, path: list[Column], tokens: Column, weight: Callable[[tuple], float], total: int | float, max_epochs: int, seed: int, key: Column) -> DataFrame:
    """One row for each leaf with a budget: its path, whole (epochs taken whole), last_hash and last_key.

    Of epoch number whole are taken the rows up to (last_hash, last_key) in its order, none if last_hash
    is null. Only keys, paths and token counts are looked at, and the result is as small as the tree.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = [F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for c, n in zip(path, PATH)]
    rows = scratch.stage(docs.select(key.alias("key"), *names, F.coalesce(tokens.cast("long"), F.lit(0).cast("long")).alias("n_tokens")), "mix-rows")
    sums = rows.groupBy(*PATH).agg(F.sum("n_tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(sums) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    have = {tuple(r[:3]): r[3] for r in sums}
    wanted = int(Fraction(total) * sum(have.values())) if isinstance(total, float) else int(total)
    plan = [(*p, b // have[p], b % have[p]) for p, b in budgets(have, weight, wanted, max_epochs).items() if b > 0]
    plan = F.broadcast(spark.createDataFrame(plan, ", ".join(f"{n} string" for n in PATH) + ", whole long, rest long"))
    last = rows.join(plan.where("rest > 0"), PATH).withColumn("order_hash", order_hash(seed, F.col("whole"), F.col("key")))
    last = last.withColumn("part", F.expr(f"int((order_hash div {2**64 // PARTS}) + if(order_hash < 0 and order_hash % {2**64 // PARTS} != 0, -1, 0))"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    parts = last.groupBy(*PATH, "rest", "part").agg(F.sum("n_tokens").alias("n")).withColumn("range", F.expr(f"part div {RANGE} - if(part % {RANGE} < 0, 1, 0)"))
    # two levels, so that no task orders all parts of a leaf
    ranges = parts.groupBy(*PATH, "range").agg(F.sum("n").alias("in_range"))
    ranges = ranges.select(*PATH, "range", (F.sum("in_range").over(upto(*PATH).orderBy("range")) - F.col("in_range")).alias("base"))
    parts = parts.withColumn("inside", F.sum("n").over(upto(*PATH, "range").orderBy("part")) - F.col("n")).join(ranges, [*PATH, "range"])
    parts = parts.withColumn("before", F.col("base") + F.col("inside"))
    # the last part with a row that starts before the budget ends, and of it the last such row
    edge = parts.where("before < rest").groupBy(*PATH).agg(F.max_by(F.struct("part", "before"), "part").alias("e")).select(*PATH, "e.*")
    inside = last.join(F.broadcast(edge), [*PATH, "part"]).groupBy(*PATH, "rest", "before", "order_hash", "key").agg(F.sum("n_tokens").alias("n"))
    inside = inside.withColumn("at", F.col("before") + F.sum("n").over(upto(*PATH).orderBy("order_hash", "key")) - F.col("n")).where("at < rest")
    found = inside.groupBy(*PATH).agg(F.max(F.struct("order_hash", "key")).alias("c")).select(*PATH, F.col("c.order_hash").alias("last_hash"), F.col("c.key").alias("last_key"))
    out = stage(plan.drop("rest").join(found, PATH, "left"), "mix-cuts")
    scratch.drop("mix-rows")
    return out


def mix(docs: DataFrame, path: list[Column], tokens: Column, weight: Callable[[tuple], float], total: int | float, max_epochs: int = 4, seed: int = 7, key: Column | str = "doc_id", out: tuple[str, ...] = ("domain", "language", "origin", "n_tokens", "epoch", "order_hash")) -> DataFrame:
    """docs, each row once for each epoch that takes it, with the columns out: its path and tokens, the epoch and its place in the order.

    total: tokens wanted, or if a float that share of the tokens there are. Documents are neither
    shuffled nor joined with one another: they are filtered in place by the table of cuts, one row a
    leaf, which is broadcast (MAX_LEAVES rows at most). A leaf's prefix holds each document that starts
    before its budget ends, so it exceeds it by a document at most.
    Nulls: a null step of the path is 'unknown'; a null token count is 0. Documents without tokens
    are taken with the epochs that reach them. Rows that repeat a key are in or out together, and each
    is given once an epoch. Columns of the names out already there are replaced, others stay as they
    are. An empty table or a budget of 0 gives no rows.
    To find a leaf's cut its ranges, the parts of a range and the rows of one part are each ordered in a task.
    """
    key = (F.col(key) if isinstance(key, str) else key).cast("long")
    counted = F.coalesce(tokens.cast("long"), F.lit(0).cast("long"))
    table = F.broadcast(cuts(docs, path, tokens, weight, total, max_epochs, seed, key))
    rows = docs.select(F.struct(*(F.col(c) for c in docs.columns if c not in out)).alias("row"), key.alias("key"), counted.alias("n_tokens"), *(F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for c, n in zip(path, PATH)))
    rows = rows.join(table, PATH)
    at = order_hash(seed, F.col("whole"), F.col("key"))
    # in the order of rows nulls come first, and only one key has a given hash but by chance
    reached = (at < F.col("last_hash")) | ((at == F.col("last_hash")) & (F.col("key").isNull() | (F.col("key") <= F.col("last_key"))))
    epochs = F.concat(F.expr("if(whole > 0, sequence(0, int(whole) - 1), array())").cast("array<int>"), F.when(reached, F.array(F.col("whole").cast("int"))).otherwise(F.array().cast("array<int>")))
    rows = rows.withColumn("epoch", F.explode(epochs))
    return rows.select("row.*", *(F.col(n).alias(o) for n, o in zip([*PATH, "n_tokens", "epoch"], out)), order_hash(seed, F.col("epoch"), F.col("key")).alias(out[5]))
