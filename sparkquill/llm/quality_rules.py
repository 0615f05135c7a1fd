"""Operator 9, quality rules: a learned decision list over statistics of whole texts, all native.

Sequential covering on a bounded sample of labelled rows: a rule grows by the threshold condition
with the best information gain on two thirds of the sample, is pruned on the last third, and the
rows that it covers leave before the next one grows. The list becomes one conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that rules are learned from, at most; those with the smallest hashes of doc_id.
MAX_LABELLED = 20_000
#: Thresholds tried for a statistic: its quantiles in the sample.
QUANTILES = 24

SPACE = r"[\x20\x09-\x0D]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistics in thousandths, so that rules compare whole numbers.
FEATURES = {
    "n_words": "n_words",
    "word_length": "1000 * word_chars div greatest(n_words, 1)",
    "symbols": "1000 * n_symbols div greatest(word_chars, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_lines, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    "capitals": "1000 * n_capitals div greatest(word_chars, 1)",
    "marks": "1000 * n_marks div greatest(word_chars, 1)",
}


def without(column: Column, characters: str) -> Column:
    """Number of a text's characters that are one of these."""
    return F.length(column) - F.length(F.translate(column, characters, ""))


def fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with new columns behind a generator, so that no later filter or projection repeats their expressions.

    An expression over arrays that is moved into a lambda would be worked out again for each entry.
    """
    return df.drop(*columns).select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals and n_marks (long).

    Null and empty texts have 0 of all. Columns of these names already there are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    out = fixed(docs, {"__hash": F.transform(F.filter(F.split(t, SPACE, -1), lambda w: w != ""), lambda w: F.xxhash64(w)), "__lines": lines})
    out = fixed(out, {"__n": F.size("__hash"), "n_lines": F.size("__lines").cast("long"), "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")})
    # three-word windows with their places, sorted: equal ones become neighbours
    window = F.expr("if(__n < 3, array(), sort_array(transform(sequence(0, __n - 3), i -> struct(xxhash64(get(__hash, i), get(__hash, i + 1), get(__hash, i + 2)) as h, i as p))))")
    out = fixed(out, {"__tri": window.cast("array<struct<h:bigint,p:int>>")})
    twice = F.expr("if(size(__tri) < 2, array(), sort_array(filter(transform(sequence(0, size(__tri) - 1), i -> if(get(__tri, i).h <=> get(__tri, i - 1).h or get(__tri, i).h <=> get(__tri, i + 1).h, get(__tri, i).p, -1)), p -> p >= 0)))")
    out = fixed(out, {"__twice": twice.cast("array<int>")})
    covered = F.expr("aggregate(__twice, struct(0 as upto, 0 as n), (a, p) -> struct(p + 3 as upto, a.n + p + 3 - greatest(a.upto, p) as n), a -> a.n)")
    return fixed(
        out,
        {
            "n_words": F.col("__n").cast("long"),
            "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
            "n_symbols": without(t, "#*$%&|<>").cast("long"),
            "n_repeat_words": covered.cast("long"),
            "n_capitals": without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long"),
            "n_marks": without(t, "!?").cast("long"),
        },
    ).drop("__hash", "__lines", "__n", "__tri", "__twice")


@dataclass
class Rule:
    """Conditions (statistic, '<=' or '>', threshold) that all must hold, and its counts in the third that prunes."""

    conditions: list[tuple[str, str, int]] = field(default_factory=list)
    bad: int = 0
    good: int = 0

    def holds(self, row: dict) -> bool:
        return all(row[f] <= t if op == "<=" else row[f] > t for f, op, t in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for f, op, t in self.conditions:
            stat = F.expr(FEATURES[f])
            out = out & (stat <= t if op == "<=" else stat > t)
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {op} {t}" for f, op, t in self.conditions)


def counts(rows: list[dict]) -> tuple[int, int]:
    bad = sum(r["bad"] for r in rows)
    return bad, len(rows) - bad


def best_condition(rows: list[dict], cuts: dict[str, list[int]]) -> tuple[float, tuple | None]:
    """The condition with the largest FOIL gain, from one histogram for each statistic."""
    bad, good = counts(rows)
    base, best = math.log2(bad / (bad + good)) if bad else 0, (1e-9, None)
    for f, bounds in cuts.items():
        under: dict[int, list[int]] = {}
        for r in rows:
            under.setdefault(r[f], [0, 0])[0 if r["bad"] else 1] += 1
        values, p, n, i = sorted(under), 0, 0, 0
        for t in bounds:
            while i < len(values) and values[i] <= t:
                p, n, i = p + under[values[i]][0], n + under[values[i]][1], i + 1
            for op, b, g in (("<=", p, n), (">", bad - p, good - n)):
                if b and b + g < len(rows):
                    gain = b * (math.log2(b / (b + g)) - base)
                    if gain > best[0]:
                        best = (gain, (f, op, t))
    return best


def learn(rows: list[dict], cuts: dict[str, list[int]], precision: float = 0.97, least: int = 5, max_rules: int = 24, max_conditions: int = 4) -> list[Rule]:
    """Rules for bad rows, in order. rows: statistics, 'bad', and 'prune' for the third that prunes.

    A rule stays if it covers least bad rows of the pruning third or more, with this precision. Of one
    that does not, the bad rows are set aside and the search goes on; two in a row end it. No rows, or
    none that is bad: no rules.
    """
    grow, prune, rules, failed = [r for r in rows if not r["prune"]], [r for r in rows if r["prune"]], [], 0
    while len(rules) < max_rules and failed < 2 and counts(grow)[0]:
        rule, covered = Rule(), grow
        while len(rule.conditions) < max_conditions and counts(covered)[1]:
            _, condition = best_condition(covered, cuts)
            if condition is None:
                break
            rule.conditions.append(condition)
            covered = [r for r in covered if Rule([condition]).holds(r)]

        def worth(x: Rule) -> tuple[float, int]:
            bad, good = counts([r for r in prune if x.holds(r)])
            return ((bad - good) / (bad + good) if bad + good else -1, bad)

        tried = [Rule(rule.conditions[: i + 1]) for i in range(len(rule.conditions))]
        if not tried:
            break
        rule = max(tried, key=lambda x: (*worth(x), -len(x.conditions)))
        rule.bad, rule.good = counts([r for r in prune if rule.holds(r)])
        if rule.bad < least or rule.bad < precision * (rule.bad + rule.good):
            grow, failed = [r for r in grow if not (r["bad"] and rule.holds(r))], failed + 1
            continue
        rules.append(rule)
        failed = 0
        grow, prune = [r for r in grow if not rule.holds(r)], [r for r in prune if not rule.holds(r)]
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules for documents that pass the base rule and whose label is 0, from at most max_labelled labelled rows.

    The sample is broadcast and its statistics come to the driver: max_labelled bounds both.
    Labels that are null, or of unknown documents, are left out.
    """
    order = F.xxhash64(F.lit(9), F.col("doc_id"))
    sample = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("__label")).orderBy(order, "doc_id", "__label").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = statistics(rows).where(~base_failed()).select(*(F.expr(e).alias(f) for f, e in FEATURES.items()), (F.col("__label") == 0).alias("bad"), (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(3)) == 0).alias("prune"))
    found = sorted((r.asDict() for r in rows.limit(2 * max_labelled).collect()), key=lambda r: tuple(r.values()))
    cuts = {}
    for f in FEATURES:
        # a threshold lies halfway between a quantile, or 0, and the next larger value
        values, distinct = sorted(r[f] for r in found), sorted({r[f] for r in found})
        after = dict(zip(distinct, distinct[1:]))
        chosen = {values[i * len(values) // QUANTILES] for i in range(QUANTILES)} | {0} if values else set()
        cuts[f] = sorted((v + after[v]) // 2 for v in chosen if v in after)
    return learn(found, cuts)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects: the ordered conditional expression."""
    out = None
    for r in rules:
        out = F.when(r.column(), F.lit(False)) if out is None else out.when(r.column(), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def apply_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with statistics, base_failed and kept. Empty and null texts fail the base rule."""
    out = statistics(docs)
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
