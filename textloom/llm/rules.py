"""Quality rules: document statistics in SQL, and a decision list learned from them by sequential covering.

Everything that touches documents is a built-in expression; the learner only sees
binned counts of labelled statistics (at most FEATURES x GRID rows a step).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACES, materialize, split_table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
GRID = [i / 100 for i in (0, 1, 2, 5, 10, 15, 20, 30, 40, 50, 60, 70, 80, 85, 90, 95, 98, 99, 100)]
MAX_RULES, MAX_CONDITIONS = 16, 3
MIN_PRECISION, MIN_COVER = 0.8, 3

#: name -> SQL over the statistics; all are ratios, so that thresholds mean the same for any length
FEATURES = {
    "symbols_per_word": "n_symbols / n_words",
    "chars_per_word": "word_chars / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "upper_share": "n_upper / word_chars",
    "bang_per_word": "n_bang / n_words",
    "distinct_share": "n_distinct / n_words",
}
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang", "n_distinct"]


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep`` and STATS of every row of ``docs`` (doc_id, text); null texts have no words.

    Repeated windows are found by their 64-bit hashes: only where a text has fewer
    distinct windows than windows are they sorted with their positions.
    """
    spread = split_table(docs.select("doc_id", *keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")), docs.sparkSession.sparkContext.defaultParallelism)
    chars = lambda drop: F.length("text") - F.length(F.translate("text", drop, ""))
    first = spread.select(
        "doc_id", *keep,
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        chars(SYMBOLS).cast("long").alias("n_symbols"),
        chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"),
        chars("!").cast("long").alias("n_bang"),
        F.transform(F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"), lambda w: F.xxhash64(w)).alias("words"),
        F.expr(r"transform(filter(split(text, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]'), l -> xxhash64(l))").alias("lines"),
    )
    second = first.select(
        "doc_id", *keep, "word_chars", "n_symbols", "n_upper", "n_bang",
        F.size("words").cast("long").alias("n_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            f"if(size(words) > {WINDOW}, transform(sequence(0, size(words) - {WINDOW}), i -> xxhash64("
            + ", ".join(f"words[i + {k}]" for k in range(WINDOW))
            + ")), array())"
        ).alias("windows"),
    )
    kept = [c for c in second.columns if c != "windows"]
    third = second.select(*kept, F.expr("if(size(array_distinct(windows)) < size(windows), sort_array(transform(windows, (h, i) -> struct(h, i))), null)").alias("sorted"))
    fourth = third.select(*kept, F.expr("sort_array(transform(filter(sorted, (s, j) -> get(sorted, j - 1).h <=> s.h or get(sorted, j + 1).h <=> s.h), s -> s.i))").alias("found"))
    covered = f"aggregate(transform(found, (p, j) -> least({WINDOW}, coalesce(get(found, j + 1) - p, {WINDOW}))), 0L, (a, x) -> a + x)"
    return fourth.select(*kept, F.coalesce(F.expr(covered), F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature <= bound`` or ``feature > bound``."""

    feature: str
    above: bool
    step: int
    bound: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.bound!r}D"

    def binned(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.step}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered conjunctions that reject; what none of them matches is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for rule in reversed(self.rules):
            out = F.when(F.expr(" and ".join(c.sql() for c in rule)), F.lit(False)).otherwise(out)
        return out

    def text(self) -> str:
        lines = [f"if {' and '.join(c.sql() for c in rule)} then reject" for rule in self.rules]
        return "\n".join([*lines, "else keep"])


def _all(conditions) -> Column:
    return F.expr(" and ".join(c.binned() for c in conditions) or "true")


def learn(stats: DataFrame, labels: DataFrame) -> DecisionList:
    """Sequential covering of the rows labelled quality = 0 among those that pass the base rules.

    Two thirds of the labelled rows grow a rule, by the largest information gain of
    one more threshold at a time; the others prune it to the prefix of best worth
    (bad - good) / (bad + good).  A rule enters the list if it is right on at least
    MIN_PRECISION of the pruning rows it matches; what it matches is then set aside.
    Thresholds are approximate quantiles of the labelled rows.  With no labels the
    list is empty and keeps everything.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed() & (F.col("word_chars") > 0)).join(known, "doc_id")
    rows = materialize(rows.select((F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(3)) > 0).alias("grow"), (F.col("quality") == 0).cast("long").alias("bad"), *(F.expr(f"double({sql})").alias(name) for name, sql in FEATURES.items())), "labelled")
    found = rows.groupBy("bad").agg(*(F.percentile_approx(name, GRID, 2000).alias(name) for name in FEATURES)).collect()
    if len(found) < 2:
        return DecisionList(())
    bounds = {name: sorted({x for r in found for x in r[name] or []}) for name in FEATURES}
    # between two grid values the bound is their middle: a threshold should not sit on a value of one class
    bounds = {name: [(a + b) / 2 for a, b in zip(v, v[1:])] for name, v in bounds.items()}
    step = lambda name: F.coalesce(sum((F.col(name) > b).cast("int") for b in bounds[name]) if bounds[name] else F.lit(0), F.lit(0))
    binned = materialize(rows.select("grow", "bad", *(step(name).cast("int").alias(name) for name in FEATURES)).groupBy("grow", "bad", *FEATURES).agg(F.count("*").alias("n")), "binned")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MAX_RULES:
        left = binned
        for rule in rules:
            left = left.where(~_all(rule))
        rule = _grow(left.where("grow"), bounds)
        rule = rule and _prune(left.where("not grow"), rule)
        if not rule:
            break
        rules.append(rule)
    return DecisionList(tuple(rules))


def _grow(rows: DataFrame, bounds: dict[str, list[float]]) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    while len(rule) < MAX_CONDITIONS:
        pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("step")) for f in FEATURES))).alias("x")
        counts = rows.where(_all(rule)).select("bad", "n", pairs).groupBy("x.feature", "x.step").agg(F.sum(F.col("n") * F.col("bad")).alias("bad"), F.sum("n").alias("all")).collect()
        at: dict[str, list[tuple[int, int, int]]] = {}
        for r in counts:
            at.setdefault(r["feature"], []).append((r["step"], r["bad"], r["all"]))
        if not at:
            return rule
        any_feature = next(iter(at.values()))
        bad, total = sum(b for _, b, _ in any_feature), sum(n for _, _, n in any_feature)
        if bad in (0, total):
            return rule if bad else ()
        now, best = math.log2(bad / total), (1e-9, None)
        for feature in FEATURES:
            low_bad = low_all = 0
            seen = {s: (b, n) for s, b, n in at.get(feature, [])}
            for s, bound in enumerate(bounds[feature]):
                b, n = seen.get(s, (0, 0))
                low_bad, low_all = low_bad + b, low_all + n
                for above, p, q in ((False, low_bad, low_all), (True, bad - low_bad, total - low_all)):
                    if p >= MIN_COVER and (gain := p * (math.log2(p / q) - now)) > best[0]:
                        best = (gain, Condition(feature, above, s, bound))
        if best[1] is None:
            return rule
        rule += (best[1],)
    return rule


def _prune(rows: DataFrame, rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    prefixes = [rule[: k + 1] for k in range(len(rule))]
    sums = [F.sum(F.when(_all(p), x)).alias(f"{kind}{k}") for k, p in enumerate(prefixes) for kind, x in (("b", F.col("n") * F.col("bad")), ("a", F.col("n")))]
    got = rows.agg(*sums).first()
    worth = []
    for k, p in enumerate(prefixes):
        bad, total = got[f"b{k}"] or 0, got[f"a{k}"] or 0
        if total and bad >= MIN_PRECISION * total:
            worth.append(((2 * bad - total) / total, bad, -k, p))
    return max(worth)[3] if worth else ()


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DecisionList]:
    """Statistics of every row of ``docs`` with base_failed and kept, and the learned list.

    Null and empty texts have no words and fail.  Rows with null or repeated doc_id
    are judged each by its own text.  Columns in ``keep`` pass through, others are ignored.
    """
    stats = materialize(statistics(docs, keep), "statistics")
    rules = learn(stats, labels)
    kept = ~base_failed() & rules.column()
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", F.coalesce(kept, F.lit(False))), rules
