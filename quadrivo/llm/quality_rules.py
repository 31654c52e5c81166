"""Quality rules: a decision list learned from labelled statistics by sequential covering, in DataFrame operations only.

Each rule is a conjunction of thresholds (reject if symbol_share > 0.3 and ...). A rule is grown condition by condition on
two thirds of the labelled rows by FOIL's gain, pruned to its best beginning on the remaining third, and kept while it is precise enough; the rows it covers
then leave. Counts of all candidate thresholds come from one aggregation of binned statistics, so each step sends the driver at most
features x bins x 2 numbers. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import spare, written

SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Expected labelled rows that rules are learned from, thresholds tried for a feature, and limits of the list.
SAMPLE, BINS, MAX_RULES, MAX_CONDITIONS, PRECISION, MIN_COVER = 20_000, 16, 8, 3, 0.8, 5
FEATURES = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "bang_share", "distinct_share")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(c: Column | str, others: str) -> Column:
    """Characters of a string outside a class given by its complement."""
    return F.length(F.regexp_replace(c, others, "")).cast("long")


def _let(value: Column, body) -> Column:
    """body of value, evaluated once however often body uses it: a lambda's variable can't be inlined by the optimizer."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated_words(w: Column) -> Column:
    """Words inside a window of three words that is found twice or more in w. Windows are hashed and
    sorted with their places, so equal ones are neighbours; then the words that their places cover are summed up in order.
    Hashes have 64 bits: among a million windows of a text, two different ones are taken for equal with a chance of 3 in 100 million."""
    windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def places(s: Column) -> Column:
        return F.sort_array(F.transform(F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k - 1)["h"]) | x["h"].eqNullSafe(F.get(s, k + 1)["h"])), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda i, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - i, F.lit(3)))), F.lit(0).cast("long"), lambda n, x: n + x)

    def count(h: Column) -> Column:
        in_order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(h) > F.size(F.array_distinct(h)), _let(in_order, lambda s: _let(places(s), covered))).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(w) >= 3, _let(windows, count)).otherwise(F.lit(0).cast("long"))


def statistics(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns with BASE and FEATURES of each whole text; a null text has no words, and features of texts without words are 0. Every row is worked on by itself."""
    keep = df.columns if keep is None else keep

    def words(t: Column) -> Column:
        inner = F.btrim(t, F.lit(SPACES))
        return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[\\x20\\x09-\\x0D]+"))

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")

    def all_of(t: Column) -> Column:
        parts = F.struct(words(t).alias("w"), lines(t).alias("l"))
        return _let(
            parts,
            lambda p: F.struct(
                F.size(p["w"]).cast("long").alias("n_words"),
                F.length(F.array_join(p["w"], "")).cast("long").alias("word_chars"),
                _count(t, "[^#*$%&|<>]+").alias("n_symbols"),
                (F.size(p["l"]) - F.size(F.array_distinct(p["l"]))).cast("long").alias("n_dup_lines"),
                _repeated_words(p["w"]).alias("n_repeat_words"),
                F.size(p["l"]).alias("lines"),
                _count(t, "[^A-Z]+").alias("upper"),
                _count(t, "[^!]+").alias("bang"),
                F.size(F.array_distinct(p["w"])).alias("distinct"),
            ),
        )

    made = spare(df, "_s")
    rows = df.select(*keep, _let(F.coalesce(F.col(text), F.lit("")), all_of).alias(made))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(f"{made}.{a}").cast("double"), F.col(f"{made}.{b}").cast("double")), F.lit(0.0))
    return rows.select(
        *keep,
        *(F.col(f"{made}.{c}") for c in BASE),
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "n_words").alias("symbol_share"),
        share("n_dup_lines", "lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("upper", "word_chars").alias("upper_share"),
        share("bang", "n_words").alias("bang_share"),
        share("distinct", "n_words").alias("distinct_share"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float
    #: The threshold's number among the feature's thresholds.
    at: int

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"

    def expression(self) -> Column:
        c = F.col(self.feature).cast("double")
        return c > self.threshold if self.above else c <= self.threshold

    def binned(self) -> Column:
        return F.col(f"_b_{self.feature}") > self.at if self.above else F.col(f"_b_{self.feature}") <= self.at


@dataclass(frozen=True)
class DecisionList:
    """Rules in order: the first whose conditions all hold rejects; a text that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...] = ()

    def __str__(self) -> str:
        return "\n".join([*("reject if " + " and ".join(map(str, r)) for r in self.rules), "keep"])

    def number(self) -> Column:
        """The rule that rejects, from 0; null for none."""
        case = F.lit(None).cast("int")
        for i, rule in reversed(list(enumerate(self.rules))):
            case = F.when(_all([c.expression() for c in rule]), F.lit(i)).otherwise(case)
        return case

    def keeps(self) -> Column:
        return self.number().isNull()


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _grow(rows: DataFrame, thresholds: dict[str, list[float]], rule: list[Condition]) -> Condition | None:
    """The condition that adds most of FOIL's information gain to the rule."""
    bins = F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f"_b_{f}").alias("b")) for f in thresholds)))
    counts = rows.filter(_all([c.binned() for c in rule])).select("bad", bins.alias("x")).groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect()
    by = {f: [(0, 0)] * (len(t) + 1) for f, t in thresholds.items()}
    for r in counts:
        by[r.f][r.b] = (r.p, r.n)
    best, most = None, 1e-9
    for f, cells in sorted(by.items()):
        p_all, n_all = sum(p for p, _ in cells), sum(n for _, n in cells)
        if not p_all or p_all == n_all:
            return None
        was, p_low, n_low = math.log2(p_all / n_all), 0, 0
        for at, (p, n) in enumerate(cells[:-1]):
            p_low, n_low = p_low + p, n_low + n
            for above, pp, nn in ((True, p_all - p_low, n_all - n_low), (False, p_low, n_low)):
                gain = pp * (math.log2(pp / nn) - was) if pp else 0
                if gain > most:
                    best, most = Condition(f, above, thresholds[f][at], at), gain
    return best


def _bin(feature: str, thresholds: list[float]) -> Column:
    """The number of thresholds below the feature."""
    return F.size(F.filter(F.lit(thresholds), lambda x: x < F.col(feature).cast("double")))


def learn(labelled: DataFrame, bins: int = BINS) -> DecisionList:
    """The decision list for rows of FEATURES with bad (1: reject, 0: keep) and fold (0 and 1 to grow, 2 to prune)."""
    quantiles = [F.percentile_approx(F.col(f).cast("double"), F.lit([i / bins for i in range(bins + 1)]), F.lit(1000)).alias(f) for f in FEATURES]
    # Bad rows are few, so both kinds give their quantiles; thresholds lie midway between neighbours, which leaves a margin to either kind.
    found = labelled.groupBy("bad").agg(*quantiles).collect()
    seen = {f: sorted({x for r in found for x in r[f] or []}) for f in FEATURES}
    thresholds = {f: [(x + y) / 2 for x, y in zip(v, v[1:])] for f, v in seen.items() if len(v) > 1}
    if len(found) < 2:
        return DecisionList()
    numbered = [_bin(f, t).alias(f"_b_{f}") for f, t in thresholds.items()]
    rows = written(labelled.select("bad", "fold", *numbered).coalesce(8), "labelled")
    rules: list[tuple[Condition, ...]] = []
    while len(rules) < MAX_RULES:
        left = rows.filter(_all([~_all([c.binned() for c in r]) for r in rules]))
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS and (c := _grow(left.filter("fold < 2"), thresholds, rule)):
            rule.append(c)
        if not rule:
            break
        counts = left.agg(*(x for i in range(1, len(rule) + 1) for held in [_all([c.binned() for c in rule[:i]]) & (F.col("fold") == 2)] for x in (F.count_if(held & (F.col("bad") == 1)).alias(f"p{i}"), F.count_if(held).alias(f"n{i}")))).first()
        worth = [(2 * counts[f"p{i}"] / counts[f"n{i}"] - 1 if counts[f"n{i}"] else -1, i) for i in range(1, len(rule) + 1)]
        best, size = max(worth, key=lambda x: (round(x[0], 3), -x[1]))
        if (best + 1) / 2 < PRECISION or counts[f"n{size}"] < MIN_COVER:
            break
        rules.append(tuple(rule[:size]))
    return DecisionList(tuple(rules))


def train(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DecisionList:
    """Learns to reject what labels (key, label: 1 good, 0 bad) call bad, among texts that pass the base rules.

    Of the distinct labelled keys `sample` expected ones are drawn by a hash; where their rows are more, as a key may have any number of them,
    these are drawn by a hash of their texts, equal ones counting once. Null labels and keys are left out; of a key's several labels the mean counts, 0.5 as good.
    """
    draw = lambda salt, c, share: F.pmod(F.xxhash64(F.lit(salt), c), F.lit(1 << 20)) < math.ceil(min(1.0, share) * (1 << 20))
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.avg(F.col(label).cast("double")).alias("_y"))
    known = written(known, "labels")
    picked = known.filter(draw("rules", F.col("_key"), sample / max(1, known.count())))
    n = df.select(F.col(key).alias("_key")).join(F.broadcast(picked), "_key").count()
    joined = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(picked), "_key")
    if n > sample:
        content = F.xxhash64("_key", F.coalesce(F.col("_text"), F.lit("")))
        joined = joined.withColumn("_content", content).filter(draw("row", F.col("_content"), sample / n)).dropDuplicates(["_content"]).drop("_content")
    rows = statistics(joined, "_text", ["_key", "_y"])
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("_key")), F.lit(3)).cast("int")
    made = written(rows.select(*BASE, *FEATURES[1:], (F.col("_y") < 0.5).cast("int").alias("bad"), fold.alias("fold")), "statistics")
    return learn(made.filter(~base_failed()).select(*FEATURES, "bad", "fold"))


def quality_rules(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """For each row: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (number of the learned rule that rejects, else null).

    A null, empty or blank text has no words and fails the base rules. Repeated rows repeat, a null key stays null, an empty table
    gives none; without labels of both kinds only the base rules reject.
    """
    model = train(df, labels, text, key, label, sample)
    rows = statistics(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", ["_key"])
    return rows.select(F.col("_key").alias(key), *BASE, base_failed().alias("base_failed"), (~base_failed() & model.keeps()).alias("kept"), model.number().alias("rule"))
