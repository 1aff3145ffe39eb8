"""Quality rules: learned decision lists as ordered conditional expressions.

DataFrame functions only.  A text's statistics come from built-in functions.
Sequential covering learns, from all labelled rows, an ordered list of
conjunctions of thresholds that mark low quality: a rule grows by the condition
of highest FOIL gain on one part of the rows, is pruned on the other part, and
is kept while it is precise there; then the rows it covers go.  When a rule is
not kept, the next best is tried.  Each step of growth reads one histogram of the rows that are
still uncovered, by feature and threshold bin, which Spark counts (some hundred rows, whatever the
input's size); the labelled rows themselves stay a table.

Nulls: null text has no words (and so fails the base rules), null doc_id stays null and has no
label, null labels are not learned from.  Without labels the list is empty and
keeps all that the base rules keep.  Repeated rows each get a row (a repeated
label counts as often as it stands); other columns are not read.  Windows of
words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

#: White space that separates words, and characters that count as symbols.
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
SPLIT = "[ \\t\\n\\x0B\\f\\r]+"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Thresholds of a feature are these quantiles of it in either class, and the smallest value above 0.
QUANTILES = [0.0, 0.005, 0.01, *(k / 50 for k in range(1, 50)), 0.99, 0.995, 1.0]
#: Rules that may fail to be kept before the list ends.
MAX_FAILED = 28
MAX_RULES, MAX_CONDITIONS, MIN_COVER, PRECISION = 12, 3, 5, 0.9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def n_repeat_words(words: Column) -> Column:
    """Words in windows of three words that occur twice or more; a sort, so of n log n steps for any text."""

    def covered(h: Column) -> Column:
        def marked(p: Column) -> Column:
            same = lambda i, x: F.coalesce(F.get(p, i)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(p, lambda x, i: same(i - 1, x) | same(i + 1, x)), lambda x: x["i"]))

        def total(at: Column) -> Column:
            return F.aggregate(F.transform(at, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x)

        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, lambda p: let(marked(p), total)))

    return let(words, lambda w: F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), covered))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, the base counts, n_upper and n_marks."""
    t = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split("t", SPLIT), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: without(x, SPACE) > 0)
    d = docs.select("doc_id", t.alias("t"))
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).alias("r")))
    d = d.select("doc_id", "t", counted.alias("c"))
    length = F.length("t")
    return d.select(
        "doc_id", F.col("c.n").alias("n_words"), without(F.col("t"), SPACE).cast("long").alias("word_chars"), (length - without(F.col("t"), SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"), F.col("c.r").alias("n_repeat_words"),
        (length - without(F.col("t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).cast("long").alias("n_upper"), (length - without(F.col("t"), "!?")).cast("long").alias("n_marks"),
    )


def features() -> dict[str, Column]:
    """Features that rules compare, from the statistics."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {"words": F.col("n_words").cast("double"), "mean_length": F.col("word_chars") / words, "symbols": F.col("n_symbols") / chars, "dup_lines": F.col("n_dup_lines") / words, "repeats": F.col("n_repeat_words") / words, "upper": F.col("n_upper") / chars, "marks": F.col("n_marks") / words}


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: (feature, at least, threshold): the feature is at least the threshold, or below it.
Condition = tuple[str, bool, float]


@dataclass
class Cell:
    """Labelled rows of one combination of bins: a feature's bin is the number of its thresholds that it reaches."""

    bins: dict[str, int]
    grow: bool
    low: int
    fine: int


def holds(cell: Cell, cond: tuple[str, bool, int]) -> bool:
    name, at_least, k = cond
    return (cell.bins[name] > k) == at_least


def covered(cells: list[Cell], rule: list[tuple[str, bool, int]], grow: bool | None) -> tuple[int, int, list[Cell]]:
    own = [c for c in cells if (grow is None or c.grow == grow) and all(holds(c, r) for r in rule)]
    return sum(c.low for c in own), sum(c.fine for c in own), own


def precision(p: int, n: int) -> float:
    return (p + 0.5) / (p + n + 1)


#: Of each feature and bin: low and fine rows of the growing part, low and fine rows of the other.
Histogram = dict[tuple[str, int], tuple[int, int, int, int]]
Rule = list[tuple[str, bool, int]]


def by_condition(h: Histogram, thresholds: dict[str, list[float]]) -> dict[tuple[str, bool, int], list[int]]:
    """Of each condition, the sums of the histogram's counts where it holds."""
    out = {}
    for f, ts in thresholds.items():
        bins = [h.get((f, k), (0, 0, 0, 0)) for k in range(len(ts) + 1)]
        total, below = [sum(x) for x in zip(*bins, strict=True)], [0, 0, 0, 0]
        for k in range(len(ts)):
            below = [x + y for x, y in zip(below, bins[k], strict=True)]
            out[f, True, k], out[f, False, k] = [x - y for x, y in zip(total, below, strict=True)], below
    return out


def learn(histogram: Callable[[list[Rule], Rule], Histogram], thresholds: dict[str, list[float]]) -> list[list[Condition]]:
    """Ordered rules for low quality; ``histogram`` counts the rows that a rule covers and those before it do not."""
    import math

    rules: list[Rule] = []
    barred: set[tuple[str, bool]] = set()  # what began rules that were not kept
    failed, first = 0, None
    while len(rules) < MAX_RULES and failed < MAX_FAILED:
        rule: Rule = []
        counts: list[list[int]] = []  # of the rule's first conditions
        while len(rule) < MAX_CONDITIONS:
            if rule or first is None:
                h = by_condition(histogram(rules, rule), thresholds)
                first = first if rule else h
            found = h if rule else first
            p, n = counts[-1][:2] if rule else next(([found[f, True, 0][i] + found[f, False, 0][i] for i in (0, 1)] for f, ts in thresholds.items() if ts), (0, 0))
            if not n:
                break
            info = math.log2(max(p, 1e-9) / (p + n))
            best = None
            for c, (q, m, _, _) in found.items():
                if q >= MIN_COVER and (rule or c[:2] not in barred):
                    gain = q * (math.log2(q / (q + m)) - info)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, c)
            if best is None:
                break
            rule.append(best[1])
            counts.append(found[best[1]])
        if not rule:
            break
        while len(rule) > 1:  # prune: drop the last condition while the other part likes it
            (_, _, p0, n0), (_, _, p1, n1) = counts[-1], counts[-2]
            if (p1 - n1) / max(p1 + n1, 1) < (p0 - n0) / max(p0 + n0, 1) or precision(p1, n1) < PRECISION:
                break
            rule.pop()
            counts.pop()
        q, m, held_p, held_n = counts[-1]
        if q + held_p < MIN_COVER or precision(q + held_p, m + held_n) < PRECISION or precision(held_p, held_n) < PRECISION:
            barred.add(rule[0][:2])
            failed += 1
            continue
        rules.append(rule)
        barred, first = set(), None
    return [[(f, side, thresholds[f][k]) for f, side, k in rule] for rule in rules]


def learn_list(cells: list[Cell], thresholds: dict[str, list[float]]) -> list[list[Condition]]:
    """The list from cells in memory."""

    def histogram(rules: list[Rule], rule: Rule) -> Histogram:
        out: dict[tuple[str, int], list[int]] = {}
        for c in covered(cells, rule, None)[2]:
            if not any(all(holds(c, x) for x in r) for r in rules):
                for f in thresholds:
                    t = out.setdefault((f, c.bins[f]), [0, 0, 0, 0])
                    t[0 if c.grow else 2] += c.low
                    t[1 if c.grow else 3] += c.fine
        return {k: tuple(v) for k, v in out.items()}

    return learn(histogram, thresholds)


def fit(stats: DataFrame, labels: DataFrame) -> list[list[Condition]]:
    """stats as ``statistics`` gives them; labels(doc_id, quality)."""
    marked = labels.where(F.col("quality").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("low"))
    f = features()
    rows = stats.where(~base_failed()).join(marked, "doc_id").select("low", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0).alias("grow"), *(c.alias(k) for k, c in f.items()))
    rows = written(rows, "quality-rows")
    found = rows.groupBy("low").agg(*(F.array_append(F.percentile_approx(k, QUANTILES, 2000), F.min(F.when(F.col(k) > 0, F.col(k)))).alias(k) for k in f)).collect()
    if not found:
        return []
    thresholds = {k: sorted({x for r in found for x in r[k] if x is not None}) for k in f}
    reached = lambda k: F.size(F.filter(F.array(*map(F.lit, thresholds[k])), lambda t: F.col(k) >= t))
    bins = [reached(k).alias(k) for k in thresholds]
    cells = written(rows.select("low", "grow", *bins).groupBy("grow", *f).agg(F.count_if("low").alias("n_low"), F.count_if(~F.col("low")).alias("n_fine")), "quality-cells")

    def holding(rule: Rule) -> Column:
        out = F.lit(True)
        for k, side, t in rule:
            out = out & ((F.col(k) > t) if side else (F.col(k) <= t))
        return out

    def histogram(rules: list[Rule], rule: Rule) -> Histogram:
        left = cells.where(holding(rule))
        for x in rules:
            left = left.where(~holding(x))
        binned = left.select("grow", "n_low", "n_fine", F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(k).alias("bin")) for k in f))).alias("x"))
        part = [F.sum(F.when(F.col("grow") == g, F.col(c)).otherwise(0)) for g in (True, False) for c in ("n_low", "n_fine")]
        got = binned.groupBy("x.f", "x.bin").agg(*(c.alias(f"c{i}") for i, c in enumerate(part))).collect()  # as many rows as features have bins
        return {(r.f, r.bin): (r.c0, r.c1, r.c2, r.c3) for r in got}

    return learn(histogram, thresholds)


def verdict(rules: list[list[Condition]]) -> Column:
    """The list as one conditional expression: false at the first rule that holds."""
    f = features()
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        cond = F.lit(True)
        for name, at_least, t in rule:
            cond = cond & ((f[name] >= t) if at_least else (f[name] < t))
        out = out.when(cond, F.lit(False))
    return out.otherwise(F.lit(True))


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> doc_id, base counts, base_failed, kept."""
    stats = written(statistics(docs), "quality-stats")
    rules = fit(stats, labels)
    return stats.select("doc_id", *BASE, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
