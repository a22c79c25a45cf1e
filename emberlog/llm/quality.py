"""Quality rules as a short-circuit cascade of DataFrame expressions."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm.samples import sample_texts

#: White space of the word rule: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[ \t-\r]+"
#: Rows on which rules are timed and their selectivity estimated. It only orders the rules, never changes a verdict.
SAMPLE_ROWS, SEED = 400, 7
#: Warm runs of each statistic, of which the median counts, on one of so many rows of the sample.
RUNS, TIMED_SHARE = 3, 3


@dataclass(frozen=True)
class Rule:
    """``reject`` is a boolean column over the statistics that it ``needs``; null counts as not rejected."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[], Column]


def _words() -> Column:
    trimmed = F.btrim(F.col("__text"), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def _windows() -> Column:
    words = F.col("__words")
    hashed = F.transform(words, lambda x, i: F.struct(F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    return F.sort_array(F.slice(hashed, 1, F.greatest(F.size(words) - 2, F.lit(0))))


def _repeats() -> Column:
    s = F.col("__windows")
    alike = F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
    return F.sort_array(F.transform(alike, lambda x: x["i"]))


def _covered() -> Column:
    at = F.col("__repeats")
    steps = F.transform(at, lambda x, k: F.when(k == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(at, k - 1))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")


#: Statistic -> (the ones it is made from, its column). A name that begins with ``__`` is only a step to others.
STATISTICS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "__words": ((), _words),
    "n_words": (("__words",), lambda: F.size("__words").cast("long")),
    "word_chars": (("__words",), lambda: F.length(F.array_join("__words", "")).cast("long")),
    "n_symbols": ((), lambda: F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long")),
    "__lines": ((), lambda: F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^ \t-\r]"))),
    "n_lines": (("__lines",), lambda: F.size("__lines").cast("long")),
    "n_dup_lines": (("__lines",), lambda: (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")),
    "__windows": (("__words",), _windows),
    "__repeats": (("__windows",), _repeats),
    "n_repeat_words": (("__repeats",), _covered),
}

#: The fixed rules that decide before all others.
BASE = (
    Rule("few_words", ("n_words",), lambda: F.col("n_words") < 50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
)
#: Further production rules: symbols in place of prose, lines said again, words of odd length.
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda: 2 * F.col("n_dup_lines") > F.col("n_lines")),
    Rule("word_length", ("word_chars", "n_words"), lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 10 * F.col("n_words"))),
)


def _add(df: DataFrame, names: Sequence[str], alive: Column | None = None) -> DataFrame:
    """Add statistics with the steps to them, each in a projection of its own; only where ``alive``, if given."""
    for name in names:
        if name not in df.columns:
            needs, column = STATISTICS[name]
            df = _add(df, needs, alive)
            df = df.withColumn(name, column() if alive is None else F.when(alive, column()))
    return df


def _rejects(rule: Rule) -> Column:
    return F.coalesce(rule.reject(), F.lit(False))


def _steps(name: str) -> list[str]:
    """A statistic with all that it is made from, first things first."""
    needs = STATISTICS[name][0]
    return [*dict.fromkeys([s for n in needs for s in _steps(n)] + [name])]


def _costs(sample: DataFrame, names: Sequence[str], runs: int) -> dict[str, float]:
    """Seconds that each statistic adds to those it is made from: medians of ``runs`` warm runs, less those of an empty one."""

    def seconds(df: DataFrame, name: str | None) -> float:
        value = F.lit(0) if name is None else F.xxhash64(F.to_json(F.struct(name)))
        taken = []
        for _ in range(runs + 1):  # the first compiles
            began = time.perf_counter()
            df.agg(F.bit_xor(value)).first()
            taken.append(time.perf_counter() - began)
        return median(taken[1:])

    empty = seconds(sample, None)
    whole = {n: max(0.0, seconds(_add(sample, [n]), n) - empty) for n in names}
    return {n: max(1e-4, whole[n] - max((whole[m] for m in STATISTICS[n][0]), default=0.0)) for n in names}


def order_rules(docs: DataFrame, rules: Sequence[Rule] = BASE + RULES, sample_rows: int = SAMPLE_ROWS, runs: int = RUNS, costs: Mapping[str, float] | None = None) -> list[Rule]:
    """The rules by rejections per second on a sample of ``docs``, best first; equal ones keep their order.

    Costs are those of statistics: what earlier rules have computed is free. Rejections are counted among the rows that
    earlier rules let pass. ``costs`` gives known costs instead of measured ones.
    """
    sample = sample_texts(docs, sample_rows, SEED).withColumnRenamed("text", "__text").repartition(2).cache()
    try:
        names = [*dict.fromkeys(s for r in rules for n in r.needs for s in _steps(n))]
        full = _add(sample, names)
        rows = [tuple(x) for x in full.select(*(_rejects(r) for r in rules)).collect()]
        timed = sample.filter(F.pmod(F.xxhash64("__text"), F.lit(TIMED_SHARE)) == 0)
        costs = dict(costs or (_costs(timed, names, runs) if rows else {}))
    finally:
        sample.unpersist()
    left, known, out = list(range(len(rules))), set(), []
    while left:

        def gain(i: int) -> float:
            new = {s for n in rules[i].needs for s in _steps(n)} - known
            return sum(x[i] for x in rows) / (sum(costs.get(s, 1e-4) for s in new) + 1e-4)

        best = max(left, key=gain)
        left.remove(best)
        out.append(rules[best])
        rows = [x for x in rows if not x[best]]
        known |= {s for n in rules[best].needs for s in _steps(n)}
    return out


def _with_text(docs: DataFrame) -> DataFrame:
    """The row as one struct, so that no column's name clashes with a statistic's, and its text, null as empty."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))


def keep_quality(docs: DataFrame, rules: Sequence[Rule] = BASE + RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they were.

    Rules run in the order of :func:`order_rules`. What a later rule needs is computed only for rows that all earlier
    ones let pass. Null text is an empty one; rows that repeat get one verdict each; no shuffle, and no row but the
    sample's reaches the driver's control flow.
    """
    df = _with_text(docs).withColumn("__alive", F.lit(True))
    for rule in order_rules(docs, rules, sample_rows):
        df = _add(df, rule.needs, F.col("__alive")).withColumn("__alive", F.col("__alive") & ~_rejects(rule))
    # A filter would be pushed below the projections, with every statistic written out in it again for each use.
    return df.select(F.inline(F.when(F.col("__alive"), F.array("__row"))))


def quality_report(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every row's statistics and verdict: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept`` and the rules that reject it, ``rejected_by``.

    All statistics are asked for, so only the verdict short-circuits, in the same order as :func:`keep_quality`'s. Null
    and empty texts fail; rows that repeat get a row each.
    """
    shown = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    df = _add(_with_text(docs), [*shown, "n_lines"])
    base = _rejects(BASE[0]) | _rejects(BASE[1])
    verdict = F.when(base, F.lit(False))
    for rule in order_rules(docs, rules, sample_rows):
        verdict = verdict.when(_rejects(rule), F.lit(False))
    named = F.concat_ws(",", *(F.when(_rejects(r), F.lit(r.name)) for r in (*BASE, *rules)))
    return df.select(F.col("__row.doc_id").alias("doc_id"), *shown, base.alias("base_failed"), verdict.otherwise(F.lit(True)).alias("kept"), named.alias("rejected_by"))
