"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.lets import let

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"

#: Frequent function words of English, German, French and Spanish, in lower case.
STOP_WORDS = (
    "the of and to in a is that it for on with as be by this are was from or at have an not "
    "der die und den das von zu mit des ist ein eine im für dem nicht auf sich "
    "de la le et les un une que qui dans pour du sur par au en pas est ou il "
    "el los las y por con para se del lo su no al"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie between ``low`` and ``high``, both included; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: Bounds for prose of any of the four languages; README says how they were chosen.
RULES = (
    Rule("word_count", "n_words", 50, None),
    Rule("mean_word_length", "mean_word_length", 3.0, 10.0),
    Rule("symbols_per_word", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.06, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)


def _repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text holds twice or more.

    Windows are sorted by a 32-bit hash first, packed with their place into one long; only
    windows whose hash has a twin are compared as texts. So the result is exact, and a text
    without repeats never sorts strings.
    """

    def gram(at: Column) -> Column:
        return F.concat_ws(" ", F.get(words, at), F.get(words, at + 1), F.get(words, at + 2))

    def twins(xs: Column, key) -> Column:
        """The entries of a sorted array whose key equals a neighbour's."""
        return F.filter(
            xs,
            lambda x, k: key(x).eqNullSafe(key(F.get(xs, k + 1))) | key(x).eqNullSafe(key(F.get(xs, k - 1))),
        )

    packed = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.shiftleft(F.hash(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).cast("long"), 32)
        + i.cast("long"),
    )

    def exact(places: Column) -> Column:
        grams = F.sort_array(F.transform(places, lambda x: F.struct(gram(x).alias("g"), x.alias("i"))))
        return let(grams, lambda gs: F.sort_array(F.transform(twins(gs, lambda x: x["g"]), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        """Places reached by windows of three that start at the sorted places ``at``."""
        steps = F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def from_hashes(sorted_hashes: Column) -> Column:
        places = F.transform(
            twins(sorted_hashes, lambda x: F.shiftright(x, 32)),
            lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"),
        )
        return let(places, lambda p: F.when(F.size(p) == 0, 0).otherwise(let(exact(p), covered)))

    return F.when(F.size(words) < 4, 0).otherwise(let(F.sort_array(packed), from_hashes))


def _base(text: Column) -> Column:
    """A struct of the contract's counts and the lines' ratios, from a text that is not null."""
    spaces = F.length(F.regexp_replace(text, WORD, ""))

    def with_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(text) - spaces).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(text, NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:")).isin(STOP_WORDS)))
            .cast("long")
            .alias("n_stop_words"),
        )

    def with_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
            F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$")))
            .cast("long")
            .alias("n_ellipsis_lines"),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return F.struct(
        let(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), with_words).alias("w"),
        let(lines, with_lines).alias("l"),
    )


#: Fields of _base, by part.
_PARTS = {
    "w": ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words"),
    "l": ("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"),
}
#: Ratios of two counts, 0 where the second is 0.
_RATIOS = {
    "mean_word_length": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "stop_ratio": ("n_stop_words", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
}


def compile_rules(rules: Sequence[Rule], metric: Mapping[str, Column]) -> Column:
    """An array of the names of the rules that the metrics break."""
    broken = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (metric[r.metric] < r.low)
        if r.high is not None:
            bad = bad | (metric[r.metric] > r.high)
        broken.append(F.when(bad, F.lit(r.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def _verdict(rules: Sequence[Rule]):
    """From _base's struct, one of all counts, ratios and verdicts."""

    def judge(m: Column) -> Column:
        metric = {k: m[part][k] for part, names in _PARTS.items() for k in names}
        for k, (a, b) in _RATIOS.items():
            metric[k] = F.when(metric[b] == 0, 0.0).otherwise(metric[a].cast("double") / metric[b])
        failed = (metric["n_words"] < 50) | (100 * metric["n_repeat_words"] > 50 * metric["n_words"])
        broken = compile_rules(rules, metric)
        return F.struct(
            *[c.alias(k) for k, c in metric.items()],
            failed.alias("base_failed"),
            broken.alias("failed_rules"),
            (~failed & (F.size(broken) == 0)).alias("kept"),
        )

    return judge


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with its metrics, ``base_failed``, ``failed_rules`` and ``kept``, one row for each row.

    ``base_failed``: under 50 words, or over half of the words inside repeated three-word
    windows. ``kept``: neither that nor a broken rule. Rows with a null or empty text fail the
    base; repeated rows get equal verdicts; an empty table stays empty; new columns replace
    columns of ``docs`` with the same names, and all other columns pass through.
    """
    # one column holds everything, so that a filter on a verdict evaluates the projection once
    judged = let(let(F.coalesce(F.col(text_col), F.lit("")), _base), _verdict(rules))
    taken, hold = {c.lower() for c in docs.columns}, "_m"
    while hold in taken:
        hold += "_"
    names = [*(k for part in _PARTS.values() for k in part), *_RATIOS, "base_failed", "failed_rules", "kept"]
    return docs.withColumn(hold, judged).withColumns({k: F.col(hold)[k] for k in names}).drop(hold)
