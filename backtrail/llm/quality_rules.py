"""Quality rules that vote or abstain, weighed by expectation-maximisation.

No rule rejects a text alone. Each votes ``bad`` (-1) or ``good`` (1) or abstains (0);
how often each casts either vote on bad and on good texts is estimated from the votes on
all documents, without labels, and a text goes by its posterior probability.
Everything is built-in functions; the estimation works on the counts of the vote
patterns, of which there are at most three to the number of rules.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import SPACE
from backtrail.session import cut_lineage

#: Whole numbers that ``with_features`` measures.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
            "n_letters", "n_distinct", "n_adjacent", "n_shouts", "n_symbol_runs")
#: Words of a stretch in which different words are counted, so that their share does not fall with the length.
STRETCH = 500
_LOW = 30  # bits that hold a place in a text; a text has fewer than 2**30 words
_PLACE = (1 << _LOW) - 1


@dataclass(frozen=True)
class Rule:
    """Votes bad above or below one limit, good on the other side of another, else abstains."""

    name: str
    measure: Callable[[Mapping[str, Column]], Column]
    bad: Callable[[Column], Column]
    good: Callable[[Column], Column]

    def vote(self, f: Mapping[str, Column]) -> Column:
        x = self.measure(f)
        return F.when(self.bad(x), -1).when(self.good(x), 1).otherwise(0).cast("int")


def _share(part: str, whole: str) -> Callable[[Mapping[str, Column]], Column]:
    return lambda f: f[part] / F.greatest(f[whole], F.lit(1))


def _never(x: Column) -> Column:
    return F.lit(False)


#: Limits follow common sense about prose, not the labels. Kinds of junk are met by two or
#: more rules, since one vote that no other rule shares should not decide.
RULES: tuple[Rule, ...] = (
    Rule("symbol_letters", _share("n_symbols", "word_chars"), lambda x: x > 0.03, _never),
    Rule("symbol_words", _share("n_symbol_runs", "n_words"), lambda x: x > 0.1, _never),
    Rule("letters", _share("n_letters", "word_chars"), lambda x: x < 0.85, lambda x: x > 0.92),
    Rule("upper_case", _share("n_upper", "n_letters"), lambda x: x > 0.4, _never),
    Rule("shouts", _share("n_shouts", "n_words"), lambda x: x > 0.3, _never),
    Rule("repeated_windows", _share("n_repeat_words", "n_words"), lambda x: x > 0.4, _never),
    Rule("repeated_lines", _share("n_dup_lines", "n_lines"), lambda x: x > 0.4, _never),
    Rule("doubled_words", _share("n_adjacent", "n_words"), lambda x: x > 0.2, _never),
    Rule("different_words", _share("n_distinct", "n_words"), lambda x: x < 0.2, lambda x: x > 0.4),
    Rule("word_length", _share("word_chars", "n_words"), lambda x: (x < 2.5) | (x > 10), lambda x: (x > 3.5) & (x < 7)),
)

# Bounds that keep the two classes from changing places: a rule calls few good texts bad
# and many good, whatever else it does. No rule is taken to be wrong on fewer than 6 in 100
# good texts, so that one bad vote weighs less than the good votes of others.
_BAD_ON_BAD, _BAD_ON_GOOD = (0.05, 0.99), (0.06, 0.15)
_GOOD_ON_BAD, _GOOD_ON_GOOD = (0.05, 0.95), (0.5, 0.99)
#: Made-up texts added to each estimate, at the middle of its bounds.
_ADDED = 2


@dataclass(frozen=True)
class Model:
    """For each rule, how often it votes bad or good on texts that are bad or good."""

    prior_bad: float
    bad_on_bad: Sequence[float]
    bad_on_good: Sequence[float]
    good_on_bad: Sequence[float]
    good_on_good: Sequence[float]
    rounds: int = field(default=0, compare=False)

    def good(self, votes: Sequence[Column]) -> Column:
        """Posterior probability that a text is good; abstaining says nothing.

        The log odds are summed in the order of the rules.
        """
        odds = F.lit(log(self.prior_bad / (1 - self.prior_bad)))
        for vote, *p in zip(votes, self.bad_on_bad, self.bad_on_good, self.good_on_bad, self.good_on_good, strict=True):
            odds = odds + F.when(vote == -1, log(p[0] / p[1])).when(vote == 1, log(p[2] / p[3])).otherwise(0.0)
        return 1 / (1 + F.exp(odds))


def _count(text: Column, letters: str) -> Column:
    """How many characters of ``text`` are among ``letters`` (a regular expression class)."""
    return F.length(text) - F.length(F.regexp_replace(text, letters, ""))


def _repeated(keys: Column) -> Column:
    """Places of sorted keys (hash bits above, place below) whose hash bits occur twice or more."""
    def twice(x: Column, k: Column) -> Column:
        own = F.shiftright(x, _LOW)
        return (own == F.shiftright(F.get(keys, k - 1), _LOW)) | (own == F.shiftright(F.get(keys, k + 1), _LOW))

    return F.transform(F.filter(keys, twice), lambda x: x.bitwiseAND(F.lit(_PLACE)))


def with_features(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Add the columns of ``FEATURES`` (long), each with ``prefix`` before its name.

    Words are runs without space or U+0009 to U+000D. ``n_repeat_words`` counts the
    words in windows of three words that occur twice or more, by 64-bit hashes within
    one text: sorted once by the upper and, where those agree, once by the lower half.
    ``n_distinct`` adds up the different words of each stretch of ``STRETCH`` words;
    ``n_letters`` counts letters and the marks on them.
    A null text has none of anything. The whole text is read.
    """
    t, w, h, g, s, p = (f"__quality_{x}" for x in "twhgsp")
    col = F.col
    steps = docs.withColumn(t, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    steps = steps.withColumn(w, F.array_remove(F.split(col(t), f"[{SPACE}]+"), ""))
    steps = steps.withColumn(h, F.transform(col(w), lambda x: F.xxhash64(x)))
    steps = steps.withColumn(g, F.when(F.size(h) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))))
    steps = steps.withColumn(s, F.sort_array(F.transform(
        col(g), lambda x, i: x.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("bigint")))))
    steps = steps.withColumn(p, _repeated(col(s)))
    steps = steps.withColumn(s, F.sort_array(F.transform(
        col(p), lambda i: F.shiftleft(F.get(g, i.cast("int")), _LOW).bitwiseOR(i))))
    steps = steps.withColumn(p, F.sort_array(_repeated(col(s))))
    lines = F.filter(F.split(col(t), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    steps = steps.withColumn(s, F.transform(lines, lambda x: F.struct(F.xxhash64(x), F.length(x))))
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.translate(col(t), "\t\n\x0b\x0c\r ", "")),
        "n_symbols": _count(col(t), "[#*$%&|<>]"),
        "n_dup_lines": F.size(s) - F.size(F.array_distinct(col(s))),
        "n_repeat_words": F.aggregate(
            F.transform(col(p), lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(3)), F.lit(3))),
            F.lit(0).cast("bigint"), lambda a, x: a + x),
        "n_lines": F.size(s),
        "n_upper": _count(col(t), r"\p{Lu}"),
        "n_letters": _count(col(t), r"[\p{L}\p{M}]"),
        "n_distinct": F.aggregate(
            F.transform(F.sequence(F.lit(1), F.greatest(F.size(h), F.lit(1)), F.lit(STRETCH)),
                        lambda i: F.size(F.array_distinct(F.slice(col(h), i, STRETCH)))),
            F.lit(0).cast("bigint"), lambda a, x: a + x),
        "n_adjacent": F.size(F.filter(col(h), lambda x, i: x == F.get(h, i - 1))),
        "n_shouts": _count(col(t), "!"),
        "n_symbol_runs": F.regexp_count(col(t), F.lit("[#*$%&|<>]+")),
    }
    return steps.withColumns({prefix + n: c.cast("long") for n, c in found.items()}).drop(t, w, h, g, s, p)


def votes(prefix: str = "", rules: Sequence[Rule] = RULES) -> list[Column]:
    f = {n: F.col(prefix + n) for n in FEATURES}
    return [rule.vote(f) for rule in rules]


def _rate(voted: float, of: float, bounds: tuple[float, float]) -> float:
    low, high = bounds
    return min(max((voted + _ADDED * (low + high) / 2) / (of + _ADDED), low), high)


def fit(features: DataFrame, rules: Sequence[Rule] = RULES, prefix: str = "", rounds: int = 50,
        tolerance: float = 1e-4) -> Model:
    """Estimate how often each rule votes bad and good on bad and on good texts, without labels.

    At first a text counts as bad in proportion to its bad votes; each round sums the
    counts of the vote patterns by the current posterior, until no estimate moves by
    ``tolerance``. An empty table gives the starting values.
    """
    names = [f"v{k}" for k in range(len(rules))]
    cast = [v.alias(n) for v, n in zip(votes(prefix, rules), names)]
    patterns = features.select(*cast).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    patterns = cut_lineage(patterns.repartition(1).sortWithinPartitions(*names))
    cols = [F.col(n) for n in names]
    bad = F.least(0.01 + 0.5 * sum(((c == -1).cast("double") for c in cols), F.lit(0.0)), F.lit(0.95))
    k = len(names)
    model = Model(0.1, [0.5] * k, [0.01] * k, [0.5] * k, [0.95] * k)
    for done in range(1, rounds + 1):
        weight, rest = F.col("n") * F.col("bad"), F.col("n") * (1 - F.col("bad"))
        sums = [F.sum("n"), F.sum(weight)]
        for mass, vote in ((weight, -1), (rest, -1), (weight, 1), (rest, 1)):
            sums += [F.sum(F.when(c == vote, mass)) for c in cols]
        total, all_bad, *voted = (float(x or 0) for x in patterns.withColumn("bad", bad).agg(*sums).first())
        if not total:
            return model
        all_good = total - all_bad
        new = Model(
            min(max(all_bad / total, 1e-3), 0.9),
            *([_rate(v, of, bounds) for v in voted[at * k:(at + 1) * k]] for at, (of, bounds) in enumerate((
                (all_bad, _BAD_ON_BAD), (all_good, _BAD_ON_GOOD), (all_bad, _GOOD_ON_BAD), (all_good, _GOOD_ON_GOOD)))),
            done)
        moved = max(abs(a - b) for a, b in zip(_numbers(new), _numbers(model)))
        model, bad = new, 1 - new.good(cols)
        if moved < tolerance:
            break
    return model


def _numbers(model: Model) -> list[float]:
    return [model.prior_bad, *model.bad_on_bad, *model.bad_on_good, *model.good_on_bad, *model.good_on_good]


def verdicts(features: DataFrame, model: Model, prefix: str = "", rules: Sequence[Rule] = RULES,
             threshold: float = 0.5) -> DataFrame:
    """Add ``base_failed``, ``p_good`` and ``kept``, each with ``prefix`` before its name.

    The base fails under 50 words, or if over half of the words stand in repeated
    windows; such a text is not kept whatever the votes. Others are kept if the
    posterior probability of a good text is ``threshold`` or more.
    """
    n, again = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    failed = (n < 50) | (100 * again > 50 * n)
    cast = votes(prefix, rules)
    return features.withColumns({prefix + "base_failed": failed, prefix + "p_good": model.good(cast)}).withColumn(
        prefix + "kept", ~F.col(prefix + "base_failed") & (F.col(prefix + "p_good") >= threshold))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on all documents and judge each: the id, ``FEATURES``, ``base_failed``, ``p_good``, ``kept``."""
    measured = with_features(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    kept = cut_lineage(measured.drop("__text"))
    return verdicts(kept, fit(kept)).withColumnRenamed("__id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Only the documents that ``judge`` keeps, with the columns they came with.

    The features are measured twice, once to fit and once to filter, which costs less
    than moving the texts for a join.
    """
    model = fit(cut_lineage(with_features(docs.select(text_col), text_col).select(*FEATURES)))
    mark = "__quality_"
    judged = verdicts(with_features(docs, text_col, mark), model, mark)
    # a row number stands between, or the optimizer would move the filter below the features and measure them in it
    barred = judged.withColumn(mark + "row", F.monotonically_increasing_id())
    return barred.where(F.col(mark + "kept") & (F.col(mark + "row") >= 0)).select(*docs.columns)
