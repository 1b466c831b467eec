"""Quality by weak supervision, in DataFrame functions alone.

Each rule votes good (1), bad (-1) or abstains (0) on a text. Votes are counted
by pattern, of which there are at most 3^rules whatever the corpus; over these
counts expectation-maximisation estimates, for either class, how often each
rule is right when it votes, and the share of good texts. A text is kept if its
posterior probability of being good reaches THRESHOLD and no base rule fails.
"""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.5
#: Rounds of estimation end once no chance moves by SETTLED, or at ROUNDS.
ROUNDS, SETTLED = 60, 1e-3
#: Weight of the rules' believed accuracies, as a share of all texts.
BELIEF = 0.1
LEAST_WORDS = 50

# Blanks between words and the signs counted as symbols.
BLANKS = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
LARGE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, however often then uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\t-\\r ]+"))


def _repeated(word: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    windows = F.when(F.size(word) < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(word) - 3), lambda i: F.xxhash64(word[i], word[i + 1], word[i + 2]))
    )

    def covered(at: Column) -> Column:
        """at: sorted starts of repeated windows; each covers three words."""
        steps = F.transform(at, lambda p, i: F.when(i + 1 < F.size(at), F.least(F.lit(3), at[i + 1] - p)).otherwise(3))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def placed(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            last = F.size(p) - 1
            twin = lambda x, k: ((k > 0) & (p[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < last) & (p[F.least(k + 1, last)]["h"] == x["h"]))
            return F.sort_array(F.transform(F.filter(p, twin), lambda x: x["i"]))

        return let(let(pairs, starts), covered)

    def judged(hashes: Column) -> Column:
        distinct = F.size(F.array_distinct(hashes))
        return F.when(distinct == F.size(hashes), 0).otherwise(placed(hashes))

    return let(windows, judged)


def count_columns(text: Column) -> list[Column]:
    """The five base counts, and what the other rules look at."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    word = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeated(w).alias("r"), F.size(F.array_distinct(w)).alias("d")))
    line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    length = F.length(text)
    return [
        word.alias("word"), line.alias("line"), (_without(text, BLANKS)).alias("word_chars"), (length - _without(text, SYMBOLS)).alias("n_symbols"),
        (length - _without(text, LARGE)).alias("n_large"), (length - _without(text, "!")).alias("n_shouts"), (length - _without(text, SIGNS)).alias("n_signs"), (length - _without(text, "0123456789")).alias("n_digits"),
    ]


def counts(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *count_columns(text))
    long = lambda c, name: F.col(c).cast("long").alias(name)
    return found.select(
        "doc_id", long("word.n", "n_words"), long("word_chars", "word_chars"), long("n_symbols", "n_symbols"), long("line.d", "n_dup_lines"), long("word.r", "n_repeat_words"),
        long("line.n", "n_lines"), long("word.d", "n_distinct"), long("n_large", "n_large"), long("n_shouts", "n_shouts"), long("n_signs", "n_signs"), long("n_digits", "n_digits"),
    )


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


#: name: (value, good if within, bad if outside of); between the two a rule abstains.
RULES: dict[str, tuple[Callable[[], Column], tuple[float, float], tuple[float, float]]] = {
    "length": (lambda: F.col("n_words").cast("double"), (80, 1e12), (30, 1e12)),
    "word_length": (lambda: _share("word_chars", "n_words"), (3.0, 9.0), (2.2, 12.0)),
    "symbols": (lambda: _share("n_symbols", "n_words"), (0, 0.05), (0, 0.25)),
    "signs": (lambda: _share("n_signs", "word_chars"), (0, 0.07), (0, 0.1)),
    "repeated_lines": (lambda: _share("n_dup_lines", "n_lines"), (0, 0.1), (0, 0.35)),
    "few_words": (lambda: _share("n_distinct", "n_words"), (0.3, 1), (0.15, 1)),
    "repeated_words": (lambda: _share("n_repeat_words", "n_words"), (0, 0.15), (0, 0.4)),
    "capitals": (lambda: _share("n_large", "word_chars"), (0, 0.15), (0, 0.5)),
    "shouting": (lambda: _share("n_shouts", "n_words"), (0, 0.1), (0, 0.4)),
    "digits": (lambda: _share("n_digits", "word_chars"), (0, 0.1), (0, 0.35)),
}


def vote(rule: str) -> Column:
    value, good, bad = RULES[rule]
    x = value()
    return F.when((x < bad[0]) | (x > bad[1]), -1).when((x >= good[0]) & (x <= good[1]), 1).otherwise(0).cast("tinyint")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


class Accuracies:
    """right[rule] = (chance that its vote is good on a good text, bad on a bad one)."""

    def __init__(self, right: dict[str, tuple[float, float]], good: float):
        self.right, self.good = right, good

    def chances(self) -> list[float]:
        return [self.good, *(x for both in self.right.values() for x in both)]

    def posterior(self) -> Column:
        odds = F.lit(log(self.good / (1 - self.good)))
        for rule, (on_good, on_bad) in self.right.items():
            v = F.col(f"vote_{rule}")
            odds = odds + F.when(v == 1, log(on_good / (1 - on_bad))).when(v == -1, log((1 - on_good) / on_bad)).otherwise(0.0)
        return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> Accuracies:
    """patterns: a vote column per rule and n, the number of texts. Starts from
    the belief that a bad vote on a good text is rare, and that a bad text fails
    few rules; BELIEF of all texts are made up to behave so, which keeps the
    classes from changing their meaning and chances off 0 and 1."""
    found = Accuracies({r: (0.98, 0.3) for r in rules}, 0.8)
    for _ in range(rounds):
        # the posterior is a column of its own: sums that each spelt it out would make plans of megabytes
        weighed = patterns.withColumn("q", found.posterior())
        q = F.col("q")
        sums = [F.sum(F.col("n") * q).alias("good"), F.sum("n").alias("n")]
        for r in rules:
            v = F.col(f"vote_{r}")
            for name, weight, hit in (("g", q, 1), ("b", 1 - q, -1)):
                sums.append(F.sum(F.when(v == hit, F.col("n") * weight).otherwise(0.0)).alias(f"{r}_{name}_right"))
                sums.append(F.sum(F.when(v != 0, F.col("n") * weight).otherwise(0.0)).alias(f"{r}_{name}_votes"))
        row = weighed.agg(*sums).first()
        if not row["n"]:
            break
        extra = max(10.0, BELIEF * row["n"])
        chance = lambda k, belief, row=row, extra=extra: min(max((row[f"{k}_right"] + extra * belief) / (row[f"{k}_votes"] + extra), 0.001), 0.999)
        right = {r: (chance(f"{r}_g", 0.98), chance(f"{r}_b", 0.3)) for r in rules}
        now = Accuracies(right, min(max((row["good"] + 8) / (row["n"] + 10), 0.01), 0.99))
        moved = max(abs(a - b) for a, b in zip(now.chances(), found.chances(), strict=True))
        found = now
        if moved < SETTLED:
            break
    return found


def judge(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: base counts, votes, posterior, base_failed, kept.

    Null and empty texts have no words and fail the base rules. A null doc_id
    stays null; rows with the same doc_id are judged one by one. An empty table
    gives no rows. Other columns are ignored.
    """
    rules = list(RULES)
    names = [f"vote_{r}" for r in rules]
    voted = common.materialise(counts(documents).select("*", *(vote(r).alias(n) for r, n in zip(rules, names, strict=True))), "quality-votes")
    # texts that fail the base rules are judged already and would blur the classes
    patterns = common.materialise(voted.where(~base_failed()).groupBy(*names).agg(F.count("*").alias("n")), "quality-patterns")
    found = estimate(patterns, rules)
    out = voted.withColumn("posterior", found.posterior()).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")
