"""Quality rules by weak supervision. DataFrame operations only.

Each rule looks at one measure of a text and votes good, bad, very bad, or abstains. No rule decides alone: how far a
rule's votes can be trusted is estimated by expectation-maximisation over the votes of all texts, and a text stays if
the probability that it is good, given its votes, is at least one half.

Texts are good or bad, and bad in different ways: there is one class of bad texts per rule. Of a class' own texts a
fixed share fails the rule's strict bound; rules that are wrong about good texts hardly ever go that far. So the votes
themselves tell a rule that finds bad texts from one that is noisy: the more of its bad votes are very bad ones, or
stand beside bad votes of other rules, the more texts of its class there are, and the rest of its bad votes are taken
for false alarms. Only these proportions count, not how common a kind of bad text is.

The votes of all rules make a pattern, and there are at most 4 ** rules patterns. Their counts, taken over all
texts, are all that the estimation needs and all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, functions as F

from samerow.session import pin_splits, save

# The white space that ends a word, and the characters counted as symbols.
SPACE = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 30
# Before the first round: share of good texts, how often a rule votes bad on a good text, and how often on a bad text of
# another kind. They count as so many texts beside those of the table, however large it is.
START_GOOD, FALSE_ALARM, CHANCE, BELIEF = 0.8, 0.002, 0.05, 50
# Of bad texts of a rule's own kind: votes good, bad and very bad. Of its false alarms: this share is very bad.
OWN_GOOD, OWN_BAD, OWN_VERY = 0.1, 0.4, 0.5
SLIP = 0.05


@dataclass(frozen=True)
class Rule:
    """SQL conditions on the measures; both engines read them. None true: the rule abstains."""

    name: str
    very_bad: str
    bad: str
    good: str


RULES = (
    Rule("symbols", "4 * n_symbols > n_words", "10 * n_symbols > n_words", "20 * n_symbols <= n_words"),
    Rule(
        "word_length",
        "word_chars < 2 * n_words or word_chars > 15 * n_words",
        "word_chars < 3 * n_words or word_chars > 10 * n_words",
        "2 * word_chars >= 7 * n_words and word_chars <= 8 * n_words",
    ),
    Rule("duplicate_lines", "5 * n_dup_lines > 3 * n_lines", "5 * n_dup_lines > 2 * n_lines", "10 * n_dup_lines <= n_lines"),
    Rule("repeated_words", "5 * n_repeat_words > 3 * n_words", "5 * n_repeat_words > 2 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("capitals", "5 * n_capitals > 3 * word_chars", "5 * n_capitals > 2 * word_chars", "5 * n_capitals <= word_chars"),
    Rule("shouting", "10 * n_shouts > 3 * n_words", "10 * n_shouts > n_words", "50 * n_shouts <= n_words"),
)

BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass(frozen=True)
class Model:
    """Shares of the classes, and per rule how often it votes bad, given any vote, on good texts and on bad texts of
    another rule's kind. Class 0 are good texts, class k the texts that are bad by rule k - 1."""

    share: tuple[float, ...]
    alarm: tuple[float, ...]
    chance: tuple[float, ...]

    def joint(self, votes: Sequence[int]) -> list[float]:
        """Probability of each class together with these votes."""
        joint = list(self.share)
        for c in range(len(joint)):
            for j, v in enumerate(votes):
                joint[c] *= self.vote(c, j).get(v, 1.0)
        return joint

    def vote(self, c: int, j: int) -> dict[int, float]:
        """Probability of each vote of rule ``j`` on a text of class ``c``, given any."""
        if c == j + 1:
            return {1: OWN_GOOD, -1: OWN_BAD, -2: OWN_VERY}
        if c == 0:
            a = self.alarm[j]
            return {1: 1 - a, -1: a * (1 - SLIP), -2: a * SLIP}
        b = self.chance[j]
        own = OWN_BAD + OWN_VERY
        return {1: 1 - b, -1: b * (OWN_BAD / own), -2: b * (OWN_VERY / own)}


def start(n_rules: int = len(RULES)) -> Model:
    share = (START_GOOD, *[(1 - START_GOOD) / n_rules] * n_rules)
    return Model(share, (FALSE_ALARM,) * n_rules, (CHANCE,) * n_rules)


def score(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Store one row per row of ``docs``: ``row``, ``doc`` (a struct of ``carry``), the measures, ``votes``, ``base_failed``.

    ``row`` is the position in ``docs``. ``votes`` holds 1 (good), -1 (bad), -2 (very bad) or 0 (abstains) for every
    rule. A null text counts as empty: it has no words and fails the base. Columns of ``docs`` only meet
    each other inside ``doc``, so their names are free.
    """
    pin_splits(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))

    def without(chars: str) -> Column:
        return F.translate(F.col("text"), chars, "")

    n_chars = F.length("text")
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*carry).alias("doc"), text.alias("text"))
    split = base.select(
        "row",
        "doc",
        F.filter(F.split("text", f"[{SPACE}]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "").alias("lines"),
        F.length(without(SPACE_CHARS)).cast("long").alias("word_chars"),
        (n_chars - F.length(without(SYMBOLS))).cast("long").alias("n_symbols"),
        (n_chars - F.length(without(CAPITALS))).cast("long").alias("n_capitals"),
        ((n_chars - F.length(F.replace("text", F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_shouts"),
    )
    measured = split.select(
        "row",
        "doc",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_capitals",
        "n_shouts",
    )
    votes = [F.when(F.expr(r.very_bad), -2).when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in RULES]
    return save(measured.select("*", F.array(*votes).alias("votes"), F.expr(BASE_FAILED).alias("base_failed")))


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that occur at least twice in ``words``, the first occurrence included.

    64-bit hashes of the windows are sorted with their places, so equal ones are neighbours; no window is compared
    with all others, and none is made into a string.
    """
    n = F.size(words)
    windows = F.transform(
        F.sequence(F.lit(1), n - 2),
        lambda i: F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("w"), i.alias("i")),
    )

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda x, i: F.coalesce(F.get(ordered, i - 1)["w"] == x["w"], F.lit(False))
            | F.coalesce(F.get(ordered, i + 1)["w"] == x["w"], F.lit(False)),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        # Windows overlap: each adds what reaches beyond the one before.
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(
            places,
            start,
            lambda a, i: F.struct(
                (i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(a["end"], i)).cast("int").alias("n")
            ),
            lambda a: a["n"],
        )

    # An array of one, so that the sorted windows are computed once and not at each use.
    one = F.transform(F.array(F.sort_array(windows)), covered)
    return F.when(n < 4, F.lit(0)).otherwise(F.get(one, F.lit(0)))


def fit(votes: DataFrame, rounds: int = ROUNDS) -> Model:
    """Estimate the model from the ``votes`` of all rows, a ``score`` result; the patterns are counted by Spark."""
    return estimate([(r["votes"], r["n"]) for r in votes.groupBy("votes").agg(F.count("*").alias("n")).collect()], rounds)


def estimate(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = ROUNDS, n_rules: int = len(RULES)) -> Model:
    """The model from patterns of votes and how many texts have each. Rules are independent inside a class."""
    first = model = start(n_rules)
    classes, m = range(n_rules + 1), range(n_rules)
    for _ in range(rounds):
        size = [0.0 for _ in classes]
        cast, bad = ([[0.0 for _ in m] for _ in range(2)] for _ in range(2))  # on good texts, and on bad ones of other kinds
        for pattern, n in patterns:
            joint = model.joint(pattern)
            total = sum(joint)
            for c in classes:
                w = n * joint[c] / total
                size[c] += w
                for j, v in enumerate(pattern):
                    if v and c != j + 1:
                        cast[c > 0][j] += w
                        bad[c > 0][j] += w * (v < 0)
        model = Model(
            tuple((size[c] + BELIEF * first.share[c]) / (sum(size) + BELIEF) for c in classes),
            *(
                tuple((bad[k][j] + BELIEF * belief) / (cast[k][j] + BELIEF) for j in m)
                for k, belief in ((0, FALSE_ALARM), (1, CHANCE))
            ),
        )
    return model


def p_good(model: Model) -> Column:
    """Probability that a text is good, from its ``votes``."""
    joint = []
    for c, share in enumerate(model.share):
        p = F.lit(share)
        for j in range(len(model.alarm)):
            vote, of = F.get("votes", F.lit(j)), model.vote(c, j)
            p = p * F.when(vote == 1, of[1]).when(vote == -1, of[-1]).when(vote == -2, of[-2]).otherwise(1.0)
        joint.append(p)
    return joint[0] / reduce(add, joint)


def judge(docs: DataFrame, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``score`` with ``p_good``, the probability that a text is good, ``sound`` and ``kept``.

    Sound is a text at least as likely good as bad, kept a sound one that passes the base too. An empty table gives an
    empty result. A text that one rule alone finds very bad is dropped at any share of the table, unless that
    rule votes bad twenty times as often; one that a rule alone finds bad is dropped if enough of the rule's votes are
    very bad ones.
    """
    scored = score(docs, text_col, carry)
    judged = scored.withColumn("p_good", p_good(fit(scored.select("votes"))))
    sound = judged.withColumn("sound", F.col("p_good") >= 0.5)
    return sound.withColumn("kept", ~F.col("base_failed") & F.col("sound"))
