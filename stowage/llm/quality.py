"""Quality rules as weak supervision, in DataFrame functions only.

Six rules each call a document good or bad or abstain. Expectation-maximisation estimates, for
either class, how often each rule casts each vote (Dawid and Skene's model, 1979), and a document
stays if its posterior probability of being good is at least one half.

Only counts of vote patterns leave the scan: at most 3^6 rows, whatever the input. The steps of the
maximisation are aggregations over those rows; a step hands the next one its parameters as literals.

Defined results: a null text has no words; a text of any length is one row, whose arrays are a few times
its size; an empty table gives an empty result; repeated rows, and rows that share a doc_id or have
none, are judged each by its own text, equal texts alike; every other column of the input, whatever its
name, is passed through or ignored, never used by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.common import BLANKS, Written, as_list, words_of

SYMBOLS = "#*$%&|<>"
RULES = ("symbols", "marks", "repetition", "lines", "shouting", "word_length")
#: The expectation-maximisation ends when no pattern's posterior moves by this much in a step, or after so many steps.
SETTLED, STEPS = 1e-4, 40
#: A document stays if its posterior probability of being good is at least this.
KEEP_AT = 0.5


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the base counts and what the rules read, columns `_q_...`. One pass, no shuffle.

    Each step adds plain columns: fields of a struct would be inlined, and computed, at every use.
    """
    columns = docs.columns
    at = lambda name: F.col(f"_q_{name}")
    step = docs.withColumn("_q_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_q_w", words_of(at("t")))
    # One 64-bit key for each window of three words; a text has far too few for two of them to meet by chance.
    keys = F.slice(
        F.transform(at("w"), lambda w, i: F.xxhash64(w, F.get(at("w"), i + 1), F.get(at("w"), i + 2))),
        1,
        F.greatest(F.size(at("w")) - 2, F.lit(0)),
    )
    lines = F.filter(F.split(at("t"), "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    step = step.withColumns({"_q_k": keys, "_q_l": lines}).withColumn("_q_s", F.sort_array(at("k")))
    again = F.size(F.filter(at("s"), lambda x, i: x == F.get(at("s"), i + 1))) > 0
    # Only texts that have a repeated window sort their windows together with the places.
    placed = F.when(again, F.sort_array(F.transform(at("k"), lambda x, i: F.struct(x.alias("k"), i.alias("i")))))
    step = step.withColumn("_q_p", placed)
    meets = lambda x, i: (i > 0) & (F.get(at("p"), F.greatest(i - 1, F.lit(0)))["k"] == x["k"]) | F.coalesce(F.get(at("p"), i + 1)["k"] == x["k"], F.lit(False))
    step = step.withColumn("_q_r", F.sort_array(F.transform(F.filter(at("p"), meets), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(at("r"), lambda x, i: F.coalesce(F.least(F.get(at("r"), i + 1) - x, F.lit(3)), F.lit(3))),
        F.lit(0),
        lambda a, x: a + x,
    )
    count = lambda kept: F.length(at("t")) - F.length(F.translate(at("t"), kept, ""))
    made = {
        "n_words": F.size(at("w")),
        "word_chars": F.length(F.translate(at("t"), BLANKS, "")),
        "n_symbols": count(SYMBOLS),
        "n_lines": F.size(at("l")),
        "n_dup_lines": F.size(at("l")) - F.size(F.array_distinct(at("l"))),
        "n_repeat_words": F.coalesce(covered, F.lit(0)),
        "n_capitals": F.length(F.regexp_replace(at("t"), r"[^\p{Lu}]+", "")),
        "n_marks": F.length(F.regexp_replace(at("t"), r"[\p{L}\p{M}\p{N}\s]+", "")),
    }
    # The row number keeps Catalyst from copying all of this into a filter on the verdict.
    return step.select(*columns, *[c.cast("long").alias(f"_q_{k}") for k, c in made.items()], F.monotonically_increasing_id().alias("_q_row"))


def votes() -> list[Column]:
    """A column for each of RULES: -1 bad, 1 good, 0 abstains."""
    q = lambda name: F.col(f"_q_{name}")

    def rule(x: Column, bad: Column, good: Column) -> Column:
        return F.when(q("n_words") == 0, 0).when(bad, -1).when(good, 1).otherwise(0)

    per_word = lambda name: q(name) / F.greatest(q("n_words"), F.lit(1))
    by_line = q("n_dup_lines") / F.greatest(q("n_lines"), F.lit(1))
    capitals = q("n_capitals") / F.greatest(q("word_chars"), F.lit(1))
    found = {
        "symbols": (per_word("n_symbols"), lambda x: x > 0.15, lambda x: x <= 0.05),
        "repetition": (per_word("n_repeat_words"), lambda x: x > 0.35, lambda x: x <= 0.1),
        "lines": (by_line, lambda x: x > 0.4, lambda x: x <= 0.1),
        "shouting": (capitals, lambda x: x > 0.5, lambda x: x <= 0.15),
        "marks": (per_word("n_marks"), lambda x: x > 0.35, lambda x: x <= 0.25),
        "word_length": (per_word("word_chars"), lambda x: (x < 2) | (x > 20), lambda x: (x >= 3) & (x <= 12)),
    }
    return [rule(x, bad(x), good(x)).alias(f"v_{name}") for name, (x, bad, good) in ((r, found[r]) for r in RULES)]


class VoteModel:
    """What the maximisation estimates: `good`, the share of good documents, and `odds[rule][vote]`, log P(vote | good) - log P(vote | bad)."""

    def __init__(self, good: float, odds: list[dict[int, float]]):
        self.good, self.odds = good, odds

    def posterior(self, vote: list[Column]) -> Column:
        """The probability that a document with these votes is good."""
        x = F.lit(math.log(self.good / (1 - self.good)))
        for v, odds in zip(vote, self.odds, strict=True):
            x = x + F.when(v == -1, odds[-1]).when(v == 1, odds[1]).otherwise(odds[0])
        return 1 / (1 + F.exp(-x))


def fit(features: DataFrame) -> VoteModel:
    """Estimate the model from the votes (columns v_...) on all rows.

    It begins with every bad vote taken at its word. An abstention is no evidence, a bad vote never counts in favour of a document
    and a good one never against it, whatever the estimates, so that the classes can't change places.
    """
    names = [f"v_{r}" for r in RULES]
    kept = Written(features.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "votes")
    patterns = kept.df.coalesce(1)  # at most 3^6 rows
    model = VoteModel(0.9, [{-1: -3.0, 0: 0.0, 1: 0.1} for _ in RULES])
    before, p = F.lit(-1.0), F.when(F.least(*names) < 0, 0.1).otherwise(0.95)
    for step in range(STEPS + 1):
        cast = patterns.select("n", p.alias("p"), before.alias("before"), F.posexplode(F.array(*names)).alias("rule", "vote"))
        sums = cast.groupBy("rule", "vote").agg(F.sum(F.col("n") * F.col("p")).alias("good"), F.sum(F.col("n") * (1 - F.col("p"))).alias("bad"), F.max(F.abs(F.col("p") - F.col("before"))).alias("moved"))
        rows = as_list(sums, "rule", "vote", "good", "bad", "moved")
        if step == STEPS or max((r[-1] for r in rows), default=0) < SETTLED:
            break
        got = {(r, v): (g, b) for r, v, g, b, _ in rows}
        # Each document votes once by each rule, so the first rule's sums are those of all documents.
        good, bad = (sum(got.get((0, v), (0, 0))[k] for v in (-1, 0, 1)) + 1 for k in (0, 1))
        odds = []
        for r in range(len(RULES)):
            of = {v: math.log((got.get((r, v), (0, 0))[0] + 1) / (good + 2)) - math.log((got.get((r, v), (0, 0))[1] + 1) / (bad + 2)) for v in (-1, 0, 1)}
            odds.append({-1: min(of[-1], 0.0), 0: 0.0, 1: max(of[1], 0.0)})
        model = VoteModel(good / (good + bad), odds)
        before, p = p, model.posterior([F.col(c) for c in names])
    kept.drop()
    return model


def base_failed() -> Column:
    """The hard limits: under 50 words, or more than half of the words in repeated windows."""
    q = lambda name: F.col(f"_q_{name}")
    return (q("n_words") < 50) | (100 * q("n_repeat_words") > 50 * q("n_words"))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with `_q_...` (the counts), `v_...` (the votes), `_p` (posterior probability of good quality), `_base_failed` and `_kept`.

    Rows are written with their counts, so that these are computed once, for the fit and for the result.
    """
    features = with_features(docs, text)
    rows = Written(features.select("*", *votes()), "judged").df
    p = fit(rows).posterior([F.col(f"v_{r}") for r in RULES])
    return rows.withColumns({"_p": p, "_base_failed": base_failed(), "_kept": ~base_failed() & (p >= KEEP_AT)})


def verdicts(docs: DataFrame) -> DataFrame:
    """The digest columns, a row for each of `docs`."""
    narrow = with_features(docs.select("doc_id", "text")).drop("text")
    rows = Written(narrow.select("*", *votes()), "quality").df
    p = fit(rows).posterior([F.col(f"v_{r}") for r in RULES])
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select(
        "doc_id",
        *[F.col(f"_q_{n}").alias(n) for n in names],
        base_failed().alias("base_failed"),
        (~base_failed() & (p >= KEEP_AT)).alias("kept"),
        F.round(p, 6).alias("p_good"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    return judge(docs.select(*[F.col(c).alias(f"_d_{c}") for c in docs.columns]), "_d_text").where("_kept").select(*[F.col(f"_d_{c}").alias(c) for c in docs.columns])
