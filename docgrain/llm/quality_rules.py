"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (1), junk (-1) or abstains (0) on a text, and rules vote both ways. A hidden class, good or junk, is
assumed of which each vote is a noisy sign: a rule that votes says junk with one probability on good texts and another on junk. These
and the share of good texts are estimated by expectation-maximisation over the counts of vote patterns, without labels; that a
rule abstains says nothing, in the estimate and in the verdict. A text is kept if the posterior probability that it is good is at
least one half and the hard base rule does not reject it. What the base rule rejects is not in the estimate.

One junk vote does not reject a text, nor do all good votes but one keep it: what a vote weighs is learned. The prior counts as
PRIOR_ROWS texts, so it decides on empty and tiny tables only.

The counts of patterns, at most 3 ** len(rules()), are all that reaches the driver. Null text has no words and fails the
base rule. A null doc_id stays null; repeated rows count each; other columns are carried if asked for by name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, shielded

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 5
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_upper", "n_stops", "n_filled_lines", "n_distinct")


def with_features(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns and the counts above, one row for each row; no shuffle.

    Words that stand in a window of five words found twice: windows are hashed to 64 bits, sorted with their places
    inside the row, and the places of equal neighbours cover their words. All of it is linear or a sort in the text.
    """
    base = docs.select(*[F.col(f"`{c}`").alias(f"dg_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col(text), F.lit("")).alias("dg_t"))
    held = [f"dg_c{i}" for i in range(len(carry))]
    words = base.select(*held, "dg_t", F.array_remove(F.split("dg_t", SPACE), "").alias("dg_w"), F.filter(F.split("dg_t", "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "").alias("dg_l"))
    counted = words.select(
        *held,
        F.size("dg_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("dg_t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("dg_t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("dg_l") - F.size(F.array_distinct("dg_l"))).cast("long").alias("n_dup_lines"),
        (F.length("dg_t") - F.length(F.regexp_replace("dg_t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        F.regexp_count("dg_t", F.lit(r"[.!?](?=[\x20\x09-\x0D]|$)")).cast("long").alias("n_stops"),
        F.size("dg_l").cast("long").alias("n_filled_lines"),
        F.transform("dg_w", lambda x: F.xxhash64(x)).alias("dg_h"),
    )
    n = WINDOW
    windows = F.when(
        F.size("dg_h") > n,
        F.transform(F.slice("dg_h", 1, F.greatest(F.size("dg_h") - F.lit(n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("dg_h", i + k) for k in range(1, n)])),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = counted.select(*held, *FEATURES[:-1], *MORE[:-1], F.size(F.array_distinct("dg_h")).cast("long").alias("n_distinct"), windows.alias("dg_v"))
    sorted_ = hashed.select(
        *held, *FEATURES[:-1], *MORE,
        F.when(F.size(F.array_distinct("dg_v")) < F.size("dg_v"), F.sort_array(F.transform("dg_v", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("dg_s"),
    )
    same = lambda i, j: F.get("dg_s", i)["h"] == F.get("dg_s", j)["h"]
    twice = F.filter("dg_s", lambda x, i: F.coalesce(same(i, i + 1), F.lit(False)) | ((i > 0) & F.coalesce(same(i, i - 1), F.lit(False))))
    placed = sorted_.select(*held, *FEATURES[:-1], *MORE, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("dg_p"))
    covered = F.aggregate(F.transform("dg_p", lambda x, i: F.coalesce(F.least(F.lit(n), F.get("dg_p", i + 1) - x), F.lit(n))), F.lit(0).cast("long"), lambda a, x: a + x)
    return placed.select(*[F.col(f"dg_c{i}").alias(c) for i, c in enumerate(carry)], *FEATURES[:-1], F.coalesce(covered, F.lit(0).cast("long")).alias(FEATURES[-1]), *MORE)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def vote(junk: Column, good: Column) -> Column:
    return F.when(junk, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Each rule as a column of votes, over the counts of with_features."""
    n, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_filled_lines"), F.lit(1))
    symbols, upper, stops = F.col("n_symbols") / n, F.col("n_upper") / chars, F.col("n_stops") / n
    dup, repeat, kinds = F.col("n_dup_lines") / lines, F.col("n_repeat_words") / n, F.col("n_distinct") / n
    mean, short, long = chars / n, n < 20, n >= 30
    return {
        "length": vote(short, n >= 60),
        "word_length": vote((mean < 3) | (mean > 6.5), (mean >= 4.3) & (mean <= 6)),
        "symbols": vote(symbols > 0.1, symbols < 0.02),
        "shouting": vote(upper > 0.3, upper < 0.1),
        "stops": vote(~short & ((stops < 0.03) | (stops > 0.4)), (stops >= 0.05) & (stops <= 0.2)),
        "same_lines": vote((dup > 0.3) & (F.col("n_dup_lines") > 1), (lines >= 4) & (F.col("n_dup_lines") == 0)),
        "repetition": vote(repeat > 0.1, long & (repeat < 0.02)),
        "kinds": vote(long & (n < 2000) & (kinds < 0.55), long & (kinds > 0.65)),
    }


#: Before any evidence: the share of good texts, and how often a vote of any rule says junk of either class.
PRIOR_GOOD, PRIOR_JUNK_VOTE = 0.9, {True: 0.05, False: 0.5}
#: The prior counts as so many texts, whatever the size of the table.
PRIOR_ROWS = 20.0


def estimate(patterns: list[tuple[tuple[int, ...], int]], n_rules: int, rounds: int = 1000) -> tuple[float, list[dict[bool, float]]]:
    """Expectation-maximisation over (votes, count): the share of good texts, and for each rule the share of junk votes among its votes on either class.

    Both steps are of one model: votes are independent given the class, abstentions ignored. An empty table gives the prior itself.
    """
    prior_mass = {True: PRIOR_ROWS * PRIOR_GOOD, False: PRIOR_ROWS * (1 - PRIOR_GOOD)}
    good, tables = PRIOR_GOOD, [dict(PRIOR_JUNK_VOTE) for _ in range(n_rules)]
    for _ in range(rounds):
        mass = dict(prior_mass)
        junk = [{c: PRIOR_ROWS * PRIOR_JUNK_VOTE[c] for c in (True, False)} for _ in range(n_rules)]
        cast = [{c: PRIOR_ROWS for c in (True, False)} for _ in range(n_rules)]
        for votes, count in patterns:
            p = posterior(votes, good, tables)
            for c, share in ((True, p * count), (False, (1 - p) * count)):
                mass[c] += share
                for r, v in enumerate(votes):
                    if v:
                        cast[r][c] += share
                        junk[r][c] += share * (v < 0)
        before, good = good, mass[True] / (mass[True] + mass[False])
        after = [{c: j[c] / n[c] for c in (True, False)} for j, n in zip(junk, cast)]
        moved = max([abs(good - before), *(abs(a[c] - b[c]) for a, b in zip(after, tables) for c in a)])
        tables = after
        if moved < 1e-9:
            break
    return good, tables


def weights(tables) -> list[tuple[float, float]]:
    """Log odds for good that a junk vote and a good vote of each rule add."""
    return [(math.log(t[True] / t[False]), math.log((1 - t[True]) / (1 - t[False]))) for t in tables]


def posterior(votes, good: float, tables) -> float:
    x = math.log(good / (1 - good))
    for v, (junk, fine) in zip(votes, weights(tables)):
        x += junk if v < 0 else fine if v > 0 else 0.0
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judged(docs: DataFrame, carry: list[str], text: str = "text") -> DataFrame:
    """The carried columns, the counts, base_failed, quality (the posterior that the text is good) and kept."""
    named = rules()
    # The counts are written once: the patterns and the verdicts read them.
    rows = saved(with_features(docs, carry, text), "quality")
    votes = [v.alias(f"dg_v{i}") for i, v in enumerate(named.values())]
    keys = [f"dg_v{i}" for i in range(len(named))]
    patterns = [(tuple(x[k] for k in keys), x["dg_n"]) for x in rows.where(~base_failed()).select(*votes).groupBy(*keys).agg(F.count(F.lit(1)).alias("dg_n")).collect()]
    good, tables = estimate(sorted(patterns), len(named))
    odds = F.lit(math.log(good / (1 - good)))
    for v, (junk, fine) in zip(named.values(), weights(tables)):
        odds = odds + F.when(v == -1, F.lit(junk)).when(v == 1, F.lit(fine)).otherwise(F.lit(0.0))
    return rows.withColumn("base_failed", base_failed()).withColumn("quality", F.round(1 / (1 + F.exp(-odds)), 9)).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def accept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows that are kept, all columns as they came."""
    plain, names, back = shielded(docs)
    return back(judged(plain, plain.columns, names[text]).where("kept"))
