"""Quality rules under weak supervision (DataFrame operations only).

Each rule votes good (1), bad (-1) or abstains (0) on a document. Rules overlap:
each defect is looked at by several, of unlike strictness. Documents are counted
by their pattern of votes, at most ``3 ** len(RULES)`` patterns, and
expectation-maximisation over that table of counts estimates how often each rule
votes against good and against bad documents, and the share of good ones. A
document's posterior probability of being good follows from its pattern; it is
kept where that is at least ``KEEP_AT`` and the base rules pass. So one vote
against is weighed: it isn't a veto. Every document enters the estimate.

The estimate starts from the same belief about each rule (``RATES``), which also
counts as ``BELIEF`` of the corpus's size in documents; a rule is taken to be at
least as ready to vote against a bad document as against a good one. Of the
starts in ``STARTS`` the one that ends at the most probable estimate counts.

All text statistics are computed inside the row from arrays: nothing is
exploded, so the only shuffle is the count by pattern; the statistics are written
once, so that texts are read once. Repeated windows are
found from one hash a word and one a window; a document whose windows are all
distinct (nearly all are) stops there.

Defined results: a null or empty text has no words, zeros everywhere, fails the
base rules and isn't kept. Repeated rows count each. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import materialise

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]"
#: Posterior probability of being good from which a document is kept.
KEEP_AT = 0.5
#: First belief about any rule: how often it votes against bad and against good documents, where it votes.
RATES = (0.4, 0.1)
#: Weight of that belief, as a share of the documents.
BELIEF = 0.05
#: Starts of the first of the two rates.
STARTS = (0.2, 0.3, 0.4, 0.5, 0.6)
ROUNDS = 500
#: Variety of words is asked of this many words at most, as it falls with length.
VARIED = 400

#: name -> (bad where, good where), over the statistics below; anything else abstains.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 20", "n_words >= 50"),
    "symbols": ("n_symbols > 0.25 * n_words", "n_symbols <= 0.02 * n_words"),
    "symbol_chars": ("n_symbols > 0.03 * word_chars", "n_symbols <= 0.005 * word_chars"),
    "letters": ("n_letter_words < 0.8 * n_words", "n_letter_words >= 0.95 * n_words"),
    "repeats": ("n_repeat_words > 0.2 * n_words", "n_repeat_words = 0"),
    "stutter": ("n_stutter > 0.1 * n_words", "n_stutter <= 0.02 * n_words"),
    "variety": (f"n_distinct < 0.3 * least(n_words, {VARIED})", f"n_distinct >= 0.5 * least(n_words, {VARIED})"),
    "lines": ("n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    "word_length": ("word_chars > 12 * n_words OR word_chars < 2 * n_words", "word_chars BETWEEN 3 * n_words AND 10 * n_words"),
    "capitals": ("n_capitals > 0.5 * word_chars", "n_capitals < 0.1 * word_chars"),
    "digits": ("n_digits > 0.2 * word_chars", "n_digits < 0.02 * word_chars"),
}


def _removed(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match an ASCII class."""
    return (F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))).cast("long")


def _let(value: Column, body) -> Column:
    """Bind a value once, so that a lambda that indexes it doesn't compute it again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(hashes: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``hashes`` has one a window, in order."""
    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def doubled(s: Column) -> Column:
        same = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["i"]))

    covered = F.aggregate(
        _let(pairs, doubled),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, i: F.struct(
            (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics that the rules read."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split("t", SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.when(
        F.size("w") >= WINDOW,
        _let(
            F.col("w"),
            lambda w: F.transform(
                F.sequence(F.lit(0), F.size(w) - WINDOW),
                lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]),
            ),
        ),
    ).otherwise(F.array().cast("array<long>"))
    return (
        docs.select("doc_id", text.alias("t"))
        .select("doc_id", "t", F.transform(words, lambda x: F.xxhash64(x)).alias("w"), lines.alias("lines"))
        .select(
            "doc_id",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.regexp_replace("t", SPACE + "+", "")).cast("long").alias("word_chars"),
            _removed(F.col("t"), r"[#*$%&|<>]+").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            windows.alias("hashes"),
            F.size(F.filter(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, y: x == y), lambda same: same)).cast("long").alias("n_stutter"),
            F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
            F.regexp_count("t", F.lit(r"\p{L}[^\x20\x09-\x0D]*")).cast("long").alias("n_letter_words"),
            F.size("lines").cast("long").alias("n_lines"),
            _removed(F.col("t"), "[A-Z]+").alias("n_capitals"),
            _removed(F.col("t"), "[0-9]+").alias("n_digits"),
        )
        .withColumn("n_repeat_words", repeat_words(F.col("hashes")))
        .drop("hashes")
    )


def with_votes(stats: DataFrame) -> DataFrame:
    votes = [
        F.when(F.expr(f"n_words = 0 OR ({bad})"), -1).when(F.expr(good), 1).otherwise(0).alias(name)
        for name, (bad, good) in RULES.items()
    ]
    return stats.select("*", *votes).withColumn("votes", F.concat_ws(",", *[F.col(name).cast("string") for name in RULES]))


Counts = list[tuple[tuple[int, ...], int]]
#: How often each rule votes against bad [0] and good [1] documents, where it votes.
Rates = tuple[list[float], list[float]]


def log_odds(k: int, vote: int, rates: Rates) -> float:
    """What a vote adds to the log odds of being good: nothing if it abstains."""
    bad, good = rates[0][k], rates[1][k]
    return 0.0 if not vote else math.log(good / bad) if vote < 0 else math.log((1 - good) / (1 - bad))


def posterior(pattern: tuple[int, ...], prior: float, rates: Rates) -> float:
    odds = math.log(prior / (1 - prior)) + sum(log_odds(k, v, rates) for k, v in enumerate(pattern))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def _climb(votes: np.ndarray, n: np.ndarray, first: float) -> tuple[float, Rates, float]:
    """Share of good documents, rates and log probability that one start ends at; ``votes`` has a row a pattern, ``n`` the documents of each."""
    total = float(n.sum())
    belief, against, for_ = BELIEF * total, (votes < 0).astype(float), (votes > 0).astype(float)
    prior, rates = 0.5, np.array([[first] * votes.shape[1], [RATES[1]] * votes.shape[1]])

    def parts() -> np.ndarray:
        """Log probability of each pattern together with each class."""
        return np.log([1 - prior, prior]) + against @ np.log(rates).T + for_ @ np.log(1 - rates).T

    for _ in range(ROUNDS):
        p = parts()
        good = np.exp(p[:, 1] - np.logaddexp(p[:, 0], p[:, 1]))
        mass = np.stack([n * (1 - good), n * good])
        no = mass @ against + belief * np.array(RATES)[:, None]
        cast = mass @ (against + for_) + belief
        new = no / cast
        new = np.where(new[0] < new[1], no.sum(axis=0) / cast.sum(axis=0), new)
        share = float((mass[1].sum() + 1) / (total + 2))
        moved = max(abs(share - prior), float(np.abs(new - rates).max()))
        prior, rates = share, new
        if moved < 1e-9:
            break
    p = parts()
    held = belief * (np.array(RATES)[:, None] * np.log(rates) + (1 - np.array(RATES)[:, None]) * np.log(1 - rates)).sum()
    return prior, (rates[0].tolist(), rates[1].tolist()), float(held + n @ np.logaddexp(p[:, 0], p[:, 1]))


def estimate(counts: Counts) -> tuple[float, Rates]:
    """Share of good documents and the rules' rates: expectation-maximisation over patterns of votes and their counts."""
    if not counts:
        return 0.5, ([RATES[0]] * len(RULES), [RATES[1]] * len(RULES))
    votes, n = np.array([pattern for pattern, _ in counts], np.int8), np.array([n for _, n in counts], float)
    prior, rates, _ = max((_climb(votes, n, first) for first in STARTS), key=lambda x: round(x[2], 6))
    return prior, rates


def judge(docs: DataFrame) -> DataFrame:
    """Statistics, base_failed, p_good and kept of every row of ``docs``."""
    voted = materialise(with_votes(statistics(docs)), "quality")
    counts = [
        (tuple(map(int, r.votes.split(","))), r["count"]) for r in voted.groupBy("votes").count().orderBy("votes").collect()
    ]  # at most 3 ** len(RULES) rows
    prior, rates = estimate(counts)
    odds = F.lit(math.log(prior / (1 - prior)))
    for k, name in enumerate(RULES):
        odds = odds + F.when(F.col(name) > 0, log_odds(k, 1, rates)).when(F.col(name) < 0, log_odds(k, -1, rates)).otherwise(0.0)
    return (
        voted.withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .withColumn("base_failed", F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= KEEP_AT))
    )
