"""Mixing sources to target weights by iterative proportional fitting (DataFrame operations only).

Tokens are counted by cell (source, language, topic) over all documents. The
cells' weights are raked: scaled in turn so that their sums by source, by
language and by topic meet the targets, until none is off by more than
``TOLERANCE``. A document is then kept with the probability that its cell's
raked weight asks for, scaled and held to one at most so that the expected
tokens are ``keep`` of the corpus. The draw is a hash of doc_id and seed, so it is the same on every run.

Targets are shares of tokens. Where none are given, the corpus's own shares are
flattened: share ** TEMPERATURE, normalised.

The topic is fitted to the corpus (``topics``): clusters of hashed term vectors.

Counting shuffles one row a cell and task. Cells are few (sources x languages x
topics); up to ``MAX_CELLS`` of them are raked on the driver. Beyond that they
are raked by DataFrame aggregation and joins, cutting lineage at each sweep, to
the same tolerance and within the same numbers of sweeps and steps.

Defined results: null source, lang or text are values of their own (topic of a
null text, or one without a word: ``empty``); a target for a value that doesn't occur is left out and
the rest renormalised; equal doc_ids are drawn alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import topics
from millrace.session import cut, materialise

AXES = ("source", "lang", "topic")
TEMPERATURE = {"source": 0.5, "lang": 0.7, "topic": 0.7}
KEEP = 0.7
#: At most so many sweeps, and steps of calibration.
SWEEPS, STEPS = 100, 60
TOLERANCE = 1e-9
MAX_CELLS = 100_000
NONE = "\u0000none"

Marginals = dict[str, dict[str, float]]


def tokens() -> Column:
    """Words separated by single white space characters, runs of which count as one."""
    return F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def cells(docs: DataFrame, weight: Column, axes: dict[str, Column | None]) -> tuple[DataFrame, dict[str, Column]]:
    """doc_id, the axes and the weight of each document, written once, and the axes as expressions over ``docs``.

    An axis without an expression is the fitted topic; its vectors are written with
    the rest, so that texts aren't read again to fit it.
    """
    fitted = [a for a, e in axes.items() if e is None]
    given = [F.coalesce(e.cast("string"), F.lit(NONE)).alias(a) for a, e in axes.items() if e is not None]
    extra = [topics.vector(F.col("text")).alias("v"), F.xxhash64("text", F.lit(5)).alias("key")] if fitted else []
    rows = materialise(docs.select("doc_id", *given, *extra, F.coalesce(weight, F.lit(0)).cast("long").alias("tokens")), "mix")
    if not fitted:
        return rows, axes
    centres = topics.fit(rows)
    rows = rows.withColumns({a: topics.label(F.col("v"), centres) for a in fitted}).select("doc_id", *axes, "tokens")
    return materialise(rows, "mix-topics"), {a: topics.topic(F.col("text"), centres) if e is None else e for a, e in axes.items()}


def flattened(sums: Marginals) -> Marginals:
    """Default targets: the shares raised to the temperature of their axis."""
    out: Marginals = {}
    for axis, by in sums.items():
        power = {v: x ** TEMPERATURE.get(axis, 1.0) for v, x in by.items() if x > 0}
        out[axis] = {v: p / sum(power.values()) for v, p in power.items()}
    return out


def rake(table: dict[tuple[str, ...], float], axes: tuple[str, ...], targets: Marginals, tolerance: float = TOLERANCE) -> dict[tuple[str, ...], float]:
    """Weights of the cells, in shares, with the margins that are asked for."""
    total = sum(table.values())
    w = {k: x / total for k, x in sorted(table.items()) if x > 0}
    for _ in range(SWEEPS if w else 0):
        off = 0.0
        for n, axis in enumerate(axes):
            sums: dict[str, float] = defaultdict(float)
            for k, x in w.items():
                sums[k[n]] += x
            want = {v: targets[axis][v] for v in sums if targets[axis].get(v, 0) > 0}
            scale = sum(want.values())
            off = max([off, *(abs(want[v] / scale - sums[v]) for v in want)])
            w = {k: x * want[k[n]] / scale / sums[k[n]] for k, x in w.items() if k[n] in want}
        if off < tolerance:
            break
    return w


def calibrated(spent: Callable[[float], float], budget: float, steps: int) -> float:
    """The factor on the ratios at which the expected tokens meet the budget; ``spent`` grows with it."""
    lo, hi = 0.0, 1.0
    while spent(hi) < budget and hi < 1e9:
        lo, hi = hi, hi * 4
    for _ in range(steps):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if spent(mid) < budget else (lo, mid)
    return hi


def probabilities(table: dict[tuple[str, ...], float], w: dict[tuple[str, ...], float], keep: float) -> dict[tuple[str, ...], float]:
    """Inclusion probability of each cell's documents, in proportion to raked weight over tokens, at most one."""
    total = sum(table.values())
    ratio = {k: w[k] * total / table[k] for k in w}
    budget = keep * sum(table[k] for k in w)
    c = calibrated(lambda c: sum(min(1.0, c * r) * table[k] for k, r in ratio.items()), budget, STEPS) if w else 0.0
    return {k: min(1.0, c * r) for k, r in ratio.items()}


def _raked_frame(counts: DataFrame, axes: tuple[str, ...], targets: Marginals | None, keep: float, tolerance: float) -> DataFrame:
    """``rake`` and ``probabilities`` for many cells: each sweep is an aggregation and a join by axis."""
    total = counts.agg(F.sum("tokens")).first()[0] or 1
    w = counts.where("tokens > 0").withColumn("w", F.col("tokens") / total)
    goals = {}
    for axis in axes:
        own = w.groupBy(axis).agg(F.sum("tokens").cast("double").alias("n"))
        if targets and axis in targets:
            given = counts.sparkSession.createDataFrame(list(targets[axis].items()), f"{axis} string, goal double").where("goal > 0")
            own = own.join(given, axis)
        else:
            own = own.withColumn("goal", F.pow("n", F.lit(TEMPERATURE.get(axis, 1.0))))
        scale = own.agg(F.sum("goal")).first()[0] or 1.0
        goals[axis] = cut(own.select(axis, (F.col("goal") / scale).alias("goal")))
    for _ in range(SWEEPS):
        off = 0.0
        for axis in axes:
            sums = cut(w.groupBy(axis).agg(F.sum("w").alias("s")).join(goals[axis], axis))
            off = max(off, sums.agg(F.max(F.abs(F.col("goal") - F.col("s")))).first()[0] or 0.0)
            w = w.join(sums, axis).withColumn("w", F.col("w") * F.col("goal") / F.col("s")).drop("s", "goal")
        w = cut(w)
        if off < tolerance:
            break
    ratio = F.col("w") * F.lit(float(total)) / F.col("tokens")
    spent = lambda c: w.agg(F.sum(F.least(F.lit(1.0), ratio * c) * F.col("tokens"))).first()[0] or 0.0
    budget = keep * (w.agg(F.sum("tokens")).first()[0] or 0)
    c = calibrated(spent, budget, STEPS) if budget else 0.0
    return w.select(*axes, F.least(F.lit(1.0), ratio * c).alias("p"))


def chances(
    rows: DataFrame, names: tuple[str, ...], targets: Marginals | None, keep: float, max_cells: int, tolerance: float = TOLERANCE,
) -> DataFrame:
    """The axes and p of each cell; a broadcast is asked for where their number has been checked."""
    counts = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    found = counts.limit(max_cells + 1).collect()
    if len(found) > max_cells:
        return _raked_frame(cut(counts), names, targets, keep, tolerance)
    table = {tuple(r[a] for a in names): float(r.tokens) for r in found}
    sums: Marginals = {a: defaultdict(float) for a in names}
    for k, x in sorted(table.items()):
        for a, v in zip(names, k, strict=True):
            sums[a][v] += x
    p = probabilities(table, rake(table, names, flattened(sums) | (targets or {}), tolerance), keep)
    kinds = ", ".join(f"{a} string" for a in names) + ", p double"
    return F.broadcast(rows.sparkSession.createDataFrame([(*k, x) for k, x in p.items()], kinds))


def drawn(seed: int) -> Column:
    """A number in [0, 1) from doc_id and seed."""
    key = F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2**32


def default_axes() -> dict[str, Column | None]:
    return {"source": F.col("source"), "lang": F.col("lang"), "topic": None}


def mix(
    docs: DataFrame, targets: Marginals | None = None, keep: float = KEEP, seed: int = 0,
    weight: Column | None = None, axes: dict[str, Column | None] | None = None, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """doc_id, axes, tokens, p (inclusion probability) and kept of every row of ``docs``."""
    names = tuple(axes or default_axes())
    rows, _ = cells(docs, tokens() if weight is None else weight, axes or default_axes())
    out = rows.join(chances(rows, names, targets, keep, max_cells), list(names), "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    back = [F.when(F.col(a) != NONE, F.col(a)).alias(a) for a in names]
    return out.select("doc_id", *back, "tokens", "p", (drawn(seed) < F.col("p")).alias("kept"))


def sample(
    docs: DataFrame, targets: Marginals | None = None, keep: float = KEEP, seed: int = 0,
    weight: Column | None = None, axes: dict[str, Column | None] | None = None, max_cells: int = MAX_CELLS,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, texts and all; where cells are few, the texts stay where they are."""
    counted, axes = cells(docs, tokens() if weight is None else weight, axes or default_axes())
    inner = {f"__axis_{n}": e for n, e in enumerate(axes.values())}
    p = chances(counted, tuple(axes), targets, keep, max_cells)
    for name, axis in zip(inner, axes, strict=True):
        p = p.withColumnRenamed(axis, name)
    keyed = docs.withColumns({name: F.coalesce(e.cast("string"), F.lit(NONE)) for name, e in inner.items()})
    return keyed.join(p.withColumnRenamed("p", "__p"), list(inner)).where(drawn(seed) < F.col("__p")).select(*docs.columns)
