"""Mixing sources to target weights by entropy balancing.

A document's size is its number of words. Each source has a target of words. Among all rates with the source's words at its
target and no rate above a limit, entropy balancing takes the ones closest to 1 in relative entropy: exp(k * size), cut at
the limit, with one multiplier per source. The convex dual is solved by Newton iterations, kept within a bracket: each is an
aggregate over the histogram of sizes per source, the driver sees two sums per source. Sums are exact decimals, so reruns
agree to the last digit.

Rates become copies: the whole part, and one copy more where a hash of the document lies below the fractional part plus an
offset. The offset of a source is the one that brings its words nearest to the target; it is found by counting words per
interval of offsets, each time within the interval before. Then, a few times, the source takes one copy more or less of the document whose size comes nearest to what
is still missing or too much, unless that makes the difference larger.

Results: a null text has size 0 and takes nothing. A null source is a source of its own, the last one. Rows of equal id and
text get equal copies. An empty table gives an empty table. What reaches the driver is a few numbers per source.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.core import fresh, written

#: Weights of sources in order of their names, repeating, and the most copies of a document.
WEIGHTS, MOST_COPIES = (5, 2, 1), 3
#: A dual is solved when the words differ from the target by this part; iterations end in any case.
PRECISION, MOST_STEPS = 1e-7, 60
#: Intervals of offsets per round, and rounds.
_INTERVALS, _ROUNDS = 512, 4
#: Single copies added or taken away per source at the end.
_TOUCHES = 3
WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Source:
    number: int
    name: str | None
    size: int
    documents: int
    target: float


def targets(sizes: Sequence[int], weights: Sequence[int] = WEIGHTS, limit: int = MOST_COPIES) -> list[float]:
    """Shares of the sum of sizes by weight; what exceeds ``limit`` times a size goes to the others by weight."""
    weight = [weights[k % len(weights)] for k in range(len(sizes))]
    fixed: dict[int, int] = {}
    while True:
        rest = sum(sizes) - sum(fixed.values())
        open_weight = sum(w for k, w in enumerate(weight) if k not in fixed)
        share = {k: Fraction(rest * w, open_weight) for k, w in enumerate(weight) if k not in fixed}
        above = {k: limit * sizes[k] for k, x in share.items() if x > limit * sizes[k]}
        if not above:
            return [float(fixed[k] if k in fixed else share[k]) for k in range(len(sizes))]
        fixed |= above


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _multipliers(histogram: DataFrame, sources: list[Source]) -> dict[int, float]:
    """The dual's solution: exponents per mean size, infinite where a target is the limit itself."""
    spark = histogram.sparkSession
    mean = {s.number: s.size / s.documents for s in sources if s.size}
    k = {n: 0.0 for n in mean}
    low, high = {n: -math.inf for n in mean}, {n: math.inf for n in mean}
    todo = {s.number: s.target for s in sources if s.size}
    for n, s in {s.number: s for s in sources if s.size and s.target >= MOST_COPIES * s.size}.items():
        k[n] = math.inf
        todo.pop(n)
    for _ in range(MOST_STEPS):
        if not todo:
            break
        state = _local(spark, [(n, k[n] / mean[n]) for n in todo], "number int, exponent double")
        rate = F.least(F.lit(float(MOST_COPIES)), F.exp(F.least(F.col("exponent") * F.col("size"), F.lit(700.0))))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(rate < MOST_COPIES, words * F.col("size")).otherwise(0.0)
        sums = histogram.join(state, "number").groupBy("number").agg(
            F.sum(words.cast("decimal(38,6)")).cast("double").alias("words"),
            F.sum(slope.cast("decimal(38,6)")).cast("double").alias("slope"),
        )
        for r in sums.collect():
            n, gap = r.number, r.words - todo[r.number]
            if abs(gap) <= PRECISION * todo[n]:
                todo.pop(n)
                continue
            if gap > 0:
                high[n] = k[n]
            else:
                low[n] = k[n]
            step = k[n] - gap / (r.slope / mean[n]) if r.slope > 0 else math.nan
            if not low[n] < step < high[n]:
                if math.isinf(low[n]) or math.isinf(high[n]):
                    step = k[n] - math.copysign(max(1.0, abs(k[n])), gap)
                else:
                    step = (low[n] + high[n]) / 2
            k[n] = step
    return {n: k[n] / mean[n] for n in mean}


def _offsets(rated: DataFrame, sources: list[Source]) -> dict[int, float]:
    """Per source the offset that brings the words taken nearest to the target."""
    spark = rated.sparkSession
    base = {r.number: r.words for r in rated.groupBy("number").agg(F.sum(F.col("whole") * F.col("size")).alias("words")).collect()}
    low, taken = {s.number: -1.0 for s in sources}, {s.number: base.get(s.number, 0) or 0 for s in sources}
    target, width, best = {s.number: s.target for s in sources}, 2.0, {}
    open_rows = rated.filter("whole < rate and size > 0")
    for _ in range(_ROUNDS):
        step = width / _INTERVALS
        state = _local(spark, [(n, low[n]) for n in low], "number int, low double")
        at = F.floor((F.col("place") - F.col("low")) / step)
        counted = (
            open_rows.join(state, "number").withColumn("at", at).filter(f"at >= 0 and at < {_INTERVALS}")
            .groupBy("number", "at").agg(F.sum("size").alias("words"))
            .withColumn("words", F.sum("words").over(Window.partitionBy("number").orderBy("at")))
        )
        goal = _local(spark, [(n, target[n] - taken[n]) for n in low], "number int, goal double")
        passed = {r.number: r for r in counted.join(goal, "number").groupBy("number").agg(
            F.max(F.when(F.col("words") <= F.col("goal"), F.struct("at", "words"))).alias("under"),
            F.min(F.when(F.col("words") > F.col("goal"), F.struct("at", "words"))).alias("over"),
        ).collect()}
        for n in low:
            r = passed.get(n)
            if r is None:
                continue
            under = r.under.words if r.under else 0
            edges = [(abs(target[n] - taken[n] - under), low[n] + step * ((r.under.at if r.under else -1) + 1))]
            if r.over:
                edges.append((abs(target[n] - taken[n] - r.over.words), low[n] + step * (r.over.at + 1)))
            best[n] = min([*edges, *([best[n]] if n in best else [])], key=lambda x: x[0])
            low[n] += step * (r.over.at if r.over else _INTERVALS)
            taken[n] += under
        width = step
    return {n: best[n][1] if n in best else 0.0 for n in low}


def _touched(copied: DataFrame, sources: list[Source]) -> dict[int, dict[int, int]]:
    """Per source the keys of documents that get a copy more or less, so that the words come nearer to the target."""
    spark = copied.sparkSession
    chosen: dict[int, dict[int, int]] = {s.number: {} for s in sources}
    last: dict[int, tuple[int, float]] = {}
    target = {s.number: s.target for s in sources}
    for turn in range(_TOUCHES + 1):
        sums = _with_touches(copied, chosen).groupBy("number").agg(F.sum(F.col("copies") * F.col("size")).alias("words")).collect()
        gaps = {r.number: target[r.number] - r.words for r in sums}
        for n, (key, before) in list(last.items()):
            if abs(gaps[n]) >= abs(before):
                chosen[n].pop(key)
                gaps.pop(n)
        last = {}
        if turn == _TOUCHES or not gaps:
            break
        state = _local(spark, list(gaps.items()), "number int, gap double")
        allowed = F.when(F.col("gap") > 0, F.col("copies") < MOST_COPIES).otherwise(F.col("copies") > 0)
        done = [k for keys in chosen.values() for k in keys]
        near = F.abs(F.abs("gap") - F.col("size"))
        best = (
            copied.join(state, "number").filter(allowed & (F.col("size") > 0) & (near < F.abs("gap")) & ~F.col("key").isin(done))
            .groupBy("number").agg(F.min(F.struct(near.alias("near"), "key")).alias("best"))
        )
        for r in best.collect():
            chosen[r.number][r.best.key] = 1 if gaps[r.number] > 0 else -1
            last[r.number] = (r.best.key, gaps[r.number])
    return chosen


def _with_touches(copied: DataFrame, chosen: dict[int, dict[int, int]]) -> DataFrame:
    rows = [(n, key, more) for n, keys in chosen.items() for key, more in keys.items()]
    if not rows:
        return copied
    touches = _local(copied.sparkSession, rows, "number int, key long, more long")
    touched = copied.join(touches, ["number", "key"], "left")
    return touched.withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, key (a hash of id and text), size, source_size, target, rate, copies."""
    spark = docs.sparkSession
    base = written(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("key"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ), "sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    goals = targets([r.size for r in sums]) if sums else []
    sources = [Source(k, r.source, r.size, r.n, goal) for k, (r, goal) in enumerate(zip(sums, goals))]
    numbers = _local(spark, [(s.number, s.name, s.size, s.target) for s in sources], "number int, name string, source_size long, target double")
    rows = base.join(numbers, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    histogram = written(rows.groupBy("number", "size").agg(F.count("*").alias("n")), "histogram")
    exponents = _multipliers(histogram, sources)
    state = _local(spark, [(s.number, exponents.get(s.number, 0.0)) for s in sources], "number int, exponent double")
    exponent = F.when(F.col("size") > 0, F.least(F.col("exponent") * F.col("size"), F.lit(700.0))).otherwise(0.0)
    rated = (
        rows.join(state, "number").withColumn("rate", F.least(F.lit(float(MOST_COPIES)), F.exp(exponent)))
        .withColumn("whole", F.floor("rate"))
        .withColumn("place", F.pmod("key", F.lit(1 << 40)) / float(1 << 40) - (F.col("rate") - F.col("whole")))
    )
    found = _offsets(rated, sources)
    offsets = _local(spark, list(found.items()), "number int, offset double")
    more = (F.col("whole") < F.col("rate")) & (F.col("place") < F.col("offset"))
    copies = (F.col("whole") + more.cast("long")).cast("long").alias("copies")
    copied = written(rated.join(offsets, "number").select("number", "id", "key", "size", "source_size", "target", "rate", copies), "copies")
    out = _with_touches(copied, _touched(copied, sources))
    return out.select("id", "key", "size", "source_size", "target", "rate", "copies").withColumnRenamed("id", id_col)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents, each as often as it is taken, with all their columns."""
    same_id, key, copies, copy = (fresh(docs, n) for n in ("id", "key", "copies", "copy"))
    plans = plan(docs, id_col, text_col, source_col).filter("copies > 0")
    plans = plans.select(F.col(id_col).alias(same_id), F.col("key").alias(key), F.col("copies").cast("int").alias(copies)).distinct()
    same = docs[id_col].eqNullSafe(plans[same_id]) & (F.xxhash64(docs[id_col], docs[text_col]) == plans[key])
    many = F.explode(F.array_repeat(F.lit(1), F.col(copies)))
    return docs.join(plans, same).withColumn(copy, many).select(*docs.columns)
