"""Performance terms: differences, repeat noise, thresholds, materiality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import strictest
from ..sources.tables import written


def term_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join of terms (key, kind, parent, value): status paired, appeared, disappeared or not_comparable (kind or parent differ; parents compare null-safe); delta and pct (null at base 0) only where paired."""
    b = before.select(*key, F.col("kind").alias("b_kind"), F.col("parent").alias("b_parent"), F.col("value").alias("before"))
    a = after.select(*key, F.col("kind").alias("a_kind"), F.col("parent").alias("a_parent"), F.col("value").alias("after"))
    same = (F.col("b_kind") == F.col("a_kind")) & F.col("b_parent").eqNullSafe(F.col("a_parent"))
    status = F.when(F.col("b_kind").isNull(), "appeared").when(F.col("a_kind").isNull(), "disappeared").when(same, "paired").otherwise("not_comparable")
    out = b.join(a, key, "full_outer").withColumn("status", status)
    delta = F.when(F.col("status") == "paired", F.col("after") - F.col("before"))
    return out.withColumn("delta", delta).withColumn("pct", F.when(F.col("before") != 0, 100 * delta / F.col("before")))


def repeat_noise(repeats: DataFrame, key: list[str]) -> DataFrame:
    """Range of each term over repeats (run, key, kind, parent, value), only for terms in every repeat with one kind and parent."""
    runs = repeats.agg(F.count_distinct("run").alias("_runs"))
    seen = repeats.groupBy(*key).agg((F.max("value") - F.min("value")).alias("noise"), F.count_distinct("run").alias("_n"), F.count(F.lit(1)).alias("_rows"), F.count_distinct("kind").alias("_kinds"), F.count_distinct(F.coalesce(F.col("parent"), F.lit("\0"))).alias("_parents"))
    return seen.crossJoin(F.broadcast(runs)).where("_n = _runs and _rows = _runs and _kinds = 1 and _parents = 1").select(*key, "noise")


def threshold(noise: Column, quantum: Column, frame: Column, k: float = 3.0, ticks: float = 2.0, min_ms: float = 0.05, pct: float = 1.0) -> Column:
    """The largest of k noise ranges, timer ticks, and the least material amount; unknown if any of them is."""
    return strictest(k * noise, ticks * quantum, F.when(frame.isNotNull(), F.greatest(F.lit(min_ms), pct / 100 * frame)))


def beyond_noise(delta: Column, limit: Column) -> Column:
    """Strictly beyond; null while either is unknown."""
    return F.abs(delta) > limit


def additive(terms: DataFrame, group: list[str]) -> DataFrame:
    """Sum of the terms that are no scopes, and what the frame has left."""
    total = F.sum(F.when(F.col("kind") != "scope", F.col("value")).otherwise(0.0))
    return terms.groupBy(*group).agg(total.alias("additive"), F.max("frame").alias("frame")).withColumn("remainder", F.col("frame") - F.col("additive"))


def top_terms(diff: DataFrame, group: list[str], n: int) -> DataFrame:
    """The n largest changes of each group, by size and then by id."""
    w = Window.partitionBy(*group).orderBy(F.abs("delta").desc(), "id")
    return diff.where("delta is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def by_change(counters: DataFrame, group: list[str]) -> DataFrame:
    """Counters in order of percent change; unknown changes last."""
    w = Window.partitionBy(*group).orderBy(F.coalesce(F.abs("pct"), F.lit(-1.0)).desc(), "counter")
    return counters.withColumn("place", F.row_number().over(w))


def selected_ancestors(terms: DataFrame, selected: DataFrame, depth: int = 16) -> DataFrame:
    """Nearest selected ancestor-or-self of every term (id, parent), looked for in so many terms from itself upwards; a cycle ends there with null.

    Ways of 2^n terms are put together from two of 2^(n - 1), each a table of its own; only those that found nothing and are not at an end go on."""
    if depth < 1:
        return terms.select("id", F.lit(None).cast("string").alias("ancestor"))
    chosen = selected.select(F.col("id").alias("_s")).distinct().hint("merge")
    # Parents that are chosen but no terms end a way too.
    one = terms.select("id", "parent", F.lit(True).alias("term")).join(chosen, F.col("id") == F.col("_s"), "full_outer")
    one = written(one.select(F.coalesce("id", "_s").alias("id"), F.when(F.col("_s").isNull(), F.col("parent")).alias("at"), F.col("_s").alias("ancestor"), F.coalesce("term", F.lit(False)).alias("term")), "ways")

    def then(first: DataFrame, second: DataFrame) -> DataFrame:
        goes = F.col("ancestor").isNull() & F.col("at").isNotNull()
        rest = second.select(F.col("id").alias("at"), F.col("at").alias("_at"), F.col("ancestor").alias("_a")).hint("merge")
        on = first.where(goes).drop("ancestor").join(rest, "at", "left").select("id", F.col("_at").alias("at"), F.col("_a").alias("ancestor"), "term")
        return written(first.where(~goes).union(on), "ways")

    way = one
    for bit in f"{depth:b}"[1:]:
        way = then(way, way)
        if bit == "1":
            way = then(way, one)
    return way.where("term").select("id", "ancestor")


def counter_diff(before: DataFrame, after: DataFrame, key: list[str], terms: DataFrame) -> DataFrame:
    """Counters (key.., id, counter, value) of terms, joined whether or not both sides have them: delta and pct only where the term itself is comparable; place within the term by absolute pct, unknown last, then name. terms: (key.., id, comparable)."""
    on = [*key, "id", "counter"]
    j = before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), on, "full_outer").join(terms, [*key, "id"], "left")
    known = F.coalesce(F.col("comparable"), F.lit(False)) & F.col("before").isNotNull() & F.col("after").isNotNull()
    j = j.withColumn("delta", F.when(known, F.col("after") - F.col("before"))).withColumn("pct", F.when(known & (F.col("before") != 0), 100 * (F.col("after") - F.col("before")) / F.col("before")))
    return by_change(j, [*key, "id"]).drop("comparable")


#: Gaps and remainders below this many milliseconds count as nothing.
TICK_TOLERANCE = 1e-6
#: Divisions after which two numbers up to 10^12 tolerances apart have come down to their common step.
DIVISIONS = 64
#: Parts that the gaps of a group are dealt to before their steps meet.
PARTS = 64


def common_step(a: Column, b: Column) -> Column:
    """The greatest step that both numbers are whole multiples of, up to the tolerance: division with remainder until nothing is left."""
    rest = lambda s: s["large"] % s["small"]
    goes_on = lambda s: (rest(s) >= TICK_TOLERANCE) & (s["small"] - rest(s) >= TICK_TOLERANCE)
    step = lambda s, _: F.when(goes_on(s), F.struct(s["small"].alias("large"), rest(s).alias("small"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(DIVISIONS)), F.struct(F.greatest(a, b).alias("large"), F.least(a, b).alias("small")), step)["small"]


def timer_quantum(samples: DataFrame, group: list[str], value: str = "value") -> DataFrame:
    """By group: the timer's step, null under two distinct values. It is the common step of the distinct gaps between neighbouring values, which are found by a
    window and meet in two steps, so that a task folds a part of a group's gaps only."""
    values = samples.select(*group, F.col(value).cast("double").alias("_v")).distinct()
    gap = F.col("_v") - F.lag("_v").over(Window.partitionBy(*group).orderBy("_v"))
    gaps = values.select(*group, F.when(gap >= TICK_TOLERANCE, F.round(gap, 9)).alias("_gap")).distinct()
    met = lambda gaps: F.aggregate(F.array_sort(F.collect_set(gaps)), F.lit(None).cast("double"), lambda now, x: F.when(now.isNull(), x).otherwise(common_step(now, x)))
    parts = gaps.groupBy(*group, F.pmod(F.xxhash64("_gap"), F.lit(PARTS)).alias("_part")).agg(met("_gap").alias("_step"))
    return parts.groupBy(*group).agg(met("_step").alias("quantum"))


def plan_check(plan: DataFrame, observed: DataFrame, session: list[str]) -> DataFrame:
    """By session: what keeps paired samples from being used, comma-joined, or empty. plan: (at, pair_id, order), observed: (at, pair_id, order, before, after), joined by place: incomplete, changed (other ids or orders), repeated ids, invalid timings, too_few (under 6 pairs), one_order."""
    p = plan.select(*session, "at", F.col("pair_id").alias("_id"), F.col("order").alias("_order"), F.lit(True).alias("_p"))
    j = p.join(observed.withColumn("_o", F.lit(True)), [*session, "at"], "full_outer")
    both = F.col("_p").isNotNull() & F.col("_o").isNotNull()
    usable = lambda c: F.coalesce((F.col(c) > 0) & (F.col(c) <= 1e12) & ~F.isnan(c), F.lit(False))
    flag = lambda c, name: F.when(c, F.lit(name))
    found = F.array_compact(F.array(
        flag(F.count_if(~both) > 0, "incomplete"), flag(F.count_if(both & ((F.col("_id") != F.col("pair_id")) | (F.col("_order") != F.col("order")))) > 0, "changed"),
        flag(F.count("_id") > F.count_distinct("_id"), "repeated"), flag(F.count_if(both & ~(usable("before") & usable("after"))) > 0, "invalid"),
        flag(F.count("_p") < 6, "too_few"), flag(F.count_distinct("_order") < 2, "one_order")))
    return j.groupBy(*session).agg(F.count("_p").alias("planned"), F.count("_o").alias("observed"), F.array_join(found, ",").alias("reasons"))


def bound_sidecars(captures: DataFrame, sidecars: DataFrame, key: list[str]) -> DataFrame:
    """Captures with their sidecar's payload where it names the sha256 of the very content (and of its own payload); status bound, unbound (no sidecar), content_changed or payload_changed."""
    c = captures.select(*key, F.sha2("content", 256).alias("_have"))
    j = c.join(sidecars.select(*key, "content_sha256", "payload", "payload_sha256", F.lit(True).alias("_s")), key, "left")
    status = F.when(F.col("_s").isNull(), "unbound").when(~F.col("content_sha256").eqNullSafe(F.col("_have")), "content_changed").when(~F.col("payload_sha256").eqNullSafe(F.sha2("payload", 256)), "payload_changed").otherwise("bound")
    return j.withColumn("status", status).select(*key, "status", F.when(F.col("status") == "bound", F.col("payload")).alias("payload"))


def bound_measurements(cases: DataFrame, measurements: DataFrame, files: DataFrame, roles: tuple[str, ...] = ("reference", "candidate", "mask")) -> DataFrame:
    """By case: measured if a measurement exists and, for each role that it names, a file of that role whose hash is the recorded one; else not_measured, missing_<role> or changed_<role>, the first in order of roles. measurements: (case_id, <role>_sha256..), null where a role is not used."""
    j = cases.select("case_id").join(measurements.withColumn("_m", F.lit(True)), "case_id", "left")
    status = F.when(F.col("_m").isNull(), "not_measured")
    for role in roles:
        f = files.where(F.col("role") == role).select("case_id", F.col("sha256").alias(f"_{role}"))
        j = j.join(f, "case_id", "left")
        want, have = F.col(f"{role}_sha256"), F.col(f"_{role}")
        status = status.when(want.isNotNull() & have.isNull(), f"missing_{role}").when(want != have, f"changed_{role}")
    return j.select("case_id", status.otherwise("measured").alias("status"))


def image_noise(runs: DataFrame, key: list[str], margin: float = 1.5) -> DataFrame:
    """By key of (run, other, mean, p95, most), rows of pairs of repeats: the largest of each over the pairs, and a threshold `margin` above the largest mean."""
    out = runs.where("run < other").groupBy(*key).agg(F.max("mean").alias("mean"), F.max("p95").alias("p95"), F.max("most").alias("most"), F.count(F.lit(1)).alias("pairs"))
    return out.withColumn("threshold", F.least(F.lit(1.0), F.col("mean") * margin))


def clock_windows(before: DataFrame, after: DataFrame, most_pct: float = 5.0) -> DataFrame:
    """By window name of (window, clock): medians of both runs, and whether they are equal within most_pct; unknown where a side has none."""
    side = lambda df, name: df.groupBy("window").agg(F.percentile("clock", F.lit(0.5)).alias(name))
    j = side(before, "before").join(side(after, "after"), "window", "full_outer")
    return j.withColumn("equal", F.abs(F.col("after") - F.col("before")) <= most_pct / 100 * F.greatest("before", "after"))
