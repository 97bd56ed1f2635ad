"""What is decided from measured entries: pages, failures that no opinion overrides, verdict classes, declared changes, receipts, canaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import glob_pattern
from ..sources.tables import dealt

STATUSES = ("pass", "fail", "error", "new", "missing")


def page(entries: DataFrame, order: list[str], statuses: list[str] = (), glob: str | None = None, offset: int = 0, limit: int = 50, name: str = "name") -> DataFrame:
    """Entries of these statuses (all if none are named) whose name matches, from offset on, each with total and next_cursor (null on the last page). Unknown statuses raise."""
    unknown = [s for s in statuses if s not in STATUSES]
    if unknown:
        raise ValueError(f"unknown status {unknown[0]!r}; use {','.join(STATUSES)}")
    chosen = entries.where(F.col("status").isin(*statuses)) if statuses else entries
    chosen = chosen.where(F.col(name).rlike(glob_pattern(glob))) if glob is not None else chosen
    total = chosen.agg(F.count(F.lit(1)).alias("total"))  # one row
    out = chosen.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))
    return out.withColumn("next_cursor", F.when((F.lit(limit) > 0) & (offset + limit < F.col("total")), F.lit(str(offset + limit))))


def key_matches(token: str, key: Column) -> Column:
    """Whether a metadata key is the token, begins with `token.`, ends with `.token`, or matches it as a glob."""
    return (key == token) | key.startswith(f"{token}.") | key.endswith(f".{token}") | key.rlike(glob_pattern(token))


def layer_predicate(spec: str, value: Column, label: Column | None = None) -> tuple[str, Column]:
    """Layer name and condition of `NAME=PREDICATE`: id=1,2 (native ids), range=a,b (inclusive), above=x (strict), mask (not zero), label=GLOB or material=GLOB (needs the label). Anything else raises."""
    name, part, rule = spec.partition("=")
    if not part or not name:
        raise ValueError("a mask layer is NAME=PREDICATE")
    kind, _, rest = rule.partition("=")
    number = lambda s: float(s) if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s) else _refuse(f"not a finite number: {s!r}")
    if kind == "id":
        ids = rest.split(",")
        if not all(re.fullmatch(r"\d+", i) and int(i) < 1 << 32 for i in ids):
            _refuse("an id is a native unsigned integer")
        return name, value.isin(*[float(i) for i in ids])
    if kind in ("label", "material") and rest:
        return name, label.rlike(glob_pattern(rest)) if label is not None else F.lit(False)
    if rule == "mask":
        return name, value != 0
    if kind == "above":
        return name, value > number(rest)
    if kind == "range" and rest.count(",") == 1:
        low, high = map(number, rest.split(","))
        return (name, value.between(low, high)) if low <= high else _refuse("an empty range")
    return _refuse(f"not a predicate: {rule!r}")


def _refuse(why: str):
    raise ValueError(why)


def deterministic_failure(entries: DataFrame, identity: bool = False, strict_meta: bool = False) -> DataFrame:
    """entries with `failure`, the reason that no opinion may override, or null: an error (under strict_meta told apart where metadata differ), samples that are not finite, a frame all black or white that the baseline's is not, a changed candidate under `identity`."""
    broken = lambda c: F.coalesce(F.col(f"capture_{c}"), F.lit(False)) & ~F.coalesce(F.col(f"baseline_{c}"), F.lit(False))
    bad = lambda side: F.coalesce(F.col(f"{side}_nonfinite") > 0, F.lit(False))
    differs = F.coalesce(F.col("meta_differs"), F.lit(False)) & F.lit(strict_meta)
    reason = F.when((F.col("status") == "error") & differs, "config mismatch").when(F.col("status") == "error", "error status")
    reason = reason.when(bad("capture"), "non-finite capture").when(bad("baseline"), "non-finite baseline").when(broken("black"), "all black").when(broken("white"), "all white")
    return entries.withColumn("failure", reason.when(F.lit(identity) & (F.col("status") == "fail"), "identity break"))


def sample_equality(entries: DataFrame, group: list[str]) -> DataFrame:
    """By group: false if an entry differs, true if all are known to be identical, else unknown."""
    return entries.groupBy(*group).agg(F.when(F.bool_or(~F.col("identical")), False).when(F.count("identical") == F.count(F.lit(1)), True).alias("equal"))


def verdict_class(reports: DataFrame) -> DataFrame:
    """reports with `class`: their own verdict, else their result; a comparison's fail, diagnostic_performance or pass; ablation_table; the coverage; or recorded."""
    own = F.coalesce("verdict", "result")
    measured = F.when(F.col("regression"), "fail").when(F.col("comparability").isNotNull() & (F.col("comparability") != "qualified"), "diagnostic_performance").otherwise("pass")
    return reports.withColumn("class", F.when(own.isNotNull(), own).when(F.col("kind") == "comparison", measured).when(F.col("arms").isNotNull(), "ablation_table").otherwise(F.coalesce("coverage", F.lit("recorded"))))


def intent(declared: DataFrame, measured: DataFrame) -> DataFrame:
    """entry, kind, outcome of declared changes (entry, kind) against measured entries (entry, status, hits, stops, identical): matched, missing or unmeasurable; and `unexpected` for entries that changed though nothing but `none` is declared for them."""
    declared, measured = dealt([declared, measured], ["entry"])
    j = declared.join(measured, "entry", "left")
    seen = F.when(F.col("kind") == "structure", F.col("hits") > 0).when(F.col("kind") == "tone_up", F.col("stops") > 0).when(F.col("kind") == "tone_down", F.col("stops") < 0).when(F.col("kind") == "none", (F.col("hits") == 0) & F.coalesce(F.col("identical"), F.lit(False)))
    whole = F.coalesce(F.col("status").isin("pass", "fail"), F.lit(False))
    told = j.select("entry", "kind", F.when(~whole, "unmeasurable").when(F.coalesce(seen, F.lit(False)), "matched").otherwise("missing").alias("outcome"))
    named = declared.where("kind <> 'none'").select("entry").distinct()
    extra = measured.where(F.col("status").isin("pass", "fail") & (F.col("hits") > 0)).join(named, "entry", "left_anti").select("entry", F.lit(None).cast("string").alias("kind"), F.lit("unexpected").alias("outcome"))
    return told.unionByName(extra)


def receipts(plan: DataFrame, got: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of a plan or a receipt with its outcome: complete, missing, duplicate (more than one receipt) or extra (not in the plan); only complete ones may be compared."""
    n = got.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    j = plan.select(*keys).distinct().withColumn("_p", F.lit(True)).join(n, keys, "full_outer")
    return j.select(*keys, F.when(F.col("_p").isNull(), "extra").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "duplicate").otherwise("complete").alias("outcome"))


def canary(answers: DataFrame, least: float) -> DataFrame:
    """By judge of (judge, answer, truth): correct, wrong, abstained (null or `abstain`), accuracy, flagged (below `least` after two answers, or all wrong), and the factor of the judge's weight."""
    said = F.coalesce(F.lower(F.trim("answer")) != "abstain", F.lit(False))
    out = answers.groupBy("judge").agg(F.count_if(said & (F.col("answer") == F.col("truth"))).alias("correct"), F.count_if(said & (F.col("answer") != F.col("truth"))).alias("wrong"), F.count_if(~said).alias("abstained"))
    n = F.col("correct") + F.col("wrong")
    out = out.withColumn("accuracy", F.when(n > 0, F.col("correct") / n))
    flagged = F.coalesce((F.col("accuracy") < least) & ((n >= 2) | (F.col("accuracy") == 0)), F.lit(False))
    return out.withColumn("flagged", flagged).withColumn("weight_factor", F.when(F.col("flagged"), F.greatest(F.col("accuracy") * F.col("accuracy"), F.lit(0.05))).otherwise(1.0))


def cheapest(candidates: DataFrame, group: list[str], target: float) -> DataFrame:
    """By group of (ord, bytes, score, ok): the candidate of fewest bytes that meets the target, the first on ties; none where any candidate failed."""
    meets = F.when(F.col("score") >= target, F.struct("bytes", "ord"))
    out = candidates.groupBy(*group).agg(F.bool_and("ok").alias("_ok"), F.min(meets).alias("_b"), F.max(F.when(F.col("ord") == 0, F.col("bytes"))).alias("original"))
    pick = lambda c: F.when(F.col("_ok"), F.col("_b")[c])
    return out.select(*group, pick("ord").alias("selected"), pick("bytes").alias("bytes"), F.when(F.col("_ok"), F.col("original") - F.col("_b")["bytes"]).alias("saved"))


def tuning_rollup(selected: DataFrame, group: list[str]) -> DataFrame:
    """By group of cheapest(): items, selected ones, bytes saved, and the least share saved."""
    return selected.groupBy(*group).agg(F.count(F.lit(1)).alias("items"), F.count("selected").alias("selected"), F.coalesce(F.sum("saved"), F.lit(0)).cast("long").alias("saved"), F.min(F.col("saved") / (F.col("saved") + F.col("bytes"))).alias("worst"))


def exclusion_audit(entries: DataFrame, group: list[str]) -> DataFrame:
    """By group of (threshold, value, pixels, excluded, error, excluded_error): least headroom below the threshold, entries at or beyond it, shares of pixels and of error that were left out (null where nothing was measured)."""
    ratio = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    room = F.col("threshold") - F.col("value")
    return entries.groupBy(*group).agg(F.min(room).alias("headroom"), F.count_if(room <= 0).alias("at_limit"), ratio("excluded", "pixels").alias("excluded_pixels"), ratio("excluded_error", "error").alias("excluded_error"))


def disjoint(fit: DataFrame, holdout: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that both parts have: none if a calibration may be trusted."""
    return fit.select(*keys).intersect(holdout.select(*keys))


def shuffled(items: DataFrame, group: list[str], key: str, seed: int) -> DataFrame:
    """items with `place`, a seeded order of presentation: by sha256(seed:key), so that it can be told again."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256), key)))


def age_checks(rows: DataFrame, at: str, now: Column, most: int) -> DataFrame:
    """rows with `age` in seconds and `stale`: future, too_old or current; unknown times are unknown."""
    age = now.cast("long") - F.col(at).cast("long")
    return rows.withColumn("age", age).withColumn("stale", F.when(F.col("age").isNull(), "unknown").when(F.col("age") < 0, "future").when(F.col("age") > most, "too_old").otherwise("current"))
