"""Whether captures are what was planned, whether two arms differ only as declared, and whether a history still says what its reports said.

All three are joins of records with what they claim; every finding is a row with a code. Codes,
key names and the two schemas are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.readers import safe_relative
from ..sources.tables import written

RECORD_SCHEMA, FINGERPRINT_SCHEMA = "capture-record.v1", "fingerprint.v1"
#: Keys that name the identity of an arm, and groups of which at least one key must be there.
IDENTITY = ("fingerprint.schema", "producer.binary", "inputs.identity", "run.mode", "run.session")
GROUPS = ("producer.build", "run.env")
READINESS = "run.readiness"
SHA = "[0-9a-f]{64}"
#: Runs that are not sound, up to this many, are broadcast; more are joined by shuffle.
SMALL = 1_000_000


def _flags(rows: DataFrame, flags: list[tuple[Column, str]], *columns: str) -> DataFrame:
    """A row with `code` for each flag that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))
    return rows.select(*columns, F.explode(found).alias("code"))


# --- captures --------------------------------------------------------------

def _identified(fingerprint: str) -> Column:
    """Whether the map of a fingerprint names a binary and inputs by their hashes, under the known schema, and a criterion that was looked at."""
    at = lambda k: F.coalesce(F.element_at(fingerprint, F.lit(k)), F.lit(""))
    criteria = F.exists(F.map_keys(fingerprint), lambda k: k.startswith(f"{READINESS}."))
    return F.coalesce((at(IDENTITY[0]) == FINGERPRINT_SCHEMA) & at(IDENTITY[1]).rlike(f"^sha256:{SHA}$") & at(IDENTITY[2]).rlike(f"^sha256:{SHA}$") & criteria, F.lit(False))


def _digest(fingerprint: str) -> Column:
    """SHA-256 of the entries of a fingerprint that say nothing of readiness, in order; null for null."""
    entries = F.array_sort(F.filter(F.map_entries(fingerprint), lambda e: ~e["key"].startswith(READINESS)))
    return F.unhex(F.sha2(F.to_json(entries), 256))


def conformance(runs: DataFrame, slots: DataFrame, acquisitions: DataFrame, files: DataFrame) -> DataFrame:
    """run, slot (null for findings of the whole run) and code of all that keeps runs from being as planned; a run without rows conforms.

    runs: (run, schema, complete); slots: (run, slot, settings, fingerprint map, domain); acquisitions: (run, slot, status, error, settings, fingerprint, domain, clock_run,
    start_ns, end_ns, path, sha256); files: (run, path, content). The acquisitions of a run must be of its slots, each at most once; a run in which they are not, or of another schema,
    gets that one code only. A slot that was not filled gets its reason only, and one of which the plan is at fault invalid_record. Within a clock's domain the
    intervals of a run must not overlap: one that starts before the latest end of those that started earlier does (clock_overlap)."""
    # Slots and acquisitions of a run are counted by its slots' names, in one shuffle of names.
    side = lambda df, k: df.select("run", "slot", F.lit(k).alias("_k"))
    names = side(slots, True).union(side(acquisitions, False)).repartition("run").groupBy("run", "slot").agg(F.count_if("_k").alias("n"), F.count_if(~F.col("_k")).alias("m"))
    blank = F.coalesce(F.trim("slot"), F.lit("")) == ""
    odd = blank | (F.col("n") > 1) | (F.col("m") > 1) | (F.col("n") == 0)
    whole = runs.withColumn("_listed", F.lit(True)).join(names.groupBy("run").agg(F.sum("n").alias("n"), F.bool_or(odd).alias("_odd")), "run", "full_outer").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    broken = (F.coalesce(F.trim("run"), F.lit("")) == "") | (F.coalesce("n", F.lit(0)) == 0) | F.coalesce("_odd", F.lit(False))
    state = whole.withColumn("_schema", ~F.col("schema").eqNullSafe(F.lit(RECORD_SCHEMA))).withColumn("_broken", ~F.col("_schema") & broken)
    state = written(state.select("run", "_listed", "_schema", "_broken", F.coalesce("complete", F.lit(False)).alias("complete")), "runs")
    sound = F.col("_listed") & ~F.col("_schema") & ~F.col("_broken")
    of_run = _flags(state.where("_listed"), [(F.col("_schema"), "unsupported_schema"), (F.col("_broken"), "invalid_record"), (sound & ~F.col("complete"), "partial_run")], "run")
    unsound = state.groupBy("run").agg(F.bool_or(sound).alias("_sound")).where("run is not null and not _sound").select("run")
    few = unsound.count() <= SMALL
    of_sound = lambda df: df.where("run is not null").join(F.broadcast(unsound) if few else unsound, "run", "left_anti")

    # What a fingerprint says is told beside it, and hashes go as bytes: of each only answers are shuffled.
    planned = slots.select("run", "slot", "settings", "domain", _digest("fingerprint").alias("_others"),
                           ((F.coalesce(F.trim("domain"), F.lit("")) == "") | ~_identified("fingerprint") | ~F.coalesce(F.element_at("fingerprint", F.lit("run.session")), F.lit("")).eqNullSafe(F.col("run"))).alias("_plan_fault"))
    reached = F.exists(F.map_entries("fingerprint"), lambda e: e["key"].startswith(READINESS) & e["key"].endswith(".reached") & (e["value"] != "true"))
    made = acquisitions.select("run", "slot", "path", F.coalesce(F.col("status") == "skipped", F.lit(False)).alias("_skipped"), (F.coalesce(F.col("status") == "failed", F.lit(False)) | F.col("error").isNotNull()).alias("_failed"), F.col("settings").alias("a_settings"),
                               _identified("fingerprint").alias("_known"), F.coalesce(reached, F.lit(False)).alias("_unready"), _digest("fingerprint").alias("a_others"), F.col("domain").alias("a_domain"), F.coalesce((F.col("clock_run") != F.col("run")) | (F.col("end_ns") < F.col("start_ns")), F.lit(True)).alias("_off"),
                               "start_ns", "end_ns", F.when(F.col("sha256").rlike(f"^{SHA}$"), F.unhex("sha256")).alias("_said"), F.lit(True).alias("_there"))
    stored = files.select("run", "path", F.unhex(F.sha2("content", 256)).alias("_have"), F.lit(True).alias("_stored"))
    image = F.when(F.col("path").isNull(), "missing_image").when(~safe_relative(F.col("path")), "unsafe_image_path").when(F.col("_said").isNull(), "invalid_record").when(F.col("_stored").isNull(), "missing_image").when(~F.col("_have").eqNullSafe(F.col("_said")), "stale_hash")
    made = of_sound(made).join(stored, ["run", "path"], "left").withColumn("_image", image).drop("path", "_said", "_have", "_stored")
    j = of_sound(planned).join(made, ["run", "slot"], "left")
    plan_fault, absent, failed = F.col("_plan_fault"), F.col("_there").isNull() | F.col("_skipped"), F.col("_failed")
    filled = ~plan_fault & ~absent & ~failed
    off_clock = F.coalesce(F.col("a_domain") != F.col("domain"), F.lit(True)) | F.col("_off")
    flags = [(plan_fault, "invalid_record"), (~plan_fault & absent, "partial_run"), (~plan_fault & ~absent & failed, "acquisition_failed"), (filled & ~F.col("a_settings").eqNullSafe(F.col("settings")), "settings_mismatch"), (filled & ~F.col("_known"), "missing_identity"),
             (filled & F.col("_known") & F.col("_unready"), "readiness_not_reached"), (filled & F.col("_known") & ~F.col("a_others").eqNullSafe(F.col("_others")), "identity_mismatch"), (filled & off_clock, "clock_mismatch")]
    flags += [(filled & (F.col("_image") == name), name) for name in ("missing_image", "unsafe_image_path", "invalid_record", "stale_hash")]
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags]))
    j = j.select("run", "slot", "a_domain", "start_ns", "end_ns", found.alias("found"), (filled & ~off_clock).alias("_timed"))
    w = Window.partitionBy("run", "a_domain").orderBy("start_ns", "end_ns", "slot").rowsBetween(Window.unboundedPreceding, -1)
    late = F.col("a_domain").isNotNull() & (F.col("start_ns") < F.max("end_ns").over(w))
    j = j.withColumn("found", F.when(F.coalesce(F.col("_timed") & late, F.lit(False)), F.array_append("found", F.lit("clock_overlap"))).otherwise(F.col("found")))
    return of_run.select("run", F.lit(None).cast("string").alias("slot"), "code").union(j.select("run", "slot", F.explode("found").alias("code")))


# --- arms ------------------------------------------------------------------

def _heads(key: str) -> Column:
    """All dotted beginnings of a key, itself and the empty one included."""
    parts = F.split(key, r"\.")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def _tails(key: str) -> Column:
    """All dotted endings of a key but itself."""
    parts = F.split(key, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def resolved(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """keys (arm, key) with the rule (pattern, kind) that is most specific for each, null where none fits. rules: (arm, or null for all; pattern; kind).

    A pattern fits the key itself, keys that it begins or ends at a dot, and as a glob (`*`) whole keys. Keys meet
    patterns by joins on their dotted beginnings and endings, globs by the plain beginning before the first star; so the number of rules does not matter. The key
    itself is most specific, then longer patterns; `vary` goes before `ignore`."""
    r = rules.select(F.col("arm").alias("rule_arm"), "pattern", "kind").distinct().withColumn("star", F.contains("pattern", F.lit("*")))
    plain = F.regexp_extract("pattern", r"^((?:[^*.]+\.)*)", 1)
    r = r.withColumn("head", F.when(F.col("star"), F.rtrim(plain, F.lit("."))).otherwise(F.col("pattern")))
    regex = F.concat(F.lit("^"), F.array_join(F.transform(F.split("pattern", r"\*", -1), lambda x: F.concat(F.lit("\\Q"), x, F.lit("\\E"))), "[^/]*"), F.lit("$"))
    r = r.withColumn("regex", regex)
    k = keys.select("arm", "key").distinct()
    # Arms share most of their keys: patterns meet each key once, rules of all arms and of one are told apart after.
    names = k.select("key").distinct()
    columns = ["key", "rule_arm", "pattern", "kind"]
    begins = names.withColumn("part", F.explode(_heads("key"))).join(r, F.col("part") == F.col("head")).where(~F.col("star") | F.expr("key rlike regex")).where("star or part <> ''")
    ends = names.withColumn("part", F.explode(_tails("key"))).join(r.where("not star"), F.col("part") == F.col("pattern"))
    rank = F.struct((F.col("pattern") == F.col("key")).alias("whole"), F.length("pattern").alias("size"), (F.col("kind") == "vary").alias("varies"), "pattern", "kind")
    best = begins.select(columns).union(ends.select(columns)).groupBy("key", "rule_arm").agg(F.max(rank).alias("m"))
    all_arms, own = best.where("rule_arm is null").select("key", F.col("m").alias("_all")), best.where("rule_arm is not null").select(F.col("rule_arm").alias("arm"), "key", F.col("m").alias("_own"))
    out = k.join(own, ["arm", "key"], "left").join(all_arms, "key", "left").withColumn("m", F.greatest("_own", "_all"))
    return out.select("arm", "key", F.col("m.pattern").alias("pattern"), F.col("m.kind").alias("kind"))


def arm_findings(baseline: DataFrame, capture: DataFrame, rules: DataFrame) -> DataFrame:
    """arm, key, reason, baseline, capture of what was found between the flattened fingerprints (arm, key, value) of each arm's baseline and capture.

    Reasons that make an arm invalid: difference (no rule declares it), missing and malformed (identity, groups, readiness), readiness_not_reached. Others tell
    what the rules did: varied and ignored (differences that the most specific rule allows), never_varies (a declared pattern under which nothing differs). A null value is a value; a key
    that only one side has differs."""
    side = lambda df, name: df.select("arm", "key", F.col("value").alias(name), F.lit(True).alias(f"_{name}"))
    j = side(baseline, "baseline").join(side(capture, "capture"), ["arm", "key"], "full_outer")
    apart = j.where(F.col("_baseline").isNull() | F.col("_capture").isNull() | ~F.col("baseline").eqNullSafe(F.col("capture")))
    rule = resolved(apart, rules)
    told = apart.join(rule, ["arm", "key"]).withColumn("reason", F.when(F.col("kind") == "vary", "varied").when(F.col("kind") == "ignore", "ignored").otherwise("difference"))
    columns = ["arm", "key", "reason", "baseline", "capture"]

    arms = j.select("arm").distinct()
    wanted = arms.withColumn("key", F.explode(F.array(*[F.lit(x) for x in IDENTITY]))).join(j, ["arm", "key"], "left")
    blank = lambda c: F.trim(c) == ""
    lacks = F.col("_baseline").isNull() | F.col("_capture").isNull() | F.col("baseline").isNull() | F.col("capture").isNull()
    odd = blank("baseline") | blank("capture") | ((F.col("key") == IDENTITY[0]) & ((F.col("baseline") != FINGERPRINT_SCHEMA) | (F.col("capture") != FINGERPRINT_SCHEMA)))
    identity = wanted.withColumn("reason", F.when(lacks, "missing").when(odd, "malformed")).where("reason is not null")

    has = lambda name, g: F.count_if(F.col(f"_{name}") & F.col(name).isNotNull() & F.col("key").startswith(f"{g}."))
    groups = F.array_compact(F.array(*[F.when((has("baseline", g) == 0) | (has("capture", g) == 0), F.lit(g)) for g in (*GROUPS, READINESS)]))
    none = j.groupBy("arm").agg(groups.alias("g")).select("arm", F.explode("g").alias("key"), F.lit("missing").alias("reason"), F.lit(None).cast("string").alias("baseline"), F.lit(None).cast("string").alias("capture"))

    field = F.regexp_extract("key", rf"^{READINESS}\.(.+)\.(criterion|reached|observed)$", 2)
    criteria = j.where(F.col("key").startswith(f"{READINESS}.")).withColumns({"field": field, "name": F.regexp_extract("key", rf"^{READINESS}\.(.+)\.(criterion|reached|observed)$", 1)})
    of = lambda f, c: F.max(F.when(F.col("field") == f, F.col(c)))
    each = criteria.where("field <> ''").groupBy("arm", "name").agg(*[of(f, c).alias(f"{f}_{c}") for f in ("criterion", "reached", "observed") for c in ("baseline", "capture")])
    asked = F.coalesce("criterion_baseline", "criterion_capture").isNotNull()
    reports = []
    for f in ("reached", "observed"):
        key = F.concat(F.lit(f"{READINESS}."), "name", F.lit(f".{f}"))
        gone = asked & ((F.col("criterion_baseline").isNotNull() & F.col(f"{f}_baseline").isNull()) | (F.col("criterion_capture").isNotNull() & F.col(f"{f}_capture").isNull()))
        unmet = F.lit(False) if f == "observed" else F.coalesce(F.col("reached_baseline") != "true", F.lit(False)) | F.coalesce(F.col("reached_capture") != "true", F.lit(False))
        reports.append(each.withColumns({"key": key, "reason": F.when(gone, "missing").when(unmet, "readiness_not_reached"), "baseline": F.col(f"{f}_baseline"), "capture": F.col(f"{f}_capture")}).where("reason is not null"))

    declared = rules.where("kind = 'vary'").select(F.col("arm").alias("rule_arm"), "pattern").distinct()
    due = arms.join(declared.where("rule_arm is not null").withColumnRenamed("rule_arm", "arm"), "arm").union(arms.join(F.broadcast(declared.where("rule_arm is null").select("pattern"))))
    idle = due.distinct().join(rule.where("kind = 'vary'").select("arm", "pattern"), ["arm", "pattern"], "left_anti")
    idle = idle.select("arm", F.col("pattern").alias("key"), F.lit("never_varies").alias("reason"), F.lit(None).cast("string").alias("baseline"), F.lit(None).cast("string").alias("capture"))
    out = told.select(*columns)
    for part in (identity, none, *reports, idle):
        out = out.union(part.select(*columns))
    return out


#: Reasons that do not make an arm invalid.
TOLD = ("varied", "ignored", "never_varies")


def arm_validity(findings: DataFrame, arms: DataFrame) -> DataFrame:
    """arm, valid, offending (findings that make it invalid) of every arm (arm)."""
    bad = findings.where(~F.col("reason").isin(*TOLD)).groupBy("arm").agg(F.count(F.lit(1)).alias("offending"))
    return arms.select("arm").distinct().join(bad, "arm", "left").select("arm", F.col("offending").isNull().alias("valid"), F.coalesce("offending", F.lit(0)).alias("offending"))


# --- histories -------------------------------------------------------------

REPORT = "config string, entries array<struct<name: string, status: string, validity: string, metric: string, value: double, threshold: double, baseline_sha256: string, capture_sha256: string>>"
SAMPLE = ("entry", "metric", "value", "threshold", "baseline_sha256", "capture_sha256")


def report_samples(reports: DataFrame, *also: str) -> DataFrame:
    """report, and a row for each entry of its content that is a measurement: compared, not of an invalid capture, with finite numbers and both hashes. reports: (report, content of JSON); columns named in `also` go along."""
    e = reports.withColumn("_r", F.from_json("content", REPORT)).select("report", *also, F.explode("_r.entries").alias("e")).select("report", *also, "e.*").withColumnRenamed("name", "entry")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = F.col("status").isin("pass", "fail") & ~F.col("validity").eqNullSafe(F.lit("invalid")) & F.col("baseline_sha256").isNotNull() & F.col("capture_sha256").isNotNull()
    return e.where(whole & finite("value") & finite("threshold")).select("report", *also, *SAMPLE)


def verified_history(index: DataFrame, samples: DataFrame, objects: DataFrame) -> DataFrame:
    """report, state, lost, added, changed of every report of an index (report: sha256 of its content, config_sha256; each once), whose samples (report and those of SAMPLE) must be those that the stored objects (report, content) say.

    The content is hashed again and its samples are derived again and compared one by one. state: invalid_identity, object_missing, content_changed, malformed, config_changed, samples_changed or verified.
    lost, added, changed: samples that only the report has, that only the index has, and that differ; null where the content is not to be trusted.
    Contents stay where they are stored: what is asked of one is told beside it, and only samples and these answers are shuffled, all by report."""
    said = F.from_json("content", REPORT)
    facts = objects.select("report", F.sha2("content", 256).eqNullSafe(F.col("report")).alias("_same"), said["entries"].isNull().alias("_malformed"), F.sha2(said["config"], 256).alias("_config"), F.lit(True).alias("_there"))
    j = index.join(facts, "report", "left")
    j = j.withColumn("state", F.when(~F.coalesce(F.col("report").rlike(f"^{SHA}$"), F.lit(False)), "invalid_identity").when(F.col("_there").isNull(), "object_missing").when(~F.col("_same"), "content_changed").when(F.col("_malformed"), "malformed").when(~F.col("_config").eqNullSafe(F.col("config_sha256")), "config_changed"))
    j = j.select("report", "state")
    side = lambda df, k: df.select("report", *SAMPLE, F.lit(k).alias("_k"))
    both = side(report_samples(objects.where(F.sha2("content", 256) == F.col("report"))), True).union(side(samples, False)).repartition("report")
    alike = both.groupBy("report", *SAMPLE).agg(F.count_if("_k").alias("said"), F.count_if(~F.col("_k")).alias("held"))
    each = alike.groupBy("report", "entry").agg(F.sum("said").alias("said"), F.sum("held").alias("held"), F.sum(F.col("said") * F.col("held")).alias("same"))
    # Entries without a name are nobody's match.
    met = F.col("entry").isNotNull() & (F.col("said") > 0) & (F.col("held") > 0)
    summed = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    diff = each.groupBy("report").agg(summed(~met, F.col("said")).alias("lost"), summed(~met, F.col("held")).alias("added"), summed(met, F.col("said") * F.col("held") - F.col("same")).alias("changed"))
    out = j.join(diff, "report", "left")
    trust = F.col("state").isNull() | (F.col("state") == "config_changed")
    counts = {c: F.when(trust, F.coalesce(c, F.lit(0))) for c in ("lost", "added", "changed")}
    out = out.withColumns(counts)
    state = F.coalesce("state", F.when(F.col("lost") + F.col("added") + F.col("changed") > 0, "samples_changed").otherwise("verified"))
    return out.select("report", state.alias("state"), "lost", "added", "changed")
