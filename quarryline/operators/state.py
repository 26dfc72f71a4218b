"""Writes as state tables: operations, plans, archive transitions, notes. Each function maps tables to tables; storing them is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .cut import dealt, parts_for

STAGES = ["dependencies", "retrieval", "navigation", "overview", "audit_log"]
# Moves the archive's state machine allows, fields that an update must not change, and limits of notes.
TRANSITIONS = {
    "planned": ("staged", "rolling_back", "failed_recoverable"), "staged": ("pending", "rolling_back", "failed_recoverable"), "pending": ("detaching", "rolling_back", "failed_recoverable"),
    "detaching": ("committed", "rolling_back", "failed_recoverable"), "failed_recoverable": ("rolling_back", "detaching"), "rolling_back": ("rolled_back",), "committed": (), "rolled_back": (),
}
LOCKED_FIELDS = ("type", "concept_id", "entity_id", "entity_type", "created", "source_path", "source_hash")
#: Parts over which the dependents of one raw page are dealt.
SPREAD = 32
STRUCTURAL = ("wiki/index.md", "wiki/log.md", "wiki/overview.md")
ALIASES_MOST, ALIAS_CHARS, QUESTIONS_MOST, QUESTION_CHARS = 20, 120, 20, 300


def commit(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """requests (operation_id, path, expected_hash, new_hash) with outcome: committed, unchanged, conflict. Of several requests on a page the first id wins."""
    w = Window.partitionBy("path").orderBy("operation_id")
    both = requests.join(pages.select("path", F.col("content_hash").alias("have")), "path", "left").withColumn("k", F.row_number().over(w))
    outcome = F.when(F.col("new_hash").eqNullSafe(F.col("have")), "unchanged").when(~F.col("expected_hash").eqNullSafe(F.col("have")) | (F.col("k") > 1), "conflict").otherwise("committed")
    return both.withColumn("outcome", outcome).drop("k", "have")


def stages(operations: DataFrame) -> DataFrame:
    """operation_id, stage, position, status of new operations."""
    return operations.select("operation_id", F.posexplode(T.strings(STAGES)).alias("position", "stage")).withColumn("status", F.lit("pending"))


def next_stage(stage_rows: DataFrame) -> DataFrame:
    """The first stage of each operation that isn't completed."""
    return stage_rows.where("status <> 'completed'").groupBy("operation_id").agg(F.min_by("stage", "position").alias("stage"))


def recover(operations: DataFrame, pages: DataFrame) -> DataFrame:
    """operation_id, found: base, intended or conflict, by what the page holds now."""
    both = operations.join(pages.select("path", F.col("content_hash").alias("have")), "path", "left")
    return both.select("operation_id", F.when(F.col("have").eqNullSafe(F.col("intended_hash")), "intended").when(F.col("have").eqNullSafe(F.col("base_hash")), "base").otherwise("conflict").alias("found"))


def create_operations(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """request_key, operation_id, outcome: created, existing (same fields) or conflict (other fields)."""
    fields = ["operation_kind", "path", "base_hash", "intended_hash"]
    old = existing.select("request_key", F.col("operation_id").alias("old_id"), *[F.col(f).alias(f"old_{f}") for f in fields])
    both = requests.join(old, "request_key", "left")
    same = F.lit(True)
    for f in fields:
        same &= F.col(f).eqNullSafe(F.col(f"old_{f}"))
    outcome = F.when(F.col("old_id").isNull(), "created").when(same, "existing").otherwise("conflict")
    return both.select("request_key", F.coalesce("old_id", "operation_id").alias("operation_id"), outcome.alias("outcome"))


def plan_status(plans: DataFrame, now: Column) -> DataFrame:
    """plans with status: consumed, claimed, expired or open."""
    status = F.when(F.col("consumed_at").isNotNull(), "consumed").when(F.col("claimed_at").isNotNull(), "claimed").when(F.col("expires_at") <= now, "expired").otherwise("open")
    return plans.withColumn("status", status)


def claim(plans: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """plans after claims: open plans among ids are claimed; claiming again changes nothing."""
    mine = ids.select("plan_id", F.lit(True).alias("__mine")).distinct()
    rows = plan_status(plans, now).join(mine, "plan_id", "left")
    return rows.withColumn("claimed_at", F.when(F.col("__mine") & (F.col("status") == "open"), now).otherwise(F.col("claimed_at"))).drop("__mine", "status")


def consume(plans: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    mine = ids.select("plan_id", F.lit(True).alias("__mine")).distinct()
    rows = plans.join(mine, "plan_id", "left")
    return rows.withColumn("consumed_at", F.when(F.col("__mine") & F.col("claimed_at").isNotNull() & F.col("consumed_at").isNull(), now).otherwise(F.col("consumed_at"))).drop("__mine")


def knowledge_blocker(path: Column, generated: Column, lifecycle: Column, replaced_by: Column, explicit: bool = True, namespace: str | None = None) -> Column:
    """Why a wiki page may not be archived; null if it may. Pages of a forced namespace may."""
    generated, lifecycle = F.coalesce(generated, F.lit(False)), T.text_of(lifecycle)
    forced = T.path_matches_prefix(path, namespace) if namespace else F.lit(False)
    why = F.when(~generated & F.lit(not explicit), "manual_page_protected").when(lifecycle.isin("stale", "review_required"), "archive_lifecycle_ineligible")
    why = why.when(generated & ~lifecycle.isin("superseded", "deprecated", "archive-ready"), "archive_lifecycle_ineligible").when((lifecycle == "superseded") & (T.text_of(replaced_by) == ""), "replaced_by_required")
    return F.when(~forced, why)


def archive_plan(targets: DataFrame, pages: DataFrame, edges: DataFrame, cascade: bool = False, explicit: bool = False, namespace: str | None = None) -> DataFrame:
    """path, role (target, dependent), blocker (null if none), dependents (their number, of a raw target).

    pages: path, generated, lifecycle_status, replaced_by; edges: source_path, page_path. A raw page that pages depend on
    goes only with them (cascade); then each of these must be free to go.
    """
    parts = parts_for(targets, pages, edges)
    have = dealt(pages.select("path", "generated", "lifecycle_status", "replaced_by", F.lit(True).alias("there")), parts, "path")
    asked = dealt(targets.select("path"), parts, "path").distinct()
    # a raw page's dependents are dealt to at most SPREAD parts: a page of many is not one task's, and few counts are left to sum up
    raw = edges.where(F.startswith("source_path", F.lit("raw/"))).select("source_path", "page_path", F.pmod(F.hash("page_path"), F.lit(SPREAD)).alias("__s"))
    of = dealt(raw, parts, "source_path", "__s").distinct().drop("__s")
    fed = of.groupBy(F.col("source_path").alias("path")).agg(F.count("*").alias("dependents"))
    own = knowledge_blocker(F.col("path"), F.col("generated"), F.col("lifecycle_status"), F.col("replaced_by"), explicit, namespace)
    outside = ~(F.startswith("path", F.lit("wiki/")) | F.startswith("path", F.lit("raw/")))
    place = F.when(outside, "invalid_archive_target").when(F.col("path").isin(*STRUCTURAL), "structural_page_protected").when(F.col("there").isNull(), "archive_target_missing")
    held = F.when((F.coalesce("dependents", F.lit(0)) > 0) & F.lit(not cascade), "archive_dependency_blocked")
    rows = asked.join(have, "path", "left").join(fed, "path", "left")
    out = rows.select("path", F.lit("target").alias("role"), F.coalesce(place, F.when(F.startswith("path", F.lit("raw/")), held).otherwise(own)).alias("blocker"), F.coalesce("dependents", F.lit(0)).cast("long").alias("dependents"))
    if not cascade:
        return out
    of = of.join(asked.withColumnRenamed("path", "source_path"), "source_path")
    more = of.select(F.col("page_path").alias("path")).distinct().join(asked, "path", "left_anti").join(have, "path", "left")
    return out.unionByName(more.select("path", F.lit("dependent").alias("role"), F.coalesce(place, own).alias("blocker"), F.lit(0).cast("long").alias("dependents")))


def invalid_transitions(moves: DataFrame) -> DataFrame:
    """moves (operation_id, old_state, new_state) the state machine refuses."""
    after = F.create_map(*[x for state, to in TRANSITIONS.items() for x in (F.lit(state), T.strings(to))])
    return moves.where(~F.coalesce(F.array_contains(after[F.col("old_state")], F.col("new_state")), F.lit(False)))


def restore_plan(items: DataFrame, pages: DataFrame) -> DataFrame:
    """path, action: restore, skip (same content is there) or conflict."""
    both = items.join(pages.select("path", F.col("content_hash").alias("have")), "path", "left")
    return both.select("path", F.when(F.col("have").isNull(), "restore").when(F.col("have") == F.col("content_hash"), "skip").otherwise("conflict").alias("action"))


def purge(archives: DataFrame, requests: DataFrame, active: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Refused requests (archive_id, forget, reason) with why, and tombstones of the others.

    items: archive_id, path of what each archive holds; active: source_path of what live pages still refer to. A tombstone keeps the
    hashes of its paths, unless they are to be forgotten.
    """
    in_use = items.join(active.select(F.col("source_path").alias("path")).distinct(), "path", "left_semi").groupBy("archive_id").agg(F.count("*").alias("used"))
    hashes = items.groupBy("archive_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("sha256:"), F.sha2("path", 256)))).alias("path_hashes"))
    both = requests.join(archives.select("archive_id", F.lit(True).alias("there")), "archive_id", "left").join(in_use, "archive_id", "left").join(hashes, "archive_id", "left")
    rows = both.withColumn("why", F.when(F.col("there").isNull(), "archive_not_found").when(F.col("used") > 0, "purge_active_reference"))
    kept = F.when(F.col("forget"), F.array().cast("array<string>")).otherwise(F.coalesce("path_hashes", F.array().cast("array<string>")))
    return rows.where("why is not null").select("archive_id", "why"), rows.where("why is null").select("archive_id", "forget", "reason", kept.alias("path_hashes"))


def recover_restores(journal: DataFrame) -> DataFrame:
    """operation_id, path, action after a crash: files an unfinished restore made are removed, unfinished archives put back."""
    open_ = journal.where("state in ('restoring', 'staging', 'committing')")
    action = F.when((F.col("state") == "restoring") & F.col("created_here"), "remove").when(F.col("state").isin("staging", "committing") & F.col("moved"), "put_back").otherwise("leave")
    return open_.select("operation_id", "path", action.alias("action"))


def notes(rows: DataFrame) -> DataFrame:
    """rows with aliases and questions trimmed, distinct by folded text and within limits, and errors."""
    def tidy(c: str, drop: Column | None = None) -> Column:
        values = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
        folded = F.transform(values, lambda x: T.casefold(x))
        first = F.filter(F.transform(values, lambda x, i: F.when(F.array_position(folded, T.casefold(x)) == i + 1, x)), lambda x: x.isNotNull())
        return first if drop is None else F.filter(first, lambda x: T.casefold(x) != T.casefold(drop))
    out = rows.withColumn("aliases", tidy("aliases", F.col("title"))).withColumn("questions", tidy("questions"))
    checks = [
        (F.trim(F.coalesce("title", F.lit(""))) == "", "missing_title"), (F.size("aliases") > ALIASES_MOST, "too_many_aliases"), (F.exists("aliases", lambda a: F.length(a) > ALIAS_CHARS), "alias_too_long"),
        (F.size("questions") > QUESTIONS_MOST, "too_many_questions"), (F.exists("questions", lambda q: F.length(q) > QUESTION_CHARS), "question_too_long"),
    ]
    return out.withColumn("errors", F.array_compact(F.array(*[F.when(c, n) for c, n in checks])))


def updates(requests: DataFrame, pages: DataFrame, plans: DataFrame, now: Column) -> DataFrame:
    """requests (request_id, path, expected_hash, fields array, sources array, structural, plan_id, intent_hash) with outcome: apply or why not."""
    known = pages.select("path", F.col("content_hash").alias("have"), "lifecycle_status")
    plan = plan_status(plans, now).select("plan_id", F.col("base_hash").alias("plan_base"), F.col("intent_hash").alias("plan_intent"), F.col("status").alias("plan_status"))
    both = requests.join(known, "path", "left").join(plan, "plan_id", "left")
    outcome = (
        F.when(F.col("have").isNull(), "page_not_found").when(F.col("lifecycle_status") != "active", "inactive_page").when(F.arrays_overlap("fields", T.strings(LOCKED_FIELDS)), "locked_field")
        .when(F.array_contains("fields", F.lit("sources")) & (F.size("sources") == 0), "sources_required").when(~F.col("expected_hash").eqNullSafe(F.col("have")), "hash_mismatch").when(F.col("structural") & F.col("plan_status").isNull(), "update_plan_required")
        .when(F.col("plan_status").isin("expired", "consumed"), F.concat(F.lit("plan_"), F.col("plan_status"))).when(F.col("plan_status").isNotNull() & ((F.col("plan_base") != F.col("have")) | (F.col("plan_intent") != F.col("intent_hash"))), "plan_mismatch")
        .otherwise("apply")
    )
    return both.select("request_id", "path", outcome.alias("outcome"))


def repair_gate(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Entries (path, content_hash) that no longer match: a repair is applied only if there are none."""
    return entries.join(pages.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def escalate(results: DataFrame, mode: str) -> DataFrame:
    """operation_id, action: a failed structural stage is rebuilt in full in repair, and left failed otherwise."""
    action = F.when(F.col("status") == "completed", "done").when((F.col("kind") == "structural") & F.lit(mode == "repair"), "full_rebuild").otherwise("failed")
    return results.select("operation_id", "stage", action.alias("action"))


def legacy_migration(pages: DataFrame, marker: bool) -> DataFrame:
    """path, target, blocker for pages of the old archive folder; nothing once the marker is set."""
    old = pages.where(F.startswith("path", F.lit("wiki/archive/")) & F.lit(not marker)).withColumn("target", F.regexp_replace("path", "^wiki/archive/", "archive/legacy/"))
    taken = pages.select(F.col("path").alias("target"), F.lit(True).alias("taken"))
    return old.join(taken, "target", "left").select("path", "target", F.when(F.col("taken"), "target_exists").alias("blocker"))


# Where shared specifications lie, and what they may apply to.
SHARED_SPECS, APPLIES_TO = "wiki/entities/shared-specs/", ("languages", "platforms", "frameworks")


def shared_spec_plan(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """request_id, page_path, action (create, update, unchanged, delete) or code (why not), current_hash, desired_hash, missing: origins without a page.

    requests: request_id, operation (upsert or delete), page_path, title, body, applies_to (map of lists), conditions, derived_from
    (project, path, rule: rules of projects' specifications); pages: path, content_hash.
    """
    path, none = F.col("page_path"), F.array().cast("array<struct<project:string,path:string,rule:string>>")
    origins = F.coalesce("derived_from", none)
    parts = lambda o: F.split(o["path"], "/")
    spec = lambda o: o["path"].startswith("wiki/projects/") & (F.size(parts(o)) >= 5) & (F.get(parts(o), F.lit(2)) == o["project"]) & (F.get(parts(o), F.lit(3)) == "specs") & (F.trim(T.text_of(o["rule"])) != "")
    lists = F.coalesce(F.col("applies_to"), F.create_map().cast("map<string,array<string>>"))
    applies = F.forall(F.map_keys(lists), lambda k: k.isin(*APPLIES_TO)) & F.forall(F.flatten(F.map_values(lists)), lambda x: F.trim(T.text_of(x)) != "")
    tidy = F.transform_values(lists, lambda k, v: F.array_sort(F.array_distinct(F.transform(v, lambda x: F.trim(x)))))
    desired = F.sha2(F.to_json(F.struct(F.trim("title").alias("title"), "body", F.array_sort(F.map_entries(tidy)).alias("applies_to"), F.trim(T.text_of("conditions")).alias("conditions"), F.array_sort(F.array_distinct(origins)).alias("derived_from"))), 256)
    have = pages.select(F.col("path").alias("page_path"), F.col("content_hash").alias("current_hash"))
    gone = requests.select("request_id", F.explode(origins).alias("o")).select("request_id", F.col("o.path").alias("path")).join(pages.select("path"), "path", "left_anti").groupBy("request_id").agg(F.array_sort(F.collect_set("path")).alias("missing"))
    rows = requests.join(have, "page_path", "left").join(gone, "request_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    upsert = F.col("operation") == "upsert"
    code = (
        F.when(~F.col("operation").isin("upsert", "delete"), "invalid_operation").when(~path.startswith(SHARED_SPECS) | ~path.endswith(".md") | path.contains(".."), "invalid_page_path")
        .when(~upsert & F.col("current_hash").isNull(), "page_not_found").when(upsert & ((F.trim(T.text_of("title")) == "") | F.col("body").isNull()), "invalid_shared_spec")
        .when(upsert & ((F.size(origins) == 0) | ~F.coalesce(F.forall(origins, spec), F.lit(False))), "invalid_derived_from").when(upsert & ~F.coalesce(applies, F.lit(False)), "invalid_applies_to")
    )
    rows = rows.withColumn("code", code).withColumn("desired_hash", F.when(upsert & F.col("code").isNull(), desired))
    action = F.when(F.col("code").isNotNull(), None).when(~upsert, "delete").when(F.col("current_hash").isNull(), "create").when(F.col("current_hash") == F.col("desired_hash"), "unchanged").otherwise("update")
    return rows.select("request_id", "page_path", action.alias("action"), "code", "current_hash", "desired_hash", "missing")


class Adapters:
    """Write adapters by operation kind, then by path prefix, in the order of registration."""

    def __init__(self, adapters: list[tuple[str, str, object]] = ()):
        self.adapters = list(adapters)

    def of(self, kind: str, path: str):
        for k, prefix, adapter in self.adapters:
            if k == kind and path.startswith(prefix):
                return adapter
        raise KeyError(f"no adapter for {kind} on {path}")
