"""Run tables: drift, snapshots, restore, purge, state folding, caches and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidgrid import lexicon as lx
from evidgrid.functions.identity import content_sha, valid_request_id, valid_run_id, valid_sha
from evidgrid.operators.skew import previous_value


def drift(expected: DataFrame, observed: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Every key with ``status`` added, removed, changed or same (null-safe comparison)."""
    old = expected.select(*keys, F.struct(*compared).alias("_old"))
    new = observed.select(*keys, F.struct(*compared).alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added")
        .when(F.col("_new").isNull(), "removed")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "same")
        .otherwise("changed")
    )
    return old.join(new, keys, "full").select(*keys, status.alias("status"))


def snapshot(pre: DataFrame, post: DataFrame, keys: list[str]) -> DataFrame:
    """Hashes and sizes before and after, with a changed flag (columns keys, content)."""

    def facts(df: DataFrame, side: str) -> DataFrame:
        return df.select(
            *keys,
            content_sha("content").alias(f"{side}_sha256"),
            F.octet_length("content").cast("long").alias(f"{side}_bytes"),
        )

    joined = facts(pre, "pre").join(facts(post, "post"), keys, "full")
    changed = ~F.col("pre_sha256").eqNullSafe(F.col("post_sha256"))
    return joined.withColumn("existed", F.col("pre_sha256").isNotNull()).withColumn("changed", changed)


def restore_plan(targets: DataFrame, live: DataFrame, keys: list[str], recover: bool = False) -> DataFrame:
    """What a restore would do per changed target.

    ``targets``: keys, existed, changed, pre_sha256, post_sha256; ``live``: keys, live_sha256 (no
    row for a missing document). Diverged targets need force and are archived first; during
    recovery a target that is still in its earlier state counts as known.
    """
    joined = targets.where("changed").join(live, keys, "left")
    exists = F.col("live_sha256").isNotNull()
    is_pre = F.when(F.col("existed"), F.col("live_sha256") == F.col("pre_sha256")).otherwise(~exists)
    is_pre = F.coalesce(is_pre, F.lit(False))
    is_post = F.coalesce(F.col("live_sha256") == F.col("post_sha256"), F.lit(False))
    known = is_post | is_pre if recover else is_post
    action = (
        F.when(is_pre, "already_restored")
        .when(is_post & F.col("existed"), "restorable")
        .when(is_post, "removable")
        .otherwise("diverged")
    )
    return joined.select(
        *keys,
        action.alias("status"),
        (~known).alias("needs_force"),
        F.when(F.col("existed"), F.col("pre_sha256")).alias("result_sha256"),
    )


def purge(runs: DataFrame, requested: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(remaining runs, tombstones) for the requested run ids.

    Runs in an active state stay unless forced. ``runs``: run_id, state and the marker fields.
    """
    asked = runs.join(requested.select("run_id").distinct(), "run_id", "left_semi")
    active = F.col("state").isin(*lx.ACTIVE_RUN_STATES)
    removable = asked if force else asked.where(~active)
    remaining = runs.join(removable.select("run_id"), "run_id", "left_anti")
    tombstones = removable.withColumnRenamed("state", "previous_state").withColumn(
        "restore_possible", F.lit(False)
    )
    return remaining, tombstones


def valid_marker() -> Column:
    """Shape of a resolution marker."""
    return (
        valid_run_id("parent_run_id")
        & valid_run_id("successor_run_id")
        & valid_request_id("request_id")
        & valid_sha("parent_sha256")
        & valid_sha("successor_sha256")
        & valid_sha("conflict_fingerprint")
        & valid_sha("response_sha256")
    )


def resolve_requests(requests: DataFrame, successors: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Status of every request: available with its successor run, purged, or pending.

    All sides carry parent_run_id, parent_sha256, request_id; successors and tombstones also
    successor_run_id. The first successor by id is reported.
    """
    keys = ["parent_run_id", "parent_sha256", "request_id"]

    def first(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.min("successor_run_id").alias(name))

    joined = requests.join(first(successors, "_run"), keys, "left").join(
        first(tombstones, "_gone"), keys, "left"
    )
    status = (
        F.when(F.col("_run").isNotNull(), "available")
        .when(F.col("_gone").isNotNull(), "purged")
        .otherwise("pending")
    )
    return joined.select(
        *requests.columns,
        status.alias("status"),
        F.coalesce("_run", "_gone").alias("successor_run_id"),
    )


def current_states(log: DataFrame, run: str = "run_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Latest state and number of entries per run."""
    return log.groupBy(run).agg(
        F.max(F.struct(*order, "state"))["state"].alias("state"), F.count("*").alias("entries")
    )


def illegal_transitions(
    log: DataFrame,
    transitions: DataFrame,
    run: str = "run_id",
    order: tuple[str, ...] = ("ts", "event_id"),
    initial: str | None = "planned",
) -> DataFrame:
    """Log entries whose step from the entry before is not in (from_state, to_state).

    The entry before is found by chunks, so a run with very many entries is spread over tasks.
    """
    stepped = previous_value(log, [run], list(order), "state", "from_state")
    pairs = transitions.select("from_state", F.col("to_state").alias("state")).distinct()
    later = stepped.where(F.col("from_state").isNotNull())
    wrong = later.join(F.broadcast(pairs), ["from_state", "state"], "left_anti")
    columns = [run, *order, "from_state", "state"]
    wrong = wrong.select(*columns)
    if initial is not None:
        starts = stepped.where(F.col("from_state").isNull() & (F.col("state") != initial))
        wrong = wrong.unionByName(starts.select(*columns))
    return wrong


def cache_lookup(work: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reusable, todo, corrupt): results found, work without a result, entries with a bad hash."""
    checked = cache.withColumn("_good", content_sha("response") == F.col("response_sha256"))
    good = checked.where("_good").drop("_good")
    reusable = work.join(good, key)
    todo = work.join(cache.select(key), key, "left_anti")
    corrupt = work.select(key).join(checked.where("not _good").drop("_good"), key)
    return reusable, todo, corrupt


def new_blobs(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """Payloads (sha256, payload) not in the store yet, each once."""
    keyed = candidates.select(F.sha2(F.col("payload").cast("binary"), 256).alias("sha256"), "payload")
    return keyed.join(store.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])


def corrupt_blobs(store: DataFrame) -> DataFrame:
    return store.where(F.sha2(F.col("payload").cast("binary"), 256) != F.col("sha256")).select("sha256")


def field_disagreements(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) where two tables differ, missing rows included; null equals null."""
    a = left.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_a"))
    b = right.select(key, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias("_b"))
    joined = a.join(b, key, "full")
    differing = F.array_compact(
        F.array(
            *[F.when(~F.col("_a")[f].eqNullSafe(F.col("_b")[f]), F.lit(f)) for f in fields]
        )
    )
    return joined.select(key, F.explode(differing).alias("field"))


def integrity_audit(runs: DataFrame, checks: dict[str, tuple[str, str]]) -> DataFrame:
    """(run_id, check) for payloads whose recomputed hash is not the stored one.

    ``checks`` maps a name to (payload column, hash column); an absent payload with an absent hash
    is in order.
    """
    failing = F.array_compact(
        F.array(
            *[
                F.when(~content_sha(payload).eqNullSafe(F.col(sha)), F.lit(name))
                for name, (payload, sha) in checks.items()
            ]
        )
    )
    return runs.select("run_id", F.explode(failing).alias("check"))


def ledger(entries: DataFrame, keep: int = lx.LEDGER_KEEP, order: tuple[str, ...] = ("at", "run_id")) -> tuple[DataFrame, DataFrame]:
    """(retained entries, one row with the attended total over all entries)."""
    newest = entries.orderBy(*[F.col(c).desc() for c in order]).limit(keep)
    totals = entries.agg(
        F.count("*").alias("entries"), F.count_if(F.col("mode") == "attended").alias("attended_applies")
    )
    return newest, totals
