"""Rules and what they bind: suppression rules, vector spaces, versions of a strategy, imported memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_states(log: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """The state of each rule by its latest entry (rule_id, revision, state, template_id, fingerprint), and what it resolves to.

    Only enabled rules can match. Of several for one template none does; one whose
    template is gone, or has another fingerprint than the rule was made for, is stale.
    """
    latest = log.groupBy("rule_id").agg(F.max(F.struct("revision", "state", "template_id", "fingerprint")).alias("r")).select("rule_id", "r.*")
    enabled = F.col("state") == "enabled"
    rivals = latest.where(enabled).groupBy("template_id").agg(F.count("*").alias("rivals"))
    rows = latest.join(rivals, "template_id", "left").join(fingerprints.select("template_id", F.col("fingerprint").alias("now")), "template_id", "left")
    kind = (
        F.when(~enabled, "inactive").when(F.col("template_id").isNull() | (F.coalesce("fingerprint", F.lit("")) == ""), "invalid_predicate").when(F.col("rivals") > 1, "conflicting_predicate")
        .when(F.col("now").isNull(), "stale_target_missing").when(F.col("now") != F.col("fingerprint"), "stale_fingerprint_changed").otherwise("matches_current")
    )
    return rows.select("rule_id", "revision", "state", "template_id", kind.alias("resolution"))


def trusted_lens(requested: DataFrame, states: DataFrame) -> DataFrame:
    """Of the templates asked to be hidden (template_id), those that a matching rule allows."""
    return requested.select("template_id").distinct().join(states.where("resolution = 'matches_current'"), "template_id", "left_semi")


def binding(stored: Column, asked: Column, fields: list[str]) -> Column:
    """Struct of verdict and drift: whether vectors of two spaces (structs of `fields` and dimensions) may be compared.

    No stored space, or one without measured dimensions, is unbound; dimensions that
    the asked one has not measured are no drift.
    """
    size = stored["dimensions"]
    differs = [F.when(~stored[f].eqNullSafe(asked[f]), F.lit(f)) for f in fields] + [F.when(size != asked["dimensions"], F.lit("dimensions"))]
    drift = F.array_compact(F.array(*differs))
    unbound = stored.isNull() | (F.coalesce(size, F.lit(0)) == 0)
    verdict = F.when(unbound, "legacy_unbound").when(F.size(drift) > 0, "drift").otherwise("bound")
    return F.struct(verdict.alias("verdict"), F.when(~unbound, F.array_join(drift, ",")).alias("drift"))


def version_pairs(runs: DataFrame, key: list[str], score: str) -> DataFrame:
    """Neighbouring versions of one strategy on one task and snapshot (`key`, version, run, score), and how the score changed.

    Runs without a version are left out. Runs of other snapshots are never compared, as the snapshot is part of the key.
    """
    along = Window.partitionBy(*key).orderBy("version", "run")
    before = lambda c: F.lag(c).over(along).alias(f"older_{c}")
    rows = runs.where("version is not null").select(*key, F.col("version").alias("newer_version"), F.col("run").alias("newer_run"), F.col(score).alias("now"), before("version"), before("run"), F.lag(score).over(along).alias("was"))
    change = F.when(F.col("now") > F.col("was"), "improved").when(F.col("now") < F.col("was"), "regressed").when(F.col("now") == F.col("was"), "unchanged").otherwise("incomparable")
    return rows.where("older_version <> newer_version").select(*key, "older_version", "newer_version", "older_run", "newer_run", change.alias("change"))


def imported(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """New memories of JSON lines (line): id, kind, content; the id is a hash of the content, so a second import adds nothing.

    Lines that are no JSON object with content are left out; equal contents are one memory, of the least kind.
    """
    parsed = lines.select(F.from_json("line", "kind string, content string").alias("m")).select("m.*").where("trim(content) <> ''")
    content = F.trim("content")
    rows = parsed.select(F.sha2(content, 256).alias("id"), "kind", content.alias("content")).groupBy("id").agg(F.min("kind").alias("kind"), F.min("content").alias("content"))
    return rows.join(stored.select("id"), "id", "left_anti")
