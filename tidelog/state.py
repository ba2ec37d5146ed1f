"""Event tables and rules with revisions: snapshots, a log of commits, compare-and-set, one-step undo.

A revision is one immutable folder, and one small file in the log that names it. The file is
made by creation without overwriting, so of two writers that saw the same revision one commits
and the other is refused. Readers go to the last file of the log; what a writer has left behind
without committing is never read.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from zoneinfo import available_timezones

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import fresh_folder, kept
from .sources import zones


class Conflict(RuntimeError):
    """The revision that a change was based on is no longer the last, or its updates do not match."""


@dataclass(frozen=True)
class Commit:
    """One entry of the log: `data` is the snapshot's folder, `before` the one it replaced (for undo), `note` what was done."""

    revision: int
    data: str
    before: str | None
    kind: str
    note: dict


class Versioned:
    """A table with revisions in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._log = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        self._fs = self._log.getFileSystem(self._conf)

    def history(self) -> list[Commit]:
        """All commits, first to last."""
        if not self._fs.exists(self._log):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._log) if s.getPath().getName().endswith(".json"))
        return [self._read(n) for n in names]

    def _read(self, name: str) -> Commit:
        stream = self._fs.open(self._jvm.org.apache.hadoop.fs.Path(self._log, name))
        try:
            return Commit(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def last(self) -> Commit | None:
        found = self.history()
        return found[-1] if found else None

    def revision(self) -> int:
        """The last committed revision, 0 before the first."""
        last = self.last()
        return last.revision if last else 0

    def read(self, revision: int | None = None) -> DataFrame:
        """The table at a revision, the last if none is given."""
        found = [c for c in self.history() if revision is None or c.revision == revision]
        if not found:
            raise LookupError("no such revision")
        return self.spark.read.parquet(found[-1].data)

    def _publish(self, commit: Commit) -> None:
        target = self._jvm.org.apache.hadoop.fs.Path(self._log, f"{commit.revision:020d}.json")
        try:
            out = self._fs.create(target, False)  # fails if another writer was first
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(f"revision {commit.revision} was committed by another writer") from e
            raise
        try:
            out.write(bytearray(json.dumps(commit.__dict__, sort_keys=True).encode()))
        finally:
            out.close()

    def commit(self, table: DataFrame, expected: int, kind: str, note: dict | None = None) -> Commit:
        """Writes `table` as the revision after `expected`; Conflict if that is no longer the last one, with nothing changed."""
        last = self.last()
        if (last.revision if last else 0) != expected:
            raise Conflict(f"expected revision {expected}, found {last.revision if last else 0}")
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        table.write.parquet(data)
        done = Commit(expected + 1, data, last.data if last else None, kind, note or {})
        self._publish(done)
        return done

    def undo(self, expected: int) -> Commit:
        """Takes back the last change, which must itself be no undo and no first commit, by a new revision that points to what it replaced."""
        last = self.last()
        if not last or last.revision != expected:
            raise Conflict(f"expected revision {expected}, found {last.revision if last else 0}")
        if last.before is None or last.kind == "undo":
            raise Conflict("nothing to undo")
        done = Commit(expected + 1, last.before, last.data, "undo", {"of": last.revision})
        self._publish(done)
        return done


def append(events: Versioned, more: DataFrame, expected: int) -> Commit:
    """`more` behind the events, as one revision. A seq that is there already, or twice in `more`, refuses the whole batch."""
    if expected:
        now = events.read()
        clash = more.select("seq").unionByName(now.join(more.select("seq"), "seq", "left_semi").select("seq"))
        table = now.unionByName(more)
    else:
        clash, table = more.select("seq"), more
    twice = clash.groupBy("seq").agg(F.count("*").alias("n")).where("n > 1 or seq is null").limit(1).collect()
    if twice:
        raise Conflict(f"seq {twice[0].seq} is not new")
    return events.commit(table, expected, "append", {"rows": more.count()})


def apply_times(events: Versioned, updates: DataFrame, expected: int, note: dict | None = None) -> Commit:
    """New times for events, all or none: `updates` has seq, source, expected_ts (null: none yet) and new_ts.

    Refused are updates that name an event twice, that match no event by seq, source and expected
    time, and a revision that is not the last. The snapshot keeps every other column.
    """
    now = events.read(expected) if expected else None
    if now is None or events.revision() != expected:
        raise Conflict(f"expected revision {expected}, found {events.revision()}")
    wanted = updates.select("seq", F.col("source").alias("_source"), F.col("expected_ts").cast("long").alias("_expected"), F.col("new_ts").cast("long").alias("_new"))
    n, kinds = wanted.agg(F.count("*"), F.count_distinct("seq")).first()
    if n != kinds:
        raise Conflict(f"{n} updates name {kinds} events")
    holds = F.col("ts").eqNullSafe(F.col("_expected")) & F.col("source").eqNullSafe(F.col("_source"))
    matched = now.join(wanted, "seq").where(holds).count()
    if matched != n:
        raise Conflict(f"{n} updates match {matched} events")
    hit = F.col("_hit") & holds
    joined = now.join(wanted.withColumn("_hit", F.lit(True)), "seq", "left")
    table = joined.withColumn("ts", F.when(hit, F.col("_new")).otherwise(F.col("ts"))).select(now.columns)
    return events.commit(table, expected, "times", {"updated": n} | (note or {}))


# What may become of a rule.
STATES = ("enabled", "disabled", "removed")
_NEXT = {"enable": ("disabled", "enabled"), "disable": ("enabled", "disabled"), "remove": (None, "removed")}
RULES = "rule_id string, template_id long, fingerprint string, state string, changed_in int"


def activate_rule(rules: Versioned, rule_id: str, template_id: int, fingerprint: str, previewed: int, events: Versioned, expected: int) -> Commit:
    """A rule that hides a template, as reviewed: refused if the events have changed since the preview, or the template has a rule that is not removed."""
    if events.revision() != previewed:
        raise Conflict("the events have changed since the preview")
    old = rules.read() if expected else rules.spark.createDataFrame([], RULES)
    if old.where((F.col("rule_id") == rule_id) | ((F.col("template_id") == template_id) & (F.col("state") != "removed"))).limit(1).collect():
        raise Conflict("the template has a rule, or the name is taken")
    new = rules.spark.createDataFrame([(rule_id, template_id, fingerprint, "enabled", expected + 1)], RULES)
    return rules.commit(old.unionByName(new), expected, "activate", {"rule_id": rule_id, "events": previewed})


def change_rule(rules: Versioned, rule_id: str, action: str, expected: int) -> Commit:
    """enable, disable or remove a rule; refused for what is unknown, removed, or already so."""
    needs, state = _NEXT[action]
    found = rules.read().where(F.col("rule_id") == rule_id).collect() if expected else []
    if not found or found[0].state == "removed" or needs not in (None, found[0].state):
        raise Conflict(f"{rule_id} cannot be changed by {action}")
    mine = F.col("rule_id") == rule_id
    table = rules.read().withColumns({"state": F.when(mine, state).otherwise(F.col("state")), "changed_in": F.when(mine, expected + 1).otherwise(F.col("changed_in"))})
    return rules.commit(table, expected, action, {"rule_id": rule_id})


def audit(table: Versioned) -> DataFrame:
    """revision, kind, note (JSON) of every commit, in order; the log is only ever appended to."""
    rows = [(c.revision, c.kind, json.dumps(c.note, sort_keys=True)) for c in table.history()]
    return table.spark.createDataFrame(rows, "revision int, kind string, note string").orderBy("revision")


def upsert_templates(templates: Versioned, rows: DataFrame, expected: int) -> Commit:
    """Templates by template_id, new ones added and known ones replaced, as one revision; one named twice, or without an id, refuses the whole."""
    wrong = rows.groupBy("template_id").agg(F.count("*").alias("n")).where("n > 1 or template_id is null").limit(1).collect()
    if wrong:
        raise Conflict(f"template {wrong[0].template_id} is not named once")
    old = templates.read().join(rows.select("template_id"), "template_id", "left_anti") if expected else rows.limit(0)
    return templates.commit(old.unionByName(rows), expected, "templates", {"rows": rows.count()})


def apply_zones(events: Versioned, declared: dict[str, str], expected: int) -> Commit:
    """Resolves the local times of whole sources by their declared zones.

    Events have local (calendar seconds), abbreviation and basis besides seq, source and ts. A
    time that its line gives with an offset (explicit_wall) stays; a local one that the zone
    settles gets ts and basis resolved_local, any other has no ts and basis unresolved_local, also
    if an earlier declaration had settled it. The note counts reasons.
    """
    if not expected or events.revision() != expected:
        raise Conflict(f"expected revision {expected}, found {events.revision()}")
    unknown = sorted(set(declared.values()) - available_timezones())
    if unknown:
        raise Conflict(f"no zone {unknown[0]}")
    now = events.read(expected)
    zone = F.create_map(*(F.lit(x) for pair in sorted(declared.items()) for x in pair)) if declared else F.create_map().cast("map<string,string>")
    local = now.where(F.col("source").isin(*declared) & (F.col("basis") != "explicit_wall") & F.col("local").isNotNull())
    told = zones.resolved(local.select("seq", "local", F.try_element_at(zone, F.col("source")).alias("zone"), "abbreviation"), zones.offsets(events.spark, list(declared.values())), "seq")
    told = kept(told, fresh_folder(events.spark, "zones")).select("seq", F.col("ts").alias("_ts"), "reason")
    counts = {r.reason: r.n for r in told.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    joined = now.join(told, "seq", "left")
    new = F.col("reason").isNotNull()
    basis = F.when(new & (F.col("reason") == "resolved"), "resolved_local").when(new, "unresolved_local").otherwise(F.col("basis"))
    table = joined.withColumns({"ts": F.when(new, F.col("_ts")).otherwise(F.col("ts")), "basis": basis}).select(now.columns)
    return events.commit(table, expected, "zones", {"declared": declared, "reasons": counts})


def clear_zone(events: Versioned, source: str, expected: int) -> Commit:
    """Takes back what declarations have settled for a source: its resolved local times are unresolved again; Conflict if there are none."""
    if not expected or events.revision() != expected:
        raise Conflict(f"expected revision {expected}, found {events.revision()}")
    now = events.read(expected)
    mine = (F.col("source") == source) & (F.col("basis") == "resolved_local")
    n = now.where(mine).count()
    if not n:
        raise Conflict(f"nothing to clear for {source}")
    table = now.withColumns({"ts": F.when(~F.coalesce(mine, F.lit(False)), F.col("ts")), "basis": F.when(mine, "unresolved_local").otherwise(F.col("basis"))})
    return events.commit(table.select(now.columns), expected, "clear_zone", {"source": source, "cleared": n})
