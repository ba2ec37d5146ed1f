"""Repair of conversations whose turns are missing, blank, repeated, cut off or misattributed.

The cheapest edits that give roles ``(s?(ua)+)?`` come from a dynamic programme over the
turns, with four states: nothing yet, after the system's, the user's, the assistant's turn.
Conversations of one length form one time-major tensor, turns by conversations by states;
costs are filled from the last turn to the first for all of them at once, and the edits are
traced forward at once.

Turns are range-partitioned by conversation and turn, so a long conversation is spread over
tasks. What begins and ends in one buffer of PIECE_ROWS turns is finished there. The
conversations at a partition's borders and longer ones become pieces, each with the costs
from every state to every state; scans over these small tables give each piece the costs
behind it and the state before it. Only the hash of a repaired conversation, a chain by its
nature, streams through one task, piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
PIECE_ROWS = 65_536
PIECE_BYTES = 32 << 20

#: States: 0 nothing, 1 system, 2 user, 3 assistant. Initials: 0 s, 1 u, 2 a, 3 any other.
TARGET = np.array([2, 2, 3, 2])  # where an inserted or reassigned turn leads
NEXT = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])  # state by initial of a kept turn
ROLE = {2: "user", 3: "assistant"}
FINE, BLANK, DUPLICATE, CUT = range(4)
NEVER = 1 << 40
END = np.array([0, 2 * INSERT, INSERT, 0])
_SPACE = " \t\n\v\f\r"


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32(``conv_id:turn``) % 20, nulls read as one space.

    0 drops a row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row, 4 sets role user.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _closed(b: np.ndarray) -> np.ndarray:
    """Costs where turns may be inserted first; two in a row lead from any state to any that is worth it."""
    for _ in range(2):
        b = np.minimum(b, INSERT + b[:, TARGET])
    return b


def costs(initial: np.ndarray, fault: np.ndarray, final: np.ndarray) -> np.ndarray:
    """Backward costs, turns + 1 by columns by states, of columns of turns (time-major) that end with costs `final`."""
    out = np.empty((len(initial) + 1, *final.shape), np.int64)
    out[-1] = _closed(final)
    for t in range(len(initial) - 1, -1, -1):
        later, at = out[t + 1], NEXT.T[initial[t]]
        extra = np.where(fault[t] == CUT, TRUNCATED, 0)[:, None]
        keep = np.where(at >= 0, np.take_along_axis(later, np.maximum(at, 0), 1), NEVER)
        stay = np.minimum(keep, REROLE + later[:, TARGET]) + extra
        stay[(fault[t] == BLANK) | (fault[t] == DUPLICATE)] = NEVER
        out[t] = _closed(np.minimum(DELETE + later, stay))
    return out


def trace(initial: np.ndarray, fault: np.ndarray, cost: np.ndarray, state: np.ndarray, last: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The ASCII-least cheapest edits of each column, and the state that it ends in. Where `last`, turns are inserted at the end too."""
    n, (columns,) = len(initial), state.shape
    at, state, every = np.zeros(columns, np.int64), state.copy(), np.arange(columns)
    steps = []
    while True:
        live = (at < n) | (last & (state != 0) & (state != 3))
        if not live.any():
            break
        c = every[live]
        p, s = at[c], state[c]
        inside = p < n
        row = np.minimum(p, max(n - 1, 0))
        now, after = cost[p, c, s], np.minimum(p + 1, n)
        kind, wrong = (initial[row, c], fault[row, c]) if n else (np.zeros(len(c), np.int64),) * 2
        extra = np.where(wrong == CUT, TRUNCATED, 0)
        stays = inside & (wrong != BLANK) & (wrong != DUPLICATE)
        to = NEXT[s, kind]
        delete = inside & (DELETE + cost[after, c, s] == now)
        insert = ~delete & (INSERT + cost[p, c, TARGET[s]] == now)
        keep = ~delete & ~insert & stays & (to >= 0) & (extra + cost[after, c, np.maximum(to, 0)] == now)
        op = np.where(delete, ord("D"), np.where(insert, ord("I"), np.where(keep, ord("K"), ord("R"))))
        state[c] = np.where(delete, s, np.where(keep, to, TARGET[s]))
        at[c] += ~insert
        step = np.zeros(columns, np.uint8)
        step[c] = op
        steps.append(step)
    ops = np.array(steps, np.uint8).reshape(-1, columns).T.copy()
    return [o.tobytes().rstrip(b"\0").decode() for o in ops], state


def rewritten(edits: str, state: int, roles: list[str], texts: list[str], initial: np.ndarray) -> list[tuple[str, str]]:
    """The turns that `edits` leave or insert."""
    out, at = [], 0
    for op in edits:
        if op == "K":
            state = NEXT[state, initial[at]]
            out.append((roles[at], texts[at]))
        elif op != "D":
            state = TARGET[state]
            out.append((ROLE[int(state)], texts[at] if op == "R" else ""))
        at += op != "I"
    return out


def _text(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for role, text in turns)


_TURN = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_DIGEST = [("conv_id", pa.int64()), ("gaps", pa.int64()), *((n, pa.int64()) for n in _COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()), ("begin", pa.int64()), ("repaired", pa.list_(_TURN))]
_DIGEST_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, begin long, repaired array<struct<role: string, text: string>>"
_PIECE = pa.schema([*_DIGEST, ("part", pa.int32()), ("no", pa.int32()), ("codes", pa.binary()), ("matrix", pa.list_(pa.int64())), ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), ("first", pa.int32()), ("final", pa.int32()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PIECE_SQL = _DIGEST_SQL + ", part int, no int, codes binary, matrix array<long>, least long, most long, turns long, first int, final int, roles array<string>, texts array<string>"


class _Turns:
    """Turns in order, with the spans of their conversations, initials and first faults."""

    def __init__(self, table: pa.Table, before: dict | None):
        table = table.combine_chunks()
        col = {n: (c.chunk(0) if (c := table.column(n)).num_chunks else pa.array([], c.type)) for n in table.column_names}
        self.conv, self.role, self.text = col["conv_id"], col["role"], col["text"]
        n = len(self.conv)
        null, conv = (np.asarray(pc.is_null(self.conv)), self.conv.fill_null(0).to_numpy())
        new = np.ones(n, bool)
        new[1:] = (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])
        self.begin = np.append(np.flatnonzero(new), n)
        self.no_turn, self.turn = np.asarray(pc.is_null(col["turn"])), col["turn"].fill_null(0).to_numpy()
        letter = pc.utf8_slice_codeunits(self.role, 0, 1)
        self.initial = np.full(n, 3, np.int8)
        for i, name in enumerate("sua"):
            self.initial[np.asarray(pc.equal(letter, name))] = i
        ink = pc.utf8_rtrim(self.text, characters=_SPACE)
        ended = np.asarray(pc.or_(pc.or_(pc.ends_with(ink, "."), pc.ends_with(ink, "!")), pc.ends_with(ink, "?")))
        late = np.asarray(col["late"]).astype(bool)
        same = np.zeros(n, bool)  # as the row before, in one turn; rows of a turn are sorted, so equal ones are neighbours
        for i in np.flatnonzero(~new & (np.append(False, (self.turn[1:] == self.turn[:-1]) & (self.no_turn[1:] == self.no_turn[:-1])))):
            same[i] = self.role[i] == self.role[i - 1] and self.text[i] == self.text[i - 1]
        if n and before and before == self.row(0):
            same[0] = True
        blank = np.asarray(pc.equal(ink, ""))
        self.fault = np.where(blank, BLANK, np.where(late | same, DUPLICATE, np.where(ended, FINE, CUT))).astype(np.int8)
        pair = self.initial[:-1].astype(int) * 4 + self.initial[1:]
        self.illegal = np.append(~np.isin(pair, [1, 6, 9]), False)  # su, ua, au

    def row(self, i: int) -> dict:
        return {"conv": self.conv[i].as_py(), "turn": None if self.no_turn[i] else int(self.turn[i]), "role": self.role[i].as_py(), "text": self.text[i].as_py()}

    def facts(self, a: int, b: int) -> dict:
        turns = self.turn[a:b][~self.no_turn[a:b]]
        counts = np.bincount(self.fault[a:b], minlength=4)
        return {
            "conv_id": self.conv[a].as_py(), "blank": int(counts[BLANK]), "duplicate": int(counts[DUPLICATE]), "truncated": int(counts[CUT]), "illegal": int(self.illegal[a : b - 1].sum()),
            "least": int(turns[0]) if len(turns) else None, "most": int(turns[-1]) if len(turns) else None, "turns": int((turns[1:] != turns[:-1]).sum() + 1) if len(turns) else 0,
        }


def _gaps(least: int | None, most: int | None, turns: int) -> int:
    return most - least + 1 - turns if turns else 0


def _finished(t: _Turns, spans: list[tuple[int, int]], rows: bool) -> Iterator[dict]:
    """Digests of whole conversations, one tensor for each length."""
    by_length: dict[int, list[int]] = {}
    for a, b in spans:
        by_length.setdefault(b - a, []).append(a)
    for n, begins in by_length.items():
        at = np.arange(n)[:, None] + np.array(begins)[None, :]
        initial, fault = t.initial[at], t.fault[at]
        start = np.zeros(len(begins), np.int64)
        cost = costs(initial, fault, np.tile(END, (len(begins), 1)))
        edits, _ = trace(initial, fault, cost, start, start == 0)
        for i, a in enumerate(begins):
            f = t.facts(a, a + n)
            turns = rewritten(edits[i], 0, t.role[a : a + n].to_pylist(), t.text[a : a + n].to_pylist(), initial[:, i])
            gaps = _gaps(f.pop("least"), f.pop("most"), f.pop("turns"))
            yield f | {"gaps": gaps, "cost": int(cost[0, i, 0]), "audit": edits[i], "repaired_sha256": hashlib.sha256(_text(turns).encode()).hexdigest(), "begin": 0, "repaired": [{"role": r, "text": x} for r, x in turns] if rows else None}


def _piece(t: _Turns, a: int, b: int, part: int, no: int) -> dict:
    initial, fault = np.repeat(t.initial[a:b, None], 4, 1), np.repeat(t.fault[a:b, None], 4, 1)
    matrix = costs(initial, fault, np.where(np.eye(4, dtype=bool), 0, NEVER))[0].T  # from state by to state
    codes = (t.initial[a:b] * 4 + t.fault[a:b]).astype(np.uint8).tobytes()
    return t.facts(a, b) | {"part": part, "no": no, "codes": codes, "matrix": np.minimum(matrix, NEVER).ravel().tolist(), "first": int(t.initial[a]), "final": int(t.initial[b - 1]), "roles": t.role[a:b].to_pylist(), "texts": t.text[a:b].to_pylist()}


def _pieces(rows: bool, piece_rows: int):
    """Digests of the conversations that begin and end inside a partition, pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, before = TaskContext.get().partitionId(), 0, None
        held: pa.Table | None = None
        head_open = True

        def out(t: _Turns, upto: int, tail_open: bool) -> list[dict]:
            nonlocal no
            spans = list(zip(t.begin[:upto], t.begin[1 : upto + 1]))
            open_at = {0} if head_open else set()
            if tail_open:
                open_at.add(len(spans) - 1)
            found = list(_finished(t, [s for i, s in enumerate(spans) if i not in open_at], rows))
            for i in sorted(open_at):
                found.append(_piece(t, *spans[i], part, no))
                no += 1
            return found

        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows < piece_rows and held.nbytes < PIECE_BYTES:
                continue
            t = _Turns(held, before)
            whole = len(t.begin) - 2  # conversations before the last, which may go on
            if whole:
                found, cut = out(t, whole, False), int(t.begin[whole])
                head_open, held, before = False, held.slice(cut), None
            else:
                found = out(t, 1, True)
                head_open, held, before = True, None, t.row(len(t.turn) - 1)
            yield from _batched(found, _PIECE)
        if held is not None and held.num_rows:
            t = _Turns(held, before)
            yield from _batched(out(t, len(t.begin) - 1, True), _PIECE)

    return run


def _batched(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of rows; one with texts comes alone."""
    small = [r for r in rows if not r.get("texts") and not r.get("repaired")]
    for i in range(0, len(small), 4096):
        yield pa.RecordBatch.from_pylist(small[i : i + 4096], schema=schema)
    large = [r for r in rows if r.get("texts") or r.get("repaired")]
    for i in range(0, len(large), 64):
        yield pa.RecordBatch.from_pylist(large[i : i + 64], schema=schema)


_TAIL_SQL = "part int, no int, tail array<long>, is_last boolean, total long"
_TAIL = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("tail", pa.list_(pa.int64())), ("is_last", pa.bool_()), ("total", pa.int64())])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs behind each piece, and from each piece on; pieces come last first."""
    conv, tail = (False,), END
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            is_last = conv != (x["conv_id"],)
            if is_last:
                conv, tail = (x["conv_id"],), END
            here = np.minimum((np.array(x["matrix"]).reshape(4, 4) + tail).min(1), NEVER)
            out.append({"part": x["part"], "no": x["no"], "tail": tail.tolist(), "is_last": is_last, "total": int(here[0])})
            tail = here
        yield pa.RecordBatch.from_pylist(out, schema=_TAIL)


_TRACED = pa.schema([("part", pa.int32()), ("no", pa.int32()), ("edits", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's edits and last state for each state before it."""
    for batch in batches:
        for x in batch.to_pylist():
            codes = np.frombuffer(x["codes"], np.uint8)[:, None].repeat(4, 1)
            initial, fault = (codes >> 2).astype(np.int8), (codes & 3).astype(np.int8)
            cost = costs(initial, fault, np.tile(np.array(x["tail"]), (4, 1)))
            edits, state = trace(initial, fault, cost, np.arange(4), np.full(4, x["is_last"]))
            yield pa.RecordBatch.from_pylist([{"part": x["part"], "no": x["no"], "edits": edits, "exits": state.tolist()}], schema=_TRACED)


def _stitched(rows: bool):
    """Digests of conversations from their pieces in order."""
    schema = pa.schema(_DIGEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def digest() -> pa.RecordBatch:
            done = {n: now[n] for n in ("conv_id", *_COUNTS, "cost")} | {"gaps": _gaps(now["least"], now["most"], now["turns"]), "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}
            return pa.RecordBatch.from_pylist([done], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                x = batch.slice(i, 1).to_pylist()[0]
                if now is None or now["conv_id"] != x["conv_id"]:
                    if now:
                        yield digest()
                    now = {"conv_id": x["conv_id"], "cost": x["total"], "audit": [], "hash": hashlib.sha256(), "least": None, "most": None, "turns": 0, "state": 0, "final": None, "n": 0} | dict.fromkeys(_COUNTS, 0)
                for name in _COUNTS:
                    now[name] += x[name]
                if now["final"] is not None:
                    now["illegal"] += now["final"] * 4 + x["first"] not in (1, 6, 9)
                now["final"] = x["final"]
                if x["turns"]:
                    now["turns"] += x["turns"] - (now["most"] == x["least"])
                    now["least"], now["most"] = x["least"] if now["least"] is None else now["least"], x["most"]
                edits = x["edits"][now["state"]]
                turns = rewritten(edits, now["state"], x["roles"], x["texts"], np.frombuffer(x["codes"], np.uint8) >> 2)
                now["state"] = x["exits"][now["state"]]
                now["audit"].append(edits)
                if turns:
                    now["hash"].update((("\n" if now["n"] else "") + _text(turns)).encode())
                    if rows:
                        yield pa.RecordBatch.from_pylist([{"conv_id": x["conv_id"], "begin": now["n"], "repaired": [{"role": r, "text": t} for r, t in turns]}], schema=schema)
                    now["n"] += len(turns)
        if now:
            yield digest()

    return run


def _repaired(turns: DataFrame, rows: bool, piece_rows: int) -> DataFrame:
    spark = turns.sparkSession
    scratch = Scratch(spark, "conversations")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lines = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    lines = lines.withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    place = F.struct(F.col("turn").isNotNull().alias("a"), F.coalesce("turn", F.lit(0)).alias("b"))  # nulls first
    seen = lines.groupBy(F.col("conv_id").alias("of"), F.col("digest").alias("what")).agg(F.min(place).alias("earliest"), F.max(place).alias("latest")).where("earliest < latest")
    marked = lines.join(seen, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("what")), "left")
    marked = marked.select("conv_id", "turn", "role", "text", F.coalesce(place > F.col("earliest"), F.lit(False)).alias("late"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    kept = scratch.keep(marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pieces(rows, piece_rows), _PIECE_SQL), "pieces")
    names = [n for n, _ in _DIGEST]
    pieces = kept.where("no is not null")
    back = [F.col("conv_id").asc_nulls_first(), F.desc("part"), F.desc("no")]
    tails = scratch.keep(pieces.select("conv_id", "part", "no", "matrix").repartition(parts, "conv_id").sortWithinPartitions(*back).mapInArrow(_tails, _TAIL_SQL), "tails")
    traced = pieces.select("part", "no", "codes").join(tails, ["part", "no"]).select("part", "no", "codes", "tail", "is_last").mapInArrow(_traced, "part int, no int, edits array<string>, exits array<int>")
    whole = pieces.join(tails.select("part", "no", "total"), ["part", "no"]).join(traced, ["part", "no"])
    forth = whole.select("conv_id", "part", "no", *_COUNTS, "codes", "least", "most", "turns", "first", "final", "roles", "texts", "total", "edits", "exits").repartition(parts, "conv_id")
    stitched = forth.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "no").mapInArrow(_stitched(rows), _DIGEST_SQL)
    return kept.where("no is null").select(*names).unionByName(stitched)


def repaired_conversations(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row per conversation of `turns`: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `turns` needs conv_id, turn, role and text. Null roles and texts are read as one space; rows
    with a null conv_id are one conversation. Rows come by turn, nulls first, then by role and
    text. A row's first fault counts: blank, duplicate (role and text seen earlier), truncated
    (the last character that is no space is none of ``.!?``). audit holds the cheapest edits,
    Keep, Rerole, Delete and Insert, the ASCII-least of several.
    """
    return _repaired(turns, False, piece_rows).where("audit is not null").select("conv_id", "gaps", *_COUNTS, "cost", "audit", "repaired_sha256")


def repaired_turns(turns: DataFrame, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The turns after repair: conv_id, place (from 0), role, text. Edge cases are those of `repaired_conversations`; conversations without turns left have no row."""
    found = _repaired(turns, True, piece_rows).where("repaired is not null").select("conv_id", "begin", F.posexplode("repaired").alias("at", "turn"))
    return found.select("conv_id", (F.col("begin") + F.col("at")).alias("place"), "turn.role", "turn.text")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """`repaired_conversations` of `damaged` turns, for every conv_id of `turns`; one without rows after damage has zeros, no edits and the hash of an empty text."""
    ids = turns.select(F.col("conv_id").cast("long").alias("id")).distinct()
    found = ids.join(repaired_conversations(damaged(turns)), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", *_COUNTS, "cost")]
    return found.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


#: `damaged_and_repaired` of the table conversations; the checksum goes bit by bit, the costs and edits turn by turn.
ORACLE = """
WITH RECURSIVE k AS (
  SELECT DISTINCT conv_id, turn, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), fate AS MATERIALIZED (
  SELECT conv_id, turn, xor(list_reduce(list_transform(range(0, 8 * len(k)), lambda j: CASE WHEN j % 8 = 0 THEN ord(k[(j // 8 + 1)::INT])::BIGINT ELSE 0 END),
    lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END, 4294967295), 4294967295) % 20 AS fate FROM k
), d AS (
  SELECT v.conv_id, v.turn, CASE WHEN fate = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE coalesce(text, ' ') END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM conversations v JOIN fate f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND v.turn IS NOT DISTINCT FROM f.turn WHERE fate <> 0
), o AS (
  SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ink, dense_rank() OVER (ORDER BY conv_id) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth FROM d
), r AS MATERIALIZED (
  SELECT *, CASE WHEN ink = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(ink, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS fault,
    CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS init,
    left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS pair FROM o
), f AS MATERIALIZED (
  SELECT c, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
    count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c
), back AS (
  SELECT c, n + 1 AS i, [0, 10, 5, 0] AS b FROM f
  UNION ALL
  SELECT c, i, [least(p[1], 5 + p[3], 10 + p[4]), least(p[2], 5 + p[3], 10 + p[4]), least(p[3], 5 + p[4]), least(p[4], 5 + p[3])] FROM (
    SELECT r.c, r.i, [least(2 + b[1], stay + 1 + b[3], CASE init WHEN 0 THEN stay + b[2] WHEN 1 THEN stay + b[3] END), least(2 + b[2], stay + 1 + b[3], CASE init WHEN 1 THEN stay + b[3] END),
      least(2 + b[3], stay + 1 + b[4], CASE init WHEN 2 THEN stay + b[4] END), least(2 + b[4], stay + 1 + b[3], CASE init WHEN 1 THEN stay + b[3] END)] AS p
    FROM (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 END AS stay FROM r) r JOIN back ON back.c = r.c AND back.i = r.i + 1)
), cost AS MATERIALIZED (SELECT * FROM back
), place AS MATERIALIZED (
  SELECT here.c, here.i, here.b, after.b AS later, CASE r.fault WHEN 0 THEN 0 WHEN 3 THEN 5 END AS stay, r.init, r.role, r.text
  FROM cost here LEFT JOIN cost after ON after.c = here.c AND after.i = here.i + 1 LEFT JOIN r ON r.c = here.c AND r.i = here.i
), walk AS (
  SELECT c, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS lines FROM f
  UNION ALL
  SELECT c, CASE WHEN op = 'I' THEN i ELSE i + 1 END, CASE op WHEN 'D' THEN s WHEN 'K' THEN kept ELSE made END, audit || op,
    CASE op WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, CASE made WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE op WHEN 'R' THEN text ELSE '' END) END
  FROM (
    SELECT *, CASE WHEN 2 + later[s + 1] = b[s + 1] THEN 'D' WHEN 5 + b[made + 1] = b[s + 1] THEN 'I' WHEN stay + later[kept + 1] = b[s + 1] THEN 'K' ELSE 'R' END AS op FROM (
      SELECT w.*, a.b, a.later, a.stay, a.role, a.text, CASE s WHEN 2 THEN 3 ELSE 2 END AS made,
        CASE WHEN s = 0 AND init = 0 THEN 1 WHEN s <> 2 AND init = 1 THEN 2 WHEN s = 2 AND init = 2 THEN 3 END AS kept
      FROM walk w JOIN place a ON a.c = w.c AND a.i = w.i WHERE a.later IS NOT NULL OR s IN (1, 2)))
), done AS (
  SELECT f.*, w.audit, w.lines, a.b[1] AS cost FROM f JOIN walk w ON w.c = f.c AND w.i = f.n + 1 AND w.s IN (0, 3) JOIN cost a ON a.c = f.c AND a.i = 1
)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) v LEFT JOIN done ON v.conv_id IS NOT DISTINCT FROM done.conv_id"""
