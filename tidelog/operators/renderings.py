"""Renderings of exceptions in a stream of records, and chains of renderings that tell of one occurrence.

A rendering is one record with a whole stack, or records of one source and thread that a
stream wrapped line by line. Lines are told apart by Spark's expressions; a lane's lines are cut
into segments at headers, at records that close a source's lanes, and at gaps, all by windows
over blocks of sequence numbers, so a busy source is shared by many tasks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import _once, exception_signature
from ..shared import fresh_folder, kept
from . import long_chains
from .exceptions import below_stack, envelope, graph, line_role
from .graphs import components

# Records and bytes of a rendering, gaps in sequence numbers and seconds between its records, the span of a chain.
MAX_RECORDS, MAX_PAYLOAD, SEQ_GAP, WALL_GAP, CHAIN_SPAN = 400, 8_192, 8, 5, 5
#: Beyond so many sequence numbers behind its header a rendering can hold no further record.
REACH = MAX_RECORDS * SEQ_GAP
BLOCK = 2 * REACH
#: Renderings of a component that chains are grown among on bit sets; a larger one is grown by `long_chains`, in memory that grows with its rows only.
ON_BITS = 2_048


def _last_before(rows: DataFrame, lane: list[str], is_mark: Column, name: str, own: bool) -> DataFrame:
    """`rows` with the seq of the lane's last marked row before each row (or at it, with `own`), at most a block back."""
    within = Window.partitionBy(*lane, "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    marked = rows.withColumn("_here", F.max(F.when(is_mark, F.col("seq"))).over(within))
    ends = rows.where(is_mark).groupBy(*[F.col(c).alias(f"_{c}") for c in lane], (F.col("block") + 1).alias("_block")).agg(F.max("seq").alias("_earlier"))
    same = F.col("block") == F.col("_block")
    for c in lane:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return marked.join(ends, same, "left").withColumn(name, F.coalesce("_here", "_earlier")).drop("_here", "_earlier", "_block", *[f"_{c}" for c in lane])


def _told(events: DataFrame) -> DataFrame:
    """Each record with its envelope and what its line is."""
    rows = events.where("seq is not null and source is not null").select("seq", "source", "ts", "wall", "service", "host", "trace_id", F.coalesce("message", F.lit("")).alias("message"))
    rows = rows.withColumn("e", _once(F.col("message"), envelope))
    rows = rows.withColumns({"payload": F.coalesce(F.col("e.payload"), F.lit("")), "bad": F.col("e.conflict") | F.col("e.malformed")})
    single = F.size(F.filter(F.split("payload", "\n"), lambda y: F.trim(y) != "")) <= 1
    rows = rows.withColumn("role", F.when(single, _once(F.trim("payload"), line_role)))
    rows = rows.withColumn("wrapped", F.col("e.stream").isNotNull() | F.col("role").isNotNull())
    rows = rows.withColumn("text", F.when(F.col("wrapped"), F.col("payload")).otherwise(F.col("message")))
    rows = rows.withColumn("said", exception_signature(F.col("text")))
    rows = rows.withColumn("whole", F.when(F.col("said").isNotNull(), F.exists(F.slice(F.split("text", "\n"), 2, 1 << 30), below_stack)))
    wrapped, whole, said = F.col("wrapped"), F.col("whole"), F.col("said")
    kind = (
        F.when(~wrapped & whole & said.isNotNull(), "full").when(~wrapped, "closer").when(F.col("bad") & said.isNotNull(), "alone").when(F.col("bad"), "closer")
        .when(whole & said.isNotNull(), "complete").when(said.isNotNull() & (F.col("role") == "cause"), "cause").when(said.isNotNull(), "header").when(F.col("role").isNotNull(), "frame")
    )
    told = rows.select("seq", "source", "ts", F.coalesce("wall", F.lit(True)).alias("wall"), "service", "host", F.col("trace_id").alias("trace"), F.col("e.thread").alias("thread"), F.col("e.request").alias("request"), F.col("bad").alias("conflict"), F.col("text").alias("payload"), said.alias("signature"), kind.alias("what"))
    return told.withColumn("block", F.floor(F.col("seq") / BLOCK))


def _grown(rows: Column) -> Column:
    """The renderings of one segment, its rows in order: each row extends the open one, opens one or is passed over."""
    fresh = lambda x: F.struct(
        x["seq"].alias("first_seq"), x["seq"].alias("last_seq"), x["ts"].alias("first_ts"), x["ts"].alias("last_ts"), x["wall"].alias("wall"), F.lit(1).alias("records"), F.lit(True).alias("complete"),
        x["signature"].alias("signature"), F.substring(x["payload"], 1, MAX_PAYLOAD).alias("payload"), x["trace"].alias("trace"), x["request"].alias("request"),
    )

    def extended(o: Column, x: Column) -> Column:
        full = o["records"] >= MAX_RECORDS
        keep = lambda name, new: F.when(full, o[name]).otherwise(new).alias(name)
        more = F.substring(F.concat(o["payload"], F.lit("\n"), x["payload"]), 1, MAX_PAYLOAD)
        return F.struct(
            o["first_seq"], keep("last_seq", x["seq"]), o["first_ts"], keep("last_ts", x["ts"]), o["wall"], keep("records", o["records"] + 1), (o["complete"] & ~full).alias("complete"),
            F.when(x["what"] == "cause", x["signature"]).otherwise(o["signature"]).alias("signature"), keep("payload", more), keep("trace", F.coalesce(o["trace"], x["trace"])), keep("request", F.coalesce(o["request"], x["request"])),
        )

    def step(done: Column, x: Column) -> Column:
        o = F.get(done, F.size(done) - 1)  # null while nothing is open
        near = F.coalesce((x["seq"] - o["last_seq"] <= SEQ_GAP) & (~(o["wall"] & x["wall"]) | (F.abs(x["ts"] - o["last_ts"]) <= WALL_GAP)), F.lit(False))
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        joins = near & x["what"].isin("cause", "frame")
        return F.when(joins, F.concat(before, F.array(extended(o, x)))).when(x["what"].isin("cause", "header"), F.concat(done, F.array(fresh(x)))).otherwise(done)

    nothing = F.slice(F.array(fresh(F.get(rows, F.lit(0)))), 1, 0)
    return F.aggregate(rows, nothing, step)


def renderings(events: DataFrame) -> DataFrame:
    """id (the first record's seq), kind (full or wrapped), source, thread, signature, records, complete, first and last seq and ts, wall, payload, service, host, trace, request, conflict.

    `events` needs seq (unique), source, ts, wall (whether ts is of a clock), message, service,
    host and trace_id. A record with a whole stack is a rendering and closes all open lanes of
    its source, as does every record that is no wrapped line. A header opens a lane (source and
    thread), frames and scaffolding extend it, a cause extends it and gives it its signature; what
    is further away than SEQ_GAP records or, by the clock, WALL_GAP seconds does not join, and
    a cause that cannot join opens a lane. A malformed or conflicting envelope closes its source's
    lanes, joins nothing, and stands alone if it has a signature. Records without seq or source
    are left out. What follows a header without another one over more than REACH records is left out.
    """
    path = fresh_folder(events.sparkSession, "renderings")
    told = kept(_told(events), path).where("what is not null")  # behind the table, as a filter before it would tell each record twice
    single = told.where(F.col("what").isin("full", "alone", "complete"))
    alone = single.select(
        F.col("seq").alias("id"), F.when(F.col("what") == "full", "full").otherwise("wrapped").alias("kind"), "source", "thread", "signature", F.lit(1).alias("records"), F.lit(True).alias("complete"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"),
        F.col("ts").alias("first_ts"), F.col("ts").alias("last_ts"), "wall", F.substring("payload", 1, MAX_PAYLOAD).alias("payload"), "service", "host", "trace", "request", "conflict",
    )
    lane = ["source", "thread"]
    closed = _last_before(told, ["source"], F.col("what").isin("full", "alone", "closer"), "closer", False)
    lines = closed.where(F.col("what").isin("header", "cause", "frame", "complete"))
    lines = _last_before(lines, lane, F.lit(True), "_previous", False)
    alone_here = F.coalesce(F.col("seq") - F.col("_previous") > SEQ_GAP, F.lit(True)) | F.coalesce(F.col("closer") > F.col("_previous"), F.lit(False))
    lines = lines.withColumn("starts", F.col("what").isin("header", "complete") | alone_here).drop("_previous")
    held = _last_before(lines, lane, F.col("starts"), "start", True).where((F.col("seq") - F.col("start") <= REACH) & F.coalesce(F.col("closer") < F.col("start"), F.lit(True)))
    row = F.struct("seq", "ts", "wall", "payload", "signature", "what", "trace", "request", "service", "host")
    segments = held.groupBy(*lane, "start").agg(F.array_sort(F.collect_list(row)).alias("rows"))  # at most REACH rows each
    lead = F.get("rows", F.lit(0))
    grown = segments.select("source", "thread", lead["service"].alias("service"), lead["host"].alias("host"), F.explode(_grown(F.col("rows"))).alias("r"))
    wrapped = grown.select(
        F.col("r.first_seq").alias("id"), F.lit("wrapped").alias("kind"), "source", "thread", "r.signature", "r.records", "r.complete", "r.first_seq", "r.last_seq", "r.first_ts", "r.last_ts", "r.wall", "r.payload", "service", "host", "r.trace", "r.request", F.lit(False).alias("conflict")
    )
    return alone.unionByName(wrapped)


def _groups(values: list) -> tuple[list[int], list[int]]:
    """For each row the rows of an equal value and those of another one, as bits; nulls are in neither."""
    of: dict = {}
    for i, v in enumerate(values):
        if v is not None:
            of[v] = of.get(v, 0) | 1 << i
    some = sum(of.values())
    same = [0 if v is None else of[v] for v in values]
    return same, [some & ~m if m else 0 for m in same]


def _related(col: dict) -> list[int]:
    """For each row the rows of the same signature or with types that end alike, as bits."""
    same, _ = _groups(col["signature"])
    types = [tuple(t) for t in col["types"]]
    of: dict = {}
    for i, t in enumerate(types):
        of[t] = of.get(t, 0) | 1 << i
    ends = dict.fromkeys(of, 0)
    for t in of:
        for k in range(len(t)):
            if t[k:] in of:
                ends[t] |= of[t[k:]]
                ends[t[k:]] |= of[t]
    return [m | ends[t] for m, t in zip(same, types)]


def _up_to(values: list[int]) -> Callable[[int], int]:
    """The rows whose value is at most a bound, as bits, by bound."""
    order = sorted(range(len(values)), key=values.__getitem__)
    bounds, masks = [values[i] for i in order], [0]
    for i in order:
        masks.append(masks[-1] | 1 << i)
    return lambda bound: masks[bisect_right(bounds, bound)]


def _bits(mask: int) -> Iterator[int]:
    while mask:
        yield (mask & -mask).bit_length() - 1
        mask &= mask - 1


def _grown_chains(rows: list[dict]) -> Iterator[tuple]:
    """`grow` on a list of rows. What holds between two rows is a bit of a number; a row's numbers come from groups of equal values, not from all pairs."""
    rows = sorted(rows, key=lambda r: (r["first_ts"] is None, r["first_ts"] or 0, r["first_seq"], r["source"] is None, r["source"] or ""))
    n = len(rows)
    every = (1 << n) - 1
    col = {c: [r[c] for r in rows] for c in rows[0]}
    timed = [bool(w) and a is not None and b is not None for w, a, b in zip(col["wall"], col["first_ts"], col["last_ts"])]
    lo, hi = ([f(a, b) if t else 0 for a, b, t in zip(col["first_ts"], col["last_ts"], timed)] for f in (min, max))
    bits_of = lambda flags: sum(1 << i for i, f in enumerate(flags) if f)
    wall, bad = bits_of(timed), bits_of(col["conflict"])
    short = bits_of(b - a <= CHAIN_SPAN for a, b in zip(lo, hi))
    lo_to, hi_to = _up_to(lo), _up_to(hi)
    (thread, other_thread), (source, _), (trace, other_trace), (request, other_request) = (_groups(col[c]) for c in ("thread", "source", "trace", "request"))
    other_host, other_service = _groups(col["host"])[1], _groups(col["service"])[1]
    conflict = [every if bad >> i & 1 else bad | other_trace[i] | other_request[i] | source[i] & other_thread[i] | other_host[i] | other_service[i] for i in range(n)]
    anchor = [a | b for a, b in zip(trace, request)]
    related = _related(col)
    site, _ = _groups([("site", x) for x in col["site"]])
    near = lambda i: wall & lo_to(hi[i] + CHAIN_SPAN) & ~hi_to(lo[i] - CHAIN_SPAN - 1) if timed[i] else 0
    claims: list[int | None] = [None] * n

    def rivals(i: int) -> int:
        if claims[i] is None:
            claims[i] = ~conflict[i] & related[i] & (anchor[i] | (near(i) & thread[i])) & ~(1 << i)
        return claims[i] & free

    free = every
    for seed in range(n):
        if not free >> seed & 1:
            continue
        free &= ~(1 << seed)
        chain, links = [seed], ["seed"]
        sharing = ~conflict[seed] & anchor[seed] & related[seed] & ((~wall | near(seed)) if timed[seed] else every)
        unique = all((site[i] & sharing).bit_count() == 1 for i in _bits(sharing))
        ambiguous = not unique
        at, kin, sites, shared, threads, all_timed, first, last = conflict[seed], related[seed], site[seed], anchor[seed], thread[seed], timed[seed], lo[seed], hi[seed]
        while True:
            can = free & ~at & kin & ~sites
            can &= (shared if unique else 0) | (wall & threads & ~shared if all_timed else 0)
            if all_timed and can & wall:
                fits = short & lo_to(first + CHAIN_SPAN) & hi_to(first + CHAIN_SPAN) & ~lo_to(last - CHAIN_SPAN - 1) if last - first <= CHAIN_SPAN else 0
                can &= ~wall | fits
            pick = next((i for i in _bits(can) if shared >> i & 1 or not rivals(i)), None)
            if pick is None:
                ambiguous |= can.bit_count() > 1
                break
            links.append("anchor" if shared >> pick & 1 else "thread")
            chain.append(pick)
            free &= ~(1 << pick)
            at, kin, sites, shared, threads = at | conflict[pick], kin | related[pick], sites | site[pick], shared | anchor[pick], threads | thread[pick]
            all_timed &= timed[pick]
            if timed[pick]:
                first, last = min(first, lo[pick]), max(last, hi[pick])
        yield from ((col["id"][i], col["id"][seed], k, link, ambiguous) for k, (i, link) in enumerate(zip(chain, links)))


_OUT = ["id", "chain", "place", "link", "ambiguous"]


def grow(rows: pd.DataFrame) -> pd.DataFrame:
    """Chains among the rows of one component: id, chain (the id of its first), place, link, ambiguous.

    Rows come by first_ts, first_seq, source. From each row not yet taken a chain grows: a
    candidate conflicts with no member, is related to one, brings a new site, and keeps the
    chain within its span. It joins by a shared trace or request, if no site occurs twice among
    all that share it with the seed, or by the thread if no other free row could claim it.
    The earliest that may join is taken, until none is left. A row without a time has no clock.
    """
    rows = rows.astype(object)
    return pd.DataFrame(_grown_chains(rows.where(rows.notna(), None).to_dict("records")) if len(rows) else [], columns=_OUT)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chains of a partition sorted by component; a task holds a batch and one component."""
    schema = pa.schema([("id", pa.int64()), ("chain", pa.int64()), ("place", pa.int32()), ("link", pa.string()), ("ambiguous", pa.bool_())])
    found = (chain for parts in _components(batches) for chain in (_grown_chains(parts) if isinstance(parts[0], dict) else long_chains.grown(parts, CHAIN_SPAN)))
    while some := list(islice(found, 10_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The components of a sorted partition, each as its rows or, if it is too large for bit sets, as batches."""
    held: list[pa.RecordBatch] = []  # of the component that may go on
    for batch in batches:
        c = batch.column("component").to_numpy()
        cuts = [0, *(np.flatnonzero(c[1:] != c[:-1]) + 1).tolist(), len(c)]
        if held and len(c) and held[0].column("component")[0].as_py() != c[0]:
            yield _rows_or(held)
            held = []
        if len(cuts) > 2:  # what begins and ends in the batch, besides what goes on from the last one
            yield _rows_or([*held, batch.slice(0, cuts[1])])
            held = []
            rows = batch.slice(cuts[1], cuts[-2] - cuts[1]).to_pylist()
            for lo, hi in zip(cuts[1:-2], cuts[2:-1]):
                yield rows[lo - cuts[1] : hi - cuts[1]] if hi - lo <= ON_BITS else [batch.slice(lo, hi - lo)]
        held += [batch.slice(cuts[-2])] if len(c) else []
    if held:
        yield _rows_or(held)


def _rows_or(parts: list[pa.RecordBatch]) -> list:
    return [row for p in parts for row in p.to_pylist()] if sum(p.num_rows for p in parts) <= ON_BITS else parts


_CHAIN = "id long, chain long, place int, link string, ambiguous boolean"


def chains(full: DataFrame, max_component: int | None = None) -> DataFrame:
    """id, chain, place, link (seed, anchor or thread), ambiguous of renderings of kind full, as `grow` says.

    Renderings can only meet in a chain if they share the type of the root exception and a trace,
    a request, or a thread within the chain's span of time. Components of such renderings are
    found first; each is grown by one task, whatever its size. Only a caller that gives
    `max_component` has larger ones left as they are: each of their renderings says too_large.
    """
    path = fresh_folder(full.sparkSession, "chains")
    said = F.split_part("signature", F.lit(":"), F.lit(1))
    rows = full.where("kind = 'full'").withColumn("g", graph(F.col("payload")))
    named = F.filter(F.split("g.types", ">"), lambda t: t != "")
    types = F.when(F.size(named) > 0, named).otherwise(F.array(said))
    site = F.when(F.col("g.site").startswith("sig:") | (F.col("g.site") == "unknown_site"), F.concat(F.lit("render:"), F.col("id").cast("string"))).otherwise(F.col("g.site"))
    rows = kept(rows.select("id", "signature", "source", "service", "host", "trace", "request", "thread", "first_seq", "first_ts", "last_ts", "wall", "conflict", types.alias("types"), site.alias("site")), f"{path}/rows")
    root = F.explode(F.array_distinct(F.array(F.lower(F.element_at("types", -1)), said))).alias("root")
    key = lambda name, *values: F.when(F.greatest(*(v.isNull().cast("int") for v in values), F.lit(0)) == 0, F.concat_ws("\x00", F.lit(name), *values))
    second = lambda slack: F.floor((F.col("first_ts") + slack) / CHAIN_SPAN).cast("string")
    timed = lambda at: F.when(F.col("wall"), key("thread", F.col("thread"), at))
    keys = rows.select("id", root, F.explode(F.array_compact(F.array(key("trace", F.col("trace")), key("request", F.col("request")), timed(second(0)), timed(second(CHAIN_SPAN))))).alias("key"))
    heads = keys.groupBy("root", "key").agg(F.min("id").alias("head"))
    found = components(keys.join(heads, ["root", "key"]).select(F.col("id").alias("a"), F.col("head").alias("b"))).select(F.col("node").alias("id"), "component")
    placed = rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("size"))
    sized = placed.join(sizes, "component")
    lone = sized.where("size = 1").select("id", F.col("id").alias("chain"), F.lit(0).alias("place"), F.lit("seed").alias("link"), F.lit(False).alias("ambiguous"))
    several = sized.where("size > 1" if max_component is None else f"size between 2 and {max_component}").drop("size")
    parts = int(full.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, as rows cost far more than their bytes say
    grown = several.repartition(parts, "component").sortWithinPartitions("component").mapInArrow(_chained, _CHAIN).unionByName(lone)
    if max_component is None:
        return grown
    return grown.unionByName(sized.where(F.col("size") > max(max_component, 1)).select("id", F.col("id").alias("chain"), F.lit(0).alias("place"), F.lit("too_large").alias("link"), F.lit(True).alias("ambiguous")))
