"""Chains of renderings in a component of any size, in memory that grows with its rows and not with their pairs.

It gives what `renderings.grow` says. A member's attributes stand for all rows they bar or let in, rows
are found by key and time, and rows that are taken are skipped over.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain as chained
from itertools import islice

import numpy as np
import pyarrow as pa


def _codes(parts: list[pa.RecordBatch], name: str, null: int | None = -1) -> tuple[np.ndarray, dict]:
    """Numbers of the values of a column and the values; without a number for null, null is a value like others."""
    of: dict = {}
    found = array("q")
    for part in parts:
        values = part.column(name).to_pylist()
        if values and isinstance(values[0], list):
            values = map(tuple, values)
        found.extend(null if v is None and null is not None else of.setdefault(v, len(of)) for v in values)
    return np.frombuffer(found, np.int64), of


def _numbers(parts: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of whole numbers, 0 for null, and where it is null."""
    column = pa.chunked_array([p.column(name) for p in parts])
    return column.fill_null(0).to_numpy().astype(np.int64), column.is_null().to_numpy()


class _Lanes:
    """Rows that have a key, by key, slot of time, sort and site: the rows of a key and a span of time are a stretch of places, of which each slot and sort is a lane."""

    def __init__(self, key: np.ndarray, sort: np.ndarray, site: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, width: int, free: bytearray):
        rows = np.flatnonzero(of & (key >= 0))
        slots, slot = np.unique(lo[rows] // width, return_inverse=True)
        order = np.lexsort((rows, lo[rows], site[rows], sort[rows], slot, key[rows]))
        rows, slot = rows[order], slot[order]
        cell = key[rows] * (len(slots) + 1) + slot
        first = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (sort[rows][1:] != sort[rows][:-1]))) if len(rows) else np.zeros(0, np.int64)
        self.slots, self.width, self.free = slots.tolist(), width, free
        self.rows, self.cell, self.begin = (array("q", c.astype(np.int64).tobytes()) for c in (rows, cell[first], np.append(first, len(rows))))
        self.skip = array("q", range(len(rows)))
        self.reach = int((hi[rows] - lo[rows]).max()) if len(rows) else 0  # the longest row, which may begin so long before a span it lies in

    def lanes(self, key: int, a: int | None = None, b: int | None = None) -> range:
        """The lanes of a key whose slot touches the span of time from a to b, or all."""
        if key < 0:
            return range(0)
        m = len(self.slots) + 1
        lo = 0 if a is None else bisect_left(self.slots, a // self.width)
        hi = m - 1 if b is None else bisect_right(self.slots, b // self.width)
        return range(bisect_left(self.cell, key * m + lo), bisect_left(self.cell, key * m + hi))

    def head(self, lane: int) -> int:
        return self.rows[self.begin[lane]]

    def all(self, lane: int) -> Iterator[int]:
        return (self.rows[p] for p in range(self.begin[lane], self.begin[lane + 1]))

    def of(self, lane: int) -> Iterator[int]:
        """The rows of a lane that are still free."""
        return (self.rows[p] for p in self.places(self.begin[lane], self.begin[lane + 1]))

    def places(self, at: int, end: int) -> Iterator[int]:
        """The places of free rows. What is taken stays taken, so each place may remember where the next free row can be."""
        rows, skip, free = self.rows, self.skip, self.free
        while at < end:
            if free[rows[at]]:
                yield at
                at += 1
                continue
            passed = []
            while at < end and not free[rows[at]]:
                passed.append(at)
                at = max(skip[at], at + 1)
            for p in passed:
                skip[p] = at


def grown(parts: list[pa.RecordBatch], span: int) -> Iterator[tuple]:
    """id, chain, place, link, ambiguous of one component's rows, a chain spanning at most `span` seconds."""
    first_seq, _ = _numbers(parts, "first_seq")
    begin, no_begin = _numbers(parts, "first_ts")
    end, no_end = _numbers(parts, "last_ts")
    source, names = _codes(parts, "source")
    rank = np.zeros(len(names) + 1, np.int64)
    rank[[names[s] for s in sorted(names)]] = np.arange(len(names))
    rank[-1] = len(names)  # of null, behind all others
    order = np.lexsort((rank[source], first_seq, begin, no_begin))
    n = len(order)
    flag = lambda name: np.concatenate([p.column(name).fill_null(False).to_numpy(zero_copy_only=False) for p in parts]).astype(bool)[order]
    clocked = flag("wall") & ~no_begin[order] & ~no_end[order]
    lo_of, hi_of = (np.where(clocked, f(begin, end)[order], 0) for f in (np.minimum, np.maximum))
    (trace_of, _), (request_of, _), (thread_of, _), (host_of, _), (service_of, _), (sign_of, _) = (_codes(parts, c) for c in ("trace", "request", "thread", "host", "service", "signature"))
    (site_of, _), (types_of, types_seen) = _codes(parts, "site", None), _codes(parts, "types")
    keys = [c[order] for c in (trace_of, request_of, thread_of, source, host_of, service_of, sign_of, types_of)]
    bad_of, site_of = flag("conflict"), site_of[order]
    # Rows of a sort have all in common but the site and the time.
    sort_of = np.unique(np.column_stack([*keys, bad_of, clocked]), axis=0, return_inverse=True)[1].reshape(-1).astype(np.int64)
    free = bytearray(b"\x01") * n
    of_trace, of_request, of_thread = (_Lanes(k, sort_of, site_of, lo_of, hi_of, clocked, span, free) for k in keys[:3])
    loose_trace, loose_request = (_Lanes(k, sort_of, site_of, lo_of, hi_of, ~clocked, 1, free) for k in keys[:2])
    trace, request, thread, source, host, service, sign, types, site, sort, lo, hi = (array("q", np.ascontiguousarray(c, np.int64).tobytes()) for c in (*keys, site_of, sort_of, lo_of, hi_of))
    bad, timed = bytearray(bad_of.astype(np.uint8).tobytes()), bytearray(clocked.astype(np.uint8).tobytes())
    ids = array("q", np.ascontiguousarray(_numbers(parts, "id")[0][order]).tobytes())
    suffixes = [()] * len(types_seen)
    for t, code in types_seen.items():
        suffixes[code] = tuple(types_seen[t[k:]] for k in range(len(t)) if t[k:] in types_seen)
    witness = array("q", [-1]) * n
    unique_of: dict[int, bool] = {}  # by sort, of rows without a clock
    unique_at: dict = {}  # by sort, of rows of the time under -1

    def barred(i: int, j: int) -> bool:
        return bool(
            bad[i] or bad[j] or (trace[i] != trace[j] and trace[i] >= 0 <= trace[j]) or (request[i] != request[j] and request[i] >= 0 <= request[j]) or (host[i] != host[j] and host[i] >= 0 <= host[j])
            or (service[i] != service[j] and service[i] >= 0 <= service[j]) or (source[i] == source[j] >= 0 and thread[i] != thread[j] and thread[i] >= 0 <= thread[j])
        )

    def akin(i: int, j: int) -> bool:
        return sign[i] == sign[j] >= 0 or types[j] in suffixes[types[i]] or types[i] in suffixes[types[j]]

    def kindred(i: int, j: int) -> bool:
        """Whether rows of the sorts of i and j can be in one chain."""
        return akin(i, j) and not barred(i, j)

    def near(i: int, j: int) -> bool:
        return lo[j] <= hi[i] + span and hi[j] >= lo[i] - span

    def sharing(i: int) -> Iterator[int]:
        """What is kindred to a seed and shares its trace or request, of any time if one of the two has no clock."""
        for timely, loose, key in ((of_trace, loose_trace, trace[i]), (of_request, loose_request, request[i])):
            for lane in timely.lanes(key, lo[i] - span - timely.reach, hi[i] + span) if timed[i] else timely.lanes(key):
                if kindred(i, timely.head(lane)):
                    yield from (j for j in timely.all(lane) if not timed[i] or near(i, j))
            for lane in loose.lanes(key):
                if kindred(i, loose.head(lane)):
                    yield from loose.all(lane)

    def unique(i: int) -> bool:
        """Whether no two of those that share the seed's trace or request have one site."""
        if timed[i] and unique_at.get(-1) != (lo[i], hi[i]):
            unique_at.clear()
            unique_at[-1] = (lo[i], hi[i])
        known = unique_at if timed[i] else unique_of
        if sort[i] not in known:
            at: dict[int, int] = {}
            known[sort[i]] = all(at.setdefault(site[j], j) == j for j in sharing(i))
        return known[sort[i]]

    def rival(i: int) -> int:
        """A free row that could claim the free row i too, or -1. Rows are never freed, so one that was found serves until it is taken."""
        if witness[i] >= 0 and free[witness[i]]:
            return witness[i]
        for lanes, key in ((of_trace, trace[i]), (loose_trace, trace[i]), (of_request, request[i]), (loose_request, request[i])):
            found = (j for lane in lanes.lanes(key) if kindred(i, lanes.head(lane)) for j in lanes.of(lane) if j != i)
            if (j := next(found, -1)) >= 0:
                break
        else:
            about = of_thread.lanes(thread[i], lo[i] - span - of_thread.reach, hi[i] + span)
            j = next((j for lane in about if kindred(i, of_thread.head(lane)) for j in of_thread.of(lane) if j != i and near(i, j)), -1)
        witness[i] = j
        return j

    at_trace = at_request = at_host = at_service = first = last = -1
    at_thread, threads, sites, signs, tails, ends = {}, set(), set(), set(), set(), set()
    alone = all_timed = True

    def out(i: int) -> bool:
        """Whether i, and with it its whole sort, can no more join the chain."""
        return bool(
            bad[i] or (trace[i] != at_trace and trace[i] >= 0 <= at_trace) or (request[i] != at_request and request[i] >= 0 <= at_request) or (host[i] != at_host and host[i] >= 0 <= at_host)
            or (service[i] != at_service and service[i] >= 0 <= at_service) or (thread[i] >= 0 and at_thread.get(source[i], thread[i]) != thread[i])
        )

    def shares(i: int) -> bool:
        return trace[i] == at_trace >= 0 or request[i] == at_request >= 0

    def open_to(i: int) -> bool:
        """Whether the sort of i may join by an anchor or a thread."""
        return alone if shares(i) else bool(all_timed and timed[i] and thread[i] in threads)

    def fits(i: int) -> bool:
        return not (all_timed and timed[i]) or (hi[i] - lo[i] <= span and last - first <= span and hi[i] <= first + span and lo[i] >= last - span)

    def of_kin(i: int) -> bool:
        return sign[i] in signs and sign[i] >= 0 or types[i] in ends or any(t in tails for t in suffixes[types[i]])

    def new_site(lane: int) -> Iterator[int]:
        """The free rows of a lane that fit and bring a new site."""
        at, end = of_thread.begin[lane], of_thread.begin[lane + 1]
        while (at := next(of_thread.places(at, end), end)) < end:
            i = of_thread.rows[at]
            if site[i] in sites or lo[i] > first + span:  # so have or are all that follow of this site
                at = bisect_right(of_thread.rows, site[i], at, end, key=site.__getitem__)
                continue
            if fits(i):
                yield i
            at += 1

    for seed in range(n):
        if not free[seed]:
            continue
        if bad[seed]:
            free[seed] = 0
            yield ids[seed], ids[seed], 0, "seed", False
            continue
        alone = unique(seed)
        at_trace = at_request = at_host = at_service = -1
        at_thread, threads, sites, signs, tails, ends = {}, set(), set(), set(), set(), set()
        all_timed, first, last = bool(timed[seed]), lo[seed], hi[seed]
        ready: list[int] = []  # what may join, as a heap by order
        strange: list[int] = []  # what is related to no member yet
        claimed: dict[int, list[int]] = {}  # what a free row could claim too, by that row
        stuck: list[int] = []  # lanes whose rows claim each other
        chain, links, pick, link = [], [], seed, "seed"
        while pick >= 0:
            chain.append(pick)
            links.append(link)
            free[pick] = 0
            was_timed, all_timed = all_timed, all_timed and bool(timed[pick])
            if timed[pick]:
                first, last = min(first, lo[pick]), max(last, hi[pick])
            sites.add(site[pick])
            fresh = claimed.pop(pick, [])
            if types[pick] not in tails or sign[pick] not in signs:
                tails.add(types[pick])
                signs.add(sign[pick])
                ends.update(suffixes[types[pick]])
                fresh, strange = fresh + strange, []
            new = (at_trace < 0 <= trace[pick], at_request < 0 <= request[pick])
            at_trace, at_request, at_host, at_service = max(at_trace, trace[pick]), max(at_request, request[pick]), max(at_host, host[pick]), max(at_service, service[pick])
            if alone:
                window = (last - span, first + span) if all_timed else (None, None)
                for key_is_new, timely, loose, key in ((new[0], of_trace, loose_trace, at_trace), (new[1], of_request, loose_request, at_request)):
                    if key_is_new or was_timed and not all_timed:
                        fresh += (i for lane in timely.lanes(key, *window) if not out(timely.head(lane)) for i in timely.of(lane))
                    if key_is_new:
                        fresh += (i for lane in loose.lanes(key) if not out(loose.head(lane)) for i in loose.of(lane))
            if thread[pick] >= 0:
                if source[pick] >= 0:
                    at_thread[source[pick]] = thread[pick]
                if all_timed and thread[pick] not in threads:
                    for lane in of_thread.lanes(thread[pick], last - span, first + span):
                        i = of_thread.head(lane)
                        if not out(i):
                            # Rows of one lane are near each other, so where two are free they claim each other, and neither may join by its thread.
                            some = of_thread.of(lane) if not akin(i, i) else list(islice(of_thread.of(lane), 2))
                            if akin(i, i) and len(some) > 1:
                                stuck.append(lane)
                            else:
                                fresh += some
                threads.add(thread[pick])
            if len(fresh) > len(ready) // 8:
                ready += fresh
                heapify(ready)
            else:
                for i in fresh:
                    heappush(ready, i)
            pick = -1
            while ready and pick < 0:
                i = heappop(ready)
                if not free[i] or site[i] in sites or out(i) or not open_to(i) or not fits(i):
                    continue
                if not of_kin(i):
                    strange.append(i)
                elif shares(i):
                    pick, link = i, "anchor"
                elif (by := rival(i)) >= 0:
                    claimed.setdefault(by, []).append(i)
                else:
                    pick, link = i, "thread"
        waiting = (i for rows in claimed.values() for i in rows if free[i] and site[i] not in sites and not out(i) and open_to(i) and fits(i))
        heads = ((k, of_thread.head(k)) for k in stuck)
        jammed = (i for k, head in heads if not out(head) and open_to(head) and of_kin(head) for i in new_site(k))
        one = next(both := chained(waiting, jammed), -1)
        several = any(i != one for i in both)
        ambiguous = not alone or several
        yield from ((ids[i], ids[seed], k, how, ambiguous) for k, (i, how) in enumerate(zip(chain, links)))
