"""Connected components of an edge table, and the pairs that every largest matching holds."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import fresh_folder, kept
from . import matchings

#: Edges of one component that a task may match alone; a larger component is matched by rounds over tables.
AT_ONCE = 2_000_000


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of undirected edges (a, b), by rounds of large and small stars.

    Every round hangs neighbours on the smallest node in reach; no node's neighbours are ever
    gathered. Nulls and loops are left out.
    """
    path = fresh_folder(edges.sparkSession, "components")
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{path}/0")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen, n = mark(now), 0
    while True:
        n += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        now = kept(small.distinct(), f"{path}/{n}")
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def whole_components(work: Callable[[pd.DataFrame], pd.DataFrame]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """`work` on the whole components of a batch, of a partition sorted by component; a task holds a batch and one component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # of the component that may go on
        for batch in batches:
            c = batch["component"].to_numpy()
            if not len(c):
                continue
            last = int(np.searchsorted(c, c[-1]))
            if held and held[0]["component"].iloc[-1] != c[-1]:
                yield work(pd.concat([*held, batch.iloc[:last]], ignore_index=True))
                held = []
            elif last:
                yield work(batch.iloc[:last])
            held.append(batch.iloc[last:])
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return run


class _Pairs:
    """A bipartite graph as numbered neighbours of each side, with the partners of a matching, -1 for none."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.lefts, a = np.unique(left, return_inverse=True)
        self.rights, b = np.unique(right, return_inverse=True)
        self.of_left, self.of_right = _neighbours(a, b, len(self.lefts)), _neighbours(b, a, len(self.rights))
        self.partner, self.owner = array("i", [-1]) * len(self.lefts), array("i", [-1]) * len(self.rights)

    def match(self) -> None:
        """Makes the matching one of the largest size: shortest paths to free right sides are flipped, many at a time."""
        partner, owner, (begin, rights) = self.partner, self.owner, self.of_left
        for left in range(len(partner)):
            right = next((r for r in rights[begin[left] : begin[left + 1]] if owner[r] < 0), -1)
            if right >= 0:
                partner[left], owner[right] = right, left
        while True:
            depth = array("i", [-1]) * len(partner)
            free = [left for left in range(len(partner)) if partner[left] < 0]
            level, ends, d = free, False, 0
            for left in free:
                depth[left] = 0
            while level and not ends:
                d, behind = d + 1, []
                for left in level:
                    for right in rights[begin[left] : begin[left + 1]]:
                        other = owner[right]
                        if other < 0:
                            ends = True
                        elif depth[other] < 0:
                            depth[other] = d
                            behind.append(other)
                level = behind
            if not ends:
                return
            tried = begin[:-1]
            for left in free:
                self._flip(left, tried, depth)

    def _flip(self, left: int, tried: array, depth: array) -> None:
        """Gives `left` a partner along a path down the levels, if there is one; what was tried is not tried again."""
        partner, owner, (begin, rights) = self.partner, self.owner, self.of_left
        path, down = [left], []
        while path:
            left = path[-1]
            if tried[left] == begin[left + 1]:
                path.pop()
                if down:
                    down.pop()
                continue
            right = rights[tried[left]]
            tried[left] += 1
            other = owner[right]
            if other < 0:
                for a, r in zip(path, [*down, right], strict=True):
                    partner[a], owner[r] = r, a
                return
            if depth[other] == depth[left] + 1:
                down.append(right)
                path.append(other)

    def after(self, left: int) -> Iterator[int]:
        """The partners of the other right sides of a left side."""
        begin, rights = self.of_left
        return (o for r in rights[begin[left] : begin[left + 1]] if (o := self.owner[r]) >= 0 and o != left)

    def before(self, left: int) -> Iterator[int]:
        """The other left sides of a left side's partner."""
        begin, lefts = self.of_right
        r = self.partner[left]
        return (a for a in (lefts[begin[r] : begin[r + 1]] if r >= 0 else ()) if a != left)

    def loose(self) -> bytearray:
        """The left sides that some matching of the largest size gives another partner or none.

        A pair of one such matching can be spared only if it lies on a path that begins or ends at
        a free side, or on a ring, whose pairs alternate between in the matching and not; so one
        matching and a few passes over the pairs tell.
        """
        n, (begin, rights) = len(self.partner), self.of_left
        found, open_ended = bytearray(n), bytearray(n)
        for _ in _reached((left for left in range(n) if self.partner[left] < 0), self.after, found):
            pass
        for _ in _reached((left for left in range(n) if any(self.owner[r] < 0 for r in rights[begin[left] : begin[left + 1]])), self.before, open_ended):
            pass
        for left in range(n):
            found[left] |= open_ended[left]
        for left in self._on_rings(found):
            found[left] = 1
        return found

    def _on_rings(self, without: bytearray) -> Iterator[int]:
        """The left sides that lie on a ring of steps to partners of other right sides, without some of them."""
        owner, (begin, rights) = self.owner, self.of_left
        seen, finished, tried = bytearray(without), array("i"), begin[:-1]
        for root in range(len(seen)):
            todo = array("i", () if seen[root] else (root,))
            seen[root] = 1
            while todo:
                left, to = todo[-1], -1
                while tried[left] < begin[left + 1] and to < 0:
                    other = owner[rights[tried[left]]]
                    tried[left] += 1
                    to = other if other >= 0 and not seen[other] else -1
                if to < 0:
                    finished.append(todo.pop())
                else:
                    seen[to] = 1
                    todo.append(to)
        seen = bytearray(without)
        for root in reversed(finished):
            group = array("i", _reached([root], self.before, seen))
            if len(group) > 1:
                yield from group


def _neighbours(a: np.ndarray, b: np.ndarray, n: int) -> tuple[array, array]:
    """Where the neighbours of each of n nodes begin, and all neighbours, by number."""
    order = np.lexsort((b, a))
    begin = np.searchsorted(a[order], np.arange(n + 1))
    return array("i", begin.astype(np.int32).tobytes()), array("i", b[order].astype(np.int32).tobytes())


def _reached(begin: Iterable[int], after: Callable[[int], Iterator[int]], seen: bytearray) -> Iterator[int]:
    """What can be reached from some nodes, each once, without what was seen; marks it as seen."""
    for root in begin:
        todo = [] if seen[root] else [root]
        seen[root] = 1
        while todo:
            node = todo.pop()
            yield node
            for w in after(node):
                if not seen[w]:
                    seen[w] = 1
                    todo.append(w)


def _sure(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the pairs every matching of the largest size holds; no pair may be given twice."""
    graph = _Pairs(left, right)
    graph.match()
    loose, partner = np.frombuffer(graph.loose(), np.uint8), np.frombuffer(graph.partner, np.int32)
    a = np.searchsorted(graph.lefts, left)
    return (loose[a] == 0) & (partner[a] >= 0) & (graph.rights[partner[a]] == right)


def forced(pairs: list[tuple]) -> set[tuple]:
    """The pairs that every matching of the largest size holds."""
    if not pairs:
        return set()
    left, right = np.array(sorted(set(pairs))).T
    sure = _sure(left, right)
    return set(zip(left[sure].tolist(), right[sure].tolist(), strict=True))


def _settled(edges: pd.DataFrame) -> pd.DataFrame:
    left, right = edges["left"].to_numpy(), edges["right"].to_numpy()
    sure = _sure(left, right)
    out = np.isin(left, left[sure]) | np.isin(right, right[sure])
    return pd.DataFrame({"left": left, "right": right, "status": np.where(sure, "paired", np.where(out, "ruled_out", "ambiguous"))})


def matched(pairs: DataFrame, max_edges: int | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """`pairs` (left, right: integers) with status: paired, ruled_out or ambiguous.

    A pair that is in every matching of the largest size is paired; what shares a side with
    one is ruled out; where largest matchings differ, pairs stay ambiguous. A component of up
    to `at_once` pairs is settled by one task, a larger one by rounds over tables. Only a caller
    that gives `max_edges` has components of more pairs left as they are: they say too_large.
    Repeated pairs count once; a pair with a null side is left out.
    """
    path = fresh_folder(pairs.sparkSession, "matching")
    edges = kept(pairs.select(F.col("left").cast("long"), F.col("right").cast("long")).where("left is not null and right is not null").distinct(), f"{path}/edges")
    node = lambda side, c: F.struct(F.lit(side).alias("side"), F.col(c).alias("id"))
    found = components(edges.select(node(0, "left").alias("a"), node(1, "right").alias("b"))).where("node.side = 0").select(F.col("node.id").alias("left"), "component")
    placed = edges.join(found, "left")
    sizes = kept(placed.groupBy("component").agg(F.count("*").alias("edges")), f"{path}/sizes")
    sized, size = placed.join(sizes, "component"), F.col("edges")
    most = at_once if max_edges is None else min(at_once, max_edges)
    few = sized.where(size <= most).select(F.xxhash64("component").alias("component"), "left", "right")
    settled = few.repartition("component").sortWithinPartitions("component").mapInPandas(whole_components(_settled), "left long, right long, status string")
    if max_edges is not None:
        settled = settled.unionByName(sized.where(size > max_edges).select("left", "right", F.lit("too_large").alias("status")))
    by_rounds = size > at_once if max_edges is None else size.between(at_once + 1, max_edges)
    if sizes.where(by_rounds).isEmpty():
        return settled
    return settled.unionByName(matchings.settled(kept(sized.where(by_rounds).select("left", "right"), f"{path}/large")))
