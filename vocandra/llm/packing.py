"""Filling fixed-capacity containers with items (problem 9): hierarchical multi-length packing.

1. Items above the capacity are cut into full pieces and a rest; all others stay whole; empty items take no room.
2. The histogram of piece sizes, at most ``CAPACITY`` numbers however many items there are, is packed on the driver.
   Sizes are routed to tiers of context length. Each tier packs windows of its own length: tier by tier, from the longest,
   its largest size opens a window, and the gap is filled from the shorter tiers, by one size that closes it, else by
   two, else by the largest that fits. A filling is used as often as the histogram allows, so each step uses up a size.
   A container holds as many windows of a tier as go into it, full ones with full ones.
3. Short windows may cost room where no small pieces close them. So the tiers are tried with fewer and fewer short ones, and
   the plan with the fewest containers counts, of equals the one with more tiers.
4. Pieces take the planned places by their rank among the pieces of their size. Ranks come from counts per size and
   salt, so a size that a third of all items share is ranked in ``SALTS`` tasks.
5. Containers are numbered from the fullest on and dealt to the step groups to and fro, so the groups' tokens differ by
   less than two containers.

Defined results: null or negative sizes count as empty; ties in size are ranked by salt and id; rows that come again
are items of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from vocandra.session import stage

CAPACITY = 2048
TIERS = (2048, 1024, 512, 256)
SALTS = 64
#: Containers a step group holds.
GROUP = 64


Windows = list[tuple[tuple[tuple[int, ...], ...], int, int]]


def plan_tiers(counts: dict[int, int], capacity: int, tiers: tuple[int, ...]) -> Windows:
    """(windows of a container, times, tier) that use up all counts; windows are tuples of sizes of at most the tier's length."""
    left = Counter({s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity})
    sizes = sorted(left)
    plan: Windows = []
    rest: list[tuple[int, ...]] = []

    def largest(bound: int) -> int:
        at = bisect_right(sizes, bound)
        return sizes[at - 1] if at else 0

    def take(size: int, used: list[int]) -> None:
        used.append(size)
        left[size] -= 1
        if not left[size]:
            sizes.remove(size)

    for length, low in zip(tiers, [*tiers[1:], 0]):
        filled: list[tuple[tuple[int, ...], int]] = []
        while (head := largest(length)) > low:
            used: list[int] = []
            take(head, used)
            gap = length - head
            while gap and (first := largest(gap)):
                if first != gap:
                    for at in range(bisect_right(sizes, gap) - 1, -1, -1):
                        a = sizes[at]
                        if 2 * a < gap:
                            break
                        if left.get(gap - a, 0) >= (2 if 2 * a == gap else 1):
                            first = a
                            break
                take(first, used)
                gap -= first
            need = Counter(used)
            more = min(left.get(s, 0) // n for s, n in need.items())
            for s, n in need.items():
                if more:
                    left[s] -= more * n
                    if not left[s] and s in sizes:
                        sizes.remove(s)
            filled.append((tuple(used), 1 + more))
        together = max(1, capacity // length)
        for windows, times in joined(filled, together):
            if len(windows) == together or length == capacity:
                plan.append((windows, times, length))
            else:
                rest += windows
    # The windows that are left, fewer of each tier than fill a container, share containers as one window each.
    shared: list[list[int]] = []
    for window in sorted(rest, key=lambda w: -sum(w)):
        room = next((c for c in shared if sum(c) + sum(window) <= capacity), None)
        if room is None:
            shared.append(room := [])
        room += window
    return plan + [((tuple(c),), 1, capacity) for c in shared]


def joined(filled: list[tuple[tuple[int, ...], int]], together: int) -> list[tuple[tuple[tuple[int, ...], ...], int]]:
    """Windows, fullest first, ``together`` to a container: (windows, times)."""
    out: list[tuple[tuple[tuple[int, ...], ...], int]] = []
    open_windows: list[tuple[int, ...]] = []
    for used, times in sorted(filled, key=lambda f: -sum(f[0])):
        if open_windows:
            missing = min(times, together - len(open_windows))
            open_windows += [used] * missing
            times -= missing
            if len(open_windows) == together:
                out.append((tuple(open_windows), 1))
                open_windows = []
        if times >= together:
            out.append(((used,) * together, times // together))
        open_windows += [used] * (times % together)
    return [*out, (tuple(open_windows), 1)] if open_windows else out


def plan_windows(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> Windows:
    """The plan with the fewest containers, its containers from the fullest on; see steps 2 and 3."""
    tiers = (capacity, *[t for t in tiers if t < capacity])
    plans = [plan_tiers(counts, capacity, tiers[:n]) for n in range(len(tiers), 0, -1)]
    best = min(plans, key=lambda plan: sum(times for _, times, _ in plan))
    return sorted(best, key=lambda row: -sum(map(sum, row[0])))


def plan_fillings(counts: dict[int, int], capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> list[tuple[tuple[int, ...], int]]:
    """(sizes, times): fillings of containers and how often each is used; uses up all counts."""
    return [(tuple(s for window in windows for s in window), times) for windows, times, _ in plan_windows(counts, capacity, tiers)]


def places(plan: Windows) -> dict[int, list[tuple]]:
    """Per size, rows (first rank, pieces a container, first container, tier, (window, offset) of each) in order of rank."""
    out: dict[int, list[tuple]] = {}
    used: Counter[int] = Counter()
    container = 0
    for windows, times, tier in plan:
        where: dict[int, list[tuple[int, int]]] = {}
        at = 0
        for number, window in enumerate(windows):
            for s in window:
                where.setdefault(s, []).append((number, at))
                at += s
        for s, found in where.items():
            out.setdefault(s, []).append((used[s], len(found), container, tier, found))
            used[s] += len(found) * times
        container += times
    return out


def step_group(container: Column, groups: int) -> Column:
    """To and fro over the groups."""
    at, turn = F.pmod(container, F.lit(groups)), F.floor(container / groups) % 2
    return F.when(turn == 0, at).otherwise(groups - 1 - at)


def pieces(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """items: (doc_id, tokens). (doc_id, part, start, tokens): whole items, and items above the capacity in parts."""
    filled = items.filter(F.col("tokens") > 0)
    cut = filled.select("doc_id", "tokens", F.posexplode(F.sequence(F.lit(0), F.col("tokens") - 1, F.lit(capacity))).alias("part", "start"))
    return cut.select("doc_id", "part", "start", F.least(F.lit(capacity), F.col("tokens") - F.col("start")).cast("int").alias("tokens"))


def pack(items: DataFrame, capacity: int = CAPACITY, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """(container_id, tier, window, step_group, doc_id, part, start, tokens, at): every piece's place."""
    salted = pieces(items, capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(SALTS)).cast("int"))
    salted = stage(salted, "pieces")
    counts = salted.groupBy("tokens", "salt").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("before", before)
    histogram = {r["tokens"]: r["n"] for r in counts.groupBy("tokens").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    plan = plan_windows(histogram, capacity, tiers)
    groups = max(1, -(-sum(times for _, times, _ in plan) // GROUP))
    table = places(plan)
    rank = F.row_number().over(W.partitionBy("tokens", "salt").orderBy("doc_id", "part")) - 1
    # At most capacity x SALTS rows.
    ranked = salted.withColumn("own", rank).join(F.broadcast(starts.select("tokens", "salt", "before")), ["tokens", "salt"])
    ranked = ranked.select("doc_id", "part", "start", "tokens", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts = {s: np.array([r[0] for r in rows]) for s, rows in table.items()}
        for batch in batches:
            out = []
            for size, rank in zip(batch["tokens"].tolist(), batch["rank"].tolist()):
                row = table[size][int(np.searchsorted(firsts[size], rank, side="right")) - 1]
                k, use = divmod(rank - row[0], row[1])
                out.append((row[2] + k, row[3], *row[4][use]))
            container, tier, window, at = zip(*out) if out else ((), (), (), ())
            places32 = {"tier": np.array(tier, np.int32), "window": np.array(window, np.int32), "at": np.array(at, np.int32)}
            yield batch.drop(columns="rank").assign(container_id=np.array(container, np.int64), **places32)

    schema = "doc_id long, part int, start int, tokens int, container_id long, tier int, window int, at int"
    placed = ranked.mapInPandas(place, schema)
    return placed.select("container_id", "tier", "window", step_group(F.col("container_id"), groups).alias("step_group"), "doc_id", "part", "start", "tokens", "at")
