"""Searching timeseries for patterns by dynamic time warping, and aligning pairs of sequences."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotag.plans.durable import pinned
from chronotag.plans.ordered import Ordered
from chronotag.plans.sequential import per_group

# Patterns travel with the tasks, so their size is limited.
MAX_PATTERN_SAMPLES = 1_000_000

WINDOWS = ("event_id bigint, pattern string, pattern_no int, start_pos bigint, end_pos bigint, "
           "start_time double, end_time double, error double, length int, scale double")


def rates(ratio: float, steps: int) -> list[float]:
    """1, and `steps` faster and slower rates up to `ratio`."""
    out = [1.0]
    for i in range(1, steps + 1):
        r = 1 + i * (ratio - 1) / steps
        out += [r, 1 / r]
    return out


def load(patterns: DataFrame, sample_rates: list[float] = (1.0,)) -> list[tuple[str, np.ndarray]]:
    """Patterns (name, time, value) as arrays, each resampled to every rate."""
    rows = patterns.select("name", "time", "value").limit(MAX_PATTERN_SAMPLES + 1).collect()
    if len(rows) > MAX_PATTERN_SAMPLES:
        raise ValueError("the patterns are too large to send to every task; search for fewer at a time")
    by_name: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["time"])):
        by_name.setdefault(r["name"], []).append((r["time"], r["value"]))
    out = []
    for name, points in by_name.items():
        t = np.array([p[0] for p in points], dtype=float)
        v = np.array([p[1] for p in points], dtype=float)
        for rate in sample_rates:
            n = int(len(t) * rate)
            if n < 3:
                raise ValueError(f"pattern {name} is shorter than 3 samples at rate {rate}")
            grid = t[0] + (t[-1] - t[0]) * np.arange(n) / (n - 1)
            resampled = np.stack([np.interp(grid, t, v[:, d]) for d in range(v.shape[1])], axis=1)
            out.append((f"{name}@{rate:g}" if len(sample_rates) > 1 else name, resampled))
    return out


def _normalise(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, length, dim) with zero mean and one shared deviation for all dimensions."""
    mean = w.mean(axis=1, keepdims=True)
    dev = np.sqrt(w.var(axis=1).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return (w - mean) / dev[:, None, None], dev


def _warped(d: np.ndarray, q: np.ndarray, band: int) -> np.ndarray:
    """Warping cost of every window against the pattern inside the band, all windows at once."""
    n_w, n = d.shape[0], len(q)
    previous = np.full((n_w, n), np.inf)
    for i in range(n):
        current = np.full((n_w, n), np.inf)
        lo, hi = max(0, i - band), min(n - 1, i + band)
        step = ((d[:, i, None, :] - q[None, lo:hi + 1, :]) ** 2).sum(axis=2)
        for j in range(lo, hi + 1):
            if i == 0 and j == 0:
                best = 0.0
            else:
                best = previous[:, j]
                if j > 0:
                    best = np.minimum(np.minimum(best, previous[:, j - 1]), current[:, j - 1])
            current[:, j] = best + step[:, j - lo]
        previous = current
    return previous[:, -1]


def _envelope(q: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(q)
    parts = [q[max(0, i - band):min(n, i + band + 1)] for i in range(n)]
    return np.stack([p.min(axis=0) for p in parts]), np.stack([p.max(axis=0) for p in parts])


def _search(values: np.ndarray, name: str, pattern: np.ndarray, band: int, max_error: float | None):
    """(end position, error, scale) of the windows whose error stays below the limit."""
    n = len(pattern)
    if len(values) < n:
        return []
    q, q_dev = _normalise(pattern[None])
    q = q[0]
    low, high = _envelope(q, band)
    limit = np.inf if max_error is None else max_error * n
    windows = np.lib.stride_tricks.sliding_window_view(values, n, axis=0).transpose(0, 2, 1)
    out = []
    for at in range(0, len(windows), 2048):
        d, dev = _normalise(windows[at:at + 2048])
        alive = np.flatnonzero(dev > 0)
        # cheapest bound first: the first and last points are always aligned with each other
        ends = ((d[alive, 0] - q[0]) ** 2).sum(axis=1) + ((d[alive, -1] - q[-1]) ** 2).sum(axis=1)
        alive = alive[ends < limit]
        # distance to the pattern's envelope
        outside = d[alive] - np.clip(d[alive], low, high)
        alive = alive[(outside ** 2).sum(axis=(1, 2)) < limit]
        if not len(alive):
            continue
        error = _warped(d[alive], q, band)
        for i in np.flatnonzero(error < limit):
            out.append((at + int(alive[i]) + n - 1, float(error[i]), float(dev[alive[i]] / q_dev[0])))
    return out


def search(samples: DataFrame, patterns: list[tuple[str, np.ndarray]], warp: float, max_error: float | None,
           rows_per_task: int = 50_000) -> DataFrame:
    """Every window of every series whose warping error per sample is below `max_error`:
    (event_id, pattern, pattern_no, start_pos, end_pos, start_time, end_time, error, length, scale).

    `warp` is the band, as a share of the pattern (up to 1) or in samples. A series is cut into
    slices by position that overlap by the longest pattern.
    """
    longest = max(len(p) for _, p in patterns)
    size = max(rows_per_task, 4 * longest)

    def band(n):
        return int(np.floor(warp * n if warp <= 1 else warp))

    numbered = Ordered(samples.select("event_id", "time", "value"), "event_id", "time").row_number("_pos").done()
    pos = F.col("_pos") - 1
    slices = F.array_distinct(F.array(F.floor(pos / size), F.floor((pos + longest - 1) / size)))
    cut = numbered.withColumn("_pos", pos).withColumn("_slice", F.explode(slices))

    def find(c):
        first, number = int(c["_pos"][0]), int(c["_slice"][0])
        time, values = c["time"], np.stack(c["value"]).astype(float)
        rows = []
        for no, (name, p) in enumerate(patterns):
            n = len(p)
            for end, error, scale in _search(values, name, p, band(n), max_error):
                if (first + end) // size == number:  # windows ending in the overlap belong to the slice before
                    rows.append((c["event_id"][0], name, no, first + end - n + 1, first + end, time[end - n + 1], time[end],
                                 error, n, scale))
        return rows

    return per_group(cut, ["event_id", "_slice"], ["_pos"], find, WINDOWS)


def best_matches(found: DataFrame) -> DataFrame:
    """Windows of `search` without those that overlap a better one.

    Windows count in order of their end (then of their pattern). A candidate is a window that no earlier overlapping
    candidate equals or betters, so a later candidate is always better than those it overlaps. A match is a
    candidate that no later match overlaps.
    """
    rows = pinned(found.withColumn("_id", F.struct("event_id", "end_pos", "pattern_no")))
    longest = rows.agg(F.coalesce(F.max("length"), F.lit(1))).first()[0]
    pairs = pinned(_overlapping(rows, longest))
    candidates = _unbeaten(rows.select("_id"), pairs.where("earlier_rate <= later_rate").select(F.col("later").alias("loser"), F.col("earlier").alias("winner")))
    among = pairs.join(candidates.withColumnRenamed("_id", "earlier"), "earlier", "left_semi").join(candidates.withColumnRenamed("_id", "later"), "later", "left_semi")
    matches = _unbeaten(candidates, among.select(F.col("earlier").alias("loser"), F.col("later").alias("winner")))
    return rows.join(matches, "_id", "left_semi").drop("_id")


def _overlapping(rows: DataFrame, longest: int) -> DataFrame:
    """(earlier, later, earlier_rate, later_rate) of overlapping windows of a series. The earlier one ends inside the later one, so it
    is met in one of the two cells, as wide as the longest window, that the later one lies in."""
    rate = F.col("error") / F.col("length")
    cell = lambda pos: F.floor(F.col(pos) / longest)
    ends = rows.select("event_id", cell("end_pos").alias("cell"), F.col("end_pos").alias("_end"), F.col("_id").alias("earlier"), rate.alias("earlier_rate"))
    spans = rows.select("event_id", F.explode(F.array_distinct(F.array(cell("start_pos"), cell("end_pos")))).alias("cell"), "start_pos", F.col("_id").alias("later"), rate.alias("later_rate"))
    return spans.join(ends, ["event_id", "cell"]).where((F.col("_end") >= F.col("start_pos")) & (F.col("earlier") < F.col("later"))).drop("event_id", "cell", "start_pos", "_end")


def _unbeaten(rows: DataFrame, beaten: DataFrame) -> DataFrame:
    """The ids (_id) that no chosen one beats, by rounds: who has no winner left is chosen, whom a chosen one beats is out, and
    who is out beats no one any more. `beaten` (loser, winner) has no cycles."""
    chosen, rest, beaten = [], rows, pinned(beaten)
    while True:
        free = pinned(rest.join(beaten, F.col("_id") == F.col("loser"), "left_anti"))
        chosen.append(free)
        lost = pinned(beaten.join(free, F.col("winner") == F.col("_id"), "left_semi").select(F.col("loser").alias("_out")).distinct())
        beaten = pinned(beaten.join(lost, F.col("loser") == F.col("_out"), "left_anti").join(lost, F.col("winner") == F.col("_out"), "left_anti"))
        rest = rest.join(free, "_id", "left_anti").join(lost, F.col("_id") == F.col("_out"), "left_anti")
        if rest.isEmpty():
            return reduce(DataFrame.union, chosen)
        rest = pinned(rest)


def match(samples: DataFrame, patterns: list[tuple[str, np.ndarray]], warp: float, max_error: float | None) -> DataFrame:
    return best_matches(search(samples, patterns, warp, max_error))


def _aligned(a: np.ndarray, b: np.ndarray):
    """Distance and path of the best alignment. Cells on one anti-diagonal do not depend on each other, so a diagonal is computed at once:
    `total[s + 2, i + 1]` is the least sum up to element i of a and s - i of b, infinite outside."""
    n, m = len(a), len(b)
    if not n or not m:
        return (0.0 if n == m else float("inf")), [], []
    total = np.full((n + m + 1, n + 1), np.inf)
    total[0, 0] = 0.0

    def ways(s, i):
        """Sums before a step of both, of a alone, of b alone; the first of equal ones is taken."""
        return np.stack([total[s, i], total[s + 1, i], total[s + 1, i + 1]])

    for s in range(n + m - 1):
        i = np.arange(max(0, s - m + 1), min(n - 1, s) + 1)
        total[s + 2, i + 1] = ways(s, i).min(axis=0) + np.abs(a[i] - b[s - i])
    path = [(n - 1, m - 1)]
    while path[-1] != (0, 0):
        i, j = path[-1]
        back = ((1, 1), (1, 0), (0, 1))[int(ways(i + j, i).argmin())]
        path.append((i - back[0], j - back[1]))
    i, j = zip(*reversed(path))
    return float(total[-1, -1]), list(i), list(j)


def align(pairs: DataFrame) -> DataFrame:
    """(pair_id, distance, a_index, b_index): best alignment of two sequences (pair_id, a, b) by
    absolute difference, each element matched at least once, with the path."""

    def run(batches):
        for pdf in batches:
            rows = [(pid, *_aligned(np.asarray(a, float), np.asarray(b, float))) for pid, a, b in zip(pdf["pair_id"], pdf["a"], pdf["b"])]
            yield pd.DataFrame(rows, columns=["pair_id", "distance", "a_index", "b_index"])

    return pairs.select("pair_id", "a", "b").mapInPandas(
        run, "pair_id bigint, distance double, a_index array<int>, b_index array<int>")
