"""Linear paths of designs with thousands of features, without a matrix of features by features.

Only features that some resample's path may select ever meet each other: the strong rule proposes them before each run of settings, and a pass over all
features' gradients afterwards brings in what it missed, until nothing is. Proposed features come in groups of at most ``TILE``; the sums of products of two groups are a tile of a
resample's Gram matrix, and a tile is a row of a table that grows by the new groups' tiles only. Tasks add up tiles of at most ``TASK_MB`` at a
time, so what a worker holds doesn't grow with the features. Each resample's path is a task over its own tiles; the driver sees coefficients and gradients.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsonde.operators import kernels, stability, suffstats
from sparsonde.operators.design import Design
from sparsonde.operators.resample import cutoffs, hash_array

TILE, TASK_MB = 256, 128
#: Settings between two looks at all gradients.
RUN = 4
#: Rows whose gradients a task works on at once.
ROWS = 4096
SCHEMA = "boot int, side int, i int, j int, sums binary"


class WideFit:
    def __init__(self, df: DataFrame, design: Design, label: str, id_col: str, y_mean: float, y_std: float, intercept: bool, stratum: str | None = None) -> None:
        self.design, self.id_col, self.intercept, self.p = design, id_col, intercept, design.p
        self.stratum = "stratum__" if stratum else None
        y = ((F.col(label).cast("double") - y_mean) / y_std).alias("y__")
        self.df = df.select(id_col, *design.columns, y, *([F.col(stratum).alias("stratum__")] if stratum else [])).persist()
        self.passes = 0

    def cuts(self, boots: int, fraction: float, seed: int) -> dict:
        return {(r["boot"], r["stratum"] if self.stratum else None): (r["cut_h"], r["cut_id"]) for r in cutoffs(self.df, self.id_col, boots, fraction, seed, self.stratum).collect()}  # a row per boot and stratum

    def _blocks(self, batches: Iterator[pa.RecordBatch], cuts: dict, boots: Sequence[int], seed: int):
        """Parts of batches: the features, the labels, and of each boot which rows are its test rows."""
        for batch in batches:
            for part in self.design.parts(batch, ROWS):
                ids = part.column(self.id_col).cast(pa.int64()).to_numpy()
                strata, place = suffstats.strata_of(part, self.stratum) if self.stratum else ([None], np.zeros(len(ids), np.int64))
                tests = {}
                for b in boots:
                    h = hash_array(ids, b, seed)
                    ch, ci = np.array([cuts.get((b, s), (-1, -1)) for s in strata]).T[:, place]
                    tests[b] = (h < ch) | ((h == ch) & (ids <= ci))
                yield self.design.block(part), part.column("y__").to_numpy(), tests

    def _bare(self) -> WideFit:
        """Without the DataFrame, to go to the tasks."""
        other = object.__new__(WideFit)
        other.__dict__ = self.__dict__ | {"df": None}
        return other

    def gradients(self, coefs: dict[tuple[int, int], tuple[np.ndarray, float]], cuts: dict, seed: int, boots: int) -> tuple[dict, np.ndarray]:
        """Of each model (boot, setting) the mean of x (y - prediction) over its training rows, for every feature, and the number of each boot's training rows; one pass."""
        keys = list(coefs)
        w, b0 = np.array([coefs[m][0] for m in keys]).T.copy(), np.array([coefs[m][1] for m in keys])
        bare = self._bare()

        def run(batches: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
            total, n = np.zeros((bare.p, len(keys))), np.zeros(boots)
            for block, y, tests in bare._blocks(batches, cuts, range(boots), seed):
                r = y[:, None] - block.times(w) - b0
                for i, (b, _) in enumerate(keys):
                    r[tests[b], i] = 0.0
                total += block.transposed(r)
                n += [(~tests[b]).sum() for b in range(boots)]
            return {-1: n} | {i: total[:, i].copy() for i in range(len(keys))}

        self.passes += 1
        with self.design.rows_of_batch(self.df):
            found = suffstats.summed(self.df, run)
        return {m: found[i] / max(found[-1][m[0]], 1.0) for i, m in enumerate(keys)}, found[-1]

    def tiles(self, groups: list[np.ndarray], new: int, cuts: dict, seed: int, boots: int, sides: Sequence[int] = (0,)) -> DataFrame:
        """Tiles (boot, side, i, j <= i) whose first group is one of ``groups[new:]``; side 0 are the training rows, 1 the test rows. Group 0 is the constant and the label."""
        from sparsonde.operators.tables import written

        width = [2, *map(len, groups[1:])]
        bare, out, now, size = self._bare(), None, [], 0
        rounds: list[list[tuple[int, int, int]]] = []
        for i in range(new, len(groups)):
            for j in range(i + 1):
                for b in range(boots):
                    if size and size + width[i] * width[j] * 8 * len(sides) > TASK_MB * 2**20:
                        rounds.append(now)
                        now, size = [], 0
                    now.append((b, i, j))
                    size += width[i] * width[j] * 8 * len(sides)
        for keys in [*rounds, now]:
            wanted = sorted({k for _, i, j in keys for k in (i, j)})

            def run(batches: Iterator[pa.RecordBatch], keys=keys, wanted=wanted) -> Iterator[pa.RecordBatch]:
                sums = {(*k, s): np.zeros((width[k[1]], width[k[2]])) for k in keys for s in sides}
                used = sorted({b for b, _, _ in keys})
                for block, y, tests in bare._blocks(batches, cuts, used, seed):
                    parts = {g: np.column_stack([np.ones(block.n), y]) if g == 0 else block.columns(groups[g]) for g in wanted}
                    for (b, i, j, s), total in sums.items():
                        on = tests[b] if s else ~tests[b]
                        total += parts[i][on].T @ parts[j][on]
                yield _table(sums)

            with self.design.rows_of_batch(self.df):
                some = written(self.df.mapInArrow(run, SCHEMA).repartition("boot", "side", "i", "j").mapInArrow(_added, SCHEMA), "gram-tiles")
            out = some if out is None else out.unionByName(some)
            self.passes += 1
        return out

    def over_boots(self, tiles: DataFrame, groups: list[np.ndarray], boots: int, solve, schema: str) -> DataFrame:
        """``solve(boot, Gram matrices by side)`` of each boot, a boot at a time in a task; the matrix is of (1, features of groups 1 .., label)."""
        width = [2, *map(len, groups[1:])]
        start = np.r_[0, 0, np.cumsum([1, *width[1:]])][1:]
        total = int(start[-1]) + 1

        def place(g: int) -> np.ndarray:
            return np.array([0, total - 1]) if g == 0 else np.arange(start[g], start[g] + width[g])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            boot, held = None, {}
            for batch in batches:
                for r in batch.to_pylist():
                    if r["boot"] != boot:
                        if boot is not None:
                            yield solve(boot, held)
                        boot, held = r["boot"], {}
                    g = held.setdefault(r["side"], np.zeros((total, total)))
                    t, i, j = np.frombuffer(r["sums"]).reshape(width[r["i"]], width[r["j"]]), place(r["i"]), place(r["j"])
                    g[np.ix_(i, j)], g[np.ix_(j, i)] = t, t.T
            if boot is not None:
                yield solve(boot, held)

        return tiles.repartition(boots, "boot").sortWithinPartitions("boot").mapInArrow(run, schema)

    def select(self, settings: list[tuple[float, float]] | None, grid, boots: int, fraction: float, seed: int, warm_start: bool, max_iter: int, tol: float) -> tuple[list[tuple[float, float]], dict[tuple[int, int], np.ndarray], np.ndarray]:
        """The settings, and of each (boot, setting) the coefficients of the features ever proposed, whose numbers come last. ``grid(cross)`` makes settings from the full data's gradient."""
        cuts, intercept, p = self.cuts(boots, fraction, seed), self.intercept, self.p
        groups: list[np.ndarray] = [np.zeros(0, int)]
        tiles = self.tiles(groups, 0, cuts, seed, boots + 1)  # boot ``boots`` has no test rows

        def means(boot: int, grams: dict[int, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([boot], pa.int32()), pa.array([float(suffstats.solve_parts(grams[0], intercept)[3])])], ["boot", "m"])

        alone = {r["boot"]: r["m"] for r in self.over_boots(tiles, groups, boots + 1, means, "boot int, m double").collect()}  # a row per boot
        tiles = tiles.filter(F.col("boot") < boots)
        grads, _ = self.gradients({(b, 0): (np.zeros(p), alone[b]) for b in range(boots + 1)}, cuts, seed, boots + 1)
        settings = grid(grads[boots, 0]) if settings is None else settings
        grads = {b: grads[b, 0] for b in range(boots)}
        at = np.zeros(0, int)
        found: dict[tuple[int, int], np.ndarray] = {}
        last: dict[int, np.ndarray] = {b: np.zeros(0) for b in range(boots)}
        before = max(np.abs(g).max(initial=0.0) for g in grads.values())
        for first in range(0, len(settings), RUN):
            run = settings[first : first + RUN]
            least = min(lam * a for lam, a in run)
            size = np.max([np.abs(g) for g in grads.values()], axis=0)
            add = np.setdiff1d(np.flatnonzero(size >= max(2 * least - max(before, least), least * 0.9)), at)
            add = add[np.argsort(-size[add], kind="stable")[:TILE]]  # what this leaves out and counts, comes in below
            while True:
                if len(add):
                    new = len(groups)
                    groups = groups + [add[k : k + TILE] for k in range(0, len(add), TILE)]
                    tiles = tiles.unionByName(self.tiles(groups, new, cuts, seed, boots))
                    at = np.concatenate(groups[1:])
                starts = {b: np.r_[w, np.zeros(len(at) - len(w))] for b, w in last.items()}

                def solve(boot: int, grams: dict[int, np.ndarray], run=run, starts=starts) -> pa.RecordBatch:
                    g, c, m, ym = suffstats.solve_parts(grams[0], intercept)
                    b, coefs = starts[boot], []
                    for lam, ratio in run:
                        b = kernels.descent(g, c, lam, ratio, b if warm_start else None, max_iter, tol) if len(c) else np.zeros(0)
                        coefs.append(b)
                    return pa.RecordBatch.from_arrays([pa.array([boot] * len(run), pa.int32()), pa.array(range(len(run)), pa.int32()), pa.array([x.tolist() for x in coefs], pa.list_(pa.float64())), pa.array([float(ym - m @ x) if intercept else 0.0 for x in coefs])], ["boot", "s", "coefs", "b0"])

                rows = self.over_boots(tiles, groups, boots, solve, "boot int, s int, coefs array<double>, b0 double").collect()  # coefficients of this run
                full = {}
                for r in rows:
                    w = np.zeros(p)
                    w[at] = r["coefs"]
                    full[r["boot"], first + r["s"]] = (w, r["b0"])
                now, _ = self.gradients(full, cuts, seed, boots)
                outside = np.ones(p, bool)
                outside[at] = False
                over = np.max([np.abs(g) - settings[m[1]][0] * settings[m[1]][1] * (1 + 1e-6) - 1e-12 for m, g in now.items()], axis=0)
                add = np.flatnonzero(outside & (over > 0))
                add = add[np.argsort(-over[add], kind="stable")[:TILE]]
                if not len(add):
                    break
            found |= {m: w[at] for m, (w, _) in full.items()}
            last = {b: found[b, first + len(run) - 1] for b in range(boots)}
            grads, before = {b: now[b, first + len(run) - 1] for b in range(boots)}, run[-1][0] * run[-1][1]
        return settings, {m: np.r_[w, np.zeros(len(at) - len(w))] for m, w in found.items()}, at

    def estimate(self, supports: list[np.ndarray], at: np.ndarray, boots: int, fraction: float, seed: int, solve) -> DataFrame:
        """``solve(boot, train, test, supports)`` of each boot, over the Gram matrices of the supports' features ``at``."""
        cuts = self.cuts(boots, fraction, seed)
        groups = [np.zeros(0, int), *[at[k : k + TILE] for k in range(0, len(at), TILE)]]
        tiles = self.tiles(groups, 0, cuts, seed, boots, (0, 1))

        def run(boot: int, grams: dict[int, np.ndarray]) -> pa.RecordBatch:
            rows = solve(boot, grams[0], grams[1], supports)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], ["boot", "support_id", "score", "coefs"])

        return self.over_boots(tiles, groups, boots, run, "boot int, support_id int, score double, coefs array<double>")


def _table(sums: dict[tuple[int, int, int, int], np.ndarray]) -> pa.RecordBatch:
    ints = [pa.array([k[n] for k in sums], pa.int32()) for n in range(4)]
    return pa.RecordBatch.from_arrays([ints[0], ints[3], ints[1], ints[2], pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["boot", "side", "i", "j", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[tuple[int, int, int, int], np.ndarray] = {}
    for batch in batches:
        for r in batch.to_pylist():
            k = (r["boot"], r["i"], r["j"], r["side"])
            total[k] = total.get(k, 0) + np.frombuffer(r["sums"])
    yield _table(total)


def supports_of(coefs: dict[tuple[int, int], np.ndarray], at: np.ndarray, limits: list[int], boots: int, settings: int) -> list[np.ndarray]:
    """The distinct sets of the features ``at`` that at least so many boots select, over all limits and settings, in the order of the flags of all features."""
    order = np.argsort(at)
    found = set()
    for s in range(settings):
        times = np.sum([coefs[b, s] != 0 for b in range(boots)], axis=0)
        found |= {tuple((times >= limit).tolist()) for limit in limits}
    return sorted((np.array(x, bool) for x in found), key=lambda x: x[order].tolist())


def medians(scores: DataFrame, n: int) -> np.ndarray:
    """The median coefficients of the boots' best supports."""
    union = {r["feature"]: r["coef"] for r in stability.median_union(stability.best_supports(scores)).collect()}
    return np.array([union[j] for j in range(n)])
