"""Boosted trees with second-order splits over binned columns.

Columns are binned once, at exact quantiles of the fitting rows, and the matrix of bin numbers is written. A level of a tree is one pass: every block
of rows adds up gradients and hessians by (node, column, bin), the sums of all blocks meet by column chunk, where the best split of
each node is chosen, and the driver sees one candidate per node and chunk; sums of a few MB in all are added up by the driver itself, which
saves a shuffle. A node of at most ``SMALL`` rows sends the rows themselves, and the
task they meet in grows its whole subtree, so that a pass can finish many levels (after the PLANET paper). Sums are of whole numbers
(gradients in units of 2^-24 of the largest weight), so neither way, nor the order of rows, nor their partitioning changes a tree.

As long as the bins of their rows keep within ``ALONE`` bytes, models (one, the trials of a search, the refits of an ablation) are dealt out, each to a
task of its own; beyond that they grow in step: one pass serves all of them. Sums that reach the driver are kept
for a level, so that of two children only the one of fewer rows is added up; the other is what its parent has left.

The rows' margins travel with the blocks. They are kept in memory and on disk, and every ``CHECKPOINT`` trees written to the shared folder, so
a lost executor costs the trees since then. This is one of the few places that works on an RDD: hundreds of passes with
state, where planning a DataFrame for each took several times as long as the passes themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditkit.operators.cumulate import cumulate, q
from auditkit.operators.profile import long_form
from auditkit.sources.staging import materialize, shared_dir

# The strengths of a fit where none are given.
DEFAULTS = {"n_estimators": 300, "max_depth": 6, "learning_rate": 0.3, "min_child_weight": 1.0, "subsample": 1.0, "colsample_bytree": 1.0,
            "reg_alpha": 0.0, "reg_lambda": 1.0, "gamma": 0.0}
#: Bins of a column; bin 0 holds its nulls, below all values.
BINS = 255
UNIT, LEAST_GAIN, CHECKPOINT = 2.0**24, 1e-6, 25
#: Rows of a block, cells of a histogram that meet under one key, and rows of a node that is finished in one task.
BLOCK, CHUNK, SMALL = 1 << 18, 1 << 21, 1 << 16
#: Rows that make a block worth a task, and joint bins of columns that are added up together.
LEAST_BLOCK, JOINT = 1 << 16, 512
#: Rows that are added up at once: their counts fit below their hessians in the 53 bits of a double, and what is read of them in a core's cache.
SLICE = (1 << 15) - 1
#: Bytes of sums that all tasks of a pass together may hand to the driver; more of them meet by column chunk.
HANDED = 1 << 24
#: Bytes of bins that a task may hold to grow a model by itself.
ALONE = 1 << 27


@dataclass
class Tree:
    """Nodes in heap order. ``column`` is -1 at a leaf; rows with bin <= cut go to node 2i + 1. cover is the sum of hessians."""

    column: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n))

    def walk(self, x: np.ndarray) -> np.ndarray:
        """The node that each row of bin numbers ends in."""
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        # One flat gather for all columns, in the order that the numbers lie in.
        cells, by_row, by_column = (x.T, 1, len(x)) if x.flags.f_contiguous else (np.ascontiguousarray(x), x.shape[1], 1)
        cells, column = cells.reshape(-1), self.column.astype(np.int64)
        node = at
        while True:
            c = column[node]
            going = c >= 0
            if not going.all():
                rows, node, c = rows[going], node[going], c[going]
            if not len(rows):
                return at
            node = 2 * node + 1 + (cells[rows * by_row + c * by_column] > self.cut[node])
            at[rows] = node


@dataclass
class Spec:
    """One model to grow: its strengths, the columns it may use (all if None), the folds it is fitted on, and its seed."""

    params: dict = field(default_factory=dict)
    columns: tuple[int, ...] | None = None
    folds: tuple[int, ...] = (0,)
    seed: int = 42

    def __post_init__(self):
        unknown = set(self.params) - set(DEFAULTS)
        if unknown:
            raise ValueError(f"unknown strengths: {sorted(unknown)}")
        self.params = {**DEFAULTS, **self.params}


@dataclass
class Model:
    names: list[str]
    cuts: list[np.ndarray]
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            out += t.value[t.walk(x)]
        return out


# ---------------------------------------------------------------- bins
def cut_points(df: DataFrame, names: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Per column the least value of each bin: all distinct values where they are few enough, else exact quantiles. Nulls and NaN don't count."""
    cells = long_form(df, names, []).filter("value is not null and not isnan(value)")
    hist = materialize(cells.groupBy("feature", "value").agg(F.count("*").alias("n"), F.lit(1).cast("long").alias("one")), "values")
    totals = hist.groupBy("feature").agg(F.sum("n").alias("rows"), F.count("*").alias("distinct"))
    ranked = cumulate(hist, ["feature"], ["value"], ["n", "one"]).join(totals, "feature")
    at = F.when(F.col("distinct") <= bins, F.col("one_before")).otherwise(F.expr(f"n_before * {bins} div rows"))
    found: dict[str, list[float]] = {}
    for r in ranked.groupBy("feature", at.alias("bin")).agg(F.min("value").alias("least")).collect():  # at most ``bins`` a column
        found.setdefault(r["feature"], []).append(r["least"])
    return [np.array(sorted(found.get(n, []))) for n in names]


def binned(df: DataFrame, names: list[str], cuts: list[np.ndarray], keep: list[str]) -> DataFrame:
    """(keep..., bins): a byte per column. Values below the first bin belong to it, null and NaN to bin 0."""

    def work(batches):
        for b in batches:
            x = np.zeros((len(b), len(names)), np.uint8)
            for i, inner in enumerate(cuts):
                v = b.column(len(keep) + i).to_numpy(zero_copy_only=False)
                x[:, i] = np.where(np.isnan(v), 0, 1 + np.searchsorted(inner[1:], v, side="right"))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array([r.tobytes() for r in x], pa.binary())], names=[*keep, "bins"])

    kinds = dict(df.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    return df.select(*map(q, keep), *[q(n).cast("double").alias(n) for n in names]).mapInArrow(work, f"{fields}, bins binary")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


# ---------------------------------------------------------------- growing
def _draw(keys: np.ndarray, salt: int) -> np.ndarray:
    """A number in [0, 1) for each key, the same wherever the row is."""
    z = (keys + np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)).astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


def _salt(spec: Spec, tree: int) -> int:
    return int.from_bytes(hashlib.md5(f"{spec.seed}|{tree}".encode()).digest()[:8], "big")


def _columns(spec: Spec, tree: int, names: list[str]) -> list[int]:
    """Columns that a tree may use: the share asked for, by a draw over their names."""
    allowed = list(range(len(names))) if spec.columns is None else list(spec.columns)
    n = max(1, int(spec.params["colsample_bytree"] * len(allowed)))
    if n >= len(allowed):
        return sorted(allowed)
    return sorted(sorted(allowed, key=lambda c: hashlib.md5(f"{spec.seed}|{tree}|{names[c]}".encode()).digest())[:n])


def _pack(table: DataFrame, width: int, models: int, count: int) -> RDD:
    """Blocks (bins by column, label, fold, key, margins) of a written table of ``count`` rows: a like share for each core, in blocks of
    ``BLOCK`` rows or little more."""

    def work(batches):
        parts, size = [], 0

        def block():
            t = pa.Table.from_batches(parts)
            return pa.RecordBatch.from_arrays([pa.array([b"".join(c.to_pylist())], pa.binary()) if c.type == pa.binary() else pa.array([c.to_numpy().tobytes()], pa.binary())
                                               for c in t.columns], names=["bins", "label", "fold", "key"])

        for b in batches:
            parts.append(b)
            size += len(b)
            if size >= BLOCK:
                yield block()
                parts, size = [], 0
        if size:
            yield block()

    rows = table.select("bins", F.col("label").cast("long").alias("label"), F.col("fold").cast("long").alias("fold"), F.col("key").cast("long").alias("key"))
    cores = table.sparkSession.sparkContext.defaultParallelism
    packed = rows.repartition(max(1, min(cores, count // LEAST_BLOCK))).mapInArrow(work, "bins binary, label binary, fold binary, key binary")

    def decoded(r):
        y = np.frombuffer(r["label"], np.int64).astype(np.int8)
        return (np.ascontiguousarray(np.frombuffer(r["bins"], np.uint8).reshape(len(y), width).T), y, np.frombuffer(r["fold"], np.int64).astype(np.int8),
                np.frombuffer(r["key"], np.uint64), np.zeros((len(y), models)))

    return packed.rdd.map(decoded)


def _add_up(own: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, n: int, columns: list[int], widths: list[int]) -> np.ndarray:
    """Gradients, hessians and rows by slot and bin, the columns side by side. Whole numbers below 2^53, so doubles add them exactly.

    Columns of few bins are counted by their joint bins, which are then added up for each of them."""
    out = np.zeros((n, sum(widths[c] for c in columns), 3), np.int64)
    starts = dict(zip(columns, np.cumsum([0, *[widths[c] for c in columns]])))
    g, h = g.astype(float), h.astype(float)
    for group in _joint(columns, widths, min(JOINT, len(own) // (2 * n))):
        cell = slot.astype(np.int64)
        for c in group:
            cell *= widths[c]
            cell += own[:, c]
        sizes = [n, *[widths[c] for c in group]]
        for k, weights in enumerate((g, h, None)):
            sums = np.bincount(cell, weights, int(np.prod(sizes))).reshape(sizes)
            for i, c in enumerate(group):
                others = tuple(j for j in range(1, len(sizes)) if j != i + 1)
                out[:, starts[c]:starts[c] + widths[c], k] = sums.sum(axis=others)
    return out


def _joint(columns: list[int], widths: list[int], most: int) -> list[list[int]]:
    """The columns in groups of at most ``most`` joint bins; a column of more stands alone."""
    groups, size = [], 0
    for c in sorted(columns, key=lambda c: widths[c]):
        if groups and size * widths[c] <= most:
            groups[-1].append(c)
            size *= widths[c]
        else:
            groups.append([c])
            size = widths[c]
    return groups


def _bundles(turned: np.ndarray) -> list[tuple[np.ndarray, list[int], np.ndarray]]:
    """(code of each row, columns, their bins by code): columns whose joint bins take at most 256 of all values share a code, so that columns that
    exclude or determine each other are added up together."""
    out = []
    for c in sorted(range(len(turned)), key=lambda c: (int(turned[c].max(initial=0)), c)):
        if out:
            code, columns, bins = out[-1]
            joint = code.astype(np.int64) * 256 + turned[c]
            seen = np.flatnonzero(np.bincount(joint, minlength=1))
            if len(seen) <= 256:
                place = np.zeros(256 * 256, np.uint8)
                place[seen] = np.arange(len(seen))
                out[-1] = place[joint], [*columns, c], np.column_stack([bins[seen // 256], seen % 256])
                continue
        out.append((turned[c], [c], np.arange(int(turned[c].max(initial=0)) + 1)[:, None]))
    return out


def _lighter(block, keyed: bool):
    """A block as passes read it: bundles instead of columns, and keys only where rows are drawn by them."""
    turned, y, fold, key, margins = block
    return _bundles(turned), y, fold, key if keyed else key[:0], margins


def _walk(tree: Tree, bundles: list[tuple], n: int) -> np.ndarray:
    """``Tree.walk`` by codes: a node tells for each code of its column's bundle whether it goes right."""
    right, cells = np.zeros((len(tree.column), 256), np.int8), np.concatenate([code for code, _, _ in bundles])
    start = np.zeros(len(tree.column), np.int64)
    at = {c: (b, i) for b, (_, members, _) in enumerate(bundles) for i, c in enumerate(members)}
    for node in np.flatnonzero(tree.column >= 0):
        b, i = at[int(tree.column[node])]
        bins, start[node] = bundles[b][2][:, i], b * n
        right[node, :len(bins)] = bins > tree.cut[node]
    right, inner, rows, node = right.reshape(-1), tree.column >= 0, np.arange(n), np.zeros(n, np.int64)
    out = node
    while True:
        going = inner[node]
        if not going.all():
            rows, node = rows[going], node[going]
        if not len(rows):
            return out
        node = 2 * node + 1 + right[node * 256 + cells[start[node] + rows]]
        out[rows] = node


def _add_bundles(bundles: list[tuple], rows: np.ndarray, slot: np.ndarray, g: np.ndarray, h: np.ndarray, n: int, columns: list[int], widths: list[int]) -> np.ndarray:
    """What ``_add_up`` gives, for the ``rows`` of a block; slot, g and h are theirs.

    A row adds one complex number to its cell: g, and h beside a count of one in the low bits. ``SLICE`` rows keep both exact: h is at most UNIT / 4."""
    out = np.zeros((n, sum(widths[c] for c in columns), 3), np.int64)
    starts = dict(zip(columns, np.cumsum([0, *[widths[c] for c in columns]])))
    wanted = [(code, bins, mine) for code, members, bins in bundles if (mine := [(i, c) for i, c in enumerate(members) if c in starts])]
    met = np.zeros((len(wanted), 3, n * 256), np.int64)
    cell, weight = np.empty(min(SLICE, len(rows)), np.int64), np.empty(min(SLICE, len(rows)), complex)
    for at in range(0, len(rows), SLICE):
        part, base = rows[at:at + SLICE], slot[at:at + SLICE].astype(np.int64) * 256
        cell, weight = cell[:len(part)], weight[:len(part)]
        weight.real, weight.imag = g[at:at + SLICE], h[at:at + SLICE] * float(SLICE + 1) + 1
        for (code, _, _), sums in zip(wanted, met):
            np.add(base, code.take(part), out=cell)
            both = np.zeros(n * 256, complex)
            np.add.at(both, cell, weight)
            packed = both.imag.astype(np.int64)
            sums[0] += both.real.astype(np.int64)
            sums[1] += packed // (SLICE + 1)
            sums[2] += packed % (SLICE + 1)
    for (_, bins, mine), sums in zip(wanted, met.reshape(len(wanted), 3, n, 256)):
        sums = sums[:, :, :len(bins)].transpose(1, 2, 0)
        for i, c in mine:
            here = out[:, starts[c]:starts[c] + widths[c]]
            if bins.shape[1] == 1:
                here[:, :len(bins)] = sums
            else:
                for b in np.unique(bins[:, i]):
                    here[:, b] = sums[:, bins[:, i] == b].sum(axis=1)
    return out


def _parts(block, jobs: list[dict]):
    """What one block has to say: ((model, 0, chunk), sums) of large nodes and ((model, 1, node), rows) of small ones."""
    bundles, y, fold, key, margins = block
    for job in jobs:
        use = np.isin(fold, job["folds"])
        if job["subsample"] < 1:
            use &= _draw(key, job["salt"]) < job["subsample"]
        at = _walk(job["tree"], bundles, len(y))
        rows = np.flatnonzero(use & job["open"][at])
        if not len(rows):
            continue
        at = at[rows]
        g, h = _slopes(margins[rows, job["model"]], y[rows], job["weights"])
        for node in job["small"]:
            mine = at == node
            if mine.any():
                yield (job["model"], 1, node), ([_unbundled(bundles, rows[mine])], [g[mine]], [h[mine]])
        slot = job["slots"][at]
        if job["large"] and (slot >= 0).any():
            if not (slot >= 0).all():
                rows, g, h, slot = (a[slot >= 0] for a in (rows, g, h, slot))
            for chunk, columns in enumerate(job["chunks"]):
                yield (job["model"], 0, chunk), _add_bundles(bundles, rows, slot, g, h, job["counted"], columns, job["widths"])


def _unbundled(bundles: list[tuple], rows: np.ndarray) -> np.ndarray:
    """The bins of some rows by column."""
    out = np.empty((sum(len(members) for _, members, _ in bundles), len(rows)), np.uint8)
    for code, members, bins in bundles:
        out[members] = bins[code[rows]].T
    return out


def _slopes(margins: np.ndarray, label: np.ndarray, weights: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians in whole units, UNIT at most."""
    p = 1 / (1 + np.exp(-margins))
    w = np.where(label == 1, weights[1], weights[0]) * UNIT
    return tuple(np.rint(v).astype(np.int32) for v in (w * (p - label), w * np.maximum(p * (1 - p), 1e-16)))


def _meet(a, b):
    return tuple(x + y for x, y in zip(a, b)) if isinstance(a, tuple) else a + b


def _met(pairs) -> dict:
    out = {}
    for key, sums in pairs:
        out[key] = out[key] + sums if key in out else sums
    return out


def _pull(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_splits(sums: np.ndarray, columns: list[int], widths: list[int], p: dict, unit: float) -> list[tuple]:
    """Per slot (gain, column, cut, left g, h and rows, all g, h and rows): the best split among ``columns``, ties to the lower column and cut."""
    return _best(*np.ascontiguousarray(sums.transpose(2, 0, 1)), columns, widths, p, unit)


def _best(g: np.ndarray, h: np.ndarray, rows: np.ndarray | None, columns: list[int], widths: list[int], p: dict, unit: float) -> list[tuple]:
    """``best_splits`` of whole numbers by slot and bin; ``rows`` are None where nobody asks for them, and told as 0."""
    ends = np.cumsum([widths[c] for c in columns])
    starts = ends - [widths[c] for c in columns]
    lam, alpha = p["reg_lambda"], p["reg_alpha"]

    def sides(s, unit):
        run = s.cumsum(axis=1)
        total = run[:, ends[0] - 1:ends[0]].astype(float) * unit
        before = run[:, starts - 1]
        before[:, starts == 0] = 0
        run -= np.repeat(before, ends - starts, axis=1)
        return run.astype(float) * unit, total

    def worth(g, h):
        pulled, below = _pull(g, alpha) if alpha else g, h + lam
        return np.divide(pulled * pulled, below, out=np.zeros(g.shape), where=below > 0)

    (left_g, all_g), (left_h, all_h) = sides(g, unit), sides(h, unit)
    right_h = all_h - left_h
    gain = worth(left_g, left_h)
    gain += worth(all_g - left_g, right_h)
    gain -= worth(all_g, all_h)
    least = max(p["min_child_weight"], 1e-12)
    gain[(left_h < least) | (right_h < least)] = -np.inf
    gain[:, ends - 1] = -np.inf  # nothing is beyond a column's last bin
    at = gain.argmax(axis=1)
    which, every = np.searchsorted(ends, at, side="right"), np.arange(len(at))
    left_n, all_n = (np.zeros((len(at), 1)),) * 2 if rows is None else sides(rows, 1.0)
    return list(zip(gain[every, at].tolist(), np.array(columns)[which].tolist(), (at - starts[which]).tolist(), left_g[every, at].tolist(),
                    left_h[every, at].tolist(), left_n[every, at if rows is not None else 0].tolist(), all_g[:, 0].tolist(), all_h[:, 0].tolist(), all_n[:, 0].tolist()))


def boost(table: DataFrame, names: list[str], cuts: list[np.ndarray], specs: list[Spec], small: int | None = None) -> list[Model]:
    """Models grown in step on a written ``table`` of bins, label (0 or 1), fold and key (any whole number that tells rows apart).

    Positives weigh negatives per positive in each model's folds. The first margin is 0, which balanced classes make the best one. A leaf is
    -G / (H + reg_lambda) with G drawn towards 0 by reg_alpha, times learning_rate; a split must gain more than gamma and leave
    min_child_weight on both sides. Folds without both classes weigh all rows alike."""
    spark, sc = table.sparkSession, table.sparkSession.sparkContext
    counts = {(r["fold"], r["label"]): r["n"] for r in table.groupBy("fold", "label").agg(F.count("*").alias("n")).collect()}
    scale, rows = [], []
    for s in specs:
        neg, pos = (sum(counts.get((f, y), 0) for f in s.folds) for y in (0, 1))
        w = neg / pos if neg and pos else 1.0
        scale.append((max(w, 1.0), (1 / max(w, 1.0), w / max(w, 1.0))))
        rows.append(neg + pos)
    widths = [len(c) + 1 for c in cuts]
    grown: list[list[Tree]] = [[] for _ in specs]
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(f"{shared_dir(spark)}/boost")
    used = sorted({f for s in specs for f in s.folds})
    fitted = sum(n for (f, _), n in counts.items() if f in used)
    wanted = table.filter(F.col("fold").isin(*used))
    if small is None and fitted * len(names) <= ALONE:
        return [Model(list(names), cuts, trees) for trees in _each_alone(_pack(wanted, len(names), 0, fitted), specs, names, widths, scale)]
    keyed = any(s.params["subsample"] < 1 for s in specs)
    state = _pack(wanted, len(names), len(specs), fitted).map(lambda block: _lighter(block, keyed)).persist(StorageLevel.MEMORY_AND_DISK)
    older, parts = state, state.getNumPartitions()
    for t in range(max(s.params["n_estimators"] for s in specs)):
        live = [m for m, s in enumerate(specs) if t < s.params["n_estimators"]]
        trees = {m: Tree.empty(specs[m].params["max_depth"]) for m in live}
        use = {m: _columns(specs[m], t, names) for m in live}
        open_ = {m: {0: rows[m]} for m in live if rows[m]}
        above: dict[int, dict[int, np.ndarray]] = {}
        while open_:
            cells = sum(len(nodes) * sum(widths[c] for c in use[m]) for m, nodes in open_.items())
            handed = small is None and cells * 24 * parts <= HANDED
            above = above if handed else {}
            jobs = [_job(m, specs[m], t, trees[m], nodes, use[m], widths, scale[m], 0 if handed else SMALL if small is None else small, above.get(m, {}))
                    for m, nodes in open_.items()]
            open_, above = _round(state, jobs, trees, handed, above)
        for m in live:
            grown[m].append(trees[m])
        old, state = state, state.map(_advance(trees)).persist(StorageLevel.MEMORY_AND_DISK)
        if t % CHECKPOINT == CHECKPOINT - 1:
            state.checkpoint()
            state.count()
        elif t:
            older.unpersist()
        older = old
    for rdd in (state, older):
        rdd.unpersist()
    return [Model(list(names), cuts, g) for g in grown]


def _job(m: int, spec: Spec, t: int, tree: Tree, nodes: dict[int, float], columns: list[int], widths: list[int], scale: tuple, small: int,
         above: dict[int, np.ndarray]) -> dict:
    """What a block needs to know for one pass of one model; ``nodes`` are the open ones with their rows, ``above`` the sums of their parents, if known.

    Large nodes are in order: those that are counted, then those that are what a counted sibling leaves of its parent."""
    large = [i for i, n in nodes.items() if n > small]
    left_over = _left_over({i: nodes[i] for i in large}) if above else set()
    large = [i for i in large if i not in left_over] + [i for i in large if i in left_over]
    counted = len(large) - len(left_over)
    slots, open_ = np.full(len(tree.column), -1, np.int64), np.zeros(len(tree.column), bool)
    slots[large[:counted]], open_[[i for i in nodes if i not in left_over]] = np.arange(counted), True
    chunks, cells = [[]], 0
    for c in columns:
        if chunks[-1] and (cells + widths[c]) * len(large) > CHUNK:
            chunks.append([])
            cells = 0
        chunks[-1].append(c)
        cells += widths[c]
    return {"model": m, "folds": list(spec.folds), "subsample": spec.params["subsample"], "salt": _salt(spec, t), "tree": tree, "slots": slots, "open": open_,
            "large": large, "counted": counted, "small": [i for i in nodes if nodes[i] <= small], "columns": columns, "chunks": chunks, "widths": widths,
            "weights": scale[1], "params": spec.params, "unit": scale[0] / UNIT}


def _left_over(nodes: dict[int, float]) -> set[int]:
    """Of each pair of siblings the one of more rows."""
    return {i if (nodes[i], -i) > (nodes[i + 1], -i - 1) else i + 1 for i in nodes if i % 2 and i + 1 in nodes}


def _completed(got: np.ndarray, large: list[int], counted: int, above: dict[int, np.ndarray]) -> np.ndarray:
    """The sums of all large nodes: the counted ones, and their parents' less theirs."""
    of = dict(zip(large, got))
    rest = [above[(i - 1) // 2] - of[i + 1 if i % 2 else i - 1] for i in large[counted:]]
    return np.concatenate([got, np.stack(rest)]) if rest else got


def _round(state: RDD, jobs: list[dict], trees: dict[int, Tree], handed: bool, above: dict) -> tuple[dict[int, dict[int, float]], dict[int, dict[int, np.ndarray]]]:
    """One pass for all models: large nodes are split once, small ones to their end. Returns the nodes that are open after it, and the sums of those split.

    ``handed``: all nodes are large and their sums few, so each task adds up its own blocks and the driver the tasks; no shuffle is made."""
    about = {j["model"]: {k: j[k] for k in ("chunks", "columns", "widths", "params", "unit")} for j in jobs}

    def chosen(kv):
        (m, kind, which), got = kv
        a = about[m]
        if kind:
            return m, kind, which, finish(which, np.concatenate(got[0], axis=1).T, *map(np.concatenate, got[1:]), a["columns"], a["widths"], a["params"], a["unit"])
        return m, kind, which, best_splits(got, a["chunks"][which], a["widths"], a["params"], a["unit"])

    keys = sum(len(j["small"]) + len(j["chunks"]) for j in jobs)
    reducers = max(1, min(state.context.defaultParallelism, keys))
    sums: dict[int, dict[int, np.ndarray]] = {}
    if handed:
        met = _met(state.mapPartitions(lambda blocks: _met(kv for b in blocks for kv in _parts(b, jobs)).items()).collect())
        by_model, parts = {j["model"]: j for j in jobs}, []
        for key, got in met.items():
            j = by_model[key[0]]
            if len(j["chunks"]) == 1:
                got = _completed(got, j["large"], j["counted"], above.get(key[0], {}))
                sums[key[0]] = dict(zip(j["large"], got))
            parts.append(chosen((key, got)))
    else:
        parts = state.flatMap(lambda block: _parts(block, jobs)).reduceByKey(_meet, reducers).map(chosen).collect()
    best: dict[int, list[tuple]] = {}
    for m, kind, _, got in sorted(parts, key=lambda p: p[:3]):
        if kind:
            for field_, values in zip(("column", "cut", "value", "cover"), got[1:]):
                getattr(trees[m], field_)[got[0]] = values
        else:  # chunks are in the order of their columns, so of equal gains the first stays
            best[m] = [max(a, b, key=lambda s: s[0]) for a, b in zip(best[m], got)] if m in best else got
    opened = {j["model"]: split(trees[j["model"]], j["large"], best.get(j["model"], []), j["params"]) for j in jobs}
    return {m: below for m, below in opened.items() if below}, sums


# ---------------------------------------------------------------- a model in a task
def _each_alone(state: RDD, specs: list[Spec], names: list[str], widths: list[int], scale: list[tuple]) -> list[list[Tree]]:
    """The trees of each model, grown by a task that gets the rows of its folds."""

    def sent(block):
        turned, y, fold, key = block[:4]
        for m, s in enumerate(specs):
            use = np.isin(fold, s.folds)
            if use.any():
                yield m, (turned, y, key) if use.all() else (turned[:, use], y[use], key[use])

    def grown(blocks):
        of = list(blocks)
        if of:
            m, got = of[0][0], [b for _, b in of]
            turned, y, key = (np.concatenate(a, axis=-1) for a in zip(*got))
            yield m, grow_alone(turned, y, key, specs[m], names, widths, scale[m])

    task = _dealt(specs)
    found = dict(state.flatMap(sent).partitionBy(len(specs), task.__getitem__).mapPartitions(grown).collect())
    return [found.get(m) or [Tree.empty(s.params["max_depth"]) for _ in range(s.params["n_estimators"])] for m, s in enumerate(specs)]


def _dealt(specs: list[Spec]) -> list[int]:
    """The task of each model: those of most levels first, since tasks start in order and the last to end is waited for."""
    order = sorted(range(len(specs)), key=lambda m: -specs[m].params["n_estimators"] * specs[m].params["max_depth"])
    return np.argsort(order).tolist()


def grow_alone(turned: np.ndarray, y: np.ndarray, key: np.ndarray, spec: Spec, names: list[str], widths: list[int], scale: tuple) -> list[Tree]:
    """All trees of one model on rows at hand: the same levels as passes make.

    The rows are gone through ``SLICE`` at a time, so that what a level reads and writes of them stays in a core's cache. A row adds one complex
    number to its cell, g and h. ``ALONE`` keeps all their sums below 2^53, so doubles hold them exactly."""
    p, unit, bundles, rows = spec.params, scale[0] / UNIT, _bundles(turned), len(y)
    spans = [(lo, min(lo + SLICE, rows)) for lo in range(0, rows, SLICE)]
    # A row's codes lie side by side, in a width that is copied at once.
    width = next((w for w in (1, 2, 4, 8, 16, 32) if w >= len(bundles)), len(bundles))
    blocks = [np.zeros((hi - lo, width), np.uint8) for lo, hi in spans]
    for (lo, hi), block in zip(spans, blocks):
        for b, (code, _, _) in enumerate(bundles):
            block[:, b] = code[lo:hi]
    bundles = [(None, members, bins) for _, members, bins in bundles]
    place = {c: (b, i) for b, (_, members, _) in enumerate(bundles) for i, c in enumerate(members)}
    margins, grown = np.zeros(rows), []
    place_of = np.uint16 if p["max_depth"] < 16 else np.uint32
    at, slopes = np.zeros(rows, place_of), np.empty(rows, complex)
    cell, every = np.empty(min(SLICE, rows), np.int64), np.arange(min(SLICE, rows)) * width
    for t in range(p["n_estimators"]):
        tree, columns = Tree.empty(p["max_depth"]), _columns(spec, t, names)
        for lo, hi in spans:
            slopes.real[lo:hi], slopes.imag[lo:hi] = _slopes(margins[lo:hi], y[lo:hi], scale[1])
        drawn = _draw(key, _salt(spec, t)) < p["subsample"] if p["subsample"] < 1 else None
        starts = dict(zip(columns, np.cumsum([0, *[widths[c] for c in columns]])))
        wanted = [(b, bins, mine) for b, (_, members, bins) in enumerate(bundles) if (mine := [(i, c) for i, c in enumerate(members) if c in starts])]
        at[:] = 0
        # Where a row goes on from its node, by the code of the bundle that the node asks; at rest it stays.
        after = np.repeat(np.arange(len(tree.column), dtype=place_of), 256).reshape(-1, 256)
        asked, moving = np.zeros(len(tree.column), np.int64), False
        open_, above = [0], {}
        while open_ or moving:
            left_over = _left_over({i: tree.cover[i] for i in open_}) if above else set()
            counted = [i for i in open_ if i not in left_over]
            base_of = np.full(len(tree.column), -1, np.int64)
            base_of[counted] = np.arange(len(counted)) * 256
            met = np.zeros((len(wanted), len(counted) * 256), complex)
            for (lo, hi), block in zip(spans, blocks):
                if moving:
                    node = at[lo:hi].astype(np.int64)
                    step = asked.take(node)
                    step += every[:hi - lo]
                    node <<= 8
                    node += block.reshape(-1).take(step)
                    at[lo:hi] = after.reshape(-1).take(node)
                if counted:
                    base = base_of.take(at[lo:hi])
                    here = np.flatnonzero(base >= 0 if drawn is None else (base >= 0) & drawn[lo:hi])
                    got, weight = block, slopes[lo:hi]
                    if len(here) < hi - lo:
                        base, got, weight = base.take(here), block.take(here, axis=0), weight.take(here)
                    mine = cell[:len(here)]
                    for (b, _, _), sums in zip(wanted, met):
                        np.add(base, got[:, b], out=mine)
                        np.add.at(sums, mine, weight)
            if not counted:
                break
            large = [*counted, *[i for i in open_ if i in left_over]]
            sums = _by_column(met, wanted, starts, sum(widths[c] for c in columns), len(counted))
            sums = _completed(sums, large, len(counted), above)
            above = dict(zip(large, sums))
            below = split(tree, large, _best(*np.ascontiguousarray(sums.transpose(1, 0, 2)), None, columns, widths, p, unit), p)
            after[large], moving = np.array(large, place_of)[:, None], False
            for i in large:
                if tree.column[i] >= 0:
                    b, k = place[int(tree.column[i])]
                    bins = bundles[b][2][:, k]
                    asked[i], moving = b, True
                    after[i, :len(bins)] = 2 * i + 1 + (bins > tree.cut[i])
            open_ = sorted(below)
        margins += tree.value.take(at)
        grown.append(tree)
    return grown


def _by_column(met: np.ndarray, wanted: list[tuple], starts: dict[int, int], cells: int, n: int) -> np.ndarray:
    """(slot, g or h, bin of the columns side by side) of sums by (bundle, slot and code)."""
    out = np.zeros((n, 2, cells))
    for (_, bins, mine), sums in zip(wanted, met.reshape(len(wanted), n, 256)):
        sums = np.stack([sums.real, sums.imag], axis=1)[:, :, :len(bins)]
        for i, c in mine:
            here = out[:, :, starts[c]:]
            if bins.shape[1] == 1:
                here[:, :, :len(bins)] = sums
            else:
                for b in np.unique(bins[:, i]):
                    here[:, :, b] = sums[:, :, bins[:, i] == b].sum(axis=2)
    return out


def finish(root: int, x: np.ndarray, g: np.ndarray, h: np.ndarray, columns: list[int], widths: list[int], p: dict, unit: float) -> tuple:
    """The subtree of a node from its own rows: its nodes with their column, cut, value and cover."""
    tree = Tree.empty(p["max_depth"])
    at, nodes, seen = np.full(len(x), root), {root: len(x)}, [root]
    while nodes:
        slots = np.full(len(tree.column), -1, np.int64)
        slots[list(nodes)] = np.arange(len(nodes))
        inside = slots[at] >= 0
        if not inside.all():
            x, g, h, at = x.T[:, inside].T, g[inside], h[inside], at[inside]
        found = best_splits(_add_up(x, slots[at], g, h, len(nodes), columns, widths), columns, widths, p, unit)
        below = split(tree, list(nodes), found, p)
        parents = [i for i in nodes if tree.column[i] >= 0]
        seen += [k for i in parents for k in (2 * i + 1, 2 * i + 2)]
        column = tree.column[at]
        moving = column >= 0
        at[moving] = 2 * at[moving] + 1 + (x[np.flatnonzero(moving), column[moving]] > tree.cut[at[moving]])
        nodes = below
    return np.array(seen), tree.column[seen], tree.cut[seen], tree.value[seen], tree.cover[seen]


def split(tree: Tree, nodes: list[int], found: list[tuple], p: dict) -> dict[int, float]:
    """Sets the nodes of one level; the nodes that are open on the next one, with their rows."""
    below = {}
    lam, alpha, rate, leaf_from = p["reg_lambda"], p["reg_alpha"], p["learning_rate"], 2 ** p["max_depth"] - 1

    def leaf(i, g, h):
        pulled = max(abs(g) - alpha, 0.0)
        tree.cover[i] = h
        tree.value[i] = -rate * (pulled if g > 0 else -pulled if g < 0 else 0.0) / (h + lam) if h + lam > 0 else 0.0

    for i, (gain, column, cut, lg, lh, ln, g, h, n) in zip(nodes, found):
        leaf(i, g, h)
        if gain > LEAST_GAIN and gain >= p["gamma"] and i < leaf_from:
            tree.column[i], tree.cut[i], tree.value[i] = column, cut, 0.0
            leaf(2 * i + 1, lg, lh)
            leaf(2 * i + 2, g - lg, h - lh)
            below |= {k: rows for k, rows in ((2 * i + 1, ln), (2 * i + 2, n - ln)) if k < leaf_from}
    return below


def _advance(trees: dict[int, Tree]):
    def work(block):
        bundles, y, fold, key, margins = block
        margins = margins.copy()
        for m, tree in trees.items():
            margins[:, m] += tree.value[_walk(tree, bundles, len(y))]
        return bundles, y, fold, key, margins

    return work


# ---------------------------------------------------------------- use
def score(models: list[Model], table: DataFrame, keep: list[str], names: list[str] | None = None) -> DataFrame:
    """(keep..., margin and score of each model): scores are probabilities. ``names`` name the score columns of several models."""
    width, names = len(models[0].names), names or ["score"]
    sent = table.sparkSession.sparkContext.broadcast(models)  # bounded by trees and their depth

    def work(batches):
        for b in batches:
            x = matrix(b.column(len(keep)), width)
            margins = [m.margins(x) for m in sent.value]
            arrays = [a for s in margins for a in (pa.array(s), pa.array(1 / (1 + np.exp(-s))))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *arrays],
                                             names=[*keep, *[c for n in names for c in (f"{n}_margin", n)]])

    kinds = dict(table.dtypes)
    fields = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], *[f"`{n}_margin` double, `{n}` double" for n in names]])
    return table.select(*map(q, keep), "bins").mapInArrow(work, fields)


def nodes(model: Model) -> list[tuple]:
    """(tree, node, column name or None, threshold, value, cover) of every node that rows can reach. Values below the threshold go left."""
    out = []
    for t, tree in enumerate(model.trees):
        stack = [0]
        while stack:
            i = stack.pop()
            c = int(tree.column[i])
            # Bins up to ``cut`` go left: the threshold is the least value of the bin after it, or none where nulls alone go left.
            threshold = None if c < 0 else float(model.cuts[c][tree.cut[i]]) if tree.cut[i] else float("-inf")
            out.append((t, i, None if c < 0 else model.names[c], threshold, float(tree.value[i]), float(tree.cover[i])))
            stack += [] if c < 0 else [2 * i + 2, 2 * i + 1]
    return out
