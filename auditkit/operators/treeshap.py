"""Path-dependent Shapley attributions of boosted trees, in log-odds, computed per partition with numpy.

At each node of its path a leaf either agrees with a row's decision or not. Written as bits, the decisions of a path of length l are a
whole number below 2^l, and rows with the same number share the leaf's attribution. So a tree has, for each leaf, a table of
shares indexed by that number; a row looks its leaves up. The numbers of all leaves come from walking the tree level by level, twice the
number of the parent plus the own decision. The table is the Shapley sum over coalitions, as an integral over t in [0, 1] of products of
(hit t + share of cover (1 - t)), which a quadrature with half as many points as there are features gives without error.

Memory is bounded by one tree's table (4 MB at depth 8, whatever the number of trees) beside a store of fixed size for tables used again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from auditkit.operators.boost import Model, Tree, matrix
from auditkit.operators.cumulate import q

#: Bytes of tables that a task keeps for its next batch, and rows worked on at once.
STORE, ROWS = 1 << 28, 8_192


def _levels(tree: Tree) -> list[np.ndarray]:
    """The nodes in use by their depth."""
    found, at = [], np.array([0])
    while len(at):
        found.append(at)
        inner = at[tree.column[at] >= 0]
        at = np.sort(np.concatenate([2 * inner + 1, 2 * inner + 2]))
    return found


def _paths(leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For leaves of one depth the nodes of their paths from the root, and where each path goes on (1: left)."""
    above = [leaves]
    for _ in range(depth):
        above.append((above[-1] - 1) // 2)
    nodes = np.stack(above[::-1], axis=1)
    return nodes[:, :-1], (nodes[:, 1:] == 2 * nodes[:, :-1] + 1).astype(np.int8)


def shares(hit: np.ndarray, zero: np.ndarray) -> np.ndarray:
    """Shapley shares along the last axis of a leaf of value one: features with ``hit`` (0 or 1) and share of cover ``zero``.

    A feature with hit and zero both 1 takes no part."""
    m = hit.shape[-1]
    points, weights = np.polynomial.legendre.leggauss(max(1, (m + 1) // 2))
    out = np.zeros(np.broadcast_shapes(hit.shape, zero.shape))
    for t, w in zip((points + 1) / 2, weights / 2):
        factor = hit * t + zero * (1 - t)
        # Products of all factors but one, from products before and behind it.
        before, behind = np.ones_like(factor), np.ones_like(factor)
        np.cumprod(factor[..., :-1], axis=-1, out=before[..., 1:])
        behind[..., :-1] = np.cumprod(factor[..., :0:-1], axis=-1)[..., ::-1]
        out += w * before * behind
    return out * (hit - zero)


def _table(tree: Tree, leaves: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For leaves of one depth: the columns of their paths, and shares by (leaf, number of the row's agreements, place on the path), times value."""
    nodes, left = _paths(leaves, depth)
    column = tree.column[nodes]
    child = np.where(left == 1, 2 * nodes + 1, 2 * nodes + 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(tree.cover[nodes] > 0, tree.cover[child] / tree.cover[nodes], 0.0)
    same = column[:, :, None] == column[:, None, :]
    first = ~np.tril(same, -1).any(axis=2)  # a column counts where it stands first; there it carries all its places
    zero = np.where(first, np.where(same, part[:, None, :], 1.0).prod(axis=2), 1.0)
    bits = (np.arange(2**depth)[:, None] >> np.arange(depth - 1, -1, -1)) & 1
    missed = np.einsum("pj,lij->lpi", 1 - bits, same.astype(np.int64))  # places of the same column that disagree
    hit = np.where(first[:, None, :], missed == 0, True).astype(float)
    return column, shares(hit, zero[:, None, :]) * tree.value[leaves][:, None, None]


def _tables(tree: Tree) -> list[tuple]:
    out = []
    for depth, level in enumerate(_levels(tree)):
        leaves = level[tree.column[level] < 0]
        if depth and len(leaves):
            column, table = _table(tree, leaves, depth)
            out.append((depth, leaves, column, np.ascontiguousarray(table.transpose(0, 2, 1))))
    return out


def _add(phi: np.ndarray, x: np.ndarray, tree: Tree, tables: list[tuple]) -> None:
    """Adds one tree's attributions of the rows ``x`` to ``phi``, which has a row for each feature."""
    rows, share = len(x), np.empty(len(x))
    wanted = {depth: (leaves, column, table) for depth, leaves, column, table in tables}
    numbers = np.zeros((1, rows), np.int32)
    for depth, level in enumerate(_levels(tree)):
        if depth in wanted:
            leaves, column, table = wanted[depth]
            for i, at in enumerate(np.searchsorted(level, leaves)):
                number = numbers[at].astype(np.intp)
                for j, c in enumerate(column[i]):
                    table[i, j].take(number, out=share, mode="clip")  # no number lies outside; other modes copy
                    phi[c] += share
        inner = np.flatnonzero(tree.column[level] >= 0)
        if len(inner):
            node = level[inner]
            goes_left = (x[:, tree.column[node]] <= tree.cut[node]).T
            below = np.empty((2 * len(inner), rows), np.int32)
            below[0::2], below[1::2] = 2 * numbers[inner] + goes_left, 2 * numbers[inner] + ~goes_left
            numbers = below


def base_value(model: Model) -> float:
    """Margin of the average training row: leaf values weighted by the share of cover that reaches them."""
    total = 0.0
    for tree in model.trees:
        reach = {0: 1.0}
        for level in _levels(tree):
            for i in level.tolist():
                if tree.column[i] < 0:
                    total += reach[i] * float(tree.value[i])
                else:
                    for k in (2 * i + 1, 2 * i + 2):
                        reach[k] = reach[i] * (float(tree.cover[k] / tree.cover[i]) if tree.cover[i] > 0 else 0.0)
    return total


def attributions(model: Model, x: np.ndarray, known: dict | None = None) -> np.ndarray:
    """Attributions of the rows ``x`` of bin numbers. ``known`` keeps tables between calls, up to STORE bytes."""
    phi = np.zeros((x.shape[1], len(x)))
    known = {} if known is None else known
    for t, tree in enumerate(model.trees):
        tables = known.get(t)
        if tables is None:
            tables = _tables(tree)
            size = sum(table.nbytes for *_, table in tables)
            if known.get("bytes", 0) + size <= STORE:
                known[t], known["bytes"] = tables, known.get("bytes", 0) + size
        _add(phi, x, tree, tables)
    return phi.T


def attribute_trees(model: Model, table: DataFrame, key: str = "row_id") -> tuple[DataFrame, float]:
    """Wide attributions (key, features...) of a table of bins, and the base value; base plus a row's attributions is its margin.

    The model is sent to the tasks once; it is bounded by its trees and their depth, not by data."""
    sent, names = table.sparkSession.sparkContext.broadcast(model), model.names

    def run(batches):
        known: dict = {}
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                phi = attributions(sent.value, matrix(part.column(1), len(names)), known)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(phi[:, i]) for i in range(len(names))]], [key, *names])

    fields = f"`{key}` {dict(table.dtypes)[key]}, " + ", ".join(f"`{n}` double" for n in names)
    return table.select(q(key), "bins").mapInArrow(run, fields), base_value(model)
