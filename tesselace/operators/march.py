"""Rays through a mesh of tetrahedra, cell by cell, and a tour through points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Mesh:
    """Vertices (n, 3), cells (m, 4 vertices) and, for each facet opposite a vertex, the cell beyond it (-1: none)."""

    def __init__(self, vertices: np.ndarray, cells: np.ndarray):
        self.vertices, self.cells = np.asarray(vertices, float), np.asarray(cells, np.int64)
        m = len(self.cells)
        facets = np.stack([np.delete(self.cells, k, 1) for k in range(4)], 1).reshape(-1, 3)
        keys = np.sort(facets, 1)
        order = np.lexsort(keys.T[::-1])
        same = np.flatnonzero((keys[order][1:] == keys[order][:-1]).all(1))
        beyond = np.full(4 * m, -1)
        a, b = order[same], order[same + 1]
        beyond[a], beyond[b] = b // 4, a // 4
        self.beyond = beyond.reshape(m, 4)
        p = self.vertices[facets]
        normal = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        inner = self.vertices[self.cells.reshape(-1)]  # the vertex that a facet lies opposite of
        out = np.sign(((p[:, 0] - inner) * normal).sum(1))
        self.normal = (normal * out[:, None]).reshape(m, 4, 3)  # away from the cell
        self.offset = (self.normal * p[:, 0].reshape(m, 4, 3)).sum(2)

    def holding(self, point: np.ndarray) -> int:
        """The lowest cell that holds a point, -1 if none does."""
        inside = ((self.normal * point).sum(2) <= self.offset + 1e-9).all(1)
        return int(np.argmax(inside)) if inside.any() else -1

    def march(self, start: np.ndarray, end: np.ndarray) -> list[tuple[int, float, float]]:
        """(cell, entered, left) of the cells on the way from start to end, as shares of it. A ray that starts outside
        enters where it first meets the border; one that leaves the mesh ends there."""
        way = end - start
        cell, t = self.holding(start), 0.0
        if cell < 0:
            border = np.argwhere(self.beyond < 0)
            speed = (self.normal[border[:, 0], border[:, 1]] * way).sum(1)
            with np.errstate(divide="ignore", invalid="ignore"):
                at = (self.offset[border[:, 0], border[:, 1]] - (self.normal[border[:, 0], border[:, 1]] * start).sum(1)) / speed
            for k in np.argsort(np.where((speed < 0) & (at >= 0) & (at <= 1), at, np.inf), kind="stable"):
                if not (speed[k] < 0 and 0 <= at[k] <= 1):
                    return []
                c = int(border[k, 0])
                if ((self.normal[c] * (start + at[k] * way)).sum(1) <= self.offset[c] + 1e-9 * (1 + np.abs(self.offset[c]))).all():
                    cell, t = c, float(at[k])
                    break
            else:
                return []
        out, seen = [], set()
        while cell >= 0 and cell not in seen:  # rounding may turn a ray back: no cell twice
            seen.add(cell)
            speed = self.normal[cell] @ way
            with np.errstate(divide="ignore", invalid="ignore"):
                leave = np.where(speed > 0, (self.offset[cell] - self.normal[cell] @ start) / speed, np.inf)
            k = int(np.argmin(leave))
            stop = min(1.0, max(t, float(leave[k])))
            out.append((cell, t, stop))
            if stop >= 1.0:
                break
            t, cell = stop, int(self.beyond[cell, k])
        return out


def crossed_cells(rays: DataFrame, vertices: DataFrame, cells: DataFrame, broadcast_bytes: int = 256_000_000) -> DataFrame:
    """(ray, at, cell, share): the cells that each ray (ray, sx, sy, sz, ex, ey, ez) passes, in order, with the share of
    its way inside. The mesh (vertices id, x, y, z; cells cell, vertices) is broadcast behind a check of its size."""
    n, m = vertices.count(), cells.count()
    if 24 * n + 500 * m > broadcast_bytes:
        raise ValueError(f"a mesh of {n} vertices and {m} cells is over the bound of {broadcast_bytes} bytes; cut it into blocks")
    v, c = vertices.orderBy("id").toArrow().to_pandas(), cells.orderBy("cell").toArrow().to_pandas()
    corners = np.array(c["vertices"].tolist(), np.int64).reshape(m, 4)
    mesh = rays.sparkSession.sparkContext.broadcast((Mesh(v[["x", "y", "z"]].to_numpy(), np.searchsorted(v["id"].to_numpy(), corners)), c["cell"].to_numpy()))

    def walk(it):
        shape, names = mesh.value
        for frame in it:
            out = []
            for ray, *p in frame[["ray", "sx", "sy", "sz", "ex", "ey", "ez"]].itertuples(index=False):
                out += [(ray, k, int(names[cell]), b - a) for k, (cell, a, b) in enumerate(shape.march(np.array(p[:3], float), np.array(p[3:], float)))]
            yield pd.DataFrame(out, columns=["ray", "at", "cell", "share"])

    return rays.dropna().mapInPandas(walk, "ray long, at long, cell long, share double")


def weak_cells(crossed: DataFrame, scores: DataFrame, span: int = 4) -> DataFrame:
    """(ray, end, before, beyond, silent): along each ray, read from finished scores (cell, emptiness, fullness): the last
    cell, the greatest emptiness in the `span` cells before it, its own, and the fullness of all cells before those.
    A surface is weakly supported where emptiness jumps at its end and nothing was said on the way."""
    last = crossed.groupBy("ray").agg(F.max("at").alias("last"))
    rows = crossed.join(scores, "cell", "left").join(last, "ray")
    e, f = F.coalesce("emptiness", F.lit(0)), F.coalesce("fullness", F.lit(0))
    back = F.col("last") - F.col("at")
    return rows.groupBy("ray").agg(
        F.max(F.when(back == 0, F.col("cell"))).alias("end"),
        F.max(F.when((back > 0) & (back <= span), e).otherwise(0)).alias("before"),
        F.max(F.when(back == 0, e)).alias("beyond"),
        F.sum(F.when(back > span, f).otherwise(0)).alias("silent"),
    )


def tours(points: DataFrame, group: str) -> DataFrame:
    """(group, at, id): from each group's least id always on to the nearest point left, ties to the lower id. A tour is
    sequential: a group (the cameras of a scene; id, x, y, z) is one task's, with one distance row a step."""

    def walk(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        p, left = frame[["x", "y", "z"]].to_numpy(float), np.ones(len(frame), bool)
        order = [0]
        for _ in range(len(frame) - 1):
            left[order[-1]] = False
            d = ((p - p[order[-1]]) ** 2).sum(1)
            order.append(int(np.argmin(np.where(left, d, np.inf))))
        return pd.DataFrame({group: key[0], "at": np.arange(len(order)), "id": frame["id"].to_numpy()[order]})

    kind = dict(points.dtypes)[group]
    return points.where("id is not null and x is not null and y is not null and z is not null").groupBy(group).applyInPandas(walk, f"{group} {kind}, at long, id long")
