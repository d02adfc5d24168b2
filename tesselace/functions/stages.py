"""Extension points: stages over batches, matchers, and costs with their derivatives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesselace.operators.knn import knn2, ratio_test

Stage = Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]


def run_stage(rows: DataFrame, stage: Stage, schema: str) -> DataFrame:
    """A stage is a function from columns to columns of the same rows, without state: what it gives does not depend on
    how rows are dealt into batches, and it can be run on plain arrays."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            made = stage({n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names})
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in made.items()})

    return rows.mapInArrow(batches, schema)


class Matcher:
    """A base of vectors (id, view, v) that queries are matched against; two neighbours each."""

    def __init__(self, **options):
        self.options, self.base = options, None

    def build(self, base: DataFrame) -> Matcher:
        self.base = base
        return self

    def search(self, queries: DataFrame, neighbours: int = 2) -> DataFrame:
        if self.base is None:
            raise RuntimeError("build first")
        if neighbours != 2:
            raise ValueError("a matcher finds two neighbours")
        return knn2(queries, self.base, **self.options)

    def matches(self, queries: DataFrame, numerator: int = 4, denominator: int = 5) -> DataFrame:
        """Those of search that pass the ratio test."""
        return ratio_test(self.search(queries), numerator, denominator).where("passes").drop("passes")


def cost_rows(rows: DataFrame, cost: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]], keep: list[str]) -> DataFrame:
    """rows' columns `keep` with the residual (n of them a row) and the Jacobian (row-major) that a cost function gives
    for columns of parameters: it returns arrays (rows, n) and (rows, n, parameters)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            columns = {n: np.array(batch.column(n).to_pylist()) if pa.types.is_list(batch.column(n).type) else batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
            if not batch.num_rows:
                continue
            residual, jacobian = cost(columns)
            flat = [pa.array(list(x.reshape(len(x), -1)), pa.list_(pa.float64())) for x in (residual, jacobian)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *flat], [*keep, "residual", "jacobian"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(batches, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", residual array<double>, jacobian array<double>")
