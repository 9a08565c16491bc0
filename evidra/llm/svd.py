"""Truncated singular value decomposition of a sparse, distributed matrix by random projection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Columns of the matrix whose partial products travel together.
BLOCK = 1024


def randomised_svd(rows: DataFrame, n_columns: int, rank: int, oversample: int = 16, iterations: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The right singular vectors (n_columns x rank) and the singular values of a matrix of sparse rows.

    `rows` has the columns `at` (array<int>) and `weights` (array<double>). Each pass multiplies A'A with a thin
    matrix: every task adds up the products of its own rows, and the sums of the tasks are added by blocks of columns
    in Spark. The driver holds n_columns x (rank + oversample) numbers; with n_columns a vocabulary, that is a bound
    which doesn't grow with the rows.
    """
    width = min(rank + oversample, n_columns)
    rng = np.random.default_rng(seed)
    basis = np.linalg.qr(rng.standard_normal((n_columns, width)))[0]

    def gram_times(thin: np.ndarray) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(thin)

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = None
            for batch in batches:
                for at, weights in zip(batch["at"], batch["weights"]):
                    if len(at):
                        out = np.zeros(shared.value.shape) if out is None else out
                        np.add.at(out, at, np.outer(weights, weights @ shared.value[at]))
            if out is not None:
                yield pd.DataFrame({"block": range(0, n_columns, BLOCK), "part": [out[i : i + BLOCK].tobytes() for i in range(0, n_columns, BLOCK)]})

        def add(parts: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in parts["part"])
            return pd.DataFrame({"block": [parts["block"].iloc[0]], "part": [total.tobytes()]})

        kind = "block int, part binary"
        sums = rows.select("at", "weights").mapInPandas(partial, kind).groupBy("block").applyInPandas(add, kind)
        out = np.zeros((n_columns, thin.shape[1]))
        for r in sums.collect():
            block = np.frombuffer(bytes(r["part"])).reshape(-1, thin.shape[1])
            out[r["block"] : r["block"] + len(block)] = block
        shared.unpersist()
        return out

    product = gram_times(basis)
    for _ in range(iterations - 1):
        basis = np.linalg.qr(product)[0]
        product = gram_times(basis)
    values, vectors = np.linalg.eigh(basis.T @ product)
    order = np.argsort(values)[::-1][:rank]
    kept = order[values[order] > max(values.max(), 0) * 1e-9]
    return basis @ vectors[:, kept], np.sqrt(values[kept])
