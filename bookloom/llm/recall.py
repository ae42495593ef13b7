"""python -m bookloom.llm.recall DIR [ROWS]: measures links found against brute force, for the figures in the README.

Vectors: of DIR's embeddings and of ROWS made ones with a third in one cluster. Documents: pairs of different texts of
DIR whose five-word shingles have a Jaccard similarity of 0.8 or more, by groups of near_groups().
"""

from __future__ import annotations

import os
import sys
from collections import defaultdict

import numpy as np
import pyarrow.dataset as ds
from pyspark.sql import SparkSession

from . import pivots, simhash
from .storage import ship


def true_links(x: np.ndarray, threshold: float = pivots.THRESHOLD) -> np.ndarray:
    """Other vectors that each is linked with, a block at a time."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300)
    return np.concatenate([(u[s : s + 512] @ u.T >= threshold).sum(1) for s in range(0, len(u), 512)]) - 1


def dense(n: int, width: int = 64, seed: int = 7) -> np.ndarray:
    """A third of the rows in one cluster with cosines about 0.92."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    x[: n // 3] = rng.normal(size=width) + x[: n // 3] * 0.295
    return x.astype(np.float32)


def of_vectors(spark: SparkSession, x: np.ndarray) -> tuple[int, float]:
    """True links, and the share of them that is found."""
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}))
    got = {r["vec_id"]: r["n_links"] for r in pivots.near_duplicates(df).collect()}
    want = true_links(x.astype(np.float64))
    found = np.array([got[i] for i in range(len(x))])
    assert (found <= want).all()
    return int(want.sum()), float(found.sum() / max(1, want.sum()))


def true_pairs(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int, float]]:
    """Pairs of that Jaccard similarity or more, by lists of who holds a shingle."""
    holds: dict[int, list[int]] = defaultdict(list)
    out = []
    for k, x in enumerate(sets):
        met = [i for h in x.tolist() for i in holds[h]]
        if met:
            who, both = np.unique(met, return_counts=True)
            for i, n in zip(who.tolist(), both.tolist(), strict=True):
                if (j := n / (len(x) + len(sets[i]) - n)) >= similarity:
                    out.append((i, k, j))
        for h in x.tolist():
            holds[h].append(k)
    return out


def of_documents(spark: SparkSession, sf_dir: str, similarity: float = 0.8) -> dict[str, tuple[int, float]]:
    """Pairs of different shingle sets by similarity, and the share of them that is in one group."""
    table = ds.dataset(f"{sf_dir}/documents.parquet").to_table(["doc_id", "text"]).to_pylist()
    by_set: dict[bytes, int] = {}
    for r in table:
        by_set.setdefault(simhash.shingles(r["text"], 5).tobytes(), r["doc_id"])
    ids, sets = list(by_set.values()), [np.frombuffer(k, np.uint64) for k in by_set]
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    root = {r["doc_id"]: r["component_id"] for r in simhash.near_groups(docs, similarity=similarity).collect()}
    out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for a, b, j in true_pairs(sets, similarity):
        band = out["0.80 to 0.85" if j < 0.85 else "0.85 and more"]
        band[0] += 1
        band[1] += root[ids[a]] == root[ids[b]]
    return {k: (n, found / n) for k, (n, found) in sorted(out.items())}


def main() -> None:
    sf_dir, rows = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 20_000
    spark = SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]").config("spark.sql.shuffle.partitions", "16").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ship(spark)
    x = np.stack(ds.dataset(f"{sf_dir}/embeddings.parquet").to_table(["embedding"]).column(0).to_numpy())
    print("vectors of the table:", len(x), "rows,", of_vectors(spark, x))
    print("a third in one cluster:", rows, "rows,", of_vectors(spark, dense(rows)))
    print("documents:", of_documents(spark, sf_dir))


if __name__ == "__main__":
    main()
