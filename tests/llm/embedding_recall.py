"""Recall of op5's tables against brute force, at the widths of larger inputs: python tests/llm/embedding_recall.py SF_DIR

Queries are the vectors whose id is divisible by 100, each against all vectors of its label.
Besides, every query gets PLANTED partners at exactly the threshold, half of them turned towards
other vectors of the table and half in any direction.  A link counts as found where any table
agrees (the rerank is exact).
"""

from __future__ import annotations

import os
import sys

import numpy as np
import pyarrow.dataset as ds

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pingscape.llm import embeddings  # noqa: E402


PLANTED = 20


def at_threshold(x: np.ndarray, queries: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """PLANTED unit vectors per query at the threshold's cosine (queries x PLANTED x dimensions)."""
    q = x[queries][:, None, :]
    to = np.concatenate([x[rng.integers(len(x), size=(len(queries), PLANTED // 2))], rng.standard_normal((len(queries), PLANTED - PLANTED // 2, x.shape[1]))], axis=1)
    side = to - (to * q).sum(axis=2, keepdims=True) * q
    length = np.linalg.norm(side, axis=2, keepdims=True)
    side = np.where(length > 1e-6, side / np.maximum(length, 1e-6), 0.0)
    return embeddings.THRESHOLD * q + np.sqrt(1 - embeddings.THRESHOLD**2) * side


def main(sf_dir: str) -> None:
    t = ds.dataset(f"{sf_dir}/embeddings.parquet").to_table(columns=["vec_id", "embedding", "label"]).drop_null().combine_chunks()
    sizes, by = embeddings._vectors(t["embedding"].chunk(0))
    d = max(by, key=lambda k: len(by[k][0]))
    rows, x = by[d]
    ids, label = t["vec_id"].to_numpy()[rows], t["label"].to_numpy(zero_copy_only=False)[rows]
    sample = x[np.random.default_rng(1).permutation(len(x))[: embeddings.SAMPLE_ROWS]]
    links = []
    for i in np.flatnonzero(ids % 100 == 0).tolist():
        same = np.flatnonzero(label == label[i])
        other = same[x[same] @ x[i] >= embeddings.THRESHOLD]
        other = other[(x[other] != x[i]).any(axis=1)]  # equal vectors are one class and need no table
        links.append(np.stack([np.full(len(other), i), other]))
    a, b = np.concatenate(links, axis=1)
    queries = np.flatnonzero(ids % 100 == 0)
    partners = at_threshold(x, queries, np.random.default_rng(2))
    print(f"{sf_dir}: {len(x)} vectors of {d}, {len(queries)} queries, {len(a)} links, {len(queries) * PLANTED} planted at the threshold")
    for n in (10**3, 10**6, 10**7, 10**8, 10**9):
        bits, tables = embeddings.table_layout(n, embeddings.THRESHOLD, embeddings.TARGET_RECALL)
        projection = embeddings.fit_rotations(sample, bits * tables)
        chunks = embeddings._chunks(x @ projection >= 0, bits, tables)
        hits = sum(int((chunks[i] == chunks[j]).any(axis=1).sum()) for i, j in zip(np.array_split(a, 64), np.array_split(b, 64), strict=True))
        near = [(embeddings._chunks(p @ projection >= 0, bits, tables) == chunks[i]).any(axis=1).mean() for i, p in zip(queries, partners, strict=True)]
        print(f"rows per label {n:.0e}: {bits} bits, {tables} tables, found {hits} of {len(a)} links, recall at the threshold {np.mean(near):.4f}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1])
