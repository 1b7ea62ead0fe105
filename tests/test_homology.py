import time
from itertools import combinations

import numpy as np
import pytest

from cortigraph.operators import graph


def by_boundaries(i, j, d):
    """Bars from the boundary matrix of all edges and triangles, column by column."""
    order = np.lexsort((j, i, d))
    edges = [(int(i[k]), int(j[k])) for k in order]
    d, place = d[order], {e: k for k, e in enumerate(edges)}
    nodes = sorted({n for e in edges for n in e})
    triangles = [sorted(place[e] for e in combinations(t, 2)) for t in combinations(nodes, 3) if all(e in place for e in combinations(t, 2))]
    out, cycles = [], []
    for columns, dim in (([sorted(map(nodes.index, e)) for e in edges], 0), (sorted(triangles, key=lambda t: t[2]), 1)):
        low = {}
        for k, column in enumerate(columns):
            column = set(column)
            while column and max(column) in low:
                column ^= low[max(column)]
            if column:
                low[max(column)] = column
                out.append((0, 0.0, d[k]) if dim == 0 else (1, d[max(column)], d[columns[k][2]]))
            elif dim == 0:
                cycles.append(k)
    return out + [(1, d[k], np.inf) for k in cycles if k not in low]


@pytest.mark.parametrize("seed", range(24))
def test_bars_like_the_boundary_matrix(seed):
    """Points, random lengths and equal lengths; sparse to complete."""
    rng = np.random.default_rng(seed)
    n = 4 + seed // 2
    i, j = np.triu_indices(n, 1)
    kept = rng.random(len(i)) < (0.3, 0.6, 1.0)[seed % 3]
    i, j = i[kept], j[kept]
    x = rng.normal(size=(n, 3))
    d = (np.linalg.norm(x[i] - x[j], axis=1), rng.random(len(i)), rng.random(len(i)).round(1), 1.0 + rng.random(len(i)) * 0)[seed % 4]
    assert sorted(graph.rips_bars(i, j, d)) == sorted(by_boundaries(i, j, d))


def test_many_crossing_cycles_take_seconds():
    """Random vectors, as in embeddings: added up triangle by triangle, 40,000 edges of 900 nodes took 27 s."""
    c = np.corrcoef(np.random.default_rng(1).normal(size=(900, 64)))
    i, j = np.triu_indices(900, 1)
    top = np.argsort(-c[i, j])[:40_000]
    began = time.process_time()
    bars = graph.rips_bars(i[top], j[top], 1 - c[i, j][top])
    assert len(bars) == 40_000 and sum(b[0] == 0 for b in bars) == 899 and time.process_time() - began < 10
