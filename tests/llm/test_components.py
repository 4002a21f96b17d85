"""Component search against a plain search over the same edges."""

from __future__ import annotations

import numpy as np
import pytest

from medialoom.llm.components import connected_components


def brute(edges: list[tuple[int | None, int | None]]) -> dict[int, int]:
    name: dict[int, int] = {}
    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        old = {name.setdefault(a, a), name.setdefault(b, b)}
        name |= {x: min(old) for x, c in name.items() if c in old}
    return name


RNG = np.random.default_rng(5)
GRAPHS = {
    "empty": [],
    "nulls and loops": [(None, 1), (2, None), (3, 3), (5, 4), (4, 5), (5, 4)],
    "stars": [(i, i % 3) for i in range(3, 60)],
    "chain": [(i, i + 1) for i in range(40)],
    "zigzag": [(i % 2 * 100 + i, (i + 1) % 2 * 100 + i + 1) for i in range(30)],
    "random": [tuple(map(int, RNG.integers(0, 120, 2))) for _ in range(90)],
}


@pytest.mark.parametrize("graph", GRAPHS)
def test_components(spark, graph):
    edges = GRAPHS[graph]
    found = connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()
    assert len(found) == len({r["id"] for r in found})
    assert {r["id"]: r["component"] for r in found} == brute(edges)
