"""Components after edits against a full run, and the median by narrowing."""

import random
import statistics

import pytest

from echotrace.operators import components, governance
from echotrace.session import temporary


@pytest.mark.parametrize("seed", [1, 2])
def test_edited_components_equal_a_full_run(spark, seed, monkeypatch):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(180)})
    gone = rng.sample(edges, 12)
    new = [tuple(rng.sample(range(320), 2)) for _ in range(6)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    with temporary(spark):
        old = components.connected_components(frame(edges), "a", "b")
        want = components.connected_components(frame([e for e in edges if e not in gone] + new), "a", "b")
        taken = []
        real = components.connected_components
        monkeypatch.setattr(components, "connected_components", lambda e, *a: (taken.append(e.count()), real(e, *a))[1])
        found = components.edited(old, frame(edges), frame([(b, a) for a, b in gone]), frame(new), "a", "b")
        assert {tuple(r) for r in found.collect()} == {tuple(r) for r in want.collect()}
        where = {r.node: r.component for r in old.collect()}
        hit = {where[a] for a, _ in gone}
        assert taken[0] == sum(1 for a, b in edges if where[a] in hit and (a, b) not in gone)  # no edge of another component
        nothing = components.edited(old, frame(edges), frame([]), frame([]), "a", "b")
        assert {tuple(r) for r in nothing.collect()} == {tuple(r) for r in old.collect()}


@pytest.mark.parametrize("values", [
    [], [3.5], [1.0, 2.0], [7.0] * 50, [0.0, 1e-300, 5e-324, 1.0], [float(i % 13) for i in range(999)], [random.Random(1).gauss(0, 1e9) for _ in range(1500)], [-1e308, 1e308, 0.0, 2.0], [None, float("nan"), 4.0, float("inf")],
])
def test_exact_median(spark, monkeypatch, values):
    monkeypatch.setattr(governance, "AT_HAND", 5)
    monkeypatch.setattr(governance, "BINS", 7)
    finite = [v for v in values if v is not None and abs(v) < float("inf")]
    found = governance.exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    assert found == (statistics.median(finite) if finite else None)
