"""The transport plan against successive shortest paths on small networks."""

import random

import pytest

from binflow.plans import transport

EDGES = "donor_id bigint, receiver_id bigint, distance_km double, score double"


def best_total(edges, supply, demand):
    """The greatest total benefit, by augmenting along the best path while that gains."""
    cap, gain = {}, {}

    def arc(u, v, c, g):
        cap[u, v], gain[u, v] = c, g
        cap.setdefault((v, u), 0)
        gain[v, u] = -g

    for d, n in supply.items():
        arc("s", ("d", d), n, 0.0)
    for r, n in demand.items():
        arc(("r", r), "t", n, 0.0)
    for d, r, km, score in edges:
        if d in supply and r in demand:
            arc(("d", d), ("r", r), 10**9, transport.URGENCY * score - km)
    total = 0.0
    while True:
        best, back = {"s": 0.0}, {}
        for _ in range(len(supply) + len(demand) + 2):
            moved = False
            for (u, v), c in cap.items():
                if c and u in best and best[u] + gain[u, v] > best.get(v, -1e18) + 1e-9:
                    best[v], back[v], moved = best[u] + gain[u, v], u, True
            if not moved:
                break
        if best.get("t", 0.0) <= 1e-9:
            return total
        v = "t"
        while v != "s":
            cap[back[v], v] -= 1
            cap[v, back[v]] += 1
            v = back[v]
        total += best["t"]


def network(rng, donors, receivers, degree):
    supply = {i: rng.randint(1, 4) for i in range(donors)}
    demand = {100 + j: rng.randint(1, 4) for j in range(receivers)}
    scores = {r: rng.choice([0.65, 0.7, 0.9, round(rng.uniform(0.65, 1), 4)]) for r in demand}
    edges = [(d, r, round(rng.uniform(0, 1), rng.choice([1, 6])), scores[r]) for r in demand for d in rng.sample(sorted(supply), min(donors, rng.randint(0, degree)))]
    return edges, supply, demand


def planned(spark, edges, supply, demand, **more):
    frames = (spark.createDataFrame(edges, EDGES), spark.createDataFrame(list(supply.items()), "donor_id bigint, supply bigint"), spark.createDataFrame(list(demand.items()), "receiver_id bigint, demand bigint"))
    rows = transport.transport_plan(*frames, **more).collect()
    for side, bound in (("donor_id", supply), ("receiver_id", demand)):
        used = {}
        for r in rows:
            used[r[side]] = used.get(r[side], 0) + r.amount
        assert all(n <= bound[k] for k, n in used.items())
    assert {(r.donor_id, r.receiver_id) for r in rows} <= {e[:2] for e in edges} and all(r.amount > 0 for r in rows)
    return sum(r.amount * (transport.URGENCY * r.score - r.distance_km) for r in rows)


def test_settled_in_a_task():
    """Many networks, without Spark: the sum of each network's units against the best."""
    import numpy as np
    import pandas as pd

    rng = random.Random(2)
    for _ in range(60):
        edges, supply, demand = network(rng, rng.randint(1, 8), rng.randint(1, 8), 5)
        supply = {d: n for d, n in supply.items() if any(e[0] == d for e in edges)}
        demand = {r: n for r, n in demand.items() if any(e[1] == r for e in edges)}
        if not edges:
            continue
        rows = []
        for d, r, km, score in edges:
            rows += [(2 * r + 1, 2 * d, round(score * 1e9) - round(km * 1e6), demand[r]), (2 * d, 2 * r + 1, 0, supply[d])]
        rows += [(2 * d, 2 * d, 0, n) for d, n in supply.items()] + [(2 * r + 1, 2 * r + 1, 0, n) for r, n in demand.items()]
        arcs = pd.DataFrame(rows, columns=["p", "o", "b", "n"])
        bidders = sum(supply.values()) + sum(demand.values())
        arcs["b"] *= bidders + 1
        nodes = [(2 * d, n) for d, n in supply.items()] + [(2 * r + 1, n) for r, n in demand.items()]
        units = pd.DataFrame({"o": np.repeat([o for o, _ in nodes], [n for _, n in nodes]), "price": 0, "p": -1})
        units["u"] = range(len(units))
        out = transport.settle(arcs, units, transport.bid_steps(int(arcs["b"].abs().max())))
        assert sorted(zip(out["p"], out["u"])) == sorted((o, u) for o, n in nodes for u in range(n))
        worth = {(2 * r + 1, 2 * d): transport.URGENCY * score - km for d, r, km, score in edges}
        assert sum(worth.get((p, o), 0.0) for p, o in zip(out["p"], out["o"])) == pytest.approx(best_total(edges, supply, demand), abs=1e-5)


def test_plan_is_optimal(spark):
    edges, supply, demand = network(random.Random(7), 14, 12, 4)
    assert planned(spark, edges, supply, demand) == pytest.approx(best_total(edges, supply, demand), abs=1e-5)


def test_plan_in_rounds(spark, monkeypatch):
    """A component that no task takes whole: tiles bid against each other. Tenths of kilometres keep the steps few."""
    monkeypatch.setattr(transport, "UNIT", 10)
    edges = [(1, 11, 0.3, 0.9), (1, 12, 0.1, 0.9), (2, 12, 0.7, 0.9), (2, 11, 0.2, 0.9)]
    supply, demand = {1: 1, 2: 1}, {11: 1, 12: 1}
    assert planned(spark, edges, supply, demand, arcs_per_task=4) == pytest.approx(best_total(edges, supply, demand), abs=1e-5)


def test_empty_networks(spark):
    assert planned(spark, [], {1: 2}, {2: 1}) == 0
    assert planned(spark, [(1, 2, 0.5, 0.9)], {1: 2}, {3: 1}) == 0
    assert planned(spark, [(1, 2, 0.5, 0.9)], {1: 2}, {2: 5}) == pytest.approx(2 * 899.5)
