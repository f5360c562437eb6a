"""Queries over whole tables: against brute force."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow.parquet as pq
import pytest
from driftline.plans import motion, registry

from .conftest import SF


def events():
    """(obs, e, n, course) of all events."""
    table = pq.read_table(f"{SF}/events.parquet", columns=["event_id", "value"])
    k, v = table["event_id"].to_numpy(), table["value"].to_numpy() * 10
    return k, v - 640 * np.floor(v / 640), k / 2, (k * 37 % 360).astype(float)


def test_all_orders_are_ways(spark):
    orders = set(pq.read_table(f"{SF}/lineitem.parquet", columns=["l_orderkey"])["l_orderkey"].to_pylist())
    got = registry.queries()["grf2_explicit_no_variant"](spark, SF)
    assert {r.way for r in got.collect()} == orders


def projected(arcs, e, n):
    """Distances of a point from all arcs."""
    ae, an, de, dn = (arcs[c].to_numpy() for c in ("start_e", "start_n", "end_e", "end_n"))
    de, dn = de - ae, dn - an
    f = np.clip(((e - ae) * de + (n - an) * dn) / (de * de + dn * dn), 0, 1)
    return np.hypot(e - ae - f * de, n - an - f * dn), f


def test_nearest_arcs_of_all_events(spark):
    obs, e, n, _ = events()
    arcs = motion.arcs(spark, SF).toPandas()
    want = {}
    for k in range(len(obs)):
        d = np.sort(projected(arcs, e[k], n[k])[0])[:8]
        want |= {(int(obs[k]), rank): pytest.approx(x, abs=1e-4) for rank, x in enumerate(d[d <= 100], 1)}
    got = registry.queries()["jon7_nearest_neighbours"](spark, SF).collect()
    assert {(r.obs, r["rank"]): r.distance for r in got} == want


def test_candidates_of_all_events_on_all_roads(spark):
    obs, e, n, course = events()
    arcs = motion.arcs(spark, SF).toPandas()
    want = {}
    for k in range(len(obs)):
        d, _ = projected(arcs, e[k], n[k])
        gap = np.abs((arcs["bearing"].to_numpy() - course[k] + 180) % 360 - 180)
        emission = -0.5 * (d / 12) ** 2 - np.log(12) - 0.5 * (gap / 35) ** 2
        want[int(obs[k])] = sorted(emission[d <= 36], reverse=True)[:12]
    got = {}
    for r in registry.queries()["jon6_spatial_candidates"](spark, SF).orderBy("obs", "rank").collect():
        got.setdefault(r.obs, []).append(r.emission)
    assert got.keys() == {k for k, v in want.items() if v}
    for k, found in got.items():
        assert found == pytest.approx(want[k], abs=2e-5)


def test_matching_and_routes_take_all_rows(spark):
    matched = {r.obs for r in motion.sta15_map_matching(spark, SF).select("obs").collect()}
    assert any(k % 10 for k in matched)


def shortest(arcs, limit):
    """Distances within ``limit`` from every node of the graph, by Dijkstra's algorithm."""
    ahead = {}
    for a, b, w in arcs[["start_node", "end_node", "length"]].itertuples(index=False):
        ahead.setdefault(a, {})[b] = min(w, ahead.get(a, {}).get(b, w))
    found = {}
    for source in pq.read_table(f"{SF}/part.parquet", columns=["p_partkey"])["p_partkey"].to_pylist():
        best, heap = {}, [(0.0, source)]
        while heap:
            d, node = heapq.heappop(heap)
            if node not in best:
                best[node] = d
                for b, w in ahead.get(node, {}).items():
                    if d + w <= limit:
                        heapq.heappush(heap, (d + w, b))
        found |= {(source, node): d for node, d in best.items()}
    return found


def test_distances_from_all_nodes(spark):
    arcs = motion.arcs(spark, SF).toPandas()
    got = {(r.source, r.node): r.distance for r in registry.queries()["grf4_bounded_distances"](spark, SF).collect()}
    assert got == {k: pytest.approx(d, abs=2e-5) for k, d in shortest(arcs, 150.0).items()}


def test_planned_routes_are_the_shortest_between_snaps(spark):
    arcs = motion.arcs(spark, SF).toPandas().sort_values(["way", "pos", "direction"]).reset_index(drop=True)
    far = shortest(arcs, 600.0)
    want = {}
    for ask in motion.route_asks(spark, SF).collect():
        ends = []
        for e, n in ((ask.e, ask.n), (ask.to_e, ask.to_n)):
            d, f = projected(arcs, e, n)
            order = sorted(np.flatnonzero(d <= 100), key=lambda j: (round(d[j], 9), j))[:8]
            ends.append([(j, d[j], f[j], arcs.loc[j]) for j in order])
        best = None
        for j, dj, fj, a in ends[0]:
            for k, dk, fk, b in ends[1]:
                middle = far.get((a.end_node, b.start_node))
                road = (fk - fj) * a.length if j == k and fk >= fj else None if middle is None else (1 - fj) * a.length + middle + fk * b.length
                if road is not None and dj + road + dk >= 20 and (best is None or dj + road + dk < best[0]):
                    # connectors of 2 m and parts of half a metre or less aren't told
                    best = dj + road + dk, dj + road + dk - (dj if dj <= 2 else 0) - (dk if dk <= 2 else 0)
        if best:
            want[ask.ask] = best[1]
    told = {}
    for r in motion.grf5_route_plan(spark, SF).collect():
        told[r.ask] = max(r.so_far, told.get(r.ask, 0.0))
    assert want and told == {k: pytest.approx(v, abs=1.1) for k, v in want.items()}


def test_connected_one_way_roads_are_followed(spark):
    """Two roads in a row, one way each: the way back isn't one."""
    from driftline.operators import roads

    form = "way long, pos int, direction int, start_node long, end_node long, start_e double, start_n double, end_e double, end_n double, length double, bearing double"
    arcs = spark.createDataFrame([(1, 1, 1, 1, 2, 0.0, 0.0, 300.0, 0.0, 300.0, 90.0), (2, 1, 1, 2, 3, 300.0, 0.0, 300.0, 300.0, 300.0, 0.0)], form)
    asks = spark.createDataFrame([(1, 5.0, 3.0, 303.0, 200.0), (2, 303.0, 200.0, 5.0, 3.0), (3, 5.0, 0.0, 8.0, 0.0), (4, 5.0, 0.0, 105.0, 0.0)], "ask long, e double, n double, to_e double, to_n double")
    got = {(r.ask, r.leg): (r.kind, round(r.length, 6), r.say) for r in roads.plan_routes(asks, arcs, ["way", "pos"]).collect()}
    # there is no way back, and 3 m are no route
    assert got == {(1, 1): ("off road", 3.0, "Start"), (1, 2): ("road", 295.0, "Turn left"), (1, 3): ("road", 200.0, "Turn left"), (1, 4): ("off road", 3.0, "Turn right"), (4, 1): ("road", 100.0, "Start")}


def test_positions_do_not_depend_on_the_ranges(spark):
    from driftline.operators.timeseries import positions

    rows = spark.range(1000).selectExpr("id", "(id * 7919) % 50 as t").repartition(7)
    got = {(r.t, r.id): r.pos for r in positions(rows, ["t", "id"]).collect()}
    assert got == {k: n for n, k in enumerate(sorted(got), 1)}


def test_full_reach(spark):
    queries = registry.queries()
    lags = {r["lag"] for r in queries["jon4_lag_sweep"](spark, SF).collect()}
    assert max(lags) > 5 and min(lags) < -5
    cells = queries["grf3_grid_index"](spark, SF).groupBy("way", "pos", "direction", "cx").count()
    assert cells.where("count > 1").count()


def test_no_query_takes_a_part_of_its_table():
    for sql in registry.oracle_sql().values():
        assert "l_orderkey % 20" not in sql and "event_id % 10 = 0)" not in sql and "drive < 10" not in sql


def test_interpolation_of_a_long_series_is_linear_in_its_length(spark):
    import time

    from driftline.operators import timeseries

    def seconds(n):
        left = spark.range(n).selectExpr("1 as k", "id * 1.0 + 0.5 as t")
        right = spark.range(n).selectExpr("1 as k", "id * 1.0 as t", "id * 2.0 as v")
        start = time.perf_counter()
        assert timeseries.interpolate(left, right, "v", ["k"]).where("abs(interpolated - 2 * t) > 1e-9").count() == 0
        return time.perf_counter() - start

    seconds(1_000)
    assert seconds(100_000) < 30  # frames to the end of the series take hours
