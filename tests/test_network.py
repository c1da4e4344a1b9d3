"""Networks: a hand-made 5 x 5 grid, random forests and cycles against brute force."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from hydroloom.operators import gridops, network

# 5 x 5 direction codes: two pits (5), a cycle of three cells, flow over every edge, a missing cell (0).
CODES = [
    [6, 2, 8, 5, 4],
    [4, 2, 0, 8, 7],
    [6, 2, 4, 3, 1],
    [8, 5, 4, 7, 6],
    [9, 8, 2, 4, 4],
]


def _codes(spark, codes=CODES):
    cols = len(codes[0])
    data = [(r * cols + c, r, c, codes[r][c]) for r in range(len(codes)) for c in range(cols)]
    return spark.createDataFrame(data, "cell_id long, row int, col int, code int")


STEP = {7: (-1, -1), 8: (-1, 0), 9: (-1, 1), 4: (0, -1), 6: (0, 1), 1: (1, -1), 2: (1, 0), 3: (1, 1)}


def _brute_edges(codes):
    n, m = len(codes), len(codes[0])
    out = {}
    for r in range(n):
        for c in range(m):
            down = None
            if codes[r][c] in STEP:
                y, x = r + STEP[codes[r][c]][0], c + STEP[codes[r][c]][1]
                if 0 <= y < n and 0 <= x < m and 1 <= codes[y][x] <= 9:
                    down = y * m + x
            out[r * m + c] = down
    return out


def _brute_repair(edges):
    """Walk from each cell in order; a walk that meets itself cuts its last new cell."""
    out, seen = dict(edges), set()
    for start in sorted(edges):
        path, at = [], start
        while at is not None and at not in seen:
            seen.add(at)
            path.append(at)
            at = out[at]
        if at is not None and at in path:
            out[path[-1]] = None
    return out


def test_edges_of_codes(spark):
    got = dict(rows(network.ldd_edges(_codes(spark))))
    assert got == _brute_edges(CODES)


def test_repair_cuts_each_cycle_once(spark):
    rng = random.Random(3)
    grids = [CODES] + [[[rng.randint(0, 9) for _ in range(9)] for _ in range(7)] for _ in range(3)]
    for codes in grids:
        edges = _brute_edges(codes)
        got = {r[0]: r[1] for r in rows(network.ldd_repair(network.ldd_edges(_codes(spark, codes))))}
        assert got == _brute_repair(edges)


def test_repair_of_long_tail_into_cycle(spark):
    # A tail of 40 cells leads into a cycle of 5; the first walk enters at its end.
    edges = [(i, i + 1) for i in range(44)] + [(44, 40)]
    df = spark.createDataFrame(edges, "cell_id long, down_id long")
    got = {r[0]: r[1] for r in rows(network.ldd_repair(df))}
    assert got == _brute_repair(dict(edges))


def _forest(rng, n, pits=3):
    order = list(range(n))
    rng.shuffle(order)
    return {c: None if i < pits else order[rng.randrange(i)] for i, c in enumerate(order)}


def _path(edges, c):
    while c is not None:
        yield c
        c = edges[c]


def test_random_forests(spark):
    rng = random.Random(11)
    edges = _forest(rng, 120)
    weights = {c: float(rng.randint(1, 9)) for c in edges}
    gauges = {g: c for g, c in enumerate(rng.sample(sorted(edges), 9), start=1)}
    ldd = spark.createDataFrame(list(edges.items()), "cell_id long, down_id long")
    w = spark.createDataFrame(list(weights.items()), "cell_id long, w double")
    gauge = spark.createDataFrame(list(gauges.items()), "gauge_id long, cell_id long")

    total = {c: 0.0 for c in edges}
    for c in edges:
        for p in _path(edges, c):
            total[p] += weights[c]
    assert dict(rows(network.upstream_accumulate(ldd, w, ["w"]))) == total
    # The weights of all cells arrive at the pits.
    assert sum(total[c] for c in edges if edges[c] is None) == sum(weights.values())

    at = {c: g for g, c in gauges.items()}
    on_path = {c: [at[p] for p in _path(edges, c) if p in at] for c in edges}
    nearest = network.subcatchment(ldd, gauge)
    assert dict(rows(nearest)) == {c: g[0] for c, g in on_path.items() if g}
    tree = network.gauge_tree(ldd, gauge, nearest)
    closure = network.gauge_closure(tree)
    assert rows(network.gauge_membership(nearest, closure, gauge)) == sorted((c, g) for c, gs in on_path.items() for g in gs)
    assert dict(rows(network.catchment(nearest, tree))) == {c: g[-1] for c, g in on_path.items() if g}
    depth = dict(rows(network.sampling_frequency(ldd, nearest, tree, gauge)))
    assert depth == {c: len(g) for c, g in on_path.items()}
    # A direct inflow lies one level deeper than the gauge it feeds.
    for g, inflow in rows(network.direct_links(tree, gauge)):
        assert depth[gauges[inflow]] == depth[gauges[g]] + 1


def test_buffer_zone(spark):
    codes = [(r * 4 + c, r, c, 7 if (r, c) == (1, 1) else 3 if (r, c) == (1, 3) else 0) for r in range(3) for c in range(4)]
    df = spark.createDataFrame(codes, "cell_id long, row int, col int, body int")
    got = {(r, c): b for _, r, c, b in rows(network.buffer_zone(df, 3))}
    assert got[(1, 1)] == 7 and got[(1, 3)] == 3 and got[(1, 2)] == 3 and got[(0, 0)] == 7 and got[(2, 3)] == 3


def test_inlets_avoid_each_other(spark):
    # Three inflows drain through the same cells 10 -> 11 -> 12 -> 13 into gauge 1.
    ldd = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (10, 11), (11, 12), (12, 13), (13, None)], "cell_id long, down_id long")
    gauge = spark.createDataFrame([(1, 13), (5, 1), (6, 2), (7, 3)], "gauge_id long, cell_id long")
    links = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], "gauge_id long, inflow_id long")
    got = {r[1]: r[3] for r in rows(network.distinct_inlet_cells(ldd, links, gauge))}
    assert got == {5: 10, 6: 11, 7: 12}


def test_clip_turns_outflow_into_pits(spark):
    got = {r[0]: r[3] for r in rows(gridops.clip_ldd_edges(_codes(spark), 5, 5))}
    assert got[2] == 5 and got[14] == 1 and got[22] == 5 and got[19] == 5 and got[5] == 5 and got[7] == 0


def test_hot_outlet(spark):
    """A star: every cell drains into one outlet."""
    n = 5000
    ldd = spark.range(n).select(F.col("id").alias("cell_id"), F.when(F.col("id") > 0, 0).cast("long").alias("down_id"))
    w = ldd.select("cell_id", F.lit(1.0).alias("w"))
    assert network.upstream_accumulate(ldd, w, ["w"]).filter("cell_id = 0").first()["w"] == n
    assert network.root_of(ldd).filter("root_id = 0").count() == n


def test_cycles_are_noticed(spark):
    ldd = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, None)], "cell_id long, down_id long")
    assert dict(rows(network.root_of(ldd).select("cell_id", "root_id"))) == {1: None, 2: None, 3: None, 4: None, 5: 6, 6: 6}
    with pytest.raises(ValueError, match="cycle"):
        network.upstream_accumulate(ldd, ldd.select("cell_id", F.lit(1.0).alias("w")), ["w"])


def test_gauges_on_one_cell_share_their_basin(spark):
    ldd = spark.createDataFrame([(c, c - 1 if c else None) for c in range(60)], "cell_id long, down_id long")
    gauge = spark.createDataFrame([(1, 40), (2, 40), (3, 5)], "gauge_id long, cell_id long")
    nearest = network.subcatchment(ldd, gauge)
    tree = network.gauge_tree(ldd, gauge, nearest)
    assert rows(network.catchment_area_cells(nearest, tree, gauge)) == [(1, 20), (2, 20), (3, 55)]
    assert rows(network.direct_links(tree, gauge)) == [(3, 1), (3, 2)]
    depth = dict(rows(network.sampling_frequency(ldd, nearest, tree, gauge)))
    assert (depth[50], depth[20], depth[3]) == (3, 1, 0)
    members = rows(network.gauge_membership(nearest, network.gauge_closure(tree), gauge))
    assert members == sorted([(c, g) for c in range(40, 60) for g in (1, 2)] + [(c, 3) for c in range(5, 60)])


def test_a_long_chain_of_gauges_is_folded_by_doubling(spark, monkeypatch):
    n = 2000
    tree = spark.createDataFrame([(g, g - 1 if g else None) for g in range(n)], "gauge_id long, parent_id long")
    written = []
    cut = network.cut_lineage

    def counted(df, label, instead_of=None):
        table = cut(df, label, instead_of)
        written.append(table.count())
        return table

    monkeypatch.setattr(network, "cut_lineage", counted)
    values = tree.selectExpr("gauge_id", "1 as n", "gauge_id as low", "gauge_id as high")
    got = rows(network.down_tree(tree, values, {"n": "sum", "low": "min", "high": "max"}))
    assert got == [(g, n - g, g, n - 1) for g in range(n)]
    assert sum(written) <= 2 * n * 13


def test_fifteen_inflows_on_one_cell(spark):
    ldd = spark.createDataFrame([(c, c - 1 if c else None) for c in range(13)], "cell_id long, down_id long")
    gauge = spark.createDataFrame([(i, 12) for i in range(1, 16)], "gauge_id long, cell_id long")
    links = spark.createDataFrame([(99, i) for i in range(1, 16)], "gauge_id long, inflow_id long")
    want = [(99, i, min(i, 12), 12 - i if i <= 12 else None) for i in range(1, 16)]
    assert rows(network.distinct_inlet_cells(ldd, links, gauge), "inflow_id") == want


def test_a_hot_cycle_is_cut(spark):
    # 100,000 cells lead straight into the cycle 1 <-> 2; the smallest of all, 1, is on it.
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
    try:
        ids = spark.range(3, 100_000).selectExpr("id as cell_id", "id % 2 + 1 as down_id")
        ring = spark.createDataFrame([(1, 2), (2, 1)], "cell_id long, down_id long")
        cut = network.ldd_repair(ids.unionByName(ring)).filter("cut")
        assert rows(cut) == [(2, None, True)]
    finally:
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def _served(down, links, at):
    """Inlet cells by serving the inflows of each gauge one by one in the order of their ids."""
    found, taken = [], set()
    for g, i in sorted(links):
        cell, step = down.get(at[i]), 1
        while cell is not None and (g, cell) in taken:
            cell, step = down.get(cell), step + 1
        taken.add((g, cell))
        found.append((g, i, step if cell is not None else step - 1, cell))
    return sorted(found, key=lambda r: r[1])


def test_inlets_like_one_by_one(spark):
    draw = random.Random(5)
    down = {c: draw.randint(max(0, c - 4), c - 1) if c else None for c in range(120)}
    at = {i: draw.choice([draw.randint(0, 119), 90, 100]) for i in range(70)}
    links = [(i % 2, i) for i in at]
    got = network.distinct_inlet_cells(
        spark.createDataFrame(list(down.items()), "cell_id long, down_id long"), spark.createDataFrame(links, "gauge_id long, inflow_id long"),
        spark.createDataFrame(list(at.items()), "gauge_id long, cell_id long"),
    )
    assert rows(got, "inflow_id") == _served(down, links, at)


def test_ten_thousand_inlets_from_one_cell(spark, monkeypatch):
    written = []
    cut = network.cut_lineage
    monkeypatch.setattr(network, "cut_lineage", lambda df, label, *old: written.append(label) or cut(df, label, *old))
    n = 10_000
    ldd = spark.range(n + 1).select(F.col("id").alias("cell_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("down_id"))
    inflow = spark.range(n).select(F.lit(7).cast("long").alias("gauge_id"), F.col("id").alias("inflow_id"))
    at = spark.range(n).select(F.col("id").alias("gauge_id"), F.lit(n).cast("long").alias("cell_id"))
    got = network.distinct_inlet_cells(ldd, inflow, at)
    assert got.filter(f"cell_id = {n} - 1 - inflow_id and step = inflow_id + 1").count() == n
    assert written.count("inlet") == 4 and written.count("down-power") == 13


def test_inlets_in_a_cycle_end(spark):
    ldd = spark.createDataFrame([(1, 2), (2, 1)], "cell_id long, down_id long")
    links = spark.createDataFrame([(9, i) for i in range(4)], "gauge_id long, inflow_id long")
    with pytest.raises(ValueError, match="cycle"):
        network.distinct_inlet_cells(ldd, links, spark.createDataFrame([(i, 1) for i in range(4)], "gauge_id long, cell_id long"))


def test_basins_are_ranges_of_the_tour(spark):
    draw = random.Random(3)
    up = {g: draw.choice([None, *range(max(0, g - 6), g)]) if g else None for g in range(60)}
    tree = spark.createDataFrame(list(up.items()), "gauge_id long, parent_id long")
    tour = {g: (a, b) for g, a, b in network.gauge_intervals(tree).collect()}
    assert sorted(a for a, _ in tour.values()) == list(range(60))
    below = set()
    for g in up:
        at = g
        while at is not None:
            below.add((g, at))
            at = up[at]
    assert {(g, h) for g in up for h in up if tour[h][0] <= tour[g][0] <= tour[h][1]} == below
    assert rows(network.gauge_closure(tree)) == sorted(below)


def test_a_long_chain_of_gauges_stays_linear(spark, monkeypatch):
    n = 2000
    written = []
    cut = network.cut_lineage

    def counted(df, *rest):
        table = cut(df, *rest)
        written.append(table.count())
        return table

    monkeypatch.setattr(network, "cut_lineage", counted)
    chain = spark.range(n).select(F.col("id").alias("gauge_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    pairs = network.gauge_closure(chain)
    assert max(written) <= n
    assert pairs.filter("below_id = 1500").count() == 500 and pairs.count() == n * (n + 1) // 2


def test_inlet_cells_are_found_without_sending_cells_around(spark, monkeypatch):
    """Tables of ordered cells are small files; none of them is broadcast."""
    seen = []
    real = network.cut_lineage

    def watched(df, label, *more):
        if label == "inlet":
            seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, label, *more)

    monkeypatch.setattr(network, "cut_lineage", watched)
    chain = spark.range(100).select(F.col("id").alias("cell_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("down_id"))
    links = spark.range(70, 74).select(F.lit(1).cast("long").alias("gauge_id"), F.col("id").alias("inflow_id"))
    gauge = spark.range(70, 74).select(F.col("id").alias("gauge_id"), F.lit(50).cast("long").alias("cell_id"))
    got = rows(network.distinct_inlet_cells(chain, links, gauge))
    assert got == [(1, 70, 1, 49), (1, 71, 2, 48), (1, 72, 3, 47), (1, 73, 4, 46)]
    joins = [p for p in seen if "_from" in p or "start_id" in p and "Join" in p]
    assert joins and not any("BroadcastHashJoin" in p and "_k_" not in p for p in joins)


def test_sums_down_a_tree_are_dealt_by_their_rows(spark, monkeypatch):
    from hydroloom.operators import keyed

    seen = []
    monkeypatch.setattr(keyed, "TASK_ROWS", 10)
    real = network._cut_and_count
    monkeypatch.setattr(network, "_cut_and_count", lambda df, label, *more: seen.append((label, df)) or real(df, label, *more))
    tree = spark.range(5).select(F.col("id").alias("gauge_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    values = spark.range(100).select((F.col("id") % 5).alias("gauge_id"), F.expr("id div 5").alias("day"), F.lit(1.0).alias("value"))
    got = network.down_tree(tree, values, {"value": "sum"}, ["day"])
    assert rows(got.groupBy("gauge_id").agg(F.sum("value"))) == [(0, 100.0), (1, 80.0), (2, 60.0), (3, 40.0), (4, 20.0)]
    rounds = [df for label, df in seen if label == "tree-values"][1:]
    assert rounds and all("REPARTITION_BY_NUM, [plan_id" in p and ", 20), REPARTITION" in p for p in (df._jdf.queryExecution().executedPlan().toString() for df in rounds))


def test_sums_down_a_tree_stay_with_their_keys(spark, monkeypatch):
    """Keys with few rows each: values are written once, not once a round, and no round shuffles them."""
    labels = []
    real = network._cut_and_count
    monkeypatch.setattr(network, "_cut_and_count", lambda df, label, *more: labels.append(label) or real(df, label, *more))
    parent = {g: None if g == 0 else g - 1 if g < 40 else g - 17 for g in range(60)}
    tree = spark.createDataFrame(list(parent.items()), "gauge_id long, parent_id long")
    data = [(g, day, float(g * 7 % 11)) for g in range(0, 60, 3) for day in (None, 1, 2) if (g + (day or 0)) % 4]
    data += [(5, 1, 2.0), (5, 1, None), (77, 2, 3.0)]
    got = network.down_tree(tree, spark.createDataFrame(data, "gauge_id long, day int, value double"), {"value": "sum"}, ["day"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and "ENSURE_REQUIREMENTS" not in plan
    want = {}
    for g, day, value in data:
        while g is not None:
            want[g, day] = want.get((g, day), 0.0) + (value or 0.0)
            g = parent.get(g)
    assert sorted(rows(got), key=str) == sorted(((g, day, value) for (g, day), value in want.items()), key=str)
    assert labels.count("tree-values") == 1


def test_a_gauge_that_comes_twice_gives_its_values_twice(spark):
    tree = spark.createDataFrame([(0, None), (1, 0), (1, 0), (2, 1)], "gauge_id long, parent_id long")
    values = spark.createDataFrame([(g, 1, 1.0) for g in range(3)], "gauge_id long, day int, value double")
    assert rows(network.down_tree(tree, values, {"value": "sum"}, ["day"])) == [(0, 1, 5.0), (1, 1, 2.0), (2, 1, 1.0)]
