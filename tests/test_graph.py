import itertools
import random

from netmine.functions import space
from netmine.operators import clusters, explore, graph, search
from netmine.session import saved


def brute(cells, edges, ports, max_cells=8, max_depth=3):
    loads = {c: {l for d, l in edges if d == c} for c in cells}
    drivers = {c: {d for d, l in edges if l == c} for c in cells}
    out = set()
    for root in cells:
        seen, todo = {frozenset([root])}, [frozenset([root])]
        while todo:
            s = todo.pop()

            def depth(c, s=s):
                return 1 if c == root else 1 + max(depth(x) for x in loads[c] if x in s)

            n_in = len({d for c in s for d in drivers[c]} - s) + sum(ports[c] for c in s)
            if 2 <= len(s) <= max_cells and 2 <= n_in <= 4 and max(map(depth, s)) >= 2:
                out.add((root, tuple(sorted(s))))
            if len(s) == max_cells:
                continue
            for p in {d for c in s for d in drivers[c]} - s:
                t = s | {p}
                if loads[p] <= s and 1 + max(depth(x) for x in loads[p]) <= max_depth and t not in seen:
                    seen.add(t)
                    todo.append(t)
    return out


def test_expand_against_search(spark):
    rng = random.Random(3)
    cells = list(range(1, 31))
    edges = {(a, b) for b, a in itertools.combinations(cells, 2) if rng.random() < 0.06}
    ports = {c: rng.randint(0, 2) for c in cells}
    c = spark.createDataFrame([(x, ports[x]) for x in cells], "id long, n_ports int")
    e = spark.createDataFrame([(a, b, "A") for a, b in edges], "driver long, load long, term string")
    found, verdicts = graph.expand(c, e, saved)
    assert {(r.root, tuple(r.cells)) for r in found.collect()} == brute(cells, edges, ports)
    assert verdicts.where("verdict = 'include'").count() == found.count()


def test_buffers_collapse_through_chains(spark):
    cells = spark.createDataFrame([(i, i in (2, 3, 4)) for i in range(1, 7)], "id long, is_buffer boolean")
    edges = spark.createDataFrame([(1, 2, "A"), (2, 3, "A"), (3, 4, "A"), (4, 5, "A"), (1, 6, "A")], "driver long, load long, term string")
    got = {(r.driver, r.load) for r in graph.collapse_buffers(cells, edges, saved).collect()}
    assert got == {(1, 5), (1, 6)}


def test_least_cost_and_roll_up_against_loops(spark):
    rng = random.Random(8)
    rel = list({(f"k{rng.randrange(12)}", f"r{rng.randrange(5)}"): None for _ in range(40)})
    rel = [(p, r, rng.randrange(3), rng.randrange(2)) for p, r in rel for _ in range(rng.randint(1, 2))]
    counts = {f"k{i}": rng.randint(1, 50) for i in range(15)}
    best = {p: min(i + o for q, _, i, o in rel if q == p) for p, *_ in rel}
    want = {(p, r): min((i, o) for q, t, i, o in rel if (q, t) == (p, r) and i + o == best[p]) for p, r, i, o in rel if i + o == best[p]}
    df = spark.createDataFrame(rel, "p_key string, np_key string, ei int, eo int")
    assert {(r.p_key, r.np_key): (r.ei, r.eo) for r in clusters.least_cost(df).collect()} == want
    sums = {}
    for p, n in counts.items():
        for r in {r for q, r in want if q == p} or {p}:
            sums[r] = sums.get(r, 0) + n
    rows = spark.createDataFrame(list(counts.items()), "p_key string, cnt long")
    assert {r.np_key: r.cnt for r in clusters.roll_up(rows, df).collect()} == sums


def test_components(spark):
    rows = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (5, 11), (7, 12), (8, 12), (9, 13)], "cluster long, cell long")
    got = {(r.cluster, r.component) for r in clusters.components(rows, saved).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (7, 7), (8, 7), (9, 9)}


def test_components_of_long_chains(spark):
    """Many rounds: plans must not grow with them."""
    rows = [(i, i) for i in range(300)] + [(i, i + 1) for i in range(300)]
    got = clusters.components(spark.createDataFrame(rows, "cluster long, cell long"), saved)
    assert {r.component for r in got.collect()} == {0}


def simulate(root, cells, gates, inputs):
    """Values of the root for all assignments, net by net."""
    out = ""
    for a in range(1 << len(inputs)):
        value = {x: a >> (len(inputs) - 1 - i) & 1 for i, x in enumerate(inputs)}

        def of(net):
            if net not in value:
                tt, nets = gates[net]
                row = 0
                for n in nets:
                    row = row * 2 + of(n)
                value[net] = int(tt[row])
            return value[net]

        out += str(of(root))
    return out


def test_evaluation_on_random_graphs(spark):
    """Ids in no order, gates of one to three inputs, against simulation."""
    rng = random.Random(9)
    ids = rng.sample(range(1, 1000), 40)
    gates, loads = {}, {i: 0 for i in ids}
    for k, i in enumerate(ids):
        n = rng.randint(1, 3)
        pool = [x for x in ids[:k] if loads[x] == 0] or [-1]
        nets = [rng.choice(pool) if rng.random() < 0.7 else -rng.randint(1, 8) for _ in range(n)]
        for x in nets:
            if x > 0:
                loads[x] += 1
        gates[i] = (f"{rng.randrange(1 << (1 << n)):0{1 << n}b}", nets)
    cells = spark.createDataFrame([(i, 0) for i in ids], "id long, n_ports int")
    edges = spark.createDataFrame([(d, i, f"A{k}") for i, (_, nets) in gates.items() for k, d in enumerate(nets)], "driver long, load long, term string")
    found, _ = graph.expand(cells, edges, saved, max_depth=4, min_inputs=1, max_inputs=5)
    table = spark.createDataFrame([(i, tt, nets) for i, (tt, nets) in gates.items()], "id long, tt string, nets array<long>")
    rows = graph.evaluate(found, table).collect()
    assert len(rows) > 15
    for r in rows:
        assert r.tt == simulate(r.root, r.cells, gates, r.inputs)


def test_evaluation_of_many_inputs(spark):
    """Trees of up to nine outside nets: tables of several words, against simulation."""
    rng = random.Random(4)
    gates = {1: ("0110100110010110", [2, 3, 4, -9]), 2: ("11101000", [-1, -2, -3]), 3: ("0111", [-4, 5]), 4: ("1001", [-7, -8]), 5: ("0001", [-5, -6]), 6: ("01", [-1])}
    gates |= {10 + i: (f"{rng.randrange(1 << (1 << n)):0{1 << n}b}", [-k for k in rng.sample(range(1, 12), n)]) for i, n in enumerate((5, 6, 7))}
    found = spark.createDataFrame([(1, [1, 2, 3, 4, 5], [1, 2, 2, 2, 3]), (6, [6], [1])] + [(10 + i, [10 + i], [1]) for i in range(3)], "root long, cells array<long>, depths array<int>")
    table = spark.createDataFrame([(i, tt, nets) for i, (tt, nets) in gates.items()], "id long, tt string, nets array<long>")
    rows = graph.evaluate(found, table).collect()
    assert {r.root: len(r.inputs) for r in rows} == {1: 9, 6: 1, 10: 5, 11: 6, 12: 7}
    for r in rows:
        assert r.tt == simulate(r.root, r.cells, gates, r.inputs)


def brute_search(cells, edges, place, b):
    loads = {c: {l for d, l in edges if d == c} for c in cells}
    drivers = {c: {d for d, l in edges if l == c} for c in cells}
    hop = lambda p, q: sum((x - y) ** 2 for x, y in zip(place[p], place[q])) ** 0.5
    out = {}
    for root in cells:
        todo, seen = [frozenset([root])], {frozenset([root])}
        while todo:
            s = todo.pop()

            def depth(c, s=s):
                return 1 if c == root else 1 + max(depth(x) for x in loads[c] & s)

            def dist(c, s=s):
                return 0.0 if c == root else min(dist(x) + hop(c, x) for x in loads[c] & s)

            outer = [c for c in s if c != root and (not loads[c] or loads[c] - s)]
            n_in = len({d for c in s for d in drivers[c]} - s)
            if 1 + len(outer) > b.max_outputs:
                verdict = "prune:max_outputs"
            elif any(len(loads[c] - s) > b.max_cells - len(s) for c in s if c != root):
                verdict = "prune:external_loads"
            elif b.max_distance is not None and max(map(dist, s)) > b.max_distance:
                verdict = "prune:max_distance"
            elif b.max_root_dx is not None and max(abs(place[c][0] - place[root][0]) for c in s) > b.max_root_dx:
                verdict = "prune:max_root_dx"
            elif b.max_root_dy is not None and max(abs(place[c][1] - place[root][1]) for c in s) > b.max_root_dy:
                verdict = "prune:max_root_dy"
            elif len(s) > b.max_cells:
                verdict = "prune:max_cells"
            elif max(map(depth, s)) > b.max_depth:
                verdict = "prune:max_depth"
            else:
                good = b.min_cells <= len(s) and b.min_inputs <= n_in <= b.max_inputs and max(map(depth, s)) >= 2
                verdict = "include" if good and (not outer or b.allow_internal_fanout or b.max_outputs > 1) else "skip:bounds"
            out[root, tuple(sorted(s))] = verdict
            if not verdict.startswith("prune"):
                for p in {d for c in s for d in drivers[c]} - s:
                    if p in loads and s | {p} not in seen:
                        seen.add(s | {p})
                        todo.append(s | {p})
    return out


def test_general_search_against_sets(spark):
    rng = random.Random(10)
    cells = list(range(1, 19))
    edges = {(a, b) for b, a in itertools.combinations(cells, 2) if rng.random() < 0.12}
    place = {c: (rng.random() * 10, rng.random() * 10) for c in cells}
    c = spark.createDataFrame([(x, *place[x]) for x in cells], "id long, x double, y double")
    e = spark.createDataFrame(list(edges), "driver long, load long")
    for b in (
        explore.Bounds(max_cells=4, min_inputs=0, max_outputs=2), explore.Bounds(max_cells=4, min_inputs=0, max_outputs=2, max_distance=9.0, max_root_dx=6.0, max_root_dy=7.0, max_depth=2),
        explore.Bounds(max_cells=5, min_inputs=1),
    ):
        got = {(r.root, tuple(r.cells)): r.verdict for r in explore.search(c, e, saved, b).collect()}
        assert got == brute_search(cells, edges, place, b)


def test_shapes_group_equal_cones(spark):
    cells = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "A"), (5, "B"), (6, "C")], "id long, gate string")
    edges = spark.createDataFrame([(2, 1, "x"), (3, 1, "y"), (5, 4, "x"), (6, 4, "y")], "driver long, load long, term string")
    one = {r.id: r.shape for r in explore.structural_groups(cells, edges, saved, 1).collect()}
    two = {r.id: r.shape for r in explore.structural_groups(cells, edges, saved, 2).collect()}
    assert one[1] == one[4] and two[1] != two[4] and two[2] == two[3] == two[5]


def fewest_gates(target, base, most):
    """Least number of base gates and inverters over two inputs, by sets of all values that so many gates can give."""
    inputs = frozenset([0b0011, 0b0101])
    states = {inputs}
    for gates in range(most + 1):
        if any(target in s for s in states):
            return gates
        after = set()
        for s in states:
            made = {15 ^ x for x in s}
            for x in s:
                for y in s:
                    rows = [(x >> (3 - a) & 1) * 2 + (y >> (3 - a) & 1) for a in range(4)]
                    made.add(sum((base >> (3 - r) & 1) << (3 - a) for a, r in enumerate(rows)))
            after |= {s | {v} for v in made - s}
        states = after
    return None


def test_synthesis_against_all_circuits():
    rng = random.Random(5)
    for target, base in [(rng.randrange(1, 15), rng.choice([1, 2, 4, 6, 7, 8, 9, 11, 13, 14])) for _ in range(25)]:
        status, gates, inverters, *_ = search.synthesis(target, 2, base, 2, 3)
        want = fewest_gates(target, base, 3)
        if status == "OK":
            assert gates + inverters == want
        elif status == "PROJECTION":
            assert want == 0
        else:
            assert want is None or gates is None and status.startswith("IMPOSSIBLE") and want > 3
    two = search.simulate([(0b1000, [0, 1]), (0b10, [2])], 2)
    assert two == [0b1000, 0b0111]


def test_loops_end_when_a_value_repeats():
    assert search.converge(8.0, lambda x: max(2.0, x / 2)) == [8.0, 4.0, 2.0, 2.0]
    assert len(search.converge(1.0, lambda x: x + 1, most=5)) == 6


def test_least_integer_classes_are_the_greatest_forms():
    for n in (1, 2, 3):
        pairs = set(zip(space.least_integer_table(n).tolist(), space.negation_table(n, True).tolist()))
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
