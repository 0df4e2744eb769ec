"""SQL twins of the graph queries on the forest p <- 2p, 2p + 1.

With two to four inputs a cluster has one of seven shapes, so the twins join
the shapes directly.
"""

from __future__ import annotations

GRAPH = """p AS (SELECT p_partkey AS id, p_type AS gate FROM part WHERE p_partkey > 0 AND p_brand <> (SELECT min(p_brand) FROM part)),
kn AS (SELECT gate, row_number() OVER (ORDER BY gate) - 1 AS kind FROM (SELECT DISTINCT gate FROM p)),
g AS (SELECT id, kind FROM p JOIN kn USING (gate))"""

#: Cells as (factor, offset) of the root, and the outside nets in order.
SHAPES = (
    (((1, 0), (2, 0)), ((2, 1), (4, 0), (4, 1))),
    (((1, 0), (2, 1)), ((2, 0), (4, 2), (4, 3))),
    (((1, 0), (2, 0), (2, 1)), ((4, 0), (4, 1), (4, 2), (4, 3))),
    (((1, 0), (2, 0), (4, 0)), ((2, 1), (4, 1), (8, 0), (8, 1))),
    (((1, 0), (2, 0), (4, 1)), ((2, 1), (4, 0), (8, 2), (8, 3))),
    (((1, 0), (2, 1), (4, 2)), ((2, 0), (4, 3), (8, 4), (8, 5))),
    (((1, 0), (2, 1), (4, 3)), ((2, 0), (4, 2), (8, 6), (8, 7))),
)


def _gate(kind: str, a: str, b: str, ones: int) -> str:
    return (
        f"(CASE {kind} WHEN 0 THEN {ones} - ({a} & {b}) WHEN 1 THEN {ones} - ({a} | {b}) WHEN 2 THEN {a} & {b} WHEN 3 THEN {a} | {b}"
        f" WHEN 4 THEN xor({a}, {b}) ELSE {ones} - xor({a}, {b}) END)"
    )


def _shape(cells, inputs, extra: str) -> str:
    joins = "".join(f" JOIN g g{i} ON g{i}.id = g0.id * {f} + {o}" for i, (f, o) in enumerate(cells) if i)
    names = " || ',' || ".join(f"g{i}.id" for i in range(len(cells)))
    return f"SELECT g0.id AS root, {names} AS cells, {extra} FROM g g0{joins}"


def _clusters() -> str:
    return " UNION ALL ".join(
        _shape(c, i, f"CAST({len(c)} AS BIGINT) AS n_cells, CAST({max(f for f, _ in c).bit_length()} AS BIGINT) AS depth, CAST({len(i)} AS BIGINT) AS n_inputs") for c, i in SHAPES
    )


def expand() -> str:
    return f"WITH {GRAPH} {_clusters()}"


def audit() -> str:
    return f"""WITH {GRAPH}, k AS (SELECT x.id, count(y.id) AS k FROM g x LEFT JOIN g y ON y.id IN (2 * x.id, 2 * x.id + 1) GROUP BY 1),
l2 AS (SELECT x.id, CAST(pow(2, count(c.id)) AS BIGINT) AS n, CAST(coalesce(sum(c.k), 0) * pow(2, greatest(count(c.id) - 1, 0)) AS BIGINT) AS w FROM g x LEFT JOIN k c ON c.id IN (2 * x.id, 2 * x.id + 1) GROUP BY 1),
l3 AS (SELECT x.id, (1 + coalesce(a.n, 0)) * (1 + coalesce(b.n, 0)) AS n, coalesce(a.w, 0) * (1 + coalesce(b.n, 0)) + coalesce(b.w, 0) * (1 + coalesce(a.n, 0)) AS w
FROM g x LEFT JOIN l2 a ON a.id = 2 * x.id LEFT JOIN l2 b ON b.id = 2 * x.id + 1),
i AS (SELECT count(*) AS n FROM ({_clusters()})), o AS (SELECT 'include' AS verdict, n FROM i UNION ALL SELECT 'skip:bounds', CAST(sum(n - 1) - (SELECT n FROM i) AS BIGINT) FROM l3 UNION ALL SELECT 'prune:max_depth', CAST(sum(w) AS BIGINT) FROM l3)
SELECT * FROM o WHERE n > 0"""


def truth_table() -> str:
    out = []
    for cells, inputs in SHAPES:
        n = len(inputs)
        size = 1 << n
        ones = (1 << size) - 1
        pattern = [sum(1 << (size - 1 - a) for a in range(size) if a >> (n - 1 - i) & 1) for i in range(n)]

        def value(node):
            if node in cells:
                f, o = node
                return _gate(f"g{cells.index(node)}.kind", value((2 * f, 2 * o)), value((2 * f, 2 * o + 1)), ones)
            return str(pattern[inputs.index(node)])

        out.append(_shape(cells, inputs, f"lpad(bin({value((1, 0))}), {size}, '0') AS tt"))
    return f"WITH {GRAPH} " + " UNION ALL ".join(out)


def reach() -> str:
    return f"""WITH {GRAPH} SELECT id AS root, id, CAST(0 AS BIGINT) AS depth FROM g UNION ALL SELECT x.id, y.id, CAST(1 AS BIGINT) FROM g x JOIN g y ON y.id // 2 = x.id
UNION ALL SELECT x.id, z.id, CAST(2 AS BIGINT) FROM g x JOIN g y ON y.id // 2 = x.id JOIN g z ON z.id // 2 = y.id"""
