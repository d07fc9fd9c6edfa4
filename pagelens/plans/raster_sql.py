"""Pixel-level DuckDB building blocks for the raster oracles."""

from __future__ import annotations

from pagelens.functions.kernels import ellipse

K = "page_id, region_id"


def runs(name: str, src: str, keys: str = K) -> str:
    return (f"{name} AS (SELECT {keys}, y, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT *, x - row_number() OVER "
            f"(PARTITION BY {keys}, y ORDER BY x) AS isle FROM {src}) GROUP BY {keys}, y, isle)")


def labels(name: str, src: str, keys: str = K, conn: int = 8) -> str:
    """``name``: pixels of ``src`` with the component label; closure over runs."""
    n, same = name, lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    ka = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    kc = ", ".join(f"c.{k.strip()}" for k in keys.split(","))
    op = "<=" if conn == 8 else "<"
    return f"""{runs(n + "_r", src, keys)},
{n}_e AS (SELECT {ka}, a.y * 4096 + a.x0 AS a, b.y * 4096 + b.x0 AS b FROM {n}_r a JOIN {n}_r b
  ON {same("a", "b")} AND b.y = a.y + 1 AND b.x0 {op} a.x1 AND a.x0 {op} b.x1),
{n}_b AS (SELECT {keys}, a, b FROM {n}_e UNION ALL SELECT {keys}, b, a FROM {n}_e),
{n}_c AS (SELECT {keys}, y * 4096 + x0 AS node, y * 4096 + x0 AS lab FROM {n}_r
  UNION SELECT {kc}, e.b, c.lab FROM {n}_c c JOIN {n}_b e ON {same("c", "e")} AND c.node = e.a),
{n}_m AS (SELECT {keys}, node, min(lab) AS lab FROM {n}_c GROUP BY {keys}, node),
{n} AS (SELECT {", ".join("r." + k.strip() for k in keys.split(","))}, r.y AS y, CAST(unnest(range(r.x0, r.x1)) AS INT) AS x, lab
  FROM {n}_r r JOIN {n}_m m ON {same("r", "m")} AND m.node = r.y * 4096 + r.x0)"""


def stats(name: str, src: str, keys: str = K) -> str:
    return (f"{name} AS (SELECT {keys}, lab, count(*) AS area, min(x) AS bx1, min(y) AS by1, max(x) + 1 AS bx2, max(y) + 1 AS by2, "
            f"max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM {src} GROUP BY {keys}, lab)")


def offsets(k: int) -> str:
    return ", ".join(f"({dy}, {dx})" for dy, hw in ellipse(k) for dx in range(-hw, hw + 1))


def diamond(n: int) -> str:
    return ", ".join(f"({dy}, {dx})" for dy in range(-n, n + 1) for dx in range(abs(dy) - n, n - abs(dy) + 1))


def dilate(name: str, src: str, k: int, keys: str = K, cells: str | None = None) -> str:
    return (f"{name} AS (SELECT DISTINCT {keys}, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x "
            f"FROM {src}, (VALUES {cells or offsets(k)}) o(dy, dx))")


def spread(name: str, src: str, k: int, keys: str = K) -> str:
    """:func:`dilate` by runs: every run is widened once a kernel row, and each pixel is listed by the first run that holds it."""
    rows = ", ".join(f"({dy}, {hw})" for dy, hw in ellipse(k))
    return f"""{runs(name + "_r", src, keys)},
{name} AS (SELECT {keys}, y, CAST(unnest(range(greatest(x0, coalesce(seen, x0)), x1)) AS INT) AS x FROM (SELECT *, max(x1) OVER (PARTITION BY {keys}, y ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT {keys}, CAST(y + dy AS INT) AS y, x0 - hw AS x0, x1 + hw AS x1 FROM {name}_r, (VALUES {rows}) o(dy, hw))))"""


def minus(name: str, a: str, b: str, keys: str = K) -> str:
    cols = f"{keys}, y, x"
    return f"{name} AS (SELECT {cols} FROM {a} EXCEPT SELECT {cols} FROM {b})"


def meet(name: str, a: str, b: str, keys: str = K) -> str:
    cols = f"{keys}, y, x"
    return f"{name} AS (SELECT {cols} FROM {a} INTERSECT SELECT {cols} FROM {b})"


def join(name: str, a: str, b: str, keys: str = K) -> str:
    cols = f"{keys}, y, x"
    return f"{name} AS (SELECT {cols} FROM {a} UNION SELECT {cols} FROM {b})"


def clip(name: str, src: str, box: str = "crops") -> str:
    return (f"{name} AS (SELECT s.page_id, s.region_id, s.y, s.x FROM {src} s JOIN {box} c ON s.page_id = c.page_id AND s.region_id = c.region_id "
            f"AND x >= x1 AND x < x2 AND y >= y1 AND y < y2)")


def box(name: str, src: str = "crops") -> str:
    return (f"{name} AS (SELECT page_id, region_id, CAST(y AS INT) AS y, CAST(unnest(range(x1, x2)) AS INT) AS x FROM "
            f"(SELECT *, unnest(range(y1, y2)) AS y FROM {src}))")


def otsu(name: str, src: str, keys: str) -> str:
    return f"""{name}_h AS (SELECT {keys}, grey, count(*) AS n FROM {src} GROUP BY {keys}, grey),
{name}_s AS (SELECT {keys}, grey, CAST(sum(n) OVER u AS BIGINT) AS w0, CAST(sum(n) OVER t AS BIGINT) AS w,
   CAST(sum(n * grey) OVER u AS BIGINT) AS s0, CAST(sum(n * grey) OVER t AS BIGINT) AS s FROM {name}_h
   WINDOW u AS (PARTITION BY {keys} ORDER BY grey ROWS UNBOUNDED PRECEDING), t AS (PARTITION BY {keys})),
{name}_v AS (SELECT {keys}, grey, CAST(s0 * w - w0 * s AS DOUBLE) * CAST(s0 * w - w0 * s AS DOUBLE) / CAST(w0 * (w - w0) AS DOUBLE) AS v FROM {name}_s WHERE w0 < w),
{name} AS (SELECT {keys}, grey AS threshold, v AS variance FROM {name}_v QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY v DESC, grey) = 1)"""


def smooth(name: str, src: str, keys: str) -> str:
    def step(out, inp, part, order, expr):
        return (f"{out} AS (SELECT {keys}, y, x, {expr} AS grey FROM (SELECT {keys}, y, x, 2 * grey + coalesce(lag(grey) OVER w, lead(grey) OVER w, grey) "
                f"+ coalesce(lead(grey) OVER w, lag(grey) OVER w, grey) AS t FROM {inp} WINDOW w AS (PARTITION BY {keys}, {part} ORDER BY {order})))")
    return step(name + "_x", src, "y", "x", "t") + ",\n" + step(name, name + "_x", "x", "y", "CAST((t + 8) // 16 AS INT)")


def minority(name: str, src: str, keys: str) -> str:
    n = name
    on = " AND ".join(f"s.{k.strip()} = o.{k.strip()}" for k in keys.split(","))
    return f"""{smooth(n + "_s", src, keys)},
{otsu(n + "_o", n + "_s", keys)},
{n}_f AS (SELECT s.*, grey <= threshold AS dark FROM {n}_s s JOIN {n}_o o ON {on}),
{n}_p AS (SELECT *, 2 * count(*) FILTER (dark) OVER (PARTITION BY {keys}) <= count(*) OVER (PARTITION BY {keys}) AS take FROM {n}_f),
{n} AS (SELECT {keys}, y, x FROM {n}_p WHERE dark = take)"""
