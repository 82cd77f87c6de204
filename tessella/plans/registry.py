"""Where the raster queries register themselves with their DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.color import FROM_XYZ

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Rounded to 6 digits, without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def with_(ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


#: Scalar raster and RGBA raster in SQL.
E = "e AS (SELECT CAST(vec_id AS INT) AS y, CAST(unnest(range(64)) AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v, CAST(label AS BIGINT) AS region FROM embeddings)"
_CHANNEL = "CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (CAST(v[x * 4 + {k}] AS DOUBLE) + 0.6::DOUBLE) / 1.2::DOUBLE)) * 255) AS INT) AS {c}"
R = "r0 AS (SELECT CAST(vec_id AS INT) AS y, CAST(unnest(range(16)) AS INT) AS x, embedding AS v FROM embeddings),\nr AS (SELECT y, x, " + ", ".join(_CHANNEL.format(k=k + 1, c=c) for k, c in enumerate("rgba")) + " FROM r0)"


def lab_ctes(source: str, out: str) -> str:
    """CTEs that add l, la, lb (CIE Lab) to the rows (.., r, g, b) of source."""
    lin = lambda c: f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4::DOUBLE) END"
    f = lambda t: f"CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE ({t} * (24389.0::DOUBLE / 27) + 16) / 116 END"
    return f"""{out}_1 AS (SELECT *, {lin("r")} AS c1, {lin("g")} AS c2, {lin("b")} AS c3 FROM {source}),
{out}_2 AS (SELECT *, (c1 * 0.4124564::DOUBLE + c2 * 0.3575761::DOUBLE + c3 * 0.1804375::DOUBLE) / 0.95047::DOUBLE AS t1, c1 * 0.2126729::DOUBLE + c2 * 0.7151522::DOUBLE + c3 * 0.0721750::DOUBLE AS t2, (c1 * 0.0193339::DOUBLE + c2 * 0.1191920::DOUBLE + c3 * 0.9503041::DOUBLE) / 1.08883::DOUBLE AS t3 FROM {out}_1),
{out}_3 AS (SELECT *, {f("t1")} AS f1, {f("t2")} AS f2, {f("t3")} AS f3 FROM {out}_2),
{out} AS (SELECT * EXCLUDE (c1, c2, c3, t1, t2, t3, f1, f2, f3), f2 * 116 - 16 AS l, (f1 - f2) * 500 AS la, (f2 - f3) * 200 AS lb FROM {out}_3)"""


def rgb_ctes(source: str, out: str) -> str:
    """CTEs that add nr, ng, nb (bytes) from l, la, lb of source."""
    xyz = lambda f, white: f"CASE WHEN {f} * {f} * {f} > 216.0::DOUBLE / 24389 THEN {f} * {f} * {f} ELSE ({f} * 116 - 16) / (24389.0::DOUBLE / 27) END * {white}::DOUBLE"
    enc = lambda c: f"CAST(floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 255 * CASE WHEN {c} <= 0.0031308 THEN {c} * 12.92::DOUBLE ELSE pow(greatest({c}, 0.0::DOUBLE), 1 / 2.4::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END)) + 5e-7) AS INT)"
    return f"""{out}_1 AS (SELECT *, (l + 16) / 116 AS fy FROM {source}),
{out}_2 AS (SELECT *, {xyz("(fy + la / 500)", 0.95047)} AS q1, {xyz("fy", 1.0)} AS q2, {xyz("(fy - lb / 200)", 1.08883)} AS q3 FROM {out}_1),
{out}_3 AS (SELECT *, {", ".join(f"q1 * {m[0]!r}::DOUBLE + q2 * {m[1]!r}::DOUBLE + q3 * {m[2]!r}::DOUBLE AS k{i + 1}" for i, m in enumerate(FROM_XYZ))} FROM {out}_2),
{out} AS (SELECT * EXCLUDE (fy, q1, q2, q3, k1, k2, k3), {enc("k1")} AS nr, {enc("k2")} AS ng, {enc("k3")} AS nb FROM {out}_3)"""


def palette_ctes(values: str) -> str:
    """pal (idx, r, g, b, l, la, lb) from the rows of a VALUES list."""
    return f"pal_0 AS (SELECT * FROM (VALUES {values}) AS p(idx, r, g, b)),\n" + lab_ctes("pal_0", "pal")


def nearest_rank_sql(value: str, p: float) -> str:
    return f"list_sort(list({value}))[CAST(floor((count(*) - 1) * {p}::DOUBLE + 0.5) AS INT) + 1]"
