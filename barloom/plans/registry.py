"""Registry of named queries and the equivalent SQL used to check them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import kernels as kn
from barloom.session import ship

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles so that sums taken in another order compare equal."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # scaled, rounded half away from zero, scaled back: as the SQL side rounds
            scale = F.lit(10.0**digits)
            c = F.when(~F.isnan(c), F.round(c.cast("double") * scale) / scale + F.lit(0.0))
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, sql: str | None = None, digits: int = DIGITS):
    """Register ``fn(spark, sf_dir)`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return tidy(fn(spark, sf_dir), digits)

        run.__module__ = fn.__module__
        QUERIES[name] = Query(name, run, sql)
        return fn

    return register


# --- SQL text ----------------------------------------------------------------------

TICK_COLUMNS = (
    "epoch_ms(l_shipdate) AS ts_ms, "
    "(l_orderkey*8+l_linenumber)*1048576 + l_partkey%1048576 AS seq, "
    "l_extendedprice/l_quantity AS price, l_quantity AS volume, "
    "l_returnflag, l_linestatus, l_discount-l_tax AS rate"
)
TICKS_SUPP = f"ticks AS (SELECT l_suppkey AS symbol, {TICK_COLUMNS} FROM lineitem)"
TICKS_BRAND = (
    f"ticks AS (SELECT p_brand AS symbol, {TICK_COLUMNS.replace('l_extendedprice/l_quantity', 'l_extendedprice/l_quantity + 50000.0')} "
    "FROM lineitem JOIN part ON l_partkey=p_partkey)"
)

_BUCKET = {
    "week": "ts_ms//604800000*604800000",
    "day": "ts_ms",
    "month": "epoch_ms(date_trunc('month', make_timestamp_ms(ts_ms)))",
}


def bars_sql(grid: str) -> str:
    return f"""
{TICKS_BRAND},
bars AS (SELECT symbol, bucket AS ts_ms,
  first(price ORDER BY ts_ms, seq) AS open, max(price) AS high, min(price) AS low,
  last(price ORDER BY ts_ms, seq) AS close, sum(volume) AS volume, count(*) AS tick_count,
  (2*sum(CASE WHEN l_linestatus='O' THEN volume ELSE 0 END)-sum(volume))/sum(volume) AS ofi,
  sum(rate)/count(*) AS funding,
  sum(volume)*last(price ORDER BY ts_ms, seq) AS oi_value,
  (count(*) FILTER (l_returnflag='A')+1.0)/(count(*) FILTER (l_returnflag='N')+1.0) AS crowd_ratio,
  (count(*) FILTER (l_returnflag='A')+1.0)/(count(*) FILTER (l_returnflag='R')+1.0) AS smart_ratio,
  (count(*) FILTER (l_returnflag='N')+1.0)/(count(*) FILTER (l_returnflag='R')+1.0) AS smart_count_ratio,
  (count(*) FILTER (l_linestatus='O')+1.0)/(count(*) FILTER (l_linestatus='F')+1.0) AS taker_ratio
 FROM (SELECT *, {_BUCKET[grid]} AS bucket FROM ticks) GROUP BY symbol, bucket)"""


def panel_sql(grid: str = "week") -> str:
    """``ticks, bars, axis, panel`` common table expressions (no leading WITH)."""
    return bars_sql(grid) + """,
axis AS (SELECT ts_ms, row_number() OVER (ORDER BY ts_ms)-1 AS ti FROM (SELECT DISTINCT ts_ms FROM bars)),
panel AS (SELECT s.symbol, a.ti, a.ts_ms, b.* EXCLUDE (symbol, ts_ms)
 FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN axis a
 LEFT JOIN bars b ON b.symbol=s.symbol AND b.ts_ms=a.ts_ms)"""


def out(body: str, keys: str, vals: str, digits: int = DIGITS) -> str:
    """Final SELECT of ``body`` (a FROM item) with rounded values."""
    k = [c.strip() for c in keys.split(",") if c.strip()]
    v = [c.strip() for c in vals.split(",") if c.strip()]
    sel = k + [f"round(CAST({c} AS DOUBLE),{digits})+0.0 AS {c}" for c in v]
    return f"SELECT {', '.join(sel)} FROM {body}"


def W(n: int, key="symbol", order="ti") -> str:
    return f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def L(x: str, n: int, key="symbol", order="ti") -> str:
    return x if n == 0 else f"lag({x},{n}) OVER (PARTITION BY {key} ORDER BY {order})"


def guarded(fn: str, x: str, n: int, m: int) -> str:
    return f"(CASE WHEN count({x}) {W(n)} >= {m} THEN {fn} {W(n)} END)"


def rmean(x, n, m):
    return guarded(f"avg({x})", x, n, m)


def rstd(x, n, m):
    return guarded(f"stddev_samp({x})", x, n, m)


def rskew(x, n, m):
    return guarded(f"skewness({x})", x, n, max(m, 3))


def sdiv(a, b):
    return f"(({a})/nullif({b},0))"


def sln(x):
    return f"(CASE WHEN ({x})>0 THEN ln({x}) END)"


def xz(x, part="ti"):
    return f"(({x})-avg({x}) OVER (PARTITION BY {part}))/nullif(stddev_samp({x}) OVER (PARTITION BY {part}),0)"


def arank(x, part="ti"):
    """Average-tie rank of the non-null values."""
    return (
        f"(CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {part} ORDER BY {x} ASC NULLS LAST)"
        f" + (count({x}) OVER (PARTITION BY {part}, {x}) - 1)/2.0) END)"
    )


def imm_sql(src: str) -> str:
    """Recursive ``imm`` (symbol, i, p_hat, nu_hat, trend_score) of the two mixed filters over ``src``.

    ``src``: symbol, i from 0, obs, pt, pc, atr. Covariances of these data stay positive definite,
    so the eigenvalue floor is not written out.
    """
    (a00, a01), (a10, a11) = kn.IMM_A
    body = []
    for j, (p0, p1) in enumerate(((a00, a10), (a01, a11))):
        q0, q1 = kn.IMM_Q[j]
        body += [
            f"greatest(w0*{p0}+w1*{p1},1e-12) AS c{j}", f"{p0}*w0/c{j} AS m{j}", f"{p1}*w1/c{j} AS n{j}",
            f"m{j}*x0+n{j}*x1 AS mx{j}", f"m{j}*v0+n{j}*v1 AS mv{j}",
        ]
        spread = lambda e0, e1, j=j: f"m{j}*(r.{e0[0]}0+{e0[1]})+n{j}*(r.{e0[0]}1+{e1})"
        dx, dv = (f"(x0-mx{j})", f"(x1-mx{j})"), (f"(v0-mv{j})", f"(v1-mv{j})")
        body += [
            f"{spread(('a', dx[0] + '*' + dx[0]), dx[1] + '*' + dx[1])} AS ma{j}",
            f"{spread(('b', dx[0] + '*' + dv[0]), dx[1] + '*' + dv[1])} AS mb{j}",
            f"{spread(('d', dv[0] + '*' + dv[0]), dv[1] + '*' + dv[1])} AS md{j}",
            f"ma{j}+2*mb{j}+md{j}+{q0} AS pa{j}", f"mb{j}+md{j} AS pb{j}", f"md{j}+{q1} AS pd{j}", f"pa{j}+{kn.IMM_R} AS g{j}",
            f"mx{j}+mv{j}+pa{j}/g{j}*(obs-(mx{j}+mv{j})) AS nx{j}", f"mv{j}+pb{j}/g{j}*(obs-(mx{j}+mv{j})) AS nv{j}",
            f"(1-pa{j}/g{j})*pa{j} AS na{j}", f"(1-pa{j}/g{j})*pb{j} AS nb{j}", f"pd{j}-pb{j}/g{j}*pb{j} AS nd{j}",
        ]
    body += ["greatest(0,pt)+greatest(0,pc) AS tk", "CASE WHEN tk>1e-12 THEN greatest(0,pt)/tk ELSE 0.5 END AS t", "CASE WHEN tk>1e-12 THEN greatest(0,pc)/tk ELSE 0.5 END AS k"]
    old = ", ".join(f"{c}::DOUBLE AS {n}{j}" for j in (0, 1) for n, c in (("x", "obs"), ("v", "0"), ("a", "1"), ("b", "0"), ("d", "1")))
    new = ", ".join(f"n{n}{j}" for j in (0, 1) for n in "xvabd")
    return f"""imm AS (SELECT symbol, -1::BIGINT AS i, {old}, 0.5::DOUBLE AS w0, 0.5::DOUBLE AS w1, NULL::DOUBLE AS p_hat, NULL::DOUBLE AS nu_hat, NULL::DOUBLE AS trend_score FROM {src} WHERE i=0
 UNION ALL SELECT symbol, yi, {new}, t, k, t*nx0+k*nx1, t*nv0+k*nv1, (t*nv0+k*nv1)/greatest(atr,1e-8) FROM (SELECT r.symbol, y.i AS yi, y.atr, {', '.join(body)} FROM imm r JOIN {src} y ON y.symbol=r.symbol AND y.i=r.i+1))"""
