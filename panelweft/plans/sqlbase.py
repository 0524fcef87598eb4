"""Shared oracle text: the same panels written in plain SQL."""

WEEKLY = """
lw AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS security_id,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS session,
         sum(CAST(l_quantity AS BIGINT)) AS q,
         sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents
  FROM lineitem GROUP BY 1, 2),
lwi AS (
  SELECT *, CAST(date_diff('day', (SELECT min(session) FROM lw), session) / 7 AS INTEGER) AS session_idx
  FROM lw),
cal AS (
  SELECT CAST(x AS DATE) AS session, CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS session_idx
  FROM (SELECT unnest(generate_series((SELECT min(session) FROM lw), (SELECT max(session) FROM lw), INTERVAL 7 DAY)) AS x))"""

BARS = (
    WEEKLY
    + """,
b0 AS (
  SELECT security_id, session, session_idx, CAST(q AS DOUBLE) AS volume,
         (CAST(sum(cents) OVER y AS DOUBLE) / 100.0) / CAST(sum(q) OVER y AS DOUBLE) AS close
  FROM lwi WINDOW y AS (PARTITION BY security_id ORDER BY session_idx RANGE BETWEEN 25 PRECEDING AND CURRENT ROW)),
bars AS (
  SELECT security_id, session, session_idx, first_value(close) OVER m AS open,
         max(close) OVER m AS high, min(close) OVER m AS low, close, volume
  FROM b0 WINDOW m AS (PARTITION BY security_id ORDER BY session_idx RANGE BETWEEN 3 PRECEDING AND CURRENT ROW))"""
)

RETURNS = (
    BARS
    + """,
assets AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS security_id, r_name AS sector, n_name AS sleeve
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
rets AS (
  SELECT b.*, a.sector, a.sleeve,
         b.close / first_value(b.close) OVER (PARTITION BY b.security_id ORDER BY b.session_idx
             RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) - 1 AS ret
  FROM bars b LEFT JOIN assets a USING (security_id))"""
)

PANEL = (
    RETURNS
    + """,
mkt AS (
  SELECT session_idx, sum(ret * volume) / sum(volume) AS market FROM rets
  WHERE ret IS NOT NULL GROUP BY 1),
panel AS (SELECT r.*, m.market FROM rets r LEFT JOIN mkt m USING (session_idx))"""
)


def ts(n: int, key: str = "security_id", order: str = "session_idx") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def tsp(n: int, key: str = "security_id", order: str = "session_idx") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def at(col: str, k: int, key: str = "security_id", order: str = "session_idx") -> str:
    side = f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING"
    return f"first_value({col}) OVER (PARTITION BY {key} ORDER BY {order} RANGE BETWEEN {side} AND {side})"


def roll(fn: str, col: str, frame: str, k: int) -> str:
    """``fn`` is a template with ``{}`` for the column."""
    return f"CASE WHEN count({col}) OVER {frame} >= {k} THEN {fn.format(col)} OVER {frame} END"


def pct_rank(col: str, by: str = "session_idx") -> str:
    return (
        f"CASE WHEN {col} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {col} NULLS LAST)"
        f" + count({col}) OVER (PARTITION BY {by} ORDER BY {col} NULLS LAST)) / 2.0"
        f" / count({col}) OVER (PARTITION BY {by}) END"
    )


def zscore(col: str, by: str = "session_idx", bound: float = 3, min_count: int = 2) -> str:
    p = f"OVER (PARTITION BY {by})"
    return (
        f"CASE WHEN {col} IS NOT NULL AND count({col}) {p} >= {min_count} AND stddev_samp({col}) {p} > 0 THEN "
        f"greatest(-{bound}, least({bound}, ({col} - avg({col}) {p}) / stddev_samp({col}) {p})) END"
    )


def peer(col: str, by: str = "session_idx, sector", min_peers: int = 2) -> str:
    p = f"OVER (PARTITION BY {by})"
    return (
        f"CASE WHEN sector IS NOT NULL AND {col} IS NOT NULL AND count({col}) {p} - 1 >= {min_peers} "
        f"THEN (sum({col}) {p} - {col}) / (count({col}) {p} - 1) END"
    )


RESEARCH = (
    RETURNS
    + f""",
mkt AS (
  SELECT session_idx, sum(ret * volume) / sum(volume) AS market FROM rets
  WHERE ret IS NOT NULL GROUP BY 1),
mm AS (
  SELECT session_idx, market,
         {roll("avg({})", "market", "(ORDER BY session_idx RANGE BETWEEN 26 PRECEDING AND 1 PRECEDING)", 13)} AS market_mean,
         {roll("var_samp({})", "market", "(ORDER BY session_idx RANGE BETWEEN 26 PRECEDING AND 1 PRECEDING)", 13)} AS market_var
  FROM mkt),
ep AS (
  SELECT r.*, m.market, m.market_mean, m.market_var,
         {roll("stddev_samp({})", "r.ret", tsp(26, "r.security_id", "r.session_idx"), 13)} AS vol,
         r.ret IS NOT NULL AND count(r.ret) OVER (PARTITION BY r.security_id ORDER BY r.session_idx
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 26 AS eligible
  FROM rets r LEFT JOIN mm m USING (session_idx))"""
)

BETA = f"""
bp AS (
  SELECT *, CASE WHEN market_var > 0 AND count(CASE WHEN ret IS NOT NULL AND market IS NOT NULL THEN 1 END) OVER {tsp(26)} >= 13
      THEN covar_samp(ret, market) OVER {tsp(26)} / market_var END AS beta
  FROM ep)"""

RESIDUAL = (
    RESEARCH
    + ","
    + BETA
    + f""",
r0 AS (SELECT *, ret - beta * market AS e FROM bp),
rs AS (SELECT * EXCLUDE (e), e - {peer("e")} AS residual FROM r0)"""
)
