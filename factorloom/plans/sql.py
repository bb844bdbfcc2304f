"""The views of the catalog in SQL, for the statements that queries are checked against."""

from __future__ import annotations

VIEWS = """
line AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS code, l_extendedprice AS ext, l_discount - l_tax AS r, l_quantity AS qty, l_returnflag AS flag, l_suppkey AS supp
  FROM lineitem JOIN part ON l_partkey = p_partkey),
px_day AS (SELECT date, code, avg(ext) AS adj_close, sum(ext) AS market_cap FROM line GROUP BY ALL),
ret_day AS (SELECT date, code, sum(ext * r) / sum(ext) AS ret, sum(ext) AS cap FROM line GROUP BY ALL),
cal AS (SELECT month, row_number() OVER (ORDER BY month) AS k FROM (SELECT DISTINCT last_day(date) AS month FROM line)),
px_month AS (SELECT month, k, code, price, cap, ret, pbr FROM (SELECT last_day(date) AS month, code, avg(ext) AS price, sum(ext) AS cap, sum(ext * r) / sum(ext) AS ret, avg(qty) AS pbr FROM line GROUP BY ALL) JOIN cal USING (month)),
days AS (SELECT date, di, k FROM (SELECT date, row_number() OVER (ORDER BY date) AS di FROM (SELECT DISTINCT date FROM line)) JOIN cal ON last_day(date) = month),
factor_day AS (SELECT *, win - los AS wml FROM (SELECT date, sum(ext * r) FILTER (flag = 'A') / sum(ext) FILTER (flag = 'A') AS win, sum(ext * r) FILTER (flag = 'R') / sum(ext) FILTER (flag = 'R') AS los, sum(ext * r) / sum(ext) AS mkt FROM line GROUP BY date)),
series_day AS (SELECT * FROM (SELECT 'win' AS series, date, win AS r FROM factor_day UNION ALL SELECT 'los', date, los FROM factor_day UNION ALL SELECT 'mkt', date, mkt FROM factor_day UNION ALL SELECT 'wml', date, wml FROM factor_day) WHERE r IS NOT NULL),
rf_month AS (SELECT last_day(CAST(o_orderdate AS DATE)) AS month, avg(o_totalprice) / 1e8 AS rf FROM orders GROUP BY 1),
market_day AS (SELECT market, date, win - los AS r FROM (SELECT r_name AS market, date, sum(ext * line.r) FILTER (flag = 'A') / sum(ext) FILTER (flag = 'A') AS win, sum(ext * line.r) FILTER (flag = 'R') / sum(ext) FILTER (flag = 'R') AS los
  FROM line JOIN supplier ON supp = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL) WHERE win IS NOT NULL AND los IS NOT NULL),
series_month AS (SELECT series, last_day(date) AS month, product(1 + r) - 1 AS ret, sum(r * r) AS rv, sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) AS down FROM series_day GROUP BY ALL),
fvar AS (SELECT series, last_day(date) AS month, arg_max(v, date) AS fvar FROM (SELECT series, date, CASE WHEN count(*) OVER w >= 126 THEN 21 * avg(r * r) OVER w END AS v FROM series_day WINDOW w AS (PARTITION BY series ORDER BY date ROWS 125 PRECEDING)) WHERE v IS NOT NULL GROUP BY ALL),
race AS (SELECT series, month, t, y, rv, fvar, ret_next FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY month) - 1 AS t FROM (
  SELECT m.series, m.month, lead(m.rv) OVER w AS y, m.rv, fvar, lead(m.ret) OVER w AS ret_next FROM series_month m LEFT JOIN fvar f ON m.series = f.series AND m.month = f.month WINDOW w AS (PARTITION BY m.series ORDER BY m.month)) WHERE y IS NOT NULL AND fvar IS NOT NULL)),
ewma AS (SELECT series, lam, t, list_reduce(past, lambda s, x: lam * s + (1 - lam) * x, seed) AS f FROM (
  SELECT a.series, a.t, lam, list(b.y ORDER BY b.t) FILTER (b.t IS NOT NULL) AS past, any_value(seed) AS seed FROM race a
  CROSS JOIN (VALUES (CAST(0.7 AS DOUBLE)), (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.94 AS DOUBLE))) g(lam) LEFT JOIN race b ON a.series = b.series AND b.t < a.t JOIN (SELECT series, avg(y) AS seed FROM race WHERE t < 12 GROUP BY 1) s ON a.series = s.series GROUP BY ALL) WHERE past IS NOT NULL
  UNION ALL SELECT race.series, lam, 0, seed FROM race CROSS JOIN (VALUES (CAST(0.7 AS DOUBLE)), (CAST(0.8 AS DOUBLE)), (CAST(0.9 AS DOUBLE)), (CAST(0.94 AS DOUBLE))) g(lam) JOIN (SELECT series, avg(y) AS seed FROM race WHERE t < 12 GROUP BY 1) s ON race.series = s.series WHERE t = 0),
folds AS (SELECT series, t0 FROM (SELECT series, max(t) AS n FROM race GROUP BY 1), (SELECT unnest(range(36, 2000, 6)) AS t0) WHERE t0 <= n),
fold_of AS (SELECT race.series, t, CAST(36 + 6 * floor((t - 36) / 6) AS BIGINT) AS t0 FROM race WHERE t >= 36),
expmean AS (SELECT o.series, o.t, avg(b.y) AS f FROM fold_of o JOIN race b ON o.series = b.series AND b.t < o.t0 GROUP BY ALL),
lam_loss AS (SELECT f.series, f.t0, e.lam, avg(y / e.f - ln(y / e.f) - 1) AS loss FROM folds f JOIN ewma e ON f.series = e.series AND e.t >= 12 AND e.t < f.t0 JOIN race r ON r.series = e.series AND r.t = e.t GROUP BY ALL),
lam_best AS (SELECT series, t0, arg_min(lam, (loss, lam)) AS lam FROM lam_loss GROUP BY ALL),
forecasts AS (SELECT series, t, 'ExpandingMean' AS model, f FROM expmean UNION ALL SELECT series, t, 'RW126', fvar FROM race WHERE t >= 36
  UNION ALL SELECT o.series, o.t, 'EWMA', e.f FROM fold_of o JOIN lam_best b ON o.series = b.series AND o.t0 = b.t0 JOIN ewma e ON e.series = o.series AND e.t = o.t AND e.lam = b.lam),
scored AS (SELECT f.series, f.model, f.t, race.month, f.f, race.y, race.y / f.f - ln(race.y / f.f) - 1 AS loss, race.ret_next, (0.12 / sqrt(12)) / sqrt(f.f) AS lev FROM forecasts f JOIN race ON f.series = race.series AND f.t = race.t),
strat AS (SELECT series, model, t, month, lev * ret_next AS r, lev FROM scored UNION ALL SELECT series, 'plain', t, month, ret_next, 1.0 FROM race WHERE t >= 36)
"""


def of_markets() -> str:
    """The views with a market's factor in the place of a series: everything after the daily returns is the same."""
    parts = VIEWS.strip().split(",\n")
    kept = [x for x in parts if not x.startswith("series_day ")]
    at = next(k for k, x in enumerate(kept) if x.startswith("market_day ")) + 1
    first = next(k for k, x in enumerate(kept) if x.startswith("series_month "))
    if first < at:
        raise ValueError("the views of a series stand before those of a market")
    return ",\n".join([*kept[:at], "series_day AS (SELECT market AS series, date, r FROM market_day)", *kept[at:]])


def with_series(ctes: str) -> str:
    """The views with another definition of the daily series, and what it needs, in the place of theirs."""
    parts = VIEWS.strip().split(",\n")
    at = next(k for k, x in enumerate(parts) if x.startswith("series_day "))
    return ",\n".join([*parts[:at], ctes.strip(), *parts[at + 1 :]])


def statement(select: str, ctes: str = "", floats: list[str] | None = None, digits: int = 6, dates: list[str] | None = None, markets: bool = False, series: str = "") -> str:
    """A whole statement: the views, own expressions, and a select whose floats are rounded (without negative zeros)."""
    body = f"WITH {of_markets() if markets else with_series(series) if series else VIEWS.strip()}{',' + chr(10) + ctes.strip() if ctes.strip() else ''}\n"
    shown = [f"round(CAST({c} AS DOUBLE), {digits}) + 0 AS {c}" for c in floats or []] + [f"CAST(CAST({c} AS DATE) AS VARCHAR) AS {c}" for c in dates or []]
    return body + select.strip() if not shown else f"{body}SELECT * REPLACE ({', '.join(shown)}) FROM ({select.strip()})"
