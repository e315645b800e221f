"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on DuckDB against the driver's tables registered as views. The
star schema, sample, grid and training set are written once as common table
expressions and prefixed to every query that needs them. The SQL is a plain
relational statement of the same semantics, not a copy of the Spark plans: the
grid is a CROSS JOIN here (fine for a single-node oracle), statistics are the
dense aggregates, and so on.
"""

from __future__ import annotations

DAY_NAMES_SQL = "['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday']"

# The vocabularies of the training set, for the pivoted and one-hot columns.
FAMILIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
STATES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
TYPES = ("A", "B", "C", "D", "E")

_STAR = """
stores AS (
  SELECT CAST(n_nationkey AS INTEGER) AS store_nbr, n_name AS city, r_name AS state,
         chr(CAST(65 + floor(n_nationkey / 5) AS INTEGER)) AS type,
         CAST(n_nationkey % 17 + 1 AS INTEGER) AS cluster
  FROM nation JOIN region ON n_regionkey = r_regionkey),
items AS (
  SELECT CAST(p_partkey AS BIGINT) AS item_nbr, p_type AS family,
         CAST(substr(p_brand, 7) AS INTEGER) AS class,
         CASE WHEN p_size <= 2 THEN 1 ELSE 0 END AS perishable
  FROM part),
sales AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey AS INTEGER) AS store_nbr,
         CAST(l_partkey AS BIGINT) AS item_nbr, sum(l_quantity) AS unit_sales,
         CASE WHEN max(l_tax) = 0 THEN NULL ELSE max(l_discount) >= 0.08 END AS onpromotion
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY 1, 2, 3)"""

_SAMPLE = """
facts AS (
  SELECT * FROM sales
  WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'
    AND item_nbr IN (SELECT item_nbr FROM items WHERE perishable = 1)),
grid AS (
  SELECT d.date, s.store_nbr, i.item_nbr
  FROM (SELECT DISTINCT date FROM facts) d
  CROSS JOIN (SELECT DISTINCT store_nbr FROM facts) s
  CROSS JOIN (SELECT DISTINCT item_nbr FROM facts) i),
panel AS (
  SELECT g.date, g.store_nbr, g.item_nbr, coalesce(f.unit_sales, 0.0) AS unit_sales,
         coalesce(f.onpromotion, false) AS onpromotion
  FROM grid g LEFT JOIN facts f
    ON g.date = f.date AND g.store_nbr = f.store_nbr AND g.item_nbr = f.item_nbr)"""


def _set(src: str) -> str:
    return f"""
  SELECT p.date, p.store_nbr, p.item_nbr, p.unit_sales, p.onpromotion,
         st.city, st.state, st.type, st.cluster, it.family, it.class, it.perishable,
         CAST(month(p.date) AS INTEGER) AS month,
         CAST(weekofyear(p.date) AS INTEGER) AS week_of_year,
         CAST(isodow(p.date) - 1 AS INTEGER) AS day_of_week
  FROM {src} p JOIN stores st ON p.store_nbr = st.store_nbr
               JOIN items it ON p.item_nbr = it.item_nbr"""


_SETS = f"""
train AS ({_set('panel')}),
test_facts AS (
  SELECT date, store_nbr, item_nbr, coalesce(unit_sales, 0.0) AS unit_sales,
         coalesce(onpromotion, false) AS onpromotion
  FROM sales
  WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
    AND item_nbr IN (SELECT item_nbr FROM items WHERE perishable = 1)),
test AS ({_set('test_facts')})"""


def _zexpr(x: str, mean: str, std: str) -> str:
    """IEEE z-score with pandas divide(fill_value=0) rules."""
    d = f"({x} - {mean})"
    return (f"(CASE WHEN {d} IS NULL AND {std} IS NULL THEN 'nan'::DOUBLE "
            f"WHEN coalesce({std}, 0) = 0 THEN (CASE WHEN coalesce({d}, 0) > 0 THEN 'inf'::DOUBLE "
            f"WHEN coalesce({d}, 0) < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END) "
            f"ELSE coalesce({d}, 0) / {std} END)")


def _status(x: str) -> str:
    return (f"(CASE WHEN {x} IS NULL THEN 'null' WHEN isnan({x}) THEN 'nan' "
            f"WHEN {x} = 'inf'::DOUBLE THEN '+inf' WHEN {x} = '-inf'::DOUBLE THEN '-inf' ELSE 'finite' END)")


def _r6(x: str) -> str:
    # + 0.0 turns a rounded -0.0 into 0.0
    return f"(CASE WHEN isfinite({x}) THEN round({x}, 6) + 0.0 END)"


_NORM = f"""
stats AS (
  SELECT item_nbr, avg(unit_sales) AS mean, stddev_samp(unit_sales) AS std
  FROM train GROUP BY item_nbr),
ntrain AS (
  SELECT t.* EXCLUDE (unit_sales, city, cluster, week_of_year, class, perishable),
         {_zexpr('t.unit_sales', 's.mean', 's.std')} AS unit_sales, s.mean, s.std
  FROM train t JOIN stats s ON t.item_nbr = s.item_nbr),
ntest AS (
  SELECT t.* EXCLUDE (unit_sales, city, cluster, week_of_year, class, perishable),
         {_zexpr('t.unit_sales', 's.mean', 's.std')} AS unit_sales, s.mean, s.std
  FROM test t JOIN stats s ON t.item_nbr = s.item_nbr)"""


def _hash(salt_seed: str) -> str:
    return (f"CAST(('0x' || substr(md5(concat_ws('|', {salt_seed}, store_nbr, item_nbr, date)), 1, 8)) AS BIGINT)")


IS_TRAIN = f"({_hash(chr(39) + '42' + chr(39))} % 10 < 8)"
FOLD = f"CAST({_hash(chr(39) + 'fold' + chr(39) + ', ' + chr(39) + '42' + chr(39))} % 5 AS INTEGER)"

_BASELINE = f"""
fit_rows AS (SELECT * FROM ntrain WHERE {IS_TRAIN}),
bmodel AS (SELECT item_nbr, day_of_week, avg(unit_sales) AS prediction
           FROM fit_rows GROUP BY item_nbr, day_of_week),
scored AS (
  SELECT t.date, t.store_nbr, t.item_nbr, t.day_of_week, t.unit_sales AS y,
         coalesce(b.prediction, 0.0) AS prediction, t.mean, t.std
  FROM ntest t LEFT JOIN bmodel b ON t.item_nbr = b.item_nbr AND t.day_of_week = b.day_of_week)"""


def _ieee_div(num: str, den: str) -> str:
    return (f"(CASE WHEN ({den}) <> 0 THEN ({num}) / ({den}) WHEN ({num}) > 0 THEN 'inf'::DOUBLE "
            f"WHEN ({num}) < 0 THEN '-inf'::DOUBLE ELSE 'nan'::DOUBLE END)")


_OK = "(isfinite(y) AND isfinite(prediction))"
_METRIC_COLS = f"""
  count(*) AS n_rows,
  CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero_target,
  CAST(sum(CASE WHEN {_OK} THEN 0 ELSE 1 END) AS BIGINT) AS n_non_finite,
  sqrt(avg(CASE WHEN {_OK} THEN (y - prediction) * (y - prediction) END)) AS rmse,
  avg(CASE WHEN {_OK} THEN abs({_ieee_div('y - prediction', 'y')}) END) * 100 AS mape"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_ALL = (_STAR, _SAMPLE, _SETS)
_KEYS = "date, store_nbr, item_nbr"


def _pivot(by: str) -> str:
    # one aggregate a family: a dynamic PIVOT can't be stored as a view
    cols = ", ".join(f"round(avg(unit_sales) FILTER (family = '{v}'), 6) AS \"{v}\"" for v in FAMILIES)
    return _with(*_ALL) + f"\nSELECT {by}, {cols} FROM train GROUP BY {by}"


def _one_hot() -> str:
    # one column per value of the training vocabulary, for every test row
    cols = ", ".join(f"CAST(coalesce({c} = '{v}', false) AS INTEGER) AS \"{c}_{v}\""
                     for c, vs in (("state", STATES), ("type", TYPES), ("family", FAMILIES)) for v in vs)
    return _with(*_ALL, _NORM) + f"\nSELECT {_KEYS}, {cols} FROM ntest"


def _label_codes() -> str:
    joins, sel = [], []
    for c in ("state", "type", "family"):
        joins.append(f"JOIN (SELECT {c} AS v, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
                     f"FROM (SELECT DISTINCT {c} FROM ntrain)) e_{c} ON t.{c} = e_{c}.v")
        sel.append(f"e_{c}.code AS {c}")
    return (_with(*_ALL, _NORM) + f"\nSELECT t.date, t.store_nbr, t.item_nbr, {', '.join(sel)} FROM ntest t "
            + " ".join(joins))


def _feature_frame() -> str:
    enc = []
    joins = []
    for c in ("state", "type", "family"):
        joins.append(f"JOIN (SELECT {c} AS v, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS code "
                     f"FROM (SELECT DISTINCT {c} FROM ntrain)) e_{c} ON t.{c} = e_{c}.v")
        enc.append(f"e_{c}.code AS {c}")
    return (_with(*_ALL, _NORM) + f"""
SELECT t.date, t.store_nbr, t.item_nbr, {_r6('t.unit_sales')} AS unit_sales,
       {_status('t.unit_sales')} AS unit_sales_status,
       CAST(t.onpromotion AS INTEGER) AS onpromotion, {', '.join(enc)}, t.month, t.day_of_week,
       {IS_TRAIN} AS is_train
FROM ntrain t """ + " ".join(joins))


def _cv() -> str:
    parts = []
    for setting, keys in (("item_mean", ["item_nbr"]), ("item_weekday_mean", ["item_nbr", "day_of_week"])):
        on = " AND ".join(f"r.{k} = o.{k}" for k in keys)
        kl = ", ".join(keys)
        parts.append(f"""
  SELECT '{setting}' AS setting, r.fold, sqrt(avg((r.unit_sales - o.prediction) * (r.unit_sales - o.prediction))) AS rmse
  FROM rows r JOIN (
    SELECT pf.{kl.replace(', ', ', pf.')}, pf.fold,
           CASE WHEN t.n_all > pf.n_fold THEN (t.s_all - pf.s_fold) / (t.n_all - pf.n_fold) ELSE 0.0 END AS prediction
    FROM (SELECT {kl}, fold, sum(unit_sales) AS s_fold, count(*) AS n_fold FROM rows GROUP BY {kl}, fold) pf
    JOIN (SELECT {kl}, sum(unit_sales) AS s_all, count(*) AS n_all FROM rows GROUP BY {kl}) t
      ON {' AND '.join(f'pf.{k} = t.{k}' for k in keys)}) o
    ON {on} AND r.fold = o.fold
  GROUP BY r.fold""")
    return (_with(*_ALL, _NORM, f"\nrows AS (SELECT {_KEYS}, day_of_week, unit_sales, {FOLD} AS fold FROM ntrain)",
                  "\nscores AS (" + " UNION ALL ".join(parts) + ")")
            + "\nSELECT setting, count(*) AS n_folds, round(avg(rmse), 6) AS rmse_mean, "
              "round(stddev_pop(rmse), 6) AS rmse_std FROM scores GROUP BY setting")


_CURVE = f"""
crow AS (SELECT item_nbr, day_of_week, month, unit_sales, {IS_TRAIN} AS is_train FROM ntrain),
csum AS (SELECT item_nbr, day_of_week, month, sum(unit_sales) AS s, count(*) AS c
         FROM crow WHERE is_train GROUP BY item_nbr, day_of_week, month),
grown AS (SELECT f.item_nbr, f.day_of_week, CAST(r.iteration AS INTEGER) AS iteration,
                 sum(f.s) / sum(f.c) AS prediction
          FROM csum f JOIN range(1, 13) r(iteration) ON r.iteration >= f.month
          GROUP BY f.item_nbr, f.day_of_week, r.iteration),
curve AS (
  SELECT 'baseline_by_month' AS run, CAST(r.iteration AS INTEGER) AS iteration,
         sqrt(avg((v.unit_sales - coalesce(g.prediction, 0.0)) * (v.unit_sales - coalesce(g.prediction, 0.0)))) AS rmse
  FROM (SELECT * FROM crow WHERE NOT is_train) v
  CROSS JOIN range(1, 13) r(iteration)
  LEFT JOIN grown g ON g.item_nbr = v.item_nbr AND g.day_of_week = v.day_of_week AND g.iteration = r.iteration
  GROUP BY r.iteration)"""


def _fold_curves() -> str:
    """CTEs up to curves(setting, fold, iteration, rmse), row by row: every row is held
    against the mean of the other folds' rows of its group in months up to the iteration."""
    parts = []
    for setting, keys in (("item_mean", ["item_nbr"]), ("item_weekday_mean", ["item_nbr", "day_of_week"])):
        kl = ", ".join(keys)
        on = " AND ".join(f"v.{k} = g.{k}" for k in keys)
        parts.append(f"""
  SELECT '{setting}' AS setting, v.fold, CAST(r.iteration AS INTEGER) AS iteration,
         sqrt(avg((v.unit_sales - coalesce(g.prediction, 0.0)) * (v.unit_sales - coalesce(g.prediction, 0.0)))) AS rmse
  FROM frow v CROSS JOIN range(1, 13) r(iteration)
  LEFT JOIN (SELECT {kl}, h.fold, i.iteration, sum(s) / sum(c) AS prediction
             FROM (SELECT {kl}, month, fold AS own, sum(unit_sales) AS s, count(*) AS c FROM frow GROUP BY {kl}, month, fold) f
             JOIN range(0, 5) h(fold) ON h.fold <> f.own JOIN range(1, 13) i(iteration) ON i.iteration >= f.month
             GROUP BY {kl}, h.fold, i.iteration) g
    ON {on} AND g.fold = v.fold AND g.iteration = r.iteration
  GROUP BY v.fold, r.iteration""")
    return _with(*_ALL, _NORM, f"\nfrow AS (SELECT item_nbr, day_of_week, month, unit_sales, {FOLD} AS fold FROM ntrain)",
                 "\ncurves AS (" + " UNION ALL ".join(parts) + ")",
                 "\ncurve AS (SELECT setting AS run, iteration, avg(rmse) AS rmse, stddev_pop(rmse) AS rmse_std FROM curves GROUP BY 1, 2)")


def _cv_best(patience: int) -> str:
    return _fold_curves() + f""",
best AS (
  SELECT run, iteration, (min({{'v': rmse, 'i': iteration}}) OVER (PARTITION BY run ORDER BY iteration
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)).i AS best_iteration FROM curve),
stops AS (
  SELECT run, coalesce(min(CASE WHEN iteration - best_iteration >= {patience} THEN iteration END), max(iteration)) AS stop_iteration
  FROM best GROUP BY run)
SELECT s.run AS setting, b.best_iteration, round(c.rmse, 6) AS rmse_mean, round(c.rmse_std, 6) AS rmse_std
FROM stops s JOIN best b ON b.run = s.run AND b.iteration = s.stop_iteration
JOIN curve c ON c.run = b.run AND c.iteration = b.best_iteration"""


def _early_stop(patience: int) -> str:
    return _with(*_ALL, _NORM, _CURVE, """
best AS (
  SELECT run, iteration, rmse,
         (min({'v': rmse, 'i': iteration}) OVER (PARTITION BY run ORDER BY iteration
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)).i AS best_iteration
  FROM curve)""", f"""
stops AS (
  SELECT run, coalesce(min(CASE WHEN iteration - best_iteration >= {patience} THEN iteration END), max(iteration)) AS stop_iteration,
         count(*) AS n_iterations
  FROM best GROUP BY run)""") + """
SELECT s.run, s.stop_iteration, b.best_iteration, round(c.rmse, 6) AS best_rmse, s.n_iterations
FROM stops s JOIN best b ON b.run = s.run AND b.iteration = s.stop_iteration
JOIN curve c ON c.run = b.run AND c.iteration = b.best_iteration"""


def oracle_sql() -> dict:
    w = _with(*_ALL)
    wn = _with(*_ALL, _NORM)
    wb = _with(*_ALL, _NORM, _BASELINE)
    return {
        "scan_sales": _with(_STAR) + "\nSELECT * FROM sales",
        "scan_stores": _with(_STAR) + "\nSELECT * FROM stores",
        "scan_items": _with(_STAR) + "\nSELECT * FROM items",
        "sample_period": _with(_STAR) + "\nSELECT * FROM sales WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'",
        "sample_perishable": _with(_STAR, _SAMPLE) + "\nSELECT * FROM facts",
        "duplicate_keys": f"""
SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey AS INTEGER) AS store_nbr,
       CAST(l_partkey AS BIGINT) AS item_nbr, count(*) AS n
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1, 2, 3 HAVING count(*) > 1""",
        "grid": _with(_STAR, _SAMPLE) + "\nSELECT * FROM grid",
        "zero_fill": _with(_STAR, _SAMPLE) + "\nSELECT * FROM panel",
        "profile": _with(_STAR, _SAMPLE) + """
SELECT 'sampled' AS stage, count(*) AS rows, count(DISTINCT date) AS dates,
       count(DISTINCT store_nbr) AS stores, count(DISTINCT item_nbr) AS items FROM facts
UNION ALL
SELECT 'zero_filled', count(*), count(DISTINCT date), count(DISTINCT store_nbr), count(DISTINCT item_nbr) FROM panel""",
        "enrich_dims": _with(_STAR, _SAMPLE) + """
SELECT p.item_nbr, p.store_nbr, p.date, p.unit_sales, p.onpromotion,
       st.city, st.state, st.type, st.cluster, it.family, it.class, it.perishable
FROM panel p JOIN stores st ON p.store_nbr = st.store_nbr JOIN items it ON p.item_nbr = it.item_nbr""",
        "date_features": w + "\nSELECT * FROM train",
        "fill_missing": w + f"\nSELECT {_KEYS}, unit_sales, onpromotion FROM test",
        "head_tail": w + f"""
SELECT * FROM (SELECT {_KEYS}, unit_sales, onpromotion, family, 'head' AS part FROM train
               ORDER BY date, store_nbr, item_nbr LIMIT 5)
UNION ALL
SELECT * FROM (SELECT {_KEYS}, unit_sales, onpromotion, family, 'tail' AS part FROM train
               ORDER BY date DESC, store_nbr DESC, item_nbr DESC LIMIT 10)""",
        "calendar_names": w + "\nSELECT DISTINCT date, monthname(date) AS month_name, dayname(date) AS day_name FROM train",
        "item_stats": w + """
SELECT item_nbr, round(avg(unit_sales), 6) AS mean, round(stddev_samp(unit_sales), 6) AS std
FROM train GROUP BY item_nbr""",
        # oracle of the sparse form is the dense aggregate over the zero-filled rows
        "item_stats_sparse": w + """
SELECT item_nbr, round(avg(unit_sales), 6) AS mean, round(stddev_samp(unit_sales), 6) AS std
FROM train GROUP BY item_nbr""",
        "sales_by_family": w + "\nSELECT family, round(coalesce(sum(unit_sales), 0), 6) AS unit_sales_sum FROM train GROUP BY family",
        "month_by_family": w + "\nSELECT family, month, round(avg(unit_sales), 6) AS unit_sales_mean FROM train GROUP BY family, month",
        "dow_by_family": w + "\nSELECT family, day_of_week, round(avg(unit_sales), 6) AS unit_sales_mean FROM train GROUP BY family, day_of_week",
        "month_family_pivot": _pivot("month"),
        "dow_family_pivot": _pivot("day_of_week"),
        "normalise_train": wn + f"\nSELECT {_KEYS}, {_r6('unit_sales')} AS unit_sales, {_status('unit_sales')} AS unit_sales_status FROM ntrain",
        "normalise_test": wn + f"\nSELECT {_KEYS}, {_r6('unit_sales')} AS unit_sales, {_status('unit_sales')} AS unit_sales_status FROM ntest",
        "unseen_items": wn + f"\nSELECT {_KEYS}, unit_sales FROM test WHERE item_nbr NOT IN (SELECT item_nbr FROM stats)",
        "label_encode": _label_codes(),
        "one_hot": _one_hot(),
        "feature_frame": _feature_frame(),
        "split_80_20": w + f"\nSELECT {_KEYS}, {IS_TRAIN} AS is_train FROM train",
        "kfold_assign": w + f"\nSELECT {_KEYS}, {FOLD} AS fold FROM train",
        "segment_day": w + f"""
SELECT a.day_of_week, ({DAY_NAMES_SQL})[a.day_of_week + 1] AS day_name, a.train_rows, a.valid_rows,
       coalesce(b.test_rows, 0) AS test_rows
FROM (SELECT day_of_week, CAST(sum(CASE WHEN {IS_TRAIN} THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
             CAST(sum(CASE WHEN {IS_TRAIN} THEN 0 ELSE 1 END) AS BIGINT) AS valid_rows
      FROM train GROUP BY day_of_week) a
LEFT JOIN (SELECT day_of_week, count(*) AS test_rows FROM test GROUP BY day_of_week) b
  ON a.day_of_week = b.day_of_week""",
        "baseline_metrics": wb + f"""
SELECT 'baseline_item_weekday' AS run, n_rows, n_zero_target, n_non_finite,
       {_r6('rmse')} AS rmse, {_r6('mape')} AS mape, {_status('mape')} AS mape_status
FROM (SELECT {_METRIC_COLS} FROM scored)""",
        "metrics_rollup": wb + f"""
SELECT 'baseline_item_weekday' AS run, CASE WHEN g = 1 THEN -1 ELSE day_of_week END AS day_of_week,
       CASE WHEN g = 1 THEN 'all' ELSE ({DAY_NAMES_SQL})[day_of_week + 1] END AS segment,
       n_rows, n_zero_target, n_non_finite, {_r6('rmse')} AS rmse, {_r6('mape')} AS mape,
       {_status('mape')} AS mape_status
FROM (SELECT day_of_week, GROUPING(day_of_week) AS g, {_METRIC_COLS} FROM scored GROUP BY ROLLUP (day_of_week))""",
        "union_days": wb + f"\nSELECT {_KEYS}, day_of_week, {_r6('y')} AS y, {_r6('prediction')} AS prediction FROM scored",
        "denormalise": wb + f"""
SELECT s.date, s.store_nbr, s.item_nbr, round(t.unit_sales, 6) AS y_units,
       {_r6('s.prediction * coalesce(s.std, 0) + s.mean')} AS prediction_units
FROM scored s JOIN test t ON s.date = t.date AND s.store_nbr = t.store_nbr AND s.item_nbr = t.item_nbr""",
        "cv_summary": _cv(),
        "learning_curve": _with(*_ALL, _NORM, _CURVE) + f"\nSELECT run, iteration, 'valid' AS dataset, {_r6('rmse')} AS rmse FROM curve",
        "early_stop": _early_stop(3),
        "cv_curve": _fold_curves() + f"\nSELECT run AS setting, iteration, {_r6('rmse')} AS rmse_mean, {_r6('rmse_std')} AS rmse_std FROM curve",
        "cv_best": _cv_best(3),
        "cv_curve_wide": _fold_curves() + "\nSELECT setting AS run, iteration, " + ", ".join(
            f"max({_r6('rmse')}) FILTER (fold = {i}) AS fold{i}" for i in range(5)) + " FROM curves GROUP BY setting, iteration",
    }
