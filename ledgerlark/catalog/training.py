"""Queries over training-set preparation."""

from pyspark.sql import functions as F

from ..operators import metrics, training as T
from . import query
from .joins import TWIN_COLS, _twin_sides
from .shared import r

DIGEST = "md5(concat_ws(':', CAST(o_orderkey AS VARCHAR), '{seed}'))"
ORDERS = "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"


def _rank(seed: int, by: str) -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {DIGEST.format(seed=seed)}, o_orderkey) - 1"


@query("ml_load_train", f"""WITH b AS (SELECT {", ".join(TWIN_COLS)} FROM lineitem WHERE l_linestatus = 'O'),
 e AS (SELECT {", ".join(TWIN_COLS)} FROM lineitem x WHERE l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM b WHERE {" AND ".join(f"b.{c} = x.{c}" for c in TWIN_COLS)}))
 SELECT *, false AS is_original FROM b UNION ALL SELECT *, true FROM e""")
def _(t):
    base, extra = _twin_sides(t)
    out = T.load_train(base, [extra], "l_discount", drop=["l_orderkey"])
    return out.withColumn("l_quantity", F.trim("l_quantity").cast("double"))


@query("ml_stratified_sample", f"""SELECT o_orderkey, o_orderstatus FROM (SELECT *, {_rank(42, 'o_orderstatus')} AS rk, count(*) OVER (PARTITION BY o_orderstatus) AS n, count(*) OVER () AS total FROM orders)
 WHERE total <= 1000 OR rk < round(n * 1000 / total)""")
def _(t):
    return T.stratified_sample(t.raw("orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", 1000, ["o_orderkey"])


@query("ml_sample", f"SELECT o_orderkey FROM orders ORDER BY {DIGEST.format(seed=42)}, o_orderkey LIMIT 1000")
def _(t):
    return T.row_cap(t.raw("orders").select("o_orderkey"), 1000, ["o_orderkey"])


def _marked(t):
    """Urgent orders stand for rows of an original source."""
    return t.raw("orders").select(*ORDERS, (F.col("o_orderpriority") == "1-URGENT").alias(T.ORIGIN))


@query("ml_audit_split", f"""SELECT o_orderkey, o_orderstatus, NOT o AND rk < round(n * 1e-1) AS is_holdout FROM (SELECT *, {_rank(2025, 'o, o_orderstatus')} AS rk, count(*) OVER (PARTITION BY o, o_orderstatus) AS n
 FROM (SELECT *, o_orderpriority = '1-URGENT' AS o FROM orders))""")
def _(t):
    return T.audit_split(_marked(t), "o_orderstatus", True, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "is_holdout")


@query("ml_inner_split", f"""SELECT o_orderkey, NOT o AND rk < round(n * 2e-1) AS is_valid FROM (SELECT *, {_rank(7, 'o')} AS rk, count(*) OVER (PARTITION BY o) AS n
 FROM (SELECT *, o_orderpriority = '1-URGENT' AS o FROM orders))""")
def _(t):
    return T.inner_split(_marked(t), "o_totalprice", False, ["o_orderkey"], 7).select("o_orderkey", "is_valid")


FOLDS = f"""SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, CASE WHEN o THEN -1 ELSE rk % 5 END AS fold FROM (SELECT *, {_rank(42, 'o, o_orderstatus')} AS rk
 FROM (SELECT *, o_orderpriority = '1-URGENT' AS o FROM orders))"""


def _folds(t):
    return T.assign_folds(_marked(t), "o_orderstatus", 5, 42, True, ["o_orderkey"])


@query("ml_folds", f"SELECT o_orderkey, o_orderstatus, CAST(fold AS INT) AS fold FROM ({FOLDS}) AS f")
def _(t):
    return _folds(t).select("o_orderkey", "o_orderstatus", "fold")


@query("ml_mean_baseline", f"""WITH f AS ({FOLDS}), s AS (SELECT fold, sum(o_totalprice) AS s, count(*) AS n FROM f GROUP BY 1),
 m AS (SELECT fold, ((SELECT sum(s) FROM s) - s) / ((SELECT sum(n) FROM s) - n) AS mean FROM s WHERE fold >= 0)
 SELECT CAST(fold AS INT) AS fold, round(sqrt(avg(pow(o_totalprice - mean, 2))), 4) AS score FROM f JOIN m USING (fold) GROUP BY 1""")
def _(t):
    return r(metrics.mean_baseline(_folds(t), "o_totalprice", "rmse"), 4)


@query("ml_target_encode", f"""WITH f AS ({FOLDS}), c AS (SELECT o_orderstatus, fold, sum(o_totalprice) AS s, count(*) AS n FROM f GROUP BY 1, 2),
 k AS (SELECT o_orderstatus, sum(s) AS ks, sum(n) AS kn FROM c GROUP BY 1), g AS (SELECT fold, sum(s) AS fs, sum(n) AS fn FROM c GROUP BY 1),
 a AS (SELECT sum(fs) AS s, sum(fn) AS n FROM g)
 SELECT o_orderkey, round(CASE WHEN kn - c.n > 0 THEN (ks - c.s + 10 * (a.s - fs) / (a.n - fn)) / (kn - c.n + 10) ELSE (a.s - fs) / (a.n - fn) END, 3) AS o_orderstatus_encoded
 FROM f JOIN c USING (o_orderstatus, fold) JOIN k USING (o_orderstatus) JOIN g USING (fold), a""")
def _(t):
    out = T.target_encode(_folds(t), "o_orderstatus", "o_totalprice", 10.0)
    return r(out.select("o_orderkey", "o_orderstatus_encoded"), 3)


@query("ml_group_features", """SELECT l_orderkey, round(l_extendedprice / (l_quantity + 1e-9), 3) AS l_extendedprice_per_l_quantity, CAST(floor(l_extendedprice) AS BIGINT) % 10 AS d0,
 CAST(floor(floor(l_extendedprice) / 10) AS BIGINT) % 10 AS d1, CAST(floor(floor(l_extendedprice) / 100) AS BIGINT) % 10 AS d2, year(l_shipdate) AS y, month(l_shipdate) AS m, (dayofweek(l_shipdate) + 6) % 7 AS wd FROM lineitem""")
def _(t):
    out = T.feature_recipes(t.raw("lineitem"), ("l_extendedprice", "l_quantity"), "l_extendedprice", "l_shipdate")
    parts = [F.col(f"l_extendedprice_digit{i}").cast("long").alias(f"d{i}") for i in range(3)]
    dates = [F.col(f"l_shipdate_{p}").cast("long").alias(a) for p, a in (("year", "y"), ("month", "m"), ("weekday", "wd"))]
    return r(out.select("l_orderkey", "l_extendedprice_per_l_quantity", *parts, *dates), 3)
