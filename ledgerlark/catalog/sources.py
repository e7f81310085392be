"""Queries over sources and sinks. Files are written to and read from a work folder of the session."""

from pyspark.sql import functions as F

from ..functions import arrays
from ..session import work_dir
from ..sources import files, ledger
from . import query
from .shared import r


@query("src_csv", "SELECT * FROM orders")
def _(t):
    orders = t.raw("orders")
    path = work_dir(t.spark) + "/train"
    orders.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return files.read_table(t.spark, path, orders.schema)


@query("src_path", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    path = ledger.resolve_path(None, "orders.parquet", local_root=t.dir)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("src_parquet", "SELECT * FROM customer")
def _(t):
    return files.write_snapshot(t.raw("customer"), work_dir(t.spark) + "/snapshot")


@query("src_ledger", """SELECT CAST(attempt_id AS VARCHAR) AS attempt_id, CAST(competition_id AS VARCHAR) AS competition_id, run_ts, stage, cv_score, label, lb_score
 FROM (SELECT * REPLACE (CAST(NULL AS DOUBLE) AS lb_score) FROM attempts)""")
def _(t):
    root = work_dir(t.spark)
    cols = ["run_ts", "stage", "cv_score", "label", "fold_scores"]
    t.attempts.select(F.col("attempt_id").cast("string"), F.col("competition_id").cast("string"), *cols).write.parquet(f"{root}/attempts")
    return ledger.Ledger(t.spark, root).attempts.select("attempt_id", "competition_id", "run_ts", "stage", "cv_score", "label", "lb_score")


@query("src_json_cols", "SELECT event_id, CAST(props->>'$.k' AS INT) AS k FROM events")
def _(t):
    return ledger.decode_json(t.raw("events").select("event_id", "props"), {"props": "struct<k:int>"}).select("event_id", "props.k")


@query("src_leaderboard", """SELECT competition_id, count(*) AS n_teams, round(sum(score), 4) AS total FROM (SELECT c_nationkey AS competition_id,
 TRY_CAST(CASE WHEN c_custkey % 7 = 0 THEN 'n/a' ELSE CAST(c_acctbal AS VARCHAR) END AS DOUBLE) AS score FROM customer) WHERE score IS NOT NULL GROUP BY 1""")
def _(t):
    text = F.when(F.col("c_custkey") % 7 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    rows = t.raw("customer").select(F.col("c_nationkey").alias("competition_id"), text.alias("Score"))
    scores = files.leaderboard_scores(rows)
    return r(scores.groupBy("competition_id").agg(F.count(F.lit(1)).alias("n_teams"), F.sum("score").alias("total")), 4)


@query("src_listing", """SELECT concat('auto ', o_orderpriority) AS description, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'error' ELSE 'pending' END AS state,
 CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH' THEN o_totalprice END AS score FROM orders WHERE o_orderpriority <> '1-URGENT'""")
def _(t):
    status = F.expr("CASE o_orderstatus WHEN 'F' THEN 'SubmissionStatus.COMPLETE' WHEN 'O' THEN 'SubmissionStatus.ERROR' ELSE 'SubmissionStatus.PENDING' END")
    score = F.when(F.col("o_orderpriority") == "2-HIGH", "").otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", F.concat(F.lit(" auto "), "o_orderpriority"), status, score)
    noisy = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("Warning: looks like a newer version")).otherwise(line)
    return files.parse_submission_listing(t.raw("orders").select(noisy.alias("value"))).select("description", "state", "score")


@query("snk_submission", "SELECT o_orderkey AS id, o_totalprice / 2e0 AS price FROM orders")
def _(t):
    preds = t.raw("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 2.0).alias("p"))
    path = work_dir(t.spark) + "/submission"
    out = files.write_predictions(preds, "id", "p", "target", path, sample_columns=["id", "price"])
    return files.read_table(t.spark, path, out.schema)


@query("snk_json_numbers", """SELECT attempt_id, len(fold_scores) AS n, CASE WHEN fold_scores IS NOT NULL THEN CASE WHEN label = 'jump' THEN 1 ELSE 0 END END AS nulls FROM attempts WHERE fold_scores IS NOT NULL""")
def _(t):
    bad = F.when(F.col("label") == "jump", F.lit(float("nan"))).otherwise(F.lit(1.0))
    rows = t.attempts.filter("fold_scores IS NOT NULL")
    folds = F.transform(F.col("fold_scores"), lambda x, i: F.when(i == 0, x * bad).otherwise(x))
    text = rows.select("attempt_id", ledger.to_json_numbers(folds).alias("j"))
    back = F.from_json("j", "array<double>")
    return text.select("attempt_id", F.size(back).cast("long").alias("n"), F.size(F.filter(back, lambda x: x.isNull())).alias("nulls"))


SEP = "# ----"


@query("snk_header_strip", """SELECT doc_id, sha256(regexp_replace(CASE WHEN doc_id % 2 = 0 OR instr(text, '# ----' || chr(10)) = 0 THEN text ELSE substr(text, instr(text, '# ----' || chr(10)) + 7) END, '^[ \\n\\r\\t\\x0B\\f]+|[ \\n\\r\\t\\x0B\\f]+$', '', 'g')) AS body FROM documents""")
def _(t):
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(f"# id: 1\n{SEP}\n"), "text")).otherwise(F.col("text"))
    return t.raw("documents").select("doc_id", F.sha2(files.strip_header(head, SEP), 256).alias("body"))
