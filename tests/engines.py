"""An operator by Spark and its text by the checking engine, over the same rows."""

import duckdb
import pyarrow as pa

from notegrain.plans.ops import apply
from notegrain.queries import OPS

NOTES = "song bigint, idx bigint, start bigint, dur bigint, chan int, pitch bigint, vel bigint"


def both(spark, name, **inputs):
    """Sorted rows of either; ``inputs``: name -> (rows, schema)."""
    op = OPS[name]
    frames = {k: spark.createDataFrame(rows, schema) for k, (rows, schema) in inputs.items()}
    got = apply(op, **frames)
    with duckdb.connect() as db:
        for k, f in frames.items():
            db.register(k, f.toArrow() if f.columns else pa.table({}))
        want = db.sql((op.check or op.sql).format(**{k: k for k in inputs}))
        columns, rows = want.columns, want.fetchall()
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    return order(got.select(*columns).collect()), order(rows), got


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
