"""Applies and stateless operators on file streams: the same rows as the batch queries give."""

from pyspark.sql import functions as F

from ..operators import columns as columns_op
from ..operators import features as features_op
from ..operators import models as models_op
from ..operators import rows as rows_op
from ..operators import splits as splits_op
from ..streaming import read_stream, run_available, stream_duplicates_dropped
from .catalog import query, table
from .features import TIME


def _stream(spark, sf_dir, name):
    return read_stream(spark, sf_dir, table(spark, sf_dir, name).schema, files=f"{name}.parquet")


@query("stream_filter", "SELECT * FROM events WHERE event_type IN ('click', 'error')")
def stream_filter(spark, sf_dir):
    events = _stream(spark, sf_dir, "events")
    return run_available(events, lambda s: rows_op.filter_rows(s, "event_type", "isin", ["click", "error"]))


GAPS = "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_type END AS event_type FROM {events}"


@query(
    "stream_fill_encode",
    f"""
WITH g AS ({GAPS}), v AS (SELECT median(value) AS m FROM g),
t AS (SELECT event_type AS m FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
d AS (SELECT event_id, coalesce(value, v.m) AS value, coalesce(event_type, t.m) AS event_type FROM g, v, t)
SELECT event_id, value, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS event_type_error, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS event_type_purchase,
  CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS event_type_signup, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS event_type_view FROM d""",
)
def stream_fill_encode(spark, sf_dir):
    def gaps(df):
        value = F.when(F.col("event_id") % 9 != 0, F.col("value"))
        kind = F.when(F.col("event_id") % 8 != 0, F.col("event_type"))
        return df.select("event_id", value.alias("value"), kind.alias("event_type"))

    batch = gaps(table(spark, sf_dir, "events"))
    fill = columns_op.fit_fill(batch, "event_id")
    encoding = features_op.fit_encoding(columns_op.apply_fill(batch, fill), "event_id")
    return run_available(
        _stream(spark, sf_dir, "events"),
        lambda s: features_op.apply_encoding(columns_op.apply_fill(gaps(s), fill), encoding),
    )


@query(
    "stream_clip_scale",
    """
WITH c AS (SELECT event_id, CASE WHEN value > 30 THEN 30 ELSE value END AS value FROM events),
m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM c) SELECT event_id, round((value - a) / s, 8) AS value FROM c, m""",
)
def stream_clip_scale(spark, sf_dir):
    batch = table(spark, sf_dir, "events").select("event_id", "value")
    clip = columns_op.fit_clip(batch, "value", upper=30)
    scaler = splits_op.fit_scaler(columns_op.apply_clip(batch, clip), ["value"])
    out = run_available(
        _stream(spark, sf_dir, "events").select("event_id", "value"),
        lambda s: splits_op.apply_scaler(columns_op.apply_clip(s, clip), scaler),
    )
    return out.withColumn("value", F.round("value", 8))


@query(
    "stream_datetime_parts",
    f"SELECT event_id, CAST(year({TIME}) AS double) AS ts_text_year, CAST(month({TIME}) AS double) AS ts_text_month, CAST(day({TIME}) AS double) AS ts_text_day, CAST(isodow({TIME}) - 1 AS double) AS ts_text_dayofweek FROM {{event_times}}",
)
def stream_datetime_parts(spark, sf_dir):
    text = F.when(F.col("event_id") % 17 == 0, "not a date").when(F.col("event_id") % 19 != 0, F.date_trunc("second", "ts").cast("string"))
    stream = _stream(spark, sf_dir, "events").select("event_id", text.alias("ts_text"))
    out = run_available(stream, lambda s: features_op.datetime_parts(s, "ts_text"))
    return out.select("event_id", *[F.col(c).cast("double").alias(c) for c in out.columns if c != "event_id"])


@query("stream_drop_duplicates", "SELECT DISTINCT user_id, event_type, date_trunc('day', ts) AS day FROM events")
def stream_drop_duplicates(spark, sf_dir):
    days = _stream(spark, sf_dir, "events").select("user_id", "event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))
    # Watermarks need a zoned timestamp; the day itself is part of the key.
    timed = days.withColumn("seen_at", F.col("day").cast("timestamp"))
    out = run_available(stream_duplicates_dropped(timed, "seen_at", "3650 days", ["user_id", "event_type", "day"]))
    return out.drop("seen_at")


@query("stream_merge_static", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def stream_merge_static(spark, sf_dir):
    from ..operators.joins import merge_tables

    out = run_available(
        _stream(spark, sf_dir, "orders"),
        lambda s: merge_tables(s, table(spark, sf_dir, "customer"), left_on="o_custkey", right_on="c_custkey"),
    )
    return out.select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("stream_score")
def stream_score(spark, sf_dir):
    """A model fitted on the batch table scores the stream."""
    batch = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    target = F.when(F.col("value") > 20, 1).otherwise(0)
    spec = models_op.make_spec(
        batch.withColumn("high", target), "high", "logistic_regression", "classification", ["user_id", "event_id"], scale=True
    )
    model = models_op.fit_model(batch.withColumn("high", target), spec)
    out = run_available(_stream(spark, sf_dir, "events").select("event_id", "user_id"), lambda s: models_op.score(model, s))
    return out.select("event_id", "prediction", F.round("probability", 4).alias("probability"))
