"""Record scoring as a stream (X2): records arriving as files in a folder
are scored micro-batch by micro-batch with the same stateless projection as
batch scoring (``plans.train.score``), so every streamed row equals its
batch-scored row. No state, so no watermark is needed; the checkpoint
location makes the query restartable after a failure."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

from dsengine.plans.train import ScoringBundle, score
from dsengine.session import work_path

#: Most records of a dropped file, about: a task deals, reads and scores that many.
FILE_ROWS = 1 << 19


def start_scoring_stream(bundle: ScoringBundle, spark, source_dir: str, schema,
                         sink_dir: str, checkpoint_dir: str, fmt: str = "parquet",
                         available_now: bool = True, id_col: str | None = None):
    """readStream(source_dir) -> score -> writeStream(sink_dir)."""
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(source_dir) if fmt == "parquet" else reader.json(source_dir)
    return _start(bundle, stream, sink_dir, checkpoint_dir, available_now, id_col)


def _start(bundle, stream, sink_dir, checkpoint_dir, available_now, id_col):
    if "train" in bundle.model.extra:
        # neighbours need a ranking, which a stream has not: each micro-batch
        # is scored as a table and written to its own folder, so a repeated
        # batch replaces its rows
        def each(batch, number):
            score(bundle, batch, id_col=id_col).write.mode("overwrite").parquet(f"{sink_dir}/__batch={number}")

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_dir)
    else:
        scored = score(bundle, stream, id_col=id_col)
        writer = (scored.writeStream.format("parquet").option("path", sink_dir)
                  .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def _dealt(records: DataFrame, files: int) -> DataFrame:
    """``records`` in ``files`` parts, or more where those would hold over ``FILE_ROWS``."""
    return records.repartition(max(files, math.ceil(records.count() / FILE_ROWS)))


def score_stream(bundle: ScoringBundle, records: DataFrame, id_col: str | None = None,
                 files: int = 4) -> DataFrame:
    """Drop ``records`` as files into a fresh source folder, run the
    streaming scorer to completion (availableNow) and return the scored
    rows read back from the sink."""
    spark = records.sparkSession
    src, sink, ckpt = (work_path(spark, "stream-src"), work_path(spark, "stream-out"),
                       work_path(spark, "stream-ckpt"))
    _dealt(records, files).write.mode("overwrite").parquet(src)
    q = start_scoring_stream(bundle, spark, src, records.schema, sink, ckpt, id_col=id_col)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("__batch")


def score_json_stream(bundle: ScoringBundle, records: DataFrame, id_col: str | None = None,
                      files: int = 4) -> DataFrame:
    """Record scoring from JSON text (one record per line, as a request
    body would carry it): ``readStream.text`` -> ``from_json`` with the
    training input schema -> the same stateless scoring projection."""
    from pyspark.sql import functions as F

    spark = records.sparkSession
    src, sink, ckpt = (work_path(spark, "json-src"), work_path(spark, "json-out"),
                       work_path(spark, "json-ckpt"))
    schema = records.schema
    lines = records.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in records.columns])).alias("value"))
    _dealt(lines, files).write.mode("overwrite").text(src)
    parsed = (spark.readStream.text(src)
              .select(F.from_json("value", schema).alias("r")).select("r.*"))
    q = _start(bundle, parsed, sink, ckpt, True, id_col)
    q.awaitTermination()
    return spark.read.parquet(sink).drop("__batch")
