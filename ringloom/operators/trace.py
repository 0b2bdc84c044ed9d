"""Step-by-step traces of decoding, as rows of a token table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ringloom.functions.scalar import ring_position


def steps(tokens: DataFrame, payload_start: int = 0, limit: int | None = 500) -> DataFrame:
    """tokens(file, token_idx, is_match, lit, pos, len, len_eff, input_pos) -> a step for each flag byte, literal and match.

    A flag byte comes before each eighth token; offsets are those of the payload behind ``payload_start``. ``limit`` is the number of steps
    that a viewer shows for a file; None gives all.
    """
    w = Window.partitionBy("file").orderBy("token_idx").rowsBetween(Window.unboundedPreceding, -1)
    size = F.when(F.col("is_match"), 2).otherwise(1)
    at = F.coalesce(F.sum(size).over(w), F.lit(0)) + F.floor(F.col("token_idx") / 8) + payload_start
    t = tokens.withColumn("at", at)
    token = F.struct(
        F.lit(1).alias("part"),
        F.when(F.col("is_match"), "match").otherwise("literal").alias("kind"),
        (F.col("at") + 1).alias("data_offset"),
        size.alias("data_length"),
        F.when(F.col("is_match"), F.pmod(ring_position(F.col("input_pos")) - F.col("pos"), F.lit(4096))).alias("distance"),
        F.when(F.col("is_match"), F.col("len")).alias("length"),
        F.when(~F.col("is_match"), F.col("lit")).alias("palette_index"),
        (F.col("input_pos") + F.col("len_eff")).cast("long").alias("pixels_decoded"),
    )
    flag = F.struct(F.lit(0).alias("part"), F.lit("flag").alias("kind"), F.col("at").alias("data_offset"), F.lit(1).alias("data_length"), F.lit(None).cast("int").alias("distance"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("int").alias("palette_index"), F.col("input_pos").cast("long").alias("pixels_decoded"))
    parts = F.when(F.col("token_idx") % 8 == 0, F.array(flag, token)).otherwise(F.array(token))
    rows = t.select("file", "token_idx", ring_position(F.col("input_pos")).alias("ring_position"), F.explode(parts).alias("p")).select("file", "token_idx", "ring_position", "p.*")
    rows = rows.withColumn("step_number", F.row_number().over(Window.partitionBy("file").orderBy("token_idx", "part")) - 1).drop("part")
    return rows if limit is None else rows.where(F.col("step_number") < limit)


def seek(trace: DataFrame, file: str, number: int, by: int = 0) -> DataFrame:
    """The step ``by`` steps from ``number``, held within the trace."""
    last = trace.where(F.col("file") == file).agg(F.max("step_number").alias("last"))
    to = F.greatest(F.lit(0), F.least(F.lit(number + by), F.col("last")))
    return trace.where(F.col("file") == file).join(last, F.col("step_number") == to).drop("last")


def progress(done, total):
    """Share of the pixels that are decoded, 0 for an empty image."""
    return F.when(total == 0, 0.0).otherwise(done / total)
