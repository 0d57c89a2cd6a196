"""Runs of consecutive equal events collapsed into one event each.

The order within a run is cut into chunks of `chunk` positions, so that one run of any size is spread over many
tasks. Within a chunk a lag window flags changes and a running sum of flags names the stretches; only the first and
last stretch of each chunk can go on in a neighbour, and only those meet again in a second lag window per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import micros

#: Characters that stand for Latin letters in hand-written levels.
LOOKALIKES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "|": "l", "а": "a", "е": "e", "о": "o", "у": "y", "г": "r"}


def level_of(c: Column) -> Column:
    """red, yellow or null of a level written by hand: any case, width, spacing and punctuation, lookalike
    characters, two letters swapped, and one (red) or two (yellow) letters missing, added or wrong."""
    wide = "".join(chr(0xFF01 + i) for i in range(94))
    plain = "".join(chr(0x21 + i) for i in range(94))
    s = F.lower(F.translate(c, wide, plain))
    s = F.regexp_replace(F.translate(s, "".join(LOOKALIKES), "".join(LOOKALIKES.values())), "[^a-z]", "")

    def near(word: str, edits: int) -> Column:
        swapped = F.array_sort(F.split(s, "")) == F.array(*[F.lit(x) for x in sorted(word)])
        return (F.levenshtein(s, F.lit(word)) <= edits) | swapped

    return F.when(s == "", None).when(near("yellow", 2), "yellow").when(near("red", 1), "red")


def collapse_runs(
    events: DataFrame, level: Column, run: str = "run_id", position: str = "start_window_idx", event: str = "episode_id", start: str = "start_time", end: str = "end_time", reach: int = 6, chunk: int = 4096
) -> DataFrame:
    """(run_id, level, first_idx, last_idx, n_events, start_us, end_us, duration_s): a row per maximal stretch.

    Events of a run are ordered by position, then event id. A stretch is of neighbouring events of the same level,
    each at most `reach` positions after the one before; an event without a level is a stretch of its own, with a
    null level. Events without run, position or id don't count; rows of one event id and position count once (the
    larger of each field). The duration spans from the earliest start to the latest end; null where either is.
    An empty table gives no rows. Only the named columns are read.
    """
    rows = events.select(
        F.col(run).alias("run_id"), F.col(position).cast("long").alias("idx"), F.col(event).alias("event"), level.alias("level"), micros(events, start).alias("s"), micros(events, end).alias("e")
    ).where("run_id IS NOT NULL AND idx IS NOT NULL AND event IS NOT NULL")
    rows = rows.withColumn("chunk", F.floor(F.col("idx") / chunk))
    # Copies are neighbours in the order, so they're dropped behind the same shuffle and sort.
    order = Window.partitionBy("run_id", "chunk").orderBy("idx", "event", F.col("level").desc_nulls_last(), F.col("s"), F.col("e"))
    once = rows.withColumn("copy", (F.lag("event").over(order) == F.col("event")) & (F.lag("idx").over(order) == F.col("idx"))).where("copy IS NULL OR NOT copy")
    goes_on = (F.col("level") == F.lag("level").over(order)) & (F.col("idx") - F.lag("idx").over(order) <= reach)
    flagged = once.withColumn("opens", F.when(goes_on, 0).otherwise(1))
    local = (
        flagged.withColumn("seg", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("run_id", "chunk", "seg")
        .agg(F.max("level").alias("level"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"), F.min("s").alias("s"), F.max("e").alias("e"))
    )
    by_seg = Window.partitionBy("run_id", "chunk").orderBy("seg")
    edged = local.withColumn("is_first", F.col("seg") == 1).withColumn("is_last", F.lead("seg").over(by_seg).isNull())
    # Stretches inside a chunk are complete and keep to their chunk; the outer ones of all chunks of a run meet.
    meet = edged.withColumn("part", F.when(F.col("is_first") | F.col("is_last"), None).otherwise(F.col("chunk")))
    across = Window.partitionBy("run_id", "part").orderBy("chunk", "seg")
    joined = (
        F.col("is_first")
        & F.lag("is_last").over(across)
        & (F.lag("chunk").over(across) < F.col("chunk"))
        & (F.lag("level").over(across) == F.col("level"))
        & (F.col("first_idx") - F.lag("last_idx").over(across) <= reach)
    )
    return (
        meet.withColumn("opens", F.when(joined, 0).otherwise(1))
        .withColumn("stretch", F.sum("opens").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("run_id", "part", "stretch")
        .agg(F.max("level").alias("level"), F.min("first_idx").alias("first_idx"), F.max("last_idx").alias("last_idx"), F.sum("n").alias("n_events"), F.min("s").alias("start_us"), F.max("e").alias("end_us"))
        .select("run_id", "level", "first_idx", "last_idx", "n_events", "start_us", "end_us", F.expr("(end_us - start_us) div 1000000").alias("duration_s"))
    )
