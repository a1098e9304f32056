"""Feature steps as a stream: which definitions each one reaches as it arrives, and how many reach none.

Definitions are a static table, so matching keeps no state; counts by time window do, and a watermark bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepweave.functions.matchers import jvm_expression


def reached(steps: DataFrame, prepared: DataFrame) -> DataFrame:
    """The stream ``steps`` (at timestamp, text, ..) with ``members``, the ids of all authoritative definitions that accept a text.

    Expressions are joined by the stream's distinct leading words where they have one, as ``text_matches`` does for tables,
    except that a text is matched once for each time it arrives.
    """
    own = prepared.where("expression is not null and authoritative").select(F.struct("def_id", jvm_expression(F.col("expression")).alias("rx")).alias("d"))
    patterns = own.agg(F.array_sort(F.collect_list("d")).alias("patterns"))  # one row: a project's definitions
    members = F.transform(F.filter("patterns", lambda p: F.rlike(F.col("text"), p["rx"])), lambda p: p["def_id"])
    return steps.crossJoin(F.broadcast(patterns)).withColumn("members", members).drop("patterns")


def windowed(matched: DataFrame, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Per window of ``at``: steps, those that no definition accepts, and those that several do."""
    by = F.window("at", width).alias("window")
    size = F.size("members")
    return matched.withWatermark("at", late).groupBy(by).agg(F.count("*").alias("n_steps"), F.count_if(size == 0).alias("n_undefined"), F.count_if(size > 1).alias("n_ambiguous"))
