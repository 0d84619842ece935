"""Live block decisions: an extension, the batch operators being the measure.

Rows later than the watermark are dropped here, while a batch sees all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echolith.functions.scalars import decide, decision_score


def block_decisions(stream: DataFrame, ts: str, width: str, classes: list[str], min_score: float, late: str = "10 minutes") -> DataFrame:
    """Decisions of tumbling blocks of a stream of wide probabilities; duplicates within the watermark count once."""
    once = stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(["detection_id"])
    block = once.groupBy(F.window(ts, width)).agg(*(F.avg(c).alias(c) for c in classes), F.count("*").alias("n"))
    probs = [F.col(c) for c in classes]
    return block.select("window", "n", *classes, decision_score(probs).alias("score"), decide(probs, classes, min_score).alias("decision"))


def sessions(stream: DataFrame, ts: str, gap: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Runs of point events with gaps of less than gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
