"""A new series from file to events: thresholds from its own first rows, decisions and explanations for the rest."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.functions import seq
from isobar.operators import detect
from isobar.operators.detect import ObservationSpec


def infer(df: DataFrame, spec: ObservationSpec, leading: int = 720, q: float = 0.995) -> tuple[DataFrame, DataFrame]:
    """(decisions, events) of the rows after each group's first `leading` ones, whose signals give its thresholds.

    Nothing of the later rows enters a threshold. A group with fewer rows has thresholds but no decisions.
    """
    keys, time = spec.keys, spec.time
    numbered = detect.compute_signals(df, spec).withColumn("_i", F.row_number().over(seq.ordered(keys, time)))
    wide = numbered.select(*keys, time, "_i", *[f"{c}__{s}" for c in spec.channels for s in detect.SIGNALS])
    long = detect.long_signals(wide, replace(spec)).join(wide.select(*keys, time, "_i"), [*keys, time])
    limits = detect.higher_quantile(long.where(F.col("_i") <= leading), [*keys, "channel", "signal"], "value", q)
    decisions = detect.decide(long.where(F.col("_i") > leading).join(limits, [*keys, "channel", "signal"]), keys, time)
    return decisions, detect.candidate_events(decisions, [*keys, "channel"], spec.cadence, time, ident=time)
