"""The selection as a stateful streaming operator: one key, state kept between micro-batches.

Reads of a micro-batch are visited in the order of read_ix; batches in the order of arrival, so arrival has to follow read_ix
across batches (a folder of FASTQ files read with maxFilesPerTrigger does). No event time, no timers; output mode append.
"""

from __future__ import annotations

import pickle

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from longpath.operators.select import DECISION, Selection, fold
from longpath.plans.config import PathConfig


def select_stream(reads: DataFrame, config: PathConfig, rollover: bool = False) -> DataFrame:
    """Decisions about a stream of reads (read_ix, seq)."""

    def step(key, frames, state):
        selection = pickle.loads(state.get[0]) if state.exists else Selection(config, rollover=rollover)
        rows = pd.concat(list(frames)).sort_values("read_ix")
        found = fold(selection, [(int(r), s.encode()) for r, s in zip(rows["read_ix"], rows["seq"], strict=True)])
        state.update((pickle.dumps(selection),))
        yield pd.DataFrame(found, columns=[x.split()[0] for x in DECISION.split(", ")])

    keyed = reads.select(F.lit(0).alias("key"), "read_ix", "seq")
    return keyed.groupBy("key").applyInPandasWithState(step, DECISION, "state binary", "append", GroupStateTimeout.NoTimeout)
