"""Run-length encoding of arriving positions, with constant state a reference.

The state is the position before the open run, the run's position and its length.  Positions of a reference arrive in order from batch to batch;
within one they may come in any order.  A row without position closes the open run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "ref_id int, pos int, delta int, mult long"


def enable(spark: SparkSession) -> None:
    """Stateful processors need the state store that keeps typed variables."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Runs(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "before int, pos int, mult long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat([r["pos"] for r in rows])
        ends = bool(got.isna().any())
        at, n = np.unique(got.dropna().to_numpy().astype(np.int64), return_counts=True)
        before = 0
        if self.state.exists():
            before, pos, mult = self.state.get()
            if len(at) and at[0] < pos:
                raise ValueError(f"reference {key[0]}: position {at[0]} came after {pos}")
            if len(at) and at[0] == pos:
                n[0] += mult
            else:
                at, n = np.concatenate([[pos], at]), np.concatenate([[mult], n])
        if not len(at):
            return
        delta = np.diff(at, prepend=before)
        done = len(at) if ends else len(at) - 1
        if ends:
            self.state.clear()
        else:
            self.state.update((int(at[-1] - delta[-1]), int(at[-1]), int(n[-1])))
        yield pd.DataFrame({"ref_id": np.full(done, key[0], np.int32), "pos": at[:done].astype(np.int32), "delta": delta[:done].astype(np.int32), "mult": n[:done]})

    def close(self) -> None:
        pass


def offset_runs(stream: DataFrame) -> DataFrame:
    """(ref_id, pos, delta, mult) of a stream of (ref_id, pos): a run comes out once it is closed."""
    return stream.select("ref_id", "pos").groupBy("ref_id").transformWithStateInPandas(Runs(), OUT, "Append", "None")
