"""Mates that arrive in any order, paired and merged while they stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.operators import merge

#: Groups of mates, by hash of their id; each has one state.
GROUPS = 200


def _paired(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Pairs of what has come and what was held; what is still without its mate is held, nothing else is."""
    held = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
    rows = pd.concat([*held, *[f[["id", "seq", "side"]] for f in frames]], ignore_index=True)
    # the nth read of an id is the mate of the nth read of that id on the other side
    rows["nth"] = rows.groupby(["id", "side"]).cumcount()
    sides = [rows[rows["side"] == side] for side in (1, 2)]
    both = sides[0].merge(sides[1], on=["id", "nth"], suffixes=("", "2"))
    known = pd.MultiIndex.from_frame(both[["id", "nth"]])
    rest = rows[~pd.MultiIndex.from_frame(rows[["id", "nth"]]).isin(known)].drop(columns="nth")
    if len(rest):
        table, sink = pa.Table.from_pandas(rest, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        state.update((sink.getvalue().to_pybytes(),))
    elif state.exists:
        state.remove()
    yield both[["id", "seq", "seq2"]]


def pair_stream(r1: DataFrame, r2: DataFrame, groups: int = GROUPS) -> DataFrame:
    """(id, seq, seq2) of two streams of reads (id, seq), each pair once both mates have come.

    A mate that came first is held in its group's state, and leaves it with the pair. Rows without an id or a sequence are
    left out.
    """
    side = lambda df, n: df.select("id", "seq", F.lit(n).alias("side"))
    both = side(r1, 1).unionByName(side(r2, 2)).filter("id is not null and seq is not null")
    grouped = both.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).groupBy("group")
    return grouped.applyInPandasWithState(
        _paired, "id string, seq string, seq2 string", "held binary", "append", GroupStateTimeout.NoTimeout
    )


def merge_stream(r1: DataFrame, r2: DataFrame, padding: int = 0, groups: int = GROUPS) -> DataFrame:
    """merge_pairs() of the mates of two streams."""
    return merge.merge_pairs(pair_stream(r1, r2, groups), padding)
