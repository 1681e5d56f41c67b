"""Crediting entries by a session's verdicts: a state machine on a stream, and the same over a table.

The first verdict of a session credits each entry that the session had retrieved until then, at most
MOST of them. Later verdicts only turn the revert of the same entries on or off; the same verdict
again changes nothing. So what counts in the end is what was retrieved before the first verdict, and the last verdict.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

MOST = 12
_OUT = "sess string, entry long, use long, reverted long"
_STATE = "ids array<long>, verdict int"


def credits_of_table(events: DataFrame) -> DataFrame:
    """sess, entry, use, reverted from rows (sess, id, entry, passed): a retrieval has an entry, a verdict has passed."""
    w = W.partitionBy("sess")
    first = F.min(F.when(F.col("passed").isNotNull(), F.col("id"))).over(w)
    last = F.max(F.when(F.col("passed").isNotNull(), F.struct("id", "passed"))).over(w)
    seen = events.withColumns({"first": first, "last": last}).where("entry is not null and id < first")
    once = seen.groupBy("sess", "entry").agg(F.min("id").alias("id"), F.first("last").alias("last"))
    place = F.row_number().over(W.partitionBy("sess").orderBy("id"))
    kept = once.withColumn("place", place).where(F.col("place") <= MOST)
    return kept.select("sess", "entry", F.lit(1).cast("long").alias("use"), F.when(F.col("last.passed"), 0).otherwise(1).cast("long").alias("reverted"))


def credits_of_stream(stream: DataFrame) -> DataFrame:
    """The changes sess, entry, use, reverted as they come; their sums are what credits_of_table() gives."""

    def run(key, frames, state):
        ids, verdict = state.get if state.exists else ([], None)
        ids, out = list(ids), []
        # plain lists: sessions are short and many, and a frame's own sorting and rows cost more than the work
        rows = [r for f in frames for r in zip(f["id"].tolist(), f["entry"].tolist(), f["passed"].tolist(), strict=True)]
        for _, entry, passed in sorted(rows, key=lambda r: r[0]):
            if passed is not None and passed == passed:
                now = int(passed)
                if verdict is None:
                    out += [(key[0], i, 1, 1 - now) for i in ids]
                elif verdict != now:
                    out += [(key[0], i, 0, verdict - now) for i in ids]
                verdict = now
            elif verdict is None and entry == entry and entry is not None and int(entry) not in ids and len(ids) < MOST:
                ids.append(int(entry))
        state.update((ids, verdict))
        if out:
            yield pd.DataFrame(out, columns=["sess", "entry", "use", "reverted"])

    # a row that is neither a retrieval nor a verdict changes no state
    some = stream.select("sess", "id", "entry", "passed").where("entry is not null or passed is not null")
    return some.groupBy("sess").applyInPandasWithState(run, _OUT, _STATE, "append", "NoTimeout")
