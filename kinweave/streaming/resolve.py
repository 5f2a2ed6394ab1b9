"""Incremental resolution: records that arrive in a stream are matched against fixed queries, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from kinweave.operators import linkage as L


def resolve_stream(arriving: DataFrame, queries: DataFrame, score: Callable[[DataFrame], DataFrame], rule: L.Rule, path: str, checkpoint: str, max_block: int = 300) -> StreamingQuery:
    """Write the pairs that ``rule`` keeps for each batch of arriving pool records (id, country, name, addr, src).

    ``score`` adds ``p`` and ``src`` to candidate pairs (q_id, p_id) of the prepared batch. Each batch writes its own
    folder, so a repeated batch replaces its rows.
    """
    own = L.block_keys(queries)

    def batch(records: DataFrame, number: int) -> None:
        pool = L.prepared(records)
        pairs = L.key_join(own, L.block_keys(pool), max_block).select("q_id", "p_id").distinct()
        both = L.with_records(pairs, queries, pool, L.MEASURED).join(pool.select(pool["id"].alias("p_id"), "src"), "p_id")
        L.decide(score(L.pair_measures(both)), rule).select("q_id", "p_id", "src", "p").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return arriving.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
