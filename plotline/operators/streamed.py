"""Digests of ordered rows, streamed.

A digest over all rows of a key is one chain: it cannot be combined from parts. Rows are
dealt by key and sorted inside each partition, and a task feeds them to one hash state as
they pass, so it holds a batch of rows and a state, never a key's rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digests(rows: DataFrame, key: str, order: list[Column], piece: Column, name: str, algorithm: str = "sha256") -> DataFrame:
    """(key, name): the hex digest over the UTF-8 bytes of all pieces of a key in their order; null pieces add nothing."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import hashlib

        import numpy as np
        now, state = None, None
        for batch in batches:
            keys, pieces = batch.column(0), batch.column(1)
            if not len(keys):
                continue
            pieces = pieces.fill_null("") if pieces.null_count else pieces
            wide = pa.types.is_large_string(pieces.type)
            ends = np.frombuffer(pieces.buffers()[1], np.int64 if wide else np.int32)[pieces.offset:pieces.offset + len(pieces) + 1]
            data = memoryview(pieces.buffers()[2] or b"")
            held = keys.to_pylist()
            firsts = [i for i in range(len(held)) if i == 0 or held[i] != held[i - 1]]
            done = []
            for a, b in zip(firsts, [*firsts[1:], len(held)]):
                if state is None or held[a] != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = held[a], hashlib.new(algorithm)
                state.update(data[int(ends[a]):int(ends[b])])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], keys.type), pa.array([d for _, d in done])], names=[key, name])
            last = keys.type
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], last), pa.array([state.hexdigest()])], names=[key, name])

    places = {f"_o{i}": c for i, c in enumerate(order)}
    dealt = rows.filter(F.col(key).isNotNull()).withColumns(places).withColumn("_piece", piece).select(key, "_piece", *places)
    dealt = dealt.repartition(key).sortWithinPartitions(key, *places)
    return dealt.select(key, "_piece").mapInArrow(run, f"{key} {kind}, {name} string")
