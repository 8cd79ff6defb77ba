"""The packed matrix that op2 writes over its whole table."""

from pathlib import Path

import numpy as np
from orgloom.llm import queries
from orgloom.llm.common import shared_dir


def test_op2_writes_the_padded_matrix(spark, sf_dir):
    shared = Path(shared_dir(spark, "x").removeprefix("file://")).parent
    old = set(shared.glob("packed-*"))
    pieces = queries.op2_packed_token_ids(spark, sf_dir).collect()
    (path,) = set(shared.glob("packed-*")) - old
    rows = {r["sequence_id"]: r for r in spark.read.parquet(str(path)).collect()}
    pad = queries.PAD_ID.to_bytes(4, "little")
    for r in rows.values():
        ends = list(r["cu_seqlens"])
        assert len(r["input_ids"]) == 4 * queries.CAPACITY
        assert bytes(r["input_ids"][4 * ends[-1] :]) == pad * (queries.CAPACITY - ends[-1])
        assert np.frombuffer(r["position_ids"], "<u2").tolist() == [i for a, b in zip(ends, ends[1:]) for i in range(b - a)] + [0] * (queries.CAPACITY - ends[-1])
    assert sum(len(r["doc_ids"]) for r in rows.values()) == len(pieces)
    assert all(p["offset"] in rows[p["sequence_id"]]["cu_seqlens"] for p in pieces)
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
