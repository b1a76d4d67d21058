"""Removal of repeated strings over several batches, hot anchors and slices."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tapeloom.llm import suffix_dedup
from tests.llm.test_llm import brute_removal, prose


@pytest.mark.parametrize(("hot", "batch_bytes"), [(1 << 20, 300), (700, 2000), (0, 1)])
def test_batches_and_hot_anchors(spark, hot, batch_bytes):
    r = random.Random(12)
    common = prose(r, 60)
    texts = []
    for i in range(30):  # one passage among ever different neighbours: its anchors have very many regions
        t = prose(r, 12) + common + prose(r, 12)
        texts += [t, t] if i % 7 == 0 else [t]
    texts += [common[3:140] * 2, "x" * 500, None]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = {x["doc_id"]: bytes(x["kept"]) for x in suffix_dedup.deduplicate(df, hot=hot, batch_bytes=batch_bytes).collect()}
    assert got == brute_removal(rows, 100)


def test_all_but_the_first_of_equal_windows_go():
    rows = [(b"a" * 100, 1, 5, 0), (b"a" * 100, 1, 5, 0), (b"a" * 100, 1, 5, 3), (b"a" * 100, 2, 5, 0), (b"b" * 100, 0, 1, 9), (b"c" * 100, 0, 1, 1), (b"c" * 100, 4, 1, 1)]
    for cut in range(len(rows) + 1):
        parts = [p for p in (rows[:cut], rows[cut:]) if p]
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in p], pa.binary()), *(pa.array(np.array([x[i] for x in p])) for i in (1, 2, 3))], names=["bytes", "doc", "chk", "at"]) for p in parts]
        got = [(x["doc"], x["at"]) for b in suffix_dedup._later(iter(batches)) for x in b.to_pylist()]
        assert got == [(1, 3), (2, 0), (4, 1)]
