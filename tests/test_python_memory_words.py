"""Word alignment holds one record's words."""

import gc
import tracemalloc

import pyarrow as pa

from chronoleaf.operators import text_scores as ts


def peak_of(f) -> int:
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
        gc.enable()


def test_alignment_holds_one_record_of_words():
    words = [[f"w{i}-{j}" for j in range(60)] for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(words), pa.array(words[1:] + [[]])], names=["k", "p", "r"])
    del words
    out = []
    assert peak_of(lambda: out.extend(ts.align([batch]))) < 2_000_000
    assert out[0].num_rows == 1000 and out[0].column("matches").to_pylist() == [0] * 1000 and out[0].column("nr").to_pylist() == [60] * 999 + [0]
