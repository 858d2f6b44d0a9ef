"""Shards are not kept in memory."""

import gc
import tracemalloc

from chronoleaf.sources import sinks


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


def test_shards_are_not_kept_after_reading():
    held = [(str(i), b"x" * 4000) for i in range(50)]
    one = bytes(sinks.packed(held))
    assert list(sinks.members(one)) == [(k, d.decode()) for k, d in held]
    assert peak_of(lambda: [sinks.packed(held) and None for _ in range(20)]) < 4 * len(one)
    assert peak_of(lambda: [sum(1 for _ in sinks.members(one)) for _ in range(20)]) < 4 * len(one)
