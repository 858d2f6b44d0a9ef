"""Shards that became Arrow arrays are let go, and are the tar files that tarfile writes."""

import io
import tarfile

import pyarrow as pa
from test_python_memory_shards import peak_of

from chronoleaf.sources import sinks


def plain(held: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, data in held:
            info = tarfile.TarInfo(f"{name}.json")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def test_shards_are_let_go_once_they_are_arrow():
    held = [(str(i), b"x" * 4000) for i in range(50)]
    one = len(sinks.packed(held))
    pa.array([b"x"])  # its first call imports modules
    assert peak_of(lambda: [pa.array([sinks.packed(held)], pa.binary()) and None for _ in range(20)]) < 4 * one


def test_shards_are_those_of_tarfile():
    simple = [(str(i), b"x" * (i * 37)) for i in range(40)]
    odd = [("a/b", b""), ("n" * 95, b"1"), ("n" * 96, b"2"), ("p/" * 80 + "q", b"3"), ("é", b"4"), ("z", b"5" * 512), ("y" * 300, "é".encode())]
    for held in (simple, odd, [], simple + odd + simple):
        one = plain(held)
        assert bytes(sinks.packed(held)) == one
        assert list(sinks.members(one)) == [(k, d.decode()) for k, d in held]
    assert list(sinks.members(plain(simple[:2])[:1536])) == [("0", ""), ("1", "x" * 37)]  # cut off where a member ends
