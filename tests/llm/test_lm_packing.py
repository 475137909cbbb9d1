"""Packed numbers come back as they were, at a level of compression that costs little time."""

import numpy as np
import pyarrow as pa

from bidscreen.llm import lm


def test_packed_and_unpacked(monkeypatch):
    levels, codec = [], pa.Codec
    monkeypatch.setattr(pa, "Codec", lambda name, compression_level: levels.append(compression_level) or codec(name, compression_level=compression_level))
    for kind in (np.uint64, np.uint32, np.int32, np.float32, np.uint8):
        values = np.arange(0, 100_000, 7).astype(kind)
        assert (lm.unpacked(lm.packed_bytes(values), kind) == values).all()
        assert len(lm.unpacked(lm.packed_bytes(values[:0]), kind)) == 0
    assert set(levels) == {3}
