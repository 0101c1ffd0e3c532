"""What the toxicity stage moves and holds stays small."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from ledgerscope.llm import common, toxicity


def test_places_take_little_more_than_two_bytes_each_and_come_back():
    for n in (1, 7, 640, 100_000):
        at = np.unique(np.append(np.random.default_rng(n).integers(0, 1 << toxicity.BITS, n), [0, (1 << toxicity.BITS) - 1]))
        told = toxicity._packed(at)
        assert len(told) == 2 * len(at) + 16
        assert np.array_equal(toxicity._unpacked(pa.array([told], pa.binary())[0].as_buffer()), at)


def test_a_worker_lets_go_of_tokenizers(monkeypatch):
    dropped = []
    module = type(sys)("ledgerscope.llm.library_ids")
    module.encoder = type("Loader", (), {"cache_clear": lambda self: dropped.append(1)})()
    monkeypatch.setitem(sys.modules, "ledgerscope.llm.library_ids", module)
    common.settle()
    assert dropped == [1]
