"""What a Python worker holds while it measures texts."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docsieve.llm import arrays, quality_rules
from tests.llm.conftest import sentence


def test_measuring_a_batch_takes_bounded_memory():
    texts = [sentence(800, i) + f" {i}" for i in range(1200)]
    batch = pa.record_batch({"c0": pa.array(texts)})
    assert batch.nbytes > 6 << 20
    whole = np.stack(quality_rules.measure(batch.column("c0")))
    arrays._powers.clear()
    tracemalloc.start()
    parts = list(quality_rules.measurer("c0")(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    got = np.stack([np.concatenate([p.column(m).to_numpy() for p in parts]) for m in quality_rules.MEASURES])
    assert (got == whole).all()
