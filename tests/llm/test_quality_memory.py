"""The fit of the quality rules holds one matrix of rules on the driver, not several."""

from __future__ import annotations

import tracemalloc

import numpy as np

from gradelake.llm import quality_rules


def test_fit_holds_one_matrix():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality_rules.STATS)))
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(0, 0.2, 4000)) > 0.8).astype(float)
    tracemalloc.start()
    model = quality_rules.fit(x, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.rules) > 100 and peak < 30e6
