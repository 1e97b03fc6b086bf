"""The exact join of near-duplicates leaves out pairs by the outlines of their sets, and no similar ones."""

import numpy as np
import pyarrow as pa

from lumengrid.llm import minhash
from lumengrid.llm import textkernel as tk


def test_outlines_bound_the_difference():
    rng = np.random.default_rng(2)
    for n in (1, 20, 300, 3000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[: n // 2 + 1], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)]))
        differ = int(np.bitwise_count((minhash.outline(x) ^ minhash.outline(y)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(x, y)) and not (minhash.outline(x) ^ minhash.outline(x.copy())).any()


def test_a_family_makes_few_pairs(spark):
    rng = np.random.default_rng(4)
    words = lambda n: [f"w{k}" for k in rng.integers(0, 10**9, n)]
    base = words(200)
    texts = [" ".join(x if rng.random() > 0.022 else words(1)[0] for x in base) for _ in range(60)]  # about 67 % alike
    texts += [t.rsplit(" ", 4)[0] + " a b c d" for t in texts[:20]]  # near copies
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = [s for c in tk.chunks(pa.array(texts)) for s in minhash.sets(c)]
    alike = {(u, v) for u in range(80) for v in range(u) if 100 * len(np.intersect1d(sets[u], sets[v])) >= 75 * len(np.union1d(sets[u], sets[v]))}
    found, _ = minhash.exact_pairs(df, None, 75)
    got = {(max(r.u, r.v), min(r.u, r.v)) for r in found.collect()}
    assert len(alike) >= 20 and alike <= got and len(got) < 2 * len(alike)
