"""Choosing centres makes one row for each set, not one for each centre it might meet."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lumengrid.llm import minhash


def test_a_set_gathers_its_centres_in_one_row(spark, capsys):
    rng = random.Random(3)
    size, component = {k: rng.randint(70, 130) for k in range(60)}, {k: k % 7 for k in range(60)}
    dealt = sorted({(k, rng.randrange(12)) for k in range(60) for _ in range(6)})
    rows = spark.createDataFrame([(k, size[k], component[k], b) for k, b in dealt], "id long, n long, c long, bucket long")
    centres = {b: [rng.randrange(60) for _ in range(8)] for b in range(12)}
    kind = "bucket long, m array<struct<r: long, id: long, n: long, c: long>>"
    centre = spark.createDataFrame([(b, [(0, k, size[k], component[k]) for k in ks]) for b, ks in centres.items()], kind)
    met = {(k, rng.choice(centres[b])) for k, b in dealt if rng.random() < 0.3}
    tested = spark.createDataFrame(sorted(met), "u long, v long")
    hashed = dict(spark.range(60).select("id", F.xxhash64("id")).collect())
    for before, df in ((set(), None), (met, tested)):
        shared = Counter((k, v) for k, b in dealt for v in set(centres[b]) if component[v] != component[k] and 100 * min(size[k], size[v]) >= 75 * max(size[k], size[v]) and (k, v) not in before)
        best = {}
        for (k, v), n in shared.items():
            best[k] = max(best.get(k, (0, 0, 0)), (n, hashed[v], v))
        found = minhash.chosen_centres(rows, centre, df, 75)
        assert {r.u: r.v for r in found.collect()} == {k: v for k, (_, _, v) in best.items()} and best
        found.explain()
        assert "Generate" not in capsys.readouterr().out
