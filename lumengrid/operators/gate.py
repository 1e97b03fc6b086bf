"""The regression gate over evaluation results, kept as JSON documents."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumengrid.config import GATE_TOLERANCE

METRIC = ("hybrid", "precision@10")


def newest(results: list[dict]) -> dict:
    """The latest one; of equal times the last in the list."""
    if not results:
        raise ValueError("there are no results")
    return max(enumerate(results), key=lambda r: (str(r[1].get("generated_at", "")), r[0]))[1]


def read_results(folder: Path) -> list[dict]:
    return [json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))]


def write_result(result: dict, folder: Path) -> Path:
    """The document in the folder, named by its revision or its time."""
    path = Path(folder) / f"{(result.get('revision') or result['generated_at'].replace(':', ''))[:26]}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(result, indent=2) + "\n")
    return path


def compared(spark: SparkSession, new: dict, base: dict) -> DataFrame:
    """ranker, metric, new_value, base_value and passed, for all that both documents measure."""
    if new["mode"] != base["mode"]:
        raise ValueError(f"modes differ: {new['mode']} and {base['mode']}")
    side = lambda d, name: spark.createDataFrame([(r, m, float(x)) for r, of in d["rankers"].items() for m, x in of.items()], f"ranker string, metric string, {name} double")
    return side(new, "new_value").join(side(base, "base_value"), ["ranker", "metric"]).withColumn("passed", F.col("new_value") >= F.col("base_value") - GATE_TOLERANCE)


def passes(new: dict, base: dict) -> bool:
    """Whether the gate's metric has not fallen; results of different modes can't be compared."""
    if new["mode"] != base["mode"]:
        raise ValueError(f"modes differ: {new['mode']} and {base['mode']}")
    a, b = (r["rankers"][METRIC[0]][METRIC[1]] for r in (new, base))
    return a >= b - GATE_TOLERANCE


def run_gate(folder: Path, baseline: Path) -> int:
    """0: passed, 1: worse, 2: nothing to compare."""
    results = read_results(folder)
    if not results or not Path(baseline).exists():
        return 2
    try:
        return 0 if passes(newest(results), json.loads(Path(baseline).read_text())) else 1
    except (KeyError, ValueError):
        return 2


def promote(result: dict, baseline: Path, note: str) -> dict:
    """The result becomes the baseline."""
    out = result | {"note": note, "promoted_at": datetime.now(timezone.utc).isoformat()}
    Path(baseline).write_text(json.dumps(out, indent=2, sort_keys=True) + "\n")
    return out
