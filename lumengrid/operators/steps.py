"""Written steps with markers, a resumable line log, and checks between steps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def fingerprint(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:12]


def read_marker(folder: Path, step: str) -> dict | None:
    path = Path(folder) / f"{step}.json"
    return json.loads(path.read_text()) if path.exists() else None


def write_marker(folder: Path, step: str, rows: int, **extra: object) -> dict:
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = {"rows": rows, "completed_at": datetime.now(timezone.utc).isoformat(), **extra}
    (Path(folder) / f"{step}.json").write_text(json.dumps(out, indent=2))
    return out


def write_step(df: DataFrame, path: str, markers: Path, step: str, files: int = 8, by: tuple[str, ...] = (), **extra: object) -> dict:
    """Parquet, and a marker with the rows counted while they are written (no second scan)."""
    seen = Observation(step)
    df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    df = df.repartition(*by) if by else df.coalesce(files)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return write_marker(markers, step, seen.get["rows"], **extra)


def require(markers: Path, *steps: str) -> None:
    missing = [s for s in steps if read_marker(markers, s) is None]
    if missing:
        raise RuntimeError(f"run first: {', '.join(missing)}")


def assert_rows(df: DataFrame, least: int, what: str) -> int:
    n = df.count()
    if n < least:
        raise ValueError(f"{what}: {n} rows, at least {least} are expected")
    return n


def append_lines(path: Path, records: list[dict]) -> None:
    with Path(path).open("a") as f:
        f.writelines(json.dumps(r) + "\n" for r in records)


def read_lines(path: Path) -> list[dict]:
    """A broken last line (a write that was cut off) is left out; any other raises."""
    lines = Path(path).read_text().split("\n") if Path(path).exists() else []
    lines = [x for x in lines if x.strip()]
    out = []
    for k, line in enumerate(lines):
        try:
            out.append(json.loads(line))
        except ValueError:
            if k < len(lines) - 1:
                raise
    return out


def pending(targets: DataFrame, key: str, *done: DataFrame) -> DataFrame:
    """Targets whose key is in none of the done tables; their null keys count for nothing."""
    for d in done:
        targets = targets.join(d.select(key).where(F.col(key).isNotNull()), key, "left_anti")
    return targets


def up_to_date(markers: Path, step: str, config: dict) -> bool:
    """Whether a step was written, and with these settings."""
    marker = read_marker(markers, step)
    return marker is not None and marker.get("config") == fingerprint(config)


def chunked(records: list, size: int) -> Iterator[list]:
    if size <= 0:
        raise ValueError("size must be positive")
    for k in range(0, len(records), size):
        yield records[k : k + size]


def known_table(spark: SparkSession, name: str, allowed: tuple[str, ...]) -> DataFrame:
    if name not in allowed:
        raise ValueError(f"unknown table {name}")
    return spark.table(name)
