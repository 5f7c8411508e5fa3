"""The manifest of work units: a small sqlite file with one writer, the driver."""

from __future__ import annotations

import sqlite3
import time
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATES = ("pending", "in_flight", "done", "empty", "failed")
COLUMNS = "unit_id string, status string, attempts int, last_error string, output_path string, completed_at double"


class Manifest:
    def __init__(self, path: str | Path):
        self.db = sqlite3.connect(path, isolation_level=None)
        self.db.executescript("""
            PRAGMA journal_mode = WAL;
            CREATE TABLE IF NOT EXISTS job (hash TEXT PRIMARY KEY, roi TEXT, started REAL, completed REAL);
            CREATE TABLE IF NOT EXISTS unit (unit_id TEXT PRIMARY KEY, status TEXT NOT NULL DEFAULT 'pending', attempts INTEGER NOT NULL DEFAULT 0,
                                             last_error TEXT, output_path TEXT, completed_at REAL);
            CREATE INDEX IF NOT EXISTS by_status ON unit (status);
        """)

    def close(self) -> None:
        self.db.close()

    def begin_job(self, config_hash: str, roi: str | None = None) -> bool:
        """False if the job is known already. A manifest belongs to one configuration."""
        known = self.db.execute("SELECT hash FROM job").fetchall()
        if known and (config_hash,) not in known:
            raise ValueError("this manifest belongs to another configuration; start afresh")
        return self.db.execute("INSERT INTO job VALUES (?, ?, ?, NULL) ON CONFLICT DO NOTHING", (config_hash, roi, time.time())).rowcount == 1

    def job(self, config_hash: str) -> tuple | None:
        return self.db.execute("SELECT hash, roi, started, completed FROM job WHERE hash = ? LIMIT 1", (config_hash,)).fetchone()

    def complete_job(self, config_hash: str) -> None:
        self.db.execute("UPDATE job SET completed = ? WHERE hash = ?", (time.time(), config_hash))

    def register(self, ids: Iterable[str]) -> int:
        """Add units that aren't known; known ones keep their state."""
        before = self.db.total_changes
        self.db.execute("BEGIN")
        self.db.executemany("INSERT INTO unit (unit_id) VALUES (?) ON CONFLICT DO NOTHING", ((i,) for i in ids))
        self.db.execute("COMMIT")
        return self.db.total_changes - before

    def _move(self, unit: str, to: str, of: tuple[str, ...], sets: str = "", values: tuple = ()) -> bool:
        marks = ", ".join("?" * len(of))
        return self.db.execute(f"UPDATE unit SET status = ?{sets} WHERE unit_id = ? AND status IN ({marks})", (to, *values, unit, *of)).rowcount == 1

    def claim(self, unit: str) -> bool:
        return self._move(unit, "in_flight", ("pending", "failed"), ", attempts = attempts + 1")

    def claim_all(self, units: Iterable[str]) -> None:
        """As claim() does, in one transaction."""
        self.db.execute("BEGIN")
        self.db.executemany("UPDATE unit SET status = 'in_flight', attempts = attempts + 1 WHERE unit_id = ? AND status IN ('pending', 'failed')", ((u,) for u in units))
        self.db.execute("COMMIT")

    def done(self, unit: str, path: str) -> bool:
        return self._move(unit, "done", STATES, ", output_path = ?, completed_at = ?, last_error = NULL", (path, time.time()))

    def empty(self, unit: str) -> bool:
        """A unit without a valid pixel is finished; it doesn't hold the merge up."""
        return self._move(unit, "empty", STATES, ", completed_at = ?", (time.time(),))

    def failed(self, unit: str, error: str) -> bool:
        return self._move(unit, "failed", STATES, ", last_error = ?", (error[:2000],))

    def reset(self, state: str = "failed") -> int:
        return self.db.execute("UPDATE unit SET status = 'pending', last_error = NULL WHERE status = ?", (state,)).rowcount

    def recover(self) -> list[str]:
        """Units that a crash left in flight are pending again; their unfinished files are removed."""
        left = self.db.execute("SELECT unit_id, output_path FROM unit WHERE status = 'in_flight' ORDER BY unit_id").fetchall()
        for _, path in left:
            if path:
                for p in (Path(path), Path(path).with_suffix(".json")):
                    p.unlink(missing_ok=True)
        self.db.execute("UPDATE unit SET status = 'pending', output_path = NULL WHERE status = 'in_flight'")
        return [u for u, _ in left]

    def ids(self, *states: str) -> list[str]:
        return [r[0] for r in self.db.execute(f"SELECT unit_id FROM unit WHERE status IN ({', '.join('?' * len(states))}) ORDER BY unit_id", states)]

    def pending(self, with_failed: bool = False) -> list[str]:
        return self.ids("pending", "failed") if with_failed else self.ids("pending")

    def status(self, unit: str) -> str | None:
        row = self.db.execute("SELECT status FROM unit WHERE unit_id = ?", (unit,)).fetchone()
        return row and row[0]

    def counts(self) -> dict[str, int]:
        return dict(self.db.execute("SELECT status, count(*) FROM unit GROUP BY status ORDER BY status"))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.db.execute("SELECT unit_id, status, attempts, last_error, output_path, completed_at FROM unit").fetchall(), COLUMNS)


def pending_units(units: DataFrame, manifest: DataFrame, with_failed: bool = False) -> DataFrame:
    states = ["pending", "failed"] if with_failed else ["pending"]
    return units.join(manifest.where(F.col("status").isin(states)).select("unit_id"), "unit_id", "left_semi")


def new_units(units: DataFrame, manifest: DataFrame) -> DataFrame:
    """Insert if absent."""
    return units.join(manifest.select("unit_id"), "unit_id", "left_anti")


def units_per_window(units: DataFrame) -> DataFrame:
    return units.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def status_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
