"""Day and night: capture inside a window, one analysis after it closes. A driver's loop around batch jobs."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import SparkSession

from kindred.config import Schedule
from kindred.functions.clock import DAY, parse_hhmm


def _second(now: datetime) -> int:
    return now.hour * 3600 + now.minute * 60 + now.second


def capturing(now: datetime, cfg: Schedule) -> bool:
    a, b, t = parse_hhmm(cfg.capture_start), parse_hhmm(cfg.capture_end), _second(now)
    return a != b and ((t - a) % DAY < (b - a) % DAY)


def next_transition(now: datetime, cfg: Schedule) -> datetime:
    goal = parse_hhmm(cfg.capture_end if capturing(now, cfg) else cfg.capture_start)
    at = datetime(now.year, now.month, now.day) + timedelta(seconds=goal)
    return at if at > now else at + timedelta(days=1)


def last_end(now: datetime, cfg: Schedule) -> datetime:
    at = datetime(now.year, now.month, now.day) + timedelta(seconds=parse_hhmm(cfg.capture_end))
    return at if at <= now else at - timedelta(days=1)


def due(now: datetime, last: float | None, cfg: Schedule) -> bool:
    return last is None or datetime.fromtimestamp(last) < last_end(now, cfg)


class State:
    """One JSON document; missing or malformed counts as empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def load(self) -> dict:
        if not self._fs.exists(self._path):
            return {}
        try:
            found = json.loads("\n".join(r["value"] for r in self.spark.read.text(self.path).collect()))
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def save(self, state: dict) -> None:
        out = self._fs.create(self._path, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()


class Supervisor:
    """Runs ``capture(seconds)`` by day and ``analyze()`` once a night. A failed analysis is recorded and tried again."""

    def __init__(self, cfg: Schedule, state: State, capture: Callable[[float], object], analyze: Callable[[], object], clock: Callable[[], datetime], sleep: Callable[[float], None]):
        self.cfg, self.state, self.capture, self.analyze, self.clock, self.sleep = cfg, state, capture, analyze, clock, sleep

    def cycle(self) -> str:
        """One step: capture, capture_failed, analysis, analysis_failed or wait."""
        now = self.clock()
        if capturing(now, self.cfg):
            left = (next_transition(now, self.cfg) - now).total_seconds()
            try:
                self.capture(min(left, self.cfg.session_minutes * 60))
            except OSError:
                self.sleep(self.cfg.retry_seconds)
                return "capture_failed"
            return "capture"
        if self.cfg.analysis_enabled and due(now, self.state.load().get("last_analysis"), self.cfg):
            if "last_analysis_error" in self.analyze_now(now):
                self.sleep(self.cfg.retry_seconds)
                return "analysis_failed"
            return "analysis"
        self.sleep(max(1.0, min((next_transition(now, self.cfg) - now).total_seconds(), 60.0)))
        return "wait"

    def analyze_now(self, now: datetime | None = None) -> dict:
        """The analysis, due or not; its summary, or its error, which is recorded and never raised."""
        now, kept = now or self.clock(), self.state.load()
        try:
            summary = self.analyze()
        except Exception as e:
            self.state.save(kept | {"last_analysis_error": str(e)})
            return {"last_analysis_error": str(e)}
        self.state.save({"last_analysis": now.timestamp(), "last_analysis_summary": summary, "last_analysis_error": None})
        return {"last_analysis_summary": summary}

    def run(self, cycles: int = 0) -> list[str]:
        out: list[str] = []
        while not cycles or len(out) < cycles:
            out.append(self.cycle())
        return out

    def status(self) -> dict:
        now = self.clock()
        kept = self.state.load()
        return {"capturing": capturing(now, self.cfg), "next_transition": next_transition(now, self.cfg).isoformat(), "analysis_due": due(now, kept.get("last_analysis"), self.cfg), **kept}
