"""The log of a run: stages and messages, read by whoever polls."""

from __future__ import annotations

import threading
import time
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any


@dataclass
class LogEntry:
    level: str
    stage: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


class Logger:
    """Thread-safe; setting a stage logs how long the one before took."""

    def __init__(self) -> None:
        self._entries: list[LogEntry] = []
        self._lock = threading.Lock()
        self._stage, self._began = "", 0.0

    def set_stage(self, stage: str) -> None:
        now = time.time()
        if self._stage:
            self.info(self._stage, f"Completed {self._stage}", {"seconds": now - self._began})
        self._stage, self._began = stage, now
        self.info(stage, f"Started {stage}")

    def _add(self, level: str, stage: str, message: str, details: dict[str, Any] | None) -> None:
        with self._lock:
            self._entries.append(LogEntry(level, stage, message, details or {}))

    def info(self, stage: str, message: str, details: dict[str, Any] | None = None) -> None:
        self._add("info", stage, message, details)

    def warning(self, stage: str, message: str, details: dict[str, Any] | None = None) -> None:
        self._add("warning", stage, message, details)

    def error(self, stage: str, message: str, details: dict[str, Any] | None = None) -> None:
        self._add("error", stage, message, details)

    def logs(self) -> list[dict[str, Any]]:
        with self._lock:
            return [asdict(e) for e in self._entries]

    def latest(self, n: int = 10) -> list[dict[str, Any]]:
        return self.logs()[-n:]

    def clear(self) -> None:
        with self._lock:
            self._entries.clear()
