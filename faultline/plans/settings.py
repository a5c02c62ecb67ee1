"""Settings from the session's configuration or the environment, and logging as JSON lines."""

from __future__ import annotations

import json
import logging
import os
import sys
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX, ENV = "spark.faultline.", "FAULTLINE_"


@dataclass(frozen=True)
class Settings:
    repo_root: str = "."
    cache_path: str = "~/.cache/faultline"
    schema_version: str = "v1"
    log_level: str = "INFO"
    cache_max_age_days: int = 30
    cache_max_size_mb: int = 500


def settings(spark: SparkSession | None = None) -> Settings:
    """Session first, then environment, then defaults; the cache path is expanded."""
    given = {}
    for f in fields(Settings):
        v = spark.conf.get(PREFIX + f.name, None) if spark else None
        v = os.environ.get(ENV + f.name.upper()) if v is None else v
        if v is not None:
            given[f.name] = int(v) if f.type == "int" else v
    s = Settings(**given)
    return Settings(**{**s.__dict__, "cache_path": os.path.expanduser(s.cache_path)})


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()} | getattr(record, "fields", {})
        return json.dumps(out | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}), ensure_ascii=False)


def log_to_stderr(level: str = "INFO") -> logging.Logger:
    log = logging.getLogger("faultline")
    log.handlers[:] = [logging.StreamHandler(sys.stderr)]
    log.handlers[0].setFormatter(JsonLines())
    log.setLevel(level.upper())
    return log
