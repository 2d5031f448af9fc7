"""Log lines as text or as JSON."""

from __future__ import annotations

import json
import logging
import sys


class JsonFormatter(logging.Formatter):
    """A line as a JSON object: time, level, logger, message, and the exception if there is one."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"timestamp": self.formatTime(record, "%Y-%m-%dT%H:%M:%S"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line)


def set_up_logging(kind: str = "text", stream=None) -> logging.Logger:
    """The handler of this package's loggers; set up again, it is replaced."""
    logger = logging.getLogger("tidemark")
    handler = logging.StreamHandler(stream or sys.stderr)
    handler.setFormatter(JsonFormatter() if kind == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    logger.handlers = [handler]
    return logger
