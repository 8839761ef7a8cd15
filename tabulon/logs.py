"""Log lines in colour for people and as JSON for programs."""

from __future__ import annotations

import json
import logging
import os
import sys

_COLOURS = {logging.DEBUG: 36, logging.INFO: 32, logging.WARNING: 33, logging.ERROR: 31, logging.CRITICAL: 35}


class Coloured(logging.Formatter):
    """Level and message, the level in a colour of its own."""

    def format(self, record: logging.LogRecord) -> str:
        return f"\033[{_COLOURS.get(record.levelno, 0)}m{record.levelname}\033[0m {super().format(record)}"


class Lines(logging.Formatter):
    """An object a line: time, level, logger, message and, of an error, its trace."""

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        if record.exc_info:
            out["trace"] = self.formatException(record.exc_info)
        return json.dumps(out, ensure_ascii=False)


def configure(debug: bool = False, as_json: bool = False, colour: bool = True) -> logging.Handler:
    """A handler for the package's logger; colour only at a terminal and where NO_COLOR isn't set."""
    handler = logging.StreamHandler()
    shown = colour and not os.environ.get("NO_COLOR") and sys.stderr.isatty()
    handler.setFormatter(Lines() if as_json else Coloured() if shown else logging.Formatter("%(levelname)s %(message)s"))
    logger = logging.getLogger("tabulon")
    logger.handlers = [handler]
    logger.setLevel(logging.DEBUG if debug else logging.WARNING)
    return handler
