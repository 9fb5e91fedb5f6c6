"""The driver's log: lines of `[context] message` on stderr."""

from __future__ import annotations

import logging
import os


class _Lines(logging.Formatter):
    """The context is the last part of a logger's name; a stack follows only while debugging."""

    def __init__(self, debug: bool) -> None:
        super().__init__()
        self.debug = debug

    def format(self, record: logging.LogRecord) -> str:
        line = f"[{record.name.rpartition('.')[2]}] {record.getMessage()}"
        return f"{line}\n{self.formatException(record.exc_info)}" if record.exc_info and self.debug else line


def setup(debug: bool | None = None, stream=None) -> logging.Logger:
    """Send the library's log to stderr (or stream); called again it replaces what it set. debug, or LEXGROVE_DEBUG=1, adds debug lines and stacks."""
    debug = os.environ.get("LEXGROVE_DEBUG") == "1" if debug is None else debug
    log = logging.getLogger("lexgrove")
    for old in [h for h in log.handlers if isinstance(h.formatter, _Lines)]:
        log.removeHandler(old)
    handler = logging.StreamHandler(stream)
    handler.setFormatter(_Lines(debug))
    log.addHandler(handler)
    log.setLevel(logging.DEBUG if debug else logging.INFO)
    log.propagate = False
    return log
