"""Errors with codes."""

from __future__ import annotations

PARSE, EXECUTION, TIMEOUT, CANCELED, INPUT, REGISTRY = "PARSE", "EXECUTION", "TIMEOUT", "CANCELED", "INPUT", "REGISTRY"


class EngineError(Exception):
    """An error with one of the codes above."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message
