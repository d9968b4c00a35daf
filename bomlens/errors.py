"""Typed errors of plan-time validation and of integrity checks."""

from __future__ import annotations


class EngineError(ValueError):
    """An error with a stable code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code = code


class IntegrityError(EngineError):
    """Data that breaks an invariant; all violations are told together."""
