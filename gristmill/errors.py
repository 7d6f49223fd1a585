"""Errors with a code and details."""

from __future__ import annotations

# Error codes, in natural order.
CODES = {
    "FILE_NOT_FOUND": 1001,
    "FILE_PROCESSING_ERROR": 1002,
    "INVALID_DIRECTORY": 1003,
    "DIRECTORY_PROCESSING_ERROR": 1004,
    "CONFIGURATION_ERROR": 2001,
    "MODEL_LOADING_ERROR": 3001,
    "VECTOR_COMPUTATION_ERROR": 3002,
    "SIMILARITY_CALCULATION_ERROR": 3003,
    "ANALYSIS_ERROR": 4001,
    "USER_INPUT_ERROR": 5001,
    "UNEXPECTED_ERROR": 9999,
}


class EngineError(Exception):
    def __init__(self, message: str, code: str = "UNEXPECTED_ERROR", details: dict | None = None):
        super().__init__(message)
        self.code, self.number, self.details = code, CODES[code], details or {}


class ConfigurationError(EngineError):
    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message, "CONFIGURATION_ERROR", details)
