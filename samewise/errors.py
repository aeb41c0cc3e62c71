"""Errors with a code, a context and hints for the user."""

from __future__ import annotations

from typing import Any


class SamewiseError(Exception):
    """Base: message, code, context (named facts) and suggestions."""

    code = "ERROR"
    hints: tuple[str, ...] = ()

    def __init__(self, message: str, *, code: str | None = None, suggestions: list[str] | None = None, **context: Any):
        super().__init__(message)
        self.message, self.code = message, code or self.code
        self.context = {k: v for k, v in context.items() if v is not None}
        self.suggestions = list(self.hints if suggestions is None else suggestions)

    def to_dict(self) -> dict[str, Any]:
        return {"error_type": type(self).__name__, "message": self.message, "error_code": self.code, "context": self.context, "suggestions": self.suggestions}

    def __str__(self) -> str:
        facts = ", ".join(f"{k}={v}" for k, v in self.context.items())
        return f"[{self.code}] {self.message}" + (f" ({facts})" if facts else "")


class DataValidationError(SamewiseError, ValueError):
    code, hints = "DATA_VALIDATION", ("Check column names and null values.",)


class MatchingError(SamewiseError):
    code, hints = "MATCHING", ("Check scorer name and threshold.",)


class ValidationError(SamewiseError):
    code, hints = "VALIDATION", ("Check the rules and the metadata columns they name.",)


class CheckpointError(SamewiseError):
    code, hints = "CHECKPOINT", ("Check that the checkpoint folder can be written.",)


class ConfigurationError(SamewiseError, ValueError):
    code, hints = "CONFIGURATION", ("Compare the configuration with the sample one.",)


class SecurityError(SamewiseError):
    code, hints = "SECURITY", ("Inspect the input for markup or control strings.",)


class ResourceError(SamewiseError):
    code, hints = "RESOURCE", ("Raise the limit or use more partitions.",)


class ModelError(SamewiseError):
    code, hints = "MODEL", ("Check the judge's provider, model and key.",)


class NetworkError(SamewiseError):
    code, hints = "NETWORK", ("Check the connection and try again.",)


class DataIntegrityError(SamewiseError):
    code, hints = "DATA_INTEGRITY", ("Compute the table again from its source.",)


class RateLimitError(ResourceError):
    code = "RATE_LIMIT"

    def __init__(self, message: str, retry_after: float = 0.0, **context: Any):
        super().__init__(message, retry_after=retry_after, **context)
        self.retry_after = retry_after


ERRORS = {c.code.lower(): c for c in (DataValidationError, MatchingError, ValidationError, CheckpointError, ConfigurationError, SecurityError, ResourceError, ModelError, NetworkError, DataIntegrityError, RateLimitError)}
#: Which error stands for a built-in one; the first that fits is taken.
_BUILTIN = ((FileNotFoundError, DataValidationError), (PermissionError, SecurityError), (ConnectionError, NetworkError), (TimeoutError, NetworkError), (MemoryError, ResourceError), (KeyError, DataValidationError), (ValueError, DataValidationError), (TypeError, DataValidationError))


def create_error(kind: str, message: str, **context: Any) -> SamewiseError:
    """An error by its code in lower case; an unknown one gives the base error."""
    return ERRORS.get(kind.lower(), SamewiseError)(message, **context)


def reraise(error: Exception, doing: str, **context: Any) -> None:
    """Raise a built-in error as one of this module's, with the original as its cause; own errors pass as they are."""
    if isinstance(error, SamewiseError):
        raise error
    kind = next((ours for builtin, ours in _BUILTIN if isinstance(error, builtin)), SamewiseError)
    raise kind(f"{doing}: {error}", original=type(error).__name__, **context) from error
