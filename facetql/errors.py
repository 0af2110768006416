"""Errors that a query can raise."""


class QueryError(ValueError):
    """A query that can't be run; ``clause`` and ``offset`` say where, if known."""

    def __init__(self, message: str, clause: str | None = None, offset: int | None = None):
        super().__init__(message)
        self.message, self.clause, self.offset = message, clause, offset

    def __str__(self) -> str:
        where = f" in the {self.clause} clause" if self.clause else ""
        at = f" at {self.offset}" if self.offset is not None else ""
        return f"{self.message}{where}{at}"


class LimitError(QueryError):
    """A result or an intermediate step exceeds a configured limit."""
