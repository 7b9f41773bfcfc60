"""Failures that stop a load instead of letting bad data through."""


class DataError(Exception):
    """Base of all data failures; the message always names the source."""

    kind = "data error"

    def __init__(self, source_id: str, detail: str):
        self.source_id = source_id
        super().__init__(f"[{source_id}] {self.kind}: {detail}")


class SourceUnavailable(DataError):
    """The landed file is an error body, truncated, or empty."""

    kind = "source unavailable"


class ContractViolation(DataError):
    """Rows break the declared contract; nothing is written."""

    kind = "contract violation"


class StaleData(DataError):
    """A table exists but is older than its agreed age."""

    kind = "stale"


class TableAbsent(DataError):
    """A table that a plan needs has never been written."""

    kind = "table absent"
