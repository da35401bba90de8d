"""Errors that refuse an input rather than repair it; a message lists a few examples."""


class RefusedInput(ValueError):
    """An input that a rule refuses."""


class UnusableRows(RefusedInput):
    """Rows that can't be scored: `rows` of them; `reasons` counts the most frequent reasons."""

    def __init__(self, message: str, reasons: dict[str, int], rows: int | None = None):
        super().__init__(message)
        self.reasons = reasons
        self.rows = sum(reasons.values()) if rows is None else rows
