"""Errors of the engine."""


class OutOfRange(ValueError):
    """A value lies outside a dimension's domain."""

    def __init__(self, domain: tuple[int, int], value: int):
        super().__init__(f"{value} is outside {domain[0]}..={domain[1]}")
        self.domain, self.value = domain, value


class Conflict(ValueError):
    """Two records would have the same key in one chunk."""


class Malformed(ValueError):
    """A record file is cut short or otherwise unreadable."""
