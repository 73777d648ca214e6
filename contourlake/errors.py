"""Refusals: what the library declines to compute, each with a reason that callers can test for."""


class Refusal(ValueError):
    """A request that has no right answer. ``reason`` is a short fixed word or phrase."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}" if detail else reason)
        self.reason = reason
        self.detail = detail

    def __reduce__(self):
        return type(self), (self.reason, self.detail)


def number(value, name: str, *, above: float | None = None, least: float | None = None, most: float | None = None) -> float:
    """``value`` if it is a finite number (never a bool) within bounds."""
    if isinstance(value, bool) or not isinstance(value, int | float):
        raise Refusal("not-a-number", f"{name} is {value!r}")
    if value != value or value in (float("inf"), float("-inf")):
        raise Refusal("not-finite", name)
    if (above is not None and value <= above) or (least is not None and value < least) or (most is not None and value > most):
        raise Refusal("out-of-range", f"{name} is {value!r}")
    return value


def whole(value, name: str, *, least: int | None = None) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise Refusal("not-a-whole-number", f"{name} is {value!r}")
    return int(number(value, name, least=least))


def one_of(value, name: str, choices) -> str:
    if value not in choices:
        raise Refusal("unknown-choice", f"{name} is {value!r}, not one of {sorted(map(str, choices))}")
    return value
