"""Settings of duplicate and copy detection."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class DetectionOptions:
    """How texts are normalised and compared.

    A TypeError says that a switch is no boolean, a ValueError that the threshold is not a
    finite number from 0.5 to 1.
    """

    approximate: bool = True
    threshold: float = 0.8
    ignore_urls: bool = True
    ignore_mentions: bool = True

    def __post_init__(self):
        for name in ("approximate", "ignore_urls", "ignore_mentions"):
            if not isinstance(getattr(self, name), bool):
                raise TypeError(f"{name} must be a boolean")
        t = self.threshold
        if isinstance(t, bool) or not isinstance(t, (int, float)) or not math.isfinite(t) or not 0.5 <= t <= 1:
            raise ValueError("threshold must be a number from 0.50 to 1.00")


class InputValidationError(ValueError):
    """Input that breaks the rules; `errors` has one message for each break, in input order."""

    def __init__(self, errors: list[str]):
        super().__init__("\n".join(errors))
        self.errors = errors
