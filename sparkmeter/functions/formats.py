"""Formatting of small results at the edge, in Python (its rounding differs from the JVM's)."""

from __future__ import annotations

import html
import math


def tokens(n: int | None) -> str:
    """``950``, ``1.2k``, ``3.4M``."""
    n = n or 0
    if n >= 1_000_000:
        return f"{n / 1_000_000:.1f}M"
    return f"{n / 1_000:.1f}k" if n >= 1_000 else str(n)


def usd(cost: float | None) -> str:
    return "n/a" if cost is None else f"${cost:,.2f}"


def delta(cost: float | None) -> str:
    return "n/a" if cost is None else f"{'+' if cost >= 0 else '-'}${abs(cost):,.2f}"


def burn_rate(cost: float | None, days: int) -> tuple[float, float] | None:
    """Cost a day and a week; only for windows of some days."""
    return None if cost is None or days <= 0 else (cost / days, 7 * cost / days)


def finite(x: float | None) -> float | None:
    return None if x is None or math.isnan(x) or math.isinf(x) else x


def escape(text: object) -> str:
    return html.escape(str(text), quote=True)
