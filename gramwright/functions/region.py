"""Region strings, chrom:start-end, both bounds included."""

from __future__ import annotations

from typing import NamedTuple


class Region(NamedTuple):
    chrom: str
    start: int
    end: int


def parse_region(text: str | None) -> Region:
    """The chromosome is kept as it is written; start may exceed end (no rows)."""
    if text is None:
        raise ValueError("no region given")
    chrom, colon, span = text.partition(":")
    start, hyphen, end = span.partition("-")
    if not (colon and hyphen) or ":" in span or "-" in end or "-" in chrom:
        raise ValueError(f"Invalid region {text!r}: expected chr:start-end")
    try:
        return Region(chrom, int(start), int(end))
    except ValueError:
        raise ValueError(f"Invalid region {text!r}: start and end must be integers") from None


def parse_range(text: str) -> tuple[int, int]:
    """A:B, half-open."""
    a, b = text.split(":")
    return int(a), int(b)
