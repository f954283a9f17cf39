"""Lines of text for people: shortened, wrapped, counted."""

from __future__ import annotations

import textwrap

WIDTH = 100


def clip(text: str, most: int) -> str:
    """At most so many characters; what is cut at the end shows as one sign."""
    return text if len(text) <= most else text[: max(most - 1, 0)] + "…" * (most > 0)


def clip_middle(text: str, most: int) -> str:
    """At most so many characters; both ends stay, as they tell keys apart."""
    if len(text) <= most:
        return text
    if most < 2:
        return clip(text, most)
    head = most // 2
    return text[:head] + "…" + text[len(text) - (most - head - 1) :]


def wrap(text: str, width: int = WIDTH, indent: str = "") -> list[str]:
    """Lines of at most so many characters, all but the first indented."""
    return textwrap.wrap(text, width, subsequent_indent=indent, break_long_words=True) or [""]


def plural(n: int, one: str, many: str | None = None) -> str:
    return f"{n} {one if n == 1 else many or one + 's'}"
