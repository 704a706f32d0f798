"""Look-alike characters: the table of the confusables library, shipped with its notice in ``confusables.txt``.

A table of one's own can be given as ordered (target, sources) pairs instead.
"""

from __future__ import annotations

import functools
from pathlib import Path


@functools.cache
def confusables() -> tuple[tuple[str, str], ...]:
    """Ordered (target, sources) pairs."""
    text = Path(__file__).with_suffix(".txt").read_text(encoding="utf-8")
    # split at line feeds only, as some sources are line breaks to splitlines()
    lines = [line for line in text.split("\n") if line[1:2] == "\t"]
    return tuple((line[0], line[2:]) for line in lines)
