"""Token files of public tokenizers, read where they are used; their path is a parameter."""

from __future__ import annotations

import base64
from functools import lru_cache
from pathlib import Path


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks from a rank file (base64 token, rank on each line)."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in lines}
