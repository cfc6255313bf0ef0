"""Dictionary files by path, with a compressed twin as fallback."""

from __future__ import annotations

import os


def read_file(path: str) -> bytes:
    """A file's bytes; those of path.hz, decompressed, if there is no such file."""
    if not os.path.exists(path) and os.path.exists(path + ".hz"):
        from lexloom.sources.hzip import decode

        with open(path + ".hz", "rb") as f:
            return decode(f.read())
    with open(path, "rb") as f:
        return f.read()
