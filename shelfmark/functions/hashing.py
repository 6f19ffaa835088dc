"""Content hashes of files, and of bytes in a column."""

from __future__ import annotations

import hashlib
from pathlib import Path

# The sizes of the sampled hash's format.
SAMPLE = 64 * 1024
WHOLE_UP_TO = 3 * SAMPLE
READ = 1 << 20


def partial_digest(data: bytes) -> bytes:
    """The 16-byte hash of a content's size and samples: the whole up to 192 KiB, else its head, middle and tail."""
    h = hashlib.blake2b(len(data).to_bytes(8, "little"), digest_size=16)
    if len(data) <= WHOLE_UP_TO:
        h.update(data)
    else:
        middle = len(data) // 2 - SAMPLE // 2
        for at in (0, middle, len(data) - SAMPLE):
            h.update(data[at : at + SAMPLE])
    return h.digest()


def partial_file_digest(path: str | Path, size: int) -> bytes | None:
    """:func:`partial_digest` of a file, reading the samples only; None where it can't be read."""
    h = hashlib.blake2b(size.to_bytes(8, "little"), digest_size=16)
    spans = [(0, size)] if size <= WHOLE_UP_TO else [(0, SAMPLE), (size // 2 - SAMPLE // 2, SAMPLE), (size - SAMPLE, SAMPLE)]
    try:
        if size:
            with open(path, "rb") as f:
                for at, n in spans:
                    f.seek(at)
                    h.update(f.read(n))
    except OSError:
        return None
    return h.digest()


def full_file_digest(path: str | Path) -> bytes | None:
    """The 32-byte hash of a whole file; None where it can't be read."""
    h = hashlib.blake2b(digest_size=32)
    try:
        with open(path, "rb") as f:
            while block := f.read(READ):
                h.update(block)
    except OSError:
        return None
    return h.digest()
