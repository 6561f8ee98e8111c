"""Splitting texts into words, a bounded piece of the text at a time."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator
from functools import wraps

#: Bytes of a text whose words are held at once.
PIECE_BYTES = 1 << 20
SPACE = re.compile(rb"[\x09-\x0d\x20]")


def spaced_words(data: bytes, piece: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words between ASCII white space (space, and 09 to 0D), in lists whose texts are about ``piece`` bytes."""
    start = 0
    while start < len(data):
        if len(data) - start <= piece:
            cut = len(data)
        else:
            found = SPACE.search(data, start + piece)
            cut = found.start() if found else len(data)
        if words := data[start:cut].split():
            yield words
        start = cut


def lowered(text: str | None) -> bytes:
    """UTF-8 bytes with A-Z lower-cased; none of a null text. Lone surrogates are kept as they are."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def released(function: Callable) -> Callable:
    """``function`` from batches to batches, after which a task gives what it has freed back to the system.

    Workers wait for other tasks, of other functions too, and would hold it all the while.
    """

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # only glibc can
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run
