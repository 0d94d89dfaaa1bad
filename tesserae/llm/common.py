"""What several operators share: token patterns, the hold-out rule, text as code points."""

import ctypes
import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space, as all contracts here define it.
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def ascii_lower(text: str) -> str:
    """A-Z lowered, all else as it is."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo `modulus`; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def unit_hash(column: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the value and the seed alone."""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_ALPHA: list[np.ndarray] = []


def alpha_table() -> np.ndarray:
    """For every code point, whether it is a letter."""
    if not _ALPHA:
        _ALPHA.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _ALPHA[0]


_TASK: list[int] = []


def lean() -> None:
    """Once for each task, has this worker process give what it has freed back to the system: the C library keeps it
    otherwise, so that a worker holds on to its largest moment. Does nothing where the library has no such call."""
    from pyspark import TaskContext

    context = TaskContext.get()
    task = context.taskAttemptId() if context is not None else -1
    if _TASK != [task]:
        _TASK[:] = [task]
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
