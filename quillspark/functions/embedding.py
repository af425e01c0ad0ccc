"""A stand-in embedder: hashed word counts.

The embedding model is an outside service given to ``operators.vector.embed`` as a
callable. This one needs no model and is reproducible, which is what checks need.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIMENSION = 64
# Letters and decimal digits, as the tokenizer takes them: \w also has fractions, superscripts and the like.
_OTHER_NUMBERS = re.escape("".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not (c.isalpha() or c.isdecimal())))
_WORD = re.compile(rf"[^\W_{_OTHER_NUMBERS}]+")
#: Words, and words joined by other numbers: found far sooner than ``_WORD``.
_RUN = re.compile(r"[^\W_]+")


#: Runs whose codes are kept, and the longest of them.
_KEPT, _LONGEST = 1 << 18, 64


class _Codes(dict):
    """The words of a run, each as a character: its dimension, and 64 more if it counts down.

    Runs come again and again, so their words are hashed once. Travels empty.
    """

    def __missing__(self, run: str) -> str:
        words = [run] if run.isascii() or run.isalpha() else _WORD.findall(run)
        digests = (hashlib.sha256(word.encode()).digest() for word in words)
        codes = "".join(chr(d[0] % DIMENSION + DIMENSION * (d[1] % 2)) for d in digests)
        if len(run) <= _LONGEST:
            if len(self) >= _KEPT:
                self.clear()
            self[run] = codes
        return codes

    def __reduce__(self) -> tuple:
        return _Codes, ()


_codes = _Codes()


def hashed_words(texts: list[str]) -> np.ndarray:
    """Counts of the words of each text; two capitals that would not become one letter by themselves are mapped first."""
    vectors = np.zeros((len(texts), DIMENSION), dtype=np.float32)
    for row, text in enumerate(texts):
        lowered = text.replace("Σ", "σ").replace("İ", "i").lower()
        codes = "".join(map(_codes.__getitem__, _RUN.findall(lowered))).encode()
        counts = np.bincount(np.frombuffer(codes, np.uint8), minlength=2 * DIMENSION)
        vectors[row] = counts[:DIMENSION] - counts[DIMENSION:]
    return vectors
