"""What a score takes from texts, for many of them at once: the figures that `text`'s column functions give one by one.

The characters of a batch stand one text after the other in an array, so each is looked at once, in a table of kinds.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from . import text as T

FACTS = ("n_chars", "n_arabic", "n_marks", "n_tokens", "repeated")
#: About as many bytes of text are looked at together, so that their arrays stay in a processor's cache.
PORTION = 1 << 18
#: Kinds of characters, as bits: white space, Arabic letters and marks, marks, and letters that make a word token.
SPACE, ARABIC, MARK, BASE = 1, 2, 4, 8


def _ranges(pattern: str) -> list[tuple[int, int]]:
    """First and last code points of the ranges of a character class."""
    plain = re.sub(r"\\x\{?([0-9A-Fa-f]{2,4})\}?", lambda m: chr(int(m[1], 16)), pattern.replace(r"\t", "\t").replace(r"\n", "\n").replace(r"\f", "\f").replace(r"\r", "\r"))
    return [(ord(m[1]), ord(m[2] or m[1])) for m in re.finditer(r"(?s)(.)(?:-(.))?", plain)]


@functools.cache
def _kinds() -> np.ndarray:
    table = np.zeros(0x110000, dtype=np.uint8)
    for pattern, kind in ((T.SPACE, SPACE), (T.ARABIC, ARABIC | BASE), (T.MARKS, MARK)):
        for first, last in _ranges(pattern):
            table[first : last + 1] |= kind
    table[(table & MARK) > 0] &= 255 - BASE
    table[0x640] &= 255 - BASE  # tatweel
    return table


def _characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts one after the other, and how many each has; a null has none."""
    texts = texts.fill_null("")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1]
    held = memoryview(texts.buffers()[2] or b"")[int(ends[0]) : int(ends[-1])]
    if len(held) == lengths.sum():
        return np.frombuffer(held, dtype=np.uint8), lengths
    return np.frombuffer(str(held, "utf-8").encode("utf-32-le", "surrogatepass"), dtype="<u4"), lengths


def facts_of(texts: pa.Array) -> dict[str, np.ndarray]:
    """FACTS of each text; n_chars and repeated are those of the stripped text."""
    n = len(texts)
    out = {f: np.zeros(n, dtype=np.int32) for f in FACTS}
    codes, lengths = _characters(texts) if n else (np.zeros(0, np.uint8), np.zeros(0, np.int64))
    if not len(codes):
        return out
    ends = np.cumsum(lengths)
    starts, some = ends - lengths, lengths > 0
    kinds = _kinds()[codes]
    spaces = (kinds & SPACE) > 0

    first, last = starts.copy(), ends - 1
    for k in np.flatnonzero(some)[spaces[starts[some]] | spaces[last[some]]]:
        signs = np.flatnonzero(~spaces[starts[k] : ends[k]])
        first[k], last[k] = (starts[k] + signs[0], starts[k] + signs[-1]) if len(signs) else (ends[k], ends[k] - 1)
    out["n_chars"][:] = last - first + 1
    same = codes[1:] == codes[:-1]
    runs = np.flatnonzero(same[:-3] & same[1:-2] & same[2:-1] & same[3:]) if len(same) > 3 else np.zeros(0, np.int64)
    runs = runs[codes[runs] != 10]
    of = np.searchsorted(ends, runs, side="right")
    out["repeated"][of[(runs >= first[of]) & (runs + 4 <= last[of])]] = 1

    found = int(np.bitwise_or.reduce(kinds))
    for name, kind in (("n_arabic", ARABIC), ("n_marks", MARK)):
        if found & kind:
            upto = np.append(0, np.cumsum((kinds & kind) > 0, dtype=np.int64))
            out[name][:] = upto[ends] - upto[starts]
    if found & BASE:
        spaces[starts[some]] = True  # a token begins after white space or with its text
        edges = np.flatnonzero(spaces)
        upto = np.append(0, np.cumsum((kinds & BASE) > 0, dtype=np.int64))
        tokens = edges[np.diff(upto[np.append(edges, len(codes))]) >= 2]
        out["n_tokens"][:] = np.bincount(np.searchsorted(ends, tokens, side="right"), minlength=n)
    return out


@F.arrow_udf(StructType([StructField(f, IntegerType()) for f in FACTS]))
def _facts(texts: pa.Array) -> pa.Array:
    step = max(1, len(texts) * PORTION // max(1, texts.nbytes))
    parts = [facts_of(texts.slice(k, step)) for k in range(0, len(texts), step)] or [facts_of(texts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate([p[f] for p in parts])) for f in FACTS], names=list(FACTS), mask=texts.is_null())


def line_facts(text: Column) -> Column:
    """A struct of FACTS; null for a null text."""
    T.small_batches()
    return _facts(text)
