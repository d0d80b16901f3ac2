"""Text functions: white space, tokens, normal forms and the Arabic clean-up steps. Built-ins only, but for normal forms."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Bytes of a batch of texts that a Python worker holds at once, as texts may be long.
BATCH_BYTES = 4 << 20

#: The code points that count as white space, and ranges of the Arabic script.
SPACE = r"\t\n\x0B\f\r\x1C-\x1F \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
MARKS = r"\x{064B}-\x{0652}"
INVISIBLE = "\u200c\u200d\u200b\u200e\u200f\ufeff"
ALEF_FORMS, ALEF = "\u0622\u0623\u0625\u0671", "\u0627"
WESTERN, EASTERN = ",;?", "\u060c\u061b\u061f"


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else unicodedata.normalize("NFKC", x))


def small_batches() -> None:
    """The session's batches are made small, for good, as the plan may run long after this call: by rows alone, 10 000 whole texts would be one."""
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _unless_ascii(form, s: Column) -> Column:
    """The Python step sees nulls where the text is ASCII, which no normal form changes."""
    small_batches()
    return F.coalesce(form(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)


def _stable() -> str:
    """Characters of Latin text that neither normal form changes, with whatever other of them beside, as a class."""
    codes = [c for c in (*range(0x250), *range(0x2010, 0x2060)) if chr(c) not in INVISIBLE and not unicodedata.combining(chr(c)) and unicodedata.normalize("NFKC", chr(c)) == chr(c)]
    starts = [c for c in codes if c - 1 not in codes]
    return "".join(rf"\x{{{a:04X}}}-\x{{{next(c for c in range(a, 0x2061) if c + 1 not in codes):04X}}}" for a in starts)


#: Other characters than these, and white space but the blank. ASCII is left at the first look: a class of many ranges costs each of them.
UNSTABLE = rf"[\x{{0080}}-\x{{10FFFF}}&&[^{_stable()}]]"
OTHER_SPACE = rf"[\x{{0000}}-\x{{001F}}\x{{0080}}-\x{{FFFF}}&&[{SPACE.replace(' ', '')}]]"


@F.arrow_udf(ArrayType(StringType()))
def _all_forms(lists: pa.Array) -> pa.Array:
    gone = str.maketrans("", "", INVISIBLE)
    forms = [x if x is None else unicodedata.normalize("NFKC", unicodedata.normalize("NFC", x).translate(gone)) for x in lists.flatten().to_pylist()]
    ends = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(forms, pa.string()))


def normal_forms(texts: Column) -> Column:
    """Of an array of texts those that normal forms may change, in them and without invisible characters; the others are null. One step for each row."""
    small_batches()
    return _all_forms(F.transform(texts, lambda t: F.when(t.rlike(UNSTABLE), t)))


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once, also where body names it often or inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nfc(s: Column) -> Column:
    return _unless_ascii(_nfc, s)


def nfkc(s: Column) -> Column:
    return _unless_ascii(_nfkc, s)


def strip(s: Column) -> Column:
    return F.regexp_replace(s, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank(s: Column) -> Column:
    """Whether a text is white space only, which its first other character tells."""
    return ~s.rlike(f"[^{SPACE}]")


def collapse(s: Column) -> Column:
    """Runs of white space become one space, none at the ends."""
    return F.trim(F.regexp_replace(s, f"[{SPACE}]+", " "))


def normalize(s: Column) -> Column:
    return collapse(nfc(s))


def words(normal: Column) -> Column:
    """Tokens of a collapsed text; none for an empty one."""
    return F.filter(F.split(normal, " "), lambda w: w != "")


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _count_of(chars: str, s: Column) -> Column:
    """How many characters are in a class: what is gone when its runs are taken out, as a match for each would cost more."""
    return F.length(s) - F.length(F.regexp_replace(s, f"[{chars}]+", ""))


def arabic_chars(s: Column) -> Column:
    return _count_of(ARABIC, s)


def marks(s: Column) -> Column:
    return _count_of(MARKS, s)


def arabic_ratio(s: Column) -> Column:
    return F.when(s == "", F.lit(0.0)).otherwise(arabic_chars(s) / F.length(s))


def arabic_word_tokens(s: Column) -> Column:
    """Tokens with two base letters or more: in range, but neither mark nor tatweel. One match is one token, from its first character."""
    # the commonest ranges first, without an intersection, which costs several times as much for each character
    base = r"[\x{0600}-\x{063F}\x{0641}-\x{064A}\x{0653}-\x{06FF}\x{0750}-\x{077F}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
    inside = rf"[!-~\x{{00A1}}-\x{{167F}}[^{SPACE}]]"
    return F.regexp_count(s, F.lit(f"(?<!{inside}){inside}*?{base}{inside}*?{base}{inside}*+"))


def diacritic_density(s: Column) -> Column:
    return F.when(s == "", F.lit(0.0)).otherwise(marks(s) / F.length(s))


def repeated_run(s: Column) -> Column:
    """Five equal characters in a row, line feeds aside."""
    return s.rlike(r"([^\n])\1{4}")


def doc_type(s: Column) -> Column:
    return type_at(diacritic_density(s))


def type_at(d: Column) -> Column:
    return F.when(d > 0.15, "quranic_or_classical").when(d > 0.05, "partially_diacritized").otherwise("modern_printed")


def strip_invisible(s: Column) -> Column:
    return F.translate(s, INVISIBLE, "")


def strip_kashida(s: Column) -> Column:
    return F.regexp_replace(s, r"\x{0640}+", "")


def dedup_diacritics(s: Column) -> Column:
    return F.regexp_replace(s, rf"([{MARKS}])\1+", "$1")


def fold_alef(s: Column) -> Column:
    return F.translate(s, ALEF_FORMS, ALEF * len(ALEF_FORMS))


def arabic_punct(s: Column) -> Column:
    """Western , ; ? next to Arabic turn Arabic. What was just turned counts as Arabic for the next, so a run turns forwards:
    all of it after Arabic, and only its last one before Arabic. Runs and what lies between them are the pieces of a split."""

    def turned(pieces: Column) -> Column:
        def turn(x: Column) -> Column:
            return F.translate(x, WESTERN, EASTERN)

        def one(piece: Column, i: Column) -> Column:
            before = F.right(F.get(pieces, i - 1), F.lit(1)).rlike(f"[{ARABIC}]")
            after = F.left(F.get(pieces, i + 1), F.lit(1)).rlike(f"[{ARABIC}]")
            last = F.concat(F.left(piece, F.length(piece) - 1), turn(F.right(piece, F.lit(1))))
            return F.when(piece.rlike("^[,;?]"), F.when(before, turn(piece)).when(after, last).otherwise(piece)).otherwise(piece)

        return F.array_join(F.transform(pieces, one), "")

    edges = "(?<=[,;?])(?![,;?])|(?<![,;?])(?=[,;?])"
    return let(s, lambda t: F.when(t.rlike("[,;?]") & t.rlike(f"[{ARABIC}]"), let(F.split(t, edges), turned)).otherwise(t))


def filter_isolated(s: Column) -> Column:
    """Drops tokens of one character of the Arabic block if at least four tokens in five stay."""

    def kept(t: Column, tokens: Column) -> Column:
        return let(F.filter(tokens, lambda w: ~w.rlike(r"^[\x{0600}-\x{06FF}]$")), lambda k: F.when((F.size(tokens) > 0) & (F.size(k) / F.size(tokens) >= 0.8), F.array_join(k, " ")).otherwise(t))

    return let(s, lambda t: let(words(collapse(t)), lambda tokens: kept(t, tokens)))


def arabic_correct(s: Column, alef: bool = False, isolated: bool = True) -> Column:
    """The clean-up steps in their order; a blank text is returned as it is."""
    return _cleaned(s, nfkc(strip_invisible(nfc(s))), alef, isolated)


def _cleaned(s: Column, forms: Column, alef: bool, isolated: bool) -> Column:
    t = dedup_diacritics(strip_kashida(forms))
    t = arabic_punct(t)
    t = fold_alef(t) if alef else t
    t = filter_isolated(t) if isolated else t
    return F.when(blank(s), s).otherwise(strip(t))


def arabic_corrected(texts: Column, forms: Column, alef: bool = False, isolated: bool = True) -> Column:
    """`arabic_correct` of each of an array of texts, with their `normal_forms`. A tidy Latin text stays as it is."""

    def one(s: Column, i: Column) -> Column:
        form = F.get(forms, i)
        tidy = ~s.rlike(OTHER_SPACE) & ~F.contains(s, F.lit("  ")) & ~F.startswith(s, F.lit(" ")) & ~F.endswith(s, F.lit(" "))
        return F.when(form.isNull() & tidy, s).otherwise(_cleaned(s, F.coalesce(form, s), alef, isolated))

    return F.transform(texts, one)


@F.pandas_udf(StringType())
def _shaped(s: pd.Series) -> pd.Series:
    try:
        from arabic_reshaper import reshape
        from bidi.algorithm import get_display
    except ImportError:  # without them the text is shown as it is stored
        return s
    return s.map(lambda x: x if x is None else get_display(reshape(x)))


def display(s: Column) -> Column:
    """Text in the order and shapes of display, where it holds Arabic and the libraries for it are there."""
    return F.coalesce(_shaped(F.when(s.rlike(r"[\x{0600}-\x{06FF}]"), s)), s)
