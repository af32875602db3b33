"""One form for texts that look the same: decompose, replace look-alikes by their prototype, decompose again.

Only what a reader cannot see is folded: ways of encoding, half and full width, kinds of blank, invisible characters
and letters of other scripts drawn like Latin ones. Case, accents, circled digits and variant characters stay.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagaspark.session import cut

# Letters of Cyrillic, Greek, Armenian, Coptic and Cherokee, letters of Latin extensions, and marks, that are drawn like the character after them.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "ϲ": "c", "ϳ": "j", "α": "a", "ρ": "p", "γ": "y", "υ": "u", "σ": "o", "Ϲ": "C", "Ϳ": "J",
    "У": "Y", "ү": "y", "Ѵ": "V", "Ӏ": "I", "ӏ": "l", "Ь": "b", "З": "3", "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ʏ": "y", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ѕ": "s",
    "օ": "o", "ո": "n", "ս": "u", "ց": "g", "հ": "h", "զ": "q", "յ": "j", "Օ": "O", "Տ": "S", "Ս": "U", "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "ⲥ": "c", "Ⲥ": "C", "Ⲏ": "H", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲧ": "T",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "‐": "-", "‑": "-", "‒": "-", "−": "-", "‧": "·", "・": "·", "•": "·", "∙": "·", "⋅": "·", "․": ".", "…": "...", "‘": "'", "’": "'", "ʼ": "'", "ʹ": "'", "∕": "/", "⁄": "/", "∶": ":", "꞉": ":",
}

#: Blocks whose compatibility mappings only change how a character is encoded or how wide it is drawn.
SAME_LOOK = ((0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB06), (0xFF01, 0xFFEF), (0x01C7, 0x01CC), (0x01F1, 0x01F3))


@lru_cache(maxsize=1)
def prototypes() -> dict[int, str]:
    """Code point to prototype, by rule over all of Unicode plus the fixed look-alikes."""
    out: dict[int, str] = {}
    for o in range(0x80, sys.maxunicode + 1):
        ch = chr(o)
        kind = unicodedata.category(ch)
        if kind in ("Cf", "Cc") and ch != "\x85" or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5):
            out[o] = ""
        elif kind in ("Zs",):
            out[o] = " "
        elif any(a <= o <= b for a, b in SAME_LOOK):
            like = unicodedata.normalize("NFKD", ch)
            out[o] = "".join(LOOK_ALIKES.get(c, c) for c in like)
    out |= {ord(a): b for a, b in LOOK_ALIKES.items()}
    out |= {0x0B: " ", 0x0C: " ", 0x09: " ", 0x0D: "\n"}
    return out


def skeleton(text: str) -> str:
    """The form in which equal-looking texts are equal; blanks at the ends don't count."""
    if text.isascii():
        return text.replace("\r\n", "\n").translate(prototypes()).strip()
    text = unicodedata.normalize("NFD", text).replace("\r\n", "\n").translate(prototypes())
    return unicodedata.normalize("NFD", text).strip()


@F.pandas_udf(T.StringType())
def skeleton_of(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else skeleton(t))


def look_alike_pairs(rows: DataFrame, group: list[str], key: str, text: str) -> DataFrame:
    """Pairs (key_a < key_b, per ``group``) of rows whose texts look the same and differ in code points.

    Rows with a null group, key or text have no partner; empty texts look like texts of invisible characters or
    blanks; repeated rows count once. Rows are first reduced to skeletons that more than one text has, so that
    groups of equal texts, however large, form no pairs.
    """
    # Digests are taken where the texts are read; no text is shuffled.
    digest = lambda c: F.unhex(F.md5(c))
    r = rows.select(*group, F.col(key).alias("k"), F.col(text).alias("t")).dropna()
    r = cut(r.select(*group, "k", digest(F.col("t")).alias("h"), digest(skeleton_of("t")).alias("s")).distinct())
    alike = r.groupBy(*group, "s").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").select(*group, "s")
    r = r.join(alike, [*group, "s"], "left_semi")
    a, b = r.withColumnsRenamed({"k": "key_a", "h": "ha"}), r.withColumnsRenamed({"k": "key_b", "h": "hb"})
    return a.join(b, [*group, "s"]).where("key_a < key_b and ha != hb").select(*group, "key_a", "key_b").distinct()


def one_form(rows: DataFrame, text: str, to: str) -> DataFrame:
    """``rows`` with column ``to`` holding the skeleton of ``text``; a null stays null."""
    return rows.withColumn(to, skeleton_of(F.col(text)))


def form_class(rows: DataFrame, text: Column | str) -> Column:
    """Class id of a text: the digest of its skeleton."""
    return F.sha2(skeleton_of(text), 256)
