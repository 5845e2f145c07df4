"""Texts that look the same, in one form.

Letters fall into classes of letters that look alike in Latin, Greek and Cyrillic. The resolved scripts of a letter
are those in which its class has a letter; intersected over a token they are the scripts that the whole token can be
spelled in. One such script: the token is spelled in it (it may have been mixed). Several: the token is a
whole-script confusable and takes the first of Latin, Greek, Cyrillic. None: each letter takes the first
script of its class. All of this depends only on the classes, so tokens that look alike get one spelling, and
as classes are kept apart, others do not become equal.

Remaining forms: full-width, half-width and font variants, ligatures, compatibility spaces, composed and combining
accents, invisible characters, line ends and trailing space. Raised and circled characters, fractions and other
forms that a reader can tell apart stay, as do letter case, accents and digits.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.session import cut_lineage, ship_package

SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")

# Letters that look alike, each row in the order Latin, Greek, Cyrillic ("." where there is none).
LETTERS = """
A Α А
B Β В
C Ϲ С
E Ε Е
G . Ԍ
H Η Н
I Ι І
J Ϳ Ј
K Κ К
M Μ М
N Ν .
O Ο О
P Ρ Р
Q . Ԛ
S . Ѕ
T Τ Т
V . Ѵ
W . Ԝ
X Χ Х
Y Υ Ү
Z Ζ .
a . а
c . с
d . ԁ
e . е
h . һ
i . і
j ϳ ј
o ο о
p . р
q . ԛ
s . ѕ
v ν ѵ
w . ԝ
x . х
y . у
. Γ Г
. Π П
"""

# Invisible characters besides those of the category of format characters.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
# Format characters that are visible (signs around numbers).
VISIBLE_FORMAT = [*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD]
# Compatibility forms that a reader can tell from what they stand for: long s and Greek symbols.
DISTINCT = [0x017F, *range(0x03D0, 0x03D7), *range(0x03F0, 0x0400)]

_JOINER = "\u200d"
_HELD = "\U0010fffd"  # stands for a joiner within an emoji sequence, where it is visible
_EMOJI_JOINER = regex.compile(r"(?<=[\p{Extended_Pictographic}\p{Emoji_Modifier}]\ufe0f?)\u200d(?=\p{Extended_Pictographic})")
_LINE_END = regex.compile(r"\r\n?|[\u2028\u2029\u0085]")
_TRAILING = regex.compile(r"[ \t]+(?=\n|\Z)")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_TWO_SCRIPTS = regex.compile(r"[\p{Greek}\p{Cyrillic}]")
_VISIBLE = regex.compile(r"[^\s\p{Cc}\p{Cf}\p{Zs}]")


@lru_cache(maxsize=1)
def letter_classes() -> dict[str, tuple[str | None, str | None, str | None]]:
    """Each letter with its look-alikes by script."""
    rows = [tuple(None if x == "." else x for x in line.split()) for line in LETTERS.split("\n") if line]
    return {x: row for row in rows for x in row if x}


def _plain(ch: str) -> str | None:
    """What a character becomes on its own; None if it stays."""
    code, kind = ord(ch), unicodedata.category(ch)
    if code in INVISIBLE or kind == "Cf" and code not in VISIBLE_FORMAT or kind == "Cc" and ch not in "\t\n\r":
        return ""
    if kind == "Zs":
        return " " if ch not in " \u1680" else None
    if code in (0x2010, 0x2011):
        return "-"
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if not tag.startswith("<") or code in DISTINCT:
        return None
    meant = "".join(chr(int(x, 16)) for x in rest.split())
    if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and (kind[0] == "L" or kind == "Nl") and meant.isalpha():
        return meant
    return None


@lru_cache(maxsize=1)
def plain_forms() -> dict[int, str]:
    """The table of ``_plain`` over all of Unicode, by rule."""
    found = ((code, _plain(chr(code))) for code in range(128, sys.maxunicode + 1) if not 0xD800 <= code <= 0xDFFF and not 0xE000 <= code <= 0xF8FF)
    controls = {code: "" for code in range(32) if chr(code) not in "\t\n\r"}
    return {code: to for code, to in found if to is not None} | controls | {127: ""}


def _scripts(ch: str) -> frozenset[str] | None:
    """The scripts that a letter's class has a letter in; None for marks and letters of other scripts' own accord."""
    row = letter_classes().get(ch)
    if row:
        return frozenset(s for s, x in zip(SCRIPTS, row) if x)
    if unicodedata.category(ch)[0] == "M":
        return None
    return frozenset([unicodedata.name(ch, "?").split()[0]])


@lru_cache(maxsize=100_000)
def spell_token(token: str) -> str:
    """One spelling for all tokens that look like this one (decomposed letters and marks)."""
    common: frozenset[str] | None = None
    for ch in token:
        own = _scripts(ch)
        if own is not None:
            common = own if common is None else common & own
    classes = letter_classes()
    order = [s for s in SCRIPTS if common and s in common] or list(SCRIPTS)
    out = []
    for ch in token:
        row = classes.get(ch)
        by = dict(zip(SCRIPTS, row)) if row else {}
        out.append(next((by[s] for s in order if by.get(s)), ch))
    return "".join(out)


def one_form(text: str, plain: dict[int, str] | None = None) -> str:
    """The form of one text."""
    if not text.isascii():
        if _JOINER in text:
            text = _EMOJI_JOINER.sub(_HELD, text)
        text = _LINE_END.sub("\n", text)
        text = text.translate(plain if plain is not None else plain_forms())
        text = unicodedata.normalize("NFD", text)
        if _TWO_SCRIPTS.search(text):
            text = _TOKEN.sub(lambda m: spell_token(m[0]) if len(m[0]) < 1000 else spell_token.__wrapped__(m[0]), text)
        text = unicodedata.normalize("NFC", text).replace(_HELD, _JOINER)
    else:
        if "\r" in text:
            text = _LINE_END.sub("\n", text)
        if not text.isprintable():
            text = text.translate(plain if plain is not None else plain_forms())
    return _TRAILING.sub("", text).rstrip("\n")


def is_visible(text: str) -> bool:
    return _VISIBLE.search(text) is not None


def unified(text: Column) -> Column:
    """The one form of a text; NULL for NULL."""
    table = plain_forms()  # a few thousand entries, fixed by Unicode; made once, by the driver

    @F.pandas_udf("string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else one_form(t, table) for t in batch], dtype=object)

    return forms(text)


def unify_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``form`` of every row. NULL texts have a NULL form, empty and invisible ones an empty or blank form."""
    ship_package(documents.sparkSession)
    return documents.select(F.col(key), unified(F.col(text)).alias("form"))


#: Documents of one spelling in a block; two blocks meet in one task.
BLOCK = 2_000


def digests(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Key, digest of the form and digest of the text, of documents with a visible character.

    Written once, as its users read it several times and the forms are what costs.
    """
    ship_package(documents.sparkSession)
    form = unified(F.col(text))
    seen = F.when(form.rlike(r"[^\s\p{Cc}\p{Cf}\p{Zs}]"), F.md5(form))
    made = documents.where(F.col(text).isNotNull()).select(F.col(key).alias("__id"), seen.alias("__f"), F.md5(F.col(text)).alias("__t"))
    # filtered after it is written: a filter before would be pushed below the forms and make them once more
    return cut_lineage(made).where(F.col("__f").isNotNull())


def lookalike_pairs(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of documents that look the same and are not the same string: ``{key}_a`` < ``{key}_b``.

    Spellings are cut into blocks of about ``BLOCK`` documents. Blocks of different spellings of one class are paired, the documents
    of both sides are sent to each pair of blocks that theirs is in, and meet there: no task gets more than two blocks, however
    many copies a spelling or spellings a class has, and exact copies are never compared with each other. Defined results: NULL
    texts and texts without a visible character are in no pair; repeated rows of one key give their pairs once; an
    empty table gives no rows.
    """
    rows = digests(documents, key, text).distinct()
    spellings = rows.groupBy("__f", "__t").agg(F.count(F.lit(1)).alias("__n"))
    several = spellings.groupBy("__f").agg(F.count(F.lit(1)).alias("__s")).where("__s > 1").select("__f")
    spellings = cut_lineage(spellings.join(several, "__f").select("__f", "__t", F.ceil(F.col("__n") / F.lit(BLOCK)).cast("int").alias("__parts")))
    blocks = spellings.select("__f", "__t", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__p"))
    side = lambda x: blocks.select("__f", F.col("__t").alias(f"__t{x}"), F.col("__p").alias(f"__p{x}"))
    pairs = side(1).join(side(2), "__f").where("__t1 < __t2")
    placed = rows.join(spellings, ["__f", "__t"]).select("__f", "__t", F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int").alias("__p"), "__id")
    sent = lambda x, out: placed.withColumnsRenamed({"__t": f"__t{x}", "__p": f"__p{x}", "__id": out}).join(pairs, ["__f", f"__t{x}", f"__p{x}"])
    met = sent(1, "__a").join(sent(2, "__b"), ["__f", "__t1", "__p1", "__t2", "__p2"]).where(F.col("__a") != F.col("__b"))
    return met.select(F.least("__a", "__b").alias(f"{key}_a"), F.greatest("__a", "__b").alias(f"{key}_b")).distinct()


def lookalike_classes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with a visible character, the least key of its class (``class_id``), and the number of spellings in it."""
    rows = digests(documents, key, text)
    spellings = rows.groupBy("__f", "__t").agg(F.min("__id").alias("__id"))
    classes = spellings.groupBy("__f").agg(F.min("__id").alias("class_id"), F.count(F.lit(1)).alias("spellings"))
    return rows.join(classes, "__f").select(F.col("__id").alias(key), "class_id", "spellings")
