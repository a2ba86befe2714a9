"""One consistent form for text that looks the same.

Most text is already in the form. A quick-check character class, built from the Unicode properties, marks the unstable
places; each is widened to its word (the boundary context: a mark needs its base, a look-alike letter its word), only
that segment is normalised, and the result is spliced between the untouched stretches.

The form: compatibility variants are replaced (but superscripts and subscripts stay, and so do spacing accents), accents
are composed, invisible characters are removed, every space but tab and line end is the plain one, and look-alike letters
of another script inside a Latin word are Latin. Nulls stay null, empty text stays empty; text of any length is read whole.
"""

from __future__ import annotations

import functools
import itertools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters of other scripts whose skeleton is one Latin letter in the Unicode confusables data (UTS #39). Small Greek letters
# that are used as symbols (alpha, gamma, iota, kappa, sigma, upsilon) are not taken: beside Latin letters they stand for themselves.
_CONFUSABLE = {
    "CYRILLIC": ("АВЕЅІӀЈКМНОРСТУХҮЬԌԚԜѴ" "асеҽѕіӏјорухүһгԁԛԝѵ", "ABESIIJKMHOPCTYXYbGQWV" "aceesiljopyxyhrdqwv"),
    "GREEK": ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϺϜ" "νορϲϳ", "ABEZHIKMNOPTYXCJMF" "vopcj"),
    "ARMENIAN": ("ՕՏՍ" "օոսհցզգյ", "OSU" "onuhgqqj"),
    "COPTIC": ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ" "ⲟⲣⲥ", "BHIKMNOPCTYX" "opc"),
    "CHEROKEE": ("ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ", "DRTiYAJEWMHYGZbRWSVSLCPKdGB"),
    "LISU": ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),
}
LOOKALIKE = {c: x for letters, plain in _CONFUSABLE.values() for c, x in zip(letters, plain, strict=True)}
_INVISIBLE_EXTRA = "͏ᅟᅠ឴឵ㅤﾠ"  # without width, but not of the format category


def invisible(c: str) -> bool:
    kind, n = unicodedata.category(c), ord(c)
    return kind == "Cf" or c in _INVISIBLE_EXTRA or (kind == "Cc" and c not in "\t\n\r\v\f\x85") or 0xFE00 <= n <= 0xFE0F or 0xE0100 <= n <= 0xE01EF or 0x180B <= n <= 0x180F


def odd_space(c: str) -> bool:
    return c != " " and (unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\v\f\x85")


def kept(c: str) -> bool:
    """Variants that stay: superscripts, subscripts, spacing accents."""
    d = unicodedata.decomposition(c)
    return d.startswith(("<super>", "<sub>", "<compat> 0020 "))


def unstable(c: str) -> bool:
    """The quick check of one character: not surely in the form wherever it stands. Marks that never compose are sure unless two meet."""
    if invisible(c) or odd_space(c) or c in LOOKALIKE:
        return True
    if kept(c):
        return False
    return not unicodedata.is_normalized("NFKC", c) or _composes(c)


def mark(c: str) -> bool:
    return unicodedata.combining(c) > 0


@functools.cache
def _second() -> frozenset[str]:
    """Characters that may compose with one before them."""
    out = set()
    for n in range(0xA0, 0x12000):
        d = unicodedata.decomposition(chr(n))
        if d and d[0] != "<" and " " in d:
            out.add(chr(int(d.split()[-1], 16)))
    return frozenset(out | {chr(n) for n in range(0x1161, 0x1200)})  # vowel and final jamo


def _composes(c: str) -> bool:
    return c in _second()


def _class(test) -> str:
    """A character class of the characters that pass the test, and of all beyond the basic plane (rare, so not told apart)."""
    runs: list[list[int]] = []
    for n in range(0x10000):
        if 0xD800 <= n <= 0xDFFF or 0x3400 <= n <= 0x9FFF or 0xAC00 <= n <= 0xD7A3:
            continue  # surrogates; ideographs and syllables are stable
        if test(chr(n)):
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs) + "\\U00010000-\\U0010ffff]"


@functools.cache
def _patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    bad, marks = _class(unstable), _class(mark)
    found = re.compile(f"{bad}|{marks}{{2,}}")
    rest = re.compile(f"(?:[^\\W_]|{bad}|{marks})*")
    return found, rest, re.compile(f"[^\\W\\d_](?:[^\\W\\d_]|{marks})*")  # the last is a word: letters with their marks


def _script(c: str) -> str:
    return unicodedata.name(c, "").split(" ", 1)[0]


def _latin_word(m: re.Match) -> str:
    word = m.group()
    foreign = [c for c in word if c > "ɏ" and _script(c) in _CONFUSABLE]
    if not foreign or len(foreign) == sum(map(str.isalpha, word)) or not all(c in LOOKALIKE for c in foreign):
        return word
    return "".join(LOOKALIKE.get(c, c) for c in word)


@functools.lru_cache(1 << 16)
def canonical_segment(s: str) -> str:
    seen = "".join(" " if odd_space(c) else "" if invisible(c) else c for c in s)
    parts = ("".join(g) if k else unicodedata.normalize("NFKC", "".join(g)) for k, g in itertools.groupby(seen, kept))
    return unicodedata.normalize("NFC", _patterns()[2].sub(_latin_word, unicodedata.normalize("NFC", "".join(parts))))


def consistent(text: str | None) -> str | None:
    """The consistent form of a text; see the module."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    found, rest, _ = _patterns()
    out, done = [], 0
    for m in found.finditer(text):
        at, end = m.span()
        if at < done:
            continue  # inside the last segment
        while at > done and (text[at - 1].isalnum() or unicodedata.combining(text[at - 1])):
            at -= 1
        if at > done and unicodedata.category(text[at - 1])[0] != "C":
            at -= 1  # the base of a mark may be no letter
        end = rest.match(text, end).end()
        out += (text[done:at], canonical_segment(text[at:end]))
        done = end
    return "".join(out) + text[done:] if out else text


def _consistent_series(values: pd.Series) -> pd.Series:
    return values.map(consistent, na_action="ignore")


def consistent_column(c: Column) -> Column:
    """The consistent form of a column. Only values with anything but plain ASCII cross into Python."""
    udf = F.pandas_udf(_consistent_series, StringType())
    odd = c.rlike(r"[^\t\n\r\x20-\x7e]")
    return F.when(odd, udf(F.when(odd, c))).otherwise(c)


def fields(questions: DataFrame | None, blocks: DataFrame | None, *extra: str) -> DataFrame:
    """(table_name, record_id, field, value): the question, each option value and each block's text; extra columns go along.

    A null record id is kept as it is; null values and null option maps give no row.
    """
    parts = []
    if questions is not None:
        pairs = F.concat(
            F.array(F.struct(F.lit("question").alias("field"), F.col("question").alias("value"))),
            F.coalesce(F.transform(F.map_entries("options"), lambda e: F.struct(F.concat(F.lit("options."), e["key"]).alias("field"), e["value"].alias("value"))), F.array()),
        )
        parts.append(questions.select(F.lit("questions").alias("table_name"), F.col("question_uid").alias("record_id"), F.explode(pairs).alias("p"), *extra).select("table_name", "record_id", "p.field", "p.value", *extra))
    if blocks is not None:
        parts.append(blocks.select(F.lit("document_blocks").alias("table_name"), F.col("block_uid").alias("record_id"), F.lit("text").alias("field"), F.col("text").alias("value"), *extra))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("value").isNotNull())


def differing(values: DataFrame) -> DataFrame:
    """Fields whose value differs from its consistent form, with that form; one row per distinct field and value."""

    def changed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b.assign(form=b["value"].map(consistent))
            yield b[b["form"] != b["value"]]

    odd = values.filter(F.col("value").rlike(r"[^\t\n\r\x20-\x7e]")).select("table_name", "record_id", "field", "value")
    return odd.mapInPandas(changed, "table_name string, record_id bigint, field string, value string, form string").dropDuplicates()


