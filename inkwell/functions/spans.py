"""Projections of block texts: citations, inline parts, images, equations, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.predicates import LABEL_AD, LABEL_AE, is_math_like
from inkwell.functions.text import all_of, first, has, inner, strip, swap

_BRACKETS = r"\[[^\]]+\]|\([^)]+\)"
_YEAR = r"\b(?:19|20)\d{2}(?![0-9])"
YEAR_TAG = r"\s*\(\s*(\d{4}[A-Za-z]?(?:-\d)?(?:\s*,\s*\d{4}[A-Za-z]?(?:-\d)?)*)\s*\)\s*$"


# Stand-ins for opening brackets that nothing closes; the search for their end would read the rest of the text each time.
_OPEN, _UNCLOSED = "[(", "\ue010\ue011"


def _closable(text: Column) -> Column:
    """The text with stand-ins for the opening brackets behind the last closing one of their kind, so that every bracket left has an end."""

    def marked(t: Column, opening: str, closing: str, sign: str) -> Column:
        rest = F.substring_index(t, closing, -1)
        return F.concat(F.substring(t, F.lit(1), F.length(t) - F.length(rest)), F.translate(rest, opening, sign))

    both = marked(marked(text, "[", "]", _UNCLOSED[0]), "(", ")", _UNCLOSED[1])
    return F.when(text.contains("[") | text.contains("("), both).otherwise(text)


def _restored(text: Column) -> Column:
    return F.translate(text, _UNCLOSED, _OPEN)


def _is_citation(bracket: Column) -> Column:
    return has(inner(bracket), _YEAR) & ~is_math_like(inner(bracket))


def appearances(text: Column) -> Column:
    """What the bracketed years of a text say, in order: lists are taken apart if all their parts look like years, else they stay whole."""

    def parts(b: Column) -> Column:
        c = inner(_restored(b))
        each = F.transform(F.split(c, ",", -1), strip)
        listed = c.contains(",") & has(c, r"(?U)^[\d\w\s,-]+$") & F.forall(each, lambda p: p.rlike(r"^\d{2,4}[a-zA-Z\d-]*$"))
        return F.when(listed, each).otherwise(F.array(strip(c)))

    return F.flatten(F.transform(F.filter(all_of(_closable(text), _BRACKETS), _is_citation), parts))


def without_citations(text: Column) -> Column:
    return strip(_restored(swap(_closable(text), _BRACKETS, lambda b: F.when(_is_citation(b), F.lit("")).otherwise(b))))


def inline_parts(text: Column) -> Column:
    """A text cut before each option label; one element if it holds no label, or only one at its start."""
    pattern = f"(?={LABEL_AD})"
    n = F.regexp_count(text, F.lit(LABEL_AD))
    whole = (n == 0) | ((n == 1) & has(text, f"^{LABEL_AD}"))
    pieces = F.filter(F.transform(F.split(text, pattern, -1), strip), lambda p: p != "")
    return F.when(whole, F.array(text)).otherwise(pieces)


def images(text: Column) -> Column:
    return all_of(text, r"\[IMG:\s*(.*?)\]", 1)


def without_images(text: Column) -> Column:
    return F.regexp_replace(text, r"\[IMG:\s*.*?\]", "")


def equations(text: Column) -> Column:
    """Formulas between dollar signs of one line."""
    return F.transform(all_of(text, r"\$(.*?)\$", 1), strip)


def role(block_type: Column, text: Column) -> Column:
    case = F.when(block_type == "table", "table").when((block_type == "image") | text.contains("[IMG:"), "image")
    case = case.when(has(text, f"^{LABEL_AE}"), "option").when(has(text, r"(?i)^(?:Statement\s*(?:I|II|1|2)|[A-E]\.\s+)"), "statement")
    return case.when(has(text, r"(?i)^\([a-zivx]+\)\s+"), "subpart").otherwise("stem")


def year_tag(text: Column) -> Column:
    """struct(tag, text): the list of years at the end of a text, cut off; tag is null if there is none."""
    tag = F.regexp_replace(first(text, YEAR_TAG, 1), " ", "")
    return F.struct(F.nullif(tag, F.lit("")).alias("tag"), F.regexp_replace(text, YEAR_TAG, "").alias("text"))


_TAG = r"\(\s*(?:19|20)\d{2}[a-zA-Z0-9,\s\-/–—]*\)"


def citation(stem: Column) -> Column:
    """struct(stem, citation): a bracketed year tag cut from the end of a stem, or else the last one anywhere; citation is null if there is none."""
    at_end = rf"(?s)^(.*?)\s*({_TAG})\s*\.?\s*$"
    inside = rf"(?s)^(.*)({_TAG})(.*)$"
    front = strip(F.regexp_replace(strip(first(stem, at_end, 1)), ":+$", ""))
    around = strip(F.regexp_replace(strip(F.concat(first(stem, inside, 1), first(stem, inside, 3))), r"\s{2,}", " "))
    case = F.when(has(stem, at_end), F.struct(front.alias("stem"), strip(first(stem, at_end, 2)).alias("citation")))
    case = case.when(has(stem, inside), F.struct(around.alias("stem"), strip(first(stem, inside, 2)).alias("citation")))
    return case.otherwise(F.struct(stem.alias("stem"), F.lit(None).cast("string").alias("citation")))


def fold_math_letters(text: Column) -> Column:
    """Styled letters and digits of the mathematical block as plain ones; nothing else changes."""
    import unicodedata

    pairs = [(chr(n), unicodedata.normalize("NFKC", chr(n))) for n in range(0x1D400, 0x1D800)]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return F.translate(text, "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def clean_noise(text: Column) -> Column:
    """Without board lines and without what follows an envelope sign on its line."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?i)For:\s*Boar\s*d\s*s", ""), r"✉.*?(?:\n|$)", ""))


def without_number(text: Column, roman: Column | None = None) -> Column:
    """Without a question number in front; 'Question 5:' stays, as only Q and digits are taken for one."""
    arabic = strip(F.regexp_replace(text, r"(?i)^(?:Q\s*)?\d+[.)]\s*", ""))
    if roman is None:
        return arabic
    return F.when(roman, strip(F.regexp_replace(text, r"(?i)^[IVX]+[.)]\s*", ""))).otherwise(arabic)


def match_columns(stem: Column) -> Column:
    """struct(intro, left_label, right_label, left, right): a match-the-column stem taken apart; numbered items are left, lettered ones right."""
    number, letter = "i{1,3}|iv|v|\\d|I{1,3}|IV|V", "[a-dA-D]"
    any_item = rf"\((?:{number}|{letter})\)"
    head, rest = first(stem, rf"(?s)^(.*?)(?={any_item}|$)", 1), F.regexp_replace(stem, rf"(?s)^.*?(?={any_item}|$)", "")

    def items(mark: str) -> Column:
        pattern = rf"(?s)\(({mark})\)\s*(.*?)(?=\s*{any_item}|\s*$)"
        return F.zip_with(all_of(rest, pattern, 1), all_of(rest, pattern, 2), lambda n, t: F.concat(F.lit("("), n, F.lit(")  "), strip(t)))

    def name(numeral: str) -> Column:
        given = F.try_element_at(all_of(head, rf"(?i)\bColumn\s+{numeral}\b(?:\s*\(([^)]+)\))?", 1), F.lit(-1))
        return F.when(F.coalesce(given, F.lit("")) == "", F.lit(f"Column {numeral}")).otherwise(strip(given))

    intro = strip(F.regexp_replace(strip(F.regexp_replace(head, r"(?is)^(.*)\bColumn\s+I\b.*$", "$1")), ":+$", ""))
    return F.struct(intro.alias("intro"), name("I").alias("left_label"), name("II").alias("right_label"), items(number).alias("left"), items(letter).alias("right"))
