"""Romanisation in column functions: letters are spelled by tables that Unicode's own names give, nothing leaves the JVM.

A text is taken apart into characters and each is looked up by its code in one table of pages. What depends on
neighbours (inherent vowels, doubled consonants, small kana, nasals) is left as a control character in the
spelling, and a few patterns over these settle it; texts without them are done after the look-up.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cyrillic letters and their spellings; the other alphabets are spelled by the names of their letters.
CYRILLIC = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяёђѓєѕіїјљњћќўџґ", "a b v g d e zh z i y k l m n o p r s t u f kh ts ch sh shch - y - e yu ya yo dj gj ye dz i yi j lj nj c kj u dz g".split()))
#: Armenian letters whose names do not begin with their sound.
ARMENIAN = {"ո": "o", "ւ": "v"}
#: Alphabets whose letters have names that begin with their sound.
ALPHABETS = ("GREEK", "ARMENIAN", "GEORGIAN", "HEBREW", "ARABIC")
#: Scripts with inherent vowels, and those that do not speak one at the end of a word.
BRAHMIC = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")
SILENT = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI")
#: Signs of nasal vowels, by the last word of their names.
NASAL = ("ANUSVARA", "CANDRABINDU", "BINDI", "TIPPI")
#: Kana whose usual spelling is not their name.
KANA = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
HANGUL, PAGE = 0xAC00, 64
#: Control characters in spellings: an inherent vowel (the first kind silent at a word's end), a vowel sign or virama, a nukta, a nasal, the marks of voiced and half-voiced kana, a small kana, a doubled consonant, nothing.
SILENT_VOWEL, VOWEL, SIGN, NUKTA, NASAL_SIGN, VOICED, HALF, SMALL, DOUBLE, NOTHING = map(chr, range(0x0E, 0x18))
#: Patterns and what they are replaced with, in order.
RULES = (
    (NUKTA, ""), (f"[{SILENT_VOWEL}{VOWEL}]{SIGN}", ""), (VOWEL, "a"), (f"{SILENT_VOWEL}(?=[a-z{NASAL_SIGN}])", "a"),
    (f"(?<![a-z])([bcdf-hj-np-tv-z]+){SILENT_VOWEL}", "$1a"), (f"{NASAL_SIGN}(?=[pbm])", "m"), (NASAL_SIGN, "n"),
    (f"(?:sh|ch)i{VOICED}", "ji"), (f"k([aiueo]){VOICED}", "g$1"), (f"t?s([aiueo]){VOICED}", "z$1"), (f"t([aiueo]){VOICED}", "d$1"), (f"[fh]([aiueo]){VOICED}", "b$1"), (f"u{VOICED}", "vu"), (f"[fh]([aiueo]){HALF}", "p$1"),
    (f"(sh|ch|j)i{SMALL}y", "$1"), (f"i{SMALL}y", "y"), (f"[aiueo]{SMALL}([aiueo])", "$1"), (f"{DOUBLE}([b-df-hj-np-tv-z])", "$1$1"), ("[\\x0E-\\x17]", ""))


def plain(c: str) -> str:
    """A character's compatibility form without marks."""
    return "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x)[0] != "M")


def spelled_consonant(stem: str) -> str:
    """A Brahmic consonant by its name without the vowel: retroflex ones like dental ones."""
    if stem in ("c", "ch"):
        return "ch" + stem[1:]
    return "sh" if stem == "ss" else re.sub(r"(.)\1+", r"\1", stem)


@cache
def letters() -> dict[str, str]:
    """Spellings of letters and signs."""
    spelled = {c: NOTHING if s == "-" else s for c, s in CYRILLIC.items()} | {"ー": NOTHING, "\u3099": VOICED, "ﾞ": VOICED, "\u309a": HALF, "ﾟ": HALF}
    for code in range(0x370, 0x10000):
        c = chr(code)
        words = unicodedata.name(c, "").split()
        own = next((w for w in words[:2] if w in ALPHABETS + BRAHMIC + ("HIRAGANA", "KATAKANA")), None)
        if own is None or c.lower() != c:
            continue
        last = words[-1].lower()
        if own in BRAHMIC:
            vowel = last[0] in "aeiou" or "VOCALIC" in words
            if words[-1] in NASAL:
                spelled[c] = NASAL_SIGN
            elif last in ("visarga", "virama", "nukta"):
                spelled[c] = {"visarga": "h", "virama": SIGN, "nukta": NUKTA}[last]
            elif ("LETTER" in words or "VOWEL" in words) and len(last) < 5:
                sound = last[0] + "i" if "VOCALIC" in words else re.sub(r"(.)\1", r"\1", last) if vowel else spelled_consonant(last.removesuffix("a"))
                if not vowel and last.endswith("a"):
                    sound += SILENT_VOWEL if own in SILENT else VOWEL
                spelled[c] = SIGN * ("VOWEL" in words) + sound
        elif own in ALPHABETS and "LETTER" in words and unicodedata.normalize("NFKD", c) == c:
            name = next(w for w in words[words.index("LETTER") + 1 :] + [""] if w not in ("SMALL", "FINAL")).lower()
            sound = re.match("[aeiou]|[^aeiou]+", name)
            if sound and len(sound[0]) < 4:
                spelled[c] = {"rh": "r", "tch": "ch"}.get(sound[0], sound[0])
        elif own in ("HIRAGANA", "KATAKANA") and "LETTER" in words:
            small = "SMALL" in words
            spelled[c] = DOUBLE if small and last == "tu" else SMALL * small + KANA.get(last, last)
    return spelled | ARMENIAN


@cache
def table() -> tuple[str, str]:
    """Pages of PAGE characters: the number of each (0: none), and the cells of all, empty where a character has no spelling."""
    spelled, cells = letters(), {}
    for code in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800)):
        c = chr(code)
        parts = plain(c).replace("\u2044", " ").lower()  # the slash of fractions
        got = spelled.get(c.lower(), "")
        if not got and unicodedata.category(c) == "Nd":
            got = str(unicodedata.digit(c))
        elif not got and unicodedata.category(c)[0] != "M" and not HANGUL <= code < HANGUL + 11172 and (unicodedata.decomposition(c) or parts != c):
            own = [x if x == " " or x.isascii() and x.isalnum() else spelled.get(x, "") for x in parts]
            got = "".join(own) if all(own) else ""
        if got:
            cells[code] = got
    pages = sorted({code // PAGE for code in cells})
    numbers = {page: i + 1 for i, page in enumerate(pages)}
    return ",".join(str(numbers.get(i, 0)) for i in range(pages[-1] + 1)), ",".join(cells.get(PAGE * page + i, "") for page in pages for i in range(PAGE))


@cache
def hangul() -> tuple[list[str], list[str], list[str]]:
    """Spellings of initial consonants, vowels and final consonants, from the names of syllables."""
    name = lambda i: unicodedata.name(chr(HANGUL + i)).split()[-1].lower()
    return [name(588 * i)[:-1] for i in range(19)], [name(588 * 11 + 28 * i) for i in range(21)], [name(588 * 11 + i)[1:] for i in range(28)]


def let(value: Column, then) -> Column:
    """then(value), with the value worked out once however often `then` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def looked_up(c: Column) -> Column:
    """Characters by the table; ASCII as it is; Hangul syllables by their parts; letters without a spelling by their codes, each a word; marks vanish; all else is a blank."""
    numbers, cells = (F.split(F.lit(x), ",") for x in table())
    first, middle, end = (F.split(F.lit(",".join(part)), ",") for part in hangul())

    def one(ch: Column, code: Column) -> Column:
        i = code - HANGUL
        syllable = F.concat(F.get(first, F.floor(i / 588).cast("int")), F.get(middle, F.floor(i % 588 / 28).cast("int")), F.get(end, i % 28))
        page = F.get(numbers, F.shiftright(code, 6)).cast("int")
        cell = F.when(page > 0, F.nullif(F.get(cells, (page - 1) * PAGE + code.bitwiseAND(PAGE - 1)), F.lit("")))
        rest = F.when(ch.rlike(r"\p{L}"), F.concat(F.lit(" u"), F.lower(F.hex(code)), F.lit(" "))).when(ch.rlike(r"\p{M}"), "").otherwise(" ")
        return F.when(code.between(14, 23), " ").when(code < 128, ch).when(i.between(0, 11171), syllable).otherwise(F.coalesce(cell, rest))

    # Stretches of ASCII stay whole, so a long text with few foreign letters is few pieces.
    pieces = F.regexp_extract_all(c, F.lit(r"[\x00-\x0D\x18-\x7F]+|[^\x00-\x0D\x18-\x7F]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: one(p, F.ascii(p))), "")


def romanised(c: Column) -> Column:
    """ASCII spelling of a lower-case text.

    Cyrillic, Greek, Armenian, Georgian, Hebrew, Arabic, nine Brahmic scripts, kana and Hangul have spellings.
    A consonant with an inherent vowel gets an `a` where no vowel sign or virama follows it, in northern scripts
    not at the end of a word. Letters of other scripts are their codes, an ideograph one word. NULL stays NULL.
    """
    t = F.replace(c, F.lit("ու"), F.lit("u"))
    for letter in CYRILLIC:  # letters with marks of their own
        apart = unicodedata.normalize("NFD", letter)
        if apart != letter:
            t = F.replace(t, F.lit(apart), F.lit(letter))

    def settled(s: Column) -> Column:
        for pattern, by in RULES:
            s = F.regexp_replace(s, pattern, by)
        return s

    return let(looked_up(t), lambda s: F.when(s.rlike(r"[\x0E-\x17]"), settled(s)).otherwise(s))
