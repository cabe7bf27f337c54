"""Column builders for names, addresses and tokens. Missing text is the empty string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .romanise import let, plain, romanised

#: Address components that mean "missing".
MISSING = ("null", "none", "n/a", "na", "nil", "-")
#: Digits that stand for letters, and the letters.
OCR = ("01345789", "oleastbg")
#: Letters that Unicode does not decompose.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ł": "l", "ı": "i"}


def _accents() -> tuple[str, str]:
    """Accented small Latin letters and their base letters, from Unicode's decompositions."""
    pairs = [(chr(c), plain(chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and b.isascii() and b.islower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def latin(c: Column) -> Column:
    """Lower-case Latin spelling. ASCII texts are lowered only; those with letters beyond extended Latin are romanised by tables, also in the JVM."""
    low = F.lower(c)
    for a, b in SPELLED.items():
        low = F.replace(low, F.lit(a), F.lit(b))
    easy = F.translate(F.regexp_replace(low, r"[\p{P}\p{S}&&[^\x00-\x7F\u2116\u2120-\u2122\u213B]]", " "), ACCENTED, PLAIN)
    far = let(easy, lambda t: F.when(t.rlike(r"[^\x00-\x7F]"), F.lower(romanised(t))).otherwise(t))
    return F.when(c.rlike(r"[^\x00-\x7F]"), far).otherwise(F.lower(c))


def nfkc(c: Column) -> Column:
    """Unicode's compatibility form, by the ICU library that Spark brings along. NULL stays NULL.

    Spark takes calls by name as not deterministic, so filters are not pushed below a column made by it.
    """
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))).otherwise(c)


def clean_tokens(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))


def norm_name(c: Column) -> Column:
    return clean_tokens(latin(F.regexp_replace(F.coalesce(c, F.lit("")), "<[A-Za-z_]+>", " ")))


def norm_addr(c: Column) -> Column:
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), "<[A-Za-z_]+>", " "), ",")
    return clean_tokens(latin(F.concat_ws(",", F.filter(parts, lambda p: ~F.lower(F.trim(p)).isin(*MISSING)))))


def digits(c: Column) -> Column:
    return F.array_join(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), " ")


def has_non_latin(c: Column) -> Column:
    return c.rlike(r"[\p{L}&&[^\x{0000}-\x{024F}]]")


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def raw_tokens(c: Column) -> Column:
    """Parts of the compatibility form between blanks and marks."""
    return F.filter(F.split(nfkc(c), r"[\s,.;:()\[\]{}\"'|/\\-]+"), lambda t: t != "")


def token_count(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.size(F.split(c, " "))).cast("long")


def ocr_token(t: Column) -> Column:
    return F.when(t.rlike("[0-9]") & t.rlike("[a-z]"), F.translate(t, *OCR)).otherwise(t)


def strip_zeros(t: Column) -> Column:
    s = F.regexp_replace(t, "^0+", "")
    return F.when((s == "") & (t != ""), "0").otherwise(s)


def number_relation(a: Column, b: Column) -> Column:
    """0 equal, 1 prefix or suffix of the other, 2 same length, 3 otherwise."""
    longer = F.length(a) > F.length(b)
    x, y = F.when(longer, a).otherwise(b), F.when(longer, b).otherwise(a)
    return F.when(a == b, 0).when(F.length(a) == F.length(b), 2).when(F.startswith(x, y) | F.endswith(x, y), 1).otherwise(3).cast("long")


def tokens_match(a: Column, b: Column, least: int = 4) -> Column:
    return (F.least(F.length(a), F.length(b)) >= least) & (F.levenshtein(a, b) <= 0.25 * F.greatest(F.length(a), F.length(b)))


def is_abbreviation(a: Column, b: Column) -> Column:
    """a: two or more letters, shorter than b, same first letter, letters in the order of b's."""
    return a.rlike("^[a-z]{2,}$") & (F.length(a) < F.length(b)) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)) & F.rlike(b, F.concat(F.lit("^"), F.array_join(F.split(a, ""), ".*")))


def fold_of(i: Column, n: int) -> Column:
    return (F.pmod(i.cast("long") * F.lit(2654435761), F.lit(1 << 32)) % n).cast("long")


def es_holdout(i: Column, share: float) -> Column:
    return F.pmod(i.cast("long") * F.lit(40503), F.lit(1000)) < F.lit(1000 * share)


def word_grams(c: Column) -> Column:
    """Character 3-grams of each word between blanks; a one-letter word has one."""
    pad = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
    return F.flatten(F.transform(tokens(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substr(pad(w), i, F.lit(3)))))
