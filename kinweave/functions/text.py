"""Text normalisation as columns: built-in functions, but for the transliteration of scripts."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kinweave import constants as C


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: t != "")


def joined(array: Column) -> Column:
    return F.array_join(array, " ")


@lru_cache(maxsize=65_536)
def _latin(char: str) -> str:
    """The ASCII form of one character by its category and Unicode name."""
    if char in C.SPECIAL_LETTERS:
        return C.SPECIAL_LETTERS[char]
    kind, name = unicodedata.category(char), unicodedata.name(char, "")
    if kind in ("Mn", "Mc", "Me", "Cf"):
        if "VOWEL SIGN" in name:
            tail = name.rsplit("VOWEL SIGN ", 1)[-1].lower()
            return "ri" if tail.startswith("vocalic") else C.INDIC_VOWELS.get(tail.split()[-1], "")
        if "ANUSVARA" in name or "CANDRABINDU" in name:
            return "n"
        return "h" if "VISARGA" in name else ""
    if kind == "Nd":
        return str(unicodedata.digit(char))
    plain = "".join(x for x in unicodedata.normalize("NFKD", char) if x < "\x80").lower()
    if plain:
        return plain
    if " LETTER " in name:
        letter = name.split(" LETTER ", 1)[1].lower()
        letter = letter.removeprefix("sign ").split(" with ")[0]
        if letter.startswith("vocalic"):
            return "ri" if letter.split()[-1].startswith("r") else "li"
        letter = letter.split()[-1]
        if letter in C.INDIC_VOWELS:
            return C.INDIC_VOWELS[letter]
        letter = letter[:-1] if letter.endswith("a") and len(letter) > 1 else letter
        return "".join(x for k, x in enumerate(letter) if not k or x != letter[k - 1])
    return " " if kind[0] in "PSZ" else char


def _transliterated(text: str | None) -> str | None:
    return text if text is None or text.isascii() else "".join(x if x < "\x80" else _latin(x) for x in text)


@F.pandas_udf(StringType())
def _translit_udf(texts: pd.Series) -> pd.Series:
    return texts.map(_transliterated)


#: Latin letters with accents, by rule: their decomposition's base letter. translate() maps them without leaving the JVM.
_ACCENTED = {chr(k): _latin(chr(k)) for k in range(0xC0, 0x180) if unicodedata.category(chr(k)) == "Ll"}


def translit(c: Column, scripts: bool = True) -> Column:
    """ASCII forms. ``scripts`` False: lower-case Latin letters only, without Python."""
    if scripts:  # only values with letters beyond ASCII travel to Python
        return F.coalesce(_translit_udf(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)
    single = {a: b for a, b in _ACCENTED.items() if len(b) == 1}
    c = F.translate(c, "".join(single), "".join(single.values()))
    for letter, plain in (_ACCENTED | C.SPECIAL_LETTERS).items():
        if letter not in single:
            c = F.replace(c, F.lit(letter), F.lit(plain))
    return c


def merge_single_letters(c: Column) -> Column:
    """Runs of single letters become one token: l l c, llc."""
    return F.regexp_replace(c, r"(?<=\b[a-z]) (?=[a-z]\b)", "")


def name_basic(c: Column, scripts: bool = False) -> Column:
    c = translit(F.lower(F.coalesce(c, F.lit(""))), scripts)
    c = F.regexp_replace(F.regexp_replace(c, C.WWW, " "), C.TOP_LEVEL, " ")
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), C.APOSTROPHES, "")
    return merge_single_letters(F.trim(F.regexp_replace(c, r"[^0-9a-z]+", " ")))


def fix_leet(token: Column) -> Column:
    """Digits for letters, in tokens of two characters or more with letters and just one digit."""
    one = (F.length(token) >= 2) & token.rlike("[a-z]") & (F.length(F.regexp_replace(token, r"\D", "")) == 1)
    return F.when(one, F.translate(token, C.LEET_FROM, C.LEET_TO)).otherwise(token)


def mapped(token: Column, table: dict[str, str]) -> Column:
    if not table:
        return token
    literal = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(literal, token), token)


def name_core(basic: Column, learned: dict[str, str] | None = None) -> Column:
    """Tokens without legal forms and stop words; all of them if none would remain."""
    every = F.transform(tokens(basic), lambda t: mapped(fix_leet(t), learned or {}))
    left = F.filter(every, lambda t: ~t.isin(*C.LEGAL_FORMS))
    return joined(F.when(F.size(left) > 0, left).otherwise(every))


def squash(core: Column) -> Column:
    return F.replace(core, F.lit(" "), F.lit(""))


def skeleton_token(t: Column) -> Column:
    swapped = t
    for a, b in C.SKELETON_SWAPS:
        swapped = F.replace(swapped, F.lit(a), F.lit(b))
    bare = F.concat(F.substring(swapped, 1, 1), F.regexp_replace(F.substring(swapped, 2, 1_000_000), "[aeiouy]", ""))
    return F.when(t.rlike(r"^\d+$"), t).otherwise(F.regexp_replace(bare, r"(.)\1+", "$1"))


def name_skeleton(core: Column) -> Column:
    return joined(F.transform(tokens(core), skeleton_token))


def name_alt(basic: Column) -> Column:
    """The name after the last trade-name marker; empty without one."""
    parts = F.split(basic, C.TRADE)
    return F.when(F.size(parts) > 1, name_core(F.trim(F.element_at(parts, -1)))).otherwise("")


def acronym(core: Column) -> Column:
    letters = F.transform(F.filter(tokens(core), lambda t: ~t.rlike(r"^\d+$")), lambda t: F.substring(t, 1, 1))
    return F.when(F.size(letters) >= 2, F.array_join(letters, "")).otherwise("")


def addr_basic(c: Column, scripts: bool = False) -> Column:
    c = translit(F.lower(F.coalesce(c, F.lit(""))), scripts)
    c = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), C.APOSTROPHES, "")
    c = F.regexp_replace(F.regexp_replace(c, r"[^0-9a-z]+", " "), C.ORDINAL, "$1")
    return joined(F.filter(tokens(merge_single_letters(F.trim(c))), lambda t: ~t.isin(*C.PLACEHOLDERS)))


def addr_canon(basic: Column, learned: dict[str, str] | None = None) -> Column:
    """Each token by the fixed map, then by the learned one."""
    return joined(F.transform(tokens(basic), lambda t: mapped(mapped(t, C.ADDRESS_FORMS), learned or {})))


def _unpadded(number: Column) -> Column:
    return F.regexp_replace(number, r"^0+(?=\d)", "")


def addr_keys(canon: Column) -> Column:
    """number|first four of the next word's skeleton, for the first three such places."""
    t = tokens(canon)
    places = F.when(F.size(t) > 1, F.sequence(F.lit(1), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    good = F.filter(places, lambda i: F.element_at(t, i).rlike(r"^\d+$") & ~F.element_at(t, i + 1).rlike(r"^\d+$") & (F.length(F.element_at(t, i + 1)) >= 3))
    keys = F.transform(good, lambda i: F.concat(_unpadded(F.element_at(t, i)), F.lit("|"), F.substring(skeleton_token(F.element_at(t, i + 1)), 1, 4)))
    return F.slice(keys, 1, 3)


def postal_codes(canon: Column) -> Column:
    """Tokens of six digits, or of five unless a longer word follows."""
    t = tokens(canon)
    places = F.when(F.size(t) > 0, F.sequence(F.lit(1), F.size(t))).otherwise(F.array().cast("array<int>"))
    after = lambda i: F.coalesce(F.try_element_at(t, i + 1), F.lit(""))
    good = F.filter(places, lambda i: F.element_at(t, i).rlike(r"^\d{6}$") | (F.element_at(t, i).rlike(r"^\d{5}$") & ~after(i).rlike(r"^[a-z]{3,}$")))
    return F.transform(good, lambda i: F.element_at(t, i))


def numbers(c: Column) -> Column:
    """Distinct digit runs without leading zeros."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), 1), _unpadded))


def first_number(c: Column) -> Column:
    found = F.substring(F.regexp_extract(c, r"(\d+)", 1), 1, 9)
    return F.when(found == "", F.lit(-1)).otherwise(found.try_cast("long")).cast("long")


def name_flags(raw: Column) -> dict[str, Column]:
    raw = F.coalesce(raw, F.lit(""))
    return {
        "f_domain": F.lower(raw).rlike(C.DOMAIN),
        "f_nonascii": raw.rlike(r"[^\x00-\x7F]"),
        "f_upper": (F.upper(raw) == raw) & (F.lower(raw) != raw),
        "f_junk": (raw != "") & ~raw.rlike(r"^[\p{L}\p{N}]"),
    }


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def legal_classes(basic: Column) -> Column:
    """Bits of the legal-form classes that a name shows."""
    bits = [F.when(basic.rlike(pattern), 1 << k).otherwise(0) for k, pattern in enumerate(C.LEGAL_CLASSES.values())]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total


def char_grams(c: Column, n: int = 3) -> Column:
    """Character n-grams of each word with a space on either side."""
    return F.flatten(F.transform(tokens(c), lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), i, F.lit(n)))))


def bigrams(c: Column) -> Column:
    t = tokens(c)
    places = F.when(F.size(t) > 1, F.sequence(F.lit(1), F.size(t) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.concat(F.element_at(t, i), F.lit("_"), F.element_at(t, i + 1)))


def words_tokens(c: Column) -> Column:
    """Tokens of an address that aren't numbers."""
    return F.filter(tokens(c), lambda t: ~t.rlike(r"^\d+$"))


@F.pandas_udf(StringType())
def script(texts: pd.Series) -> pd.Series:
    """Script of the first letter beyond Latin, LATIN without one."""

    def of(text: str | None) -> str:
        found = next((x for x in text or "" if x.isalpha() and x > "ɏ"), None)
        return unicodedata.name(found, "LATIN").split()[0] if found else "LATIN"

    return texts.map(of)
