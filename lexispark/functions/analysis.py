"""Text functions: as Column expressions for tables, and as plain Python for the few strings of a query."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The class [\p{L}\p{N}\-_.:#/@], with its commonest characters named one by one: Java looks those up in a table before it asks for a category.
TOKEN = rf"[{string.ascii_letters}{string.digits}\-_.:#/@[\p{{L}}\p{{N}}]]+"
_TOKEN = re.compile(r"[\w\-.:#/@]+")

_ACCENTED, _PLAIN = "áéíóúüÁÉÍÓÚÜ", "aeiouuAEIOUU"
_VARIANTS = {"a": "á", "e": "é", "i": "í", "o": "ó", "u": "úü"}

#: What a stored value has to look like to count as a number: no blanks, no type suffix.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_INFINITE = r"^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"


def analyze(text: Column | str) -> Column:
    """Lower-cased tokens in order. Null for a null text."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def analyze_text(text: str) -> list[str]:
    return [t.lower() for t in _TOKEN.findall(text)]


def fold_accents(text: Column | str) -> Column:
    """Accented Spanish vowels become plain; all else stays, the letter ñ too."""
    return F.translate(text, _ACCENTED, _PLAIN)


def fold_text(text: str) -> str:
    return text.translate(str.maketrans(_ACCENTED, _PLAIN))


def accent_variants(term: str) -> list[str]:
    """The folded term, then each form of it with one lower-case vowel accented."""
    base = fold_text(term)
    return [base, *(base[:i] + v + base[i + 1 :] for i, c in enumerate(base) for v in _VARIANTS.get(c, ""))]


def as_bytes(text: Column | str) -> Column:
    """A string with one character for each UTF-8 byte."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def levenshtein_bytes(a: Column | str, b: Column | str) -> Column:
    """Edit distance in UTF-8 bytes."""
    return F.levenshtein(as_bytes(a), as_bytes(b))


def to_number(value: Column | str) -> Column:
    """The number that a stored string is; null for any other string. Infinities count, not-a-number does not."""
    v = F.col(value) if isinstance(value, str) else value
    infinite = F.when(v.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(v.rlike(NUMBER), v.try_cast("double")).when(v.rlike(_INFINITE), infinite)


def base36(n: Column | str) -> Column:
    """Numbers in base 36, lower case."""
    return F.lower(F.conv(n, 10, 36))


def to_base36(n: int) -> str:
    out = ""
    while n or not out:
        n, d = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out


def key_field(name: str) -> str:
    """A keyword field's name: with _key, unless the name already has it anywhere."""
    return name if "_key" in name else name + "_key"


def wildcard_regex(pattern: str) -> str:
    """An anchored Java regular expression; * and ? stand for any characters but a newline."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.sub(r"([^\w\s])", r"\\\1", c, flags=re.A) if c.isascii() else c for c in pattern)
    return rf"(?d)\A{body}\z"


def literal_prefix(pattern: str) -> str:
    return re.split(r"[*?]", pattern, maxsplit=1)[0]
