"""Text columns: accent folding, tokens, terms."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed stop words of the text index.
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "cua", "cho", "co", "da", "de", "do", "duoc", "for", "from", "in", "is", "la", "mot", "nhung", "o", "of",
    "on", "or", "the", "to", "trong", "va", "voi", "ve", "with",
]
#: Fixed aliases between sign words of two languages.
ALIASES = {
    "warning": ["canh", "bao"], "warnings": ["canh", "bao"], "danger": ["nguy", "hiem"], "dangerous": ["nguy", "hiem"],
    "landslide": ["sat", "lo"], "landslides": ["sat", "lo"], "flood": ["lu"], "flooding": ["lu"], "yellow": ["vang"],
    "stop": ["dung"], "prohibited": ["cam"], "exit": ["loi", "ra"], "entrance": ["loi", "vao"], "canh": ["warning"],
    "bao": ["warning"], "nguy": ["danger", "dangerous"], "hiem": ["danger", "dangerous"], "sat": ["landslide"],
    "lo": ["landslide"], "lu": ["flood", "flooding"], "vang": ["yellow"], "dung": ["stop"], "cam": ["prohibited"],
}


def _folding() -> tuple[str, str]:
    """Lower-case letters of U+00C0 to U+1EFF that decompose into one letter and marks, and that letter."""
    source, target = ["đ"], ["d"]
    for code in range(0xC0, 0x1F00):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if c.lower() == c and plain != c and len(plain) == 1:
            source.append(c)
            target.append(plain)
    return "".join(source), "".join(target)


_FOLD = _folding()


_TABLE = str.maketrans(*_FOLD)


def unmarked(text: Column | str) -> Column:
    """Lower case without marks that stand apart."""
    return F.regexp_replace(F.lower(text), r"\p{Mn}", "")


def folded(text: str) -> str:
    """`normalize` of a text from `unmarked`, in Python."""
    return text if text.isascii() else text.translate(_TABLE)


def normalize(text: Column | str) -> Column:
    """Lower case without accents."""
    plain = F.octet_length(text) == F.char_length(text)  # nothing to fold; translating costs more than all else
    return F.when(plain, F.lower(text)).otherwise(F.translate(unmarked(text), *_FOLD))


def squeezed(text: Column | str) -> Column:
    """`normalize` with white space collapsed."""
    return F.trim(F.regexp_replace(normalize(text), r"\s+", " "))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(folded: Column | str) -> Column:
    return F.regexp_extract_all(folded, F.lit(r"(?U)(\w+)"), 1)


def tokens(text: Column | str) -> Column:
    return words_of(normalize(text))


def terms_of(folded: Column | str) -> Column:
    """Tokens of a folded text that have two characters or more and are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words_of(folded), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def terms(text: Column | str) -> Column:
    return terms_of(normalize(text))


def aliases(term: Column) -> Column:
    """The term and its aliases."""
    table = F.create_map(*[x for k, v in ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.concat(F.array(term), F.coalesce(F.try_element_at(table, term), F.array().cast("array<string>")))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
