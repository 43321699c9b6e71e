"""Text folding, keys and tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word boundaries over ASCII letters, digits and underscore. Java's own \b also counts
# accented letters, which would hide terms that touch one.
BEFORE_WORD = r"(?<![A-Za-z0-9_])"
AFTER_WORD = r"(?![A-Za-z0-9_])"

# Words that carry no identity in a listing text.
STOP_WORDS = [
    "a", "as", "and", "com", "da", "das", "de", "do", "dos", "e", "em", "for",
    "from", "in", "o", "of", "os", "para", "the", "um", "uma", "with", "veiculo",
    "vehicle", "carro", "car",
]

# Make aliases by identity key.
MAKE_KEY_ALIASES = {
    "vw": "Volkswagen",
    "volkswagen": "Volkswagen",
    "seat": "SEAT",
    "bmw": "BMW",
    "mercedes": "Mercedes-Benz",
    "mercedesbenz": "Mercedes-Benz",
    "skoda": "Škoda",
    "citroen": "Citroën",
}

# English exonyms of locality names.
LOCALITY_ALIASES = {"lisbon": "lisboa", "oporto": "porto"}


def words(pattern: str, flags: str = "iu") -> str:
    """Wrap a pattern so that it matches whole ASCII-bounded words only."""
    return f"(?{flags}){BEFORE_WORD}(?:{pattern}){AFTER_WORD}"


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Letters of the basic plane whose canonical decomposition is one base letter."""
    source, target = [], []
    for point in range(0x80, 0x10000):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        base = "".join(
            c for c in unicodedata.normalize("NFD", char) if not unicodedata.category(c).startswith("M")
        )
        if len(base) == 1 and base != char and char == char.lower():
            source.append(char)
            target.append(base.lower())
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def _compatible_table() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose compatible form is plain ASCII: one character for one, and longer ones."""
    single, longer = {}, {}
    for code in range(0x80, 0x10000):
        plain = unicodedata.normalize("NFKD", chr(code))
        if plain.isascii() and unicodedata.normalize("NFD", chr(code)) == chr(code):
            (single if len(plain) == 1 else longer)[chr(code)] = plain
    return single, {c: p for c, p in longer.items() if p.isalpha()}


def compatible(text: Column) -> Column:
    """Wide letters and digits, hard spaces and ligatures as their plain forms."""
    single, longer = _compatible_table()
    text = F.translate(text, "".join(single), "".join(single.values()))
    # The Latin ligatures; rarer signs of several letters stay.
    for ligature in "ﬀﬁﬂﬃﬄﬅﬆ":
        text = F.replace(text, F.lit(ligature), F.lit(longer[ligature]))
    return text


def fold(text: Column) -> Column:
    """Lower-case text without accents."""
    source, target = _accent_table()
    return F.regexp_replace(F.translate(F.lower(text), source, target), r"\p{M}+", "")


def identity_key(text: Column) -> Column:
    return F.regexp_replace(fold(text), r"[^a-z0-9]", "")


def canonical_make(make: Column) -> Column:
    aliases = F.create_map(*[F.lit(v) for pair in MAKE_KEY_ALIASES.items() for v in pair])
    return F.coalesce(F.try_element_at(aliases, identity_key(make)), F.trim(make))


def make_key(make: Column) -> Column:
    """Identity of a make after aliases."""
    return identity_key(canonical_make(make))


def model_target_key(make: Column, model: Column, variant: Column) -> Column:
    return F.concat_ws(
        ":", make_key(make), identity_key(model), identity_key(F.coalesce(variant, F.lit("")))
    )


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def plain_text(text: Column) -> Column:
    """Drop control characters except tab, newline and carriage return; trim."""
    return F.regexp_replace(
        F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""), r"^(?U)\s+|\s+$", ""
    )


def match_text(text: Column) -> Column:
    """Form used for keyword rules: folded, dashes and white space collapsed."""
    dashed = F.regexp_replace(fold(compatible(text)), "[‐‑‒–—―-]+", " ")
    return normalize_ws(dashed)


def fingerprint_text(text: Column) -> Column:
    """Folded words joined by one space; null when nothing is left."""
    value = F.trim(F.regexp_replace(fold(text), r"[^a-z0-9]+", " "))
    return F.when(value != "", value)


def slug(text: Column) -> Column:
    dashed = F.regexp_replace(fold(text), r"[^a-z0-9]+", "-")
    value = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(value != "", value)


def locality_key(place: Column) -> Column:
    """Cache key of a place: text before the first comma, folded, aliases applied."""
    head = F.split_part(normalize_ws(place), F.lit(","), F.lit(1))
    key = F.trim(F.regexp_replace(fold(head), r"[^\p{L}\p{N}]+", " "))
    aliases = F.create_map(*[F.lit(v) for pair in LOCALITY_ALIASES.items() for v in pair])
    return F.when(key != "", F.coalesce(F.try_element_at(aliases, key), key))


# A token that says nothing about identity: one character, a short number, a stop word.
_EMPTY_TOKEN = "^(?:.|[0-9]{1,3}|" + "|".join(STOP_WORDS) + ")?$"


def tokens(text: Column) -> Column:
    """Distinct, sorted identity tokens of a text."""
    parts = F.array_distinct(F.split(fold(text), r"[^a-z0-9]+"))
    return F.sort_array(F.filter(parts, lambda t: ~t.rlike(_EMPTY_TOKEN)))


def unescape_embedded(text: Column) -> Column:
    """Undo the entity and backslash quoting of data embedded in scripts."""
    value = F.regexp_replace(text, "&quot;|&#34;|&#x22;", '"')
    return F.replace(value, F.lit('\\"'), F.lit('"'))


def unescape_string(text: Column) -> Column:
    r"""Undo \uXXXX, \n, \r, \t and quote escapes of one embedded string.

    Code points are replaced piece by piece: the text is split at each escape, and every
    piece starts with the four digits of the escape before it.
    """
    pieces = F.split(text, r"\\[uU](?=[0-9a-fA-F]{4})")
    decoded = F.transform(
        pieces,
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(
                F.decode(F.unhex(F.substring(piece, 1, 4)), "UTF-16BE"),
                piece.substr(F.lit(5), F.length(piece)),
            )
        ),
    )
    value = F.array_join(decoded, "")
    for escape, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\\'", "'")):
        value = F.replace(value, F.lit(escape), F.lit(char))
    return F.regexp_replace(value, r"^(?U)\s+|(?U)\s+$", "")


def strip_json_guard(text: Column) -> Column:
    """Drop the loop some sites put before embedded JSON."""
    return F.trim(F.regexp_replace(text, r"^\s*(?:for\s*\(;;\);|while\s*\(1\);)", ""))


def safe_json(text: Column) -> Column:
    """Embedded text as a variant, null when it is not whole JSON."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(strip_json_guard(text)))


# Fixed value: notes saying that a shown location is approximate.
LOCATION_NOTE = (
    r"(?iu)(?:location|localização|localisation|ubicación|standort).{0,40}"
    r"(?:approximate|aproximad|approximatif|approximative|aproximada|ungefähr)"
    r"|(?:approximate|aproximad|approximatif|approximative|aproximada|ungefähr).{0,40}"
    r"(?:location|localização|localisation|ubicación|standort)"
)


def drop_location_notes(lines: Column) -> Column:
    """Remove short lines that only say the location is approximate."""
    return F.filter(
        lines, lambda line: ~((F.length(normalize_ws(line)) <= 200) & normalize_ws(line).rlike(LOCATION_NOTE))
    )
