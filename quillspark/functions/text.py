"""Scalar text functions as Column expressions; all stay in the JVM.

Java's \\s is ASCII by default, so patterns with it start with (?U). Word characters are written out as
\\p{L}\\p{N}_, letters and all numbers, at word ends too: Java's own word end knows no superscript digits.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the two cleaning variants and of the lexical normalisation.
HTML = r"<[^>]+>"
ENTITIES = {"basic": r"&[a-z]+;|&#\d+;", "extended": r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);"}
KEEP = {
    "basic": r"""(?U)[^\p{L}\p{N}_\s.,;:!?()\-'"áéíóúâêîôûãõàèìòùçÁÉÍÓÚÂÊÎÔÛÃÕÀÈÌÒÙÇñÑüÜ]""",
    "extended": r"""(?U)[^\p{L}\p{N}_\sÀ-ÖØ-öø-ÿ.,;:!?()\-/'"&+%#@=]""",
}
ROMAN = r"(?i)(?<![\p{L}\p{N}_])(?=[mcdlxvi])m{0,4}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})(?![\p{L}\p{N}_])"
SENTENCE_END = r"(?U)[.!?;\n]+|,\s+"


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space one space, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_tag(c: Column) -> Column:
    """A tag's key: white space collapsed, case and accents kept."""
    return collapse(c)


def clean_text(c: Column, variant: str = "basic") -> Column:
    """Tags, entities and odd characters become spaces; case and accents stay."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), HTML, " ")
    out = F.regexp_replace(out, ENTITIES[variant], " ")
    return collapse(F.regexp_replace(out, KEEP[variant], " "))


@lru_cache
def _plain_letters() -> tuple[str, str]:
    """Every composed character of the basic plane whose base is one character, and that base."""
    pairs = []
    for i in range(0xC0, min(0x10000, sys.maxunicode)):
        if 0xAC00 <= i <= 0xD7A3 or 0xD800 <= i <= 0xDFFF:
            continue
        d = unicodedata.normalize("NFD", chr(i))
        if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:]):
            pairs.append((chr(i), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(c: Column) -> Column:
    """Without accents: composed letters become their base, combining marks go."""
    return F.regexp_replace(F.translate(c, *_plain_letters()), r"\p{Mn}", "")


def normalize_lexical(c: Column) -> Column:
    """Lower case, no accents, hyphens and underscores as spaces, no punctuation, digits or Roman numerals."""
    out = strip_accents(F.lower(F.coalesce(c, F.lit(""))))
    for pattern, to in ((r"[-_]+", " "), (r"(?U)[^\p{L}\p{N}_\s]+", " "), (r"\p{Nd}+", " "), (ROMAN, " ")):
        out = F.regexp_replace(out, pattern, to)
    return collapse(out)


def sentences(c: Column) -> Column:
    """Segments between . ! ? ; line ends and comma with space; stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), SENTENCE_END), strip), lambda s: s != "")


def clean_field(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def clean_list(c: Column, sep: str = "; ") -> Column:
    """Stripped, non-empty items of an array joined by sep."""
    items = F.transform(F.coalesce(c, F.array().cast("array<string>")), clean_field)
    return F.array_join(F.filter(items, lambda x: x != ""), sep)


def publication_string(title: Column, keywords: Column, abstract: Column) -> Column:
    """Title, keywords and abstract joined by comma and space; empty parts leave nothing."""
    parts = F.array(clean_field(title), clean_list(keywords, ", "), clean_field(abstract))
    return F.array_join(F.filter(parts, lambda x: x != ""), ", ")


def labelled_text(title: Column, keywords: Column, abstract: Column, labels=("Título", "Palavras-chave", "Resumo")) -> Column:
    """Lines with a label each; empty fields have no line."""
    parts = (clean_field(title), clean_list(keywords), clean_field(abstract))
    return F.concat_ws("\n", *[F.when(x != "", F.concat(F.lit(f"{k}: "), x)) for k, x in zip(labels, parts)])


def structured(title: Column, keywords: Column, abstract: Column, variant: str = "basic") -> Column:
    """struct(titulo, keywords, abstract), cleaned; a keyword that cleans to nothing keeps its separator."""
    kws = F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.coalesce(strip(k), F.lit("")) != "")
    joined = F.array_join(F.transform(kws, lambda k: clean_text(k, variant)), ", ")
    return F.struct(clean_text(title, variant).alias("titulo"), joined.alias("keywords"), clean_text(abstract, variant).alias("abstract"))


def profile_text(publications: Column, most: int = 50) -> Column:
    """Numbered blocks of the first publications, a blank line between; empty fields have no line."""
    def block(x, i):
        lines = [F.concat(F.lit("PUBLICAÇÃO "), (i + 1).cast("string"))]
        for label, name in (("Título", "titulo"), ("Palavras-chave", "keywords"), ("Resumo", "abstract")):
            lines.append(F.when(x[name] != "", F.concat(F.lit(f"{label}: "), x[name])))
        return F.concat_ws("\n", *lines)

    return F.array_join(F.transform(F.slice(publications, 1, most), block), "\n\n")


def author_id(c: Column, ignore_case: bool = False) -> Column:
    """Stripped, without the prefix ID_."""
    return F.regexp_replace(strip(c), ("(?i)" if ignore_case else "") + "^ID_", "")


def prefixed_id(c: Column) -> Column:
    return F.when(c.startswith("ID_"), c).otherwise(F.concat(F.lit("ID_"), c))


def first_digits(c: Column) -> Column:
    """The first run of eight or more digits, with or without ID_; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?:ID_)?(\d{8,})", 1), F.lit(""))


def file_id(c: Column) -> Column:
    """Id from a file name: without .xml and ID_, the first run of digits."""
    return F.nullif(F.regexp_extract(F.regexp_replace(c, r"(?i)\.xml$", ""), r"(\d+)", 1), F.lit(""))


def field_name(c: Column) -> Column:
    """Upper case, other than letters and digits as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def local_name(c: Column) -> Column:
    """An XML name without its namespace."""
    return F.substring_index(c, "}", -1)


def year_of(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(?:19|20)\d{2}", 0), F.lit("")).cast("int")


def remove_thinking(c: Column) -> Column:
    return F.regexp_replace(c, r"(?is)<think>.*?</think>", " ")
