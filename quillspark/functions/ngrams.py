"""Tokens, n-gram windows and the part-of-speech rule.

The tagger is a plug: a Column -> Column function from an array of tokens to an array of tags. The default
looks function words up in a small lexicon; everything else is a noun, which keeps the rule deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tag classes of the n-gram rule.
FUNCTIONAL = ("ADP", "CCONJ", "SCONJ", "DET", "PRON", "AUX", "PART", "PUNCT", "SYM", "X")
BORDER = ("ADP", "CCONJ", "SCONJ", "DET", "PRON", "PART", "PUNCT", "SYM", "NUM", "AUX")
CONTENT = ("NOUN", "PROPN", "ADJ")

LEXICON = {
    "ADP": "de da do das dos em no na nos nas por para com sem sob sobre entre ate of in on at by for with from to between about across".split(),
    "DET": "um uma uns umas os as este esta esse essa the an this that these those".split(),
    "CCONJ": "e ou mas and or but nor".split(),
    "PRON": "que se ele ela eles elas it we they he she you which who".split(),
    "AUX": "foi foram ser sao esta estao is are was were be been has have".split(),
}


def tokens(normalised: Column) -> Column:
    """Words of at least two characters; shorter ones go before windows are formed, so windows bridge them."""
    return F.filter(F.split(normalised, " "), lambda t: F.length(t) >= 2)


def lexicon_tagger(toks: Column) -> Column:
    def tag(t):
        c = F
        for k, ws in LEXICON.items():
            c = c.when(t.isin(ws), k)
        return c.otherwise("NOUN")

    return F.transform(toks, tag)


def well_formed(tags: Column, start: Column | int = 1, n: Column | None = None) -> Column:
    """No border tag first or last, not only functional tags, a noun or adjective somewhere, no noun-ADP-verb.

    tags[start, start + n) is judged, of 1 to 3 tags. Scalar tests only, so the rule stays in generated code."""
    start = F.lit(start) if isinstance(start, int) else start
    n = F.size(tags) if n is None else n
    first, last = F.get(tags, start - 1), F.get(tags, start + n - 2)
    mid = F.when(n == 3, F.get(tags, start)).otherwise(first)
    any_of = lambda test: test(first) | test(mid) | test(last)
    bad = (n == 3) & first.isin("NOUN", "PROPN") & (mid == "ADP") & (last == "VERB")
    return ~first.isin(*BORDER) & ~last.isin(*BORDER) & any_of(lambda t: ~t.isin(*FUNCTIONAL)) & any_of(lambda t: t.isin(*CONTENT)) & ~bad


def windows(rows: DataFrame, toks: str = "toks", longest: int = 3) -> DataFrame:
    """A row for each window of 1 to longest tokens: n, start and words are added to the columns of rows.

    toks must be a column, not an expression: it would be evaluated for every window."""
    # no filter on the size of toks: it would be pushed down with all that makes toks, and make it twice
    sized = rows.select("*", F.explode(F.when(F.size(toks) > 0, F.sequence(F.lit(1), F.size(toks)))).alias("start"))
    each = sized.select("*", F.explode(F.array(*[F.lit(n) for n in range(1, longest + 1)])).alias("n")).where(F.col("start") + F.col("n") - 1 <= F.size(toks))
    return each.withColumn("ngram", F.array_join(F.slice(toks, F.col("start"), F.col("n")), " "))


def ngram_arrays(tokens_and_tags: Column, longest: int = 3) -> Column:
    """array<struct<toks, tags>> of sentences -> all n-grams in order of sentence, n and start; where tags is
    null every window counts."""
    def of(x, n):
        starts = F.when(F.size(x["toks"]) >= n, F.sequence(F.lit(1), F.size(x["toks"]) - n + 1)).otherwise(F.array().cast("array<int>"))
        kept = F.filter(starts, lambda s: x["tags"].isNull() | well_formed(x["tags"], s, F.lit(n)))
        return F.transform(kept, lambda s: F.array_join(F.slice(x["toks"], s, F.lit(n)), " "))

    return F.flatten(F.transform(tokens_and_tags, lambda x: F.flatten(F.array(*[of(x, n) for n in range(1, longest + 1)]))))
