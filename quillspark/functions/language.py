"""A language detector for sentences in the JVM: function words of four languages are counted.

The language with most of them is detected where no other has as many. It is a plug: any Column -> Column
function from text to a language or null takes its place.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORDS = {
    "pt": "a ao aos as até com como da das de do dos e em entre foi foram já mais mas na nas no nos não o os ou para pela pelo por que se sem ser seu sua são também um uma à às é".split(),
    "en": "a an and are as at be been but by for from had has have in into is it its not of on or our than that the their these this to was we were which with without".split(),
    "es": "a al como con de del el ella en entre es esta este fue fueron ha la las lo los más no o para pero por que se sin son su sus también un una y ya".split(),
    "fr": "a au aux avec ce ces cette comme dans de des du elle en entre est et été la le les leur mais ne nous ont ou par pas plus pour que qui sans se ses son sont sur un une à".split(),
}
ACCEPTED = ("pt", "en")


def detect(c: Column, accepted: tuple[str, ...] = ACCEPTED) -> Column:
    """The language of a text if it is one of the accepted; null for another, for none and for a tie."""
    told = F.split(F.lower(c), r"[^\p{L}]+")
    counts = F.transform(F.array(told), lambda ws: F.struct(*[F.size(F.filter(ws, lambda w: w.isin(words))).alias(k) for k, words in WORDS.items()]))
    n = {k: F.element_at(counts, 1)[k] for k in WORDS}
    best = None
    for k in accepted:
        first = F.lit(True)
        for other in WORDS:
            if other != k:
                first = first & (n[k] > n[other])
        best = F.when(first, k) if best is None else best.when(first, k)
    return best
