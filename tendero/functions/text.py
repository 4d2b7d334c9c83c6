"""Text helpers. All matching runs as native string and regex expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

# fixed values: accented letters and the plain letters they are compared as
ACCENTED = "áéíóúñ"
PLAIN = "aeioun"

_FOLD = str.maketrans(ACCENTED, PLAIN)


def fold(text: Column) -> Column:
    """Lower case without accents."""
    folded = F.lower(text)
    for accented, plain in zip(ACCENTED, PLAIN):
        folded = F.replace(folded, F.lit(accented), F.lit(plain))
    return folded


def fold_word(word: str) -> str:
    return word.lower().translate(_FOLD)


def escape(phrase: str) -> str:
    """Phrase as a literal inside a regular expression (Java and RE2 alike)."""
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def whole(phrase: str) -> str:
    """Pattern for a phrase between word edges.

    The literal comes first and the left edge is checked looking back, so the search skips
    to places where the phrase occurs instead of testing every position for an edge.
    """
    literal = escape(phrase)
    return rf"(?U){literal}\b(?<=\b{literal})"


def any_phrase(folded: Column, phrases: Sequence[str], whole_words: Sequence[str] = ()) -> Column:
    """True where the folded text holds one of the phrases.

    Phrases are byte searches. Those with words in between (``proveedor.*pedir``) and words
    that must stand alone go on to a regular expression only where their parts occur.
    """
    tests = []
    for phrase in map(fold_word, phrases):
        parts = phrase.split(".*")
        test = reduce(and_, [folded.contains(part) for part in parts])
        tests.append(test if len(parts) == 1 else test & folded.rlike("(?s)" + phrase))
    for word in map(fold_word, whole_words):
        tests.append(folded.contains(word) & folded.rlike(whole(word)))
    return reduce(or_, tests)


def best_rank(text: Column, phrases: Sequence[str]) -> Column:
    """Smallest position in ``phrases`` of a phrase found as whole words, else null.

    Single words are looked up among the distinct words of the text, so their number hardly
    matters. Phrases of several words are byte searches in rank order; only a text that
    holds the characters is checked for word boundaries.
    """
    ranks: dict[str, int] = {}
    for phrase in phrases:
        ranks.setdefault(phrase, len(ranks))
    words = {p: r for p, r in ranks.items() if re.fullmatch(r"\w+", p)}
    found = [F.lit(None).cast("int"), F.lit(None).cast("int")]
    if words:
        hits = F.array_intersect(F.split(text, r"(?U)\W+"), string_array(list(words)))
        lookup = F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
        found.append(F.array_min(F.transform(hits, lambda hit: F.element_at(lookup, hit))))
    chain = F
    for phrase, rank in ranks.items():
        if phrase not in words:
            chain = chain.when(text.contains(phrase) & text.rlike(whole(phrase)), F.lit(rank))
    if chain is not F:
        found.append(chain)
    return F.least(*found)


def string_array(values: Sequence[str]) -> Column:
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def found_in(text: Column, values: Sequence[str]) -> Column:
    """The listed values that occur in the text as substrings, in list order."""
    return F.filter(string_array(values), lambda value: F.contains(text, value))
