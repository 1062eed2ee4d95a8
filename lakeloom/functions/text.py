"""Columns from columns of text, in generated code, and the small helpers that turn a query into terms."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dashes that are searched as hyphens, and parameters that URLs lose.
DASHES = "–—－"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "spm")


def occurrences(text: Column, phrase: str) -> Column:
    """How often a phrase occurs, overlaps included.

    A phrase that doesn't begin as it ends can't overlap itself: its occurrences are counted by the length that goes
    when it is removed, which is a plain search; others need a look-ahead at each character.
    """
    if any(phrase.startswith(phrase[-k:]) for k in range(1, len(phrase))):
        return F.regexp_count(text, F.lit(f"(?=\\Q{phrase}\\E)"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def trigrams(text: Column) -> Column:
    """Number of character trigrams."""
    return F.greatest(F.length(text) - 2, F.lit(0))


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def dash_variants(phrase: str) -> tuple[str, ...]:
    """The phrase with each kind of dash in place of its dashes, for texts that were indexed with theirs."""
    if not any(c in f"-{DASHES}" for c in phrase):
        return (phrase,)
    plain = phrase.translate({ord(c): "-" for c in DASHES})
    return tuple(sorted({phrase, *(plain.replace("-", c) for c in f"-{DASHES}")}))


def preview(text: Column, size: int = 180) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), 1, size)


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without port, a path (`/` if none), no fragment, the parameters sorted by name and
    value without those of TRACKING.  Escapes are decoded and encoded anew, blanks as +."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z]+)://", 1))
    host = F.lower(F.regexp_extract(base, r"^[A-Za-z]+://([^/:]*)", 1))
    path = F.regexp_extract(base, r"^[A-Za-z]+://[^/]*(/.*)$", 1)
    items = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: p != "")
    name = lambda p: F.url_decode(F.regexp_extract(p, "^([^=]*)", 1))
    pairs = F.transform(items, lambda p: F.struct(name(p).alias("k"), F.url_decode(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), query)).otherwise(""))


def distinct_in_order(values) -> list[str]:
    return list(dict.fromkeys(v for v in values if v))


def normal_query(query: str) -> str:
    """NFKC, no quotes, dashes as hyphens, single blanks, lower case."""
    t = unicodedata.normalize("NFKC", query).translate(dict.fromkeys(map(ord, "​\"'“”‘’")))
    return " ".join(re.sub("[—–－]", "-", t).split()).lower()


def eligible(term: str) -> bool:
    """Whether an index of trigrams can find it: three letters, digits or Chinese characters at least."""
    return len(re.sub("[^㐀-鿿a-z0-9]", "", term)) >= 3


def query_terms(query: str, most: int = 8) -> list[str]:
    """Distinct terms of two characters or more, in order; only letters, digits and . _ + - stay."""
    return distinct_in_order(t for t in (re.sub("[^㐀-鿿a-z0-9._+-]", "", w) for w in normal_query(query).split()) if len(t) >= 2)[:most]


def back_off_windows(query: str) -> list[str]:
    """Of each term of five characters or more up to three windows, at its start, middle and end."""
    found = []
    for term in query_terms(query):
        size = min(8, max(4, -(-len(term) // 2)))
        if len(term) >= 5 and size < len(term):
            last = len(term) - size
            found += [term[s : s + size] for s in (0, last // 2, last)]
    return distinct_in_order(found)
