"""Text expressions: normalisation, search tokens, CJK spacing, canonical JSON, bounded strings."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code point ranges that count as CJK.
CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"

#: Latin letters with marks and the letters they are found under, from the Unicode decompositions.
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c)).lower() for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1}
ACCENTS = ("".join(_MARKED), "".join(v[0] for v in _MARKED.values()))
#: Texts for which lower case, ß as ss and white space are all there is to normalise.
PLAIN = "^[\\x00-\\x7f¡-§©«-®°±¶·»¿-ÿ]*$"


def stripped(text: Column) -> Column:
    """Without white space, of any script, at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(StringType())
def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFKC", x).casefold().split()))


def normalized(text: Column) -> Column:
    """NFKC, case folding, single spaces, stripped. Latin-1 texts stay in the JVM; only others go to Python."""
    text = F.coalesce(text, F.lit(""))
    plain = text.rlike(PLAIN)
    quick = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "[\\s\\x1c-\\x1f]+", " "))
    return F.when(plain, quick).otherwise(_folded(F.when(~plain, text)))


def normalize(text: str | None) -> str:
    """The driver's form of ``normalized``."""
    return " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())


def spaced(text: Column) -> Column:
    """The search tokens of a text, each with a space before and after it: runs of letters and digits in lower case, Latin marks removed.

    Two spaces stand between tokens, so that each has its own; no token: two spaces. Counts need no array.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.when(F.length(low) == F.octet_length(low), low).otherwise(F.translate(low, ACCENTS[0], ACCENTS[1]))
    return F.concat(F.lit("  "), F.trim(F.regexp_replace(bare, "[^\\p{L}\\p{N}\\p{Co}]+", "  ")), F.lit("  "))


def token_count(spaced_text: Column) -> Column:
    """How many tokens a spaced text has."""
    empty = F.trim(spaced_text) == ""
    return F.when(empty, 0).otherwise((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit("  "), F.lit("")))) / 2 - 1).cast("int")


def tokens(text: Column) -> Column:
    """The search tokens as an array."""
    bare = F.trim(spaced(text))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " +"))


def query_tokens(text: str) -> list[str]:
    """The driver's form of ``tokens`` for a part of a request."""
    bare = text.lower().translate(str.maketrans(*ACCENTS))
    return [t for t in re.split(r"[\W_]+", bare) if t]


def terms(query: str) -> list[str]:
    """ASCII search terms of a request, in order, repeats kept."""
    return re.findall(r"[A-Za-z0-9_][A-Za-z0-9_./:-]*", query)


def cjk_runs(query: str) -> list[list[str]]:
    """Each run of CJK characters as a phrase of single characters."""
    return [list(run) for run in re.findall(f"[{CJK}]+", query)]


def cjk_spaced(text: Column) -> Column:
    """The text with spaces around every CJK character."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), f"([{CJK}])", " $1 "), "\\s+", " "))


def quoted(text: Column) -> Column:
    """A string as JSON writes it."""
    one = F.to_json(F.array(text))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def canonical(fields: dict[str, Column]) -> Column:
    """A JSON object of strings, keys sorted, with a space after each comma and colon."""
    parts: list[Column] = []
    for k, name in enumerate(sorted(fields)):
        parts += [F.lit(("{" if k == 0 else ", ") + f'"{name}": '), quoted(F.coalesce(fields[name], F.lit("")))]
    return F.concat(*parts, F.lit("}"))


def fingerprint(fields: dict[str, Column]) -> Column:
    return F.sha2(F.encode(canonical(fields), "UTF-8"), 256)


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis if any are missing; null: empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(most - 1)), F.lit("…")))


def shortened_list(items: Column, most: int, item_most: int) -> Column:
    return F.transform(F.slice(F.coalesce(items, F.array().cast("array<string>")), 1, most), lambda x: shortened(x, item_most))


def phrase_count(spaced_text: Column, phrase: Sequence[str]) -> Column:
    """Occurrences of a phrase in a spaced text. A phrase that can overlap itself is counted by position."""
    if any(list(phrase[:k]) == list(phrase[-k:]) for k in range(1, len(phrase))):
        array = F.split(F.trim(spaced_text), " +")

        def here(token: Column, i: Column) -> Column:
            found = token == phrase[0]
            for k, word in enumerate(phrase[1:], 1):
                found = found & F.coalesce(F.get(array, i + k) == word, F.lit(False))
            return found

        return F.when(F.contains(spaced_text, F.lit(f" {'  '.join(phrase)} ")), F.size(F.filter(array, here))).otherwise(0)
    mark = f" {'  '.join(phrase)} "
    return ((F.length(spaced_text) - F.length(F.replace(spaced_text, F.lit(mark), F.lit("")))) / len(mark)).cast("int")
