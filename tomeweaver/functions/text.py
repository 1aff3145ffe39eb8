"""Text normalising as column expressions, with Python twins for query strings."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-z]+(?:['-][a-z]+)*"
WORD = "\\p{L}+(?:['’\\-]\\p{L}+)*"
MAX_PATTERN = 256

#: Quotes and dashes, and letters that decompose into none of their own.
SINGLE = {"‘": "'", "’": "'", "ʼ": "'", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "Ø": "O", "ø": "o", "Ł": "L", "ł": "l"}
MULTIPLE = {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe"}
#: Combining marks that Unicode 14 and 15 added, which a virtual machine of an older Unicode does not take as marks.
NEW_MARKS = (
    "0898-089F 08CA-08D2 0C3C-0C3C 0CF3-0CF3 0ECE-0ECE 1715-1715 180F-180F 1AC1-1ACE 1DFA-1DFA 10EFD-10EFF 10F82-10F85 11070-11070 11073-11074 110C2-110C2 11241-11241 "
    "11F00-11F01 11F03-11F03 11F34-11F3A 11F3E-11F42 13440-13440 13447-13455 1CF00-1CF2D 1CF30-1CF46 1E08F-1E08F 1E2AE-1E2AE 1E4EC-1E4EF"
).split()
#: Where those lie.
NEWER = "[\\x{0898}-\\x{1DFF}\\x{10EFD}-\\x{1FFFF}]"


def decomposed(text: Column) -> Column:
    """The compatibility decomposition (NFKD), by the Unicode library that Spark itself compares strings with.

    Spark takes any call of a method as not deterministic, so the result may stand in a
    projection or a filter, and inside an aggregate only by way of a projection.
    """
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Lower-cased text without accents, ligatures and other compatibility forms; null is empty."""
    t = F.coalesce(text, F.lit(""))
    plain = t
    for k, v in (SINGLE | MULTIPLE).items():
        plain = F.replace(plain, F.lit(k), F.lit(v))
    ranges = "".join("\\x{" + r.replace("-", "}-\\x{") + "}" for r in NEW_MARKS)
    # most texts are plain by then, and a comparison of lengths tells so without reading them
    newer = lambda x: F.when(_plain(x) | ~x.rlike(NEWER), x).otherwise(F.regexp_replace(x, f"[{ranges}]+", ""))
    # an element of an array, so that the call of a method is made once and not anew for each use of its result
    folded = F.transform(F.array(F.regexp_replace(decomposed(plain), "\\p{M}+", "")), newer)[0]
    return F.lower(F.when(_plain(t), t).otherwise(folded))


def _plain(text: Column) -> Column:
    """Whether a text is ASCII."""
    return F.octet_length(text) == F.length(text)


def canonical_text(text: str | None) -> str:
    t = text or ""
    for k, v in (SINGLE | MULTIPLE).items():
        t = t.replace(k, v)
    return "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M")).lower()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(canonical(text), F.lit(TOKEN), F.lit(0))


def tokenize(text: str | None) -> list[str]:
    return re.findall(TOKEN, canonical_text(text))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("int")


def keyword(query: str) -> str:
    """The one token that a search word stands for."""
    found = tokenize(query)
    if len(found) != 1:
        raise ValueError("The search needs exactly one word")
    return found[0]


def pattern(regex: str) -> str:
    """A search pattern without accents, its case kept."""
    if not regex or not regex.strip():
        raise ValueError("The pattern must not be blank")
    if len(regex) > MAX_PATTERN:
        raise ValueError(f"The pattern must not pass {MAX_PATTERN} characters")
    return "".join(c for c in unicodedata.normalize("NFD", regex) if not unicodedata.category(c).startswith("M"))


def checked_pattern(spark, regex: str) -> str:
    """The pattern, refused here if the JVM cannot compile it, rather than in a task."""
    p = pattern(regex)
    try:
        spark._jvm.java.util.regex.Pattern.compile(p)
    except Exception as e:
        raise ValueError(f"Invalid pattern: {p}") from e
    return p


class SubstringSearch:
    """Knuth-Morris-Pratt search of an ASCII pattern, whole or in chunks of bytes."""

    def __init__(self, needle: str):
        if not needle.isascii():
            raise ValueError("The pattern must be ASCII")
        self.needle = needle.encode()
        self.back = [0] * len(self.needle)
        k = 0
        for i in range(1, len(self.needle)):
            while k and self.needle[i] != self.needle[k]:
                k = self.back[k - 1]
            k += self.needle[i] == self.needle[k]
            self.back[i] = k
        self.reset()

    def reset(self) -> None:
        self.state, self.found = 0, not self.needle

    def feed(self, chunk: bytes, start: int = 0, end: int | None = None) -> bool:
        """Goes on over chunk[start:end]; a match may span chunks, and stays found until ``reset``."""
        end = len(chunk) if end is None else end
        if not 0 <= start <= end <= len(chunk):
            raise IndexError("Bounds lie outside the chunk")
        for b in chunk[start:end]:
            if self.found:
                break
            while self.state and self.needle[self.state] != b:
                self.state = self.back[self.state - 1]
            self.state += self.needle[self.state] == b
            self.found = self.state == len(self.needle)
        return self.found

    def search(self, text: str) -> bool:
        """Whether the text holds the pattern; characters past U+00FF before a match are refused."""
        self.reset()
        for c in text:
            if self.found:
                break
            if ord(c) > 0xFF:
                raise ValueError("The text must stay within U+00FF")
            self.feed(bytes([ord(c)]))
        return self.found
