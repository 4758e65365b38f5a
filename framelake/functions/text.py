"""Text functions: folding of accents and case, word matches, tokens, JSON answers."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str]:
    """(from, to) for translate: lower-case letters to their base, then combining marks, which go."""
    pairs = {"đ": "d"}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        if c != c.lower():
            continue
        base = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if base != c and len(base) == 1:
            pairs[c] = base
    marks = "".join(chr(c) for c in range(0x300, 0x370) if unicodedata.category(chr(c)) == "Mn")
    return "".join(pairs) + marks, "".join(pairs.values())


def strip_accents(text: Column) -> Column:
    """Lower case without accents; ``đ`` becomes ``d``. Composed and decomposed input give the same."""
    return F.translate(F.lower(text), *_folding())


@lru_cache(maxsize=1)
def _composed() -> list[tuple[str, str]]:
    """(letter and mark, the one character for both), letters with fewer marks first; by the rules of Unicode's canonical composition."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(code)
        parts = unicodedata.normalize("NFD", c)
        for i in range(1, len(parts)):
            rest = parts[1:i] + parts[i + 1 :]
            first = unicodedata.normalize("NFC", parts[0] + rest)
            if unicodedata.normalize("NFC", first + parts[i]) == c and len(first) == 1:
                pairs[first + parts[i]] = c
    return sorted(pairs.items(), key=lambda x: (len(unicodedata.normalize("NFD", x[1])), x))


def composed(text: Column) -> Column:
    """Latin letters followed by combining marks as one character each; only texts that have such marks are changed."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in _composed()])
    return F.when(text.rlike("[\u0300-\u036f]"), F.aggregate(pairs, text, lambda t, x: F.replace(t, x["a"], x["b"]))).otherwise(text)


def normalize(text: Column) -> Column:
    """Composed, trimmed lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(composed(text), r"\s+", " ")))


def contains_phrase(text: Column, phrase: Column | str) -> Column:
    """Whether the phrase occurs in the text as whole, adjacent words."""
    needle = F.lit(f" {phrase} ") if isinstance(phrase, str) else F.concat(F.lit(" "), phrase, F.lit(" "))
    return F.contains(F.concat(F.lit(" "), text, F.lit(" ")), needle)


def ordered_words_pattern(needle: str) -> str:
    """A pattern that finds the needle's words in order, with anything between; an empty needle matches all."""
    words = [re.escape(w) for w in needle.split()]
    return r"(?s)(^|\s)" + r"\s(.*\s)?".join(words) + r"(\s|$)" if words else ""


def ordered_words(text: Column, needle: str) -> Column:
    """Whether the needle's words are an ordered subsequence of the text's words.

    Each word is searched for, between blanks, after the one before it; no text
    is cut into words.
    """
    words = needle.split()
    if not words:
        return text.isNotNull()
    padded = F.concat(F.lit(" "), F.translate(text, "\t\n\x0b\f\r", "     "), F.lit(" "))
    if len(words) == 1:
        return F.contains(padded, F.lit(f" {words[0]} "))

    def after(held: Column, at: Column, w: Column) -> Column:
        """The place from which the next word may begin (its blank), or 0 when a word was missing."""
        place = F.call_function("locate", F.concat(F.lit(" "), w, F.lit(" ")), held, at)
        return F.when((at == 0) | (place == 0), 0).otherwise(place + F.length(w) + 1)

    need = F.array(*map(F.lit, words))
    reached = F.transform(F.array(padded), lambda held: F.aggregate(need, F.lit(1), lambda at, w: after(held, at, w)))[0]
    return F.when(text.isNotNull(), reached > 0)


def ordered_words_of(text: Column, needle: Column) -> Column:
    """The same for a needle in a column."""
    need = F.filter(F.split(needle, r"\s+"), lambda w: w != "")
    found = F.aggregate(F.split(text, r"\s+"), F.lit(0), lambda i, w: F.when(w == F.get(need, i), i + 1).otherwise(i))
    return found == F.size(need)


def significant_tokens(text: Column) -> Column:
    """The distinct words of three or more characters, and all numbers."""
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: (F.length(w) >= 3) | w.rlike("^[0-9]+$")))


def prompt(phrases: Column) -> Column:
    """Distinct phrases in order, as one detection prompt: ``a. b. c.``"""
    return F.concat(F.array_join(F.array_sort(F.array_distinct(phrases)), ". "), F.lit("."))


def parse_answer(text: Column, schema: str, default: Column) -> Column:
    """A JSON answer, perhaps inside a code fence; what isn't JSON gives the default."""
    bare = F.trim(F.regexp_replace(text, r"^\s*```(json)?|```\s*$", ""))
    parsed = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    return F.when(F.get_json_object(bare, "$").isNull(), default).otherwise(F.coalesce(parsed, default))


def answers_match(answer: Column, truth: Column) -> Column:
    """Whether one of two trimmed lower-case answers contains the other; an empty one matches nothing."""
    a, t = F.trim(F.lower(answer)), F.trim(F.lower(truth))
    return F.coalesce((a != "") & (t != "") & (F.contains(t, a) | F.contains(a, t)), F.lit(False))


def best_text(refined: Column, itn: Column, raw: Column) -> Column:
    return F.coalesce(refined, itn, raw)
