"""Text processing for vocabularies and signatures, as columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Sequence

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlmill.constants import BACKUP_SUFFIXES, PUNCTUATION, STOP_WORDS


def without_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, " " * len(PUNCTUATION))


def without_stop_words(tokens: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Deletes stop words that stand alone between characters which are neither letters, digits nor hyphens.

    Hyphens around one stay. Only words of ASCII letters can match. Most tokens are a stop word or have letters and digits
    only, so a set decides; the regular expression sees the others.
    """
    words = [w for w in stop_words if re.fullmatch("[a-z]+", w)]
    if not words:
        return tokens
    pattern = rf"(?U)(?<![\w-])(-*)(?:{'|'.join(sorted(words, key=lambda w: (-len(w), w)))})(-*)(?![\w-])"

    def rest(token: Column) -> Column:
        return F.when(token.isin(words), F.lit("")).when(token.rlike(r"(?U)\W"), F.regexp_replace(token, pattern, "$1$2")).otherwise(token)

    return F.transform(tokens, rest)


def preprocessed(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens: punctuation to spaces, lower case, split at white space, stop words out."""
    tokens = F.split(F.lower(without_punctuation(text)), r"(?U)\s+")
    return F.filter(without_stop_words(tokens, stop_words), lambda x: x != "")


def terms(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens of two bytes or more."""
    return F.filter(preprocessed(text, stop_words), lambda x: F.octet_length(x) >= 2)


#: What a pattern's white space is, and its word characters, in Unicode's terms.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = r"\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}"


def term_counter(stop_words: Sequence[str] = STOP_WORDS) -> Callable[[str], dict[str, int]]:
    """What `terms` lists of a text, with how often, for use in tasks: each distinct token is looked at once."""
    parting = {*PUNCTUATION, *WHITE_SPACE} - {" "}
    words = {w for w in stop_words if re.fullmatch("[a-z]+", w)}
    listed = "|".join(sorted(words, key=lambda w: (-len(w), w)))
    alone = regex.compile(rf"(?<![{_WORD}-])(-*)(?:{listed})(-*)(?![{_WORD}-])").sub if words else None

    def counted(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for c in parting.intersection(text):
            text = text.replace(c, " ")
        for token, n in Counter(text.lower().split(" ")).items():
            if token in words:
                continue
            if alone and not (token.isalpha() or token.isascii() and token.isalnum()):
                token = alone(r"\1\2", token)
            if len(token) > 1 or token > "\x7f":
                out[token] = out.get(token, 0) + n
        return out

    return counted


def backup_names(name: Column) -> Column:
    """Names under which a backup of a file may lie; none for an empty name."""
    parts = F.filter(F.split(name, r"\."), lambda x: x != "")
    made = [F.concat(name, F.lit(s)) for s in BACKUP_SUFFIXES]
    made += [F.concat(F.lit("."), name, F.lit(".swp")), F.when(F.size(parts) > 1, F.concat(parts[0], F.lit(".bak")))]
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*made)))
