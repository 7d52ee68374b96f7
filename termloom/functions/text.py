"""Text expressions. All are built-in Spark functions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.fixed_values import OBO_PREFIX, PROMPT_MISSING_WORDS

# Unicode white space plus the four separators U+001C..U+001F.
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_RUNS = rf"(?U){_SPACE}+"


def strip_text(text: Column) -> Column:
    """Cut all Unicode white space at both ends (``trim`` only cuts spaces)."""
    return F.btrim(text, F.lit(_SPACES))


def blank_to_null(text: Column) -> Column:
    """Stripped text, or null when nothing is left."""
    return F.nullif(strip_text(text), F.lit(""))


def collapse_spaces(text: Column) -> Column:
    """Stripped text with every run of white space turned into one space."""
    return F.regexp_replace(strip_text(text), _RUNS, " ")


def normalize_name(text: Column) -> Column:
    """Form in which names are compared: stripped, lower case, single spaces."""
    return collapse_spaces(F.lower(text))


def compact_id(uri: Column) -> Column:
    """``.../obo/P_N`` becomes ``P:N``, split at the first underscore; other URIs stay."""
    escaped = OBO_PREFIX.replace(".", r"\.")
    return F.regexp_replace(uri, rf"(?s)\A{escaped}([^_]*)_(.*)\z", "$1:$2")


def word_tokens(text: Column) -> Column:
    """Lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def word_ngrams(text: Column) -> Column:
    """Word tokens followed by the pairs of neighbouring tokens."""
    return word_unigrams_and_bigrams(word_tokens(text))


def neighbour_pairs(tokens: Column) -> Column:
    """Pairs of neighbouring tokens, joined by a space; none for fewer than two tokens."""
    pairs = F.greatest(F.size(tokens) - 1, F.lit(0))
    heads, tails = F.slice(tokens, F.lit(1), pairs), F.slice(tokens, F.lit(2), pairs)
    return F.zip_with(heads, tails, lambda a, b: F.concat_ws(" ", a, b))


def word_unigrams_and_bigrams(tokens: Column) -> Column:
    return F.concat(tokens, neighbour_pairs(tokens))


def pad_words(text: Column) -> Column:
    """The lower-case text with one space on both sides of every word: `` w1  w2  w3 ``."""
    spaced = F.regexp_replace(strip_text(F.lower(text)), _RUNS, "  ")
    return F.concat(F.lit(" "), spaced, F.lit(" "))


def char_ngrams(text: Column) -> Column:
    """Character 3- to 5-grams inside single words, each word padded with one space per side."""
    return padded_char_ngrams(pad_words(text))


def padded_char_ngrams(padded: Column) -> Column:
    """Character grams of a text from :func:`pad_words`.

    A gram is any window whose inner characters are not spaces, so it can touch one padding
    space per end but never span two words. The lookahead keeps the scan linear, also for one
    very long word.
    """
    grams = [
        F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.[^ ]{{{n - 2}}}.))."), F.lit(1))
        for n in (3, 4, 5)
    ]
    return F.concat(*grams)


def context_query(value: Column, field: Column) -> Column:
    """Second query text: the field name in words, then the value."""
    with_field = F.concat(F.replace(field, F.lit("_"), F.lit(" ")), F.lit(" "), value)
    return F.when(F.coalesce(field, F.lit("")) != "", with_field).otherwise(value)


def is_missing_word(stripped: Column) -> Column:
    """True for text that prompts leave out."""
    return (stripped == "") | F.upper(stripped).isin(*PROMPT_MISSING_WORDS)


def strip_fence(text: Column) -> Column:
    """Remove a Markdown code fence around a response, then strip."""
    head = F.regexp_replace(strip_text(text), rf"(?iU)\A```(?:json)?{_SPACE}*", "")
    return strip_text(F.regexp_replace(head, rf"(?U){_SPACE}*```\z", ""))
