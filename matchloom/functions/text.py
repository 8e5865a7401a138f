"""Normalisation of names and addresses as pure Column functions.

Word characters are letters, numbers and the underscore, without combining marks.  Null counts as ''.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal suffixes dropped from names, address abbreviations, stop words.
LEGAL_SUFFIXES = [
    "corp", "corporation", "co", "company", "inc", "incorporated", "ltd", "limited", "llc", "llp", "pvt",
    "private", "plc", "gmbh", "sarl", "sa", "pty", "bv", "ag", "kg", "srl",
]
ADDRESS_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ln": "lane",
    "apt": "apartment", "fl": "floor", "bldg": "building", "hwy": "highway", "ste": "suite", "sq": "square",
    "ct": "court", "pl": "place", "pkwy": "parkway",
}
STOPWORDS = ["the", "and", "of", "for", "near", "at", "in", "a", "an"]

NOT_WORD = r"[^\p{L}\p{N}_]+"
_START, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"


def _col(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, NOT_WORD, " "), " "), lambda w: w != "")


def normalize_name(name: str | Column) -> Column:
    """Lower case, '&' as 'and', signs out, legal suffixes out, single spaces."""
    words = _words(F.replace(F.lower(_col(name)), F.lit("&"), F.lit(" and ")))
    return F.array_join(F.filter(words, lambda w: ~w.isin(LEGAL_SUFFIXES)), " ")


def normalize_address(address: str | Column) -> Column:
    """Lower case, signs out, abbreviations in full, single spaces."""
    full = F.create_map(*(F.lit(x) for kv in ADDRESS_ABBREVIATIONS.items() for x in kv))
    return F.array_join(F.transform(_words(F.lower(_col(address))), lambda w: F.coalesce(F.try_element_at(full, w), w)), " ")


def significant_tokens(text: str | Column, min_len: int = 3) -> Column:
    """Sorted distinct tokens of a normalised text, at least min_len long and no stop words."""
    words = F.split(_col(text), " ")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= min_len) & ~w.isin(STOPWORDS))))


def postal_code(address: str | Column, country: str | Column) -> Column:
    """The first postal code of a raw address by the country's rule, else ''."""
    raw, n = _col(address), _col(country)
    find = lambda digits: F.regexp_extract(raw, _START + digits + _END, 0)
    return F.when(n == "india", find(r"[1-9]\p{Nd}{5}")).when(n.isin("us", "france"), find(r"\p{Nd}{5}")).otherwise(find(r"\p{Nd}{4,6}"))


def numeric_tokens(address: str | Column) -> Column:
    """Sorted distinct whole-number tokens of a raw address."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(address), F.lit(_START + r"\p{Nd}+" + _END), F.lit(0))))


def country_norm(country: str | Column) -> Column:
    """Trimmed of all white space, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(_col(country), r"^\s+", ""), r"\s+$", ""))


def embed_text(norm_name: str | Column, norm_addr: str | Column) -> Column:
    return F.trim(F.concat_ws(" ", norm_name, norm_addr))


def sorted_key(tokens: str | Column) -> Column:
    """Tokens, sorted, as one key."""
    return F.array_join(tokens, " ")


def prefix_key(norm_name: str | Column) -> Column:
    """The first three characters of a name that has three, else null."""
    c = _col(norm_name)
    return F.when(F.length(c) >= 3, F.substring(c, 1, 3))


def char_grams(text: str | Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within words, each word between spaces: all substrings of low to high characters."""
    words = F.filter(F.split(_col(text), " "), lambda w: w != "")

    def of_size(padded: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (n - 1))
        return F.when(F.length(padded) >= n, F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.concat(*(of_size(padded, n) for n in range(low, high + 1)))

    return F.flatten(F.transform(words, of_word))
