"""Scalar column functions: selectors, addresses, labels, durations, sentences, escapes. All are built of Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of call types and what they count as.
CALL_TYPES = {
    "call": "call", "callcode": "callcode", "delegatecall": "delegatecall", "staticcall": "staticcall",
    "create": "create", "create2": "create", "selfdestruct": "selfdestruct", "suicide": "selfdestruct",
}

ELLIPSIS = "…"


def selector_of_input(data: Column) -> Column:
    """The first four bytes of calldata, lower-cased; null for missing or shorter data."""
    return F.when((F.length(data) >= 10) & F.startswith(data, F.lit("0x")), F.lower(F.substring(data, 1, 10)))


def call_type(raw: Column) -> Column:
    """A provider's name for a call in our set of names; ``call`` if it is missing or unknown."""
    book = F.create_map(*(F.lit(x) for pair in CALL_TYPES.items() for x in pair))
    return F.coalesce(F.try_element_at(book, F.lower(raw)), F.lit("call"))


def is_address(text: Column) -> Column:
    return F.coalesce(text.rlike("^0x[0-9a-fA-F]{40}$"), F.lit(False))


def has_code(code: Column) -> Column:
    return F.coalesce(F.length(code) > 4, F.lit(False))


def short_address(address: Column) -> Column:
    """First six and last four characters of an address of more than twelve."""
    return F.when(F.length(address) > 12, F.concat(F.substring(address, 1, 6), F.lit(ELLIPSIS), F.right(address, F.lit(4)))).otherwise(address)


def pick_label(address: Column, *names: Column) -> Column:
    """The first name that is not empty, else the short address."""
    return F.coalesce(*(F.nullif(n, F.lit("")) for n in names), short_address(address))


def address_from_word(word: Column) -> Column:
    """The low 20 bytes of a 32-byte word; null if it is shorter or they are zero."""
    low = F.concat(F.lit("0x"), F.lower(F.right(word, F.lit(40))))
    return F.when((F.length(word) >= 42) & ~low.rlike("^0x0*$"), low)


def hex_number(text: Column) -> Column:
    """A hexadecimal number with or without 0x, as long; null if it is none or too large."""
    digits = F.regexp_replace(F.lower(text), "^0x", "")
    return F.when(digits.rlike("^0*[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).try_cast("long"))


def name_of_signature(signature: Column) -> Column:
    """The text before the parenthesis; null without one, or if nothing stands before it."""
    return F.when(F.instr(signature, "(") > 1, F.substring_index(signature, "(", 1))


def first_positive(*values: Column) -> Column:
    """The first value that is a positive number."""
    return F.coalesce(*(F.when(v.try_cast("double") > 0, v.try_cast("double").cast("long")) for v in values))


def unix_seconds(text: Column) -> Column:
    return F.unix_timestamp(F.try_to_timestamp(text))


def duration(days: Column) -> Column:
    """A span in the largest unit that it fills: days or hours with one decimal, or whole minutes."""
    hours = days * 24
    minutes = F.floor(hours * 60 + 0.5).cast("long").cast("string")
    return F.when(days >= 1, F.format_string("%.1f days", days)).when(hours >= 1, F.format_string("%.1f hours", hours)).otherwise(F.concat(minutes, F.lit(" minutes")))


def sentence(text: Column) -> Column:
    """Upper case first, a full stop last."""
    begun = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))
    return F.when(text.rlike("[.!?]$"), begun).otherwise(F.concat(begun, F.lit(".")))


def listed(items: Column, most: int = 6) -> Column:
    """``a``, ``a and b``, ``a, b and c``; beyond ``most``: ``a, b, and 3 more``."""
    n = F.size(items)
    short = F.when(n <= 1, F.array_join(items, "")).otherwise(
        F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1))
    )
    long = F.concat(F.array_join(F.slice(items, 1, most), ", "), F.lit(", and "), (n - most).cast("string"), F.lit(" more"))
    return F.when(n == 0, "").when(n > most, long).otherwise(short)


def first_sentence(text: Column) -> Column:
    """Up to and with the first full stop that ends a word; the whole text without one."""
    found = F.regexp_extract(text, r"^([^.]*\.)", 1)
    return F.when(found == "", text).otherwise(found)


def html_escape(text: Column) -> Column:
    """The five characters and their entities."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def env_name(key: Column, prefix: str = "RPC_URL_") -> Column:
    """The variable that holds a chain's address."""
    return F.concat(F.lit(prefix), F.regexp_replace(F.upper(key), "[^A-Z0-9]", "_"))


def scrub(text: Column, secrets: list[str]) -> Column:
    """text with each secret replaced, longest first, so that no part of a longer one stays."""
    for secret in sorted(filter(None, set(secrets)), key=lambda s: (-len(s), s)):
        text = F.replace(text, F.lit(secret), F.lit("***"))
    return text


def chunk(position: Column, size: int) -> Column:
    """Number of the batch of a zero-based position."""
    return F.floor(position / size).cast("long")


def span_blocks(days: Column, block_time: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(days * 86400 / block_time + 0.5)).cast("long")


def slice_size(block_time: Column, low: int = 25, high: int = 2000) -> Column:
    return F.least(F.greatest(F.floor(F.lit(2000) * block_time / 12 + 0.5), F.lit(low)), F.lit(high)).cast("long")
