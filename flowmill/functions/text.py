"""Column builders for untidy label texts and IPv4 address texts.

Each builder has a twin that gives the same expression as SQL text for the
oracle, so both sides can be compared value by value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``\z``, not ``$``: the latter also matches before a final line break.
_BLANK = r"\s\p{Z}\x{0085}\x{200B}\x{FEFF}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PLAIN_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}\z"
_NUM = "0*([0-9]{1,3})"
WRITTEN_IPV4 = (
    rf"(?i)^[{_BLANK}\"'\[(<]*(?:[0:]*:ffff:|::)?{_NUM}\.{_NUM}\.{_NUM}\.{_NUM}"
    rf"(?:[{_BLANK}\"'\])>]|:[0-9]+|/[0-9.]+)*\z"
)


def label_key(c: Column | str) -> Column:
    """Text for comparing labels: lower case, no outer blanks, one blank
    wherever ``-``, ``_``, blanks or a run of them stand. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.regexp_replace(c, rf"^[{_BLANK}]+|[{_BLANK}]+\z", "")
    return F.lower(F.regexp_replace(trimmed, rf"[{_BLANK}_-]+", " "))


def label_key_sql(c: str) -> str:
    trimmed = rf"regexp_replace({c}, '^[{_BLANK}]+|[{_BLANK}]+\z', '', 'g')"
    return rf"lower(regexp_replace({trimmed}, '[{_BLANK}_-]+', ' ', 'g'))"


def ipv4(c: Column | str) -> Column:
    """The plain dotted quad an address text names, else null.

    Outer blanks, quotes and brackets, leading zeros, a port, a mask and the
    IPv4-mapped prefix are dropped; octets above 255 name no address. Plain
    texts (nearly all) pass with one test and no rewriting.
    """
    c = F.col(c) if isinstance(c, str) else c
    rewritten = F.regexp_replace(c, WRITTEN_IPV4, "$1.$2.$3.$4")
    return F.when(c.rlike(PLAIN_IPV4), c).when(rewritten.rlike(PLAIN_IPV4), rewritten)


def ipv4_sql(c: str) -> str:
    pattern = WRITTEN_IPV4.replace("'", "''")
    re = rf"regexp_replace({c}, '{pattern}', '\1.\2.\3.\4')"
    return f"CASE WHEN regexp_matches({c}, '{PLAIN_IPV4}') THEN {c} WHEN regexp_matches({re}, '{PLAIN_IPV4}') THEN {re} END"


def measure(c: Column | str) -> Column:
    """A measure as a finite, non-negative number; all else becomes null."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when((c >= 0) & ~F.isnan(c) & (c < F.lit(float("inf"))), c)


def measure_sql(c: str) -> str:
    return f"CASE WHEN isfinite({c}::DOUBLE) AND {c} >= 0 THEN {c}::DOUBLE END"
