"""Plain forms of the values that are spelled in several ways, as column expressions.

Each function takes and returns a ``Column``; a value that says nothing becomes null. The
``sql_*`` twins give the same expression as DuckDB text for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that only say that nothing is known.
MISSING_WORDS = (
    "missing", "n a", "na", "nan", "nil", "no data", "none", "not available", "not known", "not recorded",
    "not set", "null", "pending", "tba", "tbd", "undefined", "unknown", "unset", "unspecified", "void",
)

# Spellings of the splits, without anything but letters.
SPLIT_WORDS = {
    "train": ("train", "training", "trn", "tr"),
    "val": ("val", "valid", "validation", "dev"),
    "test": ("test", "testing", "tst"),
    "external_eval": ("externaleval", "exteval", "external", "externalevaluation"),
}

EVAL_SPLITS = ("val", "test", "external_eval")

_EDGE = r"^[^a-z0-9]+|[^a-z0-9]+$"
_DIGEST_PREFIX = r"^(?:(?:urn|hash|digest|sum|hex|checksum)[^a-z0-9]+)*(?:sha[^a-z0-9]?2?[^a-z0-9]?256|0x)?[^a-z0-9]*"
_NON_ALNUM = r"[^a-z0-9]+"
_MARKS = "\t\r\n!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\u00a0\u2013\u2014\u2026\u00b7\u2022"
_CAMPAIGN_CUT = r"\s*(?:::|[/\\|:>]|\s[-_]\s)\s*"


def words_only(c: Column) -> Column:
    """Lower case with every run of other characters as one blank."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def known_text(c: Column) -> Column:
    """The trimmed text; null for blanks, bare marks and the missing words."""
    # Marks become blanks by translation, which costs a tenth of a pattern.
    bare = F.trim(F.regexp_replace(F.translate(F.lower(c), _MARKS, " " * len(_MARKS)), "  +", " "))
    return F.when(~bare.isin("", *MISSING_WORDS), F.trim(c))


def plain_digest(c: Column) -> Column:
    """64 lower-case hex digits, or null where the value is not exactly that or all zeros."""
    x = F.regexp_replace(F.lower(c), _EDGE, "")
    x = F.regexp_replace(F.regexp_replace(x, _DIGEST_PREFIX, ""), _NON_ALNUM, "")
    # Most are plain already; the order of the branches spares those the replacements.
    x = F.when(c.rlike(r"^[0-9a-f]{64}\z"), c).otherwise(F.when(x.rlike("^[0-9a-f]{64}$"), x))
    return F.nullif(x, F.lit("0" * 64))


def hash_bits(c: Column) -> Column:
    """A 64-bit hash written in hex as BIGINT (two's complement); null if unreadable or 0."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), _EDGE, ""), "^0x", "")
    x = F.when(c.rlike(r"^[0-9a-f]{16}\z"), c).otherwise(F.when(x.rlike("^[0-9a-f]{1,16}$"), x))
    bits = F.conv(x, 16, -10).cast("bigint")
    return F.when(bits != 0, bits)


def known_bits(c: Column) -> Column:
    """A 64-bit hash given as a number; 0 is missing."""
    return F.when(c != 0, c.cast("bigint"))


def plain_split(c: Column) -> Column:
    letters = F.regexp_replace(F.lower(c), "[^a-z]+", "")
    words = F.create_map(*[F.lit(x) for name, spellings in SPLIT_WORDS.items() for spelling in spellings for x in (spelling, name)])
    return F.when(c.isin(*SPLIT_WORDS), c).otherwise(F.try_element_at(words, letters))


def path_part(c: Column, place: int) -> Column:
    """Part ``place`` after the ``images`` folder: 1 split, 2 dataset, 3 campaign."""
    return F.nullif(F.regexp_extract(F.translate(c, "\\", "/"), r"(?:^|/)images/([^/]*)/([^/]*)/([^/]*)/", place), F.lit(""))


def plain_name(c: Column) -> Column:
    """A dataset or source name reduced to its letters and digits; null if missing."""
    return F.when(known_text(c).isNotNull(), F.nullif(F.regexp_replace(F.lower(c), _NON_ALNUM, ""), F.lit("")))


def plain_label(c: Column) -> Column:
    """A name in lower case with single underscores between its words; null if missing."""
    words = words_only(c)
    return F.when(known_text(c).isNotNull(), F.translate(words, " ", "_"))


def plain_campaign(c: Column) -> Column:
    """``dataset/campaign`` in lower case; null if missing."""
    x = F.regexp_replace(F.regexp_replace(F.lower(c), r"^\s+|\s+$", ""), _CAMPAIGN_CUT, "/")
    plain = c.rlike(r"^[a-z0-9]+/[a-z0-9]+\z") & ~F.translate(c, "/", " ").isin(*MISSING_WORDS)
    return F.when(plain, c).otherwise(F.when(known_text(c).isNotNull(), x))


# The same in DuckDB's SQL.


def sql_digest(c: str) -> str:
    x = f"regexp_replace(lower({c}), '{_EDGE}', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '{_DIGEST_PREFIX}', ''), '{_NON_ALNUM}', '', 'g')"
    return f"CASE WHEN regexp_full_match({x}, '[0-9a-f]{{64}}') AND NOT regexp_full_match({x}, '0+') THEN {x} END"


def sql_hash_bits(c: str) -> str:
    x = f"regexp_replace(regexp_replace(lower({c}), '{_EDGE}', '', 'g'), '^0x', '')"
    n = f"CAST('0x' || {x} AS UBIGINT)"
    wrapped = f"CASE WHEN {n} >= 9223372036854775808 THEN CAST(CAST({n} AS HUGEINT) - 18446744073709551616 AS BIGINT) ELSE CAST({n} AS BIGINT) END"
    return f"nullif(CASE WHEN regexp_full_match({x}, '[0-9a-f]{{1,16}}') THEN {wrapped} END, 0)"


def sql_split(c: str) -> str:
    letters = f"regexp_replace(lower({c}), '[^a-z]+', '', 'g')"
    cases = " ".join(f"WHEN {letters} IN ({', '.join(map(repr, s))}) THEN '{n}'" for n, s in SPLIT_WORDS.items())
    return f"CASE {cases} END"


def sql_path_part(c: str, place: int) -> str:
    return f"nullif(regexp_extract(replace({c}, '\\', '/'), '(?:^|/)images/([^/]*)/([^/]*)/([^/]*)/', {place}), '')"


def sql_known(c: str) -> str:
    words = f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"CASE WHEN {words} <> '' AND {words} NOT IN ({', '.join(map(repr, MISSING_WORDS))}) THEN trim({c}) END"


def sql_name(c: str) -> str:
    return f"CASE WHEN ({sql_known(c)}) IS NOT NULL THEN nullif(regexp_replace(lower({c}), '{_NON_ALNUM}', '', 'g'), '') END"


def sql_campaign(c: str) -> str:
    x = rf"regexp_replace(regexp_replace(lower({c}), '^\s+|\s+$', '', 'g'), '{_CAMPAIGN_CUT}', '/', 'g')"
    return f"CASE WHEN ({sql_known(c)}) IS NOT NULL THEN {x} END"
