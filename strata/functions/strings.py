"""Text functions: cleansing, casing, keys and masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata.functions._cols import ColumnLike, as_col

# Texts that stand for a missing value.
NULL_TOKENS = ("", "NULL", "null", "None", "N/A", "n/a", "NA")
# Output prefix of each mask kind; the last four characters follow.
MASK_PREFIXES = {"phone": "***-***-", "ssn": "***-**-", "credit_card": "****-****-****-"}
REDACTED = "[REDACTED]"
# White space of any alphabet, and the four separators that count as white space.
SPACE = r"[\s\x{1C}-\x{1F}\x{85}\p{Z}]"


def strip(value: ColumnLike) -> Column:
    """Remove white space of any kind from both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(as_col(value), rf"^{SPACE}+|{SPACE}+$", "")


def null_if_token(value: ColumnLike, tokens: tuple[str, ...] | list[str] = NULL_TOKENS) -> Column:
    column = as_col(value)
    return F.when(column.isin(*tokens), F.lit(None)).otherwise(column)


def clean_string(value: ColumnLike) -> Column:
    """Strip, then squeeze inner white space to one blank; null becomes the empty text."""
    return F.coalesce(F.regexp_replace(strip(value), rf"{SPACE}+", " "), F.lit(""))


def title_case(value: ColumnLike) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the others; null becomes "".

    A letter whose upper case is two letters keeps the second one small (``ß`` gives ``Ss``).
    """
    runs = F.regexp_extract_all(F.lower(strip(value)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))

    def titled(run: Column) -> Column:
        first = F.upper(F.substring(run, 1, 1))
        return F.concat(F.substring(first, 1, 1), F.lower(F.substring(first, 2, 3)), F.substring(run, 2, 1 << 30))

    return F.coalesce(F.array_join(F.transform(runs, titled), ""), F.lit(""))


def full_name(first: ColumnLike, last: ColumnLike) -> Column:
    blank = F.lit("")
    return strip(F.concat(F.coalesce(as_col(first), blank), F.lit(" "), F.coalesce(as_col(last), blank)))


def email_domain(value: ColumnLike) -> Column:
    column = as_col(value)
    return F.when(F.contains(column, F.lit("@")), F.lower(F.substring_index(column, "@", -1))).otherwise(F.lit(""))


def mask_keep_last(value: ColumnLike, mask_char: str = "*", visible: int = 4) -> Column:
    """Hide all but the last characters; a value no longer than ``visible`` is hidden completely."""
    column = as_col(value)
    length = F.char_length(column)
    masked = F.when(
        length > visible,
        F.concat(F.repeat(F.lit(mask_char), length - visible), F.right(column, F.lit(visible))),
    ).otherwise(F.repeat(F.lit(mask_char), length))
    return F.coalesce(masked, F.lit(""))


def mask_as(value: ColumnLike, kind: str) -> Column:
    """Mask by kind; null and empty values stay as they are. An e-mail without one ``@`` becomes ``***``."""
    column = as_col(value).cast("string")
    if kind == "email":
        parts = F.split(column, "@")
        local, domain = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        masked = F.when(F.size(parts) == 2, F.concat(F.left(local, F.lit(2)), F.lit("***@"), domain)).otherwise(F.lit("***"))
    elif kind in MASK_PREFIXES:
        masked = F.concat(F.lit(MASK_PREFIXES[kind]), F.right(column, F.lit(4)))
    else:
        raise ValueError(f"unknown mask kind {kind!r}; known: email, {', '.join(MASK_PREFIXES)}")
    return F.when(F.char_length(column) > 0, masked).otherwise(column)


def pii_hash(value: ColumnLike) -> Column:
    column = as_col(value).cast("string")
    return F.when(F.char_length(column) > 0, F.sha2(column, 256))


def surrogate_hash(*columns: ColumnLike) -> Column:
    """Sixteen hex digits over the ``|``-joined parts; a null part is written ``None``."""
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("None")) for c in columns]
    return F.left(F.md5(F.concat_ws("|", *parts)), F.lit(16))


def row_hash(*columns: ColumnLike) -> Column:
    """All 32 hex digits of the digest that ``surrogate_hash`` takes 16 of."""
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("None")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def natural_key(*columns: ColumnLike) -> Column:
    parts = [F.coalesce(as_col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws("|", *parts)


def merchant_slug(name: ColumnLike) -> Column:
    return F.regexp_replace(F.lower(as_col(name)), " ", "_")


def json_text(value: ColumnLike, path: str) -> Column:
    """Text at a JSON path; null when the document or the path is absent."""
    return F.get_json_object(as_col(value), path)


def json_array(value: ColumnLike) -> Column:
    return F.from_json(as_col(value), "array<string>")


def present_items(*items: Column) -> Column:
    """Array of the items that are not null, in the order given; empty array when there are none."""
    return F.array_compact(F.array(*items))
