r"""Identifier, waybill and name clean-up, as SQL text over SQL text."""

from __future__ import annotations

# Words that mean "no value", dispatcher prefixes.
NULL_WORDS = ("nan", "none", "null")
DISPATCHER_PREFIXES = ("JMR", "ECP", "AF", "PEN", "KUL", "JHR")

_PREFIX_GROUP = "|".join(DISPATCHER_PREFIXES)
_SCIENTIFIC = r"r'^\s*[+-]?\d++(\.\d++)?[eE][+-]?\d+\s*$'"

# Filters on cleaned columns are pushed below the projection that cleans them and so repeat its
# expression. Therefore every function here mentions its argument once: "blank becomes NULL" is a
# lookup in a list of matches or of non-empty values, not a comparison and a second mention.


def strip(x: str) -> str:
    """Text without surrounding blanks; may be empty."""
    return f"regexp_extract(cast({x} AS string), r'(?sU)^\\s*+(.*\\S)?', 1)"


def cell(x: str) -> str:
    """Text without surrounding blanks; NULL when nothing or only a word for "no value" is left."""
    pattern = rf"(?isU)^\s*+(?!(?:{'|'.join(NULL_WORDS)})?\s*+$)(.*\S)"
    return f"get(regexp_extract_all(cast({x} AS string), r'{pattern}', 1), 0)"


def not_empty(text: str) -> str:
    return f"get(array_remove(array({text}), ''), 0)"


def dispatcher_key(x: str) -> str:
    """Comparable dispatcher key: alphanumerics, upper case, no known prefix, no leading zeros.

    A prefix goes only when digits alone follow it, and zeros only in front of digits. The ".0" of
    an all-digit id goes, too. Ids of the usual shape, digits after an optional prefix, take one
    match; only the others take all steps.
    """
    usual = rf"^\s*+(?:(?i:{_PREFIX_GROUP})\P{{Alnum}}*+)?0*+([1-9][0-9]*+)\s*+$"
    plain = rf"regexp_replace({cell(x)}, r'\.0$(?<=^\d{{1,38}}\.0)|\P{{Alnum}}', '')"
    full = not_empty(f"regexp_replace(upper({plain}), r'^(?:{_PREFIX_GROUP})?0*(?=[0-9]+$)', '')")
    return f"coalesce(get(regexp_extract_all(cast({x} AS string), r'{usual}', 1), 0), {full})"


def penalty_id(x: str) -> str:
    """Id as shown on penalty sheets: trimmed, without a trailing ``.0``, upper case."""
    return rf"upper(regexp_replace({cell(x)}, r'(?<=.)\.0$', ''))"


def route_key(x: str) -> str:
    """Numeric text as integer text, anything else unchanged."""
    number = f"try_cast(replace({cell(x)}, ',', '') AS double)"
    integral = (
        f"CASE WHEN {number} = floor({number}) AND abs({number}) < 1e18D "
        f"THEN cast(cast({number} AS decimal(38,0)) AS string) END"
    )
    return f"coalesce({integral}, {cell(x)})"


def waybill(x: str) -> str:
    """Waybill text without a float suffix; a whole-token scientific number is written out.

    Text that merely contains an "e" stays as it is. Numbers beyond 2**53 lost digits in the
    float they came from, and nothing restores those. Plain tokens of letters, digits and dashes
    take one match; only the others take all steps.
    """
    usual = rf"^(?!(?i:{'|'.join(NULL_WORDS)})$)(?!\d++[eE]-?\d)[A-Za-z0-9-]++$"
    number = f"try_cast({strip(x)} AS double)"
    # The numeric branch is nested, so that it is not evaluated ahead as a shared subexpression.
    written_out = (
        f"CASE WHEN {x} RLIKE {_SCIENTIFIC} THEN "
        f"CASE WHEN {number} = floor({number}) AND abs({number}) < 1e37D "
        f"THEN cast(try_cast({number} AS decimal(38,0)) AS string) END END"
    )
    plain = rf"regexp_replace({cell(x)}, r'^(\d+)\.0$', '$1')"
    return f"coalesce(get(regexp_extract_all(cast({x} AS string), r'{usual}', 0), 0), {written_out}, {plain})"


def dispatcher_name(x: str, require_delimiter: bool = False) -> str:
    """Name without a known prefix and the blanks or dashes after it.

    By default the prefix needs no delimiter, so "AFIQ" becomes "IQ"; ``require_delimiter``
    strips it only in front of a blank or a dash. Printable ASCII names take one match; only the
    others take all steps.
    """
    delimiter = "[ -]+" if require_delimiter else "[ -]*"
    words = "|".join(NULL_WORDS)
    usual = rf"^(?! )(?>(?:{_PREFIX_GROUP}){delimiter})?+(?!(?i:{words}) *$)([!-~](?:[ -~]*[!-~])?) *\z"
    full = cell(f"regexp_replace({strip(x)}, r'^(?:{_PREFIX_GROUP}){delimiter}', '')")
    return f"coalesce(get(regexp_extract_all(cast({x} AS string), r'{usual}', 1), 0), {full})"


def order_source(x: str) -> str:
    return f"upper({cell(x)})"
