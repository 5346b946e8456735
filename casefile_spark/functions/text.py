"""Column expressions over text. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Window size and overlap in tokens.
WINDOW_TOKENS = 700
WINDOW_OVERLAP = 100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def tokens(col: Column) -> Column:
    """Whitespace tokens; NULL text gives an empty array."""
    return F.filter(F.split(F.coalesce(col, F.lit("")), r"\s+"), lambda t: t != "")


def token_count(col: Column) -> Column:
    return F.size(tokens(col))


def squeeze(col: Column) -> Column:
    """Runs of whitespace become one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"\s+", " "))


def collapse_key(col: Column) -> Column:
    """Comparison key for exact repeats: spaces folded, lower case, trailing . ; , dropped."""
    return F.rtrim(F.lower(squeeze(col)), F.lit(".;,"))


def strip(col: Column) -> Column:
    """Drop leading and trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def window_count(n_tokens: Column, size: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP) -> Column:
    """How many overlapping windows cover ``n_tokens`` (0 for an empty text)."""
    step = size - overlap
    many = F.floor(F.greatest(n_tokens - overlap - 1, F.lit(0)) / F.lit(step)) + 1
    return F.when(n_tokens > 0, many).otherwise(0).cast("int")


def token_windows(toks: Column, size: int = WINDOW_TOKENS, overlap: int = WINDOW_OVERLAP) -> Column:
    """Array of window texts; the token array is built once and sliced in place."""
    step = size - overlap
    n = window_count(F.size(toks), size, overlap)
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.array_join(F.slice(toks, k * step + 1, F.lit(size)), " "),
        ),
    ).otherwise(F.array().cast("array<string>"))


# Tab, newline, vertical tab, form feed, return and printable ASCII count as legible.
ILLEGIBLE = r"[^\x09-\x0D\x20-\x7E]"


def legible_chars(col: Column) -> Column:
    return F.length(F.regexp_replace(col, ILLEGIBLE, ""))


def legible_ratio(col: Column) -> Column:
    return F.when(F.length(col) > 0, legible_chars(col) / F.length(col)).otherwise(F.lit(1.0))


ENTITY = r"&(?:#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"


def _decode_entity(ent: Column) -> Column:
    body = F.regexp_replace(ent, r"^&#?[xX]?|;$", "")
    name = F.regexp_replace(ent, r"^&|;$", "")
    named = F.create_map(*[F.lit(v) for k, cp in name2codepoint.items() for v in (k, chr(cp))])
    code = F.when(ent.rlike(r"^&#[xX]"), F.conv(body, 16, 10)).otherwise(body).cast("long")
    as_char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(ent.startswith("&#"), as_char).otherwise(F.coalesce(F.try_element_at(named, name), ent))


def unescape_entities(col: Column) -> Column:
    """Named (HTML 4) and numeric character references to characters, in one pass."""

    def rebuilt(text: Column) -> Column:
        decoded = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), 0), _decode_entity)
        joined = F.zip_with(F.split(text, ENTITY, -1), decoded, lambda p, d: F.concat(p, F.coalesce(d, F.lit(""))))
        return F.when(F.instr(text, "&") == 0, text).otherwise(F.array_join(joined, ""))

    return let(col, rebuilt)


def html_to_text(col: Column) -> Column:
    """Drop comments and tags, unescape, trim line ends, at most one blank line in a row."""
    bare = F.regexp_replace(col, r"(?s)<!--.*?-->", "")
    bare = F.regexp_replace(bare, r"</?[A-Za-z!?][^>]*>", "")
    text = unescape_entities(bare)
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return strip(text)


def join_sorted(items: Column, sep: str) -> Column:
    """Join the last field of an array of (order..., value) structs in struct order."""
    return F.array_join(F.transform(F.array_sort(items), lambda s: s["value"]), sep)
