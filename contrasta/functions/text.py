"""Text scalar functions (cleaning, counting, truncation) as Column expressions.

Python's Unicode ``\\w`` / ``\\s`` are spelled out because Java's are ASCII-only:
``WORD`` is letters, digits and underscore, ``WS`` is Unicode whitespace.
Every pattern below also runs unchanged in RE2.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}\p{N}_"
WS = r"\s\x{0B}\p{Z}\x{1C}-\x{1F}\x{85}"

ESCAPE_RE = r"<[uU]\+([0-9a-fA-F]{4,6})>"
RETWEET_RE = rf"^RT[{WS}]+@[{WORD}]+:[{WS}]+"
URL_RE = rf"https?://[^{WS}]+"
MENTION_RE = rf"@[{WORD}]+"
HASHTAG_RE = rf"#([^{WS}]+)"
# The four emoji code-point ranges removed by the cleaner.
EMOJI_RE = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{2702}-\x{27B0}]+"
# Literal contraction rewrites, applied in this order before lower-casing.
CONTRACTIONS = [("don't", "do not"), ("doesn't", "does not"),
                ("won't", "will not"), ("can't", "cannot")]
STRIP_RE = rf"^[{WS}]+|[{WS}]+\z"
WORD_RUN_RE = rf"[{WORD}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def decode_unicode_escapes(col) -> Column:
    """``<U+XXXX>`` / ``<u+XXXX>`` (4-6 hex digits) -> the character; null -> ''.

    One pass: the text is split at the escapes and joined again around the decoded characters, so
    a result is never read as an escape. Code points beyond U+10FFFF and surrogates stay as written.
    """
    t = F.coalesce(_c(col), F.lit(""))
    hexes = F.regexp_extract_all(t, F.lit(ESCAPE_RE), F.lit(1))
    whole = F.regexp_extract_all(t, F.lit(ESCAPE_RE), F.lit(0))

    def char(h, written):
        code = F.conv(h, 16, 10).cast("long")
        return F.when((code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(h, 8, "0")), "UTF-32")).otherwise(written)

    chars = F.concat(F.zip_with(hexes, whole, char), F.array(F.lit("")))
    joined = F.array_join(F.zip_with(F.split(t, ESCAPE_RE, -1), chars, lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(t, F.lit("+")), joined).otherwise(t)


def _rx(col: Column, pattern: str, repl: str) -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(repl))


def _where(col: Column, applies, change) -> Column:
    """``change`` of the texts for which it ``applies``, the others as they are; an array of one element binds the text."""
    return F.transform(F.array(col), lambda x: F.when(applies(x), change(x)).otherwise(x))[0]


def clean_text(col) -> Column:
    """The full cleaning chain: decode escapes, strip retweet prefix, URL/mention
    tokens, hashtag marks, emoji ranges, contractions, lower-case, newlines, strip.

    URL/USER tokens are inserted upper-case and then lower-cased with the text,
    and contractions are expanded before lower-casing (so ``Don't`` survives).
    """
    def contracted(t: Column) -> Column:
        for a, b in CONTRACTIONS:
            t = F.replace(t, F.lit(a), F.lit(b))
        return t

    # each pattern runs on the texts that hold what its matches begin with or contain
    t = decode_unicode_escapes(col)
    t = _where(t, lambda x: F.startswith(x, F.lit("RT")), lambda x: _rx(x, RETWEET_RE, ""))
    t = _where(t, lambda x: F.contains(x, F.lit("http")), lambda x: _rx(x, URL_RE, "URL"))
    t = _where(t, lambda x: F.contains(x, F.lit("@")), lambda x: _rx(x, MENTION_RE, "USER"))
    t = _where(t, lambda x: F.contains(x, F.lit("#")), lambda x: _rx(x, HASHTAG_RE, "$1"))
    t = _where(t, lambda x: F.octet_length(x) > F.length(x), lambda x: _rx(x, EMOJI_RE, ""))  # emoji are not ASCII
    t = _where(t, lambda x: F.contains(x, F.lit("'")), contracted)
    t = F.lower(t)
    t = F.replace(F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(""))
    return strip_ws(t)


def strip_ws(col) -> Column:
    """Unicode-whitespace strip (Spark ``trim`` removes spaces only), for texts that begin or end with whitespace."""
    def at_ends(x: Column) -> Column:
        return F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(f"[{WS}]")
    return _where(_c(col), at_ends, lambda x: _rx(x, STRIP_RE, ""))


def char_count(col) -> Column:
    """Number of code points; null counts as ''."""
    return F.length(F.coalesce(_c(col), F.lit(""))).cast("long")


def word_count(col) -> Column:
    """Number of maximal word-character runs; null -> 0."""
    return F.coalesce(F.regexp_count(_c(col), F.lit(WORD_RUN_RE)), F.lit(0)).cast("long")


def truncate_text(col, limit: int = 240) -> Column:
    """Collapse whitespace runs to one space; keep ``limit`` characters, else the
    first ``limit - 3`` right-stripped plus ``...``."""
    t = _rx(_rx(F.coalesce(_c(col).cast("string"), F.lit("")), rf"[{WS}]+", " "), "^ | $", "")
    cut = F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def model_input(col, max_chars: int = 2000) -> Column:
    """Fixed-length model input: first ``max_chars`` characters, null -> ''."""
    return F.substring(F.coalesce(_c(col), F.lit("")), 1, max_chars)


def na_to_null(col, tokens=("na", "n/a")) -> Column:
    """Exact, case-sensitive NA tokens -> null."""
    c = _c(col)
    return F.when(~c.isin(*tokens), c)
