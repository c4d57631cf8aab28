"""Column expressions for text handling (all JVM-side, inside codegen).

Regular expressions are written with explicit character classes so that the
same pattern means the same thing in Java regex (Spark) and RE2 (the SQL
oracle); ``\\s`` differs between the two and is never used.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
# Whitespace as Python's str.isspace() / re "\s" sees it (used by the Python
# side of the original application: paragraph normalisation, strip()).
PY_WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Whitespace as JavaScript's "\s" and String.prototype.trim() see it (used by
# the browser side: reference extraction, quiz parsing).
JS_WS = (r"\t\n\x{0B}\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
         r"\x{202F}\x{205F}\x{3000}\x{FEFF}")
# JavaScript "." excludes these line terminators.
JS_NOT_NL = r"[^\n\r\x{2028}\x{2029}]"
# Word characters (Python's "\w" over str).
WORD = r"\p{L}\p{N}_"
# Default term pattern of the TF-IDF vectoriser: runs of two or more word chars.
TERM_PATTERN = rf"[{WORD}]{{2,}}"
# Offline token model: a word run, or one other non-space character.
TOKEN_PATTERN = rf"[{WORD}]+|[^{WORD}{PY_WS}]"
# A token with its leading whitespace, so that concatenation rebuilds text.
PIECE_PATTERN = rf"[{PY_WS}]*(?:{TOKEN_PATTERN})"
# ---------------------------------------------------------------------------


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def collapse_ws(col) -> Column:
    """``re.sub(r'\\s+', ' ', text)``: no trim."""
    return F.regexp_replace(_c(col), F.lit(f"[{PY_WS}]+"), F.lit(" "))


def normalize(col) -> Column:
    """Whitespace collapse followed by lower-case (P3 + P4)."""
    return F.lower(collapse_ws(col))


def py_strip(col) -> Column:
    """Python ``str.strip()``; Spark's ``trim`` only removes spaces."""
    return F.regexp_replace(_c(col), F.lit(rf"\A[{PY_WS}]+|[{PY_WS}]+\z"), F.lit(""))


def js_trim(col) -> Column:
    """JavaScript ``String.prototype.trim()``."""
    return F.regexp_replace(_c(col), F.lit(rf"\A[{JS_WS}]+|[{JS_WS}]+\z"), F.lit(""))


def is_blank(col) -> Column:
    """Whether ``py_strip`` leaves nothing; the search ends at the first other character."""
    return ~_c(col).rlike(f"[^{PY_WS}]")


def terms(col) -> Column:
    """TF-IDF terms of a text (lower-cased first, as the vectoriser does)."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(TERM_PATTERN), 0)


def token_count(col) -> Column:
    """Offline token estimate."""
    return F.regexp_count(_c(col), F.lit(TOKEN_PATTERN)).cast("bigint")


def truncate_tokens(col, max_tokens) -> Column:
    """Keep the first ``max_tokens`` tokens; unchanged when within budget (C4)."""
    col = _c(col)
    n = max_tokens if isinstance(max_tokens, Column) else F.lit(int(max_tokens))
    pieces = F.regexp_extract_all(col, F.lit(PIECE_PATTERN), 0)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(n, F.lit(0))), "")
    return F.when(token_count(col) <= n, col).otherwise(F.when(n > 0, cut).otherwise(F.lit("")))


def quote_regex(literal: str) -> str:
    """Regex matching ``literal`` verbatim (Java ``\\Q..\\E``)."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"
