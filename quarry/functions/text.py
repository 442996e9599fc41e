"""PHP-compatible text semantics as native Spark Column expressions.

Every function here returns a Column built from built-in functions, so row work
stays JVM-side inside whole-stage codegen. The regular expressions are shared
with the DuckDB oracle (``quarry.plans.duck``) through the module constants.
"""

from __future__ import annotations

import html.entities
import json
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import INVISIBLE_TO_SPACE, PHP_TRIM_CHARS

MAX_LONG = 9223372036854775807
MIN_LONG = -MAX_LONG - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# ---------------------------------------------------------------------------
# Regular expressions (Java and RE2 accept the same text for all of these).
# ---------------------------------------------------------------------------
INVISIBLE_RE = "[" + "".join("\\x{%04X}" % ord(c) for c in INVISIBLE_TO_SPACE) + "]"
CONTROL_RE = r"\p{C}+"
SPACE_RUN_RE = r"\p{Z}+"
PHP_TRIM_RE = r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+\z"
NUMERIC_RE = (r"^[ \t\n\r\x0B\f]*[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
              r"[ \t\n\r\x0B\f]*$")
LEADING_NUMBER_RE = r"^[ \t\n\r\x0B\f]*([+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?)"
LEADING_INT_RE = r"^[ \t\n\r\x0B\f]*([+-]?[0-9]+)"
TAG_RE = r"<[^>]*>"
SCRIPT_STYLE_RE = r"(?is)<script\b[^>]*>.*?</script[^>]*>|<style\b[^>]*>.*?</style[^>]*>"
EVENT_ATTR_RE = r"""(?i)[ \t\n\r\f]+on[a-z]+[ \t\n\r\f]*=[ \t\n\r\f]*("[^"]*"|'[^']*'|[^ \t\n\r\f>]+)"""
TEXT_FIELD_SPACE_RE = r"[\r\n\t ]+"
PERCENT_OCTET_RE = r"%[a-fA-F0-9]{2}"


def _entity_groups() -> tuple[list[str], list[str]]:
    """Named HTML5 entities (with ';') whose text is wholly invisible.

    Derived by rule from the HTML5 entity table in the Python standard library:
    entities decoding only to spaces / listed invisible characters become one
    space; entities decoding only to other control/format characters vanish.
    Any other entity decodes to a visible character, which never changes an
    emptiness test, so it is left as text.
    """
    spaces, gone = [], []
    for name, text in sorted(html.entities.html5.items()):
        if not name.endswith(";") or not text:
            continue
        cats = [unicodedata.category(ch) for ch in text]
        if all(ch in INVISIBLE_TO_SPACE or cat.startswith("Z") for ch, cat in zip(text, cats)):
            spaces.append(name[:-1])
        elif all(cat.startswith("C") and ch not in INVISIBLE_TO_SPACE for ch, cat in zip(text, cats)):
            gone.append(name[:-1])
    return spaces, gone


def _numeric_groups() -> tuple[list[int], list[int]]:
    """BMP code points that HTML5 decoding turns into invisible characters.

    HTML5 decoding refuses most C0/C1 controls, CR among them; it accepts tab, LF and FF.
    """
    spaces, gone = [], []
    for cp in range(0x10000):
        ch = chr(cp)
        cat = unicodedata.category(ch)
        allowed = (0x20 <= cp <= 0x7E or cp in (0x09, 0x0A, 0x0C)
                   or (0xA0 <= cp <= 0xD7FF) or (0xE000 <= cp <= 0xFFFD and not 0xFDD0 <= cp <= 0xFDEF))
        if not allowed:
            continue
        if ch in INVISIBLE_TO_SPACE or cat.startswith("Z"):
            spaces.append(cp)
        elif cat in ("Cc", "Cf"):
            gone.append(cp)
    return spaces, gone


def _entity_regex(names: list[str], cps: list[int], more_dec: str = "", more_hex: str = "") -> str:
    dec = "|".join(str(c) for c in cps) + more_dec
    hexa = "|".join(("%x" % c) + "|" + ("%X" % c) for c in cps) + more_hex
    named = "|".join(names)
    return f"&(?:(?:{named});|#0*(?:{dec});|#[xX]0*(?:{hexa});)"


_SP_NAMES, _GONE_NAMES = _entity_groups()
_SP_CPS, _GONE_CPS = _numeric_groups()
ENTITY_SPACE_RE = _entity_regex(_SP_NAMES, _SP_CPS)
# the private-use area of the basic plane, E000 to F8FF, goes as well
ENTITY_GONE_RE = _entity_regex(
    _GONE_NAMES, _GONE_CPS, "|573(?:4[4-9]|[5-9][0-9])|57[4-9][0-9]{2}|5[89][0-9]{3}|6[0-2][0-9]{3}|63[0-6][0-9]{2}"
    "|637(?:[0-3][0-9]|4[0-3])", "|[eE][0-9a-fA-F]{3}|[fF][0-8][0-9a-fA-F]{2}")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------------------
# F01 / F02 / F03 / F24
# ---------------------------------------------------------------------------
def php_trim(c) -> Column:
    """PHP ``trim``: strips space, tab, LF, CR, NUL, VT at both ends only."""
    return F.trim(_c(c), F.lit(PHP_TRIM_CHARS))


def ascii_lower(c) -> Column:
    """PHP 8 ``strtolower``: ASCII letters only."""
    return F.translate(_c(c), UPPER, LOWER)


def entity_table() -> dict[str, str]:
    """All named HTML5 entities that end with a semicolon (of the standard library)."""
    return {name[:-1]: text for name, text in html.entities.html5.items() if name.endswith(";")}


def entity_map() -> Column:
    """The table as a constant: first character -> name -> text, so a look-up is short."""
    first: dict[str, dict[str, str]] = {}
    for name, text in sorted(entity_table().items()):
        first.setdefault(name[0], {})[name] = text
    return F.from_json(F.lit(json.dumps(first)), "map<string,map<string,string>>")


#: What may follow an ampersand: a number or a name, and a semicolon.
REFERENCE_RE = r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"


def code_point(ref: Column) -> Column:
    """The character of ``#233`` or ``#xE9``; null where HTML5 refuses it."""
    hexa = ref.rlike("^#[xX]")
    digits = F.regexp_replace(ref, "^#[xX]?0*", "")
    # more digits than any character has are out of range
    n = F.when(F.length(digits).between(1, 7), F.when(hexa, F.conv(digits, 16, 10)).otherwise(digits).try_cast("long"))
    low = n.bitwiseAND(0xFFFF)
    allowed = (n.between(0x20, 0x7E) | n.isin(9, 10, 12) | n.between(0xA0, 0xD7FF)
               | (n.between(0xE000, 0x10FFFF) & ~n.between(0xFDD0, 0xFDEF) & (low < 0xFFFE)))
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    # a leading U+FEFF would be taken as a byte order mark
    return F.when(allowed, F.when(n == 0xFEFF, F.lit("\ufeff")).otherwise(char))


def decode_entities(c) -> Column:
    """every HTML5 entity with a semicolon and every allowed number, in one pass.

    The text is cut at ampersands; what follows one is looked up and put back as it was if
    it is no entity. Text without an ampersand is returned as it is.
    """
    c = _c(c)
    named = entity_map()

    def put(x):
        ref, rest = x["ref"], F.substring(x["part"], F.length(x["ref"]) + 2, F.length(x["part"]))
        text = F.when(ref.startswith("#"), code_point(ref)).otherwise(F.try_element_at(
            F.try_element_at(named, F.substring(ref, 1, 1)), ref))
        return F.when(x["at"] == 0, x["part"]).otherwise(F.coalesce(
            F.when(ref != "", F.concat(text, rest)), F.concat(F.lit("&"), x["part"])))

    parts = F.transform(F.split(c, "&", -1), lambda p, i: F.struct(
        p.alias("part"), F.regexp_extract(p, REFERENCE_RE, 1).alias("ref"), i.alias("at")))
    return F.when(c.contains("&"), F.array_join(F.transform(parts, put), "")).otherwise(c)


def normalize_text(c) -> Column:
    """entity decode, invisible -> space, drop controls, collapse spaces, trim."""
    c = decode_entities(F.coalesce(_c(c).cast("string"), F.lit("")))
    c = F.regexp_replace(c, INVISIBLE_RE, " ")
    c = F.regexp_replace(c, CONTROL_RE, "")
    c = F.regexp_replace(c, SPACE_RUN_RE, " ")
    return php_trim(c)


# ---------------------------------------------------------------------------
# F29 and PHP number parsing
# ---------------------------------------------------------------------------
def is_numeric(c) -> Column:
    """PHP 8 ``is_numeric`` on strings (NULL -> false)."""
    return F.coalesce(_c(c).rlike(NUMERIC_RE), F.lit(False))


def php_floatval(c) -> Column:
    """``floatval``: leading numeric prefix as double, else 0."""
    lead = F.regexp_extract(F.coalesce(_c(c), F.lit("")), LEADING_NUMBER_RE, 1)
    return F.coalesce(lead.try_cast("double"), F.lit(0.0))


def php_intval(c) -> Column:
    """``intval`` on strings: leading integer as BIGINT, saturating at the 64-bit bounds; a
    number with a fraction or exponent goes through double (0 beyond the 64-bit range)."""
    c = F.coalesce(_c(c), F.lit(""))
    lead = F.regexp_extract(c, LEADING_NUMBER_RE, 1)
    whole = F.regexp_extract(c, LEADING_INT_RE, 1)
    d = F.coalesce(lead.try_cast("double"), F.lit(0.0))
    exact = (F.when(whole == "", F.lit(0))
             .otherwise(F.coalesce(whole.try_cast("long"),
                                   F.when(whole.startswith("-"), F.lit(MIN_LONG)).otherwise(F.lit(MAX_LONG)))))
    return F.when(lead.rlike("[.eE]"), F.coalesce(d.try_cast("long"), F.lit(0))).otherwise(exact).cast("long")


# ---------------------------------------------------------------------------
# F25 / F26 (our definitions; the WordPress bodies are not in the reference)
# ---------------------------------------------------------------------------
def strip_all_tags(c, remove_breaks: bool = False) -> Column:
    """Drop script/style blocks with their content, then every tag."""
    c = F.regexp_replace(F.regexp_replace(_c(c), SCRIPT_STYLE_RE, ""), TAG_RE, "")
    if remove_breaks:
        c = F.regexp_replace(c, TEXT_FIELD_SPACE_RE, " ")
    return php_trim(c)


SANITIZE_SLOW_RE = r"[<%\r\n\t]|  "


def sanitize_text_field_fast(c) -> Column:
    """``sanitize_text_field`` for a cheap input expression (e.g. a lambda variable):
    text without '<', '%', CR, LF, tab or a double space only needs the trim."""
    c = F.coalesce(_c(c), F.lit(""))
    return F.when(c.rlike(SANITIZE_SLOW_RE), sanitize_text_field(c)).otherwise(php_trim(c))


def has_visible_text(c) -> Column:
    """``normalize_text(c) != ''`` without the entity table: a reference is either one of
    the invisible ones, which go, or it leaves a visible character, decoded or not. (Only
    numbers of unassigned and supplementary private code points count as visible here.)
    Without '&' an ASCII letter or digit always survives."""
    c = F.coalesce(_c(c), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(c, ENTITY_SPACE_RE, " "), ENTITY_GONE_RE, "")
    for pattern, by in ((INVISIBLE_RE, " "), (CONTROL_RE, ""), (SPACE_RUN_RE, " ")):
        rest = F.regexp_replace(rest, pattern, by)
    return (~c.contains("&") & c.rlike("[0-9A-Za-z]")) | (php_trim(rest) != F.lit(""))


def sanitize_text_field(c) -> Column:
    """Tags stripped, whitespace runs -> one space, trim, percent-encoded octets removed
    (three passes) and spaces squeezed again.

    Written as one linear chain (no branch copies the input): stripping tags from text
    without '<', or squeezing text without octets, changes nothing.
    """
    c = F.coalesce(_c(c), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, SCRIPT_STYLE_RE, ""), TAG_RE, "")
    c = F.regexp_replace(c, TEXT_FIELD_SPACE_RE, " ")
    for _ in range(3):
        c = F.regexp_replace(c, PERCENT_OCTET_RE, "")
    return php_trim(F.regexp_replace(c, " +", " "))


def kses_post(c) -> Column:
    """Rich text kept, script/style blocks and on*= handlers removed."""
    c = F.coalesce(_c(c), F.lit(""))
    return F.regexp_replace(F.regexp_replace(c, SCRIPT_STYLE_RE, ""), EVENT_ATTR_RE, "")


# ---------------------------------------------------------------------------
# F22 / F23 helpers
# ---------------------------------------------------------------------------
UTF8_2_RE = r"[\x{80}-\x{7FF}]"
UTF8_3_RE = r"[\x{800}-\x{FFFF}]"
UTF8_4_RE = r"[\x{10000}-\x{10FFFF}]"


def byte_sample(c, n_bytes: int) -> Column:
    """Text whose characters stand for the first ``n_bytes`` UTF-8 bytes of ``c``:
    each non-ASCII character is widened to as many placeholder characters as it has
    bytes, so ASCII delimiter counts match a byte-prefix sample."""
    s = F.substring(F.coalesce(_c(c), F.lit("")), 1, n_bytes)
    s = F.regexp_replace(s, UTF8_4_RE, "\x01\x01\x01\x01")
    s = F.regexp_replace(s, UTF8_3_RE, "\x01\x01\x01")
    s = F.regexp_replace(s, UTF8_2_RE, "\x01\x01")
    return F.substring(s, 1, n_bytes)


def count_char(c, ch: str) -> Column:
    c = _c(c)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("long")


def detect_delimiter(c, n_bytes: int = 4096) -> Column:
    """tab if more tabs than max(commas, semicolons); else ';' if more than
    commas; else ','. Counted over the first ``n_bytes`` bytes."""
    s = byte_sample(c, n_bytes)
    comma, semi, tab = count_char(s, ","), count_char(s, ";"), count_char(s, "\t")
    return (F.when(tab > F.greatest(comma, semi), F.lit("\t"))
            .when(semi > comma, F.lit(";")).otherwise(F.lit(",")))


def text_like(x: Column) -> Column:
    """Whether a cell holds a letter or text that is no number."""
    t = php_trim(F.coalesce(x, F.lit("")))
    return (t != "") & (t.rlike("[A-Za-z]") | ~is_numeric(t))


def text_like_ratio(cells: Column) -> Column:
    """Share of text-like cells; blank cells count in the denominator only."""
    n_text = F.size(F.filter(cells, text_like))
    return F.when(F.size(cells) > 0, n_text / F.size(cells)).otherwise(F.lit(0.0))
