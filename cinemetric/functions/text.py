"""Text column functions (all JVM-side expressions, no Python UDFs).

Every function takes and returns ``Column`` so it composes inside
``select``/``withColumn`` and stays inside whole-stage code generation
where Spark allows it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference behaviour)
# ---------------------------------------------------------------------------
# Word-count thresholds: more than 8 words is a sentence, more than 1 a multiword.
SENTENCE_MIN_WORDS = 8
MULTIWORD_MIN_WORDS = 1
# Route names written to the Model_Used column.
ROUTE_SENTENCE = "Sentence"
ROUTE_MULTIWORD = "Multiword"
ROUTE_SINGLE = "Single-word"
# clean_translation: characters stripped from split parts, then from the result.
PART_STRIP_CHARS = ".,;"
FINAL_STRIP_CHARS = ".,;:-–—()[]{}"
# clean_translation: separators applied in this order (the last one is a raw substring).
JOIN_SEPARATORS = [",", "–", "-"]
SPLIT_WORD = "and"
# clean_translation: raw substrings removed, in this order.
REMOVED_SUBSTRINGS = ["the ", " the", "a ", " a", "an ", " an", "to ", " to"]
# Token pattern: contractions, letter runs, single digits, other non-space runs.
TOKEN_PATTERN = r"(?i)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Placeholder replaced by the class name in prompt templates.
TEMPLATE_SLOT = "{}"

_WS = r"(?U)\s+"
# the characters that (?U)\s matches (Unicode White_Space)
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """``str.strip()``: remove leading/trailing Unicode whitespace.
    (Spark's ``trim`` removes only the space character.)  Only the ends are
    looked at, a pattern would search the whole text."""
    return F.btrim(_col(c), F.lit(_SPACES))


def _char_class(chars: str) -> str:
    return "[" + "".join("\\" + ch if ch in r"\^-[]" else ch for ch in chars) + "]"


def strip_chars(c, chars: str) -> Column:
    """``str.strip(chars)``: remove the given characters from both ends."""
    return F.btrim(_col(c), F.lit(chars))


def words(c) -> Column:
    """``str.split()`` with no argument: split on whitespace runs, no empties
    (an empty or blank string gives an empty array)."""
    t = py_strip(c)
    return F.when(t == F.lit(""), F.array().cast("array<string>")).otherwise(F.split(t, _WS))


def n_words(c) -> Column:
    return F.size(words(c))


def is_sentence(c) -> Column:
    return n_words(c) > SENTENCE_MIN_WORDS


def is_multiword(c) -> Column:
    return n_words(c) > MULTIWORD_MIN_WORDS


def route_of_count(n: Column) -> Column:
    """Route name from a word count; a sentence is tested first (it is also multiword)."""
    return (F.when(n > SENTENCE_MIN_WORDS, F.lit(ROUTE_SENTENCE))
            .when(n > MULTIWORD_MIN_WORDS, F.lit(ROUTE_MULTIWORD))
            .otherwise(F.lit(ROUTE_SINGLE)))


def model_used(c) -> Column:
    """Route name of a text."""
    return route_of_count(n_words(c))


def before_ellipsis(c) -> Column:
    """Text before the first ``...`` (the whole text when there is none)."""
    return F.substring_index(_col(c), "...", 1)


def _first_nonempty_stripped(parts: Column) -> Column:
    stripped = F.filter(F.transform(parts, lambda p: py_strip(p)), lambda p: p != F.lit(""))
    return F.try_element_at(stripped, F.lit(1))


def clean_translation(c, whole_words: bool = False) -> Column:
    """Post-edit a translated expression.

    Steps, in order: first non-empty part around ``...``; parts around ``,``,
    ``–``, ``-`` re-joined by a space; first non-empty part around the raw
    substring ``and`` after stripping ``.,;``; lower case; removal of the
    article / particle substrings; strip of punctuation then whitespace.
    ``whole_words=True`` applies the last removals on word boundaries only
    (sane variant; the default is the faithful raw-substring behaviour).
    """
    t = _col(c)
    has_ellipsis = t.contains("...")
    first_part = _first_nonempty_stripped(F.split(t, r"\.\.\."))
    t = F.when(has_ellipsis & first_part.isNotNull(), first_part).otherwise(t)
    def join_separators(x):
        # split on each separator, strip every part, re-join with one space ==
        # replace the separator and its surrounding whitespace by one space
        for sep in JOIN_SEPARATORS:
            x = py_strip(F.regexp_replace(x, rf"(?U)\s*{_char_class(sep)}\s*", " "))
        return x

    # Then the first part around the raw substring "and" that is not empty
    # after strip() + strip(".,;").  Separators never create or break an
    # "and", so the parts can be found on the text before the separators are
    # joined: a part is empty iff it is separators/whitespace around a run of
    # "." / ";" only.  One anchored regex skips the empty parts and takes the
    # next one, so only that (short) part goes through the remaining steps.
    sep_ws = "[\\s" + "".join("\\" + c if c in "-" else c for c in JOIN_SEPARATORS) + "]*"
    skip = rf"(?:{sep_ws}[.;]*{sep_ws}{SPLIT_WORD})*"
    head = F.regexp_extract(t, rf"(?sU)^{skip}(.*?)(?:{SPLIT_WORD}|\z)", 1)
    first = strip_chars(py_strip(join_separators(head)), PART_STRIP_CHARS)
    t = F.lower(F.when(first != F.lit(""), first).otherwise(join_separators(t)))
    if whole_words:
        for word in ["the", "a", "an", "to"]:
            t = F.regexp_replace(t, rf"(?U)\b{word}\b\s?", "")
    else:
        for sub in REMOVED_SUBSTRINGS:
            t = F.replace(t, F.lit(sub), F.lit(""))
    return py_strip(strip_chars(t, FINAL_STRIP_CHARS))


def translation_audit(cleaned, original) -> Column:
    """Warning class of a translation: empty, untranslated, long, or null."""
    cl, orig = _col(cleaned), _col(original)
    return (F.when(py_strip(cl) == F.lit(""), F.lit("empty"))
            .when(F.lower(cl) == F.lower(orig), F.lit("untranslated"))
            .when(cl.rlike(r"(?U)^\s*+(?:\S++\s++){3}\S"), F.lit("long")))      # more than three words


def normalize_whitespace(c) -> Column:
    """Collapse whitespace runs, trim, lower (tokeniser pre-clean)."""
    return F.lower(py_strip(F.regexp_replace(_col(c), _WS, " ")))


def tokens(c, specials: tuple[str, ...] = ()) -> Column:
    """Tokeniser split: special tokens (kept whole), contractions, letter runs,
    single digits, other runs."""
    whole = "".join(f"\\Q{t}\\E|" for t in specials)
    return F.regexp_extract_all(_col(c), F.lit(TOKEN_PATTERN.replace("(?i)", f"(?i){whole}", 1)), 0)


def _fixed_point(x: Column, decimals: int) -> Column:
    """A finite double with ``decimals`` places, rounded half-even on its exact
    binary value.  The fraction times 2**52 is exact (and whole from |x| = 1
    on), so the remainder of an integer division by 2**52 decides."""
    unit, ten = 1 << 52, 10 ** decimals
    whole = F.floor(F.abs(x))
    scaled = (F.abs(x) - whole) * F.lit(float(unit))
    n = F.floor(scaled)
    more = F.floor((scaled - n) * ten)                  # bits below 2**-52, only for |x| < 1
    total = n * ten + more
    q = F.shiftright(total, 52)
    rest = total - F.shiftleft(q, 52)
    beyond = (scaled - n) * ten > more
    up = (rest > unit // 2) | ((rest == unit // 2) & (beyond | (q % 2 == 1)))
    v = whole * ten + q + F.when(up, F.lit(1)).otherwise(F.lit(0))
    digits = F.concat(((v - v % ten) / F.lit(ten)).cast("bigint").cast("string"), F.lit("."), F.lpad((v % ten).cast("string"), decimals, "0"))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), digits)


def format_scores(c, decimals: int = 2, sep: str = ";") -> Column:
    """Array of doubles as ``%.2f`` values joined by ``;``, rounded as Python
    does (half-even on the binary value); 1 to 3 decimals."""
    if not 1 <= decimals <= 3:
        raise ValueError("format_scores takes 1 to 3 decimals")
    ten = 10 ** decimals

    def one(x: Column) -> Column:
        # a decimal cast rounds the shortest decimal form half-up, which can
        # differ from the binary value only next to a tie
        size = F.abs(x).cast(f"decimal(20,{decimals})").cast("string")
        near_tie = F.abs(F.pmod(F.abs(x) * ten, F.lit(1.0)) - 0.5) < 1e-4
        return (F.when(F.isnan(x) | (F.abs(x) > 1e12), F.format_string(f"%.{decimals}f", x))
                .when(near_tie, _fixed_point(x, decimals))
                .when(x < 0, F.concat(F.lit("-"), size)).otherwise(size))

    return F.array_join(F.transform(_col(c), one), sep)


def fill_template(template, name) -> Column:
    """Replace the ``{}`` slot of a prompt template by a class name."""
    return F.replace(_col(template), F.lit(TEMPLATE_SLOT), _col(name))
