"""Column -> Column text functions (cleaning and tokenising), all JVM-side.

Every function takes and returns a `Column`, so it composes inside one
projection and stays in whole-stage codegen: whole-string regexp / translate /
lower followed by one split, no per-token lambda (higher-order functions are
evaluated interpreted, per element).  The only Python step of the text path, the
accent stripper, lives in `textloom.functions.accents`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical tokens.
# ASCII punctuation as in Python's `string.punctuation`:
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Tokens the basic tokenizer never lower-cases or splits:
NEVER_SPLIT = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
# CJK code point ranges padded with spaces by the basic tokenizer:
CJK_RANGES = (
    (0x4E00, 0x9FFF),
    (0x3400, 0x4DBF),
    (0x20000, 0x2A6DF),
    (0x2A700, 0x2B73F),
    (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF),
    (0xF900, 0xFAFF),
    (0x2F800, 0x2FA1F),
)
# The first cleaner removes this literal two-character sequence (a yen sign
# and "n", not a newline):
YEN_NEWLINE = "¥n"
# The second cleaner removes this literal HTML line break:
HTML_BREAK = "<br />"
# ---------------------------------------------------------------------------

# Whitespace as Python's str.split() sees it (Java's \s is ASCII only).
WHITESPACE_CLASS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
# ASCII non-alphanumeric printable characters plus Unicode category P.
PUNCT_CLASS = r"[!-/:-@\[-`{-~]|\p{P}"
CJK_CLASS = "[" + "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in CJK_RANGES) + "]"
CONTROL_CLASS = r"[\x{0}\x{FFFD}\p{C}]"
SPACE_LIKE_CLASS = r"[\t\n\r\p{Zs}]"

_PUNCT_KEEP_DOT_COMMA = "".join(c for c in PUNCTUATION if c not in ".,")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _replace(c: Column, search: str, repl: str) -> Column:
    return F.replace(c, F.lit(search), F.lit(repl))


def _pad_dot_comma(c: Column) -> Column:
    c = F.translate(c, _PUNCT_KEEP_DOT_COMMA, " " * len(_PUNCT_KEEP_DOT_COMMA))
    c = _replace(c, ".", " . ")
    return _replace(c, ",", " , ")


def clean_text(text) -> Column:
    """Drop the literal yen-n, drop digits, other punctuation -> space, pad . and ,"""
    c = F.coalesce(_col(text), F.lit(""))
    c = _replace(c, YEN_NEWLINE, "")
    c = F.translate(c, "0123456789", "")
    return _pad_dot_comma(c)


def clean_text_html(text) -> Column:
    """Drop the literal `<br />`, keep digits, rest as `clean_text`."""
    c = F.coalesce(_col(text), F.lit(""))
    c = _replace(c, HTML_BREAK, "")
    return _pad_dot_comma(c)


def whitespace_split(text) -> Column:
    """Python-style `strip().split()` -> ARRAY<STRING> without empty items.

    Split on runs of whitespace and drop the empty strings a leading or
    trailing run leaves (`array_remove`, no per-element lambda).
    """
    return F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), WHITESPACE_CLASS + "+"), "")


def word_tokens(text, lower: bool = True) -> Column:
    """Clean (T01) + whitespace split (T03) + lower each token.

    Lower-casing is per character, so lowering the cleaned string before the
    split equals lowering every token after it.
    """
    c = clean_text(text)
    return whitespace_split(F.lower(c) if lower else c)


def word_tokens_html(text, lower: bool = True) -> Column:
    """T02 variant of T04, used for markup text."""
    c = clean_text_html(text)
    return whitespace_split(F.lower(c) if lower else c)


def clean_unicode(text) -> Column:
    """Whitespace (tab, newline, CR, Zs) -> space; drop NUL, U+FFFD and category C.

    Mapping whitespace first makes the control class need no exception for
    tab/newline/CR, which is equivalent to the reference's order.
    """
    c = F.regexp_replace(F.coalesce(_col(text), F.lit("")), SPACE_LIKE_CLASS, " ")
    return F.regexp_replace(c, CONTROL_CLASS, "")


def cjk_space(text) -> Column:
    """Put a space on both sides of every CJK ideograph."""
    return F.regexp_replace(_col(text), "(" + CJK_CLASS + ")", " $1 ")


def _sentinel(i: int) -> str:
    # private-use code points are category Co, removed by `clean_unicode`, so they
    # cannot occur in cleaned text; digits survive lower-casing and NFD unchanged
    return f"\uE000{i}\uE001"


def basic_protect(text) -> Column:
    """T05 -> T06, then every whole token that is a never-split special replaced by a
    sentinel (T09), so whole-string lower-casing, accent stripping and punctuation
    splitting leave it alone.  Only texts holding a `[` run the special patterns."""
    c = cjk_space(clean_unicode(text))
    protected = c
    for i, tok in enumerate(NEVER_SPLIT):
        body = "".join("\\" + ch if not ch.isalnum() else ch for ch in tok)
        pattern = f"(?<=^|{WHITESPACE_CLASS}){body}(?={WHITESPACE_CLASS}|$)"
        protected = F.regexp_replace(protected, pattern, _sentinel(i))
    return F.when(F.instr(c, "[") > 0, protected).otherwise(c)


def basic_finish(c: Column) -> Column:
    """T08 on the whole string, restore the specials, final T03 split."""
    c = F.regexp_replace(c, "(" + PUNCT_CLASS + ")", " $1 ")
    restored = c
    for i, tok in enumerate(NEVER_SPLIT):
        restored = _replace(restored, _sentinel(i), tok)
    return whitespace_split(F.when(F.instr(c, "\uE000") > 0, restored).otherwise(c))
