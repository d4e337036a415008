"""DuckDB SQL fragments for what `textloom.functions` computes (oracle side only).

The fixed values are written out here once more, so that an error in those of the
library shows as a difference."""

from __future__ import annotations

NEVER_SPLIT = ("[UNK]", "[SEP]", "[PAD]", "[CLS]", "[MASK]")
# all ASCII punctuation but the full stop and the comma
_KEEP = "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"

WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]+"
PUNCT = r"[!-/:-@\[-`{-~]|\p{P}"
CJK = (r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}"
       r"\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}]")


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pad(c: str) -> str:
    c = f"translate({c}, {lit(_KEEP)}, {lit(' ' * len(_KEEP))})"
    c = f"replace({c}, '.', ' . ')"
    return f"replace({c}, ',', ' , ')"


def clean_text(col: str) -> str:
    c = f"coalesce({col}, '')"
    c = f"replace({c}, '¥n', '')"
    c = f"translate({c}, '0123456789', '')"
    return _pad(c)


def clean_text_html(col: str) -> str:
    c = f"replace(coalesce({col}, ''), '<br />', '')"
    return _pad(c)


def ws_split(expr: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({expr}, ''), {lit(WS)}), lambda x: x <> '')"


def word_tokens(col: str) -> str:
    return f"list_transform({ws_split(clean_text(col))}, lambda t: lower(t))"


def word_tokens_html(col: str) -> str:
    return f"list_transform({ws_split(clean_text_html(col))}, lambda t: lower(t))"


def clean_unicode(col: str) -> str:
    c = f"regexp_replace(coalesce({col}, ''), '[\\t\\n\\r\\p{{Zs}}]', ' ', 'g')"
    return f"regexp_replace({c}, '[\\x{{0}}\\x{{FFFD}}\\p{{C}}]', '', 'g')"


def cjk_space(expr: str) -> str:
    return f"regexp_replace({expr}, '({CJK})', ' \\1 ', 'g')"


NEVER = "[" + ", ".join(lit(t) for t in NEVER_SPLIT) + "]"


def basic_tokens(col: str) -> str:
    """T10 in DuckDB (strip_accents for T07)."""
    pre = ws_split(cjk_space(clean_unicode(col)))
    low = f"list_transform({pre}, lambda t: CASE WHEN list_contains({NEVER}, t) THEN t ELSE strip_accents(lower(t)) END)"
    split_one = f"list_filter(string_split(regexp_replace(t, '({PUNCT})', ' \\1 ', 'g'), ' '), lambda x: x <> '')"
    per = f"list_transform(list_filter({low}, lambda x: x <> ''), lambda t: CASE WHEN list_contains({NEVER}, t) THEN [t] ELSE {split_one} END)"
    return f"flatten({per})"
