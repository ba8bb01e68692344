"""Exact Python lexing (the native token expressions in `text` are the default).

The lexer is the standard library's, so its output follows the Python version.
"""

from __future__ import annotations

import io
import re
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed

_LAYOUT = {tokenize.NEWLINE: "<NL>", tokenize.INDENT: "<INDENT>", tokenize.DEDENT: "<DEDENT>",
           tokenize.STRING: "<STR>", tokenize.NUMBER: "<NUM>"}
_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
_SILENT = {tokenize.ENCODING, tokenize.ENDMARKER, tokenize.NL, tokenize.COMMENT}
_NOT_SHOWN = {tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT,
              tokenize.ENCODING, tokenize.COMMENT}


def _lex(code: str) -> list[tokenize.TokenInfo] | None:
    try:
        return list(tokenize.tokenize(io.BytesIO(code.encode("utf-8")).readline))
    except (tokenize.TokenError, SyntaxError, UnicodeError):
        return None


def model_tokens(code: str) -> list[str]:
    found = [_LAYOUT.get(t.type, t.string.strip()) for t in _lex(code) or ()
             if t.type not in _SILENT]
    return [t for t in found if t] or re.findall(r"<[A-Z_]+>|\b\w+\b|[^\s\w]", code)


def shown_tokens(code: str) -> list[str]:
    lexed = _lex(code)
    if lexed is None:
        return re.findall(_IDENTIFIER, code)
    words = (t.string.strip() for t in lexed if t.type not in _NOT_SHOWN)
    return [w for w in words if w and w not in fixed.DISPLAY_PUNCTUATION]



def scorer_tokens(code: str) -> list[str]:
    lexed = _lex(code)
    if lexed is None:
        return re.findall(r"[A-Za-z_][A-Za-z0-9_]*|\d+|[^\s\w]", code)
    words = (t.string.strip() for t in lexed if t.type not in _NOT_SHOWN)
    return [w for w in words if w]


@F.pandas_udf(T.ArrayType(T.StringType()))
def lex_scorer_tokens(code: pd.Series) -> pd.Series:
    return code.map(scorer_tokens, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def lex_model_tokens(code: pd.Series) -> pd.Series:
    return code.map(model_tokens, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def lex_shown_tokens(code: pd.Series) -> pd.Series:
    return code.map(shown_tokens, na_action="ignore")
