"""Imports and SDK clients of script and class languages, by their tokens.

A text is read once from left to right by one pattern whose branches are the language's tokens that may hide code (comments,
texts, templates, literals) and the statements that are looked for. Whatever stands inside a comment or a text is passed over with it, and a
statement may go on over any number of lines. In a template of a script language, code in ``${}`` is passed over too.
All are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.tables import dealt
from lodestrata.functions.text import located
from lodestrata.operators.extract import client_service, external_module

_LINE = r"//[^\n]*+"
_BLOCK = r"/\*(?s:.*?)(?:\*/|\z)"
_DOUBLE = r'"[^"\\\n]*+(?:\\(?s:.)[^"\\\n]*+)*+"?'
_SINGLE = r"'[^'\\\n]*+(?:\\(?s:.)[^'\\\n]*+)*+'?"
_TEMPLATE = r"`[^`\\]*+(?:\\(?s:.)[^`\\]*+)*+`?"
#: A regular expression, where a value is expected.
_LITERAL = r"(?<=[=(,:\[!&|?;{}])[ \t]*+/(?![*/])[^/\\\n\[]*+(?:(?:\\.|\[(?:[^\]\\\n]|\\.)*+\])[^/\\\n\[]*+)*+/[a-z]*+"
_VERBATIM = r'[$@]{0,2}@[$]?"[^"]*+(?:""[^"]*+)*+"?'
_TEXT_BLOCK = r'"""(?s:.*?)(?:"""|\z)'
#: What may stand between import and from. All repetitions are possessive, so none nests with the length of a text.
_NAMES = rf"(?:[^'\"`;()/f]++|f(?!rom\s*+['\"])|{_LINE}|{_BLOCK})*+"
_START, _DOTTED = r"(?<![\w$.])", r"[\w$.]*"

#: By language: tokens that are passed over, and statements by kind with one group, the value. Values are taken as they are written.
TOKENS = {
    "script": (
        (_LINE, _BLOCK, _LITERAL),
        (
            ("import", rf"{_START}import(?![\w$.]|\s*+\()\s*+(?:{_NAMES}from\s*+)?['\"]([^'\"\n]++)['\"]"),
            ("import", rf"{_START}require\s*+\(\s*+['\"]([^'\"\n]++)['\"]"),
            ("new", rf"{_START}new\s++({_DOTTED}Client)(?![\w$.])"),
        ),
        (_DOUBLE, _SINGLE, _TEMPLATE),
    ),
    "java": (
        (_LINE, _BLOCK, _TEXT_BLOCK, _DOUBLE, _SINGLE),
        (
            ("import", rf"{_START}import\s++(?:static\s++)?([\w.*]++)\s*+;"),
            ("builder", rf"{_START}({_DOTTED}Client)\s*+\.\s*+builder\s*+\("),
            ("new", rf"{_START}new\s++({_DOTTED}Client)(?=\s*+\()"),
        ),
        (),
    ),
    "csharp": (
        (_LINE, _BLOCK, _VERBATIM, r"\$?" + _DOUBLE, _SINGLE),
        (
            ("import", rf"{_START}using\s++(?:static\s++)?([\w.]++)\s*+(?:=[^;()]*+)?;"),
            ("new", rf"{_START}new\s++(Amazon{_DOTTED}Client)(?=\s*+[({{])"),
        ),
        (),
    ),
}


def sdk_calls(files: DataFrame, language: str) -> DataFrame:
    """(path, line_no, kind, value, service, is_external) of imports and client constructions in node, typescript, java or csharp texts (path, text).

    ``kind`` is import, builder (``XClient.builder()``) or new; ``line_no`` is the line on which the statement begins.
    """
    before, statements, after = TOKENS.get(language, TOKENS["script"])
    pattern = "|".join([*before, *(p for _, p in statements), *after])
    found = located(dealt(files.select("path", "text"), "path"), pattern, {f"v{i}": i + 1 for i in range(len(statements))})
    kind = F.coalesce(*(F.when(F.col(f"v{i}") != "", k) for i, (k, _) in enumerate(statements)))
    value = F.coalesce(*(F.nullif(f"v{i}", F.lit("")) for i in range(len(statements))))
    f = found.select("path", "line_no", kind.alias("kind"), value.alias("value")).where("kind is not null")
    is_import = F.col("kind") == "import"
    return f.select("path", "line_no", "kind", "value", F.when(~is_import, client_service(F.col("value"))).alias("service"), F.when(is_import, external_module(F.col("value"), language)).alias("is_external"))
