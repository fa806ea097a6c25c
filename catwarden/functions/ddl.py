"""DDL text expressions: PSQL bodies, index expressions, field compatibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quote-aware comment stripping. Possessive quantifiers keep a
# multi-megabyte literal from backtracking the JVM regex engine; a string
# that never closes runs to the end of the text, like an open block comment.
STRIP_COMMENTS = r"('[^']*+(?:''[^']*+)*+(?:'|\z))|--[^\r\n]*|/\*[\s\S]*?(?:\*/|\z)"
BODY = r"(?is)\bBEGIN\b(.*)\bEND\b"

# Index items that make an entry an expression, not a column.
SIMPLE_IDENT = r"(?i)^[A-Z_][A-Z0-9_$]*$"
EXPR_OPERATOR = r"(?:\s[+\-*/]\s|\|\||<>|<=|>=|=|<|>)"
EXPR_KEYWORD = r"(?i)\b(?:CASE|WHEN|THEN|ELSE|END|FROM|AS|IS|NULL|NOT|AND|OR)\b"

# Field compatibility limits and minimum server versions.
TEXT_BYTES_LIMIT = 32765
TEXT_TYPE = r"^(CHAR|VARCHAR)\s*\(\s*(\d+)\s*\)"
FIXED_NUMBER = r"^(NUMERIC|DECIMAL)\s*\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?\)"
TYPE_MIN_MAJOR = {
    "BOOLEAN": 3,
    "DECFLOAT(16)": 4,
    "DECFLOAT(34)": 4,
    "INT128": 4,
    "TIME WITH TIME ZONE": 4,
    "TIMESTAMP WITH TIME ZONE": 4,
}


def strip_sql_comments(src: Column) -> Column:
    return F.regexp_replace(src, STRIP_COMMENTS, "$1")


def psql_body(src: Column) -> Column:
    """text between the first BEGIN and the last END after comments are
    removed (strings kept); NULL when there is no such pair."""
    clean = strip_sql_comments(F.coalesce(src, F.lit("")))
    return F.when(clean.rlike(BODY), F.regexp_extract(clean, BODY, 1))


def has_executable(src: Column) -> Column:
    body = psql_body(src)
    return body.isNotNull() & body.rlike(r"[^\s;]")


def normalized_body(src: Column) -> Column:
    return F.upper(F.regexp_replace(psql_body(src), r"[\s;]", ""))


def is_index_expression(item: Column) -> Column:
    v = F.trim(item)
    return (~v.rlike(SIMPLE_IDENT)) | v.rlike(r"[()']") | v.rlike(EXPR_OPERATOR) | v.rlike(EXPR_KEYWORD)


def field_compat(sql_type: Column, bytes_per_char: Column, major: Column) -> Column:
    """C01-C05 code for one field, NULL when compatible."""
    t = F.upper(F.trim(sql_type))
    # both patterns begin with a word: most types are told apart without them
    is_text = (t.startswith("CHAR") | t.startswith("VARCHAR")) & t.rlike(TEXT_TYPE)
    text_len = F.regexp_extract(t, TEXT_TYPE, 2).try_cast("bigint")
    bpc = F.greatest(F.lit(1), F.coalesce(bytes_per_char.cast("bigint"), F.lit(1)))
    is_num = (t.startswith("NUMERIC") | t.startswith("DECIMAL")) & t.rlike(FIXED_NUMBER)
    prec = F.regexp_extract(t, FIXED_NUMBER, 2).try_cast("bigint")
    scale_txt = F.regexp_extract(t, FIXED_NUMBER, 3)
    scale = F.when(scale_txt == "", F.lit(0)).otherwise(scale_txt.try_cast("bigint"))
    min_major = None
    for name, v in TYPE_MIN_MAJOR.items():
        min_major = (F.when(t == name, F.lit(v)) if min_major is None
                     else min_major.when(t == name, F.lit(v)))
    return (F.when(sql_type.isNull() | (F.trim(sql_type) == ""), F.lit("CAMPO_TIPO_VAZIO"))
             .when(is_text, F.when(text_len * bpc > TEXT_BYTES_LIMIT, F.lit("CAMPO_TAMANHO_EFETIVO_EXCEDIDO")))
             .when(is_num,
                   F.when((prec < 1) | (prec > 38) | (scale < 0) | (scale > prec),
                          F.lit("CAMPO_PRECISAO_NUMERICA_INVALIDA"))
                    .when(major.isNotNull() & (major < 4) & (prec > 18),
                          F.lit("CAMPO_PRECISAO_NUMERICA_INCOMPATIVEL")))
             .when(min_major.isNotNull() & major.isNotNull() & (major < min_major),
                   F.lit("CAMPO_TIPO_INCOMPATIVEL_VERSAO")))


def scope_table(scope: Column) -> Column:
    """text before the first '.', '?' when blank."""
    return F.when(F.trim(F.coalesce(scope, F.lit(""))) == "", F.lit("?")) \
            .otherwise(F.substring_index(scope, ".", 1))
