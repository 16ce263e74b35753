"""Named normalisers of questions and SQL texts.

Many rules share a purpose but not a result, so each has a name of its own.  White
space is Unicode white space throughout, written as an explicit class, because the
regex engines disagree on ``\\s``.  Case folding and NFKC have no Spark function and
are Arrow-batched Python; everything else stays in the JVM.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Unicode white space as a class that Java and RE2 both read.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Tokens of the evaluation tokenizer.
EVAL_TOKEN = r"""'[^']*'|"[^"]*"|[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d+)?|<=|>=|<>|!=|==|[-+*/(),.;=<>]"""
#: Tokens of the taxonomy tokenizer, comments first so that they can be dropped; a dot is any character.
TAXONOMY_TOKEN = (
    r"(?s)--[^\n]*|/\*.*?\*/|'(?:''|[^'])*'|\"(?:\"\"|[^\"])*\"|`[^`]*`|\[[^\]]*\]|"
    r"<=|>=|<>|!=|==|\|\||[-+*/%<>=]|[A-Za-z_][A-Za-z0-9_$]*|\d+(?:\.\d+)?|[(),.;]"
)
#: Quoted literals, doubled quotes included.
LITERAL = r"""'(?:''|[^'])*'|"(?:""|[^"])*\""""


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def ensure_semicolon(sql: Column) -> Column:
    """Stripped, with a closing semicolon unless empty."""
    s = strip(sql)
    return F.when((s == "") | s.endswith(";"), s).otherwise(F.concat(s, F.lit(";")))


def drop_semicolons(sql: Column) -> Column:
    """Without closing semicolons and white space after them."""
    return F.regexp_replace(strip(sql), f";+{SPACE}*$", "")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Unicode case folding."""
    return text.str.casefold()


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def norm_q_lower(text: Column) -> Column:
    """Lower case, white space collapsed."""
    return collapse(F.lower(text))


def norm_q_casefold(text: Column) -> Column:
    """Case folded, white space collapsed."""
    return collapse(casefold(text))


def norm_q_nfkc(text: Column) -> Column:
    """NFKC, case folded, punctuation, symbols and separators as spaces, collapsed."""
    return collapse(F.regexp_replace(casefold(nfkc(text)), r"[\p{P}\p{S}\p{Z}]", " "))


def norm_q_words(text: Column) -> Column:
    """NFKC, case folded, everything but letters, digits and underscores as spaces, collapsed."""
    return collapse(F.regexp_replace(casefold(nfkc(text)), r"[^\p{L}\p{N}_]+", " "))


def norm_sql_semi(sql: Column) -> Column:
    """Closing semicolon ensured, lower case, collapsed."""
    return collapse(F.lower(ensure_semicolon(sql)))


def norm_sql_semi_cf(sql: Column) -> Column:
    """Closing semicolon ensured, case folded, collapsed."""
    return collapse(casefold(ensure_semicolon(sql)))


def norm_sql_nosemi(sql: Column) -> Column:
    """Lower case without closing semicolons, collapsed."""
    return collapse(drop_semicolons(F.lower(sql)))


def norm_sql_nosemi_cf(sql: Column) -> Column:
    """Case folded without closing semicolons, collapsed."""
    return collapse(drop_semicolons(casefold(sql)))


def norm_sql_rstrip_semi(sql: Column) -> Column:
    """Exactly one semicolon in place of any at the very end, lower case, collapsed."""
    return collapse(F.lower(F.concat(F.regexp_replace(sql, ";+$", ""), F.lit(";"))))


def eval_tokens(sql: Column) -> Column:
    """Lower-case tokens of the evaluation tokenizer."""
    return F.transform(F.regexp_extract_all(sql, F.lit(EVAL_TOKEN), F.lit(0)), F.lower)


def norm_sql_tokens_eval(sql: Column) -> Column:
    """Evaluation tokens joined by spaces."""
    return F.array_join(eval_tokens(sql), " ")


def taxonomy_tokens(sql: Column) -> Column:
    """Tokens of the taxonomy tokenizer without comments."""
    found = F.regexp_extract_all(sql, F.lit(TAXONOMY_TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~(t.startswith("--") | t.startswith("/*")))


def norm_sql_taxonomy(sql: Column) -> Column:
    """Taxonomy tokens without semicolons, lower case, joined by spaces."""
    kept = F.filter(taxonomy_tokens(sql), lambda t: t != ";")
    return F.array_join(F.transform(kept, F.lower), " ")


def blank_literals(sql: Column) -> Column:
    """Quoted literals as one space."""
    return F.regexp_replace(sql, LITERAL, " ")


def empty_literals(sql: Column) -> Column:
    """Quoted literals as an empty literal."""
    return F.regexp_replace(sql, LITERAL, "''")
