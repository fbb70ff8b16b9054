"""Scalar text functions as Columns. Character classes are spelled out, so that other engines agree."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode has it.
WS = r"[\t-\r \x1c-\x1f\x85\p{Z}]"
#: Its members one by one, for functions that take a set of characters.
SPACES = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r \x1c-\x1f\x85\p{Z}]"


def strip(s: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.btrim(s, F.lit(SPACES))


def _normal(s: Column, form: str) -> Column:
    """Unicode normalisation in batches; values of ASCII alone, which it leaves as they are, take no part. (Arrow's own kernel does not compose.)"""

    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unicodedata.normalize(form, v), na_action="ignore")

    plain = F.octet_length(s) == F.length(s)
    return F.when(plain, s).otherwise(F.pandas_udf(run, T.StringType())(F.when(~plain, s)))


def _nfc(s: Column) -> Column:
    return _normal(s, "NFC")


def _ascii_fold(s: Column) -> Column:
    return F.regexp_replace(_normal(F.lower(s), "NFKD"), r"[^\x00-\x7F]", "")


def fold(s: Column, ascii_only: bool = False) -> Column:
    """Lower case, decomposed, ASCII only. With ascii_only the input is known to be ASCII and stays in the JVM."""
    return F.lower(s) if ascii_only else _ascii_fold(s)


def apostrophes(s: Column, composed: bool = False) -> Column:
    """Composed text whose typographic apostrophe and backtick are plain. composed: the input is known to be so."""
    return F.translate(s if composed else _nfc(s), "’`", "''")


def tokens(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(TOKEN), F.lit(0))


def characters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def tag_name(category: Column) -> Column:
    return F.replace(category, F.lit(" "), F.lit("_"))


def marked_entity(s: Column) -> Column:
    """What the first pair of ## encloses, '' without one."""
    return F.regexp_extract(s, r"(?d)##(.*?)##", 1)


def list_options(s: Column) -> Column:
    """Options after the first 'list: '."""
    part = F.get(F.split(s, "list: "), F.lit(1))
    return F.split(F.btrim(part, F.lit("?")), ", ")


def tail(s: Column) -> Column:
    """What follows the last colon, all of it without one."""
    return F.substring_index(s, ":", -1)


def tail_options(s: Column) -> Column:
    """Options after the last colon, stripped."""
    return F.transform(F.split(F.btrim(tail(s), F.lit("?")), ","), strip)


def tail_joined(s: Column, by: str = "|") -> Column:
    """tail_options in one string; lists with one space after each comma and no other around them, as with_options writes them, are not taken apart."""
    t = F.btrim(tail(s), F.lit("?"))
    whole = F.replace(F.trim(t), F.lit(", "), F.lit(by))
    odd = t.rlike("[^ -~]") | t.contains("  ") | t.contains(" ,") | F.contains(whole, F.lit(","))
    return F.when(odd, F.array_join(tail_options(s), by)).otherwise(whole)


def with_options(s: Column, options: Column) -> Column:
    """The message with other options after its last colon."""
    prefix = F.when(F.instr(s, ":") > 0, s.substr(F.lit(1), F.length(s) - F.length(tail(s)))).otherwise(F.lit(""))
    return F.concat(prefix, F.lit(" "), F.array_join(options, ", "), F.lit("?"))


def synonym_form(s: Column) -> Column:
    """Stripped, lower case, single spaces, no dots at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(s)), rf"{WS}+", " "), r"^[.]+|[.]+$", "")


def clean(s: Column) -> Column:
    """Words joined over line ends, lines joined, white space squeezed."""
    joined = F.regexp_replace(F.regexp_replace(s, rf"-\n{WS}*", ""), "\n", " ")
    # a space between two words stays as it is
    return strip(F.regexp_replace(joined, rf"[{WS[1:-1]}&&[^ ]]{WS}*| {WS}+", " "))


def sentences(s: Column, strict: bool = False) -> Column:
    """Split after a full stop (strict) or .!? before a capital; pieces of more than 40 (strict) or 20 characters."""
    ends, least = (r"\.", 40) if strict else (r"[.!?]", 20)
    return F.filter(F.transform(F.split(s, rf"(?<={ends}){WS}+(?=[A-Z])"), strip), lambda x: F.length(x) > least)


def replace_listed(prompt: Column, new: Column) -> Column:
    """The prompt with the text of its list, wherever it stands, replaced; unchanged without a list."""
    old = listed(prompt)
    return F.when(old == "", prompt).otherwise(F.replace(prompt, old, new))


def listed(prompt: Column) -> Column:
    return F.regexp_extract(prompt, r"(?d)in the list:[\s]*(.*?)(?:\?|If none)", 1)


def unfenced(s: Column) -> Column:
    """A reply without code fence and language tag."""
    t = strip(s)
    inner = strip(F.regexp_replace(F.regexp_replace(t, r"^`+|`+$", ""), r"^json", ""))
    return F.when(t.startswith("```"), inner).otherwise(t)


def mark_first(sentence: Column, entity: Column) -> Column:
    """The first occurrence of the entity, taken literally, between ##."""
    at = F.instr(sentence, entity)
    n = F.length(entity)
    return F.when((at > 0) & (n > 0), F.concat(sentence.substr(F.lit(1), at - 1), F.lit("##"), entity, F.lit("##"), sentence.substr(at + n, F.length(sentence)))).otherwise(sentence)


def prompt(entity: Column, highlighted: Column, options: Column) -> Column:
    return F.concat(F.lit("The ##"), entity, F.lit('## in the sentence: "'), highlighted, F.lit('" belongs to which entity in the list: '), F.array_join(options, ", "), F.lit("?"))


def question(entity: Column, sentence: Column, options: Column, zero_shot: bool = True) -> Column:
    """An inference prompt: only the first occurrence is marked."""
    q = prompt(entity, mark_first(sentence, entity), options)
    return F.concat(q, F.lit(" If none of them applied, return unknown.")) if zero_shot else q
