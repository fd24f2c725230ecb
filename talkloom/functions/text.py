"""Text functions as Column expressions: terms, clipping, salience of a line, formatting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Words that are not search terms.
STOP_WORDS = (
    "the and for with that this what which when where who how was were did does done from into onto have has had "
    "you your our out not but are can could would should will just then than them they there their its it's about "
    "after before again also any each other some such only own same very more most over under while because been being into"
).split()
TERM = r"[a-z0-9_@$][a-z0-9_.:/@$-]*[a-z0-9_]|[a-z0-9]"
COMPOUND = r"[._:/-]"

# What makes a line an error, a value, an identifier, a labelled value.  \b is an ASCII word edge.
ERROR_WORD = r"(?i)\b(?:error|errors|fail|fails|failed|failure|fatal|exception|panic|denied|refused|timed? ?out|traceback|cannot|unable to)\b"
ERROR_CODE = (
    r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]{2,}\b|\bSIG[A-Z]{2,}\d*\b|\b[A-Z]{2,}\d{2,}\b|"
    r"\bE(?:NOENT|ACCES|PERM|EXIST|CONN(?:REFUSED|RESET|ABORTED)|PIPE|ADDRINUSE|TIMEDOUT|NOTFOUND|INVAL|BUSY|MFILE|AGAIN|HOSTUNREACH|NOTDIR|ISDIR|BADF|NOSPC|AI_[A-Z]+)\b"
)
IDENTIFIER = (
    r"\b[a-z]{2,}[_-](?=[a-z0-9]*\d)[a-z0-9]{6,}\b|\b(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f])[0-9a-f]{7,}\b|https?://[^\s)\"']+|"
    r"\b\d{6,}_[a-z0-9_]{3,}\b|\bv?\d+\.\d+\.\d+\b|\bsha\d*:[0-9a-f]+|@[a-z][\w-]+|--[a-z][\w-]*=\S+"
)
NUMBER = (
    r"\b\d{4,}\b|\b\d+(?:\.\d+)?\s?(?:ms|s|[KMGT]i?B|kB|%)(?![a-z])|"
    r"\b\d+ (?:pass(?:ed|ing)?|fail(?:ed|ing)?|tests?|files? changed|insertions?|deletions?|rows?|errors?|warnings?)\b|"
    r"[$€£]\d+(?:[.,]\d+)?|\b(?:status|HTTP/\d(?:\.\d)?)\s*[:=]?\s*[45]\d{2}\b|\bexit(?: code| status)?\s*[:=]?\s*(?!0\b)\d{1,3}\b"
)
KEY_VALUE = r"^[\w .\-/()]{2,48}[:=]\s*\S"
LABEL = (
    r"(?i)\b(?:ids?|hash|sha(?:256)?|checksum|trace|deploy(?:ment)?|preview|url|version|rows|p9[59]|exit(?: code)?|signal|"
    r"request[_-]?id|job|migration|applied|bundle|build|status|took|updated|created)\b"
)
WORD = "[A-Za-z0-9_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def edged(pattern: str) -> str:
    """Java's word edge also sees accented letters; this one sees ASCII only."""
    return pattern.replace(r"\b", EDGE)


def raw_terms(text: Column) -> Column:
    """Lower-case tokens; compound ones are followed by their parts."""
    found = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.flatten(F.transform(found, lambda t: F.when(t.rlike(COMPOUND), F.concat(F.array(t), F.split(t, COMPOUND + "+"))).otherwise(F.array(t))))


def terms(text: Column) -> Column:
    """Search terms of a text, repeats kept."""
    return F.filter(raw_terms(text), lambda t: (F.length(t) >= 3) & ~t.isin(list(dict.fromkeys(STOP_WORDS))))


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s   ﻿]+", " "))


def clip(text: Column, most: int) -> Column:
    flat = collapse(text)
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


# What every match of a pattern holds; the cheap test keeps most lines from the long one.
CODE_HAS, IDENTIFIER_HAS, NUMBER_HAS = "[A-Z][A-Z0-9_]", "[0-9@]|://|--|(?i:sha:)", "[0-9]"


def is_error(line: Column) -> Column:
    return line.rlike(edged(ERROR_WORD)) | (line.rlike(CODE_HAS) & line.rlike(edged(ERROR_CODE)))


def is_identifier(line: Column) -> Column:
    return line.rlike(IDENTIFIER_HAS) & line.rlike("(?i)" + edged(IDENTIFIER))


def is_number(line: Column) -> Column:
    return line.rlike(NUMBER_HAS) & line.rlike("(?i)" + edged(NUMBER))


def is_value(line: Column) -> Column:
    return is_identifier(line) | is_number(line)


def is_salient(line: Column) -> Column:
    return is_error(line) | is_value(line)


def salience(line: Column, labels: bool = True) -> Column:
    """Score of a trimmed line; null where it is too short or neither error nor value."""
    error, ident = is_error(line), is_identifier(line)
    value = ident | is_number(line)
    one = lambda c: F.when(c, 1).otherwise(0)
    score = F.when(error, 3).otherwise(0) + F.when(ident, 3).when(value, 2).otherwise(0) + one(line.rlike(KEY_VALUE)) + one(F.length(line) < 120)
    score = score + one(line.rlike(edged(LABEL))) if labels else score
    return F.when((F.length(line) >= 4) & (error | value), score)


def without_tags(text: Column) -> Column:
    """Text without lower-case tag pairs and what they hold."""
    return F.trim(F.regexp_replace(text, r"(?s)<([a-z][a-z-]*)(?:\s[^>]*)?>.*?</\1>", ""))


def spoken(text: Column) -> Column:
    """Text without the four kinds of injected blocks."""
    return trimmed(F.regexp_replace(text, r"(?s)<(system-reminder|system-message|recalled-context|handoff)(?:\s[^>]*)?>.*?</\1>", ""))


def normalised(text: Column) -> Column:
    """For comparing answers: lower case, no quotes, joined thousands, single spaces."""
    bare = F.regexp_replace(F.lower(text), "[`'\"“”‘’]", "")
    return collapse(F.regexp_replace(bare, r"(\d),(\d{3})", "$1$2"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once for each row, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def key_tokens(text: Column) -> Column:
    """Distinct terms of six characters or with a digit; failing those, of four characters."""
    distinct = F.array_distinct(terms(text))
    strong = F.filter(distinct, lambda t: (F.length(t) >= 6) | t.rlike("[0-9]"))
    return F.when(F.size(strong) > 0, strong).otherwise(F.filter(distinct, lambda t: F.length(t) >= 4))


def mentions(text: Column, tokens: Column) -> Column:
    return F.exists(tokens, lambda t: F.contains(F.lower(text), t))


def xml_attribute(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), ("\n", " ")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def to_fixed(x: Column, places: int) -> Column:
    """A number from 0 to under 1,000 with so many decimals, rounded by its exact value, halves up."""
    tie = (x * F.lit(2.0 ** (places + 1))) % 2 == 1
    return F.format_number(F.when(tie, (F.floor(x * F.lit(10.0**places)) + 1) / F.lit(10.0**places)).otherwise(x), places)


def token_figure(n: Column) -> Column:
    """12k style: T, B, M or k where at least 1.0 of it is shown, one decimal under ten; smaller numbers as they are."""
    out = js_round(n).cast("string")
    for size, unit in ((1e3, "k"), (1e6, "M"), (1e9, "B"), (1e12, "T")):
        x = n / F.lit(size)
        text = F.when(x < 10, to_fixed(x, 1)).otherwise(js_round(x).cast("string"))
        out = F.when(x > 0.95, F.concat(text, F.lit(unit))).otherwise(out)
    return out


def dollar_figure(amount: Column) -> Column:
    """$1,234 from a hundred dollars on, $12.34 below."""
    return F.concat(F.lit("$"), F.when(amount >= 100, F.format_number(js_round(amount), 0)).otherwise(to_fixed(amount, 2)))


def percent_figure(share: Column) -> Column:
    return F.concat(js_round(share * 100).cast("string"), F.lit("%"))


def counted(n: Column, noun: str) -> Column:
    """1 fold, 2 folds."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def ago_figure(seconds: Column) -> Column:
    """How long ago: just now, minutes, hours or days."""
    s = F.greatest(F.lit(0), js_round(seconds))
    unit = lambda by, name: F.concat(js_round(s / by).cast("string"), F.lit(f"{name} ago"))
    return F.when(s < 60, "just now").when(s < 3_600, unit(60, "m")).when(s < 86_400, unit(3_600, "h")).otherwise(unit(86_400, "d"))


def depth_bucket(ago: Column) -> Column:
    return F.when(ago <= 3, "1-3").when(ago <= 10, "4-10").when(ago <= 30, "11-30").when(ago <= 60, "31-60").otherwise("61+")


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def short_hash(text: Column, chars: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, chars)
