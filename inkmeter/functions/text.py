"""Segmentation of text into the units everything else is counted over."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import Profile
from ..profiles.base import WS_CHARS, WS_CLASS
from .arrays import let, positions

# FIXED VALUES: the order of these steps decides what is left of nested marks.
_LINE = r"[^\n\r\x{2028}\x{2029}]"
MARKUP_STEPS = (
    (rf"(?m)^#+[{WS_CLASS}]+", ""),
    (rf"\*\*({_LINE}+?)\*\*", "$1"),
    (rf"__({_LINE}+?)__", "$1"),
    (rf"\*({_LINE}+?)\*", "$1"),
    (rf"_({_LINE}+?)_", "$1"),
    (rf"\[({_LINE}+?)\]\({_LINE}*?\)", "$1"),
    (r"(?s)```.*?```", ""),
    (rf"`({_LINE}+?)`", "$1"),
)
SPACE_STEPS = ((r"\r", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n"))
MARKS = "#*_[`"
MARKUP_CHARS = r"[#*_\[`]"
SPACE_MARKS = ("\r", "\t", "  ", "\n\n\n")  # a text without them is as the steps would leave it


def _replace_all(col: Column, steps) -> Column:
    for regex, to in steps:
        col = F.regexp_replace(col, regex, to)
    return col


def trim_ws(col: Column) -> Column:
    return F.btrim(col, F.lit(WS_CHARS))


def normalize(text: Column) -> Column:
    """Markup removed, line ends unified, blanks collapsed.  Missing text is empty text.

    Most documents carry no markup at all; they skip its eight passes.  Blanks that are in order are left alone.
    """
    raw = F.coalesce(text, F.lit(""))
    plain = F.when(has_markup(raw), _replace_all(raw, MARKUP_STEPS)).otherwise(raw)
    return trim_ws(let(plain, lambda t: F.when(_any_of(t, SPACE_MARKS), _replace_all(t, SPACE_STEPS)).otherwise(t)))


def _any_of(text: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return out


def has_markup(text: Column) -> Column:
    return _any_of(text, MARKS)


def compact(text: Column) -> Column:
    """Text without any white space."""
    return F.regexp_replace(text, f"[{WS_CLASS}]+", "")


def _kept(items: Column) -> Column:
    return F.filter(F.transform(items, trim_ws), lambda s: s != "")


def sentences(text: Column, p: Profile) -> Column:
    """Sentences with their end mark; an end mark without a sentence is left out.

    The text is cut after every end mark.  Text made of nothing but end marks
    counts as one sentence.
    """
    marks = list(p.terminators)
    parts = F.split(text, f"(?<=[{p.terminators}])")
    return let(
        _kept(F.filter(parts, lambda s: ~s.isin(*marks))),
        lambda found: F.when((F.size(found) > 0) | (text == ""), found)
        .when(F.translate(text, p.terminators, "") == "", F.array(text))
        .otherwise(found),
    )


def paragraphs(text: Column, trimmed: bool = True) -> Column:
    parts = F.split(text, r"\n+")
    return _kept(parts) if trimmed else F.filter(parts, lambda s: s != "")


def clauses(text: Column, p: Profile) -> Column:
    return _kept(F.split(text, p.clause_regex))


def characters(text: Column) -> Column:
    return F.when(text != "", F.split(text, "")).otherwise(F.array().cast("array<string>"))


def tokens(text: Column, p: Profile) -> Column:
    """Lower-cased words, then every character that is neither word, blank nor punctuation."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(p.word_regex), F.lit(0))
    return F.concat(words, characters(F.regexp_replace(low, p.token_strip, "")))


def pseudo_words(text: Column, p: Profile) -> Column:
    """Words by punctuation, white space and (where the script has no blanks) function characters."""
    spaced = F.regexp_replace(text, p.pseudo_break, " ")
    if p.pseudo_boundary:
        spaced = F.regexp_replace(spaced, p.pseudo_boundary, " $1 ")
    return F.filter(F.split(spaced, f"[{WS_CLASS}]+"), lambda w: w != "")


def keyword_chunks(sentence: Column, p: Profile) -> Column:
    """What is left between a sentence's punctuation and blanks; the longer chunks that are no stop words are its keywords."""
    text = F.lower(sentence) if p.fold_case else sentence
    return F.split(F.regexp_replace(text, p.keyword_break, " "), f"[{WS_CLASS}]+")


def char_ngrams(text: Column, n: int) -> Column:
    """All overlapping n-character substrings; none when the text is shorter."""
    return F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1))


def topic_ngrams(text: Column, p: Profile) -> Column:
    """Distinct topic substrings that hold at least one non-function character."""
    cleaned = F.regexp_replace(F.lower(text) if p.fold_case else text, p.topic_drop, "")
    grams = F.concat(*(char_ngrams(cleaned, n) for n in p.topic_sizes))
    content = "[^" + p.topic_function_class[1:]
    return F.array_distinct(F.filter(grams, lambda g: F.rlike(g, F.lit(content))))


def word_ngrams(words: Column, n: int) -> Column:
    """n neighbouring words joined without a separator."""
    return F.transform(
        positions(F.size(words) - (n - 1)),
        lambda i: F.concat(*(F.get(words, i + (k - 1)) for k in range(n))),
    )


def needed_literal(regex: str) -> str:
    """The longest text that every match of a regular expression holds, as far as it stands outside groups; else empty."""
    runs, i = [""], 0
    while i < len(regex):
        ch = regex[i]
        if ch == "|":
            return ""
        if ch == "\\" and not regex[i + 1].isalnum():
            runs[-1] += regex[i + 1]
            i += 2
            continue
        if ch in "?*{":  # the character before may be missing
            runs[-1] = runs[-1][:-1]
        if ch in "([{\\":
            runs.append("")
            i = _end_of(regex, i)
        elif ch in "?*+.^$":
            runs.append("")
            i += 1
        else:
            runs[-1] += ch
            i += 1
    return max(runs, key=len)


def _end_of(regex: str, i: int) -> int:
    """Where the group, class, count or escape that begins at ``i`` ends."""
    if regex[i] == "\\":
        return regex.index("}", i) + 1 if regex[i + 1 : i + 3] in ("p{", "P{", "x{") else i + 2
    close, i = {"(": ")", "[": "]", "{": "}"}[regex[i]], i + 1
    while regex[i] != close:
        i = _end_of(regex, i) if regex[i] == "\\" or (close == ")" and regex[i] in "([") else i + 1
    return i + 1


def count_regex(text: Column, regex: str) -> Column:
    """Matches in a text; one without what every match holds is not searched."""
    count, literal = F.regexp_count(text, F.lit(regex)), "" if "(?" in regex.replace("(?:", "") else needed_literal(regex)
    return F.when(F.contains(text, F.lit(literal)), count).otherwise(0) if literal.strip() else count


def count_regexes(text: Column, regexes) -> Column:
    out = F.lit(0)
    for regex in regexes:
        out = out + count_regex(text, regex)
    return out


def count_contained(text: Column, phrases) -> Column:
    """How many of the listed phrases occur; a phrase listed twice counts twice."""
    return let(text, lambda t: F.size(F.filter(F.array(*map(F.lit, phrases)), lambda phrase: F.contains(t, phrase))))


def count_literal(text: Column, phrases) -> Column:
    """Occurrences of each phrase on its own, so phrases that overlap each other all count."""
    lengths = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(len(p)).alias("n")) for p in phrases))

    def counted(t: Column, x: Column) -> Column:
        left = F.length(F.replace(t, x["p"], F.lit("")))
        return F.when(F.contains(t, x["p"]), ((F.length(t) - left) / x["n"]).cast("int")).otherwise(0)

    return let(text, lambda t: F.aggregate(lengths, F.lit(0), lambda a, x: a + counted(t, x)))


def match_text(text: Column, p: Profile) -> Column:
    """Text the pattern dictionaries look at."""
    return F.lower(text) if p.fold_case else text


def python_class(java: str) -> re.Pattern:
    """A character class of a profile for one character at a time."""
    return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m[1], 16))), java), re.ASCII)


@cache
def _letters(kind: str) -> str:
    """All characters of a general category's group, as ranges of a class."""
    own = [i for i in range(0x110000) if unicodedata.category(chr(i))[0] == kind]
    begins = [i for i, before in zip(own, [-2, *own], strict=False) if i != before + 1]
    ends = [i for i, after in zip(own, [*own[1:], -2], strict=True) if after != i + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(begins, ends, strict=True))


def _members(body: str) -> list[str]:
    """The members of a class, a range's hyphen on its own, each as Python writes it."""
    out, i = [], 0
    while i < len(body):
        end = _end_of(body, i) if body[i] == "\\" else i + 1
        end += 2 if body[i:end] == r"\x" else 0
        part = body[i:end]
        if part[:2] in (r"\p", r"\x"):
            kind = part[2:].strip("{}")
            out.append(part if part[1] == "p" else f"\\U{int(kind, 16):08x}")
        elif part in (r"\d", r"\s"):
            out.append({r"\d": "0-9", r"\s": r" \t\n\x0b\f\r"}[part])
        elif part[0] == "\\" and part[1].isalnum():
            if part[1] not in "tnfr":
                raise ValueError(f"{part} in a class")
            out.append(part)
        elif part == "[" or body[i : i + 2] == "&&":
            raise ValueError(f"a class in a class: {body}")
        else:
            out.append("-" if part == "-" and 0 < i < len(body) - 1 else re.escape(part[-1]))
        i = end
    return out


def _class_for_python(java: str) -> str:
    negated = java[1] == "^"
    members = _members(java[2 if negated else 1 : -1])
    if r"\p{L}" in members and r"\p{N}" in members:  # \w are letters, numbers and the low line
        rest = [m for m in members if m not in (r"\p{L}", r"\p{N}")]
        if "_" in rest:
            members = [r"\w", *rest]
        elif not rest:
            return r"[\W_]" if negated else r"[^\W_]"
    return f"[{'^' if negated else ''}{''.join(_letters(m[3]) if m.startswith(chr(92) + 'p') else m for m in members)}]"


@cache
def python_regex(java: str) -> re.Pattern:
    """An expression that cuts texts, for Python's engine; digits and blanks are the ASCII ones."""
    out, i = "", 0
    while i < len(java):
        if java[i] == "[":
            end = _end_of(java, i)
            out += _class_for_python(java[i:end])
        elif java[i] == "\\":
            end = _end_of(java, i)
            out += r"\Z" if java[i:end] == r"\z" else _class_for_python(f"[{java[i:end]}]")
        elif java[i] in ".$":
            raise ValueError(f"{java[i]} outside a class")
        else:
            end = i + 1
            out += java[i]
        i = end
    return re.compile(out)
