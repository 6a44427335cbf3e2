"""SQL table functions: sentences, paragraphs, clauses, tokens and n-grams of a text, to be used with LATERAL.

``SELECT d.doc_id, s.* FROM documents d, LATERAL sentences_of(d.text) s`` gives the rows of the sentence table.  The functions
are SQL text over built-in functions, so a query with them is planned like one written with columns: the text is cut in
its own row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..profiles import Profile
from ..profiles.base import WS_CHARS, WS_CLASS
from .text import MARKUP_CHARS, MARKUP_STEPS, SPACE_STEPS


def literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(x: str, steps) -> str:
    for regex, to in steps:
        x = f"regexp_replace({x}, {literal(regex)}, {literal(to)})"
    return x


def _trimmed(x: str) -> str:
    return f"btrim({x}, {literal(WS_CHARS)})"


def _normalized(x: str) -> str:
    """Marks removed and blanks collapsed, twice, as in every unit table; text without a mark is normalised once.

    Each text is bound before it is used more than once.
    """

    def once(raw: str) -> str:
        plain = f"CASE WHEN {raw} RLIKE {literal(MARKUP_CHARS)} THEN {_replaced(raw, MARKUP_STEPS)} ELSE {raw} END"
        return _trimmed(_replaced(plain, SPACE_STEPS))

    again = f"CASE WHEN norm1 RLIKE {literal(MARKUP_CHARS)} THEN {once('norm1')} ELSE norm1 END"
    return _let(f"coalesce({x}, '')", "raw", _let(once("raw"), "norm1", again))


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _kept(items: str) -> str:
    return f"filter(transform({items}, s -> {_trimmed('s')}), s -> s <> '')"


def _compact(x: str) -> str:
    return _replaced(x, ((f"[{WS_CLASS}]+", ""),))


def _sentences(x: str, p: Profile) -> str:
    marks = ", ".join(map(literal, p.terminators))
    parts = f"split(n, {literal(f'(?<=[{p.terminators}])')})"
    found = _kept(f"filter({parts}, s -> s NOT IN ({marks}))")
    bare = f"translate(n, {literal(p.terminators)}, '') = ''"
    chosen = _let(found, "f", f"CASE WHEN size(f) > 0 OR n = '' THEN f WHEN {bare} THEN array(n) ELSE f END")
    return _let(_normalized(x), "n", chosen)


def _tokens(x: str, p: Profile) -> str:
    rest = _replaced("low", ((p.token_strip, ""),))
    words = f"regexp_extract_all(low, {literal(p.word_regex)}, 0)"
    return _let(f"lower({_normalized(x)})", "low", f"concat({words}, filter(split({rest}, ''), c -> c <> ''))")


def table_functions(p: Profile) -> dict[str, str]:
    """Name, parameters and result of each function, with its body."""
    return {
        "sentences_of(t STRING) RETURNS TABLE(sent_idx INT, text STRING, n_chars INT)": f"SELECT pos, col, length(col) FROM posexplode({_sentences('t', p)})",
        "paragraphs_of(t STRING) RETURNS TABLE(para_idx INT, text STRING, n_chars INT)": f"SELECT pos, col, length(col) FROM posexplode({_kept(f'split({_normalized("t")}, {literal(chr(92) + "n+")})')})",
        "clauses_of(t STRING) RETURNS TABLE(clause_idx INT, text STRING, n_chars INT)": f"SELECT pos, col, length(col) FROM posexplode({_kept(f'split({_normalized("t")}, {literal(p.clause_regex)})')})",
        "tokens_of(t STRING) RETURNS TABLE(pos INT, token STRING)": f"SELECT pos, col FROM posexplode({_tokens('t', p)})",
        "ngrams_of(t STRING, n INT) RETURNS TABLE(pos INT, gram STRING)": f"SELECT pos, col FROM posexplode(regexp_extract_all({_compact(_normalized('t'))}, concat('(?s)(?=(.{{', n, '}}))'), 1))",
    }


def register_table_functions(spark: SparkSession, p: Profile) -> None:
    """The functions of a profile, in the session; registering another profile's replaces them."""
    for head, body in table_functions(p).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
