"""What a language profile holds.

A profile is data only: the segmentation classes, the dictionaries and the
message texts of one language family.  The Spark jobs take a profile and turn
its entries into literal column expressions, so every regular expression is
compiled once per task and nothing has to be broadcast.

Regular expressions are written in the subset shared by Java and RE2 wherever
a value is used on the corpus tables, so the same text also drives the SQL the
results are checked with.
"""

from __future__ import annotations

from dataclasses import dataclass

# White space as text editors see it, not only the ASCII part.
WS_CLASS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CHARS = "\t\n\x0b\x0c\r " + "".join(
    map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF))
)


@dataclass(frozen=True)
class Pattern:
    """One row of the pattern dictionary."""

    pattern_id: int
    label: str
    category: str
    weight: int
    regex: str
    context_rule: str | None = None  # 'contrast', 'concept' or None


@dataclass(frozen=True)
class Signal:
    """A weighted regular expression; ``every`` counts all matches, else presence."""

    regex: str
    every: bool = False
    weight: int = 1
    at_least: int = 1


@dataclass(frozen=True)
class Profile:
    name: str
    fold_case: bool

    # segmentation
    terminators: str  # end marks of a sentence, the line feed included
    clause_regex: str
    word_regex: str
    token_strip: str
    pseudo_break: str
    pseudo_boundary: str | None
    keyword_break: str
    keyword_stop_text: str
    topic_drop: str
    topic_sizes: tuple[int, ...]
    topic_function_class: str

    # statistics
    complexity_class: str
    opener_strip: str
    closer_strip: str
    unique_drop: str
    punctuation: tuple[tuple[str, str], ...]  # (name, characters); single-character classes
    ellipsis_long: str
    ellipsis_short: str
    dash_regex: str
    function_units: tuple[str, ...]
    function_by_char: bool

    # dictionaries
    patterns: tuple[Pattern, ...]
    phrases: tuple[str, ...]
    set_phrases: tuple[str, ...]
    concrete: tuple[str, ...]
    human: tuple[str, ...]
    abstract_regex: str
    community_regex: str
    genre_argumentative: tuple[Signal, ...]
    genre_narrative: tuple[Signal, ...]
    structure_signals: tuple[Signal, ...]
    strong_voice: str
    weak_voice: str
    self_reference: str
    opposites: tuple[tuple[str, str], ...]
    evidence_regex: str

    # parallel structure
    parallel_break: str
    shape_drop: str
    parallel_regexes: tuple[str, ...]
    phrase_label: str
    phrase_category: str
    parallel_label: str
    parallel_category: str

    # context rules
    sentence_stop: str
    contrast_abstract: str
    contrast_human: str
    contrast_person: str
    concept_question: str
    concept_example: str

    # document markers
    human_marker: str
    template_marker: str
    argumentative_marker: str
    opener_regex: str
    abstract_strip: str
    concrete_word_regex: str

    # texts
    rewrites: tuple[tuple[str, str], ...]
    advice: tuple[tuple[tuple[str, ...], str], ...]
    texts: dict

    def __hash__(self) -> int:
        return hash(self.name)
