"""Profile for Latin-script text (English, French, German, Spanish).

The dictionaries are this project's own.  Patterns run on lower-cased text and
stay inside the regular-expression subset that Java and RE2 share.
"""

from __future__ import annotations

from .base import WS_CLASS, Pattern, Profile, Signal

FUNCTION_WORDS = (
    # English
    "the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "be", "by", "as", "this", "are",
    "at", "from", "an", "he", "or", "but", "not", "which",
    # French
    "de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "pour", "est", "qui", "par", "dans", "sur", "au",
    "pas", "avec",
    # German
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "auf", "für", "ist", "nicht", "dem", "im", "ein", "als",
    "eine",
    # Spanish
    "el", "y", "los", "se", "del", "las", "por", "no", "con", "su", "una", "es", "para", "al", "lo",
)

_S = r"[^.!?;\n]"  # anything inside one sentence

PATTERNS = (
    # label, category, weight, pattern
    ("not … but", "contrast frame", 8, rf"(?:^|[^\p{{L}}])not {_S}{{1,46}} but "),
    ("nicht … sondern", "contrast frame", 8, rf"nicht {_S}{{1,46}} (?:sondern|als|mit|auf) "),
    ("ne pas … mais", "contrast frame", 7, rf" pas {_S}{{1,46}} (?:mais|pour|avec|dans) "),
    ("no … sino", "contrast frame", 7, rf"(?:^|[^\p{{L}}])no {_S}{{1,46}} (?:sino|que|para|por) "),
    ("it is … that", "cleft frame", 6, rf"(?:^|[^\p{{L}}])(?:it|this) (?:is|was) {_S}{{0,46}}(?:that|which) "),
    ("is … that", "cleft frame", 4, rf" (?:is|was|are) {_S}{{1,46}} that "),
    ("c'est … qui", "cleft frame", 5, rf" est {_S}{{1,46}} (?:qui|que) "),
    ("es … que", "cleft frame", 5, rf" es {_S}{{1,46}} que "),
    ("from … to", "scope frame", 5, rf" from {_S}{{1,28}} to "),
    ("von … zu", "scope frame", 5, rf" von {_S}{{1,28}} zu "),
    ("de … à", "scope frame", 3, rf" de {_S}{{1,28}} (?:à|au|aux) "),
    ("desde … hasta", "scope frame", 5, rf" (?:desde|de) {_S}{{1,28}} (?:hasta|al) "),
    ("on the one hand … on the other", "structure frame", 6, r"on the one hand[^.!?\n]{1,70}on the other"),
    ("first … then … finally", "structure frame", 7, r"first[^.!?\n]{1,90}(?:second|then)[^.!?\n]{1,90}(?:finally|therefore)"),
    ("both … and", "paired frame", 5, rf" (?:both|as well|with) {_S}{{1,46}} and "),
    ("sowohl … als auch", "paired frame", 5, rf" (?:sowohl|mit) {_S}{{1,46}} (?:als|und) "),
    ("in conclusion", "summary phrase", 6, r"in (?:conclusion|summary|short)[,.]?"),
    ("it is worth noting", "value cue", 5, r"(?:worth|important to) (?:noting|note|mentioning|mention)"),
    ("we must recognise", "appeal", 5, r"we (?:must|should|need to) (?:recognise|recognize|understand|remember)"),
    ("plays a key role", "vague role", 5, r"plays? an? (?:key|vital|crucial|important) role"),
    ("in today's world", "time phrase", 4, r"in today's [^.!?;\n]{1,28}(?:world|society|age)"),
    ("released under", "licence line", 4, r"(?:released|licensed) under the "),
    ("all rights reserved", "licence line", 4, r"all rights reserved"),
    ("that it was", "hedge", 4, r"(?:^|[^\p{L}])that (?:it|this) (?:is|was) "),
    ("of the … of the", "nominal chain", 5, rf" of the {_S}{{1,28}} of (?:the|a) "),
    ("de la … de la", "nominal chain", 4, rf" de (?:la|las|los|les) {_S}{{1,28}} de (?:la|las|los|les) "),
    ("der … der", "nominal chain", 3, rf" der {_S}{{1,20}} der {_S}{{1,20}} der "),
    ("doubled function word", "echo", 1, r" (?:the the|of of|and and|de de|la la|der der|die die) "),
    ("shouted run", "noise", 2, r"[!?]{2,}"),
    ("licence", "concept word", 2, r"license"),
    ("best", "concept word", 3, r"(?:^|[^\p{L}])best(?:[^\p{L}]|\z)"),
    ("question, suggestion and the like", "concept word", 2, r"\p{L}estions?(?:[^\p{L}]|\z)"),
    ("synergy", "concept word", 4, r"synergy"),
    ("paradigm", "concept word", 4, r"paradigm"),
    ("mindset", "concept word", 4, r"mindset"),
    ("action", "concept word", 1, r"(?:^|[^\p{L}])actions?(?:[^\p{L}]|\z)"),
)

CONTRAST_CATEGORY = "contrast frame"
CONCEPT_CATEGORY = "concept word"

PHRASES = (
    "in conclusion", "to sum up", "moreover", "furthermore", "therefore", "however", "it is clear that", "as a result",
    "in other words", "for example", "above all", "in addition", "released under", "rights reserved",
    "en conclusion", "par exemple", "cependant", "en effet", "de plus", "en outre", "tout d'abord",
    "zum beispiel", "daher", "jedoch", "darüber hinaus", "außerdem", "im folgenden", "vor allem",
    "en resumen", "por ejemplo", "sin embargo", "además", "por lo tanto", "en primer lugar", "sobre todo",
)

SET_PHRASES = (
    "of the", "of a", "the of", "in the", "in a", "and the", "to the", "that the", "is the", "is a", "it is", "on the",
    "de la", "de les", "la de", "et la", "et le", "que la", "pour la", "pas de", "en la", "de los", "que el", "y la", "se la",
    "der die", "die der", "und die", "und der", "in der", "in den", "von der", "zu der", "auf die", "mit der", "nicht der",
)

ADVICE = (
    (("not", "nicht", "pas", "no "), "Drop the contrast frame; state the point through a concrete scene or action."),
    (("parallel", "paired", "doubled"), "Break up the parallel run; keep one or two key sentences."),
    (("stock", "conclusion", "licen"), "Cut the general summary; add a concrete event, person, time or detail."),
    (("must",), "Lower the appeal; describe a real experience instead."),
    (("suggestion", "synergy", "paradigm", "mindset", "best"), "Replace the concept label with a description of what happens."),
    (("rights", "released"), "Move the licence wording out of the prose."),
)

REWRITES = (
    (r"(?i)not ([^.!?;\n]{1,32}?),? but ", "rather than $1, "),
    (r"(?i)nicht ([^.!?;\n]{1,32}?),? sondern ", "statt $1 eher "),
    (r"(?i)in conclusion,? |to sum up,? |moreover,? |furthermore,? ", ""),
    (r"(?i)in today's (?:world|society)", "now"),
    (r"(?i)plays an? (?:key|vital|crucial|important) role", "matters"),
    (r"(?i)that it was ", "that was "),
    (r"(?i) of the the ", " of the "),
)

TEXTS = {
    "untitled": "Untitled text",
    "default_scene": "general",
    "status_optimize": "rewritten",
    "status_detect": "scored",
    "advice_default": "Add a clear subject, a scene and a reason for the judgement.",
    "label_default": "template-like wording",
    "paragraph_reason_default": "mostly abstract wording",
    "problem_labels": "Matches %s; reads like a template.",
    "problem_default": "Long and abstract sentence without a concrete context.",
    "label_join": ", ",
    "risk_levels": ("minimal traces", "few traces", "some traces", "marked traces", "strong traces", "very strong traces"),
    "risk_texts": ("minimal", "few", "some", "marked", "strong", "very strong"),
    "display_labels": ("minimal", "few", "some", "some", "fairly clear", "clear"),
    "scale_labels": ("lowest", "low", "medium", "apparent", "high"),
    "source_desc": "%s matched %d times; regular but without a real context.",
    "source_concrete": ("Few concrete details", "Little data, time, people, quotation or first-hand report."),
    "source_function": ("Many function words", "Function words make up %.1f%% of the characters."),
    "source_trigram": ("Repeated character runs", "%.1f%% of the character trigrams occur more than once."),
    "source_bigram": ("Repeated word pairs", "%.1f%% of the word pairs occur more than once."),
    "source_statistical": ("Even statistics", "Entropy, burstiness and word frequencies are unusually even."),
    "source_semantic": ("Smooth transitions", "Neighbouring sentences share unusually much vocabulary."),
    "source_consistency": ("Weak coherence", "%d consistency findings (%d gaps, %d contradictions, %d repeats)."),
    "reason_patterns": "%d kinds of template pattern",
    "reason_parallel": "runs of parallel clauses",
    "reason_long": "long average sentences",
    "reason_concrete": "few concrete facts or experiences",
    "reason_abstract": "%d abstract terms with few details",
    "reason_wechat_narrative": "narrative text, template weight lowered",
    "reason_structure": "%d answer-structure signals",
    "reason_community": "%d community terms with few experiences",
    "reason_zhihu_narrative": "experience report, template weight lowered",
    "reason_function": "function words at %.1f%% of the characters",
    "reason_trigram": "repeated character trigrams at %.1f%%",
    "reason_bigram": "repeated word pairs at %.1f%%",
    "reason_gaps": "%d topic gaps",
    "reason_contradictions": "%d contradictions",
    "reason_default": "no frequent template pattern found; review by hand",
    "confidence": ("low", "medium", "high"),
    "confidence_short": "Short text, too few signals; add more text for a reliable result.",
    "confidence_agree": "Several layers agree; the result is fairly reliable.",
    "confidence_plain": "Based on statistics and pattern matching; combine with review by hand.",
    "gap_desc": "paragraphs %d and %d do not connect (similarity %.1f%%)",
    "contradiction_desc": "paragraphs %d and %d contradict each other (%s|%s)",
    "redundancy_desc": "paragraphs %d and %d use the same evidence (%s)",
    "finding_labels": {"semantic_gap": "topic gap", "contradiction": "contradiction", "redundant_evidence": "repeated evidence"},
    "severity_texts": {"high": "high risk", "medium": "medium risk"},
    "fallback_problem": "From the source analysis: %s.",
    "fallback_advice": "Add a concrete scene, a fact, an action or a reason.",
    "report": "Score: %d%%\nRisk: %s\nLength: %d\nMain points: %s",
    "report_join": "; ",
}


def _context_rule(category: str, weight: int) -> str | None:
    if category == CONTRAST_CATEGORY:
        return "contrast"
    if category == CONCEPT_CATEGORY and weight > 1:
        return "concept"
    return None


LATIN = Profile(
    name="latin",
    fold_case=True,
    terminators=".。！？!?；;\n",
    clause_regex=r"[，,.。！？!?；;：:\n]+",
    word_regex=r"[\p{L}\p{N}]+(?:['-][\p{L}\p{N}]+)?",
    token_strip=r"""[\p{L}\p{N}""" + WS_CLASS + r"""，。！？；：、“”‘’（）()《》,.!?;:'"\-—_`~@#$%^&*+=/\\\[\]{}<>|]""",
    pseudo_break=r"""[，,.。！？!?；;：:、"'（）()《》【】「」『』〔〕…—–\-~\n\r]""",
    pseudo_boundary=None,
    keyword_break=r"""[，,.。！？!?；;：:、"'（）()…—–\d]""",
    keyword_stop_text=" ".join(FUNCTION_WORDS),
    topic_drop=r"[\d" + WS_CLASS + "]",
    topic_sizes=(7, 8, 9),
    topic_function_class="[aeiou]",
    complexity_class=r"[，,；;：:（）(){}\[\]—-]",
    opener_strip=r"""^[「『"'（(【\[《,，、。！？!?.]""",
    closer_strip=r"[.。！？!?；;]\z",
    unique_drop=r"""[""" + WS_CLASS + r"""，。！？；：、"'（）()《》,.!?;:]""",
    punctuation=(
        ("comma", "，,"), ("period", "。."), ("exclamation", "！!"), ("question", "？?"), ("colon", "：:"),
        ("semicolon", "；;"), ("quote", "\"'"), ("paren", "（）()"),
    ),
    ellipsis_long=r"…{2,}\.{3,}",
    ellipsis_short="…",
    dash_regex=r"[—–-]{2,}",
    function_units=FUNCTION_WORDS,
    function_by_char=False,
    patterns=tuple(
        Pattern(i + 1, label, category, weight, regex, _context_rule(category, weight))
        for i, (label, category, weight, regex) in enumerate(PATTERNS)
    ),
    phrases=PHRASES,
    set_phrases=SET_PHRASES,
    concrete=(
        r"\d+(?:\.\d+)?%?", r"(?:19|20)\d{2}", r"https?://\S+", r"[\w.]+@[\w.]+", r'"[^"]{5,}"',
        r"[a-zà-öø-ÿ,] [A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]{1,10}[ ,.!?\n]", r"\d{3,4}-\d{3,8}", r"(?:License|GmbH|Ltd|University|Company)",
    ),
    human=("i remember", "yesterday", "last week", "honestly", "for example", "es war", "je ", " er ", " he ", "it was", " elle ", " su "),
    abstract_regex=r"\p{L}{2,}(?:tion|ment|heit|keit|ung|ción|mente)(?:[^\p{L}]|\z)",
    community_regex=r"\p{L}{2,}(?:able|ible|ly|lich|eux|ado)(?:[^\p{L}]|\z)",
    genre_argumentative=(
        Signal(r"(?:first|second|third)(?:ly)?,", every=True),
        Signal(r" (?:is|est|ist|es) (?:that|que|das|nicht|the|la|der) ", every=True),
        Signal(r"therefore|daher|donc|por tanto"),
        Signal(r"on the one hand.*on the other"),
        Signal(r" (?:for|pour|für|para) (?:the|la|les|die|el|los) ", every=True),
        Signal(r"in (?:conclusion|summary)"),
    ),
    genre_narrative=(
        Signal(r"yesterday|last (?:week|year)|once"),
        Signal(r" (?:was|war|était|fue) "),
        Signal(r" (?:he|er|elle|su) "),
        Signal(r"friend|family|neighbour|ami|freund"),
        Signal(r" (?:from|von|au|del) "),
    ),
    structure_signals=(
        Signal(r"in short|the answer is", weight=2),
        Signal(r"(?:^|\n)the ", weight=1),
        Signal(r"contents|table of contents", weight=2),
        Signal(r"(?:^|\n)\p{L}+\.", weight=2, at_least=3),
        Signal(r"(?:^|\n)\p{L}+\.", weight=1, at_least=6),
        Signal(r"(?:^|\n) *\d+[.)] *\S", weight=1),
        Signal(r"(?:like|follow).{0,8}(?:share|subscribe)", weight=2),
        Signal(r"(?:^|\n) *[-—]{3,} *(?:\n|\z)", weight=1),
        Signal(r"(?:update|released|rights)", weight=1),
    ),
    strong_voice="(?:i remember|i think|i feel|i saw|honestly|for example|it was)",
    weak_voice="(?: he | er | elle | su |yesterday|then|today|recently)",
    self_reference="(?: itself| sich )",
    opposites=(
        ("always", "never"), ("good", "bad"), (" with ", "without"), (" to ", " from "), (" it is ", " it was "),
        (" is ", " was "), (" avec ", " sans "), (" est ", " pas "), (" dans ", " sur "), (" ist ", "nicht"),
        (" mit ", " ohne "), (" zu ", " von "), (" con ", " sin "), (" es ", " no "), (" para ", " por "),
        ("increase", "decrease"),
    ),
    evidence_regex=r"(?:according to|for example|by the|as the|that the|from the|par le|par la|selon|pour le|que la|laut|nach|durch|von der|für die|según|por la|que el|study|report|data|license)",
    parallel_break=r"[，,.；;。！？!?\n]",
    shape_drop=r"[aeiouyàâäéèêëíïîóôöúùûü ]",
    parallel_regexes=(r"both [^.!?;\n]{1,24} and [^.!?;\n]{1,24} more", r"(?:^|[^\p{L}])(?:neither|weder|ni) [^.!?;\n]{1,24} (?:nor|noch|ni) "),
    phrase_label="stock transition phrases",
    phrase_category="stock phrase",
    parallel_label="runs of parallel clauses",
    parallel_category="rhythm",
    sentence_stop=".",
    contrast_abstract=r"(?:tion|ment|heit|keit|ción|essen|value|meaning|growth)",
    contrast_human=r"""["']|(?: he| er| il| su|the |der |la |friend|child|book|work)""",
    contrast_person=r"""["']| he | er | elle |\d""",
    concept_question=r"(?:what|how|why|was|wie|que|como)\z",
    concept_example=r"(?:for example|such as|like|this|that|the |der |das )",
    human_marker=r"(?:i remember|i think|honestly|last week|yesterday|it was| he was| er ist)",
    template_marker=r"(?:in conclusion|it is worth noting|not [^.!?;\n]{1,46} but |released under|that it (?:is|was))",
    argumentative_marker=r"(?:^|\n)\d+[.)]|first,.*second| is that ",
    opener_regex=r"^(?:however|therefore|also|the|so|but|la|le|der|die|el)[, ]",
    abstract_strip=r"""[，。！？；：、"'（）()《》,.!?;:]""",
    concrete_word_regex=r"(?:^| )(?:i|you|we|he|this|that|ich|wir|il|elle|su|que|das) ",
    rewrites=REWRITES,
    advice=ADVICE,
    texts=TEXTS,
)
