"""Toxicity: a weighted finite-state grammar of clauses, its insult lexicon learned from labels."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, held_out, some

#: Labelled documents that the lexicon is learned from, at most.
SAMPLE = 20_000
#: Word beginnings of these lengths, and whole words, are terms.
STEMS = range(4, 9)
#: A term stands in at least so many toxic documents of the sample, and in so large a part of them ...
LEAST_DOCS, LEAST_PART = 3, 0.003
#: ... and so large a part of the documents with it is toxic.
PURITY = 0.9
#: A clean document with a term weighs as much against it as so many toxic ones that it covers weigh for it.
CLEAN_COST = 10
#: Terms in the lexicon and candidates looked at, at most (by documents that they cover).
TERMS, CANDIDATES = 256, 50_000
#: A term that stands in so many toxic documents, and so large a part of them, is taken though others cover them.
COMMON_DOCS, COMMON_PART = 8, 0.05
THRESHOLD = 0.7
#: Log odds that context adds to an insult.
TARGETED, NEGATED, REPORTED, THREAT = 0.5, -1.5, -1.0, 2.0
#: Words after a negation that it reaches.
REACH = 3
_WORD = re.compile(r"[^\W\d_]+|[.!?;:\n]|[\"“”«»]")
_LETTERS = re.compile(r"[^\W\d_]+")
_AROUND = 400

# Closed word classes of the grammar in English, German, French and Spanish.
TARGETS = "you your you're u ya du dich dir dein deine ihr euch tu te toi vous ton ta tes tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never isn't aren't don't neither nor nicht kein keine nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says called calls claimed quoted wrote reported sagte nannte schrieb dit appelé écrit dijo llamó escribió".split()
THREATS = "kill hurt destroy beat stab shoot töten umbringen schlagen tuer frapper détruire matar golpear destruir".split()


@dataclass
class Transducer:
    """A weighted transducer: ``arcs[state, symbol]`` is (next state, output, weight); other symbols pass, and keep the state."""

    arcs: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol: str):
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def then(self, other: Transducer, symbols: str) -> Transducer:
        """The composition: what this one writes, ``other`` reads.  States are pairs, weights add up."""
        out, todo, seen = Transducer(start=(self.start, other.start)), [(self.start, other.start)], set()
        while todo:
            state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for symbol in symbols:
                a, written, first = self.step(state[0], symbol)
                b, result, second = other.step(state[1], written)
                out.arcs[state, symbol] = ((a, b), result, first + second)
                todo.append((a, b))
        return out


#: i insult, h threat, t target, n negation, r reported speech or a quotation mark, o other word, | clause end.
#: Written: I insult clause, H threat clause (both end a match), the rest as read.
SYMBOLS = "ihtnro|"


def negation() -> Transducer:
    """Weakens an insult or threat within reach of a negation; a threat so denied is an ordinary word."""
    arcs = {(0, "n"): (REACH, "n", 0.0)}
    for left in range(1, REACH + 1):
        arcs |= {(left, x): (left - 1, x, 0.0) for x in "tro"}
        arcs |= {(left, "n"): (REACH, "n", 0.0), (left, "i"): (left - 1, "i", NEGATED), (left, "h"): (left - 1, "o", 0.0), (left, "|"): (0, "|", 0.0)}
    return Transducer(arcs)


def reported() -> Transducer:
    """Weakens what follows a verb of saying or a quotation mark in its clause."""
    return Transducer({(0, "r"): (1, "r", 0.0), (1, "i"): (1, "i", REPORTED), (1, "h"): (1, "o", 0.0), (1, "|"): (0, "|", 0.0)})


def target() -> Transducer:
    """Strengthens an insult of a clause that addresses somebody, before or after it."""
    return Transducer(
        {
            (0, "t"): (1, "t", 0.0), (1, "i"): (2, "i", TARGETED), (0, "i"): (3, "i", 0.0), (3, "t"): (2, "t", TARGETED),
            (1, "|"): (0, "|", 0.0), (2, "|"): (0, "|", 0.0), (3, "|"): (0, "|", 0.0),
        }
    )


def threat() -> Transducer:
    """A threat is a verb of harm and somebody addressed, in either order, in one clause."""
    return Transducer(
        {(0, "h"): (1, "o", 0.0), (1, "t"): (2, "H", THREAT), (0, "t"): (3, "t", 0.0), (3, "h"): (2, "H", THREAT),
         (1, "|"): (0, "|", 0.0), (2, "|"): (0, "|", 0.0), (3, "|"): (0, "|", 0.0)}
    )


def insult() -> Transducer:
    """An insult makes a match; its own weight is the lexicon's."""
    return Transducer({(0, "i"): (0, "I", 0.0)})


def grammar() -> Transducer:
    out, symbols = negation(), SYMBOLS
    for machine in (reported(), target(), threat(), insult()):
        out = out.then(machine, symbols)
    return out


class Lexicon:
    """Finds the terms of a lexicon (``stem*`` or ``word``, with log odds) in a lower-cased text."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.terms = terms
        self.automaton = ahocorasick.Automaton()
        for term, weight in terms.items():
            stem = term.rstrip("*")
            held = self.automaton.get(stem, ())
            self.automaton.add_word(stem, (*held, (stem, term.endswith("*"), weight)))
        if terms:
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, float]]:
        if not self.terms:
            return
        for end, found in self.automaton.iter(text):
            for stem, is_stem, weight in found:
                at = end - len(stem) + 1
                if (at == 0 or not text[at - 1].isalpha()) and (is_stem or end + 1 == len(text) or not text[end + 1].isalpha()):
                    yield at, weight


def clause_scores(text: str | None, lexicon: Lexicon, machine: Transducer, threats: Lexicon, classes: dict[str, str]) -> list[float]:
    """Weights of the matched clauses.  Words are read from the clause ends around each find, so the whole text counts."""
    lower = (text or "").lower()
    hits: dict[int, float] = {}
    for at, weight in lexicon.find(lower):
        hits[at] = max(weight, hits.get(at, -math.inf))
    places = sorted({*hits, *(at for at, _ in threats.find(lower))})
    out, done = [], -1
    for place in places:
        if place < done:
            continue
        begin = max(lower.rfind(x, max(0, place - _AROUND), place) for x in ".!?;:\n")
        state, score, matched = machine.start, 0.0, False
        for m in _WORD.finditer(lower, max(begin + 1, done, 0)):
            done = m.end()
            word = m.group()
            if word in ".!?;:\n":
                if m.start() > place:
                    break
                symbol = "|"
            elif m.start() in hits:
                symbol = "i"
            else:
                symbol = "r" if word in "\"“”«»" else classes.get(word, "o")
            state, written, weight = machine.step(state, symbol)
            score += weight + (hits[m.start()] if written == "I" else 0.0)
            matched |= written in "IH"
        if matched:
            out.append(score)
    return out


def word_classes() -> dict[str, str]:
    return {w: s for words, s in ((THREATS, "h"), (REPORTS, "r"), (NEGATIONS, "n"), (TARGETS, "t")) for w in words}


def _terms(text: str | None) -> set[str]:
    words = set(_LETTERS.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in STEMS if len(w) >= n}


@dataclass
class Model:
    """Lexicon weights, and log odds of a toxic document with and without a matched clause."""

    terms: dict[str, float]
    matched: float
    bare: float


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A lexicon that covers the toxic documents of a bounded sample of the labelled rows that are not held out.

    Of the terms that are pure and frequent enough, the one that covers most toxic documents not yet covered (less a
    cost for clean ones) is taken, again and again; ties go to the longer term, then by name.  Pure terms that are common among toxic documents follow.
    Documents that resemble one another (the smallest word hash is equal) count once, so words of one text and its
    copies make no lexicon.  Rows with a null label are no labels, and an id with both labels
    counts as toxic.  Without toxic rows the lexicon is empty and every score is the same low one.
    """
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = F.broadcast(some(usable, "doc_id", sample))
    toxic = usable.join(ids, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = checkpointed(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(toxic), "doc_id"))
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    if not n_toxic:
        return Model({}, 0.0, math.log(0.5 / (n_clean + 0.5)))
    least = max(LEAST_DOCS, int(LEAST_PART * n_toxic))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, text in batch[["doc_id", "text"]].itertuples(index=False, name=None):
                terms = _terms(text)
                sketch = min(map(zlib.crc32, (x.encode("utf-8", "surrogatepass") for x in terms)), default=0)
                yield pd.DataFrame({"term": list(terms)}).assign(doc_id=doc_id, sketch=sketch)

    spelled = checkpointed(rows.where("toxic = 1").mapInPandas(spell, "term string, doc_id long, sketch long"))
    counted = spelled.groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("sketch").alias("kinds"))
    frequent = counted.where(F.col("kinds") >= least).orderBy(F.desc("kinds"), "term").limit(CANDIDATES).collect()
    in_toxic, kinds = ({r["term"]: r[x] for r in frequent} for x in ("n", "kinds"))
    names = set(in_toxic)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                found.update(_terms(text) & names)
        yield pd.DataFrame({"term": list(found), "n": list(found.values())}).astype({"term": "object", "n": "int64"})

    clean = rows.where("toxic = 0").select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    in_clean = Counter({r["term"]: r["n"] for r in clean.collect()})
    pure = {t: k for t, k in in_toxic.items() if k >= PURITY * (k + in_clean[t])}
    covers: dict[str, set] = {t: set() for t in pure}
    chosen = spelled.join(F.broadcast(spelled.sparkSession.createDataFrame([(t,) for t in pure], "term string")), "term")
    for r in chosen.groupBy("term").agg(F.collect_set("doc_id").alias("ids")).toLocalIterator():
        covers[r["term"]] = set(r["ids"])
    terms: dict[str, float] = {}
    odds = math.log(n_toxic + 0.5) - math.log(n_clean + 0.5)
    covered: set = set()
    while covers and len(terms) < TERMS:
        best = max(covers, key=lambda t: (len(covers[t]) - CLEAN_COST * in_clean[t], len(t), t))
        gain = covers.pop(best)
        if len(gain) < least:
            break
        terms[best] = math.log(in_toxic[best] + 0.5) - math.log(in_clean[best] + 0.5) - odds
        covered |= gain
        covers = {t: left for t, ids in covers.items() if (left := ids - gain)}
    common = max(COMMON_DOCS, COMMON_PART * n_toxic)
    for t in sorted((t for t in pure if kinds[t] >= common), key=lambda t: (-kinds[t], -len(t), t)):
        if len(terms) < TERMS and not any(t.rstrip("*").startswith(x.rstrip("*")) or x.startswith(t.rstrip("*")) for x in terms):
            terms[t] = math.log(in_toxic[t] + 0.5) - math.log(in_clean[t] + 0.5) - odds
    hit_clean = max((in_clean[t] for t in terms), default=0)
    return Model(terms, odds, math.log(n_toxic - len(covered) + 0.5) - math.log(max(0, n_clean - hit_clean) + 0.5))


def with_toxicity(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``into``: score (0 to 1, higher: likelier toxic), predicted (score at least 0.7) and n_clauses.

    The best clause counts whole, each further one three tenths.  Null and empty texts have no clause and the score
    of a document without one.  Each row is scored on its own, from its text alone.
    """
    threats = {w: 0.0 for w in THREATS}

    @F.pandas_udf("score double, n_clauses long")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lexicon, machine, harm, classes = Lexicon(model.terms), grammar(), Lexicon(threats), word_classes()
        for texts in batches:
            rows = []
            for text in texts:
                clauses = sorted(clause_scores(text, lexicon, machine, harm, classes), reverse=True)
                logit = model.matched + clauses[0] + 0.3 * sum(max(0.0, x) for x in clauses[1:]) if clauses else model.bare
                rows.append((1 / (1 + math.exp(-max(-700.0, min(700.0, logit)))), len(clauses)))
            yield pd.DataFrame(rows, columns=["score", "n_clauses"])

    scored = docs.withColumn(into, measure("text"))
    return scored.withColumn(into, F.col(into).withField("predicted", (F.col(into)["score"] >= THRESHOLD).cast("int")))
