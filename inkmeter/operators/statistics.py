"""Statistical features of a document (layer 2, first half).

Two sources: numbers that come from the document's own row alone, and numbers
over its sentences.  The sentence part is summed up per document with a partial
aggregate in the reading task, so what is shuffled is one small row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import (
    array_mean,
    array_var_pop,
    count_total,
    entropy,
    let,
    run_lengths,
    total,
)
from ..functions.scalar import ratio
from ..profiles import Profile
from .counting import character_measures, token_measures, word_repeats
from .grams import gram_measures
from .segment import measured, normalized, segmented, sentence_table, staged

def char_ngram_features(docs: DataFrame) -> DataFrame:
    """Type/token ratios, entropy and repeat share of character trigrams, ratio of 4-grams."""
    counted = normalized(docs).select("doc_id", gram_measures(F.col("norm")).alias("grams"))
    return counted.select("doc_id", *ngram_columns(F.col("grams")))


def ngram_columns(g: Column) -> list[Column]:
    return [
        g["tri_total"].cast("long").alias("tri_total"),
        g["tri_distinct"].cast("long").alias("tri_distinct"),
        ratio(g["tri_distinct"], g["tri_total"], 1.0).alias("tri_ttr"),
        g["tri_entropy"].alias("tri_entropy"),
        ratio(g["tri_repeated"], g["tri_total"], 0.0).alias("repeat_ratio"),
        ratio(g["quad_distinct"], g["quad_total"], 1.0).alias("quad_ttr"),
    ]


def window_uniformity(docs: DataFrame) -> DataFrame:
    """How much the bigram entropy varies over the windows of a text."""
    counted = normalized(docs).select("doc_id", gram_measures(F.col("norm")).alias("grams"))
    return counted.select("doc_id", F.col("grams.n_chars").cast("long").alias("n_chars"), F.col("grams.uniformity").alias("uniformity"))


def lexical_columns(total: Column, types: Column, variance: Column) -> list[Column]:
    """From the number of a document's tokens and of their kinds, and the variance of their counts."""
    diversity = ratio(types, total, 0.0)
    return [
        total.cast("long").alias("n_tokens"),
        types.cast("long").alias("n_types"),
        diversity.alias("lexical_diversity"),
        F.when(types > 0, -F.log(diversity + F.lit(1e-6))).otherwise(F.lit(0.0)).alias("perplexity_estimate"),
        variance.alias("freq_variance"),
    ]


def token_stages(p: Profile, pairs: bool = True) -> list[dict[str, Column]]:
    """Steps from ``sents`` to the counts of their tokens; without ``pairs`` the sums over all sentence pairs are left out."""
    units = () if p.function_by_char else p.function_units
    tokens = F.transform("sents", lambda s: T.tokens(s, p))
    return [{"tokens": tokens}, {"counted": token_measures(F.col("tokens"), units, pairs)}]


def zipf_fit(counts: Column) -> Column:
    """struct<alpha, deviation> of the rank/frequency line of token counts.

    Equal counts may take their ranks in any order: the fit sees the same pairs.
    """

    def fit(ys: Column) -> Column:
        n = F.size(ys)
        ranked = F.transform(ys, lambda c, i: F.struct(F.log((i + 1).cast("double")).alias("x"), F.log(c + F.lit(1.0)).alias("y")))
        slope = let(
            ranked,
            lambda r: let(
                F.struct((total(r, lambda v: v["x"]) / n).alias("x"), (total(r, lambda v: v["y"]) / n).alias("y")),
                lambda m: total(r, lambda v: (v["x"] - m["x"]) * (v["y"] - m["y"]))
                / total(r, lambda v: (v["x"] - m["x"]) * (v["x"] - m["x"])),
            ),
        )
        return let(slope, lambda s: F.struct((-s).alias("alpha"), let(_usable_alpha(-s), lambda a: deviation(ys, a)).alias("deviation")))

    def deviation(ys: Column, alpha: Column) -> Column:
        raw = F.transform(ys, lambda c, i: F.pow((i + 1).cast("double"), -alpha))
        return let(
            raw,
            lambda w: let(
                count_total(ys) / total(w),
                lambda scale: total(
                    F.transform(ys, lambda c, i: (c - F.get(w, i) * scale) * (c - F.get(w, i) * scale) / (F.get(w, i) * scale + F.lit(1e-6)))
                )
                / F.size(ys),
            ),
        )

    none = F.struct(F.lit(0.0).alias("alpha"), F.lit(0.0).alias("deviation"))
    return F.when(F.size(counts) >= 2, let(F.sort_array(counts, asc=False), fit)).otherwise(none)


def _usable_alpha(alpha: Column) -> Column:
    """A flat line has no usable exponent and falls back to 1."""
    return F.when(F.abs(alpha) < 1e-12, F.lit(1.0)).otherwise(alpha)


def token_statistics(docs: DataFrame, p: Profile) -> DataFrame:
    """Lexical diversity, frequency variance and the Zipf fit of a document's tokens."""
    counted = normalized(docs).select("doc_id", run_lengths(T.tokens(F.col("norm"), p)).alias("tok"))
    tok = F.col("tok")
    return counted.select("doc_id", *lexical_columns(count_total(tok), F.size(tok), array_var_pop(tok)), zipf_fit(tok).alias("zipf"))


def punctuation_counts(text: Column, p: Profile) -> list[tuple[str, Column]]:
    """Marks of each class; needs ``characters``."""
    long_runs = T.count_regex(text, p.ellipsis_long)
    counts = [(name, F.get(F.col("characters.marks"), F.lit(i))) for i, (name, _) in enumerate(p.punctuation)]
    counts.insert(6, ("ellipsis", F.when(long_runs > 0, long_runs).otherwise(T.count_regex(text, p.ellipsis_short))))
    counts.insert(7, ("dash", T.count_regex(text, p.dash_regex)))
    return counts


def punctuation_columns(counts: Column) -> list[Column]:
    """From an array of the ten class counts, comma first and period second."""
    comma, period, ellipsis, dash = (F.get(counts, F.lit(i)) for i in (0, 1, 6, 7))

    def measured(n: Column) -> Column:
        used = F.filter(counts, lambda c: c > 0)
        return F.struct(
            F.least((comma + 1) / (period + 1) / 8, F.lit(1.0)).alias("comma_period"),
            (1 / (1 + ellipsis / n * 50)).alias("ellipsis_score"),
            (1 / (1 + dash / n * 50)).alias("dash_score"),
            F.when(F.size(used) > 1, -total(used, lambda c: c / n * F.log(c / n))).otherwise(F.lit(0.0)).alias("punct_entropy"),
            F.least(comma / n * 1.5, F.lit(1.0)).alias("comma_share"),
        )

    return [let(F.greatest(count_total(counts), F.lit(1)), measured).alias("punct")]


def punctuation_profile(docs: DataFrame, p: Profile) -> DataFrame:
    counts = punctuation_counts(F.col("norm"), p)
    counted = staged(normalized(docs), character_stage(p)).select("doc_id", F.array(*(c for _, c in counts)).alias("marks"))
    named = [F.get("marks", F.lit(i)).cast("long").alias(f"n_{name}") for i, (name, _) in enumerate(counts)]
    return counted.select("doc_id", *named, *punctuation_columns(F.col("marks"))).select(
        "doc_id", *(f"n_{name}" for name, _ in counts), "punct.*"
    )


def function_hits(text: Column, p: Profile) -> Column:
    """Every function character (or word) of a text, in order."""
    if p.function_by_char:
        return F.regexp_extract_all(text, F.lit("[" + "".join(p.function_units) + "]"), F.lit(0))
    return F.filter(T.tokens(text, p), lambda t: t.isin(*p.function_units))


def function_columns(hits: Column, n_chars: Column) -> list[Column]:
    return function_shares(F.size(hits), F.size(F.array_distinct(hits)), n_chars)


def function_shares(n: Column, kinds: Column, n_chars: Column) -> list[Column]:
    return [
        n.cast("long").alias("function_hits"),
        ratio(n, n_chars, 0.0).alias("function_density"),
        let(kinds, lambda k: F.when(n > 0, k / F.least(n, k * 3)).otherwise(F.lit(0.0))).alias("function_diversity"),
    ]


def function_words(docs: DataFrame, p: Profile) -> DataFrame:
    counted = normalized(docs).select(
        "doc_id", function_hits(F.col("norm"), p).alias("hits"), F.length(T.compact(F.col("norm"))).alias("n_chars")
    )
    return counted.select("doc_id", *function_columns(F.col("hits"), F.col("n_chars")))


def opener_diversity(sentences: Column, p: Profile) -> Column:
    """Share of distinct sentence beginnings (three characters)."""
    starts = F.filter(
        F.transform(
            sentences, lambda s: F.left(F.regexp_replace(F.regexp_replace(s, p.opener_strip, ""), p.closer_strip, ""), F.lit(3))
        ),
        lambda s: F.length(s) >= 2,
    )
    share = let(starts, lambda x: F.when(F.size(x) < 3, F.lit(1.0)).otherwise(F.size(F.array_distinct(x)) / F.size(x)))
    return F.when(F.size(sentences) < 4, F.lit(1.0)).otherwise(share)


def initial_diversity(docs: DataFrame, p: Profile) -> DataFrame:
    cut = normalized(docs).select("doc_id", T.sentences(F.col("norm"), p).alias("sents"))
    return cut.select("doc_id", F.size("sents").cast("long").alias("n_sentences"), opener_diversity(F.col("sents"), p).alias("initial_diversity"))


def character_stage(p: Profile) -> dict[str, Column]:
    return {"characters": character_measures(F.col("norm"), tuple(chars for _, chars in p.punctuation), p.unique_drop)}


def unique_ratio(docs: DataFrame, p: Profile) -> DataFrame:
    found = staged(normalized(docs), character_stage(p))
    return found.select("doc_id", ratio(F.col("characters.kinds"), F.col("characters.total"), 0.0).alias("unique_ratio"))


def word_ngram_repeat(docs: DataFrame, p: Profile) -> DataFrame:
    words = normalized(docs).select("doc_id", T.pseudo_words(F.col("norm"), p).alias("words"))
    shares = words.withColumn("repeats", word_repeats(F.col("words")))
    return shares.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.col("repeats.bigrams").alias("bigram_repeat"),
        F.col("repeats.trigrams").alias("trigram_repeat"),
    )


def sentence_measures(docs: DataFrame, p: Profile) -> DataFrame:
    """One row per sentence: length, tokens, entropy and punctuation density."""
    counted = sentence_table(docs, p).select(
        "doc_id",
        "sent_idx",
        "text",
        "n_chars",
        run_lengths(T.tokens(F.col("text"), p)).alias("tok"),
        T.count_regex(F.col("text"), p.complexity_class).alias("marks"),
    )
    sized = counted.withColumn("n_tokens", count_total(F.col("tok")))
    return sized.select(
        "doc_id",
        "sent_idx",
        "text",
        "n_chars",
        "n_tokens",
        entropy(F.col("tok"), F.col("n_tokens")).alias("entropy"),
        (F.col("marks") / F.greatest("n_tokens", F.lit(1))).alias("complexity"),
        F.when(F.col("n_tokens") > 0, F.col("n_tokens")).otherwise(F.col("n_chars")).alias("length"),
    )


def sentence_rows(sents: Column, p: Profile) -> Column:
    """array<struct> of the sentences' measures, inside the document's row; needs ``counted``."""
    counted = F.col("counted")

    def measure(text: Column, i: Column) -> Column:
        return let(
            F.get(counted["n_tokens"], i),
            lambda n: F.struct(
                F.length(text).alias("n_chars"),
                n.alias("n_tokens"),
                F.get(counted["entropy"], i).alias("entropy"),
                (T.count_regex(text, p.complexity_class) / F.greatest(n, F.lit(1))).alias("complexity"),
                F.when(n > 0, n).otherwise(F.length(text)).alias("length"),
            ),
        )

    return F.transform(sents, measure)


def sentence_columns() -> dict[str, Column]:
    """Per document over its sentence rows ``sent_rows``: entropies, burstiness, lengths (0 without sentences)."""
    n, rows = F.col("sent_rows.n_chars"), F.size("sent_rows")
    mean, spread = array_mean(n), F.sqrt(array_var_pop(n))
    length, complexity = F.col("sent_rows.length"), F.col("sent_rows.complexity")
    return {
        "entropy_mean": array_mean(F.col("sent_rows.entropy")),
        "entropy_variance": array_var_pop(F.col("sent_rows.entropy")),
        "burstiness": F.sqrt(array_var_pop(length) + array_var_pop(complexity)),
        "avg_length": array_mean(length),
        "avg_complexity": array_mean(complexity),
        "avg_chars": mean,
        "length_variation": spread / F.greatest(mean, F.lit(1.0)),
        "chars_std": F.when(rows >= 6, spread).otherwise(F.lit(0.0)),
        "chars_range": F.when(rows >= 6, F.array_max(n) - F.array_min(n)).otherwise(F.lit(0)).cast("long"),
        "chars_max": F.array_max(n).cast("long"),
        "chars_min": F.array_min(n).cast("long"),
    }


def sentence_statistics(docs: DataFrame, p: Profile) -> DataFrame:
    """Per document over its sentences; documents without a sentence have no row."""
    cut = staged(segmented(docs, p), *token_stages(p, pairs=False))
    rows = measured(cut, "doc_id", sentence_rows(F.col("sents"), p).alias("sent_rows")).where(F.size("sent_rows") > 0)
    measures = [col.alias(name) for name, col in sentence_columns().items()]
    return rows.select("doc_id", F.size("sent_rows").cast("long").alias("n_sentences"), *measures)


def document_stages(p: Profile) -> list[dict[str, Column]]:
    """Steps from ``norm`` and ``sents`` to the counts that the document's measures are made of, those of its tokens included."""
    norm = F.col("norm")
    marks = F.array(*(col for _, col in punctuation_counts(norm, p)))
    by_char = {"hits": function_hits(norm, p)} if p.function_by_char else {}
    tokens, counted = token_stages(p)
    return [tokens, {**counted, **character_stage(p), "grams": gram_measures(norm, p.terminators)}, {**by_char, "marks": marks, "sent_rows": sentence_rows(F.col("sents"), p)}]


def document_columns(p: Profile) -> list[Column]:
    chars, of_sentences, counted = F.col("grams.n_chars"), sentence_columns(), F.col("counted")
    functions = function_columns(F.col("hits"), chars) if p.function_by_char else function_shares(counted["function_hits"], counted["function_kinds"], chars)
    return [
        chars.cast("long").alias("word_count"),
        F.size("sents").cast("long").alias("n_sents"),
        *ngram_columns(F.col("grams")),
        *lexical_columns(counted["total"], counted["types"], counted["freq_variance"]),
        counted["deviation"].alias("zipf_deviation"),
        *punctuation_columns(F.col("marks")),
        *functions,
        opener_diversity(F.col("sents"), p).alias("initial_diversity"),
        F.col("grams.uniformity").alias("uniformity"),
        *(of_sentences[n].alias(n) for n in ("entropy_mean", "entropy_variance", "burstiness", "avg_length", "avg_chars", "length_variation")),
    ]
