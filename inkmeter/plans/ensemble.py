"""Statistical score, similarity score and their ensemble, with confidence and the sentence heat map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.arrays import array_mean, let, positions
from ..functions.scalar import clamp, clip_text, r4, sigmoid
from ..operators.facts import document_facts
from ..operators.matching import Counts
from ..operators.segment import measured, normalized, segmented, staged, unnest
from ..operators.similarity import FLAT, similarity_of
from ..operators.statistics import document_columns, document_stages, function_shares, lexical_columns, ngram_columns, punctuation_columns, token_stages
from ..profiles import Profile
from ..profiles.params import STATISTICAL_WEIGHTS

TOP_SENTENCES = 20  # the heat map shows the twenty riskiest sentences


def statistical_components(f=F.col) -> dict[str, Column]:
    """FIXED VALUES: the shape of each component, by name of its weight."""
    one = F.lit(1.0)
    return {
        "entropy_var": one / (one + f("entropy_variance")),
        "burstiness": one / (one + f("burstiness") / 18),
        "zipf": one / (one + f("zipf_deviation") / 18),
        "perplexity": sigmoid(f("perplexity_estimate") - 0.7),
        "freq_var": one / (one + f("freq_variance")),
        "lexical_diversity": clamp(f("lexical_diversity") * 1.15, 0, 1),
        "tri_ttr": one - clamp(f("tri_ttr") * 1.1, 0, 0.95),
        "quad_ttr": one - clamp(f("quad_ttr") * 1.1, 0, 0.95),
        "repeat": sigmoid((f("repeat_ratio") - 0.15) * 5),
        "initial_diversity": one - clamp(f("initial_diversity"), 0, 1),
        "comma": F.when(f("punct.comma_share") > 0.55, sigmoid((f("punct.comma_share") - 0.4) * 4)).otherwise(F.lit(0.0)),
        "punct_entropy": F.when(f("punct.punct_entropy") > 0, one - sigmoid((f("punct.punct_entropy") - 0.8) * 2)).otherwise(F.lit(0.5)),
        "function": F.when(f("function_density") > 0.12, F.least((f("function_density") - 0.08) / 0.15, one)).otherwise(F.lit(0.0)),
        "uniformity": one - sigmoid((f("uniformity") - 0.15) * 4),
    }


def statistical_score() -> Column:
    parts = statistical_components()
    weighted = sum((parts[name] * w for name, w in STATISTICAL_WEIGHTS.items()), F.lit(0.0))
    return clamp(weighted / sum(STATISTICAL_WEIGHTS.values()), 0, 1)


def similarity_score() -> Column:
    """FIXED VALUES: weights of the similarity parts and the bonus for long flat regions."""
    regions = F.least(F.col("n_regions") / 3, F.lit(1.0))
    flat = clamp(regions * (1 + F.least(F.col("longest_region") / 5, F.lit(1.0)) * 0.3), 0, 1)
    parts = (
        sigmoid(F.col("mean_similarity") * 4 - 1.1) * 0.15
        + F.col("smoothness") * 0.15
        + flat * 0.12
        + (1 - clamp(F.col("similarity_diversity"), 0, 1)) * 0.04
        + F.col("clustering") * 0.04
    )
    return clamp(parts / 0.50, 0, 1)


def ensemble_stages(p: Profile, marked: dict[str, str] | None = None, counts: list[Counts] | None = None) -> list[dict[str, Column]]:
    """Steps from ``norm`` to ``facts`` and to whether the expressions of ``marked`` and the profile's two markers occur."""
    told, held = document_facts(F.col("norm"), p, {"human_marked": p.human_marker, "template_marked": p.template_marker, **(marked or {})}, counts)
    return [{"facts": told, "seen": T.match_text(F.col("norm"), p)}, held]


def ensemble_measures() -> list[Column]:
    f = F.col("facts")
    similar = similarity_of(f["n_sents"], f, f["cosine_variance"], f["n_regions"], f["longest_region"])
    return [
        f["n_chars"].cast("long").alias("word_count"),
        f["n_sents"].cast("long").alias("n_sents"),
        *ngram_columns(f),
        *lexical_columns(f["total"], f["types"], f["freq_variance"]),
        f["deviation"].alias("zipf_deviation"),
        *punctuation_columns(f["marks"]),
        *function_shares(f["function_hits"], f["function_kinds"], f["n_chars"]),
        *(f[n].alias(n) for n in ("initial_diversity", "uniformity", "entropy_mean", "entropy_variance", "burstiness", "avg_length", "avg_chars", "length_variation")),
        F.col("human_marked"),
        F.col("template_marked"),
        *(col.alias(name) for name, col in similar.items() if name not in ("n_sentences", "std_similarity")),
    ]


def with_ensemble(features: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Both scores, the ensemble, its confidence and interval.  Blank text gets the all-zero row."""
    blank = F.col("n_sents") == 0
    scores = {"statistical": statistical_score(), "similarity": similarity_score()}
    fused = features.withColumns({name: F.when(blank, F.lit(0.0)).otherwise(col) for name, col in scores.items()})
    for name, column in ensemble_columns(threshold):
        fused = fused.withColumn(name, column)
    zeroed = {name: F.when(blank, F.lit(0.0)).otherwise(F.col(name)) for name in ("overall", "confidence", "ci_lower", "ci_upper")}
    return fused.withColumns({**zeroed, "is_machine": F.col("is_machine") & ~blank}).drop("blend")


def statistical_scores(docs: DataFrame, p: Profile, keep: tuple[str, ...] = ()) -> DataFrame:
    features = measured(staged(segmented(docs, p, keep), *document_stages(p)), "doc_id", *keep, *document_columns(p))
    score = F.when(F.col("n_sents") > 0, statistical_score()).otherwise(F.lit(0.0))
    return features.withColumn("statistical", score)


def ensemble_columns(threshold: float = 0.5) -> list:
    """Steps of the fusion as (name, column); each may use the ones before.  FIXED VALUES: its constants."""
    c = F.col
    apart = F.abs(c("statistical") - c("similarity"))
    parts = F.array(c("statistical"), c("similarity"), c("overall"))
    mean = (c("statistical") + c("similarity") + c("overall")) / 3
    variance = F.aggregate(parts, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / 3
    half = F.sqrt(c("overall") * (1 - c("overall")) * 4) * (1 - c("confidence")) * 1.96
    return [
        (
            "blend",
            F.when(c("n_sents") <= 2, (c("statistical") * 0.82 + c("similarity") * 0.18) * 0.82).otherwise((c("statistical") + c("similarity")) / 2)
            - F.when(c("human_marked"), 0.05).otherwise(0.0)
            + F.when(c("template_marked"), 0.08).otherwise(0.0),
        ),
        ("overall", clamp(F.when(apart > 0.25, c("blend") * 0.95 + 0.025).otherwise(c("blend")), 0, 1)),
        ("confidence", clamp(clamp(1 / (1 + variance * 4), 0, 1) + F.abs(mean - 0.5) * 2 * 0.15, 0, 1)),
        ("ci_lower", clamp(c("overall") - half, 0, 1)),
        ("ci_upper", clamp(c("overall") + half, 0, 1)),
        ("is_machine", c("overall") > threshold),
        ("agreement", 1 - apart),
    ]


def ensemble_scores(docs: DataFrame, p: Profile, threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document, from one narrow pass."""
    return with_ensemble(measured(staged(normalized(docs, keep), *ensemble_stages(p)), "doc_id", *keep, *ensemble_measures()), threshold)


def ensemble_report(docs: DataFrame, p: Profile, threshold: float = 0.5) -> DataFrame:
    scores = ensemble_scores(docs, p, threshold)
    rounded = [r4(F.col(c)).alias(c) for c in ("statistical", "similarity", "overall", "confidence", "ci_lower", "ci_upper", "agreement")]
    return scores.select("doc_id", F.col("n_sents").cast("long").alias("n_sentences"), *rounded, "is_machine")


def _risk_tags(s: Column, flat: Column, mean_entropy: Column, p: Profile) -> Column:
    """FIXED VALUES: the seven sentence tags and their limits."""
    seen = T.match_text(s["text"], p)
    stripped = F.regexp_replace(s["text"], p.abstract_strip, "")
    tag = [
        (flat, "flat_logic"),
        (s["entropy"] < F.greatest(F.lit(1.3), mean_entropy * 0.55), "low_entropy"),
        (s["n_tokens"] < 8, "short_sentence"),
        (s["n_chars"] > 54, "long_template_sentence"),
        (F.rlike(seen, F.lit(p.template_marker)), "template_pattern"),
        ((s["n_chars"] > 8) & F.rlike(seen, F.lit(p.opener_regex)), "generic_opener"),
        (
            (F.length(stripped) > 15) & ~F.rlike(stripped, F.lit(r"\d")) & ~F.rlike(T.match_text(stripped, p), F.lit(p.concrete_word_regex)),
            "abstract_only",
        ),
    ]
    return F.array_compact(F.array(*(F.when(cond, F.lit(name)) for cond, name in tag)))


def _risk_value(n_chars: Column, tags: Column) -> Column:
    def if_tagged(name: str, points: float) -> Column:
        return F.when(F.array_contains(tags, name), points).otherwise(0.0)

    length = F.when(n_chars > 54, 0.18).when(n_chars < 12, 0.08).otherwise(0.0)
    return clamp(
        length
        + if_tagged("low_entropy", 0.20)
        + if_tagged("flat_logic", 0.28)
        + if_tagged("template_pattern", 0.32)
        + if_tagged("generic_opener", 0.12)
        + if_tagged("abstract_only", 0.14),
        0,
        1,
    )


def sentence_heatmap(docs: DataFrame, p: Profile) -> DataFrame:
    """The riskiest sentences of each document, highest risk first, text order among equals.

    A document's sentences are judged, sorted and cut to twenty inside its own
    row, so nothing is shuffled.
    """
    cut = normalized(docs).select("doc_id", T.sentences(F.col("norm"), p).alias("sents"))
    counted = F.col("counted")

    def measure(s: Column, i: Column) -> Column:
        return F.struct(
            s.alias("text"), F.length(s).alias("n_chars"), F.get(counted["n_tokens"], i).alias("n_tokens"), F.get(counted["entropy"], i).alias("entropy")
        )

    measured = staged(cut, *token_stages(p, pairs=False)).select(
        "doc_id", F.transform("sents", measure).alias("m"), counted["cosines"].alias("cosines")
    )

    def judged(i: Column, mean_entropy: Column) -> Column:
        s = F.get("m", i - 1)
        flat = F.coalesce(F.get("cosines", i - 2) > FLAT, F.lit(False)) | F.coalesce(F.get("cosines", i - 1) > FLAT, F.lit(False))
        return let(
            _risk_tags(s, flat, mean_entropy, p),
            lambda tags: let(
                _risk_value(s["n_chars"], tags),
                lambda risk: F.struct(
                    (-r4(risk)).alias("order"),
                    (i - 1).alias("sent_idx"),
                    clip_text(s["text"], 100).alias("text"),
                    r4(risk).alias("risk_score"),
                    F.concat_ws(",", tags).alias("risk_types"),
                    s["n_tokens"].alias("sentence_length"),
                    r4(1 - risk * 0.3).alias("confidence"),
                ),
            ),
        )

    judged_all = let(
        array_mean(F.transform("m", lambda s: s["entropy"])),
        lambda mean: F.transform(positions(F.size("m")), lambda i: judged(i, mean)),
    )
    top = F.slice(F.sort_array(F.filter(judged_all, lambda r: r["risk_score"] > 0.1)), 1, TOP_SENTENCES)
    rows = unnest(measured, ("doc_id",), top, "r", pos="rank")
    return rows.select(
        "doc_id",
        (F.col("rank") + 1).cast("long").alias("rank"),
        F.col("r.sent_idx").cast("long").alias("sent_idx"),
        F.col("r.text").alias("text"),
        F.col("r.risk_score").alias("risk_score"),
        F.col("r.risk_types").alias("risk_types"),
        F.col("r.sentence_length").cast("long").alias("sentence_length"),
        F.col("r.confidence").alias("confidence"),
    )
