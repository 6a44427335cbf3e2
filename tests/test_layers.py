import math
from collections import Counter

import pytest

from inkmeter.operators import consistency as CO
from inkmeter.operators import patterns as PA
from inkmeter.operators import selfmodel as SM
from inkmeter.operators import similarity as SI
from inkmeter.operators import statistics as ST
from inkmeter.profiles import LATIN, ZH

TEXTS = (
    "the cat sat on the mat. the cat sat. a dog ran! a dog ran! nothing shared here; on the mat the cat sat.",
    "x",
    "",
    "one two three. one two three. one two three. four five six. " * 6,
)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def bag(sentence):
    return Counter(w.strip(".!;").lower() for w in sentence.split() if w.strip(".!;"))


def cosine(a, b):
    return sum(a[t] * b[t] for t in a) / (math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values())))


def test_similarity_equals_all_pairs(docs):
    got = by_id(SI.similarity_measures(docs(*TEXTS), LATIN))
    for i, text in enumerate(TEXTS):
        bags = [bag(s) for s in text.replace("!", ".").replace(";", ".").split(".") if s.strip()]
        pairs = [cosine(a, b) for k, a in enumerate(bags) for b in bags[k + 1 :]]
        mean = sum(pairs) / len(pairs) if pairs else 0
        std = math.sqrt(sum((x - mean) ** 2 for x in pairs) / len(pairs)) if len(pairs) > 1 else 0
        assert got[i]["mean_similarity"] == pytest.approx(mean, abs=1e-9)
        assert got[i]["std_similarity"] == pytest.approx(std, abs=1e-6)
        assert got[i]["clustering"] == pytest.approx(sum(x > 0.48 for x in pairs) / len(pairs) if pairs else 0)


def test_pairs_of_a_long_text_without_blanks(docs):
    """Chinese: every character is a token, and common ones stand in most sentences."""
    words = "一不人大学生活时间工作问题世界"
    sentences = ["".join(words[(i * k + k) % len(words)] for k in range(2, 12)) for i in range(400)]
    row = SI.similarity_measures(docs("。".join(sentences) + "。"), ZH).first()
    bags = [Counter(x + "") for x in sentences]
    pairs = [cosine(a, b) for k, a in enumerate(bags) for b in bags[k + 1 :]]
    mean = sum(pairs) / len(pairs)
    assert row["clustering"] == pytest.approx(sum(x > 0.48 for x in pairs) / len(pairs))
    assert row["std_similarity"] == pytest.approx(math.sqrt(sum((x - mean) ** 2 for x in pairs) / len(pairs)), abs=1e-6)


def test_flat_regions(docs):
    rows = SI.flat_regions(docs("a b c. a b c. a b c. z. q r. q r."), LATIN).collect()
    assert sorted((r["first_sentence"], r["last_sentence"]) for r in rows) == [(0, 2), (4, 5)]


def test_char_ngram_features_by_hand(docs):
    row = ST.char_ngram_features(docs("aaaa")).first()
    assert (row["tri_total"], row["tri_distinct"], row["repeat_ratio"], row["quad_ttr"]) == (2, 1, 1.0, 1.0)
    empty = ST.char_ngram_features(docs("")).first()
    assert (empty["tri_ttr"], empty["tri_entropy"], empty["repeat_ratio"], empty["quad_ttr"]) == (1.0, 0.0, 0.0, 1.0)


def test_perplexity_by_hand(docs):
    text = "abcdef. abcdef. ghijkl. mnopqr."
    compact = text.replace(" ", "")
    grams = Counter(compact[i : i + 4] for i in range(len(compact) - 3))
    total = sum(grams.values())
    ppl = []
    for s in ("abcdef.", "abcdef.", "ghijkl.", "mnopqr."):
        logs = [math.log((grams[s[i : i + 4]] + 1) / (total + 256)) for i in range(len(s) - 3)]
        ppl.append(math.exp(-sum(logs) / len(logs)))
    row = SM.perplexity(docs(text), LATIN).first()
    assert row["n_usable"] == 4 and row["mean_perplexity"] == pytest.approx(sum(ppl) / 4)


def test_context_rules(docs):
    human = "他不是懒，而是他妈妈病了。"
    machine = "幸福不是拥有，而是价值的成长。"
    rows = by_id(PA.pattern_context(docs(human, machine, "比如赋能这个词。", "赋能产业升级"), ZH).where("pattern_id IN (1, 21)"))
    assert (rows[0]["n"], rows[0]["softened"]) == (1, 1)
    assert (rows[1]["n"], rows[1]["softened"]) == (1, 0)
    assert rows[2]["softened"] == 1 and rows[3]["softened"] == 0


def test_parallel_runs_count_at_three(docs):
    rows = by_id(PA.parallel_runs(docs("我们一起学习吧，我们一起运动吧，我们一起写作吧，我们一起唱歌吧。", "只有一句话而已。"), ZH))
    assert rows[0]["parallel_hits"] >= 1 and rows[1]["parallel_hits"] == 0


def test_phrases_listed_twice_count_twice(docs):
    assert PA.phrase_presence(docs("值得注意的是"), ZH).first()["n_phrases"] == 3  # twice, and a shorter one inside


def test_contradictions_stop_at_five(docs):
    text = "\n".join(["这很好"] * 4 + ["那很坏"] * 4)
    rows = sorted((r["from_para"], r["to_para"]) for r in CO.contradictions(docs(text), ZH).collect())
    assert rows == [(1, 5), (1, 6), (1, 7), (1, 8), (2, 5)]
    assert CO.consistency_scores(docs(text), ZH).first()["contradiction_count"] == 5


def test_redundant_evidence_count_equals_rows(docs):
    text = "\n".join(["数据和专家", "报告、数据、专家", "专家的报告和数据", "没有", "数据和专家"])
    rows = CO.redundant_evidence(docs(text), ZH).count()
    assert rows == 6 == CO.consistency_scores(docs(text), ZH).first()["redundancy_count"]


def test_consistency_cases(docs):
    rows = by_id(
        CO.consistency_scores(
            docs(
                "只有一个段落。",
                "工厂应该采用新的排产系统，交付会更准时。\n工厂不应该急着换系统，工人还没有培训。",
                "海底火山喷发时，岩浆遇到海水迅速冷却并堆积成枕状玄武岩地貌。\n外婆做红烧肉喜欢加两颗山楂，炖足三个钟头才肯掀锅盖尝味道。",
                "",
                "\n\n\n",
                "\n".join(f"短句{i}。" for i in range(50)),
            ),
            ZH,
        )
    )
    assert rows[0]["consistency_score"] == rows[3]["consistency_score"] == rows[4]["consistency_score"] == 0
    assert rows[1]["contradiction_count"] >= 1 and rows[2]["gap_count"] == 1 and rows[5]["n_paragraphs"] == 50


def test_no_sentence_goes_over_the_whole_text_again(docs):
    """What a sentence is compared with is computed once for its document, not inside the function over its sentences."""
    plan = SM.perplexity(docs(*TEXTS), LATIN)._jdf.queryExecution().optimizedPlan().toString()
    inner = plan.split("lambdafunction(EXP(")[1:]
    assert inner and all(part.startswith("(lambda") for part in inner)
