"""FIXED VALUES: score parameters per article type and the cut-offs of the risk scale."""

from __future__ import annotations

# article type: baseline, pattern multiplier, concrete threshold, human multiplier, function-word threshold
TYPE_PARAMS = {
    "general": (8.0, 2.0, 1, 1.0, 0.13),
    "thesis": (10.0, 1.5, 0, 0.8, 0.15),
    "wechat": (6.0, 2.3, 2, 0.9, 0.12),
    "xiaohongshu": (4.0, 1.8, 1, 1.2, 0.11),
    "zhihu": (5.0, 2.1, 2, 1.0, 0.12),
}

# article type: multiplier of the pattern score; none for general text
SCENE_BOOST = {"thesis": 1.3, "wechat": 1.2, "xiaohongshu": 1.1, "zhihu": 1.25}

# Names under which the types are known in the source data.
TYPE_ALIASES = {
    "通用文本": "general",
    "论文/作业": "thesis",
    "公众号文章": "wechat",
    "小红书笔记": "xiaohongshu",
    "知乎": "zhihu",
    "口播脚本": "voice-over",
}

# article type: (short below, long above, short baseline step, narrative pattern factor, narrative human cap and factor,
#                argumentative pattern cap and factor, function threshold floor and step)
TYPE_TUNING = {
    "wechat": (600, 1600, 2.0, 0.72, 1.25, 1.2, 2.8, 1.12, 0.105, 0.008),
    "zhihu": (500, 2000, 1.0, 0.76, 1.2, 1.15, 2.6, 1.1, 0.108, 0.006),
}

# score from which the next rank starts (ranks 2 to 6); classes by rank
RISK_CUTS = (10, 30, 50, 70, 85)
RISK_CLASSES = ("low", "low", "medium", "high", "high", "high")

# deductions for concrete details: at least n hits, points
CONCRETE_LADDER = ((40, 18), (30, 14), (20, 10), (10, 7), (5, 4), (2, 2))

# component weights of the statistical score
STATISTICAL_WEIGHTS = {
    "entropy_var": 0.12,
    "burstiness": 0.14,
    "zipf": 0.07,
    "perplexity": 0.05,
    "freq_var": 0.05,
    "lexical_diversity": 0.12,
    "tri_ttr": 0.04,
    "quad_ttr": 0.02,
    "repeat": 0.03,
    "initial_diversity": 0.04,
    "comma": 0.02,
    "punct_entropy": 0.02,
    "function": 0.02,
    "uniformity": 0.03,
}
