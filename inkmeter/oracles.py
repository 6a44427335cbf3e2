"""SQL for the registered queries, written against the plain tables.

The SQL takes the direct way everywhere: it unnests the units, joins pairs and
groups, where the Spark jobs count inside rows.  The dictionaries are the same
fixed values.
"""

from __future__ import annotations

from .functions.text import MARKUP_STEPS, SPACE_STEPS
from .operators import patterns as PA
from .profiles import LATIN as P
from .profiles.base import WS_CHARS, WS_CLASS
from .profiles.params import CONCRETE_LADDER, RISK_CLASSES, RISK_CUTS, SCENE_BOOST, STATISTICAL_WEIGHTS, TYPE_PARAMS, TYPE_TUNING


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def r4(x: str) -> str:
    return f"floor(({x})*10000+0.5)/10000"


def rnd(x: str) -> str:
    return f"floor(({x})+0.5)"


def clamp(x: str, lo, hi) -> str:
    return f"greatest({lo}, least({hi}, {x}))"


def sigmoid(x: str) -> str:
    return f"(1/(1+exp(-({x}))))"


def sub(x: str, regex: str, to: str = "") -> str:
    return f"regexp_replace({x}, {lit(regex)}, {lit(to.replace('$1', chr(92) + '1'))}, 'g')"


def found(x: str, regex: str) -> str:
    return f"regexp_extract_all({x}, {lit(regex)})"


def count(x: str, regex: str) -> str:
    return f"len({found(x, regex)})"


def has(x: str, regex: str) -> str:
    return f"regexp_matches({x}, {lit(regex)})"


def trim(x: str) -> str:
    return f"trim({x}, {lit(WS_CHARS)})"


def normalize(x: str) -> str:
    for regex, to in MARKUP_STEPS + SPACE_STEPS:
        x = sub(x, regex, to)
    return trim(x)


def compact(x: str) -> str:
    return sub(x, f"[{WS_CLASS}]+")


def kept(items: str) -> str:
    return f"list_filter(list_transform({items}, lambda s: {trim('s')}), lambda s: s <> '')"


_MARKS = P.terminators.replace("\n", r"\n")
_ENDS = P.terminators.replace("\n", "")
SENTENCE = f"[^{_MARKS}]+[{_ENDS}]?"


def sentence_list(x: str) -> str:
    f = found(x, SENTENCE)
    return kept(f"CASE WHEN len({f}) > 0 THEN {f} ELSE [{x}] END")


def token_list(x: str) -> str:
    rest = f"string_split({sub(f'lower({x})', P.token_strip)}, '')"
    return f"list_filter(list_concat({found(f'lower({x})', P.word_regex)}, {rest}), lambda t: t <> '')"


def unnested(source: str, keys: str, items: str, pos: str, name: str) -> str:
    return (
        f"SELECT {keys}, i - 1 AS {pos}, l[i] AS {name} FROM (SELECT {keys}, l, unnest(range(1, len(l) + 1)) AS i "
        f"FROM (SELECT {keys}, {items} AS l FROM {source}))"
    )


def grams(x: str, n: int) -> str:
    return f"list_transform(range(1, greatest(length({x}) - {n - 1}, 0) + 1), lambda i: substring({x}, i, {n}))"


def regex_sum(x: str, regexes) -> str:
    return " + ".join(count(x, r) for r in regexes)


def signals(x: str, items) -> str:
    parts = []
    for s in items:
        if s.every:
            parts.append(f"{count(x, s.regex)} * {s.weight}")
        elif s.at_least > 1:
            parts.append(f"CASE WHEN {count(x, s.regex)} >= {s.at_least} THEN {s.weight} ELSE 0 END")
        else:
            parts.append(f"CASE WHEN {has(x, s.regex)} THEN {s.weight} ELSE 0 END")
    return " + ".join(parts)


def values(rows) -> str:
    def one(v):
        return "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)

    return "VALUES " + ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)


def parallel(x: str) -> str:
    """Runs of equal starts or shapes over the clause list of ``x``."""
    clauses = f"list_filter(list_transform(regexp_split_to_array({x}, {lit(P.parallel_break)}), lambda k: {trim('k')}), lambda k: length(k) >= 6)"
    start = "list_transform(cl, lambda k: left(k, 2))"
    shape = f"list_transform(cl, lambda k: left(regexp_replace({sub('k', P.shape_drop)}, '\\d+', '0', 'g'), 4))"
    thirds = (
        "len(list_filter(range(3, len(ks) + 1), lambda i: ks[i] = ks[i-1] AND ks[i-1] = ks[i-2] AND (i = 3 OR ks[i-3] <> ks[i-2])))"
    )
    runs = f"list_sum(list_transform([{clauses}], lambda cl: list_sum(list_transform([{start}, {shape}], lambda ks: {thirds}))))"
    return f"{runs}::BIGINT + {regex_sum(x, P.parallel_regexes)}"


def risk_rank(x: str) -> str:
    return "(1 + " + " + ".join(f"CASE WHEN {x} >= {cut} THEN 1 ELSE 0 END" for cut in RISK_CUTS) + ")"


def by_rank(rank: str, names) -> str:
    return f"([{', '.join(lit(n) for n in names)}])[{rank}]"


_PATTERN_ROWS = [(x.pattern_id, x.label, x.category, x.weight, x.regex, x.context_rule, PA.soft_weight(x)) for x in P.patterns]
_N = len(P.patterns)
_FUNCTIONS = "(" + ", ".join(lit(w) for w in P.function_units) + ")"
_SEEN = "lower(norm)"


def _unit_hits(source: str, keys: str, text: str) -> str:
    """Dictionary hits of the units in ``source`` without context rules."""
    on = f"lower({text})"
    phrases = " + ".join(f"CAST(contains({on}, {lit(w)}) AS INT)" for w in P.phrases)
    counts = [count(on, x.regex) for x in P.patterns] + [phrases, parallel(text)]
    return (
        f"SELECT {keys}, pattern_id, label, category, weight, n FROM (SELECT {keys}, unnest([{', '.join(counts)}]) AS n, "
        f"unnest(range(1, {_N + 3})) AS pattern_id FROM {source}) JOIN kinds USING (pattern_id) WHERE n > 0"
    )


def _punct_counts() -> list[tuple[str, str]]:
    out = [(name, f"(length(norm) - length(translate(norm, {lit(chars)}, '')))") for name, chars in P.punctuation]
    long, short = count("norm", P.ellipsis_long), count("norm", P.ellipsis_short)
    out.insert(6, ("ellipsis", f"(CASE WHEN {long} > 0 THEN {long} ELSE {short} END)"))
    out.insert(7, ("dash", count("norm", P.dash_regex)))
    return out


_PUNCT = _punct_counts()
_PUNCT_TOTAL = "greatest(" + " + ".join(f"n_{n}" for n, _ in _PUNCT) + ", 1)"
_PUNCT_ENTROPY = " + ".join(f"CASE WHEN n_{n} > 0 THEN n_{n}/t*ln(n_{n}/t) ELSE 0 END" for n, _ in _PUNCT)
_PUNCT_USED = " + ".join(f"CASE WHEN n_{n} > 0 THEN 1 ELSE 0 END" for n, _ in _PUNCT)
_OPENER = "left(" + sub(sub("text", P.opener_strip), P.closer_strip) + ", 3)"
_PPL_TERM = "ln(coalesce(f, 0) + 1.0)"

CTES: dict[str, str] = {
    "docs": f"SELECT doc_id, {normalize('norm1')} AS norm FROM (SELECT doc_id, {normalize(chr(99) + 'oalesce(text, ' + lit('') + ')')} AS norm1 FROM documents)",
    "sents": unnested("docs", "doc_id", sentence_list("norm"), "sent_idx", "text"),
    "paras": unnested("docs", "doc_id", kept("regexp_split_to_array(norm, '\\n+')"), "para_idx", "text"),
    "rawparas": unnested("docs", "doc_id", "list_filter(regexp_split_to_array(norm, '\\n+'), lambda s: s <> '')", "para", "text"),
    "clauses": unnested("docs", "doc_id", kept(f"regexp_split_to_array(norm, {lit(P.clause_regex)})"), "clause_idx", "text"),
    "stoks": f"SELECT doc_id, sent_idx, token, count(*) AS cnt FROM (SELECT doc_id, sent_idx, unnest({token_list('text')}) AS token FROM sents) GROUP BY ALL",
    "dtoks": f"SELECT doc_id, token, count(*) AS cnt FROM (SELECT doc_id, unnest({token_list('norm')}) AS token FROM docs) GROUP BY ALL",
    "cdocs": f"SELECT doc_id, norm, {compact('norm')} AS c FROM docs",
    "g3": f"SELECT doc_id, gram, count(*) AS cnt FROM (SELECT doc_id, unnest({grams('c', 3)}) AS gram FROM cdocs) GROUP BY ALL",
    "g4": f"SELECT doc_id, gram, count(*) AS cnt FROM (SELECT doc_id, unnest({grams('c', 4)}) AS gram FROM cdocs) GROUP BY ALL",
    "ngram": """SELECT d.doc_id, coalesce(n3, 0) AS tri_total, coalesce(k3, 0) AS tri_distinct, coalesce(k3::DOUBLE / n3, 1) AS tri_ttr,
        coalesce(e3, 0) AS tri_entropy, coalesce(r3::DOUBLE / n3, 0) AS repeat_ratio, coalesce(k4::DOUBLE / n4, 1) AS quad_ttr FROM docs d
        LEFT JOIN (SELECT doc_id, sum(cnt) AS n3, count(*) AS k3, sum(CASE WHEN cnt > 1 THEN cnt ELSE 0 END) AS r3,
            -sum(cnt / n * ln(cnt / n + 1e-10)) AS e3 FROM (SELECT *, sum(cnt) OVER (PARTITION BY doc_id) AS n FROM g3) GROUP BY doc_id) a USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(cnt) AS n4, count(*) AS k4 FROM g4 GROUP BY doc_id) b USING (doc_id)""",
    "windows": """SELECT doc_id, len0, w, substring(c, (w * size + 1)::BIGINT, size::BIGINT) AS t FROM (
        SELECT doc_id, c, len0, k, ceil(len0 / k) AS size, unnest(range(k)) AS w FROM (
            SELECT doc_id, c, length(c) AS len0, least(6, greatest(4, length(c) // 40)) AS k FROM cdocs WHERE length(c) >= 60))""",
    "uniform": f"""SELECT d.doc_id, length(c) AS n_chars, coalesce(u, 1.0) AS uniformity FROM cdocs d LEFT JOIN (
        SELECT doc_id, CASE WHEN avg(e) = 0 THEN 1.0 ELSE least(stddev_pop(e) / avg(e) * 3, 1.0) END AS u FROM (
            SELECT doc_id, w, -sum(cnt / n * ln(cnt / n + 1e-10)) AS e FROM (
                SELECT *, sum(cnt) OVER (PARTITION BY doc_id, w) AS n FROM (
                    SELECT doc_id, w, gram, count(*) AS cnt FROM (SELECT doc_id, w, unnest({grams('t', 2)}) AS gram FROM windows) GROUP BY ALL))
            GROUP BY doc_id, w) GROUP BY doc_id) USING (doc_id)""",
    "lexical": """SELECT d.doc_id, coalesce(n, 0) AS n_tokens, coalesce(k, 0) AS n_types, coalesce(k::DOUBLE / n, 0) AS lexical_diversity,
        coalesce(-ln(k::DOUBLE / n + 1e-6), 0) AS perplexity_estimate, CASE WHEN k >= 2 THEN v ELSE 0 END AS freq_variance
        FROM docs d LEFT JOIN (SELECT doc_id, sum(cnt) AS n, count(*) AS k, var_pop(cnt) AS v FROM dtoks GROUP BY doc_id) USING (doc_id)""",
    "zipfrank": "SELECT doc_id, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC) AS rk, count(*) OVER (PARTITION BY doc_id) AS k FROM dtoks",
    "zipf": """SELECT d.doc_id, coalesce(alpha, 0) AS alpha, coalesce(deviation, 0) AS deviation FROM docs d LEFT JOIN (
        SELECT doc_id, any_value(alpha) AS alpha, sum((cnt - w / ws * n) * (cnt - w / ws * n) / (w / ws * n + 1e-6)) / count(*) AS deviation FROM (
            SELECT *, sum(w) OVER (PARTITION BY doc_id) AS ws, sum(cnt) OVER (PARTITION BY doc_id) AS n FROM (
                SELECT doc_id, cnt, alpha, pow(rk, -CASE WHEN abs(alpha) < 1e-12 THEN 1.0 ELSE alpha END) AS w FROM zipfrank JOIN (
                    SELECT doc_id, -regr_slope(ln(cnt + 1.0), ln(rk)) AS alpha FROM zipfrank WHERE k >= 2 GROUP BY doc_id) USING (doc_id)))
        GROUP BY doc_id) USING (doc_id)""",
    "punctn": "SELECT doc_id, " + ", ".join(f"{x} AS n_{n}" for n, x in _PUNCT) + " FROM docs",
    "punct": f"""SELECT doc_id, {', '.join('n_' + n for n, _ in _PUNCT)}, least((n_comma + 1) / (n_period + 1) / 8, 1) AS comma_period,
        1 / (1 + n_ellipsis / t * 50) AS ellipsis_score, 1 / (1 + n_dash / t * 50) AS dash_score,
        CASE WHEN {_PUNCT_USED} > 1 THEN -({_PUNCT_ENTROPY}) ELSE 0.0 END AS punct_entropy, least(n_comma / t * 1.5, 1) AS comma_share
        FROM (SELECT *, {_PUNCT_TOTAL} AS t FROM punctn)""",
    "func": f"""SELECT d.doc_id, coalesce(n, 0) AS function_hits, CASE WHEN length(c) > 0 THEN coalesce(n, 0)::DOUBLE / length(c) ELSE 0 END AS function_density,
        CASE WHEN n > 0 THEN k / least(n, k * 3) ELSE 0 END AS function_diversity FROM cdocs d LEFT JOIN (
        SELECT doc_id, sum(cnt) AS n, count(*) AS k FROM dtoks WHERE token IN {_FUNCTIONS} GROUP BY doc_id) USING (doc_id)""",
    "opener": f"""SELECT d.doc_id, coalesce(ns, 0) AS n_sentences, CASE WHEN ns >= 4 AND k >= 3 THEN u / k ELSE 1.0 END AS initial_diversity
        FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS ns, count(*) FILTER (length(o) >= 2) AS k, count(DISTINCT o) FILTER (length(o) >= 2) AS u
        FROM (SELECT doc_id, {_OPENER} AS o FROM sents) GROUP BY doc_id) USING (doc_id)""",
    "uniq": f"""SELECT d.doc_id, coalesce(u, 0) AS unique_ratio FROM docs d LEFT JOIN (SELECT doc_id, count(DISTINCT ch) / count(*) AS u FROM (
        SELECT doc_id, unnest(string_split({sub('norm', P.unique_drop)}, '')) AS ch FROM docs) WHERE ch <> '' GROUP BY doc_id) USING (doc_id)""",
    "words": unnested("docs", "doc_id", f"list_filter(regexp_split_to_array({sub('norm', P.pseudo_break, ' ')}, {lit('[' + WS_CLASS + ']+')}), lambda w: w <> '')", "pos", "word"),
    "wordrep": """SELECT d.doc_id, coalesce(n, 0) AS n_words, CASE WHEN n >= 5 THEN r2 ELSE 0 END AS bigram_repeat, CASE WHEN n >= 6 THEN r3 ELSE 0 END AS trigram_repeat
        FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id) USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(CASE WHEN k > 1 THEN k ELSE 0 END) / sum(k) AS r2 FROM (SELECT doc_id, g, count(*) AS k FROM (
            SELECT doc_id, word || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM words) WHERE g IS NOT NULL GROUP BY ALL) GROUP BY doc_id) USING (doc_id)
        LEFT JOIN (SELECT doc_id, sum(CASE WHEN k > 1 THEN k ELSE 0 END) / sum(k) AS r3 FROM (SELECT doc_id, g, count(*) AS k FROM (
            SELECT doc_id, word || lead(word) OVER (PARTITION BY doc_id ORDER BY pos) || lead(word, 2) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM words)
            WHERE g IS NOT NULL GROUP BY ALL) GROUP BY doc_id) USING (doc_id)""",
    "smeas": f"""SELECT s.doc_id, s.sent_idx, s.text, length(s.text) AS n_chars, coalesce(n, 0) AS n_tokens, coalesce(e, 0.0) AS entropy,
        {count('s.text', P.complexity_class)} / greatest(coalesce(n, 0), 1) AS complexity, CASE WHEN n > 0 THEN n ELSE length(s.text) END AS len0
        FROM sents s LEFT JOIN (SELECT doc_id, sent_idx, sum(cnt) AS n, ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) AS e FROM stoks GROUP BY ALL) USING (doc_id, sent_idx)""",
    "sstat": """SELECT doc_id, count(*) AS n_sentences, avg(entropy) AS entropy_mean, var_pop(entropy) AS entropy_variance,
        sqrt(var_pop(len0) + var_pop(complexity)) AS burstiness, avg(len0) AS avg_length, avg(complexity) AS avg_complexity, avg(n_chars) AS avg_chars,
        stddev_pop(n_chars) / greatest(avg(n_chars), 1) AS length_variation, CASE WHEN count(*) >= 6 THEN stddev_pop(n_chars) ELSE 0 END AS chars_std,
        CASE WHEN count(*) >= 6 THEN max(n_chars) - min(n_chars) ELSE 0 END AS chars_range, max(n_chars) AS chars_max, min(n_chars) AS chars_min
        FROM smeas GROUP BY doc_id""",
    "norms": "SELECT doc_id, sent_idx, sum(cnt * cnt) AS sq FROM stoks GROUP BY ALL",
    "pairs": """SELECT doc_id, i, j, dot / (sqrt(a.sq) * sqrt(b.sq)) AS cosine FROM (
        SELECT x.doc_id, x.sent_idx AS i, y.sent_idx AS j, sum(x.cnt * y.cnt) AS dot FROM stoks x JOIN stoks y
        ON x.doc_id = y.doc_id AND x.token = y.token AND x.sent_idx < y.sent_idx GROUP BY ALL) p
        JOIN (SELECT doc_id, sent_idx AS i, sq FROM norms) a USING (doc_id, i) JOIN (SELECT doc_id, sent_idx AS j, sq FROM norms) b USING (doc_id, j)""",
    "consec": """SELECT s.doc_id, s.sent_idx AS i, coalesce(p.cosine, 0.0) AS cosine FROM sents s JOIN sents t ON s.doc_id = t.doc_id AND t.sent_idx = s.sent_idx + 1
        LEFT JOIN pairs p ON p.doc_id = s.doc_id AND p.i = s.sent_idx AND p.j = s.sent_idx + 1""",
    "flat": """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) - 1 AS region, min(i) AS first_sentence, max(i) + 1 AS last_sentence
        FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM consec WHERE cosine > 0.62) GROUP BY doc_id, grp""",
    "simil": """SELECT d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(s1 / np, 0) AS mean_similarity,
        CASE WHEN np > 1 THEN sqrt(greatest(s2 / np - (s1 / np) * (s1 / np), 0)) ELSE 0 END AS std_similarity,
        CASE WHEN np > 0 THEN 1 / (1 + coalesce(cs, 0)) ELSE 0 END AS smoothness, CASE WHEN np > 0 THEN 1 - s1 / np ELSE 0 END AS similarity_diversity,
        coalesce(cl / np, 0) AS clustering, coalesce(nr, 0) AS n_regions, coalesce(mr, 0) AS longest_region
        FROM docs d LEFT JOIN (SELECT doc_id, n, nullif(n * (n - 1) / 2, 0) AS np, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(cl, 0) AS cl FROM (
            SELECT doc_id, count(*) AS n FROM sents GROUP BY doc_id) LEFT JOIN (
            SELECT doc_id, sum(cosine) AS s1, sum(cosine * cosine) AS s2, count(*) FILTER (cosine > 0.48) AS cl FROM pairs GROUP BY doc_id) USING (doc_id)) USING (doc_id)
        LEFT JOIN (SELECT doc_id, stddev_pop(cosine) AS cs FROM consec GROUP BY doc_id) USING (doc_id)
        LEFT JOIN (SELECT doc_id, count(*) AS nr, max(last_sentence - first_sentence) AS mr FROM flat GROUP BY doc_id) USING (doc_id)""",
    "feats": """SELECT * FROM ngram JOIN uniform USING (doc_id) JOIN lexical USING (doc_id) JOIN (SELECT doc_id, deviation FROM zipf) USING (doc_id)
        JOIN (SELECT doc_id, punct_entropy, comma_share FROM punct) USING (doc_id) JOIN func USING (doc_id)
        JOIN (SELECT doc_id, initial_diversity FROM opener) USING (doc_id)
        LEFT JOIN (SELECT doc_id, n_sentences AS ns, entropy_variance, burstiness, avg_chars, length_variation FROM sstat) USING (doc_id)""",
}

_COMPONENTS = {
    "entropy_var": "1 / (1 + coalesce(entropy_variance, 0))",
    "burstiness": "1 / (1 + coalesce(burstiness, 0) / 18)",
    "zipf": "1 / (1 + deviation / 18)",
    "perplexity": sigmoid("perplexity_estimate - 0.7"),
    "freq_var": "1 / (1 + freq_variance)",
    "lexical_diversity": clamp("lexical_diversity * 1.15", 0, 1),
    "tri_ttr": "1 - " + clamp("tri_ttr * 1.1", 0, 0.95),
    "quad_ttr": "1 - " + clamp("quad_ttr * 1.1", 0, 0.95),
    "repeat": sigmoid("(repeat_ratio - 0.15) * 5"),
    "initial_diversity": "1 - initial_diversity",
    "comma": f"CASE WHEN comma_share > 0.55 THEN {sigmoid('(comma_share - 0.4) * 4')} ELSE 0 END",
    "punct_entropy": f"CASE WHEN punct_entropy > 0 THEN 1 - {sigmoid('(punct_entropy - 0.8) * 2')} ELSE 0.5 END",
    "function": "CASE WHEN function_density > 0.12 THEN least((function_density - 0.08) / 0.15, 1) ELSE 0 END",
    "uniformity": "1 - " + sigmoid("(uniformity - 0.15) * 4"),
}
_STAT = " + ".join(f"({_COMPONENTS[k]}) * {w}" for k, w in STATISTICAL_WEIGHTS.items())
_SIM = (
    f"({sigmoid('mean_similarity * 4 - 1.1')} * 0.15 + smoothness * 0.15 + "
    + clamp("least(n_regions / 3, 1) * (1 + least(longest_region / 5, 1) * 0.3)", 0, 1)
    + " * 0.12 + (1 - similarity_diversity) * 0.04 + clustering * 0.04) / 0.50"
)

CTES.update(
    {
        "stat": f"SELECT doc_id, coalesce(ns, 0) AS ns, n_chars AS words, CASE WHEN ns > 0 THEN {clamp(f'({_STAT}) / 0.77', 0, 1)} ELSE 0.0 END AS statistical FROM feats",
        "sim": f"SELECT doc_id, CASE WHEN n_sentences > 0 THEN {clamp(_SIM, 0, 1)} ELSE 0.0 END AS similarity FROM simil",
        "fused": f"""SELECT doc_id, ns, words, statistical, similarity, CASE WHEN ns <= 2 THEN (statistical * 0.82 + similarity * 0.18) * 0.82 ELSE (statistical + similarity) / 2 END
            - CASE WHEN {has(_SEEN, P.human_marker)} THEN 0.05 ELSE 0 END + CASE WHEN {has(_SEEN, P.template_marker)} THEN 0.08 ELSE 0 END AS blend
            FROM stat JOIN sim USING (doc_id) JOIN docs USING (doc_id)""",
        "over": f"SELECT *, {clamp('CASE WHEN abs(statistical - similarity) > 0.25 THEN blend * 0.95 + 0.025 ELSE blend END', 0, 1)} AS overall0, 1 - abs(statistical - similarity) AS agreement FROM fused",
        "conf": f"""SELECT *, {clamp(clamp('1 / (1 + v * 4)', 0, 1) + ' + abs(m - 0.5) * 2 * 0.15', 0, 1)} AS confidence0 FROM (
            SELECT *, ((statistical - m) * (statistical - m) + (similarity - m) * (similarity - m) + (overall0 - m) * (overall0 - m)) / 3 AS v
            FROM (SELECT *, (statistical + similarity + overall0) / 3 AS m FROM over))""",
        "ens": f"""SELECT doc_id, ns, words, statistical, similarity, agreement, CASE WHEN ns = 0 THEN 0.0 ELSE overall0 END AS overall,
            CASE WHEN ns = 0 THEN 0.0 ELSE confidence0 END AS confidence,
            CASE WHEN ns = 0 THEN 0.0 ELSE {clamp('overall0 - sqrt(overall0 * (1 - overall0) * 4) * (1 - confidence0) * 1.96', 0, 1)} END AS ci_lower,
            CASE WHEN ns = 0 THEN 0.0 ELSE {clamp('overall0 + sqrt(overall0 * (1 - overall0) * 4) * (1 - confidence0) * 1.96', 0, 1)} END AS ci_upper FROM conf""",
        "lexicon": f"SELECT * FROM ({values(_PATTERN_ROWS)}) t(pattern_id, label, category, weight, regex, rule, soft)",
        "kinds": f"SELECT pattern_id, label, category, weight FROM ({values([r[:4] for r in _PATTERN_ROWS] + [(_N + 1, P.phrase_label, P.phrase_category, PA.PHRASE_WEIGHT), (_N + 2, P.parallel_label, P.parallel_category, PA.PARALLEL_WEIGHT)])}) t(pattern_id, label, category, weight)",
        "hits": _unit_hits("docs", "doc_id", "norm"),
        "rulehits": """SELECT doc_id, pattern_id, rule, weight, soft, t, unnest(range(1, len(h) + 1)) AS k, h, s FROM (
            SELECT doc_id, pattern_id, rule, weight, soft, lower(norm) AS t, regexp_extract_all(lower(norm), regex) AS h,
                regexp_split_to_array(lower(norm), regex) AS s FROM docs, lexicon WHERE rule IS NOT NULL)""",
        "spans": """SELECT doc_id, pattern_id, rule, t, k, length(h[k]) AS len0, coalesce(list_sum(list_transform(s[1:k], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform(h[1:k-1], lambda x: length(x))), 0) AS st FROM rulehits""",
        "windowed": f"""SELECT doc_id, pattern_id, rule, substring(t, (st + len0 + 1)::BIGINT, 15) AS aft, substring(t, (greatest(st - 20, 0) + 1)::BIGINT, least(st, 20)::BIGINT) AS bef,
            substring(t, (st + 1)::BIGINT, 15) AS own, string_split(left(t, st::BIGINT), chr(10))[-1] AS lb, string_split(substring(t, (st + 1)::BIGINT), chr(10))[1] AS la,
            string_split(left(t, st::BIGINT), {lit(P.sentence_stop)})[-1] AS lead0, substring(t, (st + 1)::BIGINT) AS rest, len0 FROM spans""",
        "softened": f"""SELECT doc_id, pattern_id, rule, count(*) AS n, count(*) FILTER (soft) AS softened FROM (SELECT doc_id, pattern_id, rule, CASE WHEN rule = 'concept' THEN
            {has(trim('bef'), P.concept_question)} OR ({has('lb', PA.QUOTES)} AND {has('la', PA.QUOTES)}) OR {has('right(bef, 15) || own', P.concept_example)}
            ELSE CASE WHEN {has('aft', P.contrast_human)} AND NOT {has('aft', P.contrast_abstract)} THEN true
            WHEN {has('aft', P.contrast_abstract)} AND NOT {has('aft', P.contrast_human)} THEN false
            ELSE regexp_matches(lead0 || CASE WHEN contains(rest, {lit(P.sentence_stop)}) THEN string_split(rest, {lit(P.sentence_stop)})[1]
                WHEN contains(rest, chr(10)) THEN string_split(rest, chr(10))[1] ELSE left(rest, (len0 + 30)::BIGINT) END, {lit(P.contrast_person)}) END END AS soft FROM windowed)
            GROUP BY ALL""",
        "scored": """SELECT h.*, n * weight - coalesce(softened, 0) * (weight - coalesce(soft, weight)) AS score FROM hits h
            LEFT JOIN (SELECT doc_id, pattern_id, softened FROM softened) USING (doc_id, pattern_id) LEFT JOIN (SELECT pattern_id, soft FROM lexicon) USING (pattern_id)""",
        "gramdoc": "SELECT doc_id, sum(cnt) AS total FROM g4 GROUP BY doc_id",
        "sppl": f"""SELECT doc_id, sent_idx, exp(-avg({_PPL_TERM} - ln(total + 256.0))) AS perplexity FROM (
            SELECT doc_id, sent_idx, unnest({grams('c', 4)}) AS gram FROM (SELECT doc_id, sent_idx, {compact('text')} AS c FROM sents
                WHERE doc_id IN (SELECT doc_id FROM sents GROUP BY doc_id HAVING count(*) >= 4)) WHERE length(c) >= 5) s
            LEFT JOIN (SELECT doc_id, gram, cnt AS f FROM g4) USING (doc_id, gram) JOIN gramdoc USING (doc_id) GROUP BY doc_id, sent_idx""",
        "ppl": "SELECT doc_id, count(*) AS n_usable, avg(perplexity) AS mean_perplexity, stddev_pop(perplexity) AS std_perplexity FROM sppl GROUP BY doc_id",
        "keys": f"""SELECT DISTINCT doc_id, sent_idx, w FROM (SELECT doc_id, sent_idx, unnest(regexp_split_to_array({sub('lower(text)', P.keyword_break, ' ')}, {lit('[' + WS_CLASS + ']+')})) AS w FROM sents)
            WHERE length(w) >= 2 AND NOT contains({lit(P.keyword_stop_text)}, w)""",
        "keyn": "SELECT doc_id, sent_idx, count(*) AS k FROM keys GROUP BY ALL",
        "trans": """SELECT doc_id, count(*) AS n_transitions, avg(coalesce(c, 0) / (a.k + b.k - coalesce(c, 0))) AS mean_overlap FROM keyn a
            JOIN (SELECT doc_id, sent_idx - 1 AS sent_idx, k FROM keyn) b USING (doc_id, sent_idx)
            LEFT JOIN (SELECT x.doc_id, x.sent_idx, count(*) AS c FROM keys x JOIN keys y ON x.doc_id = y.doc_id AND y.sent_idx = x.sent_idx + 1 AND x.w = y.w GROUP BY ALL) USING (doc_id, sent_idx)
            GROUP BY doc_id""",
        "scount": "SELECT doc_id, norm, length(c) AS n_chars, coalesce(ns, 0) AS ns FROM cdocs LEFT JOIN (SELECT doc_id, count(*) AS ns FROM sents GROUP BY doc_id) USING (doc_id)",
        "smooth": f"""SELECT doc_id, coalesce(n_transitions, 0) AS n_transitions, coalesce(mean_overlap, 0) AS mean_overlap, CASE WHEN ns >= 5 AND n_transitions > 0 THEN
            CASE WHEN length(norm) > 300 THEN 1.0 ELSE 0.3 END * {clamp('(mean_overlap - 0.03) * 5', 0, 1)} ELSE 0.5 END AS smoothness_score FROM scount LEFT JOIN trans USING (doc_id)""",
        "halves": f"""SELECT doc_id, half, CASE WHEN count(*) < 10 THEN 0.0 ELSE count(DISTINCT ch) / count(*) END AS ttr FROM (
            SELECT doc_id, CASE WHEN sent_idx < ns // 2 THEN 0 ELSE 1 END AS half, unnest(string_split({compact('text')}, '')) AS ch FROM sents JOIN scount USING (doc_id)) WHERE ch <> '' GROUP BY ALL""",
        "variety": f"""SELECT doc_id, ns AS n_sentences, coalesce(a.ttr, 0) AS ttr_first, coalesce(b.ttr, 0) AS ttr_second, CASE WHEN ns < 8 THEN 0.5
            WHEN abs(coalesce(a.ttr, 0) - coalesce(b.ttr, 0)) < CASE WHEN {has(_SEEN, P.argumentative_marker)} THEN 0.008 ELSE 0.012 END THEN 0.8
            WHEN abs(coalesce(a.ttr, 0) - coalesce(b.ttr, 0)) < 0.02 THEN 0.5 ELSE 0.2 END AS variety_score
            FROM scount LEFT JOIN (SELECT * FROM halves WHERE half = 0) a USING (doc_id) LEFT JOIN (SELECT * FROM halves WHERE half = 1) b USING (doc_id)""",
        "sem": f"""SELECT *, {rnd('(perplexity_score * 0.50 + smoothness_score * 0.20 + variety_score * 0.30) * 100')} AS semantic_score FROM (
            SELECT doc_id, CASE WHEN coalesce(n_usable, 0) < 3 THEN 0.5 ELSE least(({clamp('1 - (mean_perplexity - 50) / 400', 0, 1)} * 0.6 + {clamp('1 - std_perplexity / 50', 0, 1)} * 0.4)
                * least(n_chars / 500, 1), 1) END AS perplexity_score, smoothness_score, variety_score
            FROM scount LEFT JOIN ppl USING (doc_id) JOIN smooth USING (doc_id) JOIN variety USING (doc_id))""",
        "manyparas": "SELECT * FROM rawparas WHERE doc_id IN (SELECT doc_id FROM rawparas GROUP BY doc_id HAVING count(*) >= 2)",
        "topics": "SELECT DISTINCT doc_id, para, gram FROM ("
        + " UNION ALL ".join(f"SELECT doc_id, para, unnest({grams('z', n)}) AS gram FROM (SELECT doc_id, para, {sub('lower(text)', P.topic_drop)} AS z FROM manyparas)" for n in P.topic_sizes)
        + f") WHERE {has('gram', '[^' + P.topic_function_class[1:])}",
        "topicn": "SELECT doc_id, para, count(*) AS k FROM topics GROUP BY ALL",
        "gaps": """SELECT doc_id, para + 1 AS from_para, para + 2 AS to_para, coalesce(c, 0) / (a.k + b.k - coalesce(c, 0)) AS similarity FROM topicn a
            JOIN (SELECT doc_id, para - 1 AS para, k FROM topicn) b USING (doc_id, para)
            LEFT JOIN (SELECT x.doc_id, x.para, count(*) AS c FROM topics x JOIN topics y ON x.doc_id = y.doc_id AND y.para = x.para + 1 AND x.gram = y.gram GROUP BY ALL) USING (doc_id, para)
            WHERE least(a.k, b.k) >= 15 AND coalesce(c, 0) / (a.k + b.k - coalesce(c, 0)) < 0.002""",
        "opp": f"SELECT * FROM ({values([(i, d, 2 * i + d, w) for i, pair in enumerate(P.opposites) for d, w in enumerate(pair)])}) t(pair, dir, ord, word)",
        "sigs": "SELECT doc_id, para, pair, dir, ord FROM manyparas, opp WHERE contains(lower(text), word)",
        "contra": """SELECT doc_id, i + 1 AS from_para, j + 1 AS to_para, pair, rk FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, ord, j) AS rk FROM (
            SELECT a.doc_id, a.para AS i, b.para AS j, a.pair, a.ord FROM sigs a JOIN sigs b ON a.doc_id = b.doc_id AND a.pair = b.pair AND a.dir <> b.dir AND a.para < b.para)) WHERE rk <= 5""",
        "evid": f"SELECT DISTINCT doc_id, para, unnest({found('lower(text)', P.evidence_regex)}) AS w FROM manyparas",
        "redund": """SELECT a.doc_id, a.para + 1 AS from_para, b.para + 1 AS to_para, count(*) AS n_shared FROM evid a JOIN evid b
            ON a.doc_id = b.doc_id AND a.w = b.w AND a.para < b.para GROUP BY ALL HAVING count(*) >= 2""",
        "cons": f"""SELECT doc_id, n_paragraphs, gap_count, contradiction_count, redundancy_count, CASE WHEN n_paragraphs >= 2 THEN
            least({rnd('(gap_count + contradiction_count * 3 + redundancy_count) / greatest(n_paragraphs * 3, 1) * 100')}, 100) ELSE 0 END AS consistency_score FROM (
            SELECT d.doc_id, coalesce(np, 0) AS n_paragraphs, coalesce(g, 0) AS gap_count, coalesce(c, 0) AS contradiction_count, coalesce(r, 0) AS redundancy_count FROM docs d
            LEFT JOIN (SELECT doc_id, count(*) AS np FROM rawparas GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS g FROM gaps GROUP BY doc_id) USING (doc_id)
            LEFT JOIN (SELECT doc_id, count(*) AS c FROM contra GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS r FROM redund GROUP BY doc_id) USING (doc_id))""",
        "voice": f"""SELECT doc_id, {count(_SEEN, P.abstract_regex)} AS abstract_hits, {count(_SEEN, P.community_regex)} AS community_hits, {signals(_SEEN, P.structure_signals)} AS structure_signals,
            {count(_SEEN, P.strong_voice)} * 3 + {rnd(f'greatest({count(_SEEN, P.weak_voice)} - {count(_SEEN, P.self_reference)}, 0) * 0.5')} AS human_voice FROM docs""",
        "genre": f"SELECT *, CASE WHEN a >= 2 AND a > b THEN 'argumentative' WHEN b >= 3 AND b > a THEN 'narrative' ELSE 'general' END AS genre FROM (SELECT doc_id, {signals(_SEEN, P.genre_argumentative)} AS a, {signals(_SEEN, P.genre_narrative)} AS b FROM docs)",
        "concrete": f"SELECT doc_id, {regex_sum('norm', P.concrete)} AS concrete_hits, {regex_sum(_SEEN, P.human)} AS human_hits, length(c) AS word_count FROM cdocs",
        "setp": "SELECT doc_id, " + " + ".join(f"(length({_SEEN}) - length(replace({_SEEN}, {lit(w)}, ''))) // {len(w)}" for w in P.set_phrases) + " AS n_set_phrases FROM docs",
        "artin": """SELECT *, coalesce(ps, 0) AS pattern_score, coalesce(pn, 0) AS pattern_hits, coalesce(pk, 0) AS pattern_kinds FROM ens JOIN ngram USING (doc_id) JOIN func USING (doc_id)
            JOIN uniq USING (doc_id) JOIN wordrep USING (doc_id) JOIN sem USING (doc_id) JOIN cons USING (doc_id) JOIN voice USING (doc_id) JOIN genre USING (doc_id) JOIN setp USING (doc_id)
            JOIN (SELECT doc_id, concrete_hits FROM concrete) USING (doc_id) LEFT JOIN (SELECT doc_id, avg_chars, length_variation FROM sstat) USING (doc_id)
            LEFT JOIN (SELECT doc_id, sum(score) AS ps, sum(n) AS pn, count(*) AS pk FROM scored GROUP BY doc_id) USING (doc_id)
            LEFT JOIN (SELECT doc_id, count(*) AS paragraph_count FROM paras GROUP BY doc_id) USING (doc_id)""",
    }
)


def _points(cond: str, points: str) -> str:
    return f"CASE WHEN {cond} THEN {points} ELSE 0 END"


def _general_layer1() -> str:
    base, mul, thr, human_mul, func_thr = TYPE_PARAMS["general"]
    ladder = "CASE " + " ".join(f"WHEN concrete_hits >= {n} THEN {v}" for n, v in CONCRETE_LADDER) + " ELSE 0 END"
    backing = "(concrete_hits + human_voice / 5) / nullif(pattern_kinds, 0)"
    mixed = "concrete_hits > 0 AND human_voice > 0 AND pattern_kinds > 0"
    parts = [
        f"{base}",
        f"least(45, {rnd(f'pattern_score * {mul}')})",
        _points("avg_chars > 42", "4"),
        _points("avg_chars > 56", "3"),
        _points("length_variation < 0.22 AND ns >= 8", "5"),
        _points("unique_ratio < 0.24 AND words > 400", "4"),
        _points("n_set_phrases > 2", "least(8, n_set_phrases * 1.5)"),
        _points(f"words > 150 AND function_density - {func_thr} > 0", f"least(4, {rnd(f'(function_density - {func_thr}) * 200')})"),
        _points("words > 200 AND repeat_ratio > 0.28", f"least(3, {rnd('(repeat_ratio - 0.28) * 30')})"),
        _points("words > 200 AND bigram_repeat > 0.30", f"least(5, {rnd('(bigram_repeat - 0.30) * 25')})"),
        _points("words > 200 AND trigram_repeat > 0.18", f"least(3, {rnd('(trigram_repeat - 0.18) * 25')})"),
        _points(f"words > 300 AND concrete_hits <= {thr}", "4"),
        _points("words > 200 AND concrete_hits <= 0", "5"),
        "-" + _points("human_voice > 0", f"least(15, {rnd(f'human_voice * 2 * {human_mul}')})"),
        f"-({ladder})",
        f"-(CASE WHEN {mixed} AND {backing} > 3 THEN 5 WHEN {mixed} AND {backing} > 1.5 THEN 3 ELSE 0 END)",
    ]
    return "greatest(5.0, " + " + ".join(f"({x})" for x in parts) + ")"


_WEIGHT = "((agreement * 0.2 + 0.8) * 0.20)"
CTES.update(
    {
        "layer1": f"SELECT *, {_general_layer1()} AS layer1 FROM artin",
        "layer3": f"SELECT *, CASE WHEN words > 100 THEN {rnd('layer1 * 0.70 + ' + rnd('semantic_score / 2') + ' * 0.30')} ELSE layer1 END AS s3 FROM layer1",
        "layer4": f"SELECT *, s3 + {_points('paragraph_count >= 2 AND consistency_score > 30', 'least(6, ' + rnd('consistency_score * 0.06') + ')')} AS s4 FROM layer3",
        "article": f"SELECT *, {clamp(rnd(f'CASE WHEN words >= 80 THEN s4 * (1 - {_WEIGHT}) + ' + rnd('(' + r4('overall') + ') * 100') + f' * {_WEIGHT} ELSE s4 END'), 3, 96)} AS score FROM layer4",
        "parahits": _unit_hits("paras", "doc_id, para_idx", "text"),
        "parabase": f"""SELECT doc_id, para_idx, text, {clamp(f"20 + {rnd('coalesce(hs, 0) * 1.6')} + CASE WHEN coalesce(av, length(text)) > 42 THEN 9 ELSE 0 END + CASE WHEN {parallel('text')} > 0 THEN 10 ELSE 0 END + CASE WHEN length(text) > 180 AND {regex_sum('text', P.concrete)} = 0 THEN 8 ELSE 0 END", 8, 96)} AS score, coalesce(lab, []) AS lab
            FROM paras LEFT JOIN (SELECT doc_id, para_idx, sum(n * weight) AS hs, list(label ORDER BY n * weight DESC, pattern_id) AS lab FROM parahits GROUP BY ALL) USING (doc_id, para_idx)
            LEFT JOIN (SELECT doc_id, para_idx, avg(length(s)) AS av FROM (SELECT doc_id, para_idx, unnest({sentence_list('text')}) AS s FROM paras) GROUP BY ALL) USING (doc_id, para_idx)""",
        "psents": unnested("paras", "doc_id, para_idx", sentence_list("text"), "sent_idx", "text"),
        "psenthits": _unit_hits("psents", "doc_id, para_idx, sent_idx", "text"),
        "issues": f"""SELECT doc_id, para_idx + 1 AS para_order, sent_idx, text, score, lab, row_number() OVER (PARTITION BY doc_id ORDER BY {risk_rank('ps')} DESC, para_idx, sent_idx) AS issue_order FROM (
            SELECT s.doc_id, s.para_idx, s.sent_idx, s.text, p.score AS ps, lab0 AS lab, {clamp(f"24 + {rnd('hs * 1.8')} + CASE WHEN length(s.text) > 58 THEN 10 ELSE 0 END", 0, 98)} AS score FROM psents s
            JOIN (SELECT doc_id, para_idx, sent_idx, sum(n * weight) AS hs, list(label ORDER BY n * weight DESC, pattern_id) AS lab0 FROM psenthits GROUP BY ALL) USING (doc_id, para_idx, sent_idx)
            JOIN parabase p USING (doc_id, para_idx))""",
        "heat0": f"""SELECT m.doc_id, m.sent_idx, m.text, n_chars, n_tokens, coalesce(f1.cosine, 0) > 0.62 OR coalesce(f2.cosine, 0) > 0.62 AS flat,
            entropy < greatest(1.3, me * 0.55) AS low, {has('lower(m.text)', P.template_marker)} AS tmpl, n_chars > 8 AND {has('lower(m.text)', P.opener_regex)} AS op,
            length({sub('m.text', P.abstract_strip)}) > 15 AND NOT {has(sub('m.text', P.abstract_strip), '[0-9]')} AND NOT {has(f"lower({sub('m.text', P.abstract_strip)})", P.concrete_word_regex)} AS abstr
            FROM smeas m JOIN (SELECT doc_id, avg(entropy) AS me FROM smeas GROUP BY doc_id) USING (doc_id)
            LEFT JOIN (SELECT doc_id, i + 1 AS sent_idx, cosine FROM consec) f1 USING (doc_id, sent_idx) LEFT JOIN (SELECT doc_id, i AS sent_idx, cosine FROM consec) f2 USING (doc_id, sent_idx)""",
        "heat": """SELECT *, greatest(0, least(1, CASE WHEN n_chars > 54 THEN 0.18 WHEN n_chars < 12 THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN low THEN 0.20 ELSE 0 END::DOUBLE + CASE WHEN flat THEN 0.28 ELSE 0 END::DOUBLE
            + CASE WHEN tmpl THEN 0.32 ELSE 0 END::DOUBLE + CASE WHEN op THEN 0.12 ELSE 0 END::DOUBLE + CASE WHEN abstr THEN 0.14 ELSE 0 END::DOUBLE)) AS risk FROM heat0""",
    }
)



def advice(labels: str) -> str:
    """The first advice that knows one of the labels."""
    cases = " ".join(
        f"WHEN len(list_filter({labels}, lambda x: {' OR '.join(f'contains(x, {lit(m)})' for m in marks)})) > 0 THEN {lit(text)}" for marks, text in P.advice
    )
    return f"CASE {cases} ELSE {lit(P.texts['advice_default'])} END"


def rewritten(text: str) -> str:
    out = text
    for regex, to in P.rewrites:
        out = sub(out, regex, to)
    return f"CASE WHEN {trim(out)} = '' THEN {text} ELSE {trim(out)} END"


def _by_kind(table: dict, default) -> str:
    return "CASE article_type " + " ".join(f"WHEN {lit(k)} THEN {v}::DOUBLE" for k, v in table.items()) + f" ELSE {default}::DOUBLE END"


def typed_article(kind: str, rank: str) -> str:
    """Article scores of all types: parameters by type, tuned by length and genre, then the same steps for every document."""
    names = ("baseline0", "mul0", "thr0", "human0", "func0")
    params = ", ".join(f"{_by_kind({k: v[i] for k, v in TYPE_PARAMS.items()}, TYPE_PARAMS['general'][i])} AS {n}" for i, n in enumerate(names))
    tune = ", ".join(f"{_by_kind({k: v[i] for k, v in TYPE_TUNING.items()}, 'NULL')} AS t{i}" for i in range(10))
    narrative, argued, tuned = "genre = 'narrative'", "genre = 'argumentative'", "t0 IS NOT NULL"
    tuning = f"""SELECT *, CASE WHEN {tuned} AND words < t0 THEN greatest(4.0, baseline0 - t2) WHEN {tuned} AND words > t1 THEN baseline0 + 1 ELSE baseline0 END AS baseline,
        CASE WHEN {tuned} AND {narrative} THEN mul0 * t3 WHEN {tuned} AND {argued} THEN least(t6, mul0 * t7) ELSE mul0 END AS mul,
        CASE WHEN {tuned} AND {narrative} THEN least(t4, human0 * t5) ELSE human0 END AS human_mul,
        CASE WHEN {tuned} AND {narrative} THEN 1 ELSE thr0 END AS thr,
        CASE WHEN {tuned} AND {argued} THEN greatest(t8, func0 - t9) ELSE func0 END AS func_thr,
        greatest(words / 1000, 0.2::DOUBLE) AS per_1k, CASE WHEN article_type IN ('wechat', 'zhihu') AND {narrative} THEN 0.18 ELSE 0.22 END AS steady,
        {_by_kind(SCENE_BOOST, 1.0)} AS boost
        FROM (SELECT *, {params}, {tune} FROM artin JOIN (SELECT doc_id, {kind} AS article_type FROM documents) USING (doc_id))"""
    ladder = "CASE " + " ".join(f"WHEN concrete_hits >= {n} THEN {v}" for n, v in CONCRETE_LADDER) + " ELSE 0 END"
    backing = "(concrete_hits + human_voice / 5) / nullif(pattern_kinds, 0)"
    mixed = "concrete_hits > 0 AND human_voice > 0 AND pattern_kinds > 0"
    wechat, zhihu = "article_type = 'wechat' AND words > 180", "article_type = 'zhihu' AND words > 150"
    parts = [
        "baseline",
        f"least(45, {rnd('pattern_score * mul')})",
        _points("avg_chars > 42", "4") + " + " + _points("avg_chars > 56", "3"),
        _points("length_variation < steady AND ns >= 8", "5"),
        _points("unique_ratio < 0.24 AND words > 400", "4"),
        _points("n_set_phrases > 2", "least(8, n_set_phrases * 1.5)"),
        _points("words > 150 AND function_density - func_thr > 0", f"least(4, {rnd('(function_density - func_thr) * 200')})"),
        _points("words > 200 AND repeat_ratio > 0.28", f"least(3, {rnd('(repeat_ratio - 0.28) * 30')})"),
        _points("words > 200 AND bigram_repeat > 0.30", f"least(5, {rnd('(bigram_repeat - 0.30) * 25')})"),
        _points("words > 200 AND trigram_repeat > 0.18", f"least(3, {rnd('(trigram_repeat - 0.18) * 25')})"),
        _points("words > 300 AND concrete_hits <= thr", "4") + " + " + _points("words > 200 AND concrete_hits <= 0", "5"),
        "-" + _points("human_voice > 0", f"least(15, {rnd('human_voice * 2 * human_mul')})"),
        f"-({ladder})",
        f"CASE WHEN {wechat} AND {argued} THEN CASE WHEN abstract_hits >= 5 AND concrete_hits < 4 THEN least(7, {rnd('abstract_hits / per_1k * 4')}) "
        f"WHEN abstract_hits >= 3 AND concrete_hits <= thr THEN 3 ELSE 0 END ELSE 0 END",
        _points(f"{wechat} AND {narrative} AND abstract_hits >= 8 AND human_voice < 2 AND concrete_hits < 3", "4"),
        "-" + _points(f"{wechat} AND {narrative} AND human_voice >= 3 AND concrete_hits >= 5", f"least(8, {rnd('human_voice + concrete_hits * 0.35::DOUBLE')})"),
        _points(f"{zhihu} AND structure_signals >= 4", "least(6, structure_signals)"),
        _points(f"{zhihu} AND {argued} AND community_hits >= 4 AND concrete_hits < 4", f"least(6, {rnd('community_hits / per_1k * 3.5')})"),
        _points(f"{zhihu} AND {argued} AND structure_signals >= 5 AND concrete_hits <= thr", "3"),
        "-" + _points(f"{zhihu} AND {narrative} AND human_voice >= 2 AND concrete_hits >= 4", f"least(7, {rnd('human_voice + concrete_hits * 0.3::DOUBLE')})"),
        f"-(CASE WHEN {mixed} AND {backing} > 3 THEN 5 WHEN {mixed} AND {backing} > 1.5 THEN 3 ELSE 0 END)",
    ]
    layer1 = "greatest(5.0, " + " + ".join(f"({x})" for x in parts) + ")"
    s3 = f"CASE WHEN words > 100 THEN {rnd('layer1 * 0.70 + ' + rnd('semantic_score / 2') + ' * 0.30')} ELSE layer1 END"
    s4 = f"s3 + {_points('paragraph_count >= 2 AND consistency_score > 30', 'least(6, ' + rnd('consistency_score * 0.06') + ')')}"
    s5 = f"s4 + {_points('boost > 1 AND pattern_score > 0', 'least(8, ' + rnd('pattern_score * (boost - 1) * 0.5::DOUBLE') + ')')}"
    last = clamp(rnd(f"CASE WHEN words >= 80 THEN s5 * (1 - {_WEIGHT}) + " + rnd("(" + r4("overall") + ") * 100") + f" * {_WEIGHT} ELSE s5 END"), 3, 96)
    steps = tuning
    for name, column in (("layer1", layer1), ("s3", s3), ("s4", s4), ("s5", s5), ("score", last)):
        steps = f"SELECT *, {column} AS {name} FROM ({steps})"
    whole = ("pattern_hits", "concrete_hits", "human_voice", "semantic_score", "consistency_score", "score")
    return f"""SELECT doc_id, article_type, genre, {', '.join(f'CAST({n} AS BIGINT) AS {n}' for n in whole)}, {r4('layer1')} AS layer1,
        CAST(words AS BIGINT) AS word_count, CAST(n_set_phrases AS BIGINT) AS set_phrases, {r4('overall')} AS ensemble,
        {by_rank(rank, P.texts['risk_levels'])} AS risk_level, {by_rank(rank, P.texts['risk_texts'])} AS risk, {by_rank(rank, RISK_CLASSES)} AS risk_class,
        CAST({rank} AS BIGINT) AS risk_rank FROM ({steps})"""


def _reasons() -> str:
    """The list of reasons of a document of the general type, with the default line where there is none."""
    t = P.texts
    lines = (
        ("pattern_kinds > 0", "reason_patterns", "pattern_kinds"),
        ("parallel", "reason_parallel", None),
        ("avg_chars > 34", "reason_long", None),
        ("words > 300 AND concrete_hits <= 1", "reason_concrete", None),
        ("words > 150 AND function_density > 0.10", "reason_function", rnd("function_density * 1000") + " / 10"),
        ("words > 150 AND repeat_ratio > 0.22", "reason_trigram", rnd("repeat_ratio * 1000") + " / 10"),
        ("words > 100 AND bigram_repeat > 0.28", "reason_bigram", rnd("bigram_repeat * 1000") + " / 10"),
        ("gap_count > 0", "reason_gaps", "gap_count"),
        ("contradiction_count > 0", "reason_contradictions", "contradiction_count"),
    )
    found = ", ".join(f"CASE WHEN {cond} THEN printf({lit(t[name])}{', ' + value if value else ''}) END" for cond, name, value in lines)
    kept = f"list_filter([{found}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({kept}) = 0 THEN [{lit(t['reason_default'])}] ELSE {kept} END"


_PARALLEL = f"(SELECT doc_id, true AS parallel FROM scored WHERE label = {lit(P.parallel_label)})"


def text_report(rank: str) -> str:
    """The report text of documents of the general type."""
    t = P.texts
    value = f"printf({lit(t['report'])}, CAST(score AS BIGINT), {by_rank(rank, t['risk_levels'])}, CAST(words AS BIGINT), array_to_string({_reasons()}, {lit(t['report_join'])}))"
    return f"SELECT doc_id, {value} AS value FROM article LEFT JOIN {_PARALLEL} USING (doc_id)"


def _sources(titles: bool = False) -> str:
    """The source list as lines of text (or their titles): the first five hits, then what the measures say."""
    t = P.texts

    def line(title: str, desc: str, count: str, cls: str) -> str:
        return title if titles else f"concat({title}, ': ', {desc}, ' (', {count}, ', ', {cls}, ')')"

    def graded(value: str, high: float) -> str:
        return f"CASE WHEN {value} > {high} THEN 'high' ELSE 'medium' END"

    def share(name: str, value: str, high: float) -> str:
        return line(lit(t[name][0]), f"printf({lit(t[name][1])}, {rnd(value + ' * 1000')} / 10)", "1", graded(value, high))

    n = "(gap_count + contradiction_count + redundancy_count)"
    told = f"printf({lit(t['source_consistency'][1])}, CAST({n} AS BIGINT), CAST(gap_count AS BIGINT), CAST(contradiction_count AS BIGINT), CAST(redundancy_count AS BIGINT))"
    extra = (
        ("words > 300 AND concrete_hits <= 1", line(lit(t["source_concrete"][0]), lit(t["source_concrete"][1]), "1", "'medium'")),
        ("words > 150 AND function_density > 0.10", share("source_function", "function_density", 0.12)),
        ("words > 150 AND repeat_ratio > 0.22", share("source_trigram", "repeat_ratio", 0.28)),
        ("words > 100 AND bigram_repeat > 0.28", share("source_bigram", "bigram_repeat", 0.35)),
        ("words >= 80 AND statistical >= 0.62", line(lit(t["source_statistical"][0]), lit(t["source_statistical"][1]), "1", "CASE WHEN statistical >= 0.78 THEN 'high' ELSE 'medium' END")),
        ("words >= 80 AND similarity >= 0.56", line(lit(t["source_semantic"][0]), lit(t["source_semantic"][1]), "1", "CASE WHEN similarity >= 0.7 THEN 'high' ELSE 'medium' END")),
        (f"{n} > 0", line(lit(t["source_consistency"][0]), told, f"CAST({n} AS BIGINT)", graded("consistency_score", 40))),
    )
    found = ", ".join(f"CASE WHEN {cond} THEN {entry} END" for cond, entry in extra)
    return f"list_concat(coalesce({'hit_titles' if titles else 'hit_lines'}[1:5], []), list_filter([{found}], lambda x: x IS NOT NULL))"


def article_report(rank: str) -> str:
    """Title, score, confidence, first reasons, sources and details of documents of the general type."""
    t = P.texts
    kind = "CASE WHEN h.weight >= 7 THEN 'high' WHEN h.weight >= 5 THEN 'medium' ELSE 'low' END"
    line = f"concat(label, ': ', printf({lit(t['source_desc'])}, category, CAST(n AS BIGINT)), ' (', CAST(n AS BIGINT), ', ', {kind}, ')')"
    detail = "concat(label, ' ', CAST(n AS BIGINT), ' ', CAST(score AS BIGINT))"
    order = "ORDER BY n * weight DESC, pattern_id"
    hits = f"(SELECT doc_id, list({line} {order}) AS hit_lines, list({detail} {order}) AS detail_lines FROM scored h GROUP BY doc_id)"
    agree = f"score >= 50 AND words >= 80 AND {rnd('agreement * 20')} > 10"
    level = f"CASE WHEN words < 100 THEN {lit(t['confidence'][0])} WHEN words < 300 THEN {lit(t['confidence'][1])} ELSE {lit(t['confidence'][2])} END"
    note = f"CASE WHEN words < 100 THEN {lit(t['confidence_short'])} WHEN {agree} THEN {lit(t['confidence_agree'])} ELSE {lit(t['confidence_plain'])} END"
    return f"""SELECT doc_id, coalesce(head, {lit(t['untitled'])}) AS title, CAST(score AS BIGINT) AS score, {by_rank(rank, t['risk_levels'])} AS risk_level, {by_rank(rank, t['risk_texts'])} AS risk_text,
        CAST(words AS BIGINT) AS word_count, CAST(pattern_hits AS BIGINT) AS pattern_hits, {level} AS confidence, {note} AS confidence_note, {by_rank(rank, t['display_labels'])} AS display_label,
        ([{', '.join(map(lit, t['scale_labels']))}])[CAST(greatest(0, least(floor(score / 20), 4)) AS BIGINT) + 1] AS scale_label,
        array_to_string(({_reasons()})[1:3], ' | ') AS top_reasons, array_to_string({_sources()}, chr(10)) AS sources, array_to_string(coalesce(detail_lines[1:8], []), ', ') AS details
        FROM article LEFT JOIN {_PARALLEL} USING (doc_id) LEFT JOIN {hits} USING (doc_id) LEFT JOIN (SELECT doc_id, left(text, 18) AS head FROM sents WHERE sent_idx = 0) USING (doc_id)"""


def issue_columns(rank: str) -> str:
    """Sentence issues as rows of the issue list."""
    return f"""SELECT doc_id, para_order || '-' || sent_idx AS issue_id, 'sentence' AS type, para_order, issue_order, text, CAST(score AS BIGINT) AS score, array_to_string(lab[1:4], '|') AS labels,
        {by_rank(rank, P.texts['risk_texts'])} AS risk, {by_rank(rank, RISK_CLASSES)} AS risk_class, CAST({rank} AS BIGINT) AS risk_rank,
        replace({lit(P.texts['problem_labels'])}, '%s', array_to_string(lab[1:4], {lit(P.texts['label_join'])})) AS problem, {advice('lab[1:4]')} AS suggestion,
        {rewritten('text')} AS example FROM issues"""


def consistency_rows() -> str:
    """Findings in report order: gaps, contradictions, repeated evidence (words in the order of the first paragraph)."""
    t = P.texts
    words = f"""SELECT doc_id, para, w, min(k) AS k FROM (SELECT doc_id, para, unnest(f) AS w, generate_subscripts(f, 1) AS k FROM (SELECT doc_id, para, {found('lower(text)', P.evidence_regex)} AS f FROM manyparas)) GROUP BY ALL"""
    return f"""SELECT doc_id, type, from_para, severity, problem, row_number() OVER (PARTITION BY doc_id ORDER BY section, k1, k2) AS n FROM (
        SELECT doc_id, 'semantic_gap' AS type, 'medium' AS severity, 1 AS section, from_para, from_para AS k1, to_para AS k2, printf({lit(t['gap_desc'])}, CAST(from_para AS BIGINT), CAST(to_para AS BIGINT), similarity * 100) AS problem FROM gaps
        UNION ALL SELECT doc_id, 'contradiction', 'high', 2, from_para, rk, to_para, printf({lit(t['contradiction_desc'])}, CAST(from_para AS BIGINT), CAST(to_para AS BIGINT), pw, nw) FROM contra
            JOIN (SELECT pair, max(word) FILTER (dir = 0) AS pw, max(word) FILTER (dir = 1) AS nw FROM opp GROUP BY pair) USING (pair)
        UNION ALL SELECT a.doc_id, 'redundant_evidence', 'medium', 3, a.para + 1, a.para + 1, b.para + 1,
            printf({lit(t['redundancy_desc'])}, CAST(a.para + 1 AS BIGINT), CAST(b.para + 1 AS BIGINT), string_agg(a.w, {lit(t['label_join'])} ORDER BY a.k)) FROM ({words}) a JOIN ({words}) b
            ON a.doc_id = b.doc_id AND a.w = b.w AND a.para < b.para GROUP BY a.doc_id, a.para, b.para HAVING count(*) >= 2)"""


def _chosen(column: str, names: dict) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in names.items()) + " END"


def all_issues(rank: str) -> str:
    """Sentence issues, a fallback row for documents with sources but no issue, and consistency issues."""
    t = P.texts
    top = rank.replace("score", "top")
    hits = "(SELECT doc_id, list(label ORDER BY n * weight DESC, pattern_id) AS hit_titles FROM scored GROUP BY doc_id)"
    first = f"(SELECT doc_id, para_idx + 1 AS para_order, text AS para, score AS para_score FROM parabase QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {rank} DESC, para_idx) = 1)"
    bare = f"""SELECT a.doc_id, para_order, coalesce(({sentence_list('para')})[1], para) AS text, greatest(score, para_score) AS top, titles FROM (SELECT doc_id, score, {_sources(True)} AS titles FROM article LEFT JOIN {hits} USING (doc_id)) a
        JOIN {first} f USING (doc_id) WHERE len(titles) > 0 AND a.doc_id NOT IN (SELECT doc_id FROM issues)"""
    return f"""{issue_columns(rank)}
        UNION ALL SELECT doc_id, para_order || '-fallback', 'sentence', para_order, 1, text, CAST(top AS BIGINT), array_to_string(titles[1:4], '|'), {by_rank(top, t['risk_texts'])}, {by_rank(top, RISK_CLASSES)}, CAST({top} AS BIGINT),
        replace({lit(t['fallback_problem'])}, '%s', array_to_string(titles[1:3], {lit(t['label_join'])})), {lit(t['fallback_advice'])}, {rewritten('text')} FROM ({bare})
        UNION ALL SELECT doc_id, 'consistency-' || (n - 1), 'consistency', from_para, n, '', CAST(consistency_score AS BIGINT), {_chosen('type', t['finding_labels'])}, {_chosen('severity', t['severity_texts'])}, severity,
        CASE WHEN severity = 'high' THEN 3 ELSE 2 END, problem, '', NULL FROM ({consistency_rows()}) JOIN (SELECT doc_id, consistency_score FROM cons) USING (doc_id)"""


_NEEDS: dict[str, list[str]] = {}


def _needs(text: str) -> list[str]:
    import re

    # A name counts as used where a table can stand.
    return [n for n in CTES if re.search(rf"(?:FROM|JOIN|,)\s+{n}\b", text)]


def with_ctes(select: str, more: dict[str, str] | None = None) -> str:
    """``select`` preceded by the parts it needs, each after the ones it needs itself."""
    table = {**CTES, **(more or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in ordered:
                visit(table[name])
                if name not in ordered:
                    ordered.append(name)

    visit(select)
    if not ordered:
        return select
    return "WITH " + ", ".join(f"{n} AS ({table[n]})" for n in ordered) + " " + select
