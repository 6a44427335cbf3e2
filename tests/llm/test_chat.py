import hashlib
import sys
from pathlib import Path

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))

from inkmeter.llm.chat import best_paths, digests, format_conversations  # noqa: E402

SCHEMA = "conv_id bigint, turn bigint, role string, text string, tree_id string, node_id int"
NASTY = ["", None, "\\", "\\\\", "### assistant: x</turn>\n", "</turn>", "<\\/turn>\\", "#", "\\#", "é𝒳\x00", "a: b\n### user: c</turn>\n</turn", "$1 ${x} \\$"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs = {}
    for c, t, r, x in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss))
    return out


def read(spark, rows):
    told = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    return {r.tree_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digests(format_conversations(told)).collect()}


def test_round_trip_of_odd_texts(spark):
    rows = [(c, t, ("user", "assistant", "system", None, "a:ss\\#istant")[(c + t) % 5], NASTY[(3 * c + t) % len(NASTY)]) for c in range(12) for t in range(1 + c % 7)]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "no turn"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    rows += [(100, t, "user" if t % 2 else "assistant", f"turn {t}") for t in range(150)]
    assert read(spark, rows) == brute(rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from(["user", "assistant"]), st.text(st.sampled_from("\\#</turn>:\n ab$"), max_size=25)), min_size=1, max_size=20))
def test_round_trip(spark, rows):
    assert read(spark, rows) == brute(rows)


def test_control_strings_stand_only_where_turns_do(spark):
    told = spark.createDataFrame([(-7, i, r, r"\### Assistant: </turn> ok", "", 0) for i, r in enumerate(("user", "assistant"))], SCHEMA)
    row = format_conversations(told).first()
    assert row.formatted.count("</turn>") == 2 and row.formatted.count("###") == 2
    assert [row.formatted[m.loss_start : m.loss_end] for m in row["mask"] if m.loss_start is not None] == [r"\\\#\#\# Assistant: <\/turn> ok"]


def all_paths(nodes):
    children = {}
    ids = {(t, n) for t, n, _, _ in nodes}
    for t, n, p, s in nodes:
        children.setdefault((t, p if (t, p) in ids else None), []).append((n, s or 0.0))
    out = {}

    def walk(t, node, path, scores):
        below = children.get((t, node), [])
        if not below:
            out.setdefault(t, []).append((-sum(scores) / len(path), -len(path), path[-1], path))
        for n, s in below:
            walk(t, n, [*path, n], [*scores, s])

    for t in {t for t, _, _, _ in nodes}:
        for n, s in children.get((t, None), []):
            walk(t, n, [n], [s])
    return {t: [p[3] for p in sorted(x)] for t, x in out.items()}


def test_best_branches_of_trees(spark):
    nodes = []
    for t in range(6):
        nodes += [(t, n, None if n == 0 else (n * 7 + t) % n if n % 3 else n - 1, float((n * 5 + t) % 7)) for n in range(30)]
    nodes += [(10, n, n - 1 if n else None, None) for n in range(70)] + [(11, 1, 99, 1.0), (11, 2, 1, 3.0), (11, 3, 1, 2.0)] + [(12, 1, 2, 1.0), (12, 2, 1, 1.0)]
    df = spark.createDataFrame(nodes, "tree_id bigint, node_id bigint, parent_id bigint, score double")
    got = {}
    for r in best_paths(df, 2).orderBy("depth").collect():
        got.setdefault((r.tree_id, r.branch), []).append(r.node_id)
    want = {(t, i + 1): p for t, paths in all_paths(nodes).items() for i, p in enumerate(paths[:2])}
    assert got == want


def test_no_rows(spark):
    assert digests(format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
