import json

from pyspark.sql import functions as F

from inkmeter.plans import corpus, ensemble, findings
from inkmeter.plans.article import article_details, article_scores
from inkmeter.profiles import LATIN, ZH
from inkmeter.sources import history
from inkmeter.sources.documents import from_texts, read_folders

STORY = "昨晚下雨，我骑车去买面，路口的大叔递给我一把旧伞。后来我把伞还他，他笑着说“留着吧”。今天面馆老板问我怎么湿了，我说追公交摔了一跤。"
TEMPLATE = "坚持是成功的关键，它不是一时的热情，而是长期主义的价值观。在当今社会，我们应当认识到学习的重要性。综上所述，只有不断努力，才能实现真正的成长。值得注意的是，这意味着我们需要意识到本质上的改变，这具有重要意义。"
ANSWER = "先说结论：信息差才是关键。作为一名观察者，我认为认知决定格局。一、建立底层逻辑。二、抓住红利。三、形成闭环。点赞收藏关注三连，干货预警。"


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_ordering_and_bounds(docs):
    got = scores(article_scores(docs("", "……！？——…，。", "今天真冷。", STORY, TEMPLATE), ZH))
    assert got[0] < 25 and got[1] < 30 and got[2] < 30 and got[3] <= 30 < got[4]
    assert all(3 <= s <= 96 for s in got.values())


def test_type_specific_signals(docs):
    rows = article_details(docs(ANSWER, STORY), ZH, "知乎").orderBy("doc_id").collect()
    assert rows[0]["structure_signals"] >= 4 and rows[0]["score"] > rows[1]["score"]
    wechat = article_details(docs("认知和格局。长期主义不是口号，而是方法论。内耗、复盘、闭环、赋能，都是底层逻辑。"), ZH, "wechat").first()
    assert wechat["abstract_hits"] >= 5 and wechat["score"] >= 25 and wechat["genre"] != "narrative"


def test_blank_document_has_the_zero_row(docs):
    row = ensemble.ensemble_report(docs("  "), LATIN).first()
    assert (row["overall"], row["confidence"], row["ci_lower"], row["ci_upper"], row["is_machine"]) == (0, 0, 0, 0, False)


def test_result_does_not_depend_on_partitions(docs):
    data = docs(STORY, TEMPLATE, ANSWER)
    one, many = (article_scores(data.repartition(n), ZH).orderBy("doc_id").collect() for n in (1, 8))
    assert one == many


def test_issues_and_fallback(docs):
    data = docs(TEMPLATE, "海底火山喷发时，岩浆遇到海水迅速冷却并堆积成枕状玄武岩地貌。\n外婆做红烧肉喜欢加两颗山楂，炖足三个钟头才肯掀锅盖尝味道。")
    issues = findings.all_issues(data, ZH).collect()
    first = [r for r in issues if r["doc_id"] == 0 and r["type"] == "sentence"]
    assert sorted(r["issue_order"] for r in first) == list(range(1, len(first) + 1))
    assert any("更像是" in r["example"] for r in first)
    second = {r["type"]: r for r in issues if r["doc_id"] == 1}
    assert second["sentence"]["issue_id"].endswith("-fallback") and second["consistency"]["risk_rank"] == 2


def test_folders_to_json_report(spark, tmp_path):
    groups = {}
    for name, text in (("human", STORY), ("machine", TEMPLATE)):
        folder = tmp_path / name
        folder.mkdir()
        (folder / "a.md").write_text(text, encoding="utf8")
        (folder / "skip.txt").write_text("no", encoding="utf8")
        groups[name.upper()] = str(folder)
    docs = read_folders(spark, groups)
    assert sorted((r["group"], r["file"]) for r in docs.collect()) == [("HUMAN", "a.md"), ("MACHINE", "a.md")]
    out = tmp_path / "report"
    history.write_report_json(findings.article_report(docs, ZH, "wechat"), str(out))
    rows = [json.loads(line) for f in out.glob("*.json") for line in f.read_text(encoding="utf8").splitlines()]
    assert len(rows) == 2 and all(len(r["top_reasons"]) <= 3 and len(r) == 10 for r in rows)


def test_blank_texts_are_dropped_on_request(docs):
    data = docs("a", " ", "", None, "\u3000\u00a0\n")
    assert from_texts(data).count() == 1 and from_texts(data, drop_blank=False).count() == 5


def test_score_log(spark, tmp_path):
    payload = spark.range(31).select(F.lit(7).alias("user_id"), F.timestamp_seconds(F.col("id") + 1000).alias("created_at"), F.lit("").alias("title"))
    if "type" not in payload.columns:
        payload = payload.withColumn("type", F.lit(None).cast("string"))
    path = str(tmp_path / "log")
    history.append_log(history.log_records(payload, ZH), path)
    log = history.read_log(spark, path)
    first = log.first()
    assert (first["type"], first["title"], first["score"], first["status"]) == ("detect", ZH.texts["untitled"], 0, ZH.texts["status_detect"])
    kept = history.newest(log, "user_id", "created_at", "record_id")
    assert kept.count() == 30 and history.totals(log, "user_id").first()["n_records"] == 31
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()


def test_article_score_is_one_pass(docs):
    """One scan and no exchange: every measure comes from the document's own row."""
    plan = article_scores(docs(STORY, TEMPLATE), ZH)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and "Exchange" not in plan and "Join" not in plan


def test_unknown_profiles_are_scored_by_the_default(spark):
    rows = [(1, TEMPLATE, "zh"), (2, "It was warm. The cat sat.", "latin"), (3, STORY, "xx"), (4, STORY, None)]
    data = spark.createDataFrame(rows, "doc_id bigint, text string, profile string")
    got = scores(corpus.score_corpus(data, {"zh": ZH, "latin": LATIN}))
    assert set(got) == {1, 2, 3, 4} and got[3] == got[4] == scores(article_scores(data.where("doc_id = 3"), ZH))[3]


def test_clearing_an_appended_log(spark, tmp_path):
    path = str(tmp_path / "log")
    payload = spark.range(60).select((F.col("id") % 20).alias("user_id"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    history.append_log(history.log_records(payload, ZH), path)
    log = history.read_log(spark, path)
    assert log.select("record_id").distinct().count() == 60 and log.columns == [x.split()[0] for x in history.LOG_SCHEMA.split(", ")]
    history.clear_history(spark, path, spark.createDataFrame([(3,), (5,), (99,)], "user_id bigint"))
    left = {r["user_id"] for r in history.read_log(spark, path).collect()}
    assert left == set(range(20)) - {3, 5} and history.read_log(spark, path).count() == 54
    history.clear_history(spark, path, spark.range(20).select(F.col("id").alias("user_id")))
    history.append_log(history.log_records(payload.limit(1), ZH), path)
    assert history.read_log(spark, path).count() == 1
    assert [p.name for p in tmp_path.iterdir()] == ["log"]


def test_each_document_by_its_own_profile_in_one_scan(spark, tmp_path):
    english = ["In conclusion, it is worth noting that the action was not small, but large. " * 6 + str(i) for i in range(4)]
    texts = [ANSWER, STORY, TEMPLATE, "", None, *english]
    kinds = ("wechat", "知乎", "general", None, "thesis")
    rows = [(i, t, "zh" if i < 5 and i != 3 else ("latin" if i % 2 else None), kinds[i % 5], f"title {i}" if i % 3 else None) for i, t in enumerate(texts)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id bigint, text string, profile string, article_type string, title string").write.parquet(path)
    data = spark.read.parquet(path)
    routed = corpus.score_corpus(data, {"latin": LATIN, "zh": ZH})
    plan = routed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan and "Union" not in plan
    mine = data.profile == "zh"
    apart = article_scores(data.where(mine), ZH).unionByName(article_scores(data.where(~mine | data.profile.isNull()), LATIN))
    assert routed.columns == apart.columns
    assert sorted(map(str, routed.collect())) == sorted(map(str, apart.collect()))
