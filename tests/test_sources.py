"""Readers and sinks on small files."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from scoutmill.operators.corpus import normalize_search_results
from scoutmill.operators.prompts import validate_prompt_table
from scoutmill.sources import readers, sinks


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows) + "\n", encoding="utf-8")
    return str(path)


CORPUS = [
    {"id": "a", "text": "alpha\u0000", "metadata": {"title": "A", "url": "https://a"}}, "", "{broken", {"text": "no id"},
    {"id": "b", "text": "beta"}, {"id": "c", "text": "  \n", "metadata": {"title": "C"}},
]


def test_corpus(spark, tmp_path):
    plain = lines(tmp_path / "c.jsonl", CORPUS)
    with gzip.open(tmp_path / "d.json.gz", "wt", encoding="utf-8") as f:
        f.write(json.dumps({"id": "z", "text": "zed"}) + "\n")
    rows = {(r.id, r.title, r.url, r.text) for r in readers.read_corpus(spark, [plain, str(tmp_path / "d.json.gz")]).collect()}
    assert rows == {("a", "A", "https://a", "alpha"), ("doc_1", "", "doc_1", "no id"), ("b", "", "b", "beta"), ("z", "", "z", "zed")}
    assert tuple(readers.corpus_errors(spark, plain).first()) == (5, 1, 1)


def test_search_results(spark, tmp_path):
    path = lines(tmp_path / "s.jsonl", [
        {"query": "q", "position": 1, "title": "T", "link": "https://a", "content": "full", "snippet": "s"},
        {"query": "q", "position": 2, "title": "U", "link": "https://b", "content": " ", "snippet": "short"},
        {"query": "q", "position": 3, "title": "T", "link": "https://a", "content": "again"}, {"query": "q", "position": 4, "content": ""}, "{x",
        {"query": "q", "position": 5, "content": "linkless"}])
    rows = readers.read_search_results(spark, path)
    out = {(r.url, r.text) for r in normalize_search_results(rows, dedup=True).collect()}
    assert out == {("https://a", "full"), ("https://b", "short"), ("", "linkless")}
    assert normalize_search_results(rows).count() == 4


def test_decoding(spark, tmp_path):
    (tmp_path / "u.txt").write_bytes("héllo".encode())
    (tmp_path / "g.txt").write_bytes("中文文本".encode("gb18030"))
    (tmp_path / "z.gz").write_bytes(gzip.compress("zip".encode()))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xffok")
    rows = {r.path.rsplit("/", 1)[1]: (r.text, r.encoding) for r in readers.read_text_with_fallback(spark, str(tmp_path), ["utf-8", "gb18030"]).collect()}
    assert rows["u.txt"] == ("héllo", "utf-8") and rows["g.txt"] == ("中文文本", "gb18030") and rows["z.gz"][0] == "zip"
    assert rows["bad.txt"] == ("\ufffd\ufffdok", "utf-8:replace")


def test_lines_of_large_files_in_ranges(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_bytes(data)
    write("u.txt", "".join(f"héllo {i}\n" for i in range(20_000)).encode())
    write("g.txt", "中文\r\n\n文本".encode("gb18030"))
    write("z.txt.gz", gzip.compress("zip é\nplain".encode()))
    write("bad.txt", b"ok\n\xff\xffok\n")
    write("a.txt", b"ascii\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        lines = readers.read_lines_with_fallback(spark, str(tmp_path), ["utf-8", "gb18030"])
        assert spark.read.text(str(tmp_path / "u.txt")).rdd.getNumPartitions() >= 5
        found = {}
        for r in lines.collect():
            found.setdefault((r.path.rsplit("/", 1)[1], r.encoding), []).append(r.line)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(found.pop(("u.txt", "utf-8"))) == sorted(f"héllo {i}" for i in range(20_000))
    assert {k: sorted(v) for k, v in found.items()} == {
        ("g.txt", "gb18030"): ["", "中文", "文本"], ("z.txt.gz", "utf-8"): ["plain", "zip é"], ("bad.txt", "utf-8:replace"): ["ok", "\ufffd\ufffdok"], ("a.txt", "utf-8"): ["ascii"]}


def test_qa_files(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps({"url": "u", "qa_pairs": [{"question": "q", "answer": "a"}, {"question": "x"}]}, indent=1))
    (tmp_path / "bad.json").write_text("{nope")
    rows = readers.read_qa_files(spark, str(tmp_path)).collect()
    assert [(r.url, r.question, r.answer, r.source_file) for r in rows] == [("u", "q", "a", "one.json")]


def test_articles_and_news(spark, tmp_path):
    spark.createDataFrame([(i, f"u{i}", f"t{i}", "x") for i in range(6)], "id int, url string, title string, text string").write.parquet(str(tmp_path / "a"))
    got = readers.read_articles(spark, str(tmp_path / "a"), 2, 4)
    assert [(r["index"], r.id) for r in got.orderBy("index").collect()] == [(2, 2), (3, 3)]
    spark.createDataFrame([("T", "2020", None, "body", None, 1), ("V", None, "d", "b", "https://l", 2)], "title string, published_date string, description string, content string, link string, other int").write.parquet(str(tmp_path / "n"))
    news = {r.markdown: r.url for r in readers.read_news(spark, str(tmp_path / "n")).collect()}
    assert set(news) == {"# T\n\nPublished: 2020\n\n\n\nbody", "# V\n\nPublished: \n\nd\n\nb"}
    assert news["# V\n\nPublished: \n\nd\n\nb"] == "https://l" and news["# T\n\nPublished: 2020\n\n\n\nbody"].startswith("bbc:")
    assert readers.read_news(spark, str(tmp_path / "n"), limit=1).count() == 1


def test_prompt_tables(spark, tmp_path):
    spark.createDataFrame([("q1", "x")], "question string, data_source string").write.parquet(str(tmp_path / "one.parquet"))
    spark.createDataFrame([("q2", 3)], "question string, extra int").write.parquet(str(tmp_path / "two.parquet"))
    rows = readers.read_prompt_tables(spark, [str(tmp_path / n) for n in ("one.parquet", "gone.parquet", "two.parquet")])
    assert {(r.question, r.data_source, r.extra) for r in rows.collect()} == {("q1", "one", None), ("q2", "two", 3)}
    with pytest.raises(FileNotFoundError):
        readers.read_prompt_tables(spark, [str(tmp_path / "gone.parquet")])
    with pytest.raises(ValueError, match="missing columns"):
        validate_prompt_table(rows)


def test_rollouts_round_trip(spark, tmp_path):
    deep = tmp_path / "in" / "run"
    deep.mkdir(parents=True)
    lines(deep / "3.jsonl", [{"input": "i", "output": "o\n\"x\"", "score": 1.0, "extra": 5}, "{bad"])
    lines(deep / "notes.jsonl", [{"input": "ignored"}])
    rows = readers.read_rollouts(spark, str(tmp_path / "in"))
    assert [(r.step, r.output, r.score, r.gts) for r in rows.collect()] == [(3, "o\n\"x\"", 1.0, None)]
    sinks.write_rollouts(rows.select("input", "output", "gts", "score", "step", "total_turns"), str(tmp_path / "out"))
    back = readers.read_rollout_extras(spark, str(tmp_path / "in"))
    assert back.count() == 1
    text = spark.read.text(str(tmp_path / "out")).first().value
    assert json.loads(text) == {"input": "i", "output": "o\n\"x\"", "gts": "", "score": 1.0, "step": 3, "total_turns": ""}
    again = readers.read_rollouts(spark, str(tmp_path / "out"), "input string, output string, step int, score double")
    assert [(r.step, r.output) for r in again.collect()] == [(3, "o\n\"x\"")]


def test_url_lists(spark, tmp_path):
    cases = {
        '[{"url": "a"}, {"link": "b"}, {"x": 1}, "ignored"]': ["a", "b"], '{"links": ["c", {"url": "d"}, ""]}': ["c", "d"],
        '{"data": [{"link": "e"}], "n": 1}': ["e"], '{"other": 1}': [],
    }
    for i, (text, want) in enumerate(cases.items()):
        p = tmp_path / f"{i}.json"
        p.write_text(text)
        assert sorted(r.url for r in readers.read_url_list(spark, str(p)).collect()) == want
    lines(tmp_path / "u.txt", [" x ", "", "y"])
    assert [r.url for r in readers.read_url_list(spark, str(tmp_path / "u.txt"), is_json=False).collect()] == ["x", "y"]


def test_questions_and_runs(spark, tmp_path):
    rows = [{"question": " q1 "}, {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "Intro User: q2"}]}, {"question": ""}]
    want = ["q1", "q2"]
    assert sorted(r.question for r in readers.read_questions(spark, lines(tmp_path / "q.jsonl", rows)).collect()) == want
    (tmp_path / "q.json").write_text(json.dumps(rows, indent=1))
    assert sorted(r.question for r in readers.read_questions(spark, str(tmp_path / "q.json")).collect()) == want
    (tmp_path / "run.json").write_text(json.dumps({"metadata": {"model": "m"}, "records": [{"question": "q", "rollout_idx": 2, "judge": {"status": "ok", "correct": "true"}}]}))
    run = readers.read_eval_run(spark, str(tmp_path / "run.json")).first()
    assert (run.question, run.rollout_idx, run.judge.status) == ("q", 2, "ok")


def test_pending(spark):
    files = spark.createDataFrame([("x-0010.json.gz",), ("x-0002.json.gz",), ("odd.json",), ("x-0001.json.gz",)], "file string")
    done = spark.createDataFrame([("x-0001.json.gz",)], "file string")
    assert [r.file for r in readers.pending_files(files, done).collect()] == ["x-0002.json.gz", "x-0010.json.gz", "odd.json"]


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 3).cast("string").alias("src"))
    sinks.write_labelled(df, str(tmp_path / "l"), F.when(F.col("id") < 4, "positive").otherwise("negative"))
    assert spark.read.json(str(tmp_path / "l") + "/label=positive").count() == 4
    sinks.write_parts(df.coalesce(1), str(tmp_path / "p"), 3)
    assert len(list((tmp_path / "p").glob("part-*"))) == 4
    for how, want in (("even", [0, 3, 9]), ("first", [0, 1, 2]), ("per_source", [0, 1, 2])):
        sinks.write_with_sample(df, str(tmp_path / "t"), str(tmp_path / "j"), 3, ["id"], how, "src")
        assert sorted(r.id for r in spark.read.json(str(tmp_path / "j")).collect()) == want
    sinks.save(df, str(tmp_path / "s"), "create")
    with pytest.raises(Exception, match="already exists"):
        sinks.save(df, str(tmp_path / "s"), "create")
    sinks.save(df, str(tmp_path / "s"), "append")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 20
    sinks.swap_table(spark.read.parquet(str(tmp_path / "s")).filter("id < 5"), str(tmp_path / "s"), str(tmp_path / "s.new"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 10
