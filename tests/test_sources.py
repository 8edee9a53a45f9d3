"""Sources, sinks and normalisers on small files and literals."""

import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from claimloom.operators import builders
from claimloom.sources import artifacts as A
from claimloom.sources import claims as S
from claimloom.sources import jsonl as J


def write(path, rows):
    path.write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows) + "\n\n", encoding="utf-8")
    return str(path)


def test_jsonl(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", [{"doc_id": "x", "text": "T", "metadata": {"split": "s"}}, {"text": None}])
    rows = J.with_place(J.read_jsonl(spark, p, J.CORPUS)).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == [0, 1] and rows[0]["metadata"] == {"split": "s"} and rows[1]["text"] is None
    assert J.read_jsonl(spark, str(tmp_path / "none.jsonl"), J.CORPUS).count() == 0
    with pytest.raises(FileNotFoundError):
        J.read_jsonl(spark, str(tmp_path / "none.jsonl"), J.CORPUS, strict=True)


def test_splits(spark, tmp_path):
    write(tmp_path / "fever_val.jsonl", [{"claim_id": "1", "claim": "c", "label": "NOT_ENOUGH_INFO", "evidence": [{"doc_id": "d", "text": "t"}]}])
    got = J.read_splits(spark, str(tmp_path), ["fever_val", "scifact_val"])
    r = got.first()
    assert r["label"] == "NOT ENOUGH INFO" and r["evidence"][0]["text"] == "t" and got.count() == 1
    assert J.select_splits(got, suffix="_val").count() == 1 and J.select_splits(got, prefixes=("scifact",)).count() == 0


def test_corpus(spark, tmp_path):
    assert J.read_corpus(spark, None).count() == len(J.DEMO)
    p = write(tmp_path / "c.jsonl", [{"text": " a "}, {"doc_id": "q", "text": " "}])
    assert [r["doc_id"] for r in J.read_corpus(spark, p).orderBy("ord").collect()] == ["0", "q"]
    assert [r["text"] for r in J.read_corpus(spark, p, trimmed=True).collect()] == ["a"]
    J.write_jsonl(J.read_corpus(spark, p).select("doc_id", "text"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_page_cache(spark):
    rows = spark.createDataFrame([(0, "A", "old"), (1, "A", "new")], "ord long, title string, extract string")
    cache = S.page_cache(rows)
    assert cache.first()["extract"] == "new"
    titles = spark.createDataFrame([("A",), ("B",), ("B",), ("",)], "title string")
    assert [r["title"] for r in S.uncached(titles, cache).collect()] == ["B"]


def test_annotated_groups(spark):
    rows = spark.createDataFrame([(7, "c", "SUPPORTS", "VERIFIABLE", "train", [[["1", "2", "Paris_-LRB-x-RRB-", "1"], ["1", "3", "Gone_page", None]], [["4", None, None, None]]]), (8, "d", None, None, "", [])], "id long, claim string, label string, verifiable string, split string, evidence array<array<array<string>>>")
    cache = spark.createDataFrame([("Paris (x)", "First one. Second one.")], "title string, extract string")
    got = {r["claim_id"]: r for r in S.annotated_groups(rows, cache).collect()}
    e = got["7"]["evidence"]
    assert [x["doc_id"] for x in e] == ["Paris_-LRB-x-RRB-:1:0:0", "Gone_page:-1:0:1", ":-1:1:0"]
    assert [x["text"] for x in e] == ["Second one.", "Gone page", ""] and got["7"]["label"] == "SUPPORTED"
    assert got["8"]["label"] == "NOT_ENOUGH_INFO" and got["8"]["evidence"] == [] and got["8"]["split"] is None


def test_grouped_sentences(spark):
    corpus = S.abstracts(spark.createDataFrame([(5, "T", ["A b.", "", "C d."], False)], "doc_id long, title string, abstract array<string>, structured boolean"))
    assert corpus.first()["text"] == "A b. C d."
    rows = spark.createDataFrame([(1, "c", "dev", {"5": [([1], "CONTRADICT"), ([9], "SUPPORT")], "6": [([0], "SUPPORT")]}, [5]), (2, "d", "dev", {}, None)], "id long, claim string, split string, evidence map<string,array<struct<sentences:array<int>,label:string>>>, cited_doc_ids array<bigint>")
    got = {r["claim_id"]: r for r in S.grouped_sentences(rows, corpus).collect()}
    assert [e["text"] for e in got["1"]["evidence"]] == ["C d.", "A b. C d."] and got["1"]["label"] == "SUPPORTED"
    assert got["2"]["label"] == "NOT_ENOUGH_INFO" and got["2"]["evidence"] == []
    one = spark.createDataFrame([({"5": [([1], "CONTRADICT")]},)], "evidence map<string,array<struct<sentences:array<int>,label:string>>>")
    assert one.select(S.grouped_label(F.col("evidence"))).first()[0] == "REFUTED"


def test_flat_and_structured(spark):
    flat = S.flat_texts(spark.createDataFrame([(1, "c", "REFUTES", "s", ["x", "y"])], "id long, claim string, label string, split string, evidence array<string>")).first()
    assert [e["doc_id"] for e in flat["evidence"]] == ["0", "1"] and flat["label"] == "REFUTED"
    s = S.structured_texts(spark.createDataFrame([(1, "c", "x y", "s", [("9", "t", "T")])], "id long, claim string, label string, split string, evidence array<struct<doc_id:string,text:string,title:string>>")).first()
    assert s["label"] == "X_Y" and s["evidence"][0]["title"] == "T"


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        data = b'{"doc_id": 1}\n\n{"doc_id": 2}\n'
        info = tarfile.TarInfo("data/corpus.jsonl")
        info.size = len(data)
        tar.addfile(info, io.BytesIO(data))
    assert S.tar_lines(spark, str(tmp_path / "a.tar.gz"), "data/corpus.jsonl").count() == 2
    assert S.tar_lines(spark, str(tmp_path / "a.tar.gz"), "other").count() == 0


def test_flatten(spark):
    rows = spark.createDataFrame([("1", "c", "l", "s", {"a": "1", "b": "1"}, [("d", "t", "T", 0.5, {"b": "2"})])], f"claim_id string, claim string, label string, split string, metadata map<string,string>, evidence {J.EVIDENCE}")
    assert builders.flatten_corpus(rows).first()["metadata"] == {"a": "1", "b": "2"}


def test_artifacts(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.bin").write_bytes(b"x" * 1048576)
    (tmp_path / "sub" / ".gitkeep").write_text("")
    (tmp_path / "r.json").write_text('{"a": 1}')
    (tmp_path / "bad.json").write_text("{")
    assert A.list_artifacts(spark, str(tmp_path / "sub")).count() == 1
    assert A.folder_megabytes(spark, str(tmp_path / "sub")).first()[0] == 1.0
    assert A.load_report(spark, str(tmp_path / "r.json")) == {"a": 1} and A.load_report(spark, str(tmp_path / "bad.json")) is None and A.load_report(spark, str(tmp_path / "no.json")) is None
    with pytest.raises(KeyError):
        A.report_of("x", {}, spark)
    df = spark.createDataFrame([("a", 0.5)], "k string, v double")
    assert json.loads(A.report_json(df, ["k"])) == {"a": {"v": 0.5}} and A.report_markdown(df).endswith("| a | 0.5000 |")
    assert A.check_artifacts(spark, {"r": str(tmp_path / "r.json"), "n": str(tmp_path / "n")}) == {"r": True, "n": False}


def test_settings(tmp_path):
    s = A.load_settings({"top_k": "7", "query_expansion": "yes", "gate_threshold": "none"}, {"CLAIMLOOM_TOP_K": "9"})
    assert s.top_k == 9 and s.query_expansion is True and s.gate_threshold is None and s.rrf_k == 60
    (tmp_path / "c.yaml").write_text("retrieval:\n  mode: hybrid\ntop_k: 3\n")
    got = A.load_yaml(str(tmp_path / "c.yaml"))
    assert got["retrieval"]["mode"] == "hybrid" and int(got["top_k"]) == 3 and A.load_yaml(str(tmp_path / "no.yaml")) == {}
