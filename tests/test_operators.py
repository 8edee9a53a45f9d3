"""Retrieval, ranking, verification, metrics, de-duplication, grids and builders on small literals."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import audit, builders, dedupe, grids, metrics, ranking, sampling, verify
from claimloom.operators import retrieval as R


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def capitals(spark):
    return frame(spark, [(0, "Paris is the capital of France."), (1, "Berlin is the capital of Germany."), (2, "Rome is a city.")], "ord long, text string")


def test_bm25(spark, capitals):
    q = frame(spark, [(1, "What is the capital of France?"), (2, "zzz")], "query_id long, text string")
    rows = {(r["query_id"], r["rank"]): (r["ord"], r["score"]) for r in R.bm25_topk(q, capitals, 2).collect()}
    assert rows[1, 1][0] == 0
    assert rows[2, 1] == (0, 0.0) and rows[2, 2] == (1, 0.0)  # no match: by place
    assert R.bm25_topk(q, capitals.where("ord < 0"), 2).count() == 0


def test_rrf_ties_by_first_seen(spark):
    lists = [["a", "b", "c"], ["b", "a", "d"]]
    rows = [(1, i, d, r + 1) for i, x in enumerate(lists) for r, d in enumerate(x)]
    got = R.rrf(frame(spark, rows, "query_id long, list_no int, ord string, rank int")).orderBy("fused_rank").collect()
    assert [r["ord"] for r in got][:2] == ["a", "b"]


def test_metrics_constants(spark):
    ranking_ = frame(spark, [(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, ord string, rank int")
    gold = frame(spark, [(1, "c"), (1, "d")], "query_id long, ord string")
    q = frame(spark, [(1,), (2,)], "query_id long")
    rows = {r["query_id"]: r for r in metrics.per_query(ranking_, gold, q, (3,), (5,)).collect()}
    assert rows[1]["recall_3"] == 0.5 and rows[1]["rr"] == pytest.approx(1 / 3) and rows[1]["ap"] == pytest.approx(1 / 6)
    assert rows[2]["recall_3"] == 0.0
    with pytest.raises(ValueError):
        metrics.parse_cutoffs(" , ")
    assert metrics.parse_cutoffs("5,1,5") == [1, 5]


def test_classification(spark):
    pairs = frame(spark, [("a", "a"), ("b", "a"), ("b", "b")], "y string, p string")
    assert metrics.accuracy(pairs).first()["accuracy"] == pytest.approx(2 / 3)
    f1 = {r["label"]: r["f1"] for r in metrics.per_class(pairs).collect()}
    assert f1["a"] == pytest.approx(2 / 3) and f1["b"] == pytest.approx(2 / 3)
    assert metrics.accuracy(pairs.where("y = 'z'")).first()["accuracy"] == 0.0


def test_calibration(spark):
    rows = frame(spark, [(True, 1.0), (False, 0.95), (True, 0.0)], "correct boolean, confidence double")
    bins = {r["bin"]: r for r in metrics.calibration_bins(rows).collect()}
    assert len(bins) == 10 and bins[9]["n"] == 2 and bins[9]["accuracy"] == 0.5 and bins[3]["n"] == 0
    assert metrics.expected_calibration_error(rows).first()["ece"] == pytest.approx(2 / 3 * abs(0.5 - 0.975) + 1 / 3)


def test_percentiles(spark):
    rows = frame(spark, [(float(x),) for x in range(10)], "v double")
    assert metrics.nearest_rank_percentiles(rows, "v", (50.0, 95.0)).first()[:] == (4.0, 9.0)


def test_verifier(spark):
    pairs = frame(spark, [(1, "Paris is a capital", 1, "Paris is a capital"), (1, "Paris is a capital", 2, "x"), (2, "Paris is big", 1, "Paris is not big"), (3, "a b c d", 1, "z")], "query_id long, claim string, rank int, text string")
    got = {r["query_id"]: r for r in verify.aggregate_claims(verify.verify_passages(pairs)).collect()}
    assert got[1]["verdict"] == "SUPPORTED" and got[1]["confidence"] == 0.7 and got[1]["winning_rank"] == 1
    assert got[2]["verdict"] == "REFUTED" and got[2]["confidence"] == pytest.approx(0.95)
    assert got[3]["verdict"] == "NOT ENOUGH INFO" and got[3]["confidence"] == 0.45
    claims = frame(spark, [(1,), (9,)], "query_id long")
    none = {r["query_id"]: r for r in verify.with_no_evidence(claims, verify.aggregate_claims(verify.verify_passages(pairs))).collect()}
    assert none[9]["verdict"] == "NOT ENOUGH INFO" and none[9]["confidence"] == 0.34


def test_decisions(spark):
    d = lambda s, r, a=0.5, b=0.5: spark.range(1).select(verify.decide(F.lit(s), F.lit(r), a, b)).first()[0]
    assert d(0.2, 0.7, 0.55, 0.5) == "REFUTED" and d(0.4, 0.3) == "NOT ENOUGH INFO" and d(0.6, 0.6) == "NOT ENOUGH INFO"


def test_dedupe(spark):
    texts = frame(spark, [(0, "Alpha", "a"), (1, "Alpha", "b"), (2, "Beta", "c"), (3, None, "d"), (4, None, "e")], "ord long, text string, doc_id string")
    assert [r["ord"] for r in dedupe.keep_first(texts, ["text"], ["ord"]).orderBy("ord").collect()] == [0, 2, 3]
    near = spark.range(1).select(dedupe.near_duplicate(F.lit("alpha beta"), F.lit("beta alpha"), 0.5), dedupe.near_duplicate(F.lit(""), F.lit(" "))).first()
    assert near[0] and near[1]
    a = frame(spark, [("a", "x", 0), ("a", "y", 1), ("b", " ", 2), ("c", "z", 3)], "doc_id string, text string, ord long")
    assert sorted(r["doc_id"] for r in dedupe.assemble_corpus([a]).collect()) == ["a", "c"]


def test_near_duplicate_pairs_against_all(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) for _ in range(60)]
    got = dedupe.near_duplicate_pairs(frame(spark, list(enumerate(texts)), "ord long, text string"), 0.7).collect()
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(t.split()), i)
    sets = {i: s for s, i in first.items()}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert {(r["a"], r["b"]) for r in got} == want


def test_pareto(spark):
    pts = frame(spark, [("best", 0.9, 10.0, 10.0, 0.9), ("worse", 0.8, 20.0, 20.0, 0.8), ("tradeoff", 0.5, 1.0, 1.0, 0.95), ("best2", 0.9, 10.0, 10.0, 0.9)], "model string, macro_f1 double, latency_ms double, memory_mb double, deployment_feasibility double")
    assert {r["model"] for r in grids.pareto_frontier(pts).collect()} == {"best", "best2", "tradeoff"}


def test_bootstrap(spark):
    rows = frame(spark, [(0, 0.2, 0.3), (1, 0.4, 0.5), (2, 0.6, 0.7)], "ord long, a double, b double")
    r = sampling.bootstrap(rows, 100).first()
    assert r["delta"] == pytest.approx(0.1) and r["ci_low"] <= r["delta"] + 1e-9 and r["ci_high"] >= r["delta"] - 1e-9
    assert sampling.bootstrap(rows.where("ord < 0")).first()["delta"] == 0.0


def test_split_is_disjoint_and_clamps(spark):
    ten = spark.range(10)
    s = {r["id"]: r["split"] for r in sampling.split(ten, 4, "id").collect()}
    assert sorted(s.values()).count("val") == 4 and s == {r["id"]: r["split"] for r in sampling.split(ten, 4, "id").collect()}
    assert {r["split"] for r in sampling.split(ten, 99, "id").collect()} == {"val"}


def test_round_robin(spark):
    rows = frame(spark, [(0, "a"), (1, "a"), (2, "b"), (3, "a")], "ord long, k string")
    assert [r["ord"] for r in sampling.round_robin(rows, ["k"], 3).orderBy("turn").collect()] == [0, 2, 1]


def test_mining_excludes_the_positive(spark):
    corpus = frame(spark, [(i, f"text {i}") for i in range(12)], "ord long, text string")
    claims = frame(spark, [(1, "c", "text 0", "SUPPORTED")], "query_id long, claim string, positive string, label string")
    bm25 = frame(spark, [(1, i, i + 1) for i in range(8)], "query_id long, ord long, rank int")
    dense = frame(spark, [(1, i, i + 1) for i in range(1, 10)], "query_id long, ord long, rank int")
    got = builders.mine_negatives(claims, corpus, bm25, dense).collect()
    texts = [r["text"] for r in got]
    assert len(texts) == len(set(texts)) == 5 and "text 0" not in texts
    assert sorted(r["text"] for r in got if r["negative_type"] == "bm25_hard_negative") == ["text 1", "text 2"]
    assert sorted(r["text"] for r in got if r["negative_type"] == "dense_hard_negative") == ["text 3", "text 4"]
    retriever, pairs = builders.training_pairs(claims, builders.mine_negatives(claims, corpus, bm25, dense))
    assert len(retriever.first()["hard_negatives"]) == 5 and pairs.where("relevance = 1").count() == 1


def test_random_negatives_come_from_the_whole_corpus(spark):
    corpus = frame(spark, [(i, f"text {i % 300}") for i in range(600)], "ord long, text string")
    claims = frame(spark, [(q, "c", f"text {q % 300}", "SUPPORTED") for q in range(400)], "query_id long, claim string, positive string, label string")
    none = frame(spark, [], "query_id long, ord long, rank int")
    rows = builders.mine_negatives(claims, corpus, none, none).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], set()).add(r["text"])
    assert len(by) == 400 and all(len(t) == 5 and f"text {q % 300}" not in t for q, t in by.items())
    assert len(set().union(*by.values())) == 300
    few = builders.mine_negatives(claims.where("query_id = 0"), corpus.where("ord < 3"), none, none).collect()
    assert {r["text"] for r in few} == {"text 1", "text 2"} and {r["negative_type"] for r in few} == {"random_negative"}
    assert builders.mine_negatives(claims, corpus.where("ord < 0"), none, none).count() == 0


def test_dense_against_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    d = np.round(rng.normal(size=(150, 4)), 1)
    d[::7] = d[0]
    d[5] = 0
    q = np.round(rng.normal(size=(9, 4)), 1)
    corpus = frame(spark, [(i, v.tolist()) for i, v in enumerate(d)] + [(999, None)], "ord long, vector array<double>").repartition(3)
    queries = frame(spark, [(f"q{i}", v.tolist()) for i, v in enumerate(q)] + [("none", None)], "query_id string, vector array<double>")
    for metric in ("cosine", "ip"):
        got = {(r["query_id"], r["rank"]): (r["ord"], r["score"]) for r in R.dense_topk(queries, corpus, 10, metric).collect()}
        s = q @ d.T
        if metric == "cosine":
            s = s / np.linalg.norm(q, axis=1)[:, None] / np.maximum(np.linalg.norm(d, axis=1), 1e-300)[None]
        assert len(got) == 90
        for i in range(9):
            order = sorted(range(150), key=lambda j: (-round(s[i, j], 9), j))[:10]
            assert [got[f"q{i}", r + 1][0] for r in range(10)] == order
            assert all(abs(got[f"q{i}", r + 1][1] - s[i, order[r]]) < 1e-12 for r in range(10))
    assert R.dense_topk(queries, corpus.where("ord < 0"), 3).count() == 0 and R.dense_topk(queries.where("query_id = ''"), corpus, 3).count() == 0


def test_okapi_fills_up_with_unmatched_passages(spark):
    texts = ["common word"] * 6 + ["rare common", "other thing", "third", "x common"]
    corpus = frame(spark, list(enumerate(texts)), "ord long, text string")
    q = frame(spark, [(1, "common"), (2, "rare"), (3, "nothing here")], "query_id long, text string")
    full = R.bm25_scores(q, corpus, variant="okapi").collect()
    score = {(r["query_id"], r["ord"]): r["score"] for r in full}
    for k in (1, 3, 10):
        got = {}
        for r in R.bm25_topk(q, corpus, k, variant="okapi").collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = r["ord"]
        for i in (1, 2, 3):
            assert [got[i][r] for r in sorted(got[i])] == sorted(range(10), key=lambda o: (-round(score.get((i, o), 0.0), 9), o))[:k]


def test_keep_first_prunes_before_the_shuffle(spark):
    df = frame(spark, [(i, "same") for i in range(20)], "ord long, text string")
    got = dedupe.keep_first(df, ["text"], ["ord"])
    assert [r["ord"] for r in got.collect()] == [0] and "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_preferences(spark):
    good = '{"verdict": "SUPPORTED", "explanation": "[1] Paris is the capital.", "citations": ["1"]}'
    ctx = F.array(F.struct(F.lit(1).alias("citation_id"), F.lit(None).cast("string").alias("title"), F.lit("Paris is the capital.").alias("text")))
    rows = frame(spark, [(1, 0, "no json"), (1, 1, good), (1, 2, good)], "query_id long, candidate int, answer string")
    scored = rows.select("query_id", "candidate", ranking.preference_score("answer", F.lit("SUPPORTED"), ctx).alias("s")).select("query_id", "candidate", "s.*")
    assert {r["candidate"]: r["score"] for r in scored.collect()} == {0: -1.5, 1: 4.5, 2: 4.5}
    assert ranking.best_candidate(scored).first()["candidate"] == 1


def test_sft_and_dpo(spark):
    rows = frame(spark, [("1", "Claim.", "supports", "It is so.", "s", "gold"), ("2", "Claim.", "x", " ", "s", None)], "claim_id string, claim string, label string, evidence string, source string, evidence_type string")
    sft = builders.sft_records(rows, "train")
    r = {x["claim_id"]: x for x in sft.collect()}
    assert r["1"]["completion"] == 'Decision: SUPPORTED\nExplanation: It is so therefore the claim is supported.\nCitations: ["E1"]'
    assert "(no evidence provided)" in r["2"]["prompt"] and r["2"]["citations"] == []
    assert sft.where(F.size(builders.sft_violations(F.col("prompt"))) > 0).count() == 0
    pairs = builders.dpo_pairs(sft)
    assert pairs.where(F.size(builders.dpo_violations(F.col("prompt"))) > 0).count() == 0


def test_audit(spark):
    rows = frame(spark, [("a b", "x y z", "train"), ("a b", "", "val")], "claim string, evidence string, split string")
    r = audit.quality_audit(rows).first()
    assert (r["duplicate_claims"], r["missing_evidence"], r["average_evidence_length"]) == (1, 1, 3.0)


def test_linear_ranker(spark):
    rows = frame(spark, [(1, 2.0), (0, 0.5)], "relevance int, f double")
    assert ranking.linear_ranker(rows, ("f",)).first()["w_f"] == 1.5
    assert ranking.linear_ranker(rows.where("relevance = 0"), ("f",)).first()["w_f"] == 0.0
    assert ranking.linear_ranker(rows.where("relevance = 1"), ("f",)).first()["w_f"] == 1.0


def test_global_numbers(spark):
    import random

    from claimloom.operators import numbering

    rng = random.Random(8)
    numbers = spark.createDataFrame([(rng.randrange(10**6), "".join(rng.choices("aébΩ", k=rng.randint(0, 4)))) for _ in range(500)], "x long, s string").dropDuplicates(["x"])
    rows = numbering.numbered_by(numbers, "x").collect()
    assert [r["x"] for r in sorted(rows, key=lambda r: r["rn"])] == sorted(r["x"] for r in rows)
    named = numbers.dropDuplicates(["s"])
    rows = numbering.numbered_by(named, "s").collect()
    assert [r["s"] for r in sorted(rows, key=lambda r: r["rn"])] == sorted(r["s"] for r in rows)
    assert sorted(r["rn"] for r in rows) == list(range(1, len(rows) + 1))
    assert numbering.numbered_by(numbers.where("x < 0"), "x").count() == 0
    ids = spark.createDataFrame([(f"doc_{i:06d}",) for i in rng.sample(range(10**6), 500)], "id string")
    rows = numbering.numbered_by(ids, "id").collect()
    assert [r["id"] for r in sorted(rows, key=lambda r: r["rn"])] == sorted(r["id"] for r in rows)
    assert ids.select(numbering.bucket_of(ids, "id")).distinct().count() > 50


def test_bm25_topk_keeps_no_postings(spark, monkeypatch):
    """First places as from all scores, over several chunks of queries and batches of passages, without postings or a score a pair being shuffled."""
    import numpy as np

    rng = np.random.default_rng(11)
    texts = [" ".join(f"w{min(i, 30)}" for i in rng.geometric(0.15, size=rng.integers(0, 12))) for _ in range(80)] + [None]
    corpus = frame(spark, list(enumerate(texts)), "ord long, text string").repartition(3)
    q = frame(spark, [((i, 1), " ".join(f"w{j}" for j in rng.integers(1, 40, size=6))) for i in range(7)] + [((9, 1), "none")], "query_id struct<a:int,b:int>, text string")
    all_ = {}
    for r in R.bm25_scores(q, corpus).collect():
        all_.setdefault(tuple(r["query_id"]), {})[r["ord"]] = r["score"]

    def never(*_, **__):
        raise AssertionError("postings are made")

    monkeypatch.setattr(R, "CHUNK", 3)
    monkeypatch.setattr(R, "BATCH_ROWS", 7)
    monkeypatch.setattr(R, "postings", never)
    monkeypatch.setattr(R, "bm25_scores", never)
    got = {}
    for r in R.bm25_topk(q, corpus, 5).collect():
        got.setdefault(tuple(r["query_id"]), {})[r["rank"]] = (r["ord"], r["score"])
    assert len(got) == 8
    for i, found in got.items():
        score = {o: 0.0 for o in range(81)} | all_.get(i, {})
        order = sorted(score, key=lambda o: (-round(score[o], 9), o))[:5]
        assert [found[r][0] for r in range(1, 6)] == order
        assert all(abs(found[r + 1][1] - score[o]) < 1e-9 for r, o in enumerate(order))


def test_bm25_matrix_by_slices(monkeypatch):
    import numpy as np

    dl, toks = np.array([3, 0, 2]), np.array([5, 5, 7, 7, 9])
    q, h, w = np.array([0, 0, 1, 1]), np.array([5, 7, 7, 11]), np.array([2.0, 1.0, 3.0, 4.0])
    whole = R.bm25_matrix(dl, toks, q, h, w, 2.0, 1.5, 0.75)
    monkeypatch.setattr(R, "SLICE", 1)
    assert np.allclose(whole, R.bm25_matrix(dl, toks, q, h, w, 2.0, 1.5, 0.75)) and whole[1, 1] == 0 and whole[1, 2] > 0
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert np.allclose(whole[0], [2 * part(2, 3) + part(1, 3), 0, part(1, 2)])


def test_channels_are_worked_out_once(spark, capitals, monkeypatch):
    q = frame(spark, [(1, "capital of France")], "query_id long, text string")
    seen = []
    one, two = R.bm25_topk, R.dense_topk
    monkeypatch.setattr(R, "bm25_topk", lambda *a, **o: seen.append("bm25") or one(*a, **o))
    monkeypatch.setattr(R, "dense_topk", lambda *a, **o: seen.append("dense") or two(*a, **o))
    kept = {}
    rows = [R.retrieve(q, capitals, m, 10, kept).count() for m in ("bm25", "dense", "hybrid")]
    assert rows == [3, 3, 3] and seen == ["bm25", "dense"]


def test_near_duplicates_move_only_first_tokens(spark, monkeypatch):
    """All pairs at the threshold, each proposed once, from a tenth of the tokens; long common parts included."""
    import random

    draw = random.Random(4)
    texts = {}
    for i in range(30):
        words = [f"c{j}" for j in range(60)] + [f"o{i}_{j}" for j in range(draw.choice([3, 10, 140]))]
        for k in range(3):
            texts[3 * i + k] = " ".join(words[: len(words) - k])
    texts[500], texts[501], texts[502] = "", None, texts[0]
    made, real = [], dedupe.written
    monkeypatch.setattr(dedupe, "written", lambda df: made.append(real(df)) or made[-1])
    got = {(r["a"], r["b"]): r["similarity"] for r in dedupe.near_duplicate_pairs(frame(spark, list(texts.items()), "ord long, text string").repartition(3)).collect()}
    sets = {}
    for o in sorted(texts):
        sets.setdefault(frozenset((texts[o] or "").split()), o)
    sets = {o: s for s, o in sets.items() if s}
    want = {(a, b): len(s & t) / len(s | t) for a, s in sets.items() for b, t in sets.items() if a < b and len(s & t) >= 0.9 * len(s | t)}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    assert made[0].agg(F.sum(F.size("keys"))).first()[0] <= 0.1 * sum(map(len, sets.values())) + 2 * len(sets)
    same = {(r["ord"], r["rep"]) for r in dedupe.membership(frame(spark, list(texts.items()), "ord long, text string")).collect()}
    assert (502, 0) in same and (1, 1) in same and (500, 500) in same


def test_known_terms_alone_leave_the_worker(spark):
    """What scores passages gets the hashes of the queries' terms only, and lengths of all tokens."""
    import numpy as np
    import pyarrow as pa

    texts = pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array(["a b b zzz", "yyy a"])], names=["ord", "text"])
    (out,) = R._packed(pa.int64(), [b"a", b"b"])(iter([texts]))
    sizes, had, hashes = (np.frombuffer(out.column(i)[0].as_py(), kind).tolist() for i, kind in ((1, np.int32), (2, np.int32), (3, np.int64)))
    assert (sizes, had) == ([4, 2], [3, 1]) and hashes == [R._hash(t) for t in (b"a", b"b", b"b", b"a")]
    (found,) = R._frequencies([b"a", b"b"])(iter([texts.select(["text"])]))
    assert found.to_pydict() == {"term": ["", "a", "b"], "df": [2, 2, 1], "dl": [6, 0, 0]}


def test_containing_by_either_way(spark, monkeypatch):
    """Few queries go to the passages; more are joined: the same pairs, also for short, empty and null texts."""
    docs = frame(spark, [(1, "one two three four"), (2, "two three fourth"), (3, None), (4, "")], "ord long, text string")
    q = frame(spark, [(1, "two three four"), (2, "three"), (3, ""), (4, None), (5, "one two three four five")], "query_id long, text string")
    few = sorted(map(tuple, R.containing(q, docs).collect()))
    assert few == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (3, 2), (3, 4)]
    monkeypatch.setattr(R, "is_small", lambda *a, **k: False)
    assert sorted(map(tuple, R.containing(q, docs).collect())) == few


def test_bundles_pass_tokens_not_texts(spark):
    """The result of a bundle is that of its joined text, and no text of a passage is gathered."""
    rows = [(1, "The cat is here", 1, "the CAT"), (1, "The cat is here", 2, None), (1, "The cat is here", 3, "was not\there"), (2, "a dog", 1, None), (3, "a b c", 1, "x not y"), (3, "a b c", 2, "z"), (4, "a b c d", 1, "c"), (4, "a b c d", 2, "B"), (5, "", 1, "not")]
    pairs = spark.createDataFrame(rows, "query_id long, claim string, rank int, text string")
    got = verify.verify_bundle(pairs)
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    texts = {}
    for q, c, _, t in rows:
        texts.setdefault((q, c), []).append(t)
    whole = spark.createDataFrame([(q, c, "\n".join(t for t in x if t is not None)) for (q, c), x in texts.items()], "query_id long, claim string, text string")
    want = whole.select("query_id", verify.rule_verdict("claim", "text").alias("r")).select("query_id", "r.*")
    assert sorted(got.collect()) == sorted(want.collect()) and [r["verdict"] for r in sorted(got.collect())] == ["REFUTED", "NOT ENOUGH INFO", "NOT ENOUGH INFO", "SUPPORTED", "NOT ENOUGH INFO"]


def test_oracle_texts_are_not_shuffled(spark):
    """Gold passages are few: they go to the texts, not the texts to them."""
    from claimloom.plans import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, oracle, _ = queries._evidences(spark, "/root/testdata/sf0.001")
        plan = oracle._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("variant", ["fallback", "okapi"])
def test_bm25_scores_are_worked_out_where_passages_lie(spark, monkeypatch, variant):
    """All pairs that share a term, over several chunks of queries and pieces of batches; no pair goes through an exchange."""
    import math

    import numpy as np

    rng = np.random.default_rng(12)
    texts = [" ".join(f"w{min(i, 30)}" for i in rng.geometric(0.15, size=rng.integers(0, 12))) for _ in range(80)] + [None, "half"]
    texts = [t if i % 2 or t is None else f"{t} half" for i, t in enumerate(texts)]
    corpus = frame(spark, list(enumerate(texts)), "ord long, text string").repartition(3)
    asked = {f"q{i}": " ".join(f"w{j}" for j in rng.integers(1, 40, size=6)) for i in range(7)} | {"none": "none", "half": "half half"}
    monkeypatch.setattr(R, "CHUNK", 3)
    monkeypatch.setattr(R, "BATCH_ROWS", 7)
    monkeypatch.setattr(R, "PAIRS", 5)
    got = R.bm25_scores(frame(spark, list(asked.items()), "query_id string, text string"), corpus, variant=variant)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "").replace("Exchange RoundRobin", "")
    docs = [(t or "").split() for t in texts]
    n, mean = len(docs), sum(map(len, docs)) / len(docs)
    df = {t: sum(t in d for d in docs) for t in {t for d in docs for t in d}}
    raw = {t: math.log(n - x + 0.5) - math.log(x + 0.5) for t, x in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: math.log((n - x + 0.5) / (x + 0.5) + 1) if variant == "fallback" else floor if raw[t] < 0 else raw[t] for t, x in df.items()}
    want = {(i, o): sum(idf[t] * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / mean)) for t in text.split() if t in d) for i, text in asked.items() for o, d in enumerate(docs) if set(text.split()) & set(d)}
    found = got.collect()
    assert len(found) == len(want) == len({(r["query_id"], r["ord"]) for r in found})
    assert all(abs(r["score"] - want[r["query_id"], r["ord"]]) < 1e-9 for r in found)
