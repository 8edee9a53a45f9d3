"""The reflection loop: its outcomes, retries, failures and parsing."""

import json

import pytest
from pyspark.sql import functions as F

from claimloom.functions import constants as C
from claimloom.operators import reflect

PARIS = "Paris is the capital of France."
GOOD = "Verdict: SUPPORTED based on [1]; the claim is grounded in that evidence [1] because Paris is the capital of France."
BAD = "Verdict: SUPPORTED based on [99]; unsupported citation"


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(1, "Paris is in France")], "query_id long, text string")


def retriever(spark, texts=(PARIS,)):
    rows = [(i + 1, None, t) for i, t in enumerate(texts)]
    held = spark.createDataFrame(rows, "rank int, title string, text string")
    return lambda claims, k: claims.select("query_id").crossJoin(held.where(F.col("rank") <= k))


def stub(confidence=0.9):
    return lambda pairs: pairs.select("query_id").distinct().select("query_id", F.lit(C.SUPPORTED).alias("verdict"), F.lit(confidence).alias("confidence"))


def outcome(*args, **kw):
    (row,) = reflect.reflection_loop(*args, **kw).collect()
    return row.asDict()


def test_success(spark, one):
    got = outcome(one, retriever(spark), verify=stub(), threshold=0.5)
    assert got["decision"] == "final" and got["citation_valid"] and got["retries_used"] == 0 and got["citations"] == [1]


def test_low_confidence_abstains(spark, one):
    got = outcome(one, retriever(spark), verify=stub(0.2), threshold=0.5)
    assert got["decision"] == "abstain" and got["confidence"] == 0.2 and got["retries_used"] == 0


def test_second_try_succeeds(spark, one):
    made = reflect.generator(lambda: lambda prompt, attempt: BAD if attempt == 0 else GOOD)
    got = outcome(one, retriever(spark), verify=stub(), threshold=0.5, generate=made, max_retries=2)
    assert got["decision"] == "final" and got["retries_used"] == 1 and got["explanation"] == GOOD


@pytest.mark.parametrize("most", [0, 1, 2])
def test_retries_run_out(spark, one, most):
    made = reflect.generator(lambda: lambda prompt, attempt: BAD)
    got = outcome(one, retriever(spark), verify=stub(), generate=made, max_retries=most)
    assert got["decision"] == "abstain" and got["retries_used"] == most and got["citation_precision"] == 0.0 and got["explanation"] == BAD


def test_no_rounds(spark, one):
    got = outcome(one, retriever(spark), verify=stub(), max_retries=-1)
    assert got["decision"] == "abstain" and got["verdict"] is None and got["explanation"] == ""


def test_pending_claims_shrink(spark):
    """Claims need 0 to 3 rounds; each is asked once a round and never after it passed."""
    claims = spark.createDataFrame([(i, f"Paris is in France {'x' * i}") for i in range(8)], "query_id long, text string")
    asked = spark.sparkContext.accumulator(0)

    def load():
        def model(prompt, attempt):
            asked.add(1)
            return GOOD if attempt >= prompt.count("x") % 4 else BAD

        return model

    made = reflect.generator(load)
    got = {r["query_id"]: r["retries_used"] for r in reflect.reflection_loop(claims, retriever(spark), verify=stub(), generate=made, max_retries=3).collect()}
    # the prompt's fixed words hold two x: explanation and evidence do not count, "concise explanation" does
    shift = C.EXPLANATION_PROMPT.count("x")
    assert got == {i: (i + shift) % 4 for i in range(8)}
    assert asked.value == sum(v + 1 for v in got.values())


def test_failures_stay_in_their_row(spark):
    claims = spark.createDataFrame([(1, "Paris fails"), (2, "Paris works"), (3, "Paris works late")], "query_id long, text string")
    tries = {}

    def model(prompt, attempt):
        if "fails" in prompt:
            raise OSError("down")
        if "late" in prompt and tries.setdefault("late", 0) < 2:
            tries["late"] += 1
            raise TimeoutError("slow")
        return GOOD

    got = {r["query_id"]: r for r in reflect.reflection_loop(claims, retriever(spark), verify=stub(), generate=reflect.generator(lambda: model), max_retries=0).collect()}
    assert [got[i]["decision"] for i in (1, 2, 3)] == ["abstain", "final", "final"]
    assert got[1]["explanation"] == "Explanation unavailable: OSError: down."

    def broken():
        raise RuntimeError("no model")

    (row,) = reflect.reflection_loop(claims.where("query_id = 2"), retriever(spark), verify=stub(), generate=reflect.generator(broken)).collect()
    assert row["decision"] == "abstain" and "no model" in row["explanation"]


def test_ranker(spark, one):
    texts = ("Berlin lies on the Spree.", PARIS)
    turn = lambda pairs: pairs.withColumn("rank", 3 - F.col("rank"))
    assert PARIS.rstrip(".") in outcome(one, retriever(spark, texts), rank=turn, verify=stub())["explanation"]

    def fails(pairs):
        raise ValueError("no ranker")

    assert "Berlin" in outcome(one, retriever(spark, texts), rank=fails, verify=stub())["explanation"]


def test_without_evidence_and_claims(spark, one):
    none = lambda claims, k: retriever(spark)(claims, k).where("1 = 0")
    got = outcome(one, none)
    assert got["verdict"] == C.NEI and got["decision"] == "abstain" and got["confidence"] == C.NO_EVIDENCE_CONFIDENCE
    assert reflect.reflection_loop(one.where("1 = 0"), retriever(spark)).count() == 0


def test_parsing(spark):
    replies = {
        json.dumps({"explanation": "so [1]", "citations": [2, "1", " 3 ", "x", 2]}): ("so [1]", [1, 2, 3]),
        'text before {"explanation": "in", "citations": ["4"]} and after': ("in", [4]),
        '{"citations": [1]}': ('{"citations": [1]}', [1]),
        "plain [2] and [1] words [7]. [[3]] [x]": ("plain [2] and [1] words [7]. [[3]] [x]", [1, 2, 3]),
        "[1, 2]": ("[1, 2]", []),
        "broken {json": ("broken {json", []),
        "": ("", []),
    }
    df = spark.createDataFrame([(r,) for r in replies], "reply string").select("reply", reflect.parsed(F.col("reply")).alias("p"))
    assert {r["reply"]: (r["p"]["explanation"], r["p"]["citations"]) for r in df.collect()} == replies


def test_choice_of_generator():
    assert reflect.choose_generator("template") is None and reflect.choose_generator("model") is None
    assert reflect.choose_generator("model", lambda: lambda p, a: p) is not None
    with pytest.raises(ValueError, match="unknown"):
        reflect.choose_generator("other")
