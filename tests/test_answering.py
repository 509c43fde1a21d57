import json

import pytest

from spanwright.operators import answering as A
from spanwright.operators import context as C


@pytest.fixture(scope="module")
def world(spark):
    docs = spark.createDataFrame([(1, "The fee is due in  thirty days. It is final."), (2, "Other text.")], "doc_id int, text string")
    ctx = spark.createDataFrame([(q, "C1", 1, 0, 32) for q in range(1, 9)], "question_id int, label string, doc_id int, start_char int, end_char int")
    return docs, ctx


def reply(status="answered", cites=()):
    return json.dumps({"status": status, "answer": "x", "citations": [{"chunk_id": c, "quote": q} for c, q in cites]})


def test_every_outcome(spark, world):
    docs, ctx = world
    texts = {
        1: (reply(cites=[("C1", "fee is due")]), "stop"), 2: (reply(cites=[("C1", "due in thirty days")]), "stop"), 3: (reply(cites=[("C1", "fee was due")]), "stop"),
        4: (reply(cites=[("C1", "fee"), ("C9", "fee")]), "stop"), 5: (reply(), "stop"), 6: (reply("not_found"), "stop"), 7: ("{}", "stop"), 8: ('{"status"', "length"),
    }
    done = A.parsed(spark.createDataFrame([(q, t, 1, 1, "m", s) for q, (t, s) in texts.items()], "question_id int, text string, input_tokens long, output_tokens long, model string, stop_reason string"))
    checks = A.check_citations(done.filter("error IS NULL").select("question_id", "parsed.citations"), ctx, docs)
    asked = spark.createDataFrame([(q,) for q in range(1, 10)], "question_id int")
    gate = spark.createDataFrame([(q, q == 9) for q in range(1, 10)], "question_id int, gated boolean")
    got = {r["question_id"]: (r["status"], r["rejection_reasons"], r["whitespace_matches"]) for r in A.decide(asked, gate, done, checks).collect()}
    assert got == {
        1: ("answered", [], 0), 2: ("answered", [], 1), 3: ("rejected", ["quote_not_found:C1"], 0), 4: ("rejected", ["unknown_chunk:C9"], 0), 5: ("rejected", ["no_citations"], 0),
        6: ("not_found", [], 0), 7: ("rejected", ["invalid_json"], 0), 8: ("rejected", ["length"], 0), 9: ("not_found", [], 0),
    }


def test_cache_calls_each_miss_once(spark):
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "question_id long, prompt string")
    empty = spark.createDataFrame([], "key string, text string, input_tokens long, output_tokens long, model string, stop_reason string")
    fresh = A.cached_call(prompts, A.StubClient(), empty)
    assert fresh.count() == 3 and fresh.filter("cached").count() == 0
    cache = fresh.dropDuplicates(["key"]).drop("question_id", "cached")
    assert A.cached_call(prompts, A.StubClient(), cache).filter("cached").count() == 3
    assert A.cached_call(prompts, A.StubClient(), empty, offline=True).filter("stop_reason = 'offline_miss'").count() == 3
    for name, why in (("gpt-x", "costs money"), ("other", "no provider"), ("ollama:qwen", "no client")):
        with pytest.raises(ValueError, match=why):
            A.make_client(name)
    assert A.make_client("gpt-x", {"openai": A.StubClient}, allow_paid=True).model == "gpt-x" and A.make_client("ollama:stub").model == "ollama:stub"
    with pytest.raises(A.ContextFull):
        A.WindowedClient(A.StubClient(), 1_030).complete("word " * 100)
    assert A.WindowedClient(A.StubClient()).complete("p")[3] == "stop"


def test_cost_above_the_limit_is_refused(spark):
    plan = spark.createDataFrame([(1, 1, 2, 500_000)], "gated long, cached long, to_call long, est_tokens long")
    assert A.within_cost(plan, 2.0, 1.0).first()["est_usd"] == 1.0 and A.within_cost(plan, 0.0).first()["est_usd"] == 0.0
    with pytest.raises(Exception, match="would cost 1.00 USD; allowed are 0.50"):
        A.within_cost(plan, 2.0, 0.5).collect()


def test_context_keeps_the_reserved_chunk(spark):
    chunks = spark.createDataFrame([(i, 1, i * 10, i * 10 + 9, f"t{i}") for i in range(5)], "chunk_id long, doc_id long, start_char int, end_char int, chunk_text string")
    ranked = spark.createDataFrame([(1, 3, 1), (1, 0, 2), (1, 4, 3)], "question_id long, chunk_id long, rank int")
    first = spark.createDataFrame([(1, 0)], "question_id long, chunk_id long")
    got = C.build_context(ranked, first, chunks, 2).orderBy("label")
    assert [(r["label"], r["chunk_id"]) for r in got.collect()] == [("C1", 0), ("C2", 3)]
    asked = spark.createDataFrame([(1, "why?")], "question_id long, question string")
    assert C.build_prompts(asked, got).first()["prompt"] == '<excerpts>\n<excerpt id="C1" document="Document 1">\nt0\n</excerpt>\n<excerpt id="C2" document="Document 1">\nt3\n</excerpt>\n</excerpts>\n\nQuestion: why?'


def test_audit_names_a_matter_only_when_unique(spark):
    rows = spark.createDataFrame([(1, "answered", False, "m", 1, [], 0, 1, 1), (2, "answered", False, "m", 1, [], 0, 1, 1)], "question_id int, status string, gated boolean, model string, citation_count int, rejection_reasons array<string>, whitespace_matches int, input_tokens int, output_tokens int")
    scope = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 1, 5), (2, 3, 6)], "question_id int, doc_id int, matter_id int")
    assert {r["question_id"]: r["matter_id"] for r in A.audit(rows, scope).collect()} == {1: 5, 2: None}


VEILED = (
    "This Agreement is between Acme Widgets, Inc. and Beta LLC. Acme Widgets shall pay  the fee. "
    "Write to jane@acme.example.com or (555) 123-4567. Beta LLC may end it. Acme Widgets, Inc. may not."
)


def asked_behind(spark, replies, question="May Acme Widgets end it?", cuts=((0, 95), (85, len(VEILED)))):
    """answer_questions over one redacted document, with a client that returns replies[prompt's last word]."""

    class Client:
        model = "ollama:test"

        def complete(self, prompt):
            assert "Acme" not in prompt and "jane@" not in prompt and "123-4567" not in prompt and "PARTY_1" in prompt
            return replies[prompt.rsplit(" ", 1)[1]], 1, 1, "stop"

    docs = spark.createDataFrame([(1, VEILED)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"{question} {k}") for i, k in enumerate(replies)], "question_id long, question string")
    ctx = [(i, f"C{j + 1}", j, 1, a, b, VEILED[a:b]) for i in range(len(replies)) for j, (a, b) in enumerate(cuts)]
    context = spark.createDataFrame(ctx, "question_id long, label string, chunk_id long, doc_id long, start_char int, end_char int, chunk_text string")
    gate = asked.selectExpr("question_id", "false AS gated")
    return A.answer_questions(asked, gate, context, docs, Client()).orderBy("question_id").collect()


def test_answers_behind_redaction(spark):
    say = lambda answer, *quotes, label="C1": json.dumps({"status": "answered", "answer": answer, "citations": [{"chunk_id": label, "quote": q} for q in quotes]})
    got = asked_behind(spark, {
        "a": say("PARTY_1 pays, PARTY_2 not; see EMAIL_1, PARTY_9.", "PARTY_1 shall pay  the"), "b": say("x", "PARTY_1 shall pay the fee.", "EMAIL_1 or PHONE_1"), "c": say("x", "Acme Widgets shall pay"),
        "d": say("x", "ARTY_2 may end"), "e": json.dumps({"status": "not_found", "answer": "", "citations": []}),
    })
    cites = [[(c["start"], c["end"], c["quoted_text"]) for c in r["citations"] or []] for r in got]
    place = lambda t, n=0: (VEILED.index(t, n), VEILED.index(t, n) + len(t), t)
    assert got[0]["answer"] == "Acme Widgets, Inc. pays, Beta LLC not; see jane@acme.example.com, PARTY_9."
    assert cites[0] == [place("Acme Widgets shall pay  the")] and got[0]["whitespace_matches"] == 0
    assert cites[1] == [place("Acme Widgets shall pay  the fee."), place("jane@acme.example.com or (555) 123-4567")] and got[1]["whitespace_matches"] == 1
    assert (got[2]["status"], got[2]["rejection_reasons"]) == ("rejected", ["quote_not_found:C1"])
    assert cites[3] == [place("Beta LLC may end")]  # a quote that begins inside a placeholder holds all of it
    assert got[4]["status"] == "not_found" and got[0]["redactions"] == {"PARTY": 5, "EMAIL": 1, "PHONE": 1}


def test_redaction_takes_one_document(spark):
    docs = spark.createDataFrame([(1, "Acme Inc. one"), (2, "Beta LLC two")], "doc_id long, text string")
    context = spark.createDataFrame([(1, "C1", 1, 1, 0, 9, "x"), (1, "C2", 2, 2, 0, 8, "x")], "question_id long, label string, chunk_id long, doc_id long, start_char int, end_char int, chunk_text string")
    asked = spark.createDataFrame([(1, "q")], "question_id long, question string")
    with pytest.raises(Exception, match="one document per question"):
        A.redacted_inputs(asked, context, A.veiled(docs, context))[0].collect()
    with pytest.raises(Exception, match="unknown document 7"):
        A.known_documents(spark.createDataFrame([(1, 7)], "question_id long, doc_id long"), docs).collect()


def test_verdicts_are_read_leniently(spark):
    texts = ['{"verdict":"correct","reason":"ok"}', '{"verdict":"correct"}', "no", None, '{"reason":"r","verdict":"incorrect","more":1}']
    got = A.verdicts(spark.createDataFrame(list(enumerate(texts)), "question_id int, text string")).orderBy("question_id").collect()
    assert [(r["verdict"], r["reason"]) for r in got] == [("correct", "ok"), ("incorrect", 'unparseable judge output: {"verdict":"correct"}'), ("incorrect", "unparseable judge output: no"), ("incorrect", "unparseable judge output: "), ("incorrect", "r")]
