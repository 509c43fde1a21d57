"""The answer pipeline: gate, cache plan, model call, strict parsing, citation checks, audit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from .context import build_prompts
from .redaction import redact, redact_question, redacted_text, segment_map, segments, to_original, unredact
from .spans import merge_regions, resolve_quotes, verify_citations

#: The gate's default signal and threshold (fixed values): a question is blocked strictly below it.
SIGNAL, THRESHOLD = "top_ts_rank", 0.02507458
#: Stop reasons of a generation that ended by itself (fixed values).
NORMAL_STOPS = ("end_turn", "stop", "")
ANSWER = "status string, answer string, citations array<struct<chunk_id:string,quote:string>>"
VERDICT = "verdict string, reason string"
COMPLETION = "question_id long, text string, input_tokens long, output_tokens long, model string, stop_reason string"


def blocked(signal: str = SIGNAL, threshold: float = THRESHOLD) -> Column:
    return F.col(signal) < F.lit(threshold)


def cache_key(**fields: Column | str) -> Column:
    """SHA-256 of the request as JSON with its fields in alphabetical order."""
    named = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in sorted(fields.items())]
    return F.sha2(F.to_json(F.struct(*named)), 256)


def cache_plan(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """(gated, cached, to_call, est_tokens) of requests (question_id, key, gated, prompt): what a run would cost."""
    rows = requests.join(cache.select("key").distinct().withColumn("_hit", F.lit(True)), "key", "left")
    hit, gated = F.col("_hit").isNotNull(), F.col("gated")
    call = ~gated & ~hit
    return rows.agg(
        F.sum(gated.cast("long")).alias("gated"), F.sum((~gated & hit).cast("long")).alias("cached"), F.sum(call.cast("long")).alias("to_call"),
        F.coalesce(F.sum(F.when(call, token_estimate("prompt"))), F.lit(0)).alias("est_tokens"))


@dataclass(frozen=True)
class StubClient:
    """An offline model: cites the opening words of the first excerpt. Any picklable object with
    complete(prompt) -> (text, input tokens, output tokens, stop reason) can stand in its place."""

    model: str = "ollama:stub"
    words: int = 12

    def complete(self, prompt: str) -> tuple[str, int, int, str]:
        import json
        import re

        m = re.search(r'<excerpt id="(C\d+)"[^>]*>\n(.*?)\n</excerpt>', prompt, re.S)
        if not m:
            body = {"status": "not_found", "answer": "", "citations": []}
        else:
            quote = re.match(rf"\s*((?:\S+\s+){{0,{self.words - 1}}}\S+)", m[2])
            body = {"status": "answered", "answer": "See the cited clause.", "citations": [{"chunk_id": m[1], "quote": quote[1] if quote else ""}]}
        text = json.dumps(body)
        return text, -(-len(prompt) * 2 // 7), -(-len(text) * 2 // 7), "stop"


class ContextFull(ValueError):
    """A prompt and its answer do not fit the model's window: it would be cut without a word."""


@dataclass(frozen=True)
class WindowedClient:
    """A client that refuses prompts which leave no room for the answer in the model's window."""

    inner: StubClient
    window: int = 16_384
    answer: int = 1_024

    @property
    def model(self) -> str:
        return self.inner.model

    def complete(self, prompt: str) -> tuple[str, int, int, str]:
        text, used, made, stop = self.inner.complete(prompt)
        if used + self.answer > self.window:
            raise ContextFull(f"{used} prompt tokens and {self.answer} for the answer exceed the window of {self.window}")
        return text, used, made, stop


#: Providers by the beginning of a model's name: (who serves it, whether each call costs money).
PROVIDERS = {"ollama:": ("local", False), "claude-": ("anthropic", True), "gpt-": ("openai", True), "o1": ("openai", True), "o3": ("openai", True), "o4": ("openai", True)}


def provider(name: str) -> tuple[str, bool]:
    for start, told in PROVIDERS.items():
        if name.startswith(start):
            return told
    raise ValueError(f"no provider serves model {name!r}")


def make_client(name: str, clients: dict[str, Callable[[str], StubClient]] | None = None, allow_paid: bool = False) -> StubClient:
    """A client by model name. clients: makers by provider; only the offline stub (ollama:stub) is bundled.

    A provider that charges is refused unless the caller allows paid calls.
    """
    who, paid = provider(name)
    if paid and not allow_paid:
        raise ValueError(f"model {name!r} costs money per call; allow paid calls to use it")
    if clients and who in clients:
        return clients[who](name)
    if name.startswith("ollama:stub"):
        return StubClient(name)
    raise ValueError(f"no client for provider {who!r} of model {name!r}")


def within_cost(plan: DataFrame, usd_per_million: float, most_usd: float = 0.0) -> DataFrame:
    """plan as from cache_plan() + est_usd; fails where the calls still to make would cost more than allowed."""
    usd = F.col("est_tokens") / 1e6 * usd_per_million
    over = F.concat_ws(" ", F.lit("the run would cost"), F.format_string("%.2f", usd), F.lit(f"USD; allowed are {most_usd:.2f}"))
    return plan.withColumn("est_usd", F.when(usd <= most_usd, usd).otherwise(F.raise_error(over).cast("double")))


def call_model(prompts: DataFrame, client: StubClient) -> DataFrame:
    """(question_id, prompt) -> COMPLETION, equal prompts answered alike, by Arrow batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            done = [client.complete(p) for p in f["prompt"]]
            yield pd.DataFrame({"question_id": f["question_id"], "text": [d[0] for d in done], "input_tokens": [d[1] for d in done], "output_tokens": [d[2] for d in done], "model": client.model, "stop_reason": [d[3] for d in done]})

    return prompts.select("question_id", "prompt").mapInPandas(run, COMPLETION)


def cached_call(prompts: DataFrame, client: StubClient, cache: DataFrame, offline: bool = False) -> DataFrame:
    """COMPLETION + key, cached: cache hits joined, distinct misses called once. offline: a miss is an error row."""
    keyed = prompts.withColumn("key", cache_key(model=F.lit(client.model), user="prompt"))
    hits = keyed.join(cache, "key").withColumn("cached", F.lit(True))
    miss = keyed.join(cache.select("key"), "key", "left_anti")
    if offline:
        fresh = miss.select("question_id", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("input_tokens"), F.lit(0).cast("long").alias("output_tokens"), F.lit(client.model).alias("model"), F.lit("offline_miss").alias("stop_reason"), "key")
    else:
        once = miss.groupBy("key").agg(F.min("question_id").alias("question_id"), F.first("prompt").alias("prompt"))
        fresh = call_model(once, client).join(once.select("question_id", "key"), "question_id").drop("question_id").join(miss.select("question_id", "key"), "key")
    cols = ["question_id", "text", "input_tokens", "output_tokens", "model", "stop_reason", "key"]
    return hits.select(*cols, "cached").unionByName(fresh.select(*cols).withColumn("cached", F.lit(False)))


def parsed(completions: DataFrame) -> DataFrame:
    """completions + parsed (ANSWER), error: null, 'invalid_json', or the abnormal stop reason."""
    p = F.from_json("text", ANSWER)
    bad = p.isNull() | p["status"].isNull() | ~p["status"].isin("answered", "not_found") | p["answer"].isNull() | p["citations"].isNull() | F.coalesce(F.exists(p["citations"], lambda c: c.isNull() | c["chunk_id"].isNull() | c["quote"].isNull()), F.lit(False))
    stop = F.coalesce("stop_reason", F.lit(""))
    error = F.when(bad, F.when(stop.isin(*NORMAL_STOPS), "invalid_json").otherwise(stop))
    return completions.withColumn("parsed", p).withColumn("error", error)


def verdicts(completions: DataFrame) -> DataFrame:
    """(question_id, verdict, reason) of a judge's outputs (question_id, text), read leniently: what is no
    object with a verdict and a reason counts as 'incorrect' and is quoted."""
    said = F.from_json("text", VERDICT)
    whole = said["verdict"].isNotNull() & said["reason"].isNotNull()
    reason = F.concat(F.lit("unparseable judge output: "), F.substring(F.coalesce("text", F.lit("")), 1, 80))
    return completions.select("question_id", F.when(whole, said["verdict"]).otherwise("incorrect").alias("verdict"), F.when(whole, said["reason"]).otherwise(reason).alias("reason"))


def regions_of(context: DataFrame) -> DataFrame:
    """(question_id, doc_id, regions): what was shown of each document, merged, in order."""
    shown = context.select("question_id", "doc_id", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    return merge_regions(shown, "question_id", "doc_id").groupBy("question_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("regions"))


def veiled(docs: DataFrame, context: DataFrame) -> DataFrame:
    """(doc_id, text, entities) of the documents that a context shows."""
    return redact(docs.select("doc_id", "text").join(context.select("doc_id").distinct(), "doc_id", "left_semi"))


def redacted_inputs(questions: DataFrame, context: DataFrame, hidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions, context) with names and contact data replaced; hidden as from veiled().

    Placeholders count per document, so a question may show one document only; more fail the job.
    """
    rows = context.join(hidden.select("doc_id", F.col("text").alias("_text"), "entities"), "doc_id")
    shown = redacted_text("_text", segments("_text", "entities", F.col("start_char"), F.col("end_char")))
    excerpts = rows.withColumn("chunk_text", shown).select(*[c for c in context.columns])
    one = context.groupBy("question_id").agg(F.countDistinct("doc_id").alias("n"), F.min("doc_id").alias("doc_id"))
    one = one.withColumn("doc_id", F.when(F.col("n") == 1, F.col("doc_id")).otherwise(F.raise_error(F.lit("redaction takes one document per question")).cast(context.schema["doc_id"].dataType)))
    surfaces = F.array_distinct(F.transform("entities", lambda e: F.struct(F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]).alias("surface"), e["placeholder"].alias("placeholder"))))
    spelled = one.select("question_id", "doc_id").join(hidden.select("doc_id", surfaces.alias("_s")), "doc_id").select("question_id", "_s")
    none = F.array().cast("array<struct<surface:string,placeholder:string>>")
    asked = questions.join(spelled, "question_id", "left").withColumn("question", redact_question("question", F.coalesce("_s", none)))
    return asked.select(*questions.columns), excerpts


def shown_regions(context: DataFrame, hidden: DataFrame) -> DataFrame:
    """(question_id, doc_id, regions, shown, places, maps): the redacted regions in order as one text, where
    each lies in it, and how its pieces map to the document."""
    each = regions_of(context).join(hidden, "doc_id").select("question_id", "doc_id", "regions", "text", "entities", F.posexplode("regions").alias("i", "r"))
    pieces = segments("text", "entities", F.col("r.start"), F.col("r.end"))
    cut = each.select("question_id", "doc_id", "regions", "i", F.explode(F.array(F.struct(redacted_text("text", pieces).alias("t"), segment_map(pieces).alias("m")))).alias("x"))
    joined = cut.groupBy("question_id", "doc_id", "regions").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("x"))
    before = lambda i: F.aggregate(F.slice("x", 1, i), F.lit(0), lambda a, y: a + F.length(y["x"]["t"]))
    places = F.transform("x", lambda y, i: F.struct(before(i).alias("start"), (before(i) + F.length(y["x"]["t"])).alias("end")))
    return joined.select("question_id", "doc_id", "regions", F.array_join(F.transform("x", lambda y: y["x"]["t"]), "").alias("shown"), places.alias("places"), F.transform("x", lambda y: y["x"]["m"]).alias("maps"))


def found_behind(quotes: DataFrame, hidden: DataFrame, context: DataFrame) -> DataFrame:
    """quotes (question_id, doc_id, quote ...) + start, end, mode: sought in what the model saw, region by
    region, and mapped back to the document; a quote that touches a placeholder holds all that it hides."""
    seen = quotes.join(shown_regions(context, hidden).drop("regions"), ["question_id", "doc_id"], "left")
    asked = seen.withColumnRenamed("shown", "text").withColumnRenamed("places", "regions")
    hit = resolve_quotes(asked, per_region=True)
    at = F.expr("array_position(transform(regions, r -> r.start <= start AND start < r.end), true)").cast("int")
    place = hit.withColumn("_at", at)
    low = F.col("start") - F.get("regions", F.col("_at") - 1)["start"]
    span = to_original(F.get("maps", F.col("_at") - 1), low, low + F.col("end") - F.col("start"))
    back = place.withColumn("_o", F.when(F.col("start").isNotNull(), span))
    return back.select(*quotes.columns, F.col("_o.start").alias("start"), F.col("_o.end").alias("end"), "mode")


def check_citations(answers: DataFrame, context: DataFrame, docs: DataFrame, hidden: DataFrame | None = None) -> DataFrame:
    """answers (question_id, citations array<struct<chunk_id,quote>>) -> (question_id, citations, reasons, whitespace_matches).

    context: (question_id, label, doc_id, start_char, end_char); the label picks the document, the
    quote may lie in any of its shown regions. hidden (veiled documents): the model saw them redacted.
    """
    shown = context.select("question_id", "doc_id", F.col("start_char").alias("start"), F.col("end_char").alias("end"))
    each = answers.select("question_id", F.posexplode("citations").alias("i", "c")).select("question_id", "i", F.col("c.chunk_id").alias("label"), F.col("c.quote").alias("quote"))
    placed = each.join(context.select("question_id", "label", "doc_id"), ["question_id", "label"], "left")
    whole = docs.select("doc_id", "text")
    if hidden is None:
        found = resolve_quotes(placed.join(regions_of(context), ["question_id", "doc_id"], "left").join(whole, "doc_id", "left"))
    else:
        found = found_behind(placed, hidden, context).join(whole, "doc_id", "left")
    quoted = F.expr("substring(text, start + 1, end - start)")
    cites = found.withColumn("quoted_text", quoted)
    checked = verify_citations(cites.select("question_id", "i", "label", "doc_id", "start", "end", "quoted_text", "mode"), docs, shown)
    reason = (
        F.when(F.col("doc_id").isNull(), F.concat(F.lit("unknown_chunk:"), "label"))
        .when(F.col("start").isNull(), F.concat(F.lit("quote_not_found:"), "label"))
        .when(F.col("reason").isNotNull(), F.concat(F.lit("verifier:"), "reason"))
    )
    rows = checked.withColumn("why", reason)
    good = F.when(F.col("why").isNull(), F.struct("i", "doc_id", "start", "end", "quoted_text"))
    out = rows.groupBy("question_id").agg(
        F.array_sort(F.collect_list(good)).alias("_c"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("why").isNotNull(), F.struct("i", "why")))), lambda s: s["why"]).alias("reasons"),
        F.sum((F.coalesce(F.col("mode"), F.lit("")) == "whitespace").cast("long")).alias("whitespace_matches"))
    unique = F.array_distinct(F.transform("_c", lambda s: F.struct(s["doc_id"].alias("doc_id"), s["start"].alias("start"), s["end"].alias("end"), s["quoted_text"].alias("quoted_text"))))
    return out.select("question_id", unique.alias("citations"), "reasons", "whitespace_matches")


def restored(results: DataFrame, context: DataFrame, hidden: DataFrame) -> DataFrame:
    """results with the names put back in `answer`: each placeholder as its document first spells it."""
    spelling = lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"])
    first = F.aggregate(
        "entities", F.array().cast("array<struct<key:string,value:string>>"),
        lambda a, e: F.when(F.exists(a, lambda x: x["key"] == e["placeholder"]), a).otherwise(F.array_append(a, F.struct(e["placeholder"].alias("key"), spelling(e).alias("value")))))
    names = context.select("question_id", "doc_id").distinct().join(hidden.select("doc_id", F.map_from_entries(first).alias("_m")), "doc_id").select("question_id", "_m")
    none = F.create_map().cast("map<string,string>")
    return results.join(names, "question_id", "left").withColumn("answer", unredact("answer", F.coalesce("_m", none))).select(*results.columns)


def redactions(context: DataFrame, hidden: DataFrame) -> DataFrame:
    """(question_id, redactions): how many entities of each kind the shown spans touch, each counted once."""
    spans = context.groupBy("question_id", "doc_id").agg(F.collect_list(F.struct("start_char", "end_char")).alias("_s"))
    touched = F.filter("entities", lambda e: F.exists("_s", lambda s: (e["start"] < s["end_char"]) & (s["start_char"] < e["end"])))
    each = spans.join(hidden, "doc_id").select("question_id", F.explode(touched).alias("e")).groupBy("question_id", F.col("e.kind").alias("kind")).agg(F.count("*").alias("n"))
    return each.groupBy("question_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("redactions"))


def known_documents(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """asked (question_id, doc_id), failing where a document does not exist."""
    rows = asked.join(docs.select("doc_id", F.lit(True).alias("_known")), "doc_id", "left")
    ok = F.when(F.col("_known"), F.col("doc_id")).otherwise(F.raise_error(F.concat_ws(" ", F.lit("unknown document"), F.col("doc_id").cast("string"))).cast(asked.schema["doc_id"].dataType))
    return rows.select(*[ok.alias(c) if c == "doc_id" else c for c in asked.columns])


def answer_questions(questions: DataFrame, gate: DataFrame, context: DataFrame, docs: DataFrame, client: StubClient, redaction: bool = True) -> DataFrame:
    """The whole flow for questions (question_id, question) with their contexts: what passes the gate is
    redacted, asked, parsed, checked against the documents, decided, and given its names back."""
    open_ = context.join(gate.filter("NOT gated").select("question_id"), "question_id", "left_semi")
    asked = questions.join(gate.filter("NOT gated").select("question_id"), "question_id", "left_semi")
    hidden = veiled(docs, open_) if redaction else None
    shown = redacted_inputs(asked, open_, hidden) if redaction else (asked, open_)
    done = parsed(call_model(build_prompts(*shown), client))
    checks = check_citations(done.filter("error IS NULL").select("question_id", "parsed.citations"), open_, docs, hidden)
    results = decide(questions, gate, done, checks)
    return restored(results, open_, hidden).join(redactions(open_, hidden), "question_id", "left") if redaction else results


def decide(questions: DataFrame, gate: DataFrame, completions: DataFrame, checks: DataFrame) -> DataFrame:
    """One result per question, in the fixed order of decisions: gate, parse, abstention, citations, answer.

    gate: (question_id, gated); completions as from parsed(); checks as from check_citations().
    """
    rows = questions.select("question_id").join(gate, "question_id", "left").join(completions, "question_id", "left").join(checks, "question_id", "left")
    said = F.col("parsed.status")
    none = F.coalesce(F.size("parsed.citations"), F.lit(0)) == 0
    bad = F.size(F.coalesce("reasons", F.array().cast("array<string>"))) > 0
    gated = F.coalesce("gated", F.lit(False))
    status = F.when(gated, "not_found").when(F.col("error").isNotNull() | F.col("parsed").isNull(), "rejected").when(said == "not_found", "not_found").when(none | bad, "rejected").otherwise("answered")
    why = F.when(gated, F.array()).when(F.col("error").isNotNull(), F.array("error")).when((said == "answered") & none, F.array(F.lit("no_citations"))).when(said == "answered", F.coalesce("reasons", F.array())).otherwise(F.array())
    shown = status == "answered"
    return rows.select(
        "question_id", status.alias("status"), F.when(~gated, said).alias("model_status"), gated.alias("gated"),
        F.when(shown, F.col("parsed.answer")).alias("answer"), F.when(shown, F.col("citations")).alias("citations"), F.when(shown, F.size("citations")).otherwise(0).alias("citation_count"),
        why.cast("array<string>").alias("rejection_reasons"), F.coalesce("whitespace_matches", F.lit(0)).cast("long").alias("whitespace_matches"),
        F.coalesce("input_tokens", F.lit(0)).cast("long").alias("input_tokens"), F.coalesce("output_tokens", F.lit(0)).cast("long").alias("output_tokens"), "model")


def audit(results: DataFrame, scope: DataFrame) -> DataFrame:
    """(question_id, action, matter_id, detail): an append-only row per question; scope: (question_id, doc_id, matter_id).

    The matter is named only when all documents asked share it.
    """
    asked = scope.groupBy("question_id").agg(F.array_sort(F.collect_set("doc_id")).alias("document_ids"), F.when(F.countDistinct("matter_id") == 1, F.min("matter_id")).alias("matter_id"))
    rows = results.join(asked, "question_id", "left")
    detail = F.to_json(F.struct("document_ids", "status", "gated", "model", "citation_count", "rejection_reasons", "whitespace_matches", "input_tokens", "output_tokens"))
    return rows.select("question_id", F.lit("ask").alias("action"), "matter_id", detail.alias("detail"))
