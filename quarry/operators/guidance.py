"""Answers and incident guides for many requests at once: evidence, graph, context, a pluggable model, statuses and notices.

Requests are (request_id, query), ids being unique and not null; results are the chunks that a search has
found for them: (request_id, position from 1 on, chunk_id, title, source_filename, version_label, page_start,
page_end, content, kind, metadata), a bounded number for each request. A model is a function from
(request_id, query, context) to (request_id, answer); where its answer is null or missing it was
not available, and the evidence stands without one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources.store import written
from . import answering, budget
from . import logs as L

Model = Callable[[DataFrame], DataFrame]

#: What a reader sees of relations, evidence, and requests without an answer.
LABELS = {
    "calls": "호출", "sends_to": "전송", "reads_from": "조회", "writes_to": "저장", "depends_on": "의존", "contains": "포함", "deployed_on": "배포", "connects_to": "연결",
    "authenticates_with": "인증", "routes_to": "라우팅", "precedes": "선행", "related_to": "관련",
}
RELATIONS_HEAD = "[PostgreSQL 지식 그래프 관계]"
NO_TITLE, NO_FILE, NO_PAGE = "제목 없음", "파일명 없음", "페이지 정보 없음"
SEPARATOR = "\n\n---\n\n"
OUT_OF_SCOPE = "등록된 문서에서 질문과 관련된 내용을 찾지 못했습니다. 본 서비스는 등록 문서와 관련된 질문에만 답변할 수 있습니다."
UNAVAILABLE = "관련 문서는 찾았지만 현재 LLM 답변 서버를 사용할 수 없습니다. 아래 검색 결과에서 원문 내용을 확인해 주세요."
DECOMPILED = (
    "참고: 답변 근거에 JAR 디컴파일 소스가 포함되어 있어 스택트레이스의 원본 소스 라인 번호와 표시된 라인 범위가 다를 수 있습니다. 패키지·클래스·메서드를 기준으로 확인해 주세요."
)
GUIDE_OUT_OF_SCOPE = "등록된 장애 지식에서 질문과 관련된 내용을 찾지 못했습니다. 분석할 로그를 함께 입력하거나 질문을 더 구체적으로 작성해 주세요."
GUIDE_UNAVAILABLE = (
    "로그 핵심 정보 추출과 관련 지식 조회는 완료했지만 현재 LLM 답변 서버를 사용할 수 없어 해결 가이드를 생성하지 못했습니다. 잠시 후 다시 시도해 주세요."
)
LOG_TITLE, LOG_FILE, LOG_VERSION = "사용자 입력 장애 로그", "입력 로그", "현재 요청"
MISSING_HEADINGS = "다음 템플릿 제목이 누락되었거나 순서가 달랐습니다: "


def subgraphs(results: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, mentions: DataFrame, most_entities: int = 30, most_relations: int = 50) -> tuple[DataFrame, DataFrame]:
    """(request_id, entity_id, entity_type, canonical_name, is_seed) and (request_id, source_id, target_id, relation_type, confidence) around the versions of each request's results.

    What versions mention and prove is brought together once, by version, before requests meet it.
    Seeds, known relations and entities are written and read again, as each is met several times.
    """
    of = chunks.select("chunk_id", "version_id")
    hit = results.select("request_id", "chunk_id").join(of, "chunk_id").select("request_id", "version_id").distinct()
    needed = hit.select("version_id").distinct()
    said = mentions.join(of, "chunk_id").join(needed, "version_id", "left_semi").select("version_id", "entity_id").distinct()
    proved = relations.join(of, "chunk_id").join(needed, "version_id", "left_semi").groupBy("version_id", "source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence"))
    seed = written(hit.join(said, "version_id").select("request_id", "entity_id").distinct(), "seeds")
    known = written(hit.join(proved, "version_id").groupBy("request_id", "source_id", "target_id", "relation_type").agg(F.max("confidence").alias("confidence")), "relations")
    step = lambda here, there: known.select("request_id", F.col(here).alias("entity_id"), F.col(there).alias("to")).join(seed, ["request_id", "entity_id"], "left_semi").select("request_id", F.col("to").alias("entity_id"))
    found = seed.withColumn("is_seed", F.lit(True))
    for reached in (step("source_id", "target_id"), step("target_id", "source_id")):
        found = found.unionByName(reached.withColumn("is_seed", F.lit(False)))
    found = found.groupBy("request_id", "entity_id").agg(F.bool_or("is_seed").alias("is_seed")).join(entities, "entity_id")
    first = Window.partitionBy("request_id").orderBy(F.col("is_seed").desc(), "canonical_name", "entity_id")
    top = written(found.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most_entities).select("request_id", "entity_id", "entity_type", "canonical_name", "is_seed"), "entities")
    for end in ("source_id", "target_id"):
        known = known.join(top.select("request_id", F.col("entity_id").alias(end)), ["request_id", end], "left_semi")
    surest = Window.partitionBy("request_id").orderBy(F.col("confidence").desc(), "source_id", "target_id", "relation_type")
    edges = known.withColumn("n", F.row_number().over(surest)).filter(F.col("n") <= most_relations)
    return top, edges.select("request_id", "source_id", "target_id", "relation_type", "confidence", "n")


def relation_contexts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(request_id, relation_context, diagram): relations as sentences, the surest first, and the kind of diagram that they make (null: none)."""
    end = lambda p: entities.select("request_id", F.col("entity_id").alias(f"{p}_id"), F.col("canonical_name").alias(p))
    named = relations.join(end("source"), ["request_id", "source_id"]).join(end("target"), ["request_id", "target_id"])
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    said = F.concat(F.lit("- "), "source", F.lit(" → "), "target", F.lit(" ("), F.coalesce(F.try_element_at(labels, F.col("relation_type")), F.col("relation_type")), F.lit(")"))
    # at most as many as subgraphs() keeps
    kept = named.filter((F.col("source") != "") & (F.col("target") != ""))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", said.alias("s")))), lambda x: x["s"]), "\n")
    drawn = F.when(F.count_if(F.col("source_id") != F.col("target_id")) == 0, None).when(F.bool_and(F.col("relation_type") == "precedes"), "flow").otherwise("architecture")
    return kept.groupBy("request_id").agg(F.concat(F.lit(RELATIONS_HEAD + "\n"), lines).alias("relation_context"), drawn.alias("diagram"))


def block() -> Column:
    """One result as it stands in a prompt, under its number; the columns of a result and ``neighbor_context`` (null: none)."""
    page = F.when(F.col("page_start").isNull() | (F.col("page_start") == 0), NO_PAGE).when(F.col("page_end") != F.col("page_start"), F.concat("page_start", F.lit("-"), "page_end", F.lit("쪽"))).otherwise(F.concat("page_start", F.lit("쪽")))
    or_else = lambda c, v: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(v))
    head = F.concat(
        F.lit("["), F.col("position").cast("string"), F.lit("] 제목: "), or_else("title", NO_TITLE), F.lit("\n파일: "), or_else("source_filename", NO_FILE),
        F.lit(" / 버전: "), or_else("version_label", "-"), F.lit(" / "), page, F.lit("\n본문:\n"),
    )
    return F.concat(head, text.strip(F.concat_ws("\n", F.coalesce("content", F.lit("")), "neighbor_context")))


def within(body: Column, most: int) -> Column:
    """A result's text, stripped, as far as a context of ``most`` characters can show it. A longer one gets an end that never shows: it still fills the context, and is not stripped again."""
    body = text.strip(F.coalesce(body, F.lit("")))
    return F.when(F.length(body) > most, F.concat(F.substring(body, 1, most), F.lit("."))).otherwise(body)


def contexts(results: DataFrame, most: int, order: str = "position") -> DataFrame:
    """(request_id, context): results in order within ``most`` characters, separators not counted; only what fits is sorted and gathered."""
    shown = results.select("request_id", "position", *({order} - {"position"}), F.substring(block(), 1, most).alias("block"))
    cut = budget.prefix(shown, ["request_id"], [F.col(order)], "block", most)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda x: x["block"]), SEPARATOR)
    return cut.groupBy("request_id").agg(joined.alias("context"))


def decompiled() -> Column:
    """Whether a result is decompiled code, by its metadata or its kind."""
    held = F.try_parse_json("metadata")
    # a string that reads "true" is no mark
    flag = F.schema_of_variant(F.try_variant_get(held, "$.decompiled", "variant")) == "BOOLEAN"
    return F.coalesce(flag & F.try_variant_get(held, "$.decompiled", "boolean"), F.lit(False)) | F.coalesce(F.col("kind").startswith("decompiled_code"), F.lit(False))


def by_service(complete: Callable[[str, str], str | None]) -> Model:
    """A model from a function (query, context) to an answer, which runs in tasks; None where the service has none."""

    def ask(prompts: DataFrame) -> DataFrame:
        def batches(frames):
            for f in frames:
                answers = [complete(q, c) for q, c in zip(f["query"], f["context"])]
                yield f[["request_id"]].assign(answer=answers)

        schema = f"request_id {prompts.schema['request_id'].dataType.simpleString()}, answer string"
        return prompts.select("request_id", "query", "context").mapInPandas(batches, schema)

    return ask


def _with_notice(answer: Column, used: Column) -> Column:
    return F.when(used, F.concat(answer, F.lit("\n\n" + DECOMPILED))).otherwise(answer)


def answered(requests: DataFrame, results: DataFrame, graph: tuple[DataFrame, DataFrame] | None, model: Model, most: int = 5992) -> DataFrame:
    """(request_id, answer, generation_status, evidence_status, notices, n_results, diagram), one row for each request.

    Without results a request is out of scope and the model is not asked. Relations stand once,
    with the first result. An answer that says that evidence is lacking makes it insufficient, and
    then no diagram is drawn. Rows of ``results`` that repeat a position are evidence like others.
    """
    seen = results.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_results"), F.bool_or(decompiled()).alias("decompiled"))
    if graph is None:
        placed, drawn = results.withColumn("neighbor_context", F.lit(None).cast("string")), seen.select("request_id", F.lit(None).cast("string").alias("diagram"))
    else:
        related = written(relation_contexts(*graph), "contexts")
        placed = results.join(related.select("request_id", "relation_context"), "request_id", "left").withColumn("neighbor_context", F.when(F.col("position") == 1, F.col("relation_context")))
        drawn = related.select("request_id", "diagram")
    prompts = requests.select("request_id", "query").join(contexts(placed, most), "request_id")
    rows = requests.select("request_id").join(seen, "request_id", "left").join(model(prompts), "request_id", "left").join(drawn, "request_id", "left")
    status = F.when(F.col("n_results").isNull(), "out_of_scope").when(F.col("answer").isNull(), "unavailable").otherwise("completed")
    enough = (F.col("generation_status") == "completed") & ~text.is_insufficient(F.col("answer"))
    used = F.coalesce("decompiled", F.lit(False))
    said = F.when(F.col("generation_status") == "out_of_scope", OUT_OF_SCOPE).otherwise(_with_notice(F.coalesce("answer", F.lit(UNAVAILABLE)), used))
    return rows.withColumn("generation_status", status).select(
        "request_id", said.alias("answer"), "generation_status", F.when(enough, "sufficient").otherwise("insufficient").alias("evidence_status"),
        F.when(used, F.array(F.lit(DECOMPILED))).otherwise(F.array().cast("array<string>")).alias("notices"), F.coalesce("n_results", F.lit(0)).alias("n_results"), F.when(enough, F.col("diagram")).alias("diagram"),
    )


def log_analysis(lines: DataFrame) -> DataFrame:
    """(log_id, total_lines, error_line_count, first_at, last_at, first_exception, last_cause, error_codes, exception_classes, levels) of each log; the lists have 30 items at most."""
    found = lambda pattern, c: L.first_seen(lines, pattern, 30).withColumnRenamed("found", c)
    said = lines.select("log_id", F.explode(F.regexp_extract_all("line", F.lit(text.LEVEL), F.lit(0))).alias("x")).withColumn("x", F.upper("x"))
    counted = said.groupBy("log_id", F.when(F.col("x") == "WARNING", "WARN").otherwise(F.col("x")).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    levels = counted.groupBy("log_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("x", "n")))).alias("levels"))
    rows = L.overview(lines).join(lines.groupBy("log_id").agg(F.count(F.lit(1)).alias("total_lines")), "log_id")
    for more in (found(text.TRACE_CODE, "error_codes"), found(text.TRACE_EXCEPTION, "exception_classes"), levels):
        rows = rows.join(more, "log_id", "left")
    empty = F.array().cast("array<string>")
    return rows.withColumns({
        "error_codes": F.coalesce("error_codes", empty), "exception_classes": F.coalesce("exception_classes", empty), "levels": F.coalesce("levels", F.create_map().cast("map<string,bigint>")),
    })


def guided(requests: DataFrame, lines: DataFrame, results: DataFrame, model: Model, template: str, log_budget: int = 16_000, most: int = 5992) -> DataFrame:
    """(request_id, answer, generation_status, notices, n_results, and the columns of ``log_analysis``), one row for each request.

    ``lines`` are the log lines of requests (log_id being the request's id). A log stands before
    the results as evidence, and does not count among these. An answer whose headings are not the
    template's is asked for once more, with what it lacks; if they still are not, it is brought
    under them. Requests with neither a log nor results are out of scope.
    """
    told = log_analysis(lines).withColumnRenamed("log_id", "request_id")
    cut = L.excerpt(lines, log_budget).groupBy(F.col("log_id").alias("request_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("content")
    )
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    shown = ["request_id", "position", "title", "source_filename", "version_label", "page_start", "page_end", "content"]
    log = cut.filter("content <> ''").select(
        "request_id", F.lit(0).cast("long").alias("position"), F.lit(LOG_TITLE).alias("title"), F.lit(LOG_FILE).alias("source_filename"), F.lit(LOG_VERSION).alias("version_label"),
        none("page_start", "int"), none("page_end", "int"), "content",
    )
    # numbers and budgets go by one order, so texts are sorted once
    every = log.unionByName(results.select(*shown)).withColumnRenamed("position", "_at").withColumn("content", within(F.col("content"), most))
    numbered = every.withColumn("position", F.row_number().over(Window.partitionBy("request_id").orderBy("_at")).cast("long")).withColumn("neighbor_context", F.lit(None).cast("string"))
    seen = results.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_results"), F.bool_or(decompiled()).alias("decompiled"))
    rows = requests.select("request_id", "query").join(told, "request_id", "left").join(seen, "request_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    facts = F.to_json(F.struct("error_codes", "exception_classes", "first_at", "last_at", F.col("last_cause").alias("root_cause"), "levels"))
    asked = F.substring(F.concat(F.coalesce("query", F.lit("")), F.lit("\n"), facts, F.lit("\n"), F.col("n_results").cast("string")), 1, 4000)
    prompts = written(rows.select("request_id", asked.alias("query")).join(contexts(numbered, most, "_at"), "request_id"), "prompts")  # contexts are made once
    first = prompts.join(written(model(prompts).select("request_id", "answer"), "guides"), "request_id", "left")  # no model is asked twice for a row
    lacking = answering.missing_headings(F.col("answer"), template)
    poor = first.filter(F.col("answer").isNotNull() & (F.size(lacking) > 0))
    again = model(poor.select("request_id", F.concat("query", F.lit("\n\n" + MISSING_HEADINGS), F.array_join(lacking, ", ")).alias("query"), "context")).withColumnRenamed("answer", "second")
    # what the second attempt does not give, the first has
    given = first.select("request_id", "answer").join(again, "request_id", "left").select("request_id", F.coalesce("second", "answer").alias("answer"))
    done = rows.join(given, "request_id", "left")
    used = F.coalesce("decompiled", F.lit(False))
    status = F.when(F.col("total_lines").isNull() & (F.col("n_results") == 0), "out_of_scope").when(F.col("answer").isNull(), "unavailable").otherwise("completed")
    said = F.when(F.col("generation_status") == "out_of_scope", GUIDE_OUT_OF_SCOPE).otherwise(_with_notice(F.coalesce(answering.in_template(F.col("answer"), template), F.lit(GUIDE_UNAVAILABLE)), used))
    return done.withColumn("generation_status", status).select(
        "request_id", said.alias("answer"), "generation_status", F.when(used, F.array(F.lit(DECOMPILED))).otherwise(F.array().cast("array<string>")).alias("notices"), "n_results",
        *[c for c in told.columns if c != "request_id"],
    )
