"""Context for a generator: which retrieved documents fit, and how they are laid out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import squeezed, words

# Budget in words, documents of a context, words that make a cut document worth it.
BUDGET, MOST, WORTH = 4000, 5, 100
NOTHING = "관련 문서를 찾을 수 없습니다."


def selected(results: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """The documents (query_id, similarity, prior_rank, content) of each query's context, with ``rank``.

    The best ``most`` by similarity, as long as their words fit the budget. The first that
    does not fit is cut to what is left, if that is more than 100 words, and ends the context.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "prior_rank")
    top = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    counted = top.withColumn("_words", F.size(words(F.col("content"))))
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counted.withColumn("_total", F.sum("_words").over(running)).withColumn("_over", F.sum(F.when(F.col("_total") > budget, 1).otherwise(0)).over(running))
    left = (budget - (F.col("_total") - F.col("_words"))).cast("int")
    kept = summed.where((F.col("_over") == 0) | ((F.col("_over") == 1) & (left > WORTH)))
    cut = F.concat(F.array_join(F.slice(words(F.col("content")), F.lit(1), F.greatest(left, F.lit(0))), " "), F.lit("..."))
    content = F.when(F.col("_over") == 0, F.col("content")).otherwise(cut)
    return kept.withColumn("content", content).withColumn("n_words", F.when(F.col("_over") == 0, F.col("_words")).otherwise(left)).drop("_words", "_total", "_over")


def _percent(similarity: Column) -> Column:
    return F.concat(F.format_string("%.1f", similarity * 100), F.lit("%"))


def _source() -> Column:
    return F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("출처 미상"))


def _no() -> Column:
    return F.col("rank").cast("string")


def laid_out(docs: DataFrame, queries: DataFrame, part: Column, head: Column, tail: str = "", nothing: Column | None = None, between: str = "") -> DataFrame:
    """query_id and context: head, the parts in order of rank, tail; ``nothing`` for a query without documents.

    ``queries`` has query_id and query; ``part`` is over docs, ``head`` and ``nothing`` over queries.
    """
    parts = docs.select("query_id", "rank", part.alias("part")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("_parts"))
    body = F.array_join(F.transform("_parts", lambda p: p["part"]), between)
    full = F.concat(head, body, F.lit(tail))
    none = head if nothing is None else nothing
    return queries.join(parts, "query_id", "left").select("query_id", F.when(F.col("_parts").isNull(), none).otherwise(full).alias("context"))


def _text(*pieces: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])


# The wording of the layouts.
SYSTEM = """당신은 도움이 되는 AI 어시스턴트입니다. 주어진 문서들을 참고하여 사용자의 질문에 정확하고 상세하게 답변해주세요. 답변할 때는 다음 사항을 고려해주세요:

1. 문서의 내용을 정확히 인용하고 출처를 명시하세요
2. 불확실한 정보는 추측하지 말고 "문서에 명시되지 않았습니다"라고 답변하세요
3. 여러 문서에서 상충되는 정보가 있다면 이를 명시하세요
4. 답변은 한국어로 작성하세요"""
CAUTIONS = (
    "\n답변 시 주의사항:\n- 문서의 정보만을 사용하여 정확하게 답변하세요\n- 조건, 금리, 한도 등 구체적인 수치를 명확히 제시하세요\n"
    "- 체계적으로 구조화하여 답변하세요\n- 불완전한 정보는 '문서에 명시되지 않음'이라고 표시하세요\n"
)


def general(docs: DataFrame, queries: DataFrame) -> DataFrame:
    three = F.format_string("%.3f", "similarity")
    part = _text("\n[문서 ", _no(), "] (유사도: ", three, ")\n", F.col("content"), "\n", F.when(F.coalesce(F.col("source"), F.lit("")) != "", _text("\n출처: ", F.col("source"), "\n")).otherwise(""))
    return laid_out(docs, queries, part, _text("질문: ", F.col("query"), "\n\n관련 문서들:\n"), nothing=F.lit(NOTHING))


def question_answering(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The three best documents."""
    part = _text(_no(), ". (유사도: ", F.format_string("%.3f", "similarity"), ") ", F.col("content"), "\n\n")
    head = _text("다음 질문에 답하기 위해 관련 문서들을 검색했습니다:\n\n질문: ", F.col("query"), "\n\n참고 문서들:\n")
    tail = "위 문서들을 참고하여 질문에 정확하고 상세하게 답변해주세요."
    return laid_out(docs.where("rank <= 3"), queries, part, head, tail, _text(head, tail))


def summarisation(docs: DataFrame, queries: DataFrame) -> DataFrame:
    part = _text("[문서 ", _no(), "]\n", F.col("content"), "\n\n")
    head = _text("다음 주제에 대한 문서들을 요약해주세요:\n\n주제: ", F.col("query"), "\n\n문서들:\n")
    tail = "위 문서들을 종합하여 핵심 내용을 요약해주세요."
    return laid_out(docs, queries, part, head, tail, _text(head, tail))


def prompt(docs: DataFrame, queries: DataFrame, system: str = SYSTEM) -> DataFrame:
    part = _text("[문서 ", _no(), "] (관련도: ", F.format_string("%.3f", "similarity"), ")\n", F.col("content"), "\n\n")
    head = _text(system, "\n\n사용자 질문: ", F.col("query"), "\n\n")
    return laid_out(docs, queries, part, _text(head, "참고 문서들:\n"), "위 문서들을 참고하여 질문에 답변해주세요.", _text(head, NOTHING))


def markdown(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Sentences cleaned one by one; as observed, blanks between word characters go."""
    clean = lambda c: squeezed(c, join_letters=True)
    body = F.array_join(F.transform(F.filter(F.transform(F.split(clean(F.col("content")), r"\."), clean), lambda s: s != ""), lambda s: F.concat(s, F.lit("."))), " ")
    source = F.when(F.coalesce(F.col("source"), F.lit("")) != "", _text("**출처:** ", F.col("source"), "\n\n")).otherwise("")
    part = _text("### 문서 ", _no(), " (관련도: ", F.format_string("%.3f", "similarity"), ")\n", source, body, "\n\n")
    head = _text("# 질문\n", F.col("query"), "\n\n## 관련 문서\n")
    return laid_out(docs, queries, part, head, nothing=_text(head, NOTHING))


def json(docs: DataFrame, queries: DataFrame) -> DataFrame:
    entry = F.struct(F.col("rank").alias("id"), "content", "similarity", F.struct("source").alias("metadata"))
    found = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("documents"))
    none = F.array().cast("array<struct<id:int,content:string,similarity:double,metadata:struct<source:string>>>")
    joined = queries.join(found, "query_id", "left").withColumn("documents", F.coalesce("documents", none))
    return joined.select("query_id", F.to_json(F.struct("query", "documents")).alias("context"))


def conversational(docs: DataFrame, queries: DataFrame) -> DataFrame:
    part = _text("정보 ", _no(), " (신뢰도: ", _percent(F.col("similarity")), "):\n", F.col("content"), "\n\n")
    head = _text("질문: ", F.col("query"), "\n\n")
    return laid_out(docs, queries, part, _text(head, "관련 정보를 찾았습니다:\n\n"), "이 정보들을 바탕으로 답변드리겠습니다.", _text(head, f"죄송하지만 {NOTHING}"))


def structured(docs: DataFrame, queries: DataFrame, scores: bool = True, metadata: bool = True) -> DataFrame:
    pieces: list[str | Column] = ["DOCUMENT ", _no(), ":\nContent: ", F.col("content"), "\n"]
    if scores:
        pieces += ["Relevance Score: ", F.format_string("%.4f", "similarity"), "\n"]
    if metadata:
        pieces.append(F.when(F.col("source").isNotNull(), _text("Metadata: {'source': '", F.col("source"), "'}\n")).otherwise(""))
    head = _text("QUERY: ", F.col("query"), "\n\n")
    return laid_out(docs, queries, _text(*pieces, "-" * 30 + "\n"), _text(head, "DOCUMENTS:\n" + "=" * 50 + "\n"), nothing=_text(head, "DOCUMENTS: None found"))


def policy_facts(content: Column) -> Column:
    """struct<rates,limits,conditions,applications> of a policy text."""
    # Patterns of rates and limits, words of conditions and applications.
    rates = [r"연\s*\d+\.?\d*\s*%", r"\d+\.?\d*\s*%", r"금리.*?\d+\.?\d*"]
    limits = [r"\d+억\s*원?", r"\d+천만\s*원?", r"\d+백만\s*원?", r"\d+만\s*원?", r"\d+%\s*이내"]
    said = F.split(content, r"\.")
    every = lambda ps: F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(0)) for p in ps])

    def about(ws: list[str]) -> Column:
        naming = lambda w: F.filter(said, lambda s: s.contains(w))
        return F.concat(*[F.transform(naming(w), lambda s: squeezed(s)) for w in ws])

    return F.struct(
        every(rates).alias("rates"), every(limits).alias("limits"), about(["자격", "조건", "대상", "요건", "기준"]).alias("conditions"), about(["신청", "방법", "절차", "접수"]).alias("applications")
    )


def policy(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents and, of all of them, up to five rates and limits, in order of first appearance."""
    clean = docs.withColumn("content", squeezed(F.col("content"))).withColumn("facts", policy_facts(F.col("content")))
    part = _text("## 참고 문서 ", _no(), " (관련도: ", _percent(F.col("similarity")), ")\n**출처:** ", _source(), "\n\n**내용:**\n", F.col("content"), "\n\n---\n\n")
    head = _text("# 질문\n", F.col("query"), "\n\n# 관련 정책 정보\n\n")
    body = laid_out(clean, queries, part, head, nothing=_text("질문: ", F.col("query"), "\n\n관련 정책 정보를 찾을 수 없습니다."))
    gathered = clean.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "facts"))).alias("_all"))
    first5 = lambda name: F.slice(F.array_distinct(F.flatten(F.transform("_all", lambda x: x["facts"][name]))), 1, 5)
    line = lambda title, a: F.when(F.size(a) > 0, _text(f"**{title}:** ", F.array_join(a, ", "), "\n\n")).otherwise("")
    some = F.exists("_all", lambda x: (F.size(x["facts"]["rates"]) + F.size(x["facts"]["limits"]) + F.size(x["facts"]["conditions"]) + F.size(x["facts"]["applications"])) > 0)
    joined = body.join(gathered, "query_id", "left")
    digest = F.when(F.coalesce(some, F.lit(False)), _text("# 핵심 정보 요약\n\n", line("금리", first5("rates")), line("대출한도", first5("limits")))).otherwise("")
    return joined.select("query_id", F.concat("context", digest).alias("context"))


def enhanced(docs: DataFrame, queries: DataFrame) -> DataFrame:
    flag = F.when(F.col("similarity") > 0.85, "[🔥 매우 관련성 높음] ").when(F.col("similarity") > 0.75, "[✓ 관련성 높음] ").otherwise("")
    part = _text(flag, "문서 ", _no(), " (출처: ", _source(), ")\n", squeezed(F.col("content")), "\n\n")
    head = _text("질문: ", F.col("query"), "\n\n")
    return laid_out(docs, queries, part, _text(head, "다음 문서들을 참고하여 질문에 답변해주세요:\n\n"), CAUTIONS, _text(head, NOTHING))


LAYOUTS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "general": general, "qa": question_answering, "summarization": summarisation, "prompt": prompt, "markdown": markdown,
    "json": json, "conversational": conversational, "structured": structured, "policy": policy, "enhanced": enhanced,
}
