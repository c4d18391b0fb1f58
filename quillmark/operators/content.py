"""Joining contents to results, previews, length filters, id forms and result layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import similarity_level, compared

# Labels of previews, and what stands for a missing content.
ARTICLE_LABELS = ("第", "条", "章节: ", "长度: ", "字", "法律条文")
CASE_LABELS = ("案例ID: ", "罪名: ", "相关法条: ", "被告人: ", "有期徒刑", "个月", "罚金", "元", "死刑", "无期徒刑", "刑罚: ", "刑事案例")
MISSING = "内容缺失"


def canonical_id(raw: Column) -> Column:
    """One form for all spellings of an id: its kind and number (`case_case_000001`, `CASE_1`, `1` are `case_1`, `1`)."""
    low = F.lower(F.trim(raw))
    number = F.regexp_replace(F.regexp_extract(low, "([0-9]+)", 1), "^0+(?=[0-9])", "")
    kind = F.when(low.rlike("^(law|article)_"), "article").when(low.startswith("case_"), "case")
    return F.when(number == "", low).otherwise(F.concat_ws("_", kind, number))


def clean_case_id(raw: Column) -> Column:
    """Without a doubled prefix."""
    return F.when(raw.startswith("case_case_"), F.replace(raw, F.lit("case_case_"), F.lit("case_"))).otherwise(F.coalesce(raw, F.lit("")))


def document_type(raw: Column) -> Column:
    """Type by the id's form."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("article") | low.startswith("law"), "article").when(low.contains("case"), "case").otherwise("unknown")


def article_title(raw: Column) -> Column:
    """A title in its usual form, from its first number; without one it is left as it is."""
    number = F.regexp_extract(raw, "([0-9]+)", 1)
    return F.when(number == "", raw).otherwise(F.concat(F.lit("第"), number, F.lit("条")))


def join_content(results: DataFrame, docs: DataFrame, result_id: str = "doc_id", doc_id: str = "doc_id", content: list[str] = ("text",)) -> DataFrame:
    """Results with the trimmed first non-null content of their document, matched by canonical id."""
    key = lambda c: canonical_id(F.col(c).cast("string"))
    own = docs.select(key(doc_id).alias("_key"), F.col(doc_id).alias("_raw"), F.trim(F.coalesce(*content)).alias("content"))
    own = own.groupBy("_key").agg(F.min_by("content", "_raw").alias("content"))  # of several spellings of an id the first
    return results.withColumn("_key", key(result_id)).join(own, "_key", "left").drop("_key")


def batch_by_ids(ids: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of a list (ord, key) in the list's order; ids without a document fall out."""
    return ids.join(docs, key).orderBy("ord")


def by_id(articles: DataFrame, cases: DataFrame, wanted: str) -> DataFrame:
    """The document of an id: articles before cases."""
    key = canonical_id(F.lit(wanted))
    both = articles.withColumn("priority", F.lit(0)).unionByName(cases.withColumn("priority", F.lit(1)), allowMissingColumns=True)
    return both.where(canonical_id(F.col("id")) == key).orderBy("priority", "id").limit(1)


def by_number(articles: DataFrame, number: int, content: list[str] = ("content", "full_text", "text")) -> DataFrame:
    """The article of a number with its first content that is there."""
    there = [F.nullif(F.col(c), F.lit("")) for c in content if c in articles.columns]
    return articles.where(F.col("article_number") == number).withColumn("content", F.coalesce(*there, F.lit("")))


def by_chapter(articles: DataFrame, chapter: str) -> DataFrame:
    return articles.where(F.col("chapter").contains(chapter))


def by_accusation(cases: DataFrame, crime: str, column: str = "accusations") -> DataFrame:
    return cases.where(F.array_contains(column, crime))


def by_cited_article(cases: DataFrame, article: int, column: str = "relevant_articles") -> DataFrame:
    return cases.where(F.array_contains(F.col(column), F.lit(article)))


def content_preview(content: Column, size: int = 300) -> Column:
    """The content, or its beginning up to the last full stop beyond seven tenths of the size, else with dots."""
    head = F.substring(content, 1, size)
    back = F.locate("。", F.reverse(head))
    stop = F.when(back > 0, size - back + 1).otherwise(0)  # place of the last full stop, from 1
    cut = F.when(stop - 1 > 0.7 * size, head.substr(F.lit(1), stop)).otherwise(F.concat(head, F.lit("...")))
    return F.when(F.length(content) <= size, content).otherwise(cut)


def long_enough(results: DataFrame, least: int = 20, content: str = "content") -> DataFrame:
    """Results whose trimmed content has a length; a missing one counts as its short placeholder."""
    return results.where(F.length(F.trim(F.coalesce(content, F.lit(MISSING)))) >= least)


def long_or_unknown(results: DataFrame, least: int, size: str = "content_length") -> DataFrame:
    """Filter by a length known beforehand; rows without one stay."""
    return results.where(F.col(size).isNull() | (F.col(size) >= least))


def adaptive_length_filter(results: DataFrame, least: int, target: int) -> DataFrame:
    """Per query the rows that are long enough; twice the target at most if there are one and a half times as many."""
    own = long_enough(results, least)
    sizes = own.groupBy(F.col("qid").alias("_q")).agg(F.count("*").alias("_n"))
    sized = own.join(sizes, F.col("qid").eqNullSafe(F.col("_q"))).drop("_q")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(compared().desc(), "doc_id"))
    few = sized.where(F.col("_n") < 1.5 * target).drop("_n")
    many = sized.where(F.col("_n") >= 1.5 * target).withColumn("_place", place).where(F.col("_place") <= 2 * target)  # cut below the exchange
    return few.unionByName(many.drop("_n", "_place"))


def article_preview(number: Column, chapter: Column, length: Column) -> Column:
    a, b, c, d, e, none = ARTICLE_LABELS
    part = lambda v, *words: F.when(v.isNotNull() & (v.cast("string") != "") & (v.cast("string") != "0"), F.concat(*words))
    whole = F.concat_ws(" | ", part(number, F.lit(a), number.cast("string"), F.lit(b)), part(chapter, F.lit(c), chapter), part(length, F.lit(d), length.cast("string"), F.lit(e)))
    return F.coalesce(F.nullif(whole, F.lit("")), F.lit(none))


def case_preview(case_id: Column, accusations: Column, articles: Column, criminals: Column, months: Column, fine: Column, death: Column, life: Column) -> Column:
    c = CASE_LABELS
    some = lambda arr, label: F.when(F.size(arr) > 0, F.concat(F.lit(label), F.array_join(F.transform(arr, lambda x: x.cast("string")), ", ")))
    verdict = F.concat_ws(", ", F.when(months > 0, F.concat(F.lit(c[4]), months.cast("string"), F.lit(c[5]))), F.when(fine > 0, F.concat(F.lit(c[6]), fine.cast("string"), F.lit(c[7]))), F.when(death, F.lit(c[8])), F.when(life, F.lit(c[9])))
    whole = F.concat_ws(" | ", F.when(case_id != "", F.concat(F.lit(c[0]), case_id)), some(accusations, c[1]), some(articles, c[2]), some(criminals, c[3]), F.when(verdict != "", F.concat(F.lit(c[10]), verdict)))
    return F.coalesce(F.nullif(whole, F.lit("")), F.lit(c[11]))


def format_articles(rows: DataFrame) -> DataFrame:
    """Articles (article_number, title, content, score, similarity) as results."""
    number = F.when(F.col("article_number").cast("string").rlike("^[0-9]+$"), F.col("article_number").cast("int"))
    shown = F.col("article_number").cast("string")
    return rows.select(F.concat(F.lit("article_"), shown).alias("id"), F.lit("article").alias("type"), F.coalesce("title", F.concat(F.lit("第"), shown, F.lit("条"))).alias("title"), F.col("content"), number.alias("article_number"), F.coalesce("score", "similarity").alias("similarity"))


def format_cases(rows: DataFrame) -> DataFrame:
    """Cases (case_id, accusations, fact, content, score, similarity) as results."""
    own = clean_case_id(F.col("case_id"))
    title = F.when(F.size("accusations") > 0, F.concat(own, F.lit(" - "), F.array_join("accusations", ", "))).otherwise(own)
    return rows.select(own.alias("id"), F.lit("case").alias("type"), title.alias("title"), F.coalesce("content", "fact", F.lit("")).alias("content"), F.col("case_id"), F.coalesce("score", "similarity").alias("similarity"))


def response(articles: DataFrame, cases: DataFrame, content: bool = True) -> DataFrame:
    """Both kinds of results in one flat layout, null where a kind has no such field."""
    both = articles.unionByName(cases, allowMissingColumns=True)
    return both if content else both.drop("content")


def is_valid_result(identifier: str = "id", kind: str = "type", title: str = "title", similarity: str = "similarity") -> Column:
    fields = [F.col(c).isNotNull() for c in (identifier, kind, title, similarity)]
    return fields[0] & fields[1] & fields[2] & fields[3] & F.coalesce(F.col(similarity).between(0, 1), F.lit(False))


def severe_punishment(death: Column, life: Column, months: Column) -> Column:
    """Death, life, or ten years and more."""
    return F.coalesce(death, F.lit(False)) | F.coalesce(life, F.lit(False)) | F.coalesce(months >= 120, F.lit(False))


def searchable_text(*parts: Column) -> Column:
    return F.concat_ws(" ", *parts)


def embedding_text(title: Column, body: Column) -> Column:
    """Title and body on two lines; null if both are blank."""
    return F.nullif(F.trim(F.concat_ws("\n", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(body), F.lit("")))), F.lit(""))


def result_metadata(results: DataFrame, *group: str) -> DataFrame:
    """Numbers by type and least, largest and mean similarity."""
    return results.groupBy(*group).agg(F.count("*").alias("n"), F.count_if(F.col("doc_type") == "A").alias("n_a"), F.count_if(F.col("doc_type") == "B").alias("n_b"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("avg_score"))


def type_counts(docs: DataFrame, kind: str = "doc_type") -> DataFrame:
    """Documents by type, and all of them in the row without a type."""
    return docs.rollup(kind).agg(F.count("*").alias("n"))


def valid_query(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def clamped(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def client_filter(names: DataFrame, name: str, others: str, term: str) -> DataFrame:
    """Rows whose name, or one of whose related names, holds the term in any case."""
    low = term.lower()
    return names.where(F.lower(name).contains(low) | F.exists(others, lambda x: F.lower(x.cast("string")).contains(low)))


def percent(value: Column) -> Column:
    """A share as a percentage of one decimal, halves rounded up; six places count, so that noise of doubles decides no half."""
    return F.concat(F.round((value * 100).cast("decimal(20,6)"), 1).cast("string"), F.lit("%"))


def milliseconds(seconds: Column) -> Column:
    return F.concat(F.round(seconds * 1000).cast("long").cast("string"), F.lit("ms"))


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.9, "very_high").when(value >= 0.8, "high").when(value >= 0.7, "medium").otherwise("low")


def ordered_suggestions(rows: DataFrame) -> DataFrame:
    """Suggestions (type, priority, text): those of crimes first, then by priority, the smallest number first."""
    return rows.orderBy(F.when(F.col("type") == "crime", 0).otherwise(1), "priority", "text")


#: Fields of a kind of documents, the name of the law, the source and the search that results bear without another.
CASE_FIELDS = {"case_id": "string", "criminals": "array<string>", "accusations": "array<string>", "relevant_articles": "array<int>", "punish_of_money": "double", "death_penalty": "boolean", "life_imprisonment": "boolean", "imprisonment_months": "int"}
ARTICLE_FIELDS = {"article_number": "int", "chapter": "string", "law_name": "string"}
LAW, SOURCE, METHOD = "刑法", "数据集", "hybrid"


def field(rows: DataFrame, name: str, kind: str) -> Column:
    """A column if the rows have it, else null."""
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def display_title(rows: DataFrame) -> Column:
    """An article's number and title, a case's first defendant and charge; else the title, else the id."""
    number, title = field(rows, "article_number", "int"), F.coalesce(field(rows, "title", "string"), F.lit(""))
    who, what = F.get(field(rows, "criminals", "array<string>"), 0), F.get(field(rows, "accusations", "array<string>"), 0)
    article = F.when(F.coalesce(number, F.lit(0)) != 0, F.concat(F.lit("第"), number.cast("string"), F.lit("条 "), title)).when(title != "", title).otherwise(F.concat(F.lit("法条 "), "id"))
    case = F.when(who.isNotNull() & what.isNotNull(), F.concat(who, what, F.lit("案"))).when(title != "", title).otherwise(F.concat(F.lit("案例 "), F.coalesce(field(rows, "case_id", "string"), "id")))
    return F.when(F.col("type") == "article", article).otherwise(case)


def document_text(rows: DataFrame) -> Column:
    """What a document is searched by: title and content, then chapter and law of an article, names and charges of a case."""
    some = lambda c: F.nullif(c, F.lit(""))
    joined = lambda name: some(F.array_join(field(rows, name, "array<string>"), " "))
    first = [some(field(rows, c, "string")) for c in ("title", "content")]
    return F.when(F.col("type") == "article", F.concat_ws(" ", *first, some(field(rows, "chapter", "string")), some(field(rows, "law_name", "string")))).otherwise(F.concat_ws(" ", *first, joined("criminals"), joined("accusations")))


def own_fields(rows: DataFrame) -> list[Column]:
    """The fields of each kind, null in rows of the other."""
    of = lambda fields, kind: [F.when(F.col("type") == kind, field(rows, c, t)).alias(c) for c, t in fields.items()]
    return of(CASE_FIELDS, "case") + of(ARTICLE_FIELDS, "article")


def document_projection(rows: DataFrame, *more: Column) -> DataFrame:
    """Documents (id, type, title, content and fields of their kind) as they are answered by id."""
    return rows.select("id", display_title(rows).alias("title"), field(rows, "content", "string").alias("content"), "type", document_text(rows).alias("searchable_text"), *own_fields(rows), *more)


def result_projection(rows: DataFrame) -> DataFrame:
    """Documents with a similarity and a rank as results: with a level, and whether a case's punishment is severe."""
    severe = severe_punishment(*(field(rows, c, CASE_FIELDS[c]) for c in ("death_penalty", "life_imprisonment", "imprisonment_months")))
    extra = [F.col("similarity"), similarity_level("similarity").alias("confidence_level"), F.col("rank"), F.when(F.col("type") == "case", severe).alias("is_severe_case")]
    return document_projection(rows, *extra).drop("searchable_text")


def raw_projection(rows: DataFrame) -> DataFrame:
    """Rows of any search (id and what else they have) as results: kind and title by the id's form, defaults for the rest."""
    kind = F.when(F.col("id").contains("case_"), "case").when(F.col("id").contains("article_"), "article")
    of = lambda name, want, t, default: F.when(kind == want, F.coalesce(field(rows, name, t), default)).alias(name)
    none = F.array()
    return rows.select(
        "id", article_title(F.coalesce(field(rows, "title", "string"), "id")).alias("title"), F.coalesce(field(rows, "content", "string"), F.lit("")).alias("content"),
        F.coalesce(field(rows, "similarity", "double"), field(rows, "fusion_score", "double"), F.lit(0.0)).alias("similarity"), document_type(F.col("id")).alias("type"),
        F.coalesce(field(rows, "search_method", "string"), F.lit(METHOD)).alias("search_method"), F.lit(SOURCE).alias("source"),
        of("case_id", "case", "string", F.col("id")), of("accusations", "case", "array<string>", none.cast("array<string>")), of("relevant_articles", "case", "array<int>", none.cast("array<int>")), of("imprisonment_months", "case", "int", F.lit(0)),
        of("article_number", "article", "string", F.lit("")), of("chapter", "article", "string", F.lit("")), of("law_name", "article", "string", F.lit(LAW)),
    )
