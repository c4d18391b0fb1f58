"""Crimes, articles, names and sentences in texts; keywords of queries; templates of generated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .graph import plain_crime

# The lexicon of crimes (word, crime, confidence, article), words that say nothing about a case, weighted
# professional terms, patterns of names and sentences, and the texts of templates.
LEXICON = [
    ("故意伤害", "故意伤害罪", 0.9, 234),
    ("故意杀人", "故意杀人罪", 0.95, 232),
    ("盗窃", "盗窃罪", 0.85, 264),
    ("抢劫", "抢劫罪", 0.9, 263),
    ("诈骗", "诈骗罪", 0.88, 266),
    ("强奸", "强奸罪", 0.95, 236),
    ("绑架", "绑架罪", 0.92, 239),
    ("敲诈", "敲诈勒索罪", 0.9, 274),
    ("贪污", "贪污罪", 0.93, 382),
    ("受贿", "受贿罪", 0.93, 385),
    ("交通肇事", "交通肇事罪", 0.85, 133),
    ("危险驾驶", "危险驾驶罪", 0.88, 133),
    ("醉驾", "危险驾驶罪", 0.9, 133),
    ("毒品", "非法持有毒品罪", 0.8, 348),
    ("贩毒", "贩卖毒品罪", 0.95, 347),
]
COMMON = [
    "刑事", "犯罪", "受害者", "被告人", "法律", "处罚", "责任", "行为",
    "构成", "依据", "规定", "条文", "案件", "事实", "情节", "社会",
    "危害", "后果", "怎么", "如何", "什么", "哪个", "判刑", "定罪",
]
TERMS = {
    "轻伤": 0.75, "重伤": 0.8, "死亡": 0.85,
    "数额较大": 0.7, "数额巨大": 0.75, "数额特别巨大": 0.8,
    "情节严重": 0.7, "情节特别严重": 0.75,
    "故意": 0.65, "过失": 0.65, "暴力": 0.7,
    "秘密窃取": 0.7, "公然抢夺": 0.7, "入户": 0.65,
    "持有": 0.6, "贩卖": 0.7, "运输": 0.65,
    "伤害": 0.6, "杀人": 0.75, "盗窃": 0.7, "抢劫": 0.75,
    "醉酒": 0.7, "驾驶": 0.65, "机动车": 0.6,
    "诈骗": 0.75, "敲诈": 0.7, "勒索": 0.7,
    "绑架": 0.8, "强奸": 0.8, "抢夺": 0.7,
}
NONE_KNOWN = "暂无"
ANSWER_STARTS = ["专业回答：", "回答：", "答：", "法律回答：", "根据相关法律规定：", "依据法律规定："]
ANSWER_ENDS = ["具体情况请咨询专业律师。", "建议咨询专业律师。", "请咨询专业法律人士。", "以上仅供参考。", "详情请咨询法律专家。"]
SMALL_TALK = ["你好", "您好", "请问", "谢谢", "不客气", "希望对您有帮助"]
LEGAL_WORDS = ["法", "罪", "条", "律", "刑", "判", "责任", "处罚", "违法", "犯罪"]
COLLOQUIAL = ["怎么办", "咋办", "啥", "咋", "嘛", "呢", "吧"]
FALLBACK = (
    "针对您咨询的问题'%s'，基于检索到的法律资源，现提供以下分析：\n\n",
    "【相关法条】\n根据检索结果，找到%d条相关法条：\n",
    "【相关案例】\n系统检索到%d个相关案例可供参考。\n\n",
    "【建议】\n建议您：\n1. 详细了解上述法条的具体内容\n2. 参考相关案例的处理方式\n3. 如需具体法律意见，请咨询专业律师\n\n*本回答基于AI检索系统生成，仅供参考，不构成正式法律意见。",
)
NAME_BEFORE = "被告人|犯罪嫌疑人|上诉人|原审被告人|当事人"
NAME_END = r"[^、，。\s至]+"
NAME_LETTERS = "^[一-龯某甲乙丙丁]{2,4}$"
COMPOUND = r"[\[\]、，]"


def lexicon(spark: SparkSession) -> DataFrame:
    """(word, crime_name, confidence, article_number) in the lexicon's order."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(LEXICON)], "ord int, word string, crime_name string, confidence double, article_number int")


def contained(queries: DataFrame, words: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """Queries joined to the words (not empty) of a vocabulary that they contain.

    The first characters of words (four, or as many as the shortest has) are looked up among the distinct runs of so many
    characters of each text; what they lead to is then compared whole.  The join is one of equals at any size.  Runs carry
    a hash of their text instead of the text, which comes back for the comparison.
    """
    shortest = words.where(F.length(word) > 0).agg(F.min(F.length(word))).first()[0]
    width = min(4, shortest or 1)
    own, known = queries.withColumn("_key", F.xxhash64(text)), words.where(F.length(word) > 0).withColumn("_run", F.substring(word, 1, width))
    letters = own.where(F.length(text) >= width).select("_key", F.split(F.col(text), "").alias("_letters"))
    runs = F.col("_letters")
    for k in range(1, width):  # elements meet their followers, so that no row is split anew for each of them
        runs = F.zip_with(runs, F.slice("_letters", k + 1, F.size("_letters")), lambda x, y: F.concat(x, y))
    looked = letters.select("_key", F.explode(F.array_distinct(runs)).alias("_run")).join(known.select("_run").distinct(), "_run", "left_semi").distinct()
    return own.join(looked.join(known, "_run"), "_key").where(F.col(text).contains(F.col(word))).drop("_run", "_key")


def near_names(names: DataFrame, others: DataFrame) -> DataFrame:
    """(crime, accusation): names (crime) and others (accusation) one of which contains the other; empty names are near none."""
    inside = contained(others.select("accusation").distinct(), names.select("crime").distinct(), "accusation", "crime")
    around = contained(names.select("crime").distinct(), others.select("accusation").distinct(), "crime", "accusation")
    return inside.select("crime", "accusation").union(around.select("crime", "accusation")).distinct()


def lexicon_crimes(queries: DataFrame) -> DataFrame:
    """(qid, ord, crime_name, confidence, article_number) of lexicon words in queries (qid, text)."""
    low = queries.select("qid", F.lower("text").alias("text"))
    return contained(low, lexicon(queries.sparkSession)).select("qid", "ord", "crime_name", "confidence", "article_number")


def weighted_keywords(queries: DataFrame, most: int = 8) -> DataFrame:
    """(qid, keyword, weight, place): articles and crimes of the lexicon, professional terms, then other words."""
    spark = queries.sparkSession
    found = lexicon_crimes(queries)
    n = F.col("article_number").cast("string")
    core = F.replace("crime_name", F.lit("罪"), F.lit(""))
    of = lambda part, at, word, weight: found.select("qid", F.lit(part).alias("part"), (F.col("ord") * 2 + at).alias("ord"), word.alias("keyword"), F.lit(weight).alias("weight"))
    terms = spark.createDataFrame([(i, w, x) for i, (w, x) in enumerate(TERMS.items())], "ord int, word string, weight double")
    named = contained(queries.select("qid", "text"), terms).select("qid", F.lit(3).alias("part"), "ord", F.col("word").alias("keyword"), "weight")
    runs = queries.select("qid", F.posexplode(F.regexp_extract_all("text", F.lit("([\\u4e00-\\u9fff]{2,})"), 1)).alias("ord", "keyword"))
    known = F.array(*[F.lit(t) for t in TERMS])
    other = runs.where(~F.exists(known, lambda t: F.col("keyword").contains(t))).select("qid", F.lit(4).alias("part"), "ord", "keyword", F.when(F.length("keyword") >= 4, 0.55).otherwise(0.45).alias("weight"))
    first = of(1, 0, F.concat(F.lit("第"), n, F.lit("条")), 0.95).unionByName(of(1, 1, n, 0.9))
    second = of(2, 0, F.col("crime_name"), 0.85).unionByName(of(2, 1, core, 0.8))
    every = first.unionByName(second).unionByName(named).unionByName(other).where(~F.col("keyword").isin(COMMON))
    best = Window.partitionBy("qid", "keyword").orderBy(F.desc("weight"), "part", "ord")
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "part", "ord", "keyword")
    kept = every.withColumn("_n", F.row_number().over(best)).where("_n = 1").withColumn("place", F.row_number().over(order))
    return kept.where(F.col("place") <= most).select("qid", "keyword", "weight", "place")


def latin_keywords(queries: DataFrame, stop: list[str], most: int = 8, long: int = 8) -> DataFrame:
    """Weighted keywords of Latin texts: longer words weigh more, stop words fall out."""
    words = queries.select("qid", F.posexplode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+"), lambda w: F.length(w) >= 2)).alias("ord", "keyword"))
    first = words.where(~F.col("keyword").isin(stop)).groupBy("qid", "keyword").agg(F.min("ord").alias("ord"))
    weight = F.when(F.length("keyword") >= long, 0.55).otherwise(0.45)
    order = Window.partitionBy("qid").orderBy(F.desc("weight"), "ord")
    return first.withColumn("weight", weight).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("qid", "keyword", "weight", "place")


def detect_crimes(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, crime): the name itself, else words in the text and names before the suffix, else the closest longer name.

    Two-character beginnings of names stand for the last name in order that begins so.
    """
    names = edges.select("crime").distinct()
    start = names.where(F.length("crime") > 2).groupBy(F.substring("crime", 1, 2).alias("word")).agg(F.max("crime").alias("crime"))
    words = names.select(F.col("crime").alias("word"), "crime").union(names.select(F.concat("crime", F.lit("罪")), "crime")).union(start)
    asked = queries.select("qid", "text")
    whole = asked.withColumn("crime", plain_crime(F.col("text"))).join(names, "crime").select("qid", "crime", F.lit(1).alias("tier"))
    tail = asked.where(F.col("text").endswith("罪")).withColumn("crime", F.expr("substring(text, 1, length(text) - 1)")).join(names, "crime").select("qid", "crime", F.lit(2).alias("tier"))
    simple = names.where(~F.col("crime").rlike(COMPOUND))
    inside = contained(asked, words).join(simple, "crime", "left_semi").select("qid", "crime", F.lit(3).alias("tier"))
    spoken = F.concat(F.regexp_extract_all("text", F.lit(r"(?U)(\w+)罪"), 1), F.regexp_extract_all("text", F.lit(r"(?U)(\w{2,4})犯罪"), 1))
    said = asked.select("qid", F.explode(spoken).alias("name")).withColumn("crime", plain_crime(F.col("name"))).join(simple, "crime").select("qid", "crime", F.lit(3).alias("tier"))
    share = F.length("text") / F.length("crime")
    close = contained(names, asked, "crime", "text")  # names that contain a text: the same search the other way round
    close = close.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(share), "crime"))).where("n = 1").select("qid", "crime", F.lit(5).alias("tier"))
    every = whole.unionByName(tail).unionByName(inside).unionByName(said).unionByName(close)
    least = F.min("tier").over(Window.partitionBy("qid"))
    return every.withColumn("least", least).where("tier = least").select("qid", "crime").distinct()


def detect_articles(queries: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, article): known article numbers that a text names, alone or in an article's usual form."""
    known = edges.select(F.col("article").cast("string").alias("article")).distinct()
    words = known.select(F.col("article").alias("word"), "article")
    by_word = contained(queries.select("qid", "text"), words).select("qid", "article")
    forms = F.concat(*[F.regexp_extract_all("text", F.lit(p), 1) for p in (r"第?\s*([0-9]+)\s*条", r"([0-9]+)\s*条", r"第([0-9]+)")])
    by_form = queries.select("qid", F.explode(forms).alias("article")).join(known, "article", "left_semi")
    return by_word.unionByName(by_form).distinct()


# ---------------------------------------------------------------------------------------------------------------------
# scalars over texts


def defendants(names: Column, fact: Column) -> Column:
    """Names given, else those that a fact names after words for a defendant."""
    given = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    raw = F.regexp_extract_all(fact, F.lit(f"(?:{NAME_BEFORE})({NAME_END})"), 1)
    clean = F.transform(raw, lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "等人?$", ""), r"[；：].*$", ""), "在.*$", "")))
    found = F.array_distinct(F.filter(clean, lambda x: x.rlike(NAME_LETTERS)))
    return F.when(F.size(given) > 0, F.array_join(given, "、")).when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, F.array_join(found, "、")).otherwise(NONE_KNOWN)


def sentence(death: Column, life: Column, months: Column, fine: Column, fact: Column) -> Column:
    """The sentence in words: from the structured fields, else from the fact."""
    years, rest = F.floor(months / 12).cast("string"), (months % 12).cast("string")
    term = F.when(months < 12, F.concat(F.lit("有期徒刑"), months.cast("string"), F.lit("个月"))).when(months % 12 > 0, F.concat(F.lit("有期徒刑"), years, F.lit("年"), rest, F.lit("个月"))).otherwise(F.concat(F.lit("有期徒刑"), years, F.lit("年")))
    main = F.when(death, "死刑").when(life, "无期徒刑").when(months > 0, term)
    money = F.when(fine > 0, F.concat(F.lit("罚金"), fine.cast("string"), F.lit("元")))
    parts = [r"(判处死刑)", r"(判处无期徒刑)", r"(有期徒刑[0-9]+年[0-9]+个月)", r"(有期徒刑[0-9]+年)", r"(有期徒刑[0-9]+个月)", r"(拘役[0-9]+个月)", r"(罚金[0-9]+(?:\.[0-9]+)?万?元)"]
    told = F.array_distinct(F.transform(F.concat(*[F.regexp_extract_all(fact, F.lit(p), 1) for p in parts]), lambda x: F.regexp_replace(x, "^判处", "")))
    known = F.nullif(F.concat_ws("、", main, money), F.lit(""))
    return F.coalesce(known, F.nullif(F.array_join(told, "、"), F.lit("")), F.lit(NONE_KNOWN))


def statutes(text: Column, most: int = 5) -> Column:
    """Passages that name an article, else long sentences; the first few."""
    named = F.filter(F.transform(F.split(text, "(?=第[0-9]+条)"), lambda x: F.trim(x)), lambda x: x.rlike("^第[0-9]+条"))
    long = F.filter(F.transform(F.split(text, "[。；;]"), lambda x: F.trim(x)), lambda x: F.length(x) > 20)
    return F.slice(F.when(F.size(named) > 0, named).otherwise(long), 1, most)


def query2doc(text: Column, crimes: Column) -> Column:
    """The template of an enhanced query; `crimes` is an array of structs (crime_name, article_number)."""
    names = F.array_join(F.transform(crimes, lambda c: c["crime_name"]), ", ")
    cited = F.array_join(F.transform(F.filter(crimes, lambda c: c["article_number"].isNotNull()), lambda c: F.concat(F.lit("第"), c["article_number"].cast("string"), F.lit("条"))), ", ")
    laws = F.when(cited != "", F.concat(F.lit("相关法条包括"), cited, F.lit("。"))).otherwise("")
    known = F.concat(F.lit("根据《中华人民共和国刑法》相关规定，涉及"), names, F.lit("等罪名。"), laws, F.lit("针对'"), text, F.lit("'的法律分析和处理依据。"))
    return F.when(F.size(crimes) > 0, known).otherwise(F.concat(F.lit("关于'"), text, F.lit("'的法律条文和相关案例分析。")))


def hypothetical_answer(text: Column, crimes: Column) -> Column:
    """The template of a hypothetical answer."""
    first = F.get(crimes, 0)
    law = F.when(first["article_number"].isNotNull(), F.concat(F.lit("依据《刑法》第"), first["article_number"].cast("string"), F.lit("条，"))).otherwise("")
    known = F.concat(F.lit("根据法律规定，"), text, F.lit("可能涉及"), first["crime_name"], F.lit("。"), law, F.lit("此类行为的法律后果包括刑事责任和相应的刑罚措施。具体量刑需要根据案件的具体情况、犯罪情节、社会危害程度等因素综合判定。"))
    other = F.concat(F.lit("关于"), text, F.lit("的法律问题，需要根据具体情况分析适用的法律条文和相关判例，以确定相应的法律责任和处理方式。"))
    return F.when(F.size(crimes) > 0, known).otherwise(other)


def clean_generated(text: Column, least: int = 10, most: int = 200) -> Column:
    """A generated text without its opening phrase and quotes; empty if too short, cut if too long."""
    plain = F.trim(F.regexp_replace(F.trim(text), "^(生成的法律文档片段：|法律文档片段：|文档片段：|回答：|答：)", ""))
    bare = F.trim(F.regexp_replace(F.trim(F.regexp_replace(plain, '(?s)^"(.*)"$', "$1")), "(?s)^「(.*)」$", "$1"))
    return F.when(F.length(bare) < least, "").when(F.length(bare) > most, F.concat(F.substring(bare, 1, most), F.lit("..."))).otherwise(F.coalesce(bare, F.lit("")))


def clean_answer(text: Column, least: int = 15, most: int = 300) -> Column:
    """A generated answer without opening and closing phrases, quotes and small talk; empty if too short, cut after its
    last sentence that fits if too long."""
    strip = lambda c: F.regexp_replace(c, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")
    bare = strip(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), f"^({'|'.join(ANSWER_STARTS)})", ""))
    for end in ANSWER_ENDS:
        bare = F.regexp_replace(bare, f"[ \\t\\r\\n]*{end}$", "")
    for left, right in (('"', '"'), ("「", "」")):
        bare = strip(F.regexp_replace(bare, f"(?s)^{left}(.*){right}$", "$1"))
    head = F.substring(bare, 1, most)
    whole = F.nullif(F.regexp_extract(head, "(?s)^(.*。)", 1), F.lit(""))
    cut = F.when(F.length(bare) > most, F.coalesce(whole, F.concat(head, F.lit("...")))).otherwise(bare)
    return F.when(F.length(bare) < least, "").otherwise(strip(F.regexp_replace(cut, "|".join(SMALL_TALK), "")))


def good_answer(text: Column) -> Column:
    """Whether an answer is long enough, speaks of law, and is not colloquial."""
    spoken = sum((text.contains(m).cast("int") for m in COLLOQUIAL), F.lit(0))
    return F.coalesce((F.length(text) >= 15) & text.rlike("|".join(LEGAL_WORDS)) & (spoken <= 2), F.lit(False))


def enhanced_query(text: Column, generated: Column, between: str = " ") -> Column:
    """The query followed by what was generated for it, if anything was."""
    return F.concat_ws(between, text, F.nullif(generated, F.lit("")))


def fallback_answer(queries: DataFrame, articles: DataFrame, cases: DataFrame, most: int = 3) -> DataFrame:
    """(qid, answer): the template of an answer without a generator, with the first titles of articles (qid, rank, title)
    and the number of cases (qid, rank)."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("title", F.format_string("第%d条", F.col("rank"))))
    law = articles.groupBy("qid").agg(F.count("*").alias("n_law"), F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", line.alias("line"))))).alias("lines"))
    own = queries.select("qid", "text").join(law, "qid", "left").join(cases.groupBy("qid").agg(F.count("*").alias("n_cases")), "qid", "left")
    first, found, listed, closing = FALLBACK
    laws = F.when(F.col("n_law") > 0, F.concat(F.format_string(found, F.col("n_law")), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), F.lit("\n\n")))
    return own.select("qid", F.concat(F.format_string(first, F.coalesce("text", F.lit(""))), F.coalesce(laws, F.lit("")), F.coalesce(F.when(F.col("n_cases") > 0, F.format_string(listed, F.col("n_cases"))), F.lit("")), F.lit(closing)).alias("answer"))


def parse_classification(payload: Column) -> Column:
    """The classifier's JSON as a struct with defaults; null where it is not JSON."""
    schema = "is_criminal_law boolean, confidence double, identified_crimes array<struct<crime_name string, relevance double>>, query2doc_enhanced string, hyde_hypothetical string, bm25_keywords array<struct<keyword string, weight double>>"
    own = F.from_json(payload, schema)
    good = F.filter(F.coalesce(own["identified_crimes"], F.array().cast("array<struct<crime_name string, relevance double>>")), lambda c: c["crime_name"].isNotNull())
    words = F.filter(F.coalesce(own["bm25_keywords"], F.array().cast("array<struct<keyword string, weight double>>")), lambda k: k["keyword"].isNotNull())
    return F.when(F.get_json_object(payload, "$").isNotNull(), F.struct(F.coalesce(own["is_criminal_law"], F.lit(False)).alias("is_criminal_law"), F.coalesce(own["confidence"], F.lit(0.0)).alias("confidence"), good.alias("identified_crimes"), F.coalesce(own["query2doc_enhanced"], F.lit("")).alias("query2doc_enhanced"), F.coalesce(own["hyde_hypothetical"], F.lit("")).alias("hyde_hypothetical"), words.alias("bm25_keywords")))


def read_classification(payload: Column) -> Column:
    """A classifier's JSON as a struct, field by field: a field that is missing, null or of another kind has its default and leaves the others
    as they are; `errors` names fields that are there and can't be read, `payload` if the whole is no JSON object.

    Crimes without a name and keywords without a word fall out; a keyword may be a plain string, of weight 1.
    """
    whole = F.try_parse_json(payload)
    there = lambda path: F.try_variant_get(whole, path, "variant")
    wrong = lambda path, value: there(path).isNotNull() & ~F.is_variant_null(there(path)) & value.isNull()
    known = F.schema_of_variant(whole).startswith("OBJECT")
    plain = {
        "is_criminal_law": (F.try_variant_get(whole, "$.is_criminal_law", "boolean"), F.lit(False)),
        "confidence": (F.try_variant_get(whole, "$.confidence", "double"), F.lit(0.5)),
        "query2doc_generated": (F.try_variant_get(whole, "$.query2doc_generated", "string"), F.lit("")),
        "hyde_answer": (F.try_variant_get(whole, "$.hyde_answer", "string"), F.lit("")),
    }
    crimes = F.try_variant_get(whole, "$.identified_crimes", "array<variant>")
    named = F.transform(crimes, lambda c: F.struct(F.try_variant_get(c, "$.crime_name", "string").alias("crime_name"), F.try_variant_get(c, "$.relevance", "double").alias("relevance")))
    words = F.try_variant_get(whole, "$.bm25_keywords", "array<variant>")
    bare = lambda k: F.when(F.schema_of_variant(k) == "STRING", F.try_variant_get(k, "$", "string"))
    said = F.transform(words, lambda k: F.struct(F.coalesce(bare(k), F.try_variant_get(k, "$.keyword", "string")).alias("keyword"), F.coalesce(F.try_variant_get(k, "$.weight", "double"), F.lit(1.0)).alias("weight")))
    none = lambda kind: F.array().cast(kind)
    fields = [F.coalesce(value, default).alias(name) for name, (value, default) in plain.items()]
    fields.append(F.coalesce(F.filter(named, lambda c: F.coalesce(c["crime_name"], F.lit("")) != ""), none("array<struct<crime_name:string,relevance:double>>")).alias("identified_crimes"))
    fields.append(F.coalesce(F.filter(said, lambda k: F.coalesce(k["keyword"], F.lit("")) != ""), none("array<struct<keyword:string,weight:double>>")).alias("bm25_keywords"))
    flags = [F.when(wrong(f"$.{name}", value), F.lit(name)) for name, (value, _) in {**plain, "identified_crimes": (crimes, None), "bm25_keywords": (words, None)}.items()]
    errors = F.when(~F.coalesce(known, F.lit(False)), F.array(F.lit("payload"))).otherwise(F.filter(F.array(*flags), lambda e: e.isNotNull()))
    return F.struct(*fields, errors.alias("errors"))


def route(crimes: Column, enhanced: Column, answer: Column, keywords: Column) -> Column:
    """The search paths whose input is there, in order; the plain search always is."""
    there = lambda c, name: F.when(c, F.lit(name))
    paths = F.array(there(F.size(crimes) > 0, "knowledge_graph"), there(F.coalesce(enhanced, F.lit("")) != "", "query2doc"), there(F.coalesce(answer, F.lit("")) != "", "hyde"), there(F.size(keywords) > 0, "bm25_hybrid"), F.lit("basic_semantic"))
    return F.filter(paths, lambda p: p.isNotNull())


def routing_plan(paths: DataFrame) -> DataFrame:
    """(qid, path, priority, expected, minimum_engines, confidence) for the ordered paths of queries (qid, paths)."""
    each = paths.select("qid", F.size("paths").alias("n"), F.posexplode("paths").alias("i", "path"))
    return each.select("qid", "path", (1.0 / (F.col("i") + 1)).alias("priority"), F.when(F.col("i") == 0, 0.8).otherwise(0.6 - 0.1 * F.col("i")).alias("expected"), F.greatest(F.lit(1), F.floor(F.col("n") / 2).cast("int")).alias("minimum_engines"), F.when(F.col("n") >= 3, 0.9).otherwise(0.7).alias("confidence"))


def answer_prompt(results: DataFrame, size: int = 500, most: int = 5) -> DataFrame:
    """(qid, context): the first results as numbered lines, their contents cut."""
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("title"), F.lit(" ("), F.format_number(F.col("score") * 100, 1), F.lit("%): "), F.substring(F.coalesce("content", F.lit("")), 1, size))
    top = results.where(F.col("rank") <= most).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return top.select("qid", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("context"))


def lexicon_of_corpus(docs: DataFrame, words: int = 150, least: float = 0.015, stop: list[str] = (), between: str = r"(?U)\W+") -> DataFrame:
    """(word, weight, category): the corpus's words by tf-idf over the largest, in three bands."""
    tokens = docs.select("doc_id", F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), between)).alias("word")).where((F.length("word") >= 2) & (F.length("word") <= 8) & ~F.col("word").isin(list(stop)))
    n = docs.agg(F.count("*").alias("n_docs"))
    per = tokens.groupBy("word").agg(F.count("*").alias("tf"), F.countDistinct("doc_id").alias("df")).crossJoin(F.broadcast(n))
    scored = per.withColumn("raw", F.col("tf") * F.log((1 + F.col("n_docs")) / (1 + F.col("df"))))
    top = scored.orderBy(F.desc(F.round("raw", 6)), "word").limit(words)
    share = F.col("raw") / F.max("raw").over(Window.partitionBy())
    out = top.select("word", share.alias("weight")).where(F.col("weight") > least)
    return out.withColumn("category", F.when(F.col("weight") > 0.03, "core").when(F.col("weight") > 0.02, "common").otherwise("rest"))
