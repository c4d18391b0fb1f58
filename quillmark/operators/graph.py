"""The bipartite relation graph: one edge table (crime, article, case_count), both directions from the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import own_folder

# Articles that a crime may cite (five numbers around each), and article numbers that do not exist.
SUFFIX = "罪"
ALLOWED = {
    "盗窃": [264, 269, 270, 271],
    "抢劫": [263, 267, 269],
    "诈骗": [266],
    "故意伤害": [234, 235],
    "故意杀人": [232, 233],
    "交通肇事": [133],
    "危险驾驶": [133],
    "受贿": [383, 385, 386, 388],
    "贪污": [382, 383, 384],
    "行贿": [389, 390, 391, 392],
    "寻衅滋事": [293],
    "聚众斗殴": [292],
    "非法经营": [225],
    "合同诈骗": [224],
}
ABSENT = [500, 485, 499, 425, 410]
LAST_ARTICLE, GENERAL, AROUND = 451, 20, 5


#: Rows of names near each other that travel with the tasks.
NEAR_ROWS = 500


def normal_crime(name: Column) -> Column:
    """A crime as cases name it: trimmed, without enclosing brackets and the suffix; null if under two characters."""
    inner = F.regexp_replace(F.trim(name), r"(?s)^\[(.*)\]$", "$1")
    plain = F.trim(F.replace(inner, F.lit(SUFFIX), F.lit("")))
    return F.when(F.length(plain) >= 2, plain)


def plain_crime(name: Column) -> Column:
    """A crime as the graph names it: trimmed and without the suffix; null if under two characters."""
    plain = F.replace(F.trim(name), F.lit(SUFFIX), F.lit(""))
    return F.when(F.length(plain) >= 2, plain)


def article_number(text: Column) -> Column:
    """The first run of digits."""
    return F.nullif(F.regexp_extract(text, "([0-9]+)", 1), F.lit(""))


def rules(spark: SparkSession) -> DataFrame:
    """(crime, low, high): articles that a crime with a rule may cite."""
    rows = [(c, max(1, n - AROUND), min(LAST_ARTICLE, n + AROUND)) for c, numbers in ALLOWED.items() for n in numbers]
    return spark.createDataFrame(rows, "crime string, low int, high int")


def valid_relations(pairs: DataFrame) -> DataFrame:
    """Pairs (crime, article int) that can be: numbers in range, none of the general part, rules kept."""
    article = F.col("article")
    possible = pairs.where(article.between(GENERAL + 1, LAST_ARTICLE) & ~article.isin(ABSENT))
    ruled = F.broadcast(rules(pairs.sparkSession).groupBy("crime").agg(F.collect_list(F.struct("low", "high")).alias("_spans")))  # a fixed list
    joined = possible.join(ruled, "crime", "left")
    inside = F.exists("_spans", lambda s: article.between(s["low"], s["high"]))
    return joined.where(F.col("_spans").isNull() | inside).drop("_spans")


def co_occurrences(cases: DataFrame) -> DataFrame:
    """(crime, article, case_count) of cases with arrays `crimes` and `articles`; every pair of a case counts."""
    pairs = cases.select(F.explode("crimes").alias("crime"), "articles").select("crime", F.explode("articles").alias("article"))
    return pairs.groupBy("crime", "article").agg(F.count("*").alias("case_count"))


def extract_relations(cases: DataFrame) -> DataFrame:
    """Edges of raw cases (accusations array<string>, relevant_articles array<int>)."""
    names = F.filter(F.transform("accusations", normal_crime), lambda x: x.isNotNull())
    pairs = cases.select(F.explode(names).alias("crime"), "relevant_articles").select("crime", F.explode("relevant_articles").alias("article"))
    return valid_relations(pairs).groupBy("crime", "article").agg(F.count("*").alias("case_count"))


def totals(edges: DataFrame) -> DataFrame:
    """Numbers of crimes, articles, relations and cases; averages are cases by distinct key."""
    return edges.agg(
        F.countDistinct("crime").alias("crimes"),
        F.countDistinct("article").alias("articles"),
        F.count("*").alias("relations"),
        F.sum("case_count").alias("occurrences"),
    ).select("*", (F.col("occurrences") / F.col("crimes")).alias("avg_per_crime"), (F.col("occurrences") / F.col("articles")).alias("avg_per_article"))


def degrees(edges: DataFrame, key: str) -> DataFrame:
    """(key, degree, cases): neighbours and occurrences of each crime or article."""
    return edges.groupBy(key).agg(F.count("*").alias("degree"), F.sum("case_count").alias("cases"))


def degree_stats(edges: DataFrame) -> DataFrame:
    """Mean and largest degree on both sides, in one row."""
    side = lambda key, name: degrees(edges, key).agg(F.avg("degree").alias(f"avg_{name}_degree"), F.max("degree").alias(f"max_{name}_degree"))
    return side("crime", "crime").crossJoin(side("article", "article"))  # two single rows


def top_nodes(edges: DataFrame, key: str, k: int, by: str = "degree") -> DataFrame:
    """The k nodes with the most neighbours (or cases)."""
    return degrees(edges, key).orderBy(F.desc(by), F.asc(key)).limit(k)


def quality(edges: DataFrame, general: int = GENERAL, crowded: int = 20) -> DataFrame:
    """Occurrences of general articles, the articles' range, mean articles per crime, and crimes with very many."""
    per_crime = edges.groupBy("crime").agg(F.count("*").alias("n"))
    side = per_crime.agg(F.avg("n").alias("avg_articles"), F.count_if(F.col("n") > crowded).alias("crowded_crimes"))
    own = edges.agg(F.coalesce(F.sum(F.when(F.col("article") <= general, F.col("case_count"))), F.lit(0)).alias("general_occurrences"), F.min("article").alias("min_article"), F.max("article").alias("max_article"))
    return own.crossJoin(side)  # two single rows


def crimes_list(edges: DataFrame) -> DataFrame:
    """Every crime with its cases and sorted articles."""
    return edges.groupBy("crime").agg(F.sum("case_count").alias("cases"), F.array_sort(F.collect_list("article")).alias("articles"))


def articles_list(edges: DataFrame) -> DataFrame:
    """Every article with its cases and sorted crimes; `place` orders by number, others last."""
    out = edges.groupBy("article").agg(F.sum("case_count").alias("cases"), F.array_sort(F.collect_list("crime")).alias("crimes"))
    return out.withColumn("place", F.coalesce(F.expr("try_cast(article AS int)"), F.lit(9999)))


def adjacency(edges: DataFrame, key: str, other: str) -> DataFrame:
    """(key, map of neighbours to counts): the form the graph is exported in."""
    return edges.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(other).cast("string"), "case_count")))).alias("neighbours"))


def _related(edges: DataFrame, key: str, other: str, k: int) -> DataFrame:
    mine = Window.partitionBy(key)
    cut = Window.partitionBy(key).orderBy(F.desc("case_count"), F.asc(other))
    own = edges.withColumn("total", F.sum("case_count").over(mine)).withColumn("place", F.row_number().over(cut))
    return own.where(F.col("place") <= k).withColumn("raw", F.col("case_count") / F.col("total"))


def boost_articles(total: Column, raw: Column) -> Column:
    """Confidence of a crime's article, raised for crimes with few cases."""
    return F.when(total <= 3, F.least(raw * 3, F.lit(0.95))).when(total <= 10, F.least(raw * 2, F.lit(0.85))).when(total <= 20, F.least(raw * 1.5, F.lit(0.75))).otherwise(raw)


def boost_crimes(n: Column, raw: Column) -> Column:
    """Confidence of an article's crime, raised for rare edges."""
    return F.when(n == 1, F.least(raw * 2.5, F.lit(0.75))).when(n <= 3, F.least(raw * 2, F.lit(0.70))).when(n <= 10, F.least(raw * 1.5, F.lit(0.65))).otherwise(raw)


def related_articles(edges: DataFrame, k: int = 10) -> DataFrame:
    """Each crime's articles: cut to k by count first, then filtered by confidence; rare crimes are marked."""
    n, total, raw = F.col("case_count"), F.col("total"), F.col("raw")
    enough = F.when(total <= 5, n >= 1).when(total <= 20, raw >= 0.02).otherwise((raw >= 0.05) & (n >= 2))
    return _related(edges, "crime", "article", k).where(enough).select("crime", "article", "case_count", "total", "place", boost_articles(total, raw).alias("confidence"), (total <= 5).alias("rare"))


def related_crimes(edges: DataFrame, k: int = 10) -> DataFrame:
    """Each article's crimes: cut to k by count first, then filtered by confidence."""
    n, raw = F.col("case_count"), F.col("raw")
    enough = F.when(n <= 3, True).when(n <= 10, raw >= 0.01).otherwise(raw >= 0.025)
    return _related(edges, "article", "crime", k).where(enough).select("article", "crime", "case_count", "total", "place", boost_crimes(n, raw).alias("confidence"))


def confidence_level(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.3, "mid").when(c >= 0.1, "low").otherwise("very_low")


def relation_details(edges: DataFrame) -> DataFrame:
    """Each edge with its share of the crime's cases, raised by the edge's own count."""
    total = F.sum("case_count").over(Window.partitionBy("crime"))
    raw = F.col("case_count") / total
    return edges.withColumn("confidence", boost_articles(F.col("case_count"), raw)).withColumn("level", confidence_level(F.col("confidence")))


def star(related: DataFrame, centre: str, node: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a star around each centre, at most `most` nodes each."""
    near = related.where(F.col("place") <= most)
    nodes = near.select(F.col(centre).cast("string").alias("centre"), F.col(node).cast("string").alias("node"), F.lit(node).alias("kind"))
    nodes = nodes.unionByName(near.select(F.col(centre).cast("string").alias("centre"), F.col(centre).cast("string").alias("node"), F.lit(centre).alias("kind")).distinct())
    return nodes, near.select(F.col(centre).cast("string").alias("source"), F.col(node).cast("string").alias("target"), F.col("case_count").alias("weight"), "confidence")


def related_of(entities: DataFrame, articles: DataFrame, crimes: DataFrame, k: int = 3) -> DataFrame:
    """(qid, kind, word, confidence): the k first articles of each crime and crimes of each article in entities (qid, crime,
    article); a word that several lead to counts once, with its largest confidence.
    """
    to_articles = entities.where("crime IS NOT NULL").select("qid", "crime").join(articles.where(F.col("place") <= k), "crime").select("qid", F.lit("article").alias("kind"), F.col("article").cast("string").alias("word"), "confidence")
    to_crimes = entities.where("article IS NOT NULL").select("qid", "article").join(crimes.where(F.col("place") <= k), "article").select("qid", F.lit("crime").alias("kind"), F.col("crime").alias("word"), "confidence")
    return to_articles.unionByName(to_crimes).groupBy("qid", "kind", "word").agg(F.max("confidence").alias("confidence"))


def expand(entities: DataFrame, articles: DataFrame, crimes: DataFrame, k: int = 3, used: int = 2) -> DataFrame:
    """(qid, keywords, relations, mean_confidence): what the entities (qid, crime, article) of queries lead to."""
    near = lambda related: related.where(F.col("place") <= min(k, used))
    to_articles = entities.where("crime IS NOT NULL").select("qid", "crime").join(near(articles), "crime").select("qid", F.col("article").cast("string").alias("word"), "confidence")
    to_crimes = entities.where("article IS NOT NULL").select("qid", "article").join(near(crimes), "article").select("qid", F.col("crime").alias("word"), "confidence")
    return to_articles.unionByName(to_crimes).groupBy("qid").agg(F.array_sort(F.collect_set("word")).alias("keywords"), F.count("*").alias("relations"), F.avg("confidence").alias("mean_confidence"))


def path_articles(related: DataFrame, contents: DataFrame, k: int = 5) -> DataFrame:
    """(qid, id, article, content, score, place): the graph path's results, up to k related articles of a query with their
    contents (article, content); `related` is that of `related_of`.
    """
    own = Window.partitionBy("qid").orderBy(F.round("confidence", 9).desc(), "word")
    top = related.where("kind = 'article'").withColumn("place", F.row_number().over(own)).where(F.col("place") <= k)
    named = top.join(contents.select(F.col("article").cast("string").alias("word"), "content"), "word", "left")
    return named.select("qid", F.concat(F.lit("article_"), "word").alias("id"), F.col("word").alias("article"), F.coalesce("content", F.lit("")).alias("content"), F.col("confidence").alias("score"), "place")


def expansion_quality(entities: Column, relations: Column, confidence: Column) -> Column:
    """0.3 per entity, 0.2 per relation and half of the mean confidence, 1 at most."""
    return F.least(0.3 * entities + 0.2 * relations + 0.5 * F.coalesce(confidence, F.lit(0.0)), F.lit(1.0))


def explain(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """A line of reasons for each crime found in a query, strongest first."""
    near = entities.where("crime IS NOT NULL").select("qid", "crime").join(articles, "crime")
    line = F.concat(F.col("crime"), F.lit(" -> "), F.col("article").cast("string"), F.lit(" ("), confidence_level(F.col("confidence")), F.lit(")"))
    return near.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), line.alias("line")))), lambda x: x["line"]).alias("steps"))


#: The steps of an explanation, how a search goes on from them, and what it is meant to bring.
STEPS = ("检测到罪名'%s'，将扩展搜索相关法条: %s", "检测到法条'%s'，将扩展搜索相关罪名: %s", "查询中未检测到明确的法律实体，将使用标准搜索")
STRATEGIES = ("crime_to_article_expansion", "article_to_crime_expansion", "standard_search")
ENHANCEMENTS = ["提高搜索结果的完整性", "发现隐藏的相关内容", "提供更全面的法律参考"]


def reasoning(asked: DataFrame, entities: DataFrame, articles: DataFrame, crimes: DataFrame) -> DataFrame:
    """(qid, steps, strategies, enhancements) of every query (qid): a step for each crime and then each article found in it that leads
    anywhere, with where it leads; the plain search without any.
    """
    led = lambda related, key, shown: related.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("x")))), lambda s: s["x"]), ", ").alias("leads"))
    by_crime = led(articles, "crime", F.concat(F.lit("第"), F.col("article").cast("string"), F.lit("条")))
    by_article = led(crimes, "article", F.concat("crime", F.lit(SUFFIX)))
    step = lambda part, key, at: [F.col("qid"), F.struct(F.lit(part).alias("part"), at.alias("at"), F.format_string(STEPS[part], F.col(key).cast("string"), "leads").alias("step"))]
    first = entities.where("crime IS NOT NULL").select("qid", "crime").distinct().join(by_crime, "crime").select(*step(0, "crime", F.col("crime")))
    second = entities.where("article IS NOT NULL").select("qid", "article").distinct().join(by_article, "article").select(*step(1, "article", F.lpad(F.col("article").cast("string"), 12, "0")))
    every = first.toDF("qid", "s").unionByName(second.toDF("qid", "s")).groupBy("qid").agg(F.array_sort(F.collect_list("s")).alias("s"))
    own = asked.select("qid").join(every, "qid", "left")
    some = F.col("s").isNotNull()
    strategies = F.transform("s", lambda x: F.element_at(F.array(*map(F.lit, STRATEGIES)), x["part"] + 1))
    return own.select(
        "qid",
        F.when(some, F.transform("s", lambda x: x["step"])).otherwise(F.array(F.lit(STEPS[2]))).alias("steps"),
        F.when(some, strategies).otherwise(F.array(F.lit(STRATEGIES[2]))).alias("strategies"),
        F.when(some, F.array(*map(F.lit, ENHANCEMENTS))).otherwise(F.array().cast("array<string>")).alias("enhancements"),
    )


def fingerprint(edges: DataFrame) -> DataFrame:
    """One number that changes with the graph's totals, stable across runs."""
    return totals(edges).select(F.xxhash64("crimes", "articles", "occurrences").alias("fingerprint"))


def cases_of_relation(cases: DataFrame, crime: str, article: int, limit: int) -> DataFrame:
    """Cases with an accusation that contains the crime (or the other way round) and that cite the article."""
    near = F.exists("accusations", lambda a: a.contains(crime) | F.lit(crime).contains(a))
    return cases.where(near & F.array_contains("relevant_articles", article)).orderBy("case_id").limit(limit)


def cases_of_relations(cases: DataFrame, pairs: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """(crime, article, case_id, place): for each of `pairs` (crime, article) the first cases that cite the article and accuse of the crime
    or of a name `near` it (crime, accusation).  Cases are (case_id, accusations, relevant_articles).

    Few names, counted, are looked up inside of the cases, since a join by name would bring a frequent name's cases to one task; more
    names are joined as equal values.
    """
    spark, path = cases.sparkSession, own_folder(cases.sparkSession, "near")
    near = near.select("crime", "accusation").where("accusation IS NOT NULL").distinct()
    near.write.parquet(path)
    near = spark.read.schema(near.schema).parquet(path)
    if near.count() <= NEAR_ROWS:
        names = near.groupBy("accusation").agg(F.array_sort(F.collect_list("crime")).alias("crimes")).collect()
        known = F.create_map(*[x for r in names for x in (F.lit(r.accusation), F.array(*map(F.lit, r.crimes)))]).cast("map<string,array<string>>")
        led = F.filter(F.transform("accusations", lambda a: F.try_element_at(known, a)), lambda x: x.isNotNull())
        each = cases.select("case_id", "relevant_articles", F.explode(F.array_distinct(F.flatten(led))).alias("crime"))
    else:
        each = cases.select("case_id", "relevant_articles", F.explode("accusations").alias("accusation")).join(near, "accusation").select("case_id", "relevant_articles", "crime").distinct()
    each = each.select("case_id", "crime", F.explode("relevant_articles").alias("article"))
    found = each.join(pairs.select("crime", "article").distinct(), ["crime", "article"], "left_semi").select("crime", "article", "case_id").distinct()
    place = F.row_number().over(Window.partitionBy("crime", "article").orderBy("case_id"))
    return found.withColumn("place", place).where(F.col("place") <= limit)


def article_summary(cases: DataFrame, typical: int = 3) -> DataFrame:
    """Per article: cases, crimes, least, largest and mean months, typical cases."""
    each = cases.select("case_id", "crimes", "months", F.explode("articles").alias("article"))
    per = each.groupBy("article").agg(F.count("*").alias("cases"), F.min("months").alias("min_months"), F.max("months").alias("max_months"), F.avg("months").alias("avg_months"))
    first = each.withColumn("n", F.row_number().over(Window.partitionBy("article").orderBy("case_id"))).where(F.col("n") <= typical).groupBy("article").agg(F.array_sort(F.collect_list("case_id")).alias("typical"))
    return per.join(first, "article")


def crime_summary(cases: DataFrame) -> DataFrame:
    """Per crime: cases, cited articles, mean months, and cases of up to one, three, ten and more years."""
    each = cases.select("case_id", "articles", "months", F.explode("crimes").alias("crime"))
    cited = each.select("crime", F.explode("articles").alias("article")).groupBy("crime").agg(F.countDistinct("article").alias("articles"))
    m = F.col("months")
    per = each.groupBy("crime").agg(F.count("*").alias("cases"), F.avg(m).alias("avg_months"), F.count_if(m <= 12).alias("to_1y"), F.count_if((m > 12) & (m <= 36)).alias("to_3y"), F.count_if((m > 36) & (m <= 120)).alias("to_10y"), F.count_if(m > 120).alias("over_10y"))
    return per.join(cited, "crime", "left")


def typical_cases(cases: DataFrame, most: int = 3) -> DataFrame:
    """(crime, typical): the first cases of each crime."""
    each = cases.select("case_id", F.explode("crimes").alias("crime")).withColumn("n", F.row_number().over(Window.partitionBy("crime").orderBy("case_id")))
    return each.where(F.col("n") <= most).groupBy("crime").agg(F.array_sort(F.collect_list("case_id")).alias("typical"))
