"""News text: routing, sentiment aggregation, event detection, novelty and transcript sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.windows import td

#: Event classes and the words that show them, in order of precedence.
EVENTS = {
    "earnings": ("earnings", "revenue", "profit", "quarterly results"),
    "management": ("ceo", "cfo", "appointed", "resigned", "fired"),
    "merger": ("merger", "acquisition", "takeover", "buyout"),
    "product": ("launch", "release", "announce", "unveil"),
    "legal": ("lawsuit", "investigation", "settlement", "fine"),
    "guidance": ("guidance", "outlook", "forecast", "expects"),
}
#: Words that make a text moderately complex; cost per 1,000 tokens by priority.
DEMANDING = ("guidance", "outlook", "forecast", "risk")
RATES = {"speed": 0.0, "cost": 0.0, "accuracy": 0.015, "balanced": 0.005}


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \n\t\r]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words_of(text))


def lexicon_score(text: Column, good: tuple[str, ...], bad: tuple[str, ...]) -> Column:
    """(good - bad) / (good + bad) words, 0 without either."""
    w = words_of(text)
    g = F.size(F.filter(w, lambda x: x.isin(*good)))
    b = F.size(F.filter(w, lambda x: x.isin(*bad)))
    return F.when(g + b == 0, 0.0).otherwise(td((g - b).cast("double"), (g + b).cast("double")))


def complexity(text: Column, kind: Column) -> Column:
    """simple, moderate or complex by type, length and words."""
    n, low = n_words(text), F.lower(F.coalesce(text, F.lit("")))
    demanding = F.lit(False)
    for word in DEMANDING:
        demanding = demanding | low.contains(word)
    return F.when((kind == "social") | (n < 100), "simple").when((kind == "earnings") | (n > 1000), "complex").when(demanding, "moderate").otherwise("simple")


def model_for(priority: Column, level: Column, middle: bool = True, large: bool = True) -> Column:
    """Which model reads a text: small, middle or large; middle and large tell whether there are such."""
    mid, big = F.lit("middle" if middle else "small"), F.lit("large" if large else "small")
    saving = F.when(level == "complex", mid).otherwise("small")
    exact = F.when(level == "complex", big if large else F.lit("small")).when(level == "moderate", mid).otherwise("small")
    return F.when((priority == "speed") | (level == "simple"), "small").when(priority == "cost", saving).otherwise(exact)


def cost(articles: DataFrame, text: str, priority: str = "balanced") -> DataFrame:
    """The estimated cost of reading all texts: 1.3 tokens a word at the priority's rate."""
    return articles.agg((F.sum(n_words(F.col(text)) * F.lit(1.3)) / F.lit(1000.0) * F.lit(RATES.get(priority, RATES["balanced"]))).alias("estimated_cost"))


def event(text: Column, events: dict[str, tuple[str, ...]] = EVENTS) -> Column:
    """The first class one of whose words stands in the text, as a part of words too; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, keys in events.items():
        test = F.lit(False)
        for k in keys:
            test = test | low.contains(k)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def sentiment_signal(scored: DataFrame, *keys: str, half_life_hours: float = 12.0, full: int = 5, label_at: float = 0.3) -> DataFrame:
    """scored (keys, score, hours) to one signal per key: recency-weighted mean, confidence from agreement and number."""
    weight = 1 / (1 + F.col("hours") / half_life_hours)
    x = scored.withColumn("wt", weight)
    g = x.groupBy(*keys).agg(
        td(F.sum(F.col("score") * F.col("wt")), F.sum("wt")).alias("signal"), F.count("*").alias("n_articles"),
        F.count_if(F.col("score") > 0).alias("up"), F.count_if(F.col("score") < 0).alias("down"),
    )
    agree = td(F.greatest("up", "down").cast("double"), F.col("n_articles").cast("double"))
    return g.select(
        *keys, "signal", "n_articles", (agree * F.least(F.col("n_articles") / F.lit(float(full)), F.lit(1.0))).alias("confidence"),
        F.when(F.col("signal") > label_at, "bullish").when(F.col("signal") < -label_at, "bearish").otherwise("neutral").alias("label"),
    )


def headlines(scored: DataFrame, *keys: str, text: str = "headline", n: int = 3) -> DataFrame:
    """The n texts of the strongest scores per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("score")), text)
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select(*keys, "place", text, "score")


def tfidf(docs: DataFrame, id_col: str, text_col: str, features: int | None = None, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, term, weight): counts times ln((1 + n) / (1 + df)) + 1, of length one per document.

    features: only so many terms, those that occur most often (ties in the order of letters), which travel to the texts, so
    that no other term is counted per document.
    """
    n = docs.select(F.count("*").alias("n"))
    each = docs.select(id_col, F.explode(words_of(F.col(text_col))).alias("term"))
    if stop_words:
        each = each.where(~F.col("term").isin(*stop_words))
    if features is not None:
        top = each.groupBy("term").count().orderBy(F.desc("count"), "term").limit(features)
        each = each.join(F.broadcast(top.select("term")), "term", "left_semi")  # features rows at most
    tf = each.groupBy(id_col, "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    x = tf.join(F.broadcast(df) if features is not None else df, "term").join(F.broadcast(n), F.lit(True))
    x = x.withColumn("raw", F.col("tf") * (F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col)))
    return x.select(id_col, "term", (F.col("raw") / norm).alias("weight"))


def novelty(current: DataFrame, history: DataFrame, id_col: str, text_col: str, features: int | None = 1000, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """1 less the mean cosine of each current document with all historical ones; 0.5 without a history.

    The mean over a history is the product with its mean vector, so documents meet a vector of terms, not each other.
    """
    both = current.select(F.concat(F.lit("c"), F.col(id_col).cast("string")).alias("k"), text_col).unionByName(history.select(F.concat(F.lit("h"), F.col(id_col).cast("string")).alias("k"), text_col))
    v = tfidf(both, "k", text_col, features, stop_words)
    n = history.select(F.count("*").alias("n"))
    mean = v.where(F.col("k").startswith("h")).groupBy("term").agg(F.sum("weight").alias("m"))
    dot = v.where(F.col("k").startswith("c")).join(F.broadcast(mean) if features is not None else mean, "term", "left").groupBy("k").agg(F.sum(F.col("weight") * F.coalesce("m", F.lit(0.0))).alias("s"))
    out = dot.join(F.broadcast(n), F.lit(True)).select(F.substring("k", 2, 30).alias("k"), F.when(F.col("n") == 0, 0.5).otherwise(1 - td(F.col("s"), F.col("n").cast("double"))).alias("novelty"))
    return current.select(id_col).join(out, F.col(id_col).cast("string") == F.col("k"), "left").select(id_col, F.coalesce("novelty", F.lit(0.5)).alias("novelty"))


def sections(lines: DataFrame, *keys: str, order: str = "line_no", text: str = "line") -> DataFrame:
    """Lines of transcripts with their section: prepared_remarks, from the first heading of questions on q_and_a, or operator_notes.

    A heading (it holds question-and-answer or q&a) is no line of a section; a line with operator and a colon is the
    operator's.
    """
    raw = F.coalesce(text, F.lit(""))
    low = F.lower(raw)
    head = low.contains("question-and-answer") | low.contains("q&a")
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumn("_head", head).withColumn("_asked", F.max(head.cast("int")).over(w))
    name = F.when(low.contains("operator") & raw.contains(":"), "operator_notes").when(F.col("_asked") == 1, "q_and_a").otherwise("prepared_remarks")
    return x.where(~F.col("_head")).withColumn("section", name).drop("_head", "_asked")


def transcripts(lines: DataFrame, *keys: str, order: str = "line_no", text: str = "line") -> DataFrame:
    """(keys, section, lines): the lines of each section of a transcript, in order."""
    g = sections(lines, *keys, order=order, text=text).groupBy(*keys, "section").agg(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("line")))).alias("x"))
    return g.select(*keys, "section", F.transform("x", lambda x: x["line"]).alias("lines"))


def split_lines(raw: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, line_no, line) of whole transcripts."""
    return raw.select(*keys, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))


#: Cost of a request by source.
SOURCE_COSTS = {"alpaca_free": 0.0, "alpaca_paid": 0.00003, "polygon_basic": 0.0001, "polygon_advanced": 0.00005, "coingecko_free": 0.0, "coingecko_pro": 0.00001, "binance": 0.0}


def monthly_cost(usage: DataFrame) -> DataFrame:
    """The cost of usage (source, requests); sources without a price cost nothing."""
    known = F.create_map(*[F.lit(x) for pair in SOURCE_COSTS.items() for x in pair])
    return usage.agg(F.sum(F.col("requests") * F.coalesce(known[F.col("source")], F.lit(0.0))).alias("monthly_cost"))


def normalise_news(raw: DataFrame, vendor: str, column: str = "raw", symbol: str = "symbol") -> DataFrame:
    """Vendor articles as JSON to (id, symbol, headline, summary, content, source, published_at, url)."""
    if vendor == "benzinga":
        b = F.from_json(column, "id string, title string, teaser string, body string, created string, url string")
        x = raw.select(symbol, b.alias("b"))
        return x.select(
            F.col("b.id").alias("id"), F.col(symbol).alias("symbol"), F.col("b.title").alias("headline"), F.coalesce("b.teaser", F.lit("")).alias("summary"), F.coalesce("b.body", F.lit("")).alias("content"),
            F.lit("benzinga").alias("source"), F.to_timestamp("b.created").alias("published_at"), F.col("b.url").alias("url"),
        )
    if vendor == "polygon":
        b = F.from_json(column, "results array<struct<id string, title string, description string, article_url string, publisher struct<name string>, published_utc string>>")
        x = raw.select(symbol, F.explode(b["results"]).alias("b"))
        url = F.coalesce("b.article_url", F.lit(""))
        return x.select(
            F.col("b.id").alias("id"), F.col(symbol).alias("symbol"), F.col("b.title").alias("headline"), F.coalesce("b.description", F.lit("")).alias("summary"), url.alias("content"),
            F.coalesce("b.publisher.name", F.lit("unknown")).alias("source"), F.to_timestamp("b.published_utc").alias("published_at"), url.alias("url"),
        )
    raise ValueError(f"unknown vendor {vendor!r}")


def cheapest(sources: DataFrame, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("cost", "source")
    return sources.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
