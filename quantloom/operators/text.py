"""Text operators: dictionary sentiment and parsing of structured model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import quoted, ratio

REPLY = T.StructType([T.StructField(c, T.IntegerType()) for c in ("sentiment", "confidence", "guidance", "tone")] + [T.StructField("capital_return_stance", T.StringType())])


def tokens(text: str) -> F.Column:
    """Lower-case words of a text: runs of ASCII letters."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda x: x != "")


def sentiment(docs: DataFrame, key: str, text: str, lexicon: dict[str, list[str]], positive: str, negative: str) -> DataFrame:
    """For each document the share (percent of words) of each category, net = positive - negative, and word_count; zeros
    for an empty text. The lexicon's words are literals of the plan: no join, no shuffle."""
    rows = docs.select(key, tokens(text).alias("w")).withColumn("word_count", F.size("w").cast("long"))

    def count(words: list[str]) -> F.Column:
        return F.size(F.filter("w", lambda x: x.isin(*words)))

    hits = {c: count(ws) for c, ws in lexicon.items()}
    out = rows.select(key, "word_count", *(F.coalesce(ratio(h * F.lit(100.0), F.col("word_count")), F.lit(0.0)).alias(c) for c, h in hits.items()))
    return out.withColumn("net", F.col(positive) - F.col(negative))


def parsed_reply(df: DataFrame, reply: str, schema: T.StructType = REPLY) -> DataFrame:
    """df with the fields of a JSON object in a model's reply; code fences around it are taken off. Null if malformed."""
    body = F.regexp_extract(F.coalesce(F.col(reply), F.lit("")), r"(?s)(\{.*\})", 1)
    return df.withColumn("__r", F.from_json(body, schema)).select(*(F.col(quoted(c)) for c in df.columns), "__r.*")


def truncated(df: DataFrame, text: str, limit: int = 30_000) -> DataFrame:
    """The text as it is put to a model: white space collapsed, at most `limit` characters."""
    return df.withColumn(text, F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit))


def stripped_suffix(symbol: str, suffix: str) -> F.Column:
    """A symbol without its market's suffix."""
    return F.replace(F.col(symbol), F.lit(suffix), F.lit(""))


def vendor_ticker(symbol: str) -> F.Column:
    """A symbol as the second vendor writes it: share classes after a dash, not a dot."""
    return F.translate(F.col(symbol), ".", "-")


def ordinary_ticker(symbol: str, suffix: str) -> F.Column:
    """True for symbols of two to four letters before the suffix."""
    return stripped_suffix(symbol, suffix).rlike("^[A-Za-z]{2,4}$")


def slug(text: str) -> F.Column:
    """Lower-case words joined by underscores, for names of files and columns."""
    return F.trim(F.regexp_replace(F.lower(F.col(text)), "[^a-z0-9]+", "_"), F.lit("_"))


def sentiment_by_table(docs: DataFrame, key: str, text: str, lexicon: DataFrame, categories: list[str], positive: str, negative: str) -> DataFrame:
    """As `sentiment`, with the lexicon a table (word, category) of any size: words are counted within a document first,
    then joined. Documents without a listed word have zeros."""
    rows = docs.select(key, tokens(text).alias("w")).withColumn("word_count", F.size("w").cast("long"))
    words = rows.select(key, F.explode("w").alias("word")).groupBy(key, "word").agg(F.count("*").alias("__k"))
    hits = words.join(lexicon.select("word", "category").distinct(), "word").groupBy(key)
    hits = hits.agg(*(F.sum(F.when(F.col("category") == c, F.col("__k"))).alias(c) for c in categories))
    out = rows.drop("w").join(hits, key, "left")
    share = {c: F.coalesce(ratio(F.col(c) * F.lit(100.0), F.col("word_count")), F.lit(0.0)) for c in categories}
    return out.withColumns(share).withColumn("net", F.col(positive) - F.col(negative)).select(key, "word_count", *categories, "net")
