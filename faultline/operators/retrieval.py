"""Lexical and vector search over chunks(chunk_id, file, symbol, source, start_line, ..)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import ids, text
from ..sources.shared import written


@dataclass(frozen=True)
class SearchOptions:
    top_k: int = 25
    min_score: float = 0.35
    mode: str = "auto"


def chunks(raw: DataFrame) -> DataFrame:
    """Functions and methods of syntax rows as chunks."""
    c = raw.filter("rec = 'chunk'")
    return c.select(ids.short_id("chunk_", F.col("file"), F.col("name"), F.col("line"), sep=":").alias("chunk_id"), "file", F.col("name").alias("symbol"), F.col("text").alias("source"), F.col("line").alias("start_line"), "end_line", F.col("col").alias("start_col"), "end_col")


def postings(docs: DataFrame, key: str, body: Column) -> DataFrame:
    """key, token, tf and length of each document."""
    t = docs.select(key, text.tokens(body).alias("tokens")).withColumn("length", F.size("tokens"))
    return t.select(key, "length", F.explode("tokens").alias("token")).groupBy(key, "length", "token").agg(F.count("*").alias("tf"))


def idf_table(p: DataFrame, n: Column | int) -> DataFrame:
    """token and idf: ln(N - n + 0.5) - ln(n + 0.5), and for negative ones epsilon times the mean over the vocabulary."""
    df = p.groupBy("token").agg(F.count("*").alias("df"))
    plain = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = plain.agg(F.avg("raw").alias("mean"))
    return plain.join(F.broadcast(mean)).select("token", F.when(F.col("raw") < 0, schemas.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def bm25(docs: DataFrame, key: str, body: Column, query: str) -> DataFrame:
    """key and score of every document; query tokens count as often as they stand. No rows for a query without tokens.

    Documents are tokenized once, into a written table of postings. Lengths and the vocabulary's mean are over all documents; only the
    postings of query tokens are joined with their idf.
    """
    wanted = docs.sparkSession.range(1).select(F.explode(text.tokens(F.lit(query))).alias("token")).groupBy("token").agg(F.count("*").alias("times"))
    p = written(postings(docs, key, body), "postings")
    n = docs.count()
    avgdl = (p.agg(F.sum("tf")).first()[0] or 0) / n if n else 0
    idf = idf_table(p, n)
    k1, b = schemas.BM25_K1, schemas.BM25_B
    norm = F.col("tf") + k1 * (1 - b + b * F.col("length") / (avgdl or 1.0))
    hit = p.join(F.broadcast(wanted), "token").join(idf, "token").select(key, (F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / norm).alias("s"))
    scored = hit.groupBy(key).agg(F.sum("s").alias("score"))
    return docs.select(key).join(scored, key, "left").join(F.broadcast(wanted.limit(1)), how="left_semi").select(key, F.coalesce("score", F.lit(0.0)).alias("score"))


def normalised(scores: DataFrame) -> DataFrame:
    """score over the greatest score; 0 where that is not positive."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.join(F.broadcast(top)).withColumn("score", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(0.0)).drop("top")


def cosine(vectors: DataFrame, key: str, vector: str, query: list[float]) -> DataFrame:
    """key and cosine similarity with the query."""
    q = F.array(*(F.lit(float(x)) for x in query))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col(vector), F.col(vector))) * F.lit(sum(float(x) ** 2 for x in query) ** 0.5)
    return vectors.select(key, F.when(size > 0, dot(F.col(vector), q) / size).otherwise(0.0).alias("score"))


def best_per_key(df: DataFrame, keys: list[str], score: str, *ties: str) -> DataFrame:
    """The best row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *ties)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def neighbours(found: DataFrame, corpus: DataFrame, method: str, options: SearchOptions) -> DataFrame:
    """Rows of chunk_id and score as neighbours: filtered, one for each (file, symbol), in order, at most top_k."""
    n = found.filter(F.col("score") >= options.min_score).join(corpus, "chunk_id", "left")
    n = n.withColumn("score", F.bround(F.least("score", F.lit(1.0)), 6))
    n = best_per_key(n, ["file", "symbol"], "score", "start_line").orderBy(F.desc("score"), "file", "start_line").limit(options.top_k)
    return n.select(
        ids.short_id("nb_", F.col("file"), F.col("symbol"), F.col("start_line"), sep="|").alias("neighbor_id"), "file", "symbol", "start_line", "end_line", "score", F.lit(method).alias("method"),
        text.snippet(F.col("source"), schemas.SNIPPET_NEIGHBOR).alias("rationale_snippet"), F.lit(True).alias("uncorroborated"),
    )


def search(corpus: DataFrame, query: str, options: SearchOptions = SearchOptions(), vectors: DataFrame | None = None, embed=None) -> dict[str, DataFrame]:
    """neighbours, stats and diagnostics. vectors(chunk_id, embedding) and embed(text) stand for a provider of embeddings; ``auto`` takes them if both are there, else tokens."""
    spark = corpus.sparkSession
    able = vectors is not None and embed is not None
    by_vector = able and options.mode != "bm25"
    if by_vector:
        met = cosine(vectors.join(corpus.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", "embedding", embed(query))
        found = neighbours(met, corpus, "embedding", options)
    elif options.mode == "embedding":
        found = neighbours(corpus.select("chunk_id", F.lit(0.0).alias("score")).limit(0), corpus, "embedding", options)
    else:
        found = neighbours(normalised(bm25(corpus, "chunk_id", F.col("source"), query)), corpus, "bm25", options)
    total = corpus.agg(F.count("*").alias("chunks_total"), F.countDistinct("file").alias("indexed_files"))
    say = lambda df, severity, code, message: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))
    notes = say(total.filter("chunks_total = 0"), "warning", "semantic_index_empty", F.lit("No Python functions found within the specified scope."))
    kept = found.agg(F.count("*").alias("kept"))
    notes = notes.unionAll(say(total.join(kept).filter("chunks_total > 0 and kept = 0"), "info", "threshold_filtered_all", F.format_string(f"All %d candidate chunks scored below the min_score threshold ({options.min_score}).", "chunks_total")))
    if options.mode == "embedding" and not able:
        notes = notes.unionAll(spark.createDataFrame([("warning", "embedding_provider_unavailable", "No embedding provider is configured.")], notes.schema))
    stats = total.withColumns({"retrieval_mode": F.lit("embedding_primary" if by_vector else "bm25_fallback"), "backend": F.lit("vectors" if by_vector else "bm25"), "chunks_scanned": F.col("chunks_total")})
    return {"neighbors": found, "stats": stats, "diagnostics": notes}
