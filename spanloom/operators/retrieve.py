"""Similarity search and the concept graph.

Searches take a query table against a base table. A base is never broadcast; dense
search multiplies blocks of queries with blocks of the base and keeps the best k of
each block before anything is shuffled. Null or empty vectors and texts match nothing;
ties go to the lesser id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _best(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "base_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top(queries: DataFrame, base: DataFrame, k: int, pool: str | None = None, block: int = 4096) -> DataFrame:
    """``query_id, base_id, score, rank``: the k rows of the base of greatest cosine, within the query's ``pool``.

    Both sides come as ``id, embedding`` (and the pool column). Blocks of both meet once.
    """
    keep = [pool] if pool else []
    blocks = lambda df, side: (
        df.dropna(subset=["id", "embedding", *keep])
        .where(F.size("embedding") > 0)
        .select(*keep, F.col("id").alias("id"), "embedding")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.lit(1 << 30)))
    )
    q, b = blocks(queries, "q"), blocks(base, "b")
    # how many blocks a side has follows from its count, in a pool from that of the pool: other pools are never met
    parts = lambda df, n: df.groupBy(*keep).agg(F.ceil(F.count("*") / block).cast("int").alias(n))
    sides = parts(q, "nq").join(parts(b, "nb"), keep) if pool else parts(q, "nq").crossJoin(parts(b, "nb"))  # without a pool of one row each
    sides = sides.where("nq > 0 and nb > 0")
    q, b = (x.join(sides, keep) if pool else x.crossJoin(F.broadcast(sides)) for x in (q, b))
    q = q.withColumn("i", F.pmod("block", F.col("nq"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("side", F.lit("q"))
    b = b.withColumn("j", F.pmod("block", F.col("nb"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).withColumn("side", F.lit("b"))
    b = b.select(*q.columns)

    def unit(rows: pd.Series) -> np.ndarray:
        m = np.stack([np.asarray(r, np.float64) for r in rows])
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return m / np.where(n > 0, n, 1)

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == "q"], pdf[pdf["side"] == "b"].sort_values("id")
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "base_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        s = np.round(unit(x["embedding"]) @ unit(y["embedding"]).T, 6)
        ids = y["id"].to_numpy()
        top = np.argsort(-s, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(x["id"].to_numpy(), top.shape[1]), "base_id": ids[top].ravel(), "score": np.take_along_axis(s, top, 1).ravel()})

    met = q.unionByName(b).groupBy(*keep, "i", "j").applyInPandas(search, "query_id bigint, base_id bigint, score double")
    return _best(met, k, ["query_id"]).select("query_id", "base_id", "score", "rank")


def char_grams(df: DataFrame, text: str, low: int, high: int) -> DataFrame:
    """``id, gram, tf`` of a text's words, each with a blank at both ends."""
    each = F.filter(F.split(F.lower(text), "[ \t\r\n]+"), lambda w: w != "")
    w = df.dropna(subset=["id", text]).select("id", F.explode(F.transform(each, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))).alias("w"))

    def of(n: int):
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length("w") - n + 1, F.lit(1))), lambda i: F.substring(F.col("w"), i, F.lit(n)))

    grams = F.flatten(F.array(*(of(n) for n in range(low, high + 1))))
    return w.select("id", F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("tf"))


def tfidf(grams: DataFrame, idf: DataFrame) -> DataFrame:
    """Weights of unit length per id."""
    x = grams.join(idf, "gram").withColumn("w", F.col("tf") * F.col("idf"))
    norm = x.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return x.join(norm, "id").select("id", "gram", (F.col("w") / F.col("norm")).alias("w"))


def lexical_top(queries: DataFrame, base: DataFrame, k: int, low: int = 2, high: int = 5, block: int = 2048) -> DataFrame:
    """The k base texts of greatest cosine over character grams weighted by TF-IDF of the base. Both: ``id, text``.

    Blocks of both sides meet once, and only the best k of a block leave it: a gram that very many texts have makes no pairs to be shuffled.
    Texts without a common gram aren't near.
    """
    b = char_grams(base, "text", low, high)
    n = base.dropna(subset=["id", "text"]).select("id").distinct().agg(F.count("*").alias("n"))
    df = b.groupBy("gram").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(n)).select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    packed = lambda x: tfidf(x, idf).groupBy("id").agg(F.collect_list(F.struct("gram", "w")).alias("g")).select("id", F.transform("g", lambda v: F.xxhash64(v["gram"])).alias("grams"), F.transform("g", lambda v: v["w"]).alias("weights"))
    sides = [packed(char_grams(queries, "text", low, high)), packed(b)]
    # how many blocks a side has follows from its count
    nq, nb = (max(1, -(-x.select("id").dropna().distinct().count() // block)) for x in (queries, base))
    q = sides[0].withColumn("i", F.pmod(F.xxhash64("id"), F.lit(nq))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("side", F.lit("q"))
    d = sides[1].withColumn("j", F.pmod(F.xxhash64("id"), F.lit(nb))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("side", F.lit("b")).select(*q.columns)
    kind = sides[1].schema["id"].dataType.simpleString()

    def flat(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = rows["grams"].map(len).to_numpy()
        gram, weight = np.concatenate(rows["grams"].to_numpy()), np.concatenate(rows["weights"].to_numpy())
        at = np.repeat(np.arange(len(rows)), size)
        order = np.argsort(gram, kind="stable")
        return gram[order], at[order], weight[order]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == "q"], pdf[pdf["side"] == "b"].sort_values("id")
        names = {"query_id": x["id"].to_numpy(), "base_id": y["id"].to_numpy()}
        out = {"query_id": names["query_id"][:0], "base_id": names["base_id"][:0], "score": np.zeros(0)}
        if len(x) and len(y):
            score = np.zeros((len(x), len(y)))
            (g, r, v), (h, s, w) = flat(x), flat(y)
            both = np.intersect1d(g, h)
            ends = [np.searchsorted(z, both, side) for z in (g, h) for side in ("left", "right")]
            for a, b_, c, e in zip(*(z.tolist() for z in ends)):
                score[r[a:b_, None], s[None, c:e]] += v[a:b_, None] * w[None, c:e]
            score = np.round(score, 6)
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(score, top, 1).ravel()
            near = best > 0
            out = {"query_id": np.repeat(names["query_id"], top.shape[1])[near], "base_id": names["base_id"][top].ravel()[near], "score": best[near]}
        return pd.DataFrame(out)

    met = q.unionByName(d).groupBy("i", "j").applyInPandas(search, f"query_id {kind}, base_id {kind}, score double")
    return _best(met, k, ["query_id"]).select("query_id", "base_id", "score", "rank")


def prototypes(vectors: DataFrame, by: str) -> DataFrame:
    """Mean vector of each group, of unit length, one row a dimension: ``by, dim, value``."""
    d = vectors.dropna(subset=[by, "embedding"]).select(by, F.posexplode("embedding").alias("dim", "x"))
    m = d.groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    norm = F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy(by)))  # over as many rows as dimensions
    return m.select(by, "dim", F.round(F.when(norm > 0, F.col("m") / norm).otherwise(0.0), 6).alias("value"))


def textual_edges(nodes: DataFrame) -> DataFrame:
    """Edges from a finer code to the code of its first three characters, where that is listed."""
    n = nodes.where("identifier is not null").select("identifier", "ontology").distinct()
    child = n.where(F.length("identifier") > 3).withColumn("parent", F.substring("identifier", 1, 3))
    up = n.select(F.col("identifier").alias("parent"), "ontology")
    return child.join(up, ["parent", "ontology"]).select(F.col("identifier").alias("source"), F.col("parent").alias("target"), F.lit("child_of").alias("relation"))


def siblings(edges: DataFrame) -> DataFrame:
    """Per node with a parent, how many others have it; from counts, so that no pair is made."""
    n = edges.groupBy("target").agg(F.count("*").alias("n"))
    return edges.join(n, "target").select("source", F.col("target").alias("parent"), (F.col("n") - 1).alias("siblings"))


def neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, once."""
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(edges.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()


def neighbour_mean(edges: DataFrame, values: DataFrame) -> DataFrame:
    """Degree and mean value of the neighbours of each node; ``values``: ``id, value``."""
    j = neighbours(edges).join(values.withColumnRenamed("id", "b"), "b", "left")
    return j.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("degree"), F.round(F.avg("value"), 6).alias("neighbour_mean"))


def sibling_rows(edges: DataFrame) -> DataFrame:
    """Each node with each other node of its parent (``id, other``); as many rows as the lists have, so for fan-outs of a listed hierarchy."""
    a = edges.select(F.col("source").alias("id"), "target").distinct()
    return a.join(a.withColumnRenamed("id", "other"), "target").where("id <> other").select("id", "other").distinct()


def graph_union(*graphs: DataFrame, key: str = "identifier") -> tuple[DataFrame, DataFrame]:
    """Nodes of all graphs, of which each id must be in one only: the union of those, and the ids that more have (``key, graphs``), which are in no union."""
    every = graphs[0].withColumn("graph", F.lit(0))
    for i, g in enumerate(graphs[1:], 1):
        every = every.unionByName(g.withColumn("graph", F.lit(i)), allowMissingColumns=True)
    n = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("graph").alias("graphs"))
    twice = n.where("graphs > 1")
    return every.where(F.col(key).isNotNull()).join(twice, key, "left_anti"), twice


def graph_manifest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per part of the graph (nodes by ontology, edges by relation) its size and a digest that doesn't depend on order."""
    digest = lambda *c: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *c), 256), 1, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias("digest")
    n = nodes.where("identifier is not null").groupBy(F.concat(F.lit("node "), "ontology").alias("part")).agg(F.count("*").alias("n"), digest(F.col("identifier"), F.coalesce("canonical", F.lit(""))))
    e = edges.groupBy(F.concat(F.lit("edge "), "relation").alias("part")).agg(F.count("*").alias("n"), digest(F.col("source"), F.col("target")))
    return n.unionByName(e)


def hard_negatives(edges: DataFrame, least: int = 1) -> DataFrame:
    """Each node with others near it in the graph (``id, negative``): neighbours and siblings, each once; nodes with fewer than ``least`` are out."""
    near = neighbours(edges).select(F.col("a").alias("id"), F.col("b").alias("negative")).unionByName(sibling_rows(edges).withColumnRenamed("other", "negative"))
    near = near.where("id <> negative").distinct()
    if least < 2:
        return near
    enough = near.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return near.join(enough, "id", "left_semi")


def parent_hedge(spans: DataFrame, nodes: DataFrame, kind: str) -> DataFrame:
    """Each span with one candidate of a finer code also gets the listed parent: ``before`` and ``after`` arrays.

    ``eligible`` says whether it did; several candidates, other types and unlisted parents stay as they are.
    """
    listed = nodes.where(F.length("identifier") == 3).select(F.col("identifier").alias("parent")).distinct()
    s = spans.where("span_id is not null").select("span_id", "type", F.coalesce("candidates", F.array().cast("array<string>")).alias("before"))
    single = (F.size("before") == 1) & (F.col("type") == kind) & (F.length(F.get("before", F.lit(0))) > 3)
    s = s.withColumn("parent", F.when(single, F.substring(F.get("before", F.lit(0)), 1, 3)))
    j = s.join(listed.withColumn("known", F.lit(True)), "parent", "left").withColumn("eligible", F.coalesce("known", F.lit(False)))
    return j.select("span_id", "before", F.when(F.col("eligible"), F.concat("before", F.array("parent"))).otherwise(F.col("before")).alias("after"), "eligible")

