"""Sentence windows, vector retrieval, merge, rerank and citation as DataFrames.

Lists have an order, so every table here carries it as a column: ord within a document, pos within a hit list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

WINDOW, TOP, KEPT, BATCH = 3, 15, 8, 5
#: Cosines that agree in so many digits are equal.
DIGITS = 10
#: The replies without evidence and after an error.
NOT_FOUND = "目前系統的參考文件中未包含此資訊。"
FAILED = "系統在檢索法規與常見問題時發生錯誤，請稍後再試。"


def sentence_list(text: Column) -> Column:
    """An array of sentences: text split after . ! ? and white space, after 。！？, and at line ends; null has none."""
    split = F.split(F.coalesce(text, F.lit("")), "(?<=[.!?])\\s+|(?<=[。！？])|\\n")
    return F.filter(F.transform(split, T.strip), lambda s: s != "")


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, sent of every sentence."""
    return docs.select(F.col(key), F.posexplode(sentence_list(F.col(text))).alias("ord", "sent"))


def once(array: Column, f: Callable[[Column], Column]) -> Column:
    """f(array), with the array made once however often f names it: Catalyst would put its expression into every place."""
    return F.get(F.transform(F.array(array), f), F.lit(0))


def _window(sents: Column, i: Column, size: int) -> Column:
    return F.array_join(F.slice(sents, F.greatest(i + (1 - size), F.lit(1)), F.least(i, F.lit(size)) + (size + 1)), " ")


def windows_of(sents: Column, size: int = WINDOW) -> Column:
    """For each sentence of an array itself and `size` neighbours on either side, joined by spaces."""
    return once(sents, lambda a: F.transform(a, lambda s, i: _window(a, i, size)))


def document_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """key, ord, sent, window of every sentence of docs. A document is one row, so nothing is shuffled."""
    return docs.select(F.col(key), F.explode(windows_with_sentences(F.col(text), size)).alias("__one")).select(key, "__one.ord", "__one.sent", "__one.window")


def windows_with_sentences(text: Column, size: int = WINDOW) -> Column:
    """An array of (ord, sent, window) of a text's sentences."""
    return once(sentence_list(text), lambda a: F.transform(a, lambda s, i: F.struct(i.alias("ord"), s.alias("sent"), _window(a, i, size).alias("window"))))


def windows_at(text: Column, places: Column, size: int = WINDOW) -> Column:
    """The same for the sentences at some places only, an array of ords."""
    return once(sentence_list(text), lambda a: F.transform(places, lambda i: F.struct(i.alias("ord"), F.get(a, i).alias("sent"), _window(a, i, size).alias("window"))))


def sentence_windows(sents: DataFrame, key: str = "doc_id", size: int = WINDOW) -> DataFrame:
    """The same for a table of sentences(key, ord, sent), whatever cut them: by a window over each document."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(-size, size)
    return sents.withColumn("window", F.concat_ws(" ", F.collect_list("sent").over(w)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers in double precision; null for a zero vector."""
    d = lambda x: x.cast("array<double>")
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(queries: DataFrame, nodes: DataFrame, k: int = TOP, block: int = 10_000, slice_: int = 20_000) -> DataFrame:
    """query_id, node_id, score, pos: the k nodes(node_id, embedding) nearest each of queries(query_id, embedding).

    Queries are dealt to blocks of about `block`, nodes to slices of about `slice_`, by hashes; each query goes to every
    slice and each node to every block, and a task scores one block against one slice in a matrix product and passes on
    the k best of each query. So neither side passes the driver, and the last shuffle has k rows of each slice. Ties go
    to the smaller node_id; null and zero vectors have no score and come last, if at all.
    """
    queries, nodes = (x.select(c, "embedding").where("embedding IS NOT NULL") for x, c in ((queries, "query_id"), (nodes, "node_id")))
    blocks, slices = (max(1, -(-x.count() // n)) for x, n in ((queries, block), (nodes, slice_)))
    kinds = queries.schema["query_id"].dataType.simpleString(), nodes.schema["node_id"].dataType.simpleString()
    dealt = lambda x, c, own, n, other, m: x.withColumns({own: F.pmod(F.xxhash64(c), F.lit(n)), other: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
    asked = dealt(queries, "query_id", "__block", blocks, "__slice", slices).groupBy("__block", "__slice")
    held = dealt(nodes, "node_id", "__slice", slices, "__block", blocks).groupBy("__block", "__slice")
    return best(asked.cogroup(held).applyInArrow(scorer(k), f"query_id {kinds[0]}, node_id {kinds[1]}, score double"), k)


def best(found: DataFrame, k: int) -> DataFrame:
    """found(query_id, node_id, score) with pos: the k best of each query, ties by node_id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return found.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k)


def unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1; a zero vector becomes a row of nan."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    m = flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


#: Queries that a task multiplies with a slice at once: 500 by 20,000 scores are 80 MB.
_AT_ONCE = 500


def scorer(k: int):
    """A function for a pair of groups: for each query the nodes that can be among its k best."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        queries, nodes, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(asked) and len(held):
            left, right = unit(asked["embedding"]), unit(held["embedding"])
            known, good = (np.flatnonzero(~np.isnan(m).any(axis=1)) for m in (left, right))  # zero vectors have no score
            left, right = left[known], right[good].T
            most = min(k, right.shape[1])
            for first in range(0, len(left) if most else 0, _AT_ONCE):
                found = left[first : first + _AT_ONCE] @ right
                least = np.partition(found, -most, axis=1)[:, -most]
                query, node = np.nonzero(found >= least[:, None] - 10.0 ** (1 - DIGITS))  # equal vectors must tie
                queries.append(known[query + first]), nodes.append(good[node]), scores.append(np.round(found[query, node], DIGITS))
        query, node, score = map(np.concatenate, (queries, nodes, scores))
        return pa.table({"query_id": asked["query_id"].take(pa.array(query)), "node_id": held["node_id"].take(pa.array(node)), "score": pa.array(score, pa.float64())})

    return run


def merge_hits(first: DataFrame, second: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The union of two hit lists (node_id, score, pos), for each key `by` if given: a node found twice keeps its first
    place and its last score."""
    place = lambda df, shift: df.select(*by, "node_id", "score", (F.col("pos") + F.lit(shift)).cast("long").alias("place"))
    both = place(first, 0).unionByName(place(second, 1 << 31))
    merged = both.groupBy(*by, "node_id").agg(F.min("place").alias("place"), F.max_by("score", "place").alias("score"))
    return merged.select(*by, "node_id", "score", F.row_number().over(Window.partitionBy(*by).orderBy("place")).alias("pos"))


def batches(hits: DataFrame, size: int = BATCH) -> DataFrame:
    """hits with batch: groups of `size` in the order of pos."""
    return hits.withColumn("batch", F.floor((F.col("pos") - 1) / size).cast("int"))


def token_overlap(query: Column, text: Column) -> Column:
    """The share of the query's words that the text has; the default reranker."""
    words = lambda x: F.array_distinct(F.filter(F.split(F.lower(x), "[^\\p{L}\\p{N}]+"), lambda w: w != ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(text))).cast("double"), F.size(words(query)).cast("double")), F.lit(0.0))


def rerank(hits: DataFrame, query: Column, text: Column, keep: int = KEPT, scorer: Callable[[Column, Column], Column] = token_overlap, by: tuple[str, ...] = ()) -> DataFrame:
    """The `keep` hits that the scorer likes best for the query as it was asked, for each key `by` if given; ties keep
    their order."""
    w = Window.partitionBy(*by).orderBy(F.desc("relevance"), "pos")
    return hits.withColumn("relevance", scorer(query, text)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def widen(nodes: DataFrame, metadata: str = "metadata", text: str = "text") -> DataFrame:
    """nodes whose text is replaced by the window in their metadata, where there is one."""
    return nodes.withColumn(text, F.coalesce(F.try_element_at(F.col(metadata), F.lit("window")), F.col(text)))


def ordered_sources(nodes: DataFrame, key: str, order: str = "rank", metadata: str = "metadata") -> DataFrame:
    """key, sources: the labels of a key's nodes in order, each once."""
    labelled = nodes.select(F.col(key), F.struct(order, T.source_label(F.col(metadata)).alias("label")).alias("__place"))
    first = labelled.groupBy(key, F.col("__place.label").alias("__label")).agg(F.min("__place").alias("__place"))  # before lists are gathered
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list("__place")), lambda x: x["label"]).alias("sources"))


def answer(nodes: DataFrame, key: str, order: str = "rank", text: str = "text", metadata: str = "metadata", writer: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, answer, sources: the writer's answer (by default the passages in order), or a fixed sentence without evidence."""
    passages = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    write = writer or (lambda p: F.array_join(p, "\n"))
    labels = F.transform(F.array_sort(F.collect_list(F.struct(order, T.source_label(F.col(metadata)).alias("label")))), lambda x: x["label"])
    held = nodes.groupBy(key).agg(F.filter(passages, lambda p: ~T.blank(p)).alias("p"), F.array_distinct(labels).alias("sources"))
    return held.select(key, F.when(F.size("p") > 0, write(F.col("p"))).otherwise(F.lit(NOT_FOUND)).alias("answer"), "sources")


def apologise(answers: DataFrame, error: str = "error") -> DataFrame:
    """answers(answer, sources, error) in which rows with an error have the fixed apology and no sources."""
    failed = F.col(error).isNotNull()
    return answers.withColumns({"answer": F.when(failed, FAILED).otherwise(F.col("answer")), "sources": F.when(failed, F.array().cast("array<string>")).otherwise(F.col("sources"))})


def prefer_latest(passages: DataFrame, topic: str, text: str = "text") -> DataFrame:
    """Of each topic the passage labelled with the latest year; passages without a year count as oldest."""
    year = F.regexp_extract(F.col(text), "(\\d{2,4})\\s*學年", 1)
    w = Window.partitionBy(topic).orderBy(F.desc_nulls_last(F.try_to_number(F.nullif(year, F.lit("")), F.lit("9999"))), text)
    return passages.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


#: Administrative details that no answer needs, and names of sources that hold frequent questions.
NOISE = ("獎金", "匯款帳號", "郵局存摺")
FAQ = ("FAQ", "常見問題")


def without_noise(passages: DataFrame, text: str = "text", words: tuple[str, ...] = NOISE) -> DataFrame:
    """passages whose text names none of the words; null texts stay."""
    said = F.coalesce(F.col(text), F.lit(""))
    return passages.where(~_any(said.contains(w) for w in words))


def without_superseded(passages: DataFrame, by: str, topic: Column, labels: Column) -> DataFrame:
    """passages without those of an earlier year than another one of the same key and topic has in its labels (its file's
    name and text, say); a passage without a year is the oldest. Topics where none has a year stay as they are."""
    year = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(labels, "(\\d{2,4})\\s*學年", 1), F.lit("")), F.lit("9999")), F.lit(-1))
    w = Window.partitionBy(by, "__topic")
    dated = passages.withColumns({"__topic": topic, "__year": year})
    return dated.withColumn("__latest", F.max("__year").over(w)).where("__year = __latest").drop("__topic", "__year", "__latest")


def nearest_level(passages: DataFrame, by: str, text: Column, levels: list[Column]) -> DataFrame:
    """passages without those that name a level above another one's: levels are the names of a question's department, its
    college and so on upwards, null where unknown. A passage that names none of them holds on every level and stays."""
    level = F.coalesce(*(F.when(text.contains(name), i) for i, name in enumerate(levels)))
    near = passages.withColumn("__level", level).withColumn("__nearest", F.min("__level").over(Window.partitionBy(by)))
    return near.where("__level IS NULL OR __level = __nearest").drop("__level", "__nearest")


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def paired(passages: DataFrame, by: str = "query_id", order: str = "rank", name: str = "file_name") -> DataFrame:
    """passages with basis and place: regulations are the basis and come first, frequent questions supplement them."""
    faq = _any(F.coalesce(F.col(name), F.lit("")).contains(w) for w in FAQ)
    w = Window.partitionBy(by).orderBy(F.desc("basis"), order)
    return passages.withColumn("basis", ~faq).withColumn("place", F.row_number().over(w))


def inherited(asked: DataFrame, rules: DataFrame, units: DataFrame, unit: str = "unit", everywhere: str = "*") -> DataFrame:
    """asked(unit, topic) with rule and source_unit: the unit's own rule, else that of the one above, else the general one.

    rules(unit, topic, rule) has one row for a unit and topic; units(unit, above) names what each unit belongs to.
    """
    of = lambda n: rules.select(F.col("unit").alias(f"__unit{n}"), F.col("topic").alias(f"__topic{n}"), F.col("rule").alias(f"__rule{n}"))
    out = asked.join(units.select(F.col("unit").alias("__of"), F.col("above").alias("__above")), F.col(unit) == F.col("__of"), "left")
    for n, level in enumerate((F.col(unit), F.col("__above"), F.lit(everywhere))):
        out = out.join(of(n), (level == F.col(f"__unit{n}")) & (F.col("topic") == F.col(f"__topic{n}")), "left")
    first = F.coalesce(*(F.when(F.col(f"__rule{n}").isNotNull(), F.struct(F.col(f"__rule{n}").alias("rule"), F.col(f"__unit{n}").alias("unit"))) for n in range(3)))
    return out.select(*asked.columns, first["rule"].alias("rule"), first["unit"].alias("source_unit"))
