"""SimHash fingerprints and near duplicates by multi-index hashing.

Equal fingerprints are one node. A node is filed under the value of each of its segments. To look for nodes within
DISTANCE bits, a node enumerates a small Hamming ball within each of its segments and fetches what is filed there; two
fingerprints within the distance are close in at least one segment, so nothing is missed. Complete distances are then
verified.

A drawer in which very many fingerprints are filed would compare all pairs of a large group. Such drawers are left out
of the fetch. The nodes that look into them are linked instead through the points half way: two fingerprints are within
DISTANCE bits exactly when some point lies within half of it of both, so every node of such a drawer names all points of
its ball, and those that name the same point are hung on the smallest of them. That gives the same components without
pairs.

Null and empty texts have fingerprint 0 and link like any other. Repeated rows get equal results; rows of one id with
different texts each have their own. A component of null ids only has a null component_id. Very long texts are read
whole, by one task each. A bit that is set in just half of a text's hashes is 0. An empty table gives an empty result. Extra columns are dropped by digest() and kept by keep_one().
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, discard, materialize, sliced, text_bytes
from .graph import components

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Segments by the number of different fingerprints: 3 of about 21 bits up to this many, else 2 of 32 bits.
THREE_SEGMENTS_UP_TO = 1 << 25
#: A drawer with more fingerprints than this is resolved through half-way points.
FULL_DRAWER = 48


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of one text's word shingles."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    if n <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: n - shingle]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :])]
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[k : k + (1 << 16)], "<u8")
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, also: Column | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row of docs(doc_id, text), and th, a long, if asked for."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = [] if also is None else [also.cast("long").alias("th")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole):
                fps = np.array([fingerprint(t) for t in text_bytes(batch.column("text"))], np.uint64).view(np.int64)
                carried = batch.columns[2:]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps), *carried], ["doc_id", "fp", "th"][: 2 + len(carried)])

    return docs.select("doc_id", "text", *more).mapInArrow(run, f"doc_id {kind}, fp bigint" + (", th bigint" if more else ""))


def segments(count: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of `count` segments that cover 64 bits."""
    widths = [64 // count + (i < 64 % count) for i in range(count)]
    return list(zip([0, *accumulate(widths)], widths))


def radii(count: int, distance: int = DISTANCE) -> list[int]:
    """How far to look in each segment: if every segment differed by more, the whole would differ by over `distance`."""
    each, more = divmod(distance, count)
    return [each if i <= more else each - 1 for i in range(count)]


def ball(width: int, radius: int, low: int = 0) -> list[int]:
    """Masks with at most `radius` of `width` bits set, as signed longs."""
    masks = [sum(1 << (low + b) for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _filed(fp: Column, low: int, width: int, number: int) -> Column:
    """The drawer of a fingerprint's segment: its value, with the segment's number above it."""
    value = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
    return value.bitwiseOR(F.lit(number << 40))


def _explode_masks(masks: list[int], of: Column) -> Column:
    listed = F.expr("array(" + ",".join(f"{m}L" if m != -(1 << 63) else "(-9223372036854775807L - 1L)" for m in masks) + ")")
    return F.explode(F.transform(listed, lambda m: m.bitwiseXOR(of)))


def links(nodes: DataFrame, distance: int = DISTANCE, full: int = FULL_DRAWER, written: list | None = None) -> DataFrame:
    """Edges (a, b) that connect every two of nodes(fp), all different, within `distance` bits, directly or by others.

    Tables that were written for it are added to `written`.
    """
    written = [] if written is None else written
    count = 3 if nodes.count() <= THREE_SEGMENTS_UP_TO else 2
    filed = looked = None
    for k, ((low, width), radius) in enumerate(zip(segments(count), radii(count, distance))):
        drawer = _filed(F.col("fp"), low, width, k)
        here = nodes.select(drawer.alias("drawer"), F.col("fp").alias("b"))
        if radius >= 0:
            probe = nodes.select(F.col("fp").alias("a"), _explode_masks(ball(width, radius), drawer).alias("drawer"))
            filed, looked = (here, probe) if filed is None else (filed.union(here), looked.union(probe))
    crowded = materialize(filed.groupBy("drawer").count().where(F.col("count") > full).select("drawer"))
    written.append(crowded)
    sparse = filed.join(crowded, "drawer", "left_anti")
    # Catalyst takes an exploded table for as small as what it was made of, and would broadcast it: hence the hints.
    pairs = looked.join(sparse.hint("merge"), "drawer").where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if crowded.isEmpty():
        return pairs
    dense = materialize(looked.join(crowded, "drawer", "left_semi").select("a").distinct())
    written.append(dense)
    near, far = distance // 2, distance - distance // 2
    points = dense.select(F.col("a"), _explode_masks(ball(64, far), F.col("a")).alias("point"))
    if near != far:  # an odd distance: one end is nearer to the point
        raise ValueError("the distance must be even")
    met = points.groupBy("point").agg(F.min("a").alias("b"), F.max("a").alias("other")).where("b <> other").select("point", "b")
    stars = points.join(met.hint("merge"), "point").where("a <> b").select("a", "b")
    return pairs.union(stars)


def rooted(marked: DataFrame) -> DataFrame:
    """fp, root for every fingerprint of marked(fp), as a written table: the smallest fingerprint of the component."""
    nodes, written = materialize(marked.select("fp").distinct()), []
    found = components(links(nodes, written=written))
    out = materialize(nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")))
    for table in (nodes, found, *written):
        discard(table)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of docs(doc_id, text)."""
    marked = materialize(fingerprints(docs))
    roots = rooted(marked)
    least = materialize(roots.join(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp"))
    discard(roots)
    of_fp = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: one row of each component stays.

    It is the row with the smallest doc_id (null comes last); of several such rows the one with the smallest hash of its
    text, then of its other columns. Rows without an id, and rows that share one, are told apart by their texts.
    """
    own = docs.columns
    held = docs.select("*", F.xxhash64("text").alias("__kept_text"), F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in own)))).alias("__kept_row"))
    marked = materialize(fingerprints(docs.select("doc_id", "text"), F.xxhash64("text")))
    # The place of a row in its component; a null id sorts behind all others.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    roots = rooted(marked)
    of_fp = roots.join(marked.groupBy("fp").agg(F.min(place).alias("least")), "fp")
    chosen = of_fp.groupBy("root").agg(F.min("least").alias("p")).select(F.col("p.doc_id").alias("__chosen_id"), F.col("p.th").alias("__chosen_text")).distinct()
    chosen = materialize(chosen)
    discard(roots)
    kept = held.join(chosen, held["doc_id"].eqNullSafe(F.col("__chosen_id")) & (F.col("__kept_text") == F.col("__chosen_text")), "left_semi")
    repeated = marked.groupBy("doc_id", "th").count().where("count > 1")
    if repeated.isEmpty():
        return kept.select(*(F.col(f"`{c}`") for c in own))
    first = Window.partitionBy("doc_id", "__kept_text").orderBy("__kept_row")
    return kept.withColumn("__kept_place", F.row_number().over(first)).where("__kept_place = 1").select(*(F.col(f"`{c}`") for c in own))
