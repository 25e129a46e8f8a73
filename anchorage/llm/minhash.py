"""Near-duplicate detection with circulant MinHash.

Two permutations of the 32-bit integers give a whole signature: the first
shuffles the shingles once, and coordinate k is the least value of the second
one over the shuffled shingles circularly shifted by k.  Texts with equal
shingle sets are one class and go on as their smallest id.  Classes that agree
in a band of coordinates are candidates; each class is compared, on the full
shingle sets, within the group of every distinct smallest class among its
buckets, and only a spanning forest of each group's links is returned.

A group of one block is compared in one task.  Of a larger one, every class is
first compared with the group's smallest, block by block; those that link to it
are one component.  Only classes that do not are then compared with the whole
group, block by block, so a group of m near copies costs about m comparisons,
no group is ever held in one task, and no link between different texts is
lost.  Components of the forest are those of all links found.

A pair at the threshold misses all bands with a probability of (1 - t^r)^b,
below 10^-5 for the defaults at t = 0.85 and falling fast above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import (
    U64, binary_values, bounded_batches, discard, gram_hashes, hashed_words, list_column, map_batches, mix64, sequence_key, stash, utf8,
)
from anchorage.llm.graph import components

U32 = np.uint32


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 85
    bands: int = 20
    rows: int = 5
    block_documents: int = 256
    block_shingles: int = 2_000_000


def shingles(text: memoryview | bytes, words: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text; of the whole sequence where it is shorter; none without words."""
    found = hashed_words(text, lower=True)
    if not len(found):
        return found
    return np.unique(gram_hashes(found, min(words, len(found))))


def _permute(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers (in place)."""
    x ^= x >> U32(16)
    x *= U32(a)
    x ^= x >> U32(13)
    x *= U32(b)
    x ^= x >> U32(16)
    return x


def signature(found: np.ndarray, size: int) -> np.ndarray:
    """``size`` circulant MinHash coordinates of a non-empty set of 64-bit hashes."""
    shuffled = _permute((found ^ (found >> U64(32))).astype(U32), 0x7FEB352D, 0x846CA68B)
    shifts = np.arange(1, size + 1, dtype=U32)[:, None]
    least = np.full(size, 0xFFFFFFFF, U32)
    for at in range(0, len(shuffled), 1024):
        np.minimum(least, _permute(shuffled[at : at + 1024] + shifts, 0x85EBCA6B, 0xC2B2AE35).min(1), out=least)
    return least


def band_keys(coordinates: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band, different bands apart."""
    parts = coordinates.reshape(bands, -1).astype(U64)
    out = np.arange(1, bands + 1, dtype=U64)
    for k in range(parts.shape[1]):
        out = mix64(out * U64(0x9E3779B97F4A7C15) + parts[:, k])
    return out.view(np.int64)


def sketches(documents: DataFrame, params: Params) -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, text_key); set_id is null and bands are empty for a text without words."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, bands = [], [], []
        for text in binary_values(batch.column(1)):
            found = shingles(text, params.words)
            sizes.append(len(found))
            keys.append(sequence_key(found) if len(found) else None)
            coordinates = signature(found, params.bands * params.rows) if len(found) else None
            bands.append(np.empty(0, np.int64) if coordinates is None else band_keys(coordinates, params.bands))
        columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), list_column(bands, pa.int64())]
        return pa.record_batch([*columns, batch.column(2)], names=["doc_id", "n_shingles", "set_id", "bands", "text_key"])

    schema = "doc_id long, n_shingles long, set_id binary, bands array<long>, text_key long"
    text = utf8("text")
    return map_batches(documents.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text)), run, schema)


def linked(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None) -> np.ndarray:
    """Smallest index that each set reaches over links of at least ``percent`` similarity.

    With ``side``, only sets of different sides are compared.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(np.concatenate(sets), kind="stable")
    tokens, owner = np.concatenate(sets)[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    counts = np.diff(np.append(first, len(tokens)))
    common = np.zeros((m, m), np.float32)
    often = 8
    few = np.repeat((counts > 1) & (counts <= often), counts)
    run, who = np.repeat(np.arange(len(first)), counts)[few], owner[few]
    for lag in range(1, often):
        same = np.flatnonzero(run[lag:] == run[:-lag])
        if not len(same):
            break
        common += np.bincount(who[same] * m + who[same + lag], minlength=m * m).reshape(m, m)
    many = np.repeat(counts > often, counts)
    if many.any():
        who = owner[many]
        column = np.cumsum(np.concatenate(([0], tokens[many][1:] != tokens[many][:-1])))
        for low in range(0, int(column[-1]) + 1, 2048):
            a, b = np.searchsorted(column, (low, low + 2048))
            part = np.zeros((m, 2048), np.float32)
            part[who[a:b], column[a:b] - low] = 1
            common += np.triu(part @ part.T, 1)
    common += common.T
    union = sizes[:, None] + sizes[None, :] - common
    link = 100 * common.astype(np.float64) >= percent * union
    np.fill_diagonal(link, False)
    if side is not None:
        link &= side[:, None] != side[None, :]
    reach = np.arange(m)
    while True:
        best = np.minimum(reach, np.where(link, reach[None, :], m).min(1))
        best = np.minimum(best, best[best])
        if (best == reach).all():
            return reach
        reach = best


def _similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets link."""
    if min(len(one), len(other)) * 100 < percent * max(len(one), len(other)):
        return False
    at = np.minimum(np.searchsorted(one, other), len(one) - 1)
    common = int((one[at] == other).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def _compared(params: Params):
    """From rows (leader, i, j, side, id, text) sorted by the first four to rows (a, b, n, linked).

    Rows of one (leader, i, j) are a task.  Where i is -1, side 0 is the group's
    smallest class and every other row is compared with it: linked or not, it
    gives a row with its number of shingles.  Else all rows, or if there are two
    sides those of different sides, are compared; links of a spanning forest are given.
    """

    def forest(ids: list[int], sets: list[np.ndarray], sides: list[int]) -> Iterator[tuple[int, int, int, bool]]:
        order = sorted(range(len(ids)), key=ids.__getitem__)
        side = np.array([sides[k] for k in order])
        reach = linked([sets[k] for k in order], params.percent, side if side.min() != side.max() else None)
        for k in np.flatnonzero(reach != np.arange(len(reach))):
            yield ids[order[k]], ids[order[reach[k]]], len(sets[order[k]]), True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, sides, out = None, [], [], [], []

        def done() -> None:
            if len(ids) > 1 and key[1] >= 0:
                out.extend(forest(ids, sets, sides))

        for batch in batches:
            names = [batch.column(k).to_pylist() for k in range(5)]
            for *now, side, doc_id, text in zip(*names, binary_values(batch.column(5)), strict=True):
                if now != key:
                    done()
                    key, ids, sets, sides = now, [], [], []
                found = shingles(text, params.words)
                if len(found) and now[1] < 0 and side:
                    out.append((doc_id, now[0], len(found), any(_similar(head, found, params.percent) for head in sets)))
                elif len(found):
                    ids.append(doc_id)
                    sets.append(found)
                    sides.append(side)
            if len(out) > 10_000:
                yield _edge_batch(out)
                out = []
        done()
        yield _edge_batch(out)

    return run


def _edge_batch(rows: list[tuple[int, int, int, bool]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["a", "b", "n", "linked"])


def near_duplicates(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key) for every row of ``documents`` (doc_id, text).

    ``component_id`` is the smallest id reachable over links; ``kept`` says
    whether that is the row's own.  Null, empty and blank texts are linked with
    nothing.  Repeated rows share a component; where a doc_id comes with
    several texts, each row has its own text's component.  A null doc_id
    cannot name a component: such rows have none and are kept.  Other columns are ignored; no rows give no rows.
    """
    found = stash(sketches(documents, params))
    classes = stash(
        found.filter("set_id is not null and doc_id is not null")
        .groupBy("set_id")
        .agg(F.min(F.struct("doc_id", "n_shingles", "bands")).alias("least"))
        .select("set_id", F.col("least.doc_id").alias("rep"), F.col("least.n_shingles").alias("n"), F.col("least.bands").alias("bands"))
    )
    edges = _links(documents, classes, params)
    stars = components(edges)
    discard(edges)
    named = classes.join(stars, classes.rep == stars.id, "left").select("set_id", F.coalesce("component", "rep").alias("component_id"))
    out = found.drop("bands").join(named, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_key"
    )


def kept_documents(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """One document of each group, with all columns as they are.

    Of rows with one id and one text, the one whose columns are least stays.
    Null, empty and blank texts are groups of their own, as are rows without an
    id; no rows give no rows.
    """
    names = [f"column{k}" for k in range(len(documents.columns))]
    at = dict(zip(documents.columns, names, strict=True))
    kept = stash(near_duplicates(documents, params).filter("kept").select("doc_id", "text_key").distinct())
    keyed = documents.toDF(*names).withColumn("own_key", F.xxhash64(utf8(at["text"])))
    same = keyed[at["doc_id"]].cast("long").eqNullSafe(kept["doc_id"]) & (keyed["own_key"] == kept["text_key"])
    rows = keyed.join(kept, same, "left_semi")
    once = rows.groupBy(at["doc_id"], "own_key").agg(F.min(F.struct(*names)).alias("row"))
    return once.select(*[F.col(f"row.{n}").alias(c) for c, n in at.items()])


def _blocks(params: Params) -> Column:
    """How many blocks a group of m classes with a total of shingles has."""
    return F.greatest(F.ceil(F.col("m") / params.block_documents), F.ceil(F.col("total") / params.block_shingles)).cast("int")


def _links(documents: DataFrame, classes: DataFrame, params: Params) -> DataFrame:
    """Edges (a, b) between class representatives that span all links within candidate groups."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), utf8("text").alias("text")).filter("rep is not null")
    bounded_batches(spark)

    def compared(tasks: DataFrame) -> DataFrame:
        # Of one class, only the smallest id is here; a document with several texts appears once with each.
        rows = tasks.join(texts, "rep").select("leader", "i", "j", "side", "rep", "text")
        ordered = rows.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "side")
        return stash(ordered.mapInArrow(_compared(params), "a long, b long, n long, linked boolean"))

    keys = classes.select("rep", "n", F.explode("bands").alias("key"))
    # Written first, both sides of the next joins are plain shuffles, of which Spark splits what one key or group makes large.
    leaders = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last")
    leaders = stash(leaders.select("key", "leader"))
    pairs = stash(keys.join(leaders, "key").select("leader", "rep", "n").distinct())
    size = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    # Few groups need more than one block, so this side of the join is small and most rows find nothing in it.
    large = stash(size.select("leader", _blocks(params).alias("blocks")).filter("blocks > 1"))
    members = pairs.join(large, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    heads = large.select("leader", F.lit(-1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), F.col("leader").alias("rep"))
    own = members.filter("blocks = 1 or rep <> leader").select(
        "leader", F.when(F.col("blocks") > 1, -1).otherwise(0).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "rep"
    )
    first = compared(own.unionByName(heads).hint("shuffle_hash"))
    found = first.filter("linked")
    rest = stash(first.filter("not linked").select(F.col("b").alias("leader"), F.col("a").alias("rep"), "n").distinct())
    used = [leaders, pairs, large, first, rest]
    if not rest.isEmpty():
        over = rest.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
        over = stash(over.select("leader", _blocks(params).alias("parts")))
        left = rest.join(over, "leader").join(large, "leader").select(
            "leader", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int").alias("i"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), "rep",
        )
        right = members.join(over, "leader").select(
            "leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), "rep"
        )
        tasks = stash(left.unionByName(right))
        second = compared(tasks)
        found = found.unionByName(second)
        used += [over, tasks, second]
    edges = stash(found.select("a", "b").filter("a <> b").distinct())
    discard(*used)
    return edges
