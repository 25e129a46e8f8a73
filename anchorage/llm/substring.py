"""Exact substring deduplication by seed and extend.

Seeds are winnowed anchors: of every run of 50 words, the 20-word grams with
the least hash.  Equal runs choose equal anchors at equal places, so documents
that share a run meet in the join on anchors.  An occurrence is extended both
ways to all runs of the threshold length around its anchor.  Occurrences whose
whole surroundings are equal are extended once, for the smallest document that
has them; only surroundings that differ beside the same anchor are compared
run by run.  Runs that a smaller document has too are joined into maximal
repeats and cut.

No pairs are made: every comparison is with the smallest document of a group,
found by an aggregation that combines before the shuffle.  Words go only where
two independent 64-bit hashes of their surroundings or runs agree, so that
chance stays out of it at any number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from anchorage.llm.common import (
    U64, binary_values, discard, gram_hashes, hashed_words, list_column, map_batches, mix64, stash, utf8,
)

WINDOW = 50
GRAM = 20


def _slide(values: np.ndarray, width: int, take) -> np.ndarray:
    """``take`` (minimum or maximum) over every run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = take(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are least in some run of ``window`` words, all of them where grams tie."""
    if len(words) < window:
        return np.empty(0, np.int64), np.empty(0, U64)
    grams = gram_hashes(words, gram)
    width = window - gram + 1
    least = _slide(grams, width, np.minimum)
    edge = np.zeros(width - 1, U64)
    chosen = np.flatnonzero(_slide(np.concatenate((edge, least, edge)), width, np.maximum) == grams)
    return chosen, grams[chosen]


_reaches: dict[int, np.ndarray] = {}


def _coefficients(width: int) -> np.ndarray:
    """Two columns of odd numbers, from a fixed seed."""
    if width not in _reaches:
        _reaches[width] = np.random.default_rng(20240117).integers(1, 1 << 63, (width, 2), dtype=np.int64).astype(U64) * U64(2) + U64(1)
    return _reaches[width]


def surroundings(words: np.ndarray, positions: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of all words that share a run with the anchor at each position, and of where the text begins and ends.

    They are sums of the words' hashes, each times a number of its place, and mixed at the end.
    """
    reach, width = window - gram, 2 * window - gram
    padded = np.concatenate((np.zeros(reach, U64), words, np.zeros(window, U64)))
    place = np.maximum(reach - positions, 0) * width + np.maximum(positions + window - len(words), 0)
    sums = np.empty((len(positions), 2), U64)
    for at in range(0, len(positions), 4096):
        part = positions[at : at + 4096]
        around = padded[part[:, None] + np.arange(width)]
        sums[at : at + 4096] = np.einsum("ij,jk->ik", around, _coefficients(width))
    sums += place.astype(U64)[:, None] * U64(0x9E3779B97F4A7C15)
    return mix64(sums[:, 0].copy()), mix64(sums[:, 1].copy())


def _keyed(documents: DataFrame) -> DataFrame:
    """A key beside doc_id, as an id may come with several texts."""
    text = utf8("text")
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def seeds(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, places, anchor, around, check) with one element of the arrays for each anchor in equal surroundings.

    A text that repeats itself has such an anchor at many places, which travel together.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ends, places, grams, around, check = [], [], [], [], []
        for text in binary_values(batch.column(2)):
            words = hashed_words(text)
            at, found = anchors(words, window, gram)
            near, again = surroundings(words, at, window, gram)
            order = np.lexsort((at, again, near, found))
            at, found, near, again = at[order], found[order], near[order], again[order]
            differs = (found[1:] != found[:-1]) | (near[1:] != near[:-1]) | (again[1:] != again[:-1])
            new = np.flatnonzero(np.append(differs, True)) if len(at) else at
            ends.append(new + 1)
            places.append(at.astype(np.int32))
            grams.append(found[new].view(np.int64))
            around.append(near[new].view(np.int64))
            check.append(again[new].view(np.int64))
        before = np.cumsum([0, *map(len, places)])
        inner = np.concatenate(([0], *[e + b for e, b in zip(ends, before, strict=False)])).astype(np.int32)
        each = pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate(places)))
        outer = np.cumsum([0, *map(len, ends)]).astype(np.int32)
        arrays = [pa.ListArray.from_arrays(pa.array(outer), each), *(list_column(x, pa.int64()) for x in (grams, around, check))]
        return pa.record_batch([batch.column(0), batch.column(1), *arrays], names=["doc_id", "text_key", "places", "anchor", "around", "check"])

    schema = "doc_id long, text_key long, places array<array<int>>, anchor array<long>, around array<long>, check array<long>"
    return map_batches(_keyed(documents).filter("doc_id is not null"), run, schema).filter("size(places) > 0")


def _runs(contested: DataFrame, documents: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, text_key, starts, runs, checks): the extensions of contested occurrences, each run of a document once."""
    places = contested.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("places")).alias("places"))
    rows = places.hint("shuffle_hash").join(_keyed(documents), ["doc_id", "text_key"]).select("doc_id", "text_key", "places", "text")
    reach = np.arange(window - gram + 1)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        starts, runs, checks = [], [], []
        for at, text in zip(batch.column(2), binary_values(batch.column(3)), strict=True):
            words = hashed_words(text)
            hashes, again = gram_hashes(words, window), gram_hashes(words, window, 1)
            start = np.unique(at.values.to_numpy()[:, None].astype(np.int64) - reach)
            start = start[(start >= 0) & (start < len(hashes))]
            starts.append(start.astype(np.int32))
            runs.append(hashes[start].view(np.int64))
            checks.append(again[start].view(np.int64))
        arrays = [list_column(starts, pa.int32()), list_column(runs, pa.int64()), list_column(checks, pa.int64())]
        return pa.record_batch([batch.column(0), batch.column(1), *arrays], names=["doc_id", "text_key", "starts", "runs", "checks"])

    return map_batches(rows, run, "doc_id long, text_key long, starts array<int>, runs array<long>, checks array<long>")


def repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_key, whole, starts) for documents with repeats.

    ``whole`` lists anchors all of whose surroundings a smaller doc_id has;
    ``starts`` lists further runs of ``window`` words that one has.  Rows with
    a null id neither have repeats nor count as a source of them.
    """
    found = stash(seeds(documents, window, gram))
    hits = found.select("doc_id", "text_key", F.explode(F.arrays_zip("places", "anchor", "around", "check")).alias("x"))
    hits = hits.select("doc_id", "text_key", "x.places", "x.anchor", "x.around", "x.check")
    groups = (
        hits.groupBy("anchor")
        .agg(
            F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
            ((F.min("around") == F.max("around")) & (F.min("check") == F.max("check"))).alias("alike"),
        )
        .filter("first < last")
        .select("anchor", "first", "alike")
    )
    # Stored first, both sides of the join are plain shuffles, of which Spark splits what one frequent anchor makes large.
    groups = stash(groups)
    shared = hits.join(groups, "anchor").filter("not alike or first < doc_id")
    shared = stash(shared.select("doc_id", "text_key", "places", "alike", *[F.when(~F.col("alike"), F.col(c)).alias(c) for c in ("anchor", "around", "check")]))
    discard(found)
    discard(groups)
    differing = shared.filter("not alike")
    owners = stash(differing.groupBy("anchor", "around", "check").agg(F.min("doc_id").alias("owner")))
    judged = differing.join(owners, ["anchor", "around", "check"]).select("doc_id", "text_key", "places", (F.col("doc_id") == F.col("owner")).alias("own"))
    judged = stash(judged.unionByName(shared.filter("alike").select("doc_id", "text_key", "places", F.lit(False).alias("own"))))
    discard(shared)
    discard(owners)
    packed = stash(_runs(judged.filter("own"), documents, window, gram))
    runs = packed.select("doc_id", "text_key", F.explode(F.arrays_zip("starts", "runs", "checks")).alias("x"))
    runs = runs.select("doc_id", "text_key", F.col("x.starts").alias("start"), F.col("x.runs").alias("run"), F.col("x.checks").alias("check"))
    sources = runs.groupBy("run", "check").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).filter("source < last")
    sources = stash(sources.select("run", "check", "source"))
    extended = runs.join(sources, ["run", "check"]).filter("source < doc_id")
    nothing = F.lit(None).cast("int")
    both = judged.filter("not own").select("doc_id", "text_key", F.col("places").alias("whole"), nothing.alias("start")).unionByName(
        extended.select("doc_id", "text_key", F.lit(None).cast("array<int>").alias("whole"), "start")
    )
    spans = stash(both.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("whole")).alias("whole"), F.collect_list("start").alias("starts")))
    discard(judged)
    discard(packed)
    discard(sources)
    return spans


def _kept(text: memoryview, whole: np.ndarray, starts: np.ndarray, window: int, gram: int) -> tuple[int, int, bytes]:
    """Words, words removed, and the kept words joined by a space."""
    words = bytes(text).split()
    n = len(words)
    if not len(whole) and not len(starts):
        return n, 0, b" ".join(words)
    reach = window - gram
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, np.maximum(whole - reach, 0), 1)
    np.add.at(change, np.minimum(whole + window, n), -1)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    keep = np.cumsum(change)[:n] == 0
    return n, n - int(keep.sum()), b" ".join([words[k] for k in np.flatnonzero(keep)])


def _with_repeats(documents: DataFrame, carried: list[str], window: int, gram: int) -> DataFrame:
    spans = repeats(documents, window, gram)
    text = utf8("text")
    keyed = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"), *carried
    )
    return keyed.join(spans.hint("shuffle_hash"), ["doc_id", "text_key"], "left")


def _arrays(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[int, int, bytes]]:
    empty = np.empty(0, np.int64)
    for text, whole, starts in zip(binary_values(batch.column(0)), batch.column(1), batch.column(2), strict=True):
        at = whole.values.to_numpy().astype(np.int64) if whole.is_valid else empty
        run = starts.values.to_numpy().astype(np.int64) if starts.is_valid else empty
        yield _kept(text, at, run, window, gram)


def digests(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of ``documents`` (doc_id, text).

    Null, empty and short texts lose nothing; repeated rows have equal results;
    other columns are ignored; no rows give no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in _arrays(batch, window, gram)]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.record_batch([batch.column(3), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _with_repeats(documents, [], window, gram).select("text", "whole", "starts", "doc_id")
    return map_batches(rows, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``documents`` with repeats cut from ``text``: its kept words, joined by a space, where any word went, else as it was.

    Other columns stay as they are.
    """
    order = documents.columns
    names = {c: f"column{k}" for k, c in enumerate(order) if c not in ("doc_id", "text")}
    carried: list[Column] = [F.col(f"`{c}`").alias(n) for c, n in names.items()]
    rows = _with_repeats(documents, [F.col("text").isNull().alias("was_null"), *carried], window, gram)
    untouched = rows.filter("whole is null").withColumn("text", F.when(~F.col("was_null"), F.col("text").cast("string")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = pa.array([text.decode("utf-8") for _, _, text in _arrays(batch, window, gram)], pa.string())
        return pa.record_batch([kept, *batch.columns[3:]], names=["text", "doc_id", *names.values()])

    touched = rows.filter("whole is not null").select("text", "whole", "starts", "doc_id", *names.values())
    schema = StructType([StructField("text", StringType()), *touched.schema.fields[3:]])
    both = map_batches(touched, run, schema).unionByName(untouched.select("text", "doc_id", *names.values()))
    return both.select(*[F.col(names.get(c, c)).alias(c) for c in order])
