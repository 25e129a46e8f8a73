"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs are gathered from the whole training part and
quantised on a logarithmic scale.  A pair of level q is put into a Bloom filter
as the q events (pair, 1) ... (pair, q); its level is read back by probing for
one event after the other until one is missing.  All bits of an event lie in
one 64-bit word, so a probe is one look.  The filter is split into segments by
hash, so it is built where the counts are and each segment is written once.  Its
size is chosen from the number of events and never exceeds ``max_bits``, as it
is broadcast; if all events do not fit, the rarest levels of words and pairs
stay out.  What a text then does not find in the filter is joined to the exact
counts of these levels, so scores do not depend on what fits.  Pairs seen once
are never in the filter.  In a text that has been counted, a pair that is not
found has been seen once; those of other texts are joined, too.

The score interpolates the pair's share of its history with a word model whose
unseen words share the mass of words seen once among as many words as are
estimated to exist unseen.  Pairs are counted from the
lower end of their level and histories from the upper end, so probabilities do
not add up to more than 1 but for false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import (
    U64, binary_values, bounded_batches, byte_array, discard, map_batches, mix64, stash, utf8, word_bounds, word_hashes,
)

_END = U64(0x5DEECE66D1234568)
_SEGMENT_BITS = 20
_ONE, _TWO = 0, 1  # the lowest bit of a key: words and pairs


@dataclass(frozen=True)
class Params:
    #: Ratio of neighbouring levels.
    base: float = 1.5
    #: Bits that an event sets, bits of the filter for each event, and the most bits altogether (56 MiB).
    probes: int = 5
    bits_per_event: int = 11
    max_bits: int = 448 << 20
    #: Weight of pairs against words.
    pair_weight: float = 0.3
    #: Words whose exact counts are broadcast for the base score; all others are joined.
    head_words: int = 1 << 18
    #: Parts in which what the filter leaves open is joined to counts.
    rounds: int = 4
    #: Keys a worker gathers before it sums them.
    gather: int = 2_000_000


def _keys(text_batch: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys, pair keys and text number of every token of some texts, each text closed by an end token."""
    words, pairs, owner = [], [], []
    for k, text in enumerate(binary_values(text_batch)):
        data = byte_array(text, lower=True)
        own = np.append(word_hashes(data, *word_bounds(data)), _END)
        words.append(own)
        pairs.append(np.concatenate((own[-1:], own[:-1])))
        owner.append(np.full(len(own), k, np.int32))
    one, before = np.concatenate(words), np.concatenate(pairs)
    two = mix64(before * U64(0x9DDFEA08EB382D69) + one)
    return one & ~U64(1), two | U64(1), np.concatenate(owner)


def counts(documents: DataFrame, params: Params) -> DataFrame:
    """(key, n, asked): how often each word and each pair occurs in rows of (text as UTF-8, held_out) that are not held out.

    ``asked`` tells whether a row that is held out has the pair.  Pairs that only such rows have are listed with 0.
    """

    def run(batches):
        held, marked, size = [], [], 0

        def summed() -> Iterator[pa.RecordBatch]:
            if held:
                keys, n = np.unique(np.concatenate(held), return_counts=True)
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])
            if marked:
                keys = np.unique(np.concatenate(marked))
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.zeros(len(keys), np.int64))], names=["key", "n"])

        for batch in batches:
            if batch.num_rows:
                one, two, owner = _keys(batch.column(0))
                out = batch.column(1).to_numpy(zero_copy_only=False)[owner]
                held += [one[~out], two[~out]]
                marked.append(two[out])
                size += len(one) + len(two)
                if size >= params.gather:
                    yield from summed()
                    held, marked, size = [], [], 0
        yield from summed()

    found = documents.select("text", "held_out").mapInArrow(run, "key long, n long")
    return found.groupBy("key").agg(F.sum("n").alias("n"), (F.min("n") == 0).alias("asked"))


class LogBloom:
    """Levels of 64-bit keys.  ``skip`` is how many of the lowest levels, for words and for pairs, were left out."""

    def __init__(self, segments: np.ndarray, skip: tuple[int, int], probes: int, base: float) -> None:
        self.segments = segments  # one row of 64-bit words a segment
        self.skip, self.probes, self.base = skip, probes, base

    @staticmethod
    def places(keys: np.ndarray, level: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
        """Word of a segment that an event is in, and the bits that it sets there."""
        salted = mix64(keys * U64(0xD6E8FEB86659FD93) + U64(level * 0x1F123BB5))
        bits = U64(1) << (salted & U64(63))
        for k in range(1, probes):
            bits |= U64(1) << (salted >> U64(6 * k) & U64(63))
        return (salted >> U64(64 - _SEGMENT_BITS + 6)).astype(np.int64), bits

    @staticmethod
    def segment(keys: np.ndarray, n_segments: int) -> np.ndarray:
        return ((keys >> U64(32)) * U64(n_segments) >> U64(32)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Level of every key; 0 for those that were never put in."""
        flat = self.segments.reshape(-1)
        out = np.zeros(len(keys), np.int64)
        at, own, level = np.arange(len(keys)), keys, 1
        start = self.segment(keys, len(self.segments)) << (_SEGMENT_BITS - 6)
        while len(own):
            word, bits = self.places(own, level, self.probes)
            there = flat[start + word] & bits == bits
            at, own, start = at[there], own[there], start[there]
            out[at] = level
            level += 1
        seen = out > 0
        pair = (keys & U64(1)).astype(bool)
        out[seen & ~pair] += self.skip[_ONE]
        out[seen & pair] += self.skip[_TWO]
        return out

    def level_of(self, n: np.ndarray) -> np.ndarray:
        """Level of a count, 0 for 0."""
        return np.where(n > 0, np.floor(np.log(np.maximum(n, 1)) / np.log(self.base) + 1e-9) + 1, 0).astype(np.int64)

    def least(self, levels: np.ndarray) -> np.ndarray:
        """The smallest count of a level, 0 for level 0."""
        return np.where(levels > 0, np.ceil(self.base ** (levels - 1.0) - 1e-9), 0)

    def most(self, levels: np.ndarray) -> np.ndarray:
        """The largest count of a level, 0 for level 0."""
        return np.where(levels > 0, np.ceil(self.base ** (levels + 0.0) - 1e-9) - 1, 0)


def _level(params: Params):
    return (F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(params.base)) + 1e-9) + 1).cast("int")


def build(found: DataFrame, params: Params) -> tuple[LogBloom, dict]:
    """The filter of counts (key, n), and what its words' levels hold.

    The driver gets one row for each level and the filter's segments, at most ``max_bits``.
    """
    leveled = found.select("key", "n", (F.col("key").bitwiseAND(F.lit(1))).cast("int").alias("kind"), _level(params).alias("level"))
    by_level = leveled.groupBy("kind", "level").agg(F.count(F.lit(1)), F.sum("n")).collect()
    sizes = {(r[0], r[1]): (r[2], r[3]) for r in by_level}
    top = max((k[1] for k in sizes), default=0)

    def events(skip: tuple[int, int]) -> int:
        return sum(n * (lv - skip[kind]) for (kind, lv), (n, _) in sizes.items() if lv > skip[kind])

    # Pairs seen once need no filter; from there on, what does not fit is left to a join level by level.
    skip = next(s for s in ((t, t + 1) for t in range(top + 1)) if events(s) * params.bits_per_event <= params.max_bits or s[0] == top)
    n_segments = max(1, -(-events(skip) * params.bits_per_event >> _SEGMENT_BITS))
    segment = F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * n_segments, 32).cast("int")
    put = F.col("level") - F.when(F.col("kind") == _ONE, F.lit(skip[_ONE])).otherwise(F.lit(skip[_TWO]))
    rows = leveled.select("key", segment.alias("segment"), put.alias("put")).filter("put > 0").repartition("segment")
    probes = params.probes

    def fill(batches):
        filters: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy().view(U64)
            where, put = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for s in np.unique(where):
                bits = filters.setdefault(int(s), np.zeros(1 << _SEGMENT_BITS >> 6, U64))
                here = where == s
                own, left, at = keys[here], put[here], 1
                while len(own):
                    np.bitwise_or.at(bits, *LogBloom.places(own, at, probes))
                    own, left = own[left > at], left[left > at]
                    at += 1
        for s, bits in filters.items():
            yield pa.record_batch([pa.array([s], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])

    segments = np.zeros((n_segments, 1 << _SEGMENT_BITS >> 6), U64)
    written = stash(rows.mapInArrow(fill, "segment int, bits binary"))
    built = written.toArrow()
    discard(written)
    for s, bits in zip(built["segment"].to_pylist(), built["bits"], strict=True):
        segments[s] = np.frombuffer(bits.as_buffer(), U64)
    words = {lv: held for (kind, lv), held in sizes.items() if kind == _ONE}
    return LogBloom(segments, skip, params.probes, params.base), words


def word_probabilities(levels: dict, bloom: LogBloom) -> tuple[np.ndarray, float]:
    """Probability of a word of each level, and the number of words of level 0.  Altogether they have the mass 1.

    Unseen words together have the mass of words seen once (Good-Turing).  Their number is Chao's estimate from the words
    seen once and twice, and at least that of words seen once, so that none is likelier than a word seen once.
    """
    total = sum(n for _, n in levels.values())
    once, twice = (levels.get(int(bloom.level_of(np.array(n))), (0, 0))[0] for n in (1, 2))
    mass = max(once, 0.1) / (total + max(once, 0.1))
    types = max(once * (once - 1) / (2 * (twice + 1)), once, 1.0)
    word = np.full(max(levels, default=0) + 2, mass / types)
    for lv in range(1, len(word)):
        c, n = levels.get(lv, (0, 0))
        word[lv] = (1 - mass) * (n / c if c else float(bloom.least(np.array(lv)))) / max(total, 1)
    return word, types


@dataclass(frozen=True)
class Scorer:
    """What workers get: the filter, log-probabilities by word level and exact counts of head words."""

    bloom: LogBloom
    word: np.ndarray  # probability by level; level 0: unseen
    head_keys: np.ndarray
    head_counts: np.ndarray
    log_total: float  # log10 of the base model's denominator
    pair_weight: float

    def logs(self, pair: np.ndarray, word: np.ndarray, history: np.ndarray) -> np.ndarray:
        """Log-probability of tokens by the levels of their pair, of themselves and of the word before."""
        p = self.word[np.minimum(word, len(self.word) - 1)]
        most = self.bloom.most(history)
        share = np.minimum(1, self.bloom.least(pair) / np.maximum(most, 1))
        return np.log10(np.where(most > 0, self.pair_weight * share + (1 - self.pair_weight) * p, p))

    def score(self, texts: pa.Array, held_out: np.ndarray) -> tuple:
        """For each text: tokens, known head tokens, base score of head tokens, score of settled tokens; and what is open.

        Other words come with their texts.  Of tokens that the filter leaves open there are the texts and three places each,
        for pair, word and history: a level, or -1 - k for the k-th key that the text asks for; and the keys with their texts.
        """
        one, two, owner = _keys(texts)
        n = len(texts)
        distinct, index = np.unique(one, return_inverse=True)
        level = self.bloom.levels(distinct)
        at = np.minimum(np.searchsorted(self.head_keys, distinct), max(len(self.head_keys) - 1, 0))
        head = self.head_keys[at] == distinct if len(self.head_keys) else np.zeros(len(distinct), bool)
        counted = self.head_counts[at] if len(self.head_keys) else np.zeros(len(distinct), np.int64)
        level[head] = self.bloom.level_of(counted[head])
        asked = (level == 0) & ~head & (self.bloom.skip[_ONE] > 0)
        before = np.concatenate((index[:1], index[:-1]))
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        before[first] = index[np.append(first[1:], len(one)) - 1]
        pair = self.bloom.levels(two)
        # A pair has been seen only if both of its words have.
        possible = ((level > 0) | asked)[index] & ((level > 0) | asked)[before]
        counted_once = (pair == 0) & ~held_out[owner] & (self.bloom.skip[_TWO] == 1)
        pair[counted_once] = 1
        ask_pair = (pair == 0) & possible
        is_open = ask_pair | asked[index] | asked[before]
        settled = np.flatnonzero(~is_open)
        score = np.bincount(owner[settled], self.logs(pair[settled], level[index[settled]], level[before[settled]]), n).astype(np.float64)
        left = np.flatnonzero(is_open)
        places = np.stack((pair[left], level[index[left]], level[before[left]]), axis=1)
        ask = np.stack((ask_pair[left], asked[index[left]], asked[before[left]]), axis=1)
        keys = np.stack((two[left], one[left], distinct[before[left]]), axis=1)[ask]
        texts_of = np.repeat(owner[left], ask.sum(axis=1))
        order = np.lexsort((keys, texts_of))
        keys, texts_of = keys[order], texts_of[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (texts_of[1:] != texts_of[:-1])
        ask_keys, ask_texts = keys[new], texts_of[new]
        number = np.empty(len(keys), np.int64)
        number[order] = np.cumsum(new) - 1 - np.searchsorted(ask_texts, texts_of)
        places[ask] = -1 - number
        logs = np.where(head, np.log10(counted + 0.1) - self.log_total, 0.0)
        base = np.bincount(owner, logs[index], n)
        known = np.bincount(owner, head[index], n).astype(np.int64)
        rest = np.flatnonzero(~head[index])
        return np.bincount(owner, minlength=n), known, base, score, (owner[rest], one[rest]), (owner[left], places), (ask_texts, ask_keys)

    def answered(self, places: np.ndarray, held_out: bool, numbers: np.ndarray, found_levels: np.ndarray) -> float:
        """Score of the open tokens of a text, whose asked keys ``numbers`` have been found with levels.

        Of a text that is not held out, every pair has been counted, and those not found once.
        """
        levels = np.zeros(max(-int(places.min(initial=0)), 1), np.int64)
        levels[numbers] = found_levels
        found = np.where(places < 0, levels[np.maximum(-1 - places, 0)], places)
        pair = found[:, 0] if held_out else np.maximum(found[:, 0], 1)
        return float(self.logs(pair, found[:, 1], found[:, 2]).sum())


def _lists(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """A list column of ``n`` rows from the values and their rows, in order."""
    sizes = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(values, kind))


def _log10(column):
    return F.log10(column.cast("double"))


def scores(documents: DataFrame, params: Params = Params()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents`` (doc_id, text).

    Rows whose crc32 of the id's digits is divisible by 10 are held out; a null
    id counts as empty digits and is held out too.  A null text is empty and
    has one token, its end.  Repeated rows count and are scored as often as
    they come.  Without training rows every token is unseen.
    """
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    rows = documents.select("doc_id", held_out.alias("held_out"), utf8("text").alias("text"))
    spark = documents.sparkSession
    bounded_batches(spark)
    # A pair seen once needs room only if a text held out has it: the text that it was counted in knows its count.
    kept = stash(counts(rows, params).filter("n > 0 and (key % 2 = 0 or n > 1 or asked)").select("key", "n"))
    words = kept.filter("key % 2 = 0")
    bloom, levels = build(kept, params)

    total, distinct = sum(n for _, n in levels.values()), sum(c for c, _ in levels.values())
    word, _ = word_probabilities(levels, bloom)
    at_least, size = 0, 0
    for lv in sorted(levels, reverse=True):
        size += levels[lv][0]
        if size > params.head_words:
            break
        at_least = float(bloom.least(np.array(lv)))
    head = words.filter(F.col("n") >= at_least) if at_least else words.limit(0)
    head_rows = head.toArrow()
    keys, n = head_rows.column("key").to_numpy().view(U64), head_rows.column("n").to_numpy()
    order = np.argsort(keys)
    log_total = float(np.log10(total + 0.1 * (distinct + 1)))
    shared = spark.sparkContext.broadcast(Scorer(bloom, word, keys[order], n[order], log_total, params.pair_weight))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, known, base, score, rest, (owner, places), asks = shared.value.score(batch.column(2), batch.column(1).to_numpy(zero_copy_only=False))
        n = batch.num_rows
        lists = [_lists(rest[0], rest[1].view(np.int64), n, pa.int64())]
        lists += [_lists(np.repeat(owner, 3), places.astype(np.int32).reshape(-1), n, pa.int32()), _lists(asks[0], asks[1].view(np.int64), n, pa.int64())]
        columns = [batch.column(0), batch.column(1), *(pa.array(c) for c in (tokens.astype(np.int64), known, base, score)), *lists]
        return pa.record_batch(columns, names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "rest", "places", "asks"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rest array<long>, places array<int>, asks array<long>"
    # Each of the next steps is written before the one after it, which frees the shuffle files of the steps before.
    scored = stash(map_batches(rows, run, schema).withColumn("row", F.monotonically_increasing_id()))
    others = scored.select("row", F.explode("rest").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("tf"))
    n = F.coalesce("n", F.lit(0))
    joined = stash(
        others.join(words, "key", "left").groupBy("row").agg(
            F.sum(F.col("tf") * (_log10(n + 0.1) - log_total)).alias("more_base"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("more_known")
        )
    )
    # The levels that the filter leaves out, and what the texts ask for of them.
    left_out = kept.filter(_level(params) <= F.when(F.col("key") % 2 == 0, F.lit(bloom.skip[_ONE])).otherwise(F.lit(bloom.skip[_TWO])))
    left_out = left_out.select("key", _level(params).alias("level"))
    asked = scored.select("row", F.posexplode("asks").alias("number", "key"))
    # A key's number in its text and its level, in one integer.
    answer_of = F.shiftleft(F.col("number").cast("long"), 8).bitwiseOR(F.col("level"))
    # A part of the keys after the other, so that never all that is asked for is on its way at once.
    rounds = []
    for part in range(params.rounds):
        own = F.pmod(F.shiftrightunsigned("key", 1), F.lit(params.rounds)) == part
        found = asked.filter(own).join(left_out.filter(own), "key").select("row", answer_of.alias("answer"))
        rounds.append(stash(found.groupBy("row").agg(F.collect_list("answer").alias("answers"))))
    answers = reduce(DataFrame.unionByName, rounds).groupBy("row").agg(F.flatten(F.collect_list("answers")).alias("answers"))
    discard(kept)

    def answer(batch: pa.RecordBatch) -> pa.RecordBatch:
        more = []
        for held, places, found in zip(*batch.columns[1:], strict=True):
            found = found.values.to_numpy() if found.is_valid else np.empty(0, np.int64)
            more.append(shared.value.answered(places.values.to_numpy().astype(np.int64).reshape(-1, 3), held.as_py(), found >> 8, found & 255))
        return pa.record_batch([batch.column(0), pa.array(more, pa.float64())], names=["row", "more_score"])

    open_rows = scored.filter("size(places) > 0").select("row", "held_out", "places").join(answers, "row", "left")
    settled = stash(map_batches(open_rows.select("row", "held_out", "places", "answers"), answer, "row long, more_score double"))
    discard(*rounds)
    return scored.drop("places", "asks", "rest").join(joined, "row", "left").join(settled, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
