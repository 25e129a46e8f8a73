"""Quality rules: word statistics and compression bands.

The bands: a text is compressed with zstandard as a whole and in fixed chunks.
Repetitive text compresses far better than prose and random text far worse;
how well prose compresses grows with its length, so the limits do too: they lie
a fifth below and an eighth above the ratio that documents of good quality
usually have at a length.  A text is rejected where its ratio, or the ratio of
most of its chunks, leaves the band of its length.  Everything about a document
is computed from the document alone, in one pass without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import binary_values, byte_array, gram_hashes, map_batches, utf8, word_bounds, word_hashes

SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compression ratios (bytes before over bytes after).

    ``whole`` lists (bytes, least ratio, greatest ratio); between two lengths
    the limits follow the logarithm of the length, beyond the ends they stay.
    They were set from the labelled documents of good quality in the test data,
    and wide where these have no text.  A chunk may leave the band of its own
    length by ``chunk_slack`` of the limit, but not fall below ``chunk_least``
    or pass ``chunk_most``; more than ``bad_chunks`` of the chunks being bad
    rejects the text.  A text no longer than one chunk has no chunks to judge.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (128, 0.00, 1.75), (256, 1.22, 1.75), (512, 1.33, 1.93), (1_024, 1.47, 2.08), (2_048, 1.61, 2.25), (4_096, 1.72, 2.40),
        (8_192, 1.81, 2.54), (16_384, 1.86, 2.61), (32_768, 1.88, 2.70), (131_072, 1.88, 3.20), (1_048_576, 1.88, 4.00),
    )
    chunk_bytes: int = 4096
    chunk_slack: float = 0.15
    chunk_least: float = 1.35
    chunk_most: float = 6.5
    bad_chunks: float = 0.5
    level: int = 1

    def limits(self, size: int) -> tuple[float, float]:
        """Least and greatest ratio of a text of ``size`` bytes."""
        at = [math.log2(row[0]) for row in self.whole]
        x = math.log2(max(size, 1))
        return float(np.interp(x, at, [row[1] for row in self.whole])), float(np.interp(x, at, [row[2] for row in self.whole]))

    def chunk_limits(self, size: int) -> tuple[float, float]:
        """Least and greatest ratio of a chunk of ``size`` bytes."""
        least, most = self.limits(size)
        return max(self.chunk_least, least * (1 - self.chunk_slack)), min(self.chunk_most, most * (1 + self.chunk_slack))


def text_statistics(text: memoryview) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines and words in repeated 3-word windows of a UTF-8 text."""
    data = byte_array(text)
    starts, ends = word_bounds(data)
    n = len(starts)
    if not n:
        return 0, 0, _symbols(data), 0, 0
    continuing = np.concatenate(([0], np.cumsum((data & 0xC0) == 0x80)))
    chars = int((ends - starts).sum() - (continuing[ends] - continuing[starts]).sum())
    words = word_hashes(data, starts, ends)
    repeated = 0
    grams = gram_hashes(words, 3)
    if len(grams) > 1:
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(grams), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + len(grams)] |= twice
        repeated = int(covered.sum())
    return n, chars, _symbols(data), _repeated_lines(bytes(text)), repeated


def _symbols(data: np.ndarray) -> int:
    counts = np.bincount(data, minlength=256)
    return int(counts[list(SYMBOLS)].sum())


def _repeated_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def compression(text: memoryview, bands: Bands, compressor: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of bad chunks, and whether both are inside the bands.  An empty text is outside."""
    size = len(text)
    if not size:
        return 0.0, 0.0, False
    ratio = size / len(compressor.compress(text))
    bad = share = 0
    if size > bands.chunk_bytes:
        full = bands.chunk_limits(bands.chunk_bytes)
        chunks = range(0, size - bands.chunk_bytes // 2, bands.chunk_bytes)
        for start in chunks:
            # A last piece of at most half a chunk belongs to the chunk before it.
            part = text[start : start + bands.chunk_bytes] if start != chunks[-1] else text[start:]
            least, most = full if len(part) == bands.chunk_bytes else bands.chunk_limits(len(part))
            bad += not least <= len(part) / len(compressor.compress(part)) <= most
        share = bad / len(chunks)
    least, most = bands.limits(size)
    return ratio, float(share), least <= ratio <= most and share <= bands.bad_chunks


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, ratio double, bad_chunk_share double"
)


def quality_rules(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Word statistics, base rule and verdict for every row of ``documents`` (doc_id, text).

    Null and empty texts have no words and fail.  Repeated rows get a row each.
    Other columns are ignored; no rows give no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for text in binary_values(batch.column(1)):
            n, chars, symbols, lines, repeated = text_statistics(text)
            failed = n < 50 or 100 * repeated > 50 * n
            ratio, share, inside = compression(text, bands, compressor)
            rows.append((n, chars, symbols, lines, repeated, failed, inside and not failed, ratio, share))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.record_batch([batch.column(0), *columns], schema=_SCHEMA)

    return map_batches(documents.select(F.col("doc_id").cast("long"), utf8("text").alias("text")), run, SCHEMA)


def kept_documents(documents: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``documents`` that the rules keep, all columns as they are.

    Null and empty texts go; repeated rows all stay or all go; no rows give no rows.
    """
    order = documents.columns
    names = [f"column{k}" for k in range(len(order))]
    renamed = documents.toDF(*names)
    place = order.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        compressor = zstandard.ZstdCompressor(level=bands.level)
        keep = []
        for text in binary_values(batch.column(len(names))):
            n, _, _, _, repeated = text_statistics(text)
            keep.append(not (n < 50 or 100 * repeated > 50 * n) and compression(text, bands, compressor)[2])
        return pa.record_batch(batch.columns[:-1], names=names).filter(pa.array(keep, pa.bool_()))

    return map_batches(renamed.withColumn("bytes", utf8(names[place])), run, renamed.schema).toDF(*order)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunk_share", pa.float64())]
)
