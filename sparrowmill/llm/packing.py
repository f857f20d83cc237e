"""Packing by minimum bin slack over the multiset of lengths.

A document's ids are cut at multiples of the window; only the remainders (1 to 1023 ids) need
packing.  Remainders of equal length are interchangeable, so the whole problem is a histogram
of at most 1024 counts, whatever the number of documents.  The driver plans on the histogram:
the longest remaining length opens a window, a subset-sum over bitsets with backtracked counts
finds the multiset of remaining lengths that fills it closest to capacity, and the pattern is
repeated as often as the counts allow, which uses up some length.  So the plan has as many
patterns as lengths at most, and each piece finds its place by its rank among the pieces of
its length.  Ranks come from counts per (length, bucket), so no length gathers in one task.

Defined results: a null or empty text is one piece with the end id 0; repeated rows are packed
each; an empty table gives an empty result; extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Recent, held, map_batches, pick, stash, table, texts_of

WINDOW, END_ID, BUCKETS = 1024, 0, 4096
REMEMBER = 300_000
_LATIN = "ɏ"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Ids:
    """Ids of a text as little-endian 32-bit bytes, equal to those of the tokenizers library.

    The file's pattern never joins a space to what stands before it, so a text cut before each
    single space encodes chunk by chunk.  Chunks are remembered; new ones of Latin letters are
    encoded by the same vocabulary as ranks, the others and texts with double spaces by the library.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        alphabet = {c: b for b, c in _alphabet().items()}
        special = {t.content for t in self.library.get_added_tokens_decoder().values()}
        ranks = {bytes([alphabet[c] for c in t]): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in special}
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known = Recent(REMEMBER, lambda p: self._whole(" " + p))

    def _whole(self, text: str) -> bytes:
        if text and max(text) <= _LATIN and "<|" not in text:
            return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: str) -> bytes:
        parts = text.split(" ")
        if "" in parts:
            return self._whole(text)
        return self._whole(parts[0]) + b"".join(map(self.known.__getitem__, parts[1:]))


def _alphabet() -> dict[int, str]:
    from .bpe import byte_alphabet

    return byte_alphabet()


def _ids(path: str) -> Ids:
    return held((Ids, path), lambda: Ids(path))


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and with `with_ids` the ids of each piece (binary, unsigned 32-bit little-endian)."""
    path = path or vocabulary_path()

    def run(batch: pa.RecordBatch) -> dict:
        rows: tuple[list, ...] = ([], [], [], [], [], [])
        for at, text in enumerate(texts_of(batch.column(1))):
            ids = memoryview(_ids(path).of(text) + END_ID.to_bytes(4, "little"))
            n = len(ids) // 4
            for a in range(0, n, window):
                part = ids[4 * a : 4 * (a + window)]
                for r, v in zip(rows, (at, a, len(part) // 4, zlib.crc32(part), n, bytes(part) if with_ids else None)):
                    r.append(v)
        out = {"doc_id": batch.column(0).take(pa.array(rows[0], pa.int64()))}
        out |= {k: pa.array(v, pa.int64()) for k, v in zip(("start", "length", "ids_crc32", "doc_tokens"), rows[1:5])}
        return out | ({"ids": pa.array(rows[5], pa.binary())} if with_ids else {})

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return map_batches(pick(docs, "doc_id", "text"), run, schema)


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths within `counts` whose sum comes closest to `room` from below."""
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length), 1
        while left > 0:  # binary splitting of the count
            part = min(part, left)
            grown = (reach | reach << (length * part)) & full
            if grown != reach:
                steps.append((length, part, reach))
            reach, left, part = grown, left - part, part * 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for length, part, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + part
            at -= length * part
    return out


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, last rank, pieces in a sequence, first sequence, offset) that place every piece."""
    left = {k: n for k, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    rows, base = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fill({k: n for k, n in left.items() if n}, window - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        offset = 0
        for k in sorted(pattern, reverse=True):
            n = pattern[k]
            rows.append((k, used[k], used[k] + n * times - 1, n, base, offset))
            offset += k * n
            used[k] += n * times
            left[k] -= n * times
            if not left[k]:
                del left[k]
        base += times
    return rows


def pack(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """`rows` (doc_id, start, length, ...) with sequence_id and offset."""
    spark = rows.sparkSession
    rows = stash(rows.withColumn("_b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(BUCKETS)).cast("int")))
    counted = rows.groupBy("length", "_b").agg(F.count("*").alias("_n"))
    # At most `window` rows reach the driver.
    hist = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    begins = counted.select("length", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    own = Window.partitionBy("length", "_b").orderBy("doc_id", "start", "ids_crc32")
    ranked = rows.withColumn("_r", F.row_number().over(own)).join(begins, ["length", "_b"])
    ranked = ranked.withColumn("_rank", F.col("_from") + F.col("_r") - 1).drop("_b", "_r", "_from")
    places = spark.createDataFrame(plan(hist, window), "_length long, _lo long, _hi long, _each long, _base long, _off long")
    # The plan follows the number of lengths, not of rows: the size of a broadcast is bounded by `window`.
    hit = (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_lo"), F.col("_hi"))
    placed = ranked.join(F.broadcast(places), hit)
    k = F.col("_rank") - F.col("_lo")
    return placed.withColumns({
        "sequence_id": F.col("_base") + F.expr("(_rank - _lo) div _each"),
        "offset": F.col("_off") + F.pmod(k, F.col("_each")) * F.col("length"),
    }).drop("_length", "_lo", "_hi", "_each", "_base", "_off", "_rank")


def packed(docs: DataFrame) -> DataFrame:
    return pack(pieces(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": query}
