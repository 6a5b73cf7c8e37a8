"""Best-fit packing of documents into token sequences by large-item matching.

A document is its token ids and an end id.  Documents longer than a sequence are
cut into full pieces and a rest.  How many pieces have each length is all the
packing needs, at most ``capacity`` numbers whatever the corpus, so it is planned on
the driver over runs of equal bins: pieces above a third of the capacity are matched
greedily, two to a bin at most (longest with the longest partner that fits); shorter
ones, longest first, go where they leave the least gap.  The plan is a table of
intervals of ranks for each length; pieces are ranked within their length in hashed
buckets (no length meets in one task) and look their place up.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, shuffle_width

#: Bytes, about, of the words as they stand and of the stems whose ids a Python worker keeps, and the longest of them.
CACHE_BYTES, CACHED_LENGTH = 150_000_000, 32
#: Bytes of texts that are cut into words at once.
BLOCK_BYTES = 1_000_000
ENTRY = 150  # two small objects and a place in the table
_tokenizers: dict[str, tuple] = {}
#: Characters that Python takes for white space and the tokenizer does not.
_ODD = "\x1c\x1d\x1e\x1f"
#: Letters that no normalisation but lower-casing changes, then signs that form one more
#: token group; the apostrophe has rules of its own.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\\[-`{-~]*)")
#: The pattern's ASCII letters and its signs.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_SIGNS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "'")


def _byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()


class _Cache:
    """Ids of words in two generations: ``trim`` lets the older one go when the younger outgrows half of the share of memory.

    ``ids`` is the younger; what is asked for again moves over from ``old``.
    """

    def __init__(self):
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.used = 0

    def trim(self, share: float) -> None:
        if self.used > share * CACHE_BYTES / 2:
            self.old, self.ids, self.used = self.ids, {}, 0


def _tokenizer(path: str):
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        _tokenizers[path] = (t, t.model, _Cache(), _Cache())
    return _tokenizers[path]


def _keep(cache: _Cache, word: str, make) -> bytes:
    """A word's ids, kept unless it is long."""
    ids = cache.ids.get(word)
    if ids is None:
        ids = cache.old.get(word)
        if ids is None:
            ids = make(word)
        if len(word) <= CACHED_LENGTH:
            cache.ids[word] = ids
            cache.used += ENTRY + len(word) + len(ids)
    return ids


def _all(cache: _Cache, words: pa.Array, make) -> list[bytes]:
    names = words.to_numpy(zero_copy_only=False).tolist()
    found = list(map(cache.ids.get, names))
    for i, ids in enumerate(found):
        if ids is None:
            found[i] = _keep(cache, names[i], make)
    return found


def _deal(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the entries that ``places`` names, one after the other, and where each ends; ``sizes``: of all entries."""
    many = sizes[places]
    ends = np.cumsum(many)
    shift = (np.cumsum(sizes) - sizes)[places] - (ends - many)
    return ids[np.repeat(shift, many) + np.arange(ends[-1] if len(ends) else 0)], ends


def _table(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words, one after the other, and how many each has."""
    tokenizer, model, whole, stems = _tokenizer(path)

    def part_ids(part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        found = [t.id for t in model.tokenize(letters)] if letters else []
        return struct.pack(f"<{len(found)}I", *found)

    def word_ids(word: str) -> bytes:
        if plain := _PLAIN.fullmatch(word):
            return _keep(stems, plain[1].lower(), part_ids) + _keep(stems, plain[2], part_ids)
        return np.array(tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    # words of ASCII letters and signs are cut by columns; the pattern has the others
    letters = pc.utf8_rtrim(words, characters=_SIGNS)
    cut = pc.ascii_is_alpha(letters)
    heads = pc.ascii_lower(letters.filter(cut)).dictionary_encode()
    tails = pc.utf8_ltrim(words.filter(cut), characters=_LETTERS).dictionary_encode()
    parts = [*_all(stems, heads.dictionary, part_ids), *_all(stems, tails.dictionary, part_ids), *_all(whole, words.filter(pc.invert(cut)), word_ids), b""]
    # each word is two of the parts, the last of which is empty
    cut = cut.to_numpy(zero_copy_only=False)
    first, second = (np.full(len(words), len(parts) - 1) for _ in range(2))
    first[cut] = heads.indices.to_numpy()
    second[cut] = len(heads.dictionary) + tails.indices.to_numpy()
    first[~cut] = len(heads.dictionary) + len(tails.dictionary) + np.arange(len(words) - len(heads))
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat, _ = _deal(np.frombuffer(b"".join(parts), "<u4"), sizes, np.stack([first, second], 1).ravel())
    return flat, sizes[first] + sizes[second]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never merges across it, nor across the border
    of letters and signs, so ids are looked up once for each distinct word and dealt to
    its places by numpy.  Exactly the tokenizer's own ids for the whole text (tested).
    Long words, and texts that can't be cut into words here, are not kept.
    """
    tokenizer, _, whole, stems = _tokenizer(path)
    whole.trim(0.25)
    stems.trim(0.75)
    odd = [any(c in t for c in _ODD) for t in texts]
    words = pc.utf8_split_whitespace(pa.array(["" if o else t for o, t in zip(odd, texts)], pa.large_string()))
    coded = words.flatten().dictionary_encode()
    flat, ends = _deal(*_table(coded.dictionary, path), coded.indices.to_numpy())
    bounds = np.append(0, ends)[words.offsets.to_numpy()].tolist()
    return [
        np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if o else flat[a:b].tobytes()
        for t, o, a, b in zip(texts, odd, bounds, bounds[1:])
    ]


def _pieces(path: str, capacity: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            a, n = 0, batch.num_rows
            sizes = np.cumsum([len(x) if x is not None else 0 for x in (v.as_buffer() for v in batch.column("text").cast(pa.large_string()))])
            while a < n:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BLOCK_BYTES, "right")))
                ids = batch.column("doc_id").slice(a, b - a).to_pylist()
                texts = [t or "" for t in batch.column("text").slice(a, b - a).to_pylist()]
                rows = []
                for doc, data in zip(ids, encode(texts, path)):
                    data += end
                    salt = salt + 1 if doc is None else 0
                    for p, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        rows.append((doc, p, at // 4, len(part) // 4, zlib.crc32(part), salt))
                a = b
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "salt"],
                )

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, one past the last rank, first bin, pieces a bin, offset).

    The pieces of these ranks go to consecutive bins, so many to each, one after the
    other from the offset.  ``counts``: how many pieces have each length.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    rank: dict[int, int] = defaultdict(int)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first bin, bins)
    order: list[int] = []  # the gaps that have runs, ascending
    bins = 0

    def put(length: int, first: int, many: int, each: int, offset: int) -> None:
        rows.append((length, rank[length], rank[length] + many * each, first, each, offset))
        rank[length] += many * each
        left[length] -= many * each
        if not left[length]:
            del left[length]

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, many))

    third = capacity // 3
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        # the longest large partner that fits
        i = bisect.bisect_right(large, capacity - n) - 1
        if i >= 0 and large[i] == n:
            many = left[n] // 2
            if many:
                put(n, bins, many, 2, 0)
                free(capacity - 2 * n, bins, many)
                bins += many
            elif i > 0:
                i -= 1
            else:
                i = -1
        if n in left and (i < 0 or large[i] != n):
            if i >= 0:
                m = large[i]
                many = min(left[n], left[m])
                put(n, bins, many, 1, 0)
                put(m, bins, many, 1, n)
                free(capacity - n - m, bins, many)
                if m not in left:
                    large.pop(i)
            else:
                many = left[n]
                put(n, bins, many, 1, 0)
                free(capacity - n, bins, many)
            bins += many
        if n not in left:
            large.remove(n)

    for n in range(third, 0, -1):
        while n in left:
            i = bisect.bisect_left(order, n)
            if i == len(order):  # no gap is wide enough: new bins, as many as these pieces fill
                many = -(-left[n] // (capacity // n))
                free(capacity, bins, many)
                bins += many
                i = bisect.bisect_left(order, n)
            gap = order[i]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(i)
            each = gap // n
            full = min(many, left[n] // each)
            if full:
                put(n, first, full, each, capacity - gap)
                free(gap - full_use(each, n), first, full)
            if full < many:
                rest = left.get(n, 0)
                if rest:
                    put(n, first + full, 1, rest, capacity - gap)
                    free(gap - rest * n, first + full, 1)
                    full += 1
                free(gap, first + full, many - full)
    return rows


def full_use(each: int, n: int) -> int:
    return each * n


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row for each piece.

    Null texts are empty: a piece of the end id alone.  Rows with equal or null
    doc_ids are packed each on their own.  Further columns are ignored; an empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.save(docs.mapInArrow(_pieces(tokenizer_path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"))
    buckets = 4 * shuffle_width(spark)
    # rows without a doc_id may be alike: they are dealt out by their place too
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "salt"), F.lit(buckets)).cast("int"))
    counted = dealt.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = scratch.save(counted.select("length", "bucket", "c", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before")))
    # at most one row for each length up to the capacity
    rows = plan({r["length"]: r["c"] for r in counted.groupBy("length").agg(F.sum("c").alias("c")).collect()}, capacity)
    where = spark.createDataFrame(rows, "length long, lo long, hi long, bin long, each long, base long")
    here = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "salt")
    ranked = dealt.withColumn("n", F.row_number().over(here)).join(counted.select("length", "bucket", "before"), ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("n") - 1)
    # bounded: at most a few intervals for each length up to the capacity
    placed = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    j = F.col("rank") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", ranked["length"], "ids_crc32",
        (F.col("bin") + F.floor(j / F.col("each")).cast("long")).alias("sequence_id"),
        (F.col("base") + (j % F.col("each")) * ranked["length"]).alias("offset"),
    )
