"""MinHash document fingerprints.

Signatures: for each of ``perms`` universal hash functions h -> (a * h + b) >> 32 of
64-bit words, the least value over a text's five-word shingles, vectorised over the
shingles in numpy.  The share of equal places of two signatures estimates the Jaccard
similarity of the shingle sets.

``near_pairs`` joins bands of signatures in Spark and verifies the exact Jaccard
similarity; ``fingerprint_edits`` compares each text with an edited form of itself
and with the next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, shuffle_width
from .textblocks import U, mix1, shingle_sets, slices, word_hashes

PERMS = 128
_BLOCK = 512  # shingles at a time: a block of all permutations stays in the cache


def coefficients(perms: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([mix1(seed * 1_000_003 + 2 * i) | 1 for i in range(perms)], U)
    b = np.array([mix1(seed * 1_000_003 + 2 * i + 1) for i in range(perms)], U)
    return a, b


def signatures(s: np.ndarray, n: np.ndarray, perms: int = PERMS) -> np.ndarray:
    """A row of ``perms`` 32-bit values for each set; sets as by ``shingle_sets``.  An empty set has all ones."""
    a, b = coefficients(perms)
    a, b = a[:, None], b[:, None]
    out = np.full((len(n), perms), 2**32 - 1, np.uint32)
    at = 0
    work = np.empty((perms, _BLOCK), U)
    for i, many in enumerate(n.tolist()):
        if not many:
            continue
        least = None
        for x in range(at, at + many, _BLOCK):
            part = s[x : min(x + _BLOCK, at + many)]
            w = work[:, : len(part)]
            np.multiply(a, part, out=w)
            np.add(w, b, out=w)
            m = w.min(1)
            least = m if least is None else np.minimum(least, m)
        out[i] = least >> U(32)
        at += many
    return out


def _of_texts(texts: list[str], size: int, perms: int) -> np.ndarray:
    rows = []
    for _, _, data, offsets in slices(pa.array(texts, pa.large_string())):
        rows.append(signatures(*shingle_sets(*word_hashes(data, offsets), size), perms))
    return np.concatenate(rows) if rows else np.zeros((0, perms), np.uint32)


# --- edits -------------------------------------------------------------------------------------


def _edits(size: int, perms: int):
    """Rows (run, last, doc_id, text), sorted, to results; a ``last`` row only ends its run."""

    def hexes(sig):
        return [x.tobytes().hex() for x in sig.astype(">u4")]

    def out(rows: list[tuple], nexts: list[str], sigs: np.ndarray, next_sigs: np.ndarray) -> pa.RecordBatch:
        edited, lengths = [], []
        for (_, _, _, text), following in zip(rows, nexts):
            k = len(text) // 2
            lengths.append(len(text))
            edited.append(text[: len(text) - k] + following[:k])
        esigs = _of_texts(edited, size, perms)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[2] for r in rows], pa.int64()),
                pa.array(lengths, pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(hexes(sigs)),
                pa.array(hexes(esigs)),
                pa.array((sigs == esigs).mean(1)),
                pa.array((sigs == next_sigs).mean(1)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        held_sig = np.zeros((0, perms), np.uint32)
        for batch in batches:
            names = ("run", "last", "doc_id", "text")
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                rows = list(zip(*(part.column(c).to_pylist() for c in names)))
                rows = [(r, last, d, t or "") for r, last, d, t in rows]
                sig = np.concatenate([held_sig, _of_texts([t for *_, t in rows], size, perms)])
                rows = held + rows
                # all but the last row have their next row here
                use = [i for i in range(len(rows) - 1) if not rows[i][1]]
                if use:
                    yield out([rows[i] for i in use], [rows[i + 1][3] for i in use], sig[use], sig[[i + 1 for i in use]])
                held, held_sig = rows[-1:], sig[-1:]

    return run


def fingerprint_edits(docs: DataFrame, size: int = 5, perms: int = PERMS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row.

    The edited text has its last floor(n_chars / 2) code points replaced by as many of
    the first (or all) of the next document's text, by descending doc_id; after the last
    comes the first.  Rows of equal doc_id follow each other by the digest of their text,
    null doc_ids come last, null texts are empty, a document alone is its own next.  Two
    texts without words are alike.  An empty table gives an empty one.

    Documents are dealt out in ranges of doc_id with one shuffle; the first document of
    each range also goes to the range before it, to which it is the next.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(2, shuffle_width(docs.sparkSession))
    ids = docs.select("doc_id").where("doc_id is not null")
    cuts = sorted({int(c) for c in ids.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)}, reverse=True)
    # rows without an id are ordered, and cut into ranges, by their digest
    digest = F.when(F.col("doc_id").isNull(), F.sha2("text", 256))
    after = F.lit(len(cuts) + 1) + F.floor(F.conv(F.substring(digest, 1, 6), 16, 10).cast("long") * parts / (1 << 24)).cast("int")
    docs = docs.withColumn("run", F.coalesce(after, _cuts_from(F.col("doc_id"), cuts)).cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), F.sha2("text", 256)]
    # the first of each run: one row for each of the ranges, as many as shuffle partitions allow
    heads = docs.groupBy("run").agg(F.max("doc_id").alias("doc_id"), F.min(digest).alias("digest")).orderBy("run").collect()
    if not heads:
        return docs.select("doc_id", "text", F.col("run"), F.lit(False).alias("last")).select("run", "last", "doc_id", "text").mapInArrow(_edits(size, perms), _EDITS)
    before = {h["run"]: heads[i - 1]["run"] for i, h in enumerate(heads)}
    # an id tells its run; of null ids the least text comes first
    known = [h["doc_id"] for h in heads if h["doc_id"] is not None]
    first = [h["digest"] for h in heads if h["digest"] is not None]
    is_head = F.when(F.col("doc_id").isNull(), digest.isin(first)).otherwise(F.col("doc_id").isin(known))
    into = F.element_at(F.array(*[F.lit(before.get(i, 0)) for i in range(heads[-1]["run"] + 1)]), F.col("run") + 1)
    here = F.struct(F.col("run").alias("run"), F.lit(False).alias("last"))
    copy = F.struct(into.alias("run"), F.lit(True).alias("last"))
    both = docs.select("doc_id", "text", F.explode(F.when(is_head, F.array(here, copy)).otherwise(F.array(here))).alias("at"))
    rows = both.select(F.col("at.run").alias("run"), F.col("at.last").alias("last"), "doc_id", "text")
    # each range goes to a task of its own
    rows = rows.repartitionById(heads[-1]["run"] + 1, F.col("run")).sortWithinPartitions("run", "last", *order)
    return rows.mapInArrow(_edits(size, perms), _EDITS)


def _cuts_from(id_, cuts: list[int]):
    """How many of ``cuts`` (descending) are not under ``id_``, found in two steps of about the square root of them each."""
    step = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    if not blocks:
        return F.lit(0)
    longs = lambda xs: F.array(*[F.lit(c).cast("long") for c in xs])
    whole = F.size(F.filter(longs(b[-1] for b in blocks), lambda c: id_ <= c))
    rest = F.element_at(F.array(*[longs(b) for b in blocks], F.array().cast("array<bigint>")), whole + 1)
    return F.least(F.lit(len(cuts)), whole * step + F.size(F.filter(rest, lambda c: id_ <= c)))


_EDITS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

# --- near duplicates ---------------------------------------------------------------------------


def _banded(size: int, perms: int, bands: int):
    rows = perms // bands

    def run(batches):
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                s, n = shingle_sets(*word_hashes(data, offsets), size)
                sig = signatures(s, n, perms)
                cuts = np.concatenate([[0], np.cumsum(n)])
                keep = np.flatnonzero(n > 0)
                ids = batch.column("doc_id").slice(a, b - a)
                for i in keep:
                    keys = [hashlib.blake2b(sig[i, j * rows : (j + 1) * rows].tobytes(), digest_size=7, salt=j.to_bytes(2, "big")).digest() for j in range(bands)]
                    m = s[cuts[i] : cuts[i + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(i, 1).cast(pa.int64()), pa.array([int.from_bytes(hashlib.blake2b(m.tobytes(), digest_size=7).digest(), "big")], pa.int64()), pa.array([[int.from_bytes(k, "big") for k in keys]], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())],
                        ["doc_id", "id", "keys", "s"],
                    )

    return run


def _exact(threshold: float):
    def run(batches):
        for batch in batches:
            js = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                c = len(np.intersect1d(x, y, assume_unique=True))
                js.append(c / (len(x) + len(y) - c))
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(js, pa.float64())], ["a", "b", "jaccard"])
            yield out.filter(pa.array([j >= threshold for j in js], pa.bool_()))

    return run


def near_pairs(docs: DataFrame, threshold: float = 0.8, size: int = 5, perms: int = PERMS, bands: int = 32) -> tuple[DataFrame, DataFrame]:
    """Classes (doc_id, id) of equal shingle sets, and verified pairs (a, b, jaccard) of classes.

    Two classes are candidates when a band of their signatures agrees.  Within a band
    every class is paired with the least one, and with all those of other components
    that verified pairs have left, so large groups of near copies are not expanded.
    Null and empty texts have no class.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.save(docs.select("doc_id", "text").mapInArrow(_banded(size, perms, bands), "doc_id long, id long, keys array<long>, s binary"))
    classes = rows.select("doc_id", "id")
    each = scratch.save(rows.dropDuplicates(["id"]).select("id", "keys", "s"))
    keyed = each.select(F.explode("keys").alias("key"), "id")
    shared = scratch.save(keyed.join(keyed.groupBy("key").agg(F.min("id").alias("m"), F.count("*").alias("c")).where("c > 1"), "key").select("key", "id", "m"))

    def verified(pairs):
        full = pairs.join(each.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(each.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return full.mapInArrow(_exact(threshold), "a long, b long, jaccard double")

    first = scratch.save(verified(shared.where("id <> m").select(F.col("m").alias("a"), F.col("id").alias("b")).distinct()))
    comp = components(first, scratch)
    labelled = scratch.save(shared.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    left, right = (labelled.join(mixed, "key").select("key", F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    rest = left.join(right, "key").where("a < b and ca <> cb").select("a", "b").distinct()
    return classes, first.union(verified(rest)).dropDuplicates(["a", "b"])
