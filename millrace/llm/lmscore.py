"""Stupid-backoff scores of documents under the bigram model of all other documents.

For a word v after u in a document d (the first word follows the start sign):

    S(v | u) = (c(uv) - c_d(uv)) / c(u)   if another document holds the bigram
             = 0.4 * c(v) / N             else

c counts over all documents, c_d in d alone, N is the number of words; c of the start
sign is the number of texts with words.  A document's score is the mean of ln S over
its words.  Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

Relationally: a unigram table; bigrams exploded from the texts, dealt out by the hash
of their first word, counted there and scored per document; what backs off to a rare
word is dealt out again by that word to meet the unigram table; parts are summed by
document.  Words that make up at least 1 / ``COMMON`` of the corpus, so at most
``COMMON`` of them, are broadcast with their counts: bigrams that begin with one are
dealt out by both words, so no word's bigrams meet in one task.  Bigrams travel as
compressed blocks, one for each batch of texts and bucket, not as rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textblocks import U, mix, slices, word_hashes

BACKOFF = 0.4
#: At most so many words have a share of the corpus that makes them common.
COMMON = 1 << 19
#: Bigrams of a bucket, and of a step within a bucket's task.
BUCKET, STEP = 4_000_000, 1_000_000
_NO_ID = -(2**63)
_START, _END = U(0), U(1)
_SHIFT = U(24)  # words are named by 40 bits


def _names(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, per = word_hashes(data, offsets)
    return np.maximum(w >> _SHIFT, U(2)), per


def _press(*arrays: np.ndarray) -> bytes:
    return pa.compress(b"".join(a.tobytes() for a in arrays), codec="zstd", asbytes=True)


def _open(data: bytes, sizes: list[tuple[str, int]]) -> list[np.ndarray]:
    total = sum(np.dtype(t).itemsize * n for t, n in sizes)
    raw = pa.decompress(data, decompressed_size=total, codec="zstd", asbytes=True)
    out, at = [], 0
    for t, n in sizes:
        out.append(np.frombuffer(raw, t, n, at))
        at += np.dtype(t).itemsize * n
    return out


def _unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held):
        w, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(n.astype(np.int64))], ["w", "n"])

    held, total = [], 0
    for batch in batches:
        for _, _, data, offsets in slices(batch.column("text")):
            w, per = _names(data, offsets)
            held.append(np.concatenate([w, np.zeros(int((per > 0).sum()), U)]))
            total += len(w)
            if total > 4_000_000:
                yield out(held)
                held, total = [], 0
    if held:
        yield out(held)


_BLOCK = "bucket int, kind int, n int, m int, data binary"


def _row(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["bucket", "kind", "n", "m", "data"])


def _bigrams(buckets: int, common):
    """Blocks of bigrams: kind 0 and 1 (first word common: its place in the table)."""

    def flush(held):
        u, v, doc = (np.concatenate(x) for x in zip(*held))
        table = common.value[0]
        at = np.minimum(np.searchsorted(table, u), len(table) - 1) if len(table) else np.zeros(len(u), np.int64)
        often = table[at] == u if len(table) else np.zeros(len(u), bool)
        bucket = np.where(often, mix(u ^ mix(v)), u) % U(buckets)
        name = np.where(often, at.astype(U), (u // U(buckets)) & U(0xFFFFFFFF))
        docs, place = np.unique(doc, return_inverse=True)
        order = np.lexsort((v, name, often, bucket))
        bucket, often, name, v, place = bucket[order], often[order], name[order].astype(np.uint32), v[order], place[order]
        part = bucket.astype(np.int64) * 2 + often
        cuts = np.searchsorted(part, np.arange(2 * buckets + 1))
        rows = []
        for x in range(2 * buckets):
            a, b = cuts[x], cuts[x + 1]
            if b > a:
                mine, p = np.unique(place[a:b], return_inverse=True)
                ids = docs[mine]
                data = _press(np.diff(ids, prepend=0), p.astype(np.uint32), np.diff(name[a:b], prepend=np.uint32(0)), (v[a:b] & U(0xFFFFFFFF)).astype(np.uint32), (v[a:b] >> U(32)).astype(np.uint8))
                rows.append((x // 2, x % 2, b - a, len(mine), data))
        return _row(rows)

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for a, b, data, offsets in slices(batch.column("text")):
                w, per = _names(data, offsets)
                if not len(w):
                    continue
                ids = batch.column("doc_id").slice(a, b - a).to_numpy(zero_copy_only=False)
                has = per > 0
                first = np.cumsum(per) - per
                # start sign, words, end sign of every text
                u = np.insert(w, first[has], _START)
                v = np.insert(w, (first + per)[has], _END)
                held.append((u, v, np.repeat(ids, np.where(has, per + 1, 0))))
                total += len(u)
                if total > 2_000_000:
                    yield flush(held)
                    held, total = [], 0
        if held:
            yield flush(held)

    return run


def _sums(doc: np.ndarray, value: np.ndarray, words: np.ndarray, back: np.ndarray):
    ids, place = np.unique(doc, return_inverse=True)
    m = len(ids)
    return ids, np.bincount(place, value, m), np.bincount(place, words, m).astype(np.int32), np.bincount(place, back, m).astype(np.int32)


def _read_bigrams(batches):
    """All bigrams of a task, by bucket, as (first word, second word, document, whether common)."""
    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            held.setdefault(r["bucket"], []).append((r["kind"], r["n"], r["m"], r["data"]))
    for bucket in sorted(held):
        blocks = held.pop(bucket)
        steps = max(1, -(-sum(n for _, n, _, _ in blocks) // STEP))
        for step in range(steps):
            parts = []
            for kind, n, m, data in blocks:
                ids, p, name, low, high = _open(data, [("<i8", m), ("<u4", n), ("<u4", n), ("<u4", n), ("u1", n)])
                name = np.cumsum(name, dtype=np.uint32)
                v = low.astype(U) | (high.astype(U) << U(32))
                u = name.astype(U) | U(kind << 40)
                keep = slice(None)
                if steps > 1:
                    keep = np.flatnonzero(mix(u ^ mix(v) if kind else u) % U(steps) == U(step))
                parts.append((u[keep], v[keep], np.cumsum(ids)[p[keep]]))
            yield tuple(np.concatenate(x) for x in zip(*parts))


def _score_bigrams(buckets: int, common, total: int, what: str):
    """``sums``: blocks of parts per document by bucket of doc_id; ``rare``: blocks of what backs off to rare words."""

    def run(batches):
        table, counts = common.value
        done = []
        for u, v, doc in _read_bigrams(batches):
            k = mix(u ^ mix(v))
            _, inverse, c = np.unique(k, return_inverse=True, return_counts=True)
            many = c[inverse]
            _, inverse, c = np.unique(mix(k ^ mix(doc.astype(U))), return_inverse=True, return_counts=True)
            many = many - c[inverse]
            cold = (u >> U(40)) == 0
            names, inverse, c = np.unique(u, return_inverse=True, return_counts=True)
            cu = c[inverse]
            if len(table):
                cu = np.where(cold, cu, counts[np.where(cold, U(0), u & U(0xFFFFFFFF)).astype(np.int64)])
            word = v != _END
            hit = word & (many > 0)
            at = np.minimum(np.searchsorted(table, v), max(len(table) - 1, 0))
            known = table[at] == v if len(table) else np.zeros(len(v), bool)
            if what == "sums":
                value = np.zeros(len(u))
                value[hit] = np.log(many[hit] / cu[hit])
                easy = word & ~hit & known
                value[easy] = np.log(BACKOFF * counts[at[easy]] / total)
                done.append(_sums(doc[word], value[word], np.ones(int(word.sum())), (~hit)[word]))
            else:
                rare = word & ~hit & ~known
                done.append((v[rare], doc[rare]))
        if not done:
            return
        if what == "sums":
            d, s, n, b = (np.concatenate(x) for x in zip(*done))
            yield from _sum_blocks(d, s, n, b, buckets)
        else:
            v, doc = (np.concatenate(x) for x in zip(*done))
            order = np.lexsort((v, v % U(buckets)))
            v, doc = v[order], doc[order]
            cuts = np.searchsorted(v % U(buckets), np.arange(buckets + 1).astype(U))
            for x in range(buckets):
                a, b = cuts[x], cuts[x + 1]
                if b > a:
                    ids, p = np.unique(doc[a:b], return_inverse=True)
                    yield _row([(x, 0, b - a, len(ids), _press(np.diff(ids, prepend=0), p.astype(np.uint32), np.diff(v[a:b].astype(np.int64), prepend=0)))])

    return run


def _sum_blocks(d, s, n, b, buckets):
    """Parts per document, dealt out by document: many small rows become a few blocks."""
    ids, place = np.unique(d, return_inverse=True)
    s, n, b = (np.bincount(place, x, len(ids)) for x in (s, n, b))
    bucket = (mix(ids.astype(U)) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ids, s, n, b = ids[order], s[order], n[order].astype(np.int32), b[order].astype(np.int32)
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for x in range(buckets):
        i, j = cuts[x], cuts[x + 1]
        if j > i:
            yield _row([(x, 0, j - i, 0, _press(np.diff(ids[i:j], prepend=0), s[i:j], n[i:j], b[i:j]))])


def _unigram_blocks(buckets: int):
    def run(batches):
        for batch in batches:
            w, n = batch.column("w").to_numpy(), batch.column("n").to_numpy()
            order = np.argsort(w % buckets, kind="stable")
            w, n = w[order], n[order]
            cuts = np.searchsorted(w % buckets, np.arange(buckets + 1))
            rows = [(x, 1, b - a, 0, _press(w[a:b], n[a:b])) for x, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]
            if rows:
                yield _row(rows)

    return run


def _score_rare(buckets: int, total: int):
    def run(batches):
        w, n, rows = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"]:
                    a, b = _open(r["data"], [("<i8", r["n"]), ("<i8", r["n"])])
                    w.append(a)
                    n.append(b)
                else:
                    rows.append(r)
        if not rows:
            return
        w, n = np.concatenate(w), np.concatenate(n)
        order = np.argsort(w)
        w, n = w[order], n[order]
        done = []
        for r in rows:
            ids, p, v = _open(r["data"], [("<i8", r["m"]), ("<u4", r["n"]), ("<i8", r["n"])])
            c = n[np.searchsorted(w, np.cumsum(v))]
            done.append(_sums(np.cumsum(ids)[p], np.log(BACKOFF * c / total), np.zeros(len(c)), np.zeros(len(c))))
        yield from _sum_blocks(*(np.concatenate(x) for x in zip(*done)), buckets)

    return run


def _add_up(batches):
    d, s, n, b = [], [], [], []
    for batch in batches:
        for r in batch.to_pylist():
            m = r["n"]
            ids, x, y, z = _open(r["data"], [("<i8", m), ("<f8", m), ("<i4", m), ("<i4", m)])
            for held, part in zip((d, s, n, b), (np.cumsum(ids), x, y, z)):
                held.append(part)
    if d:
        ids, place = np.unique(np.concatenate(d), return_inverse=True)
        out = [np.bincount(place, np.concatenate(x), len(ids)) for x in (s, n, b)]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(out[0]), pa.array(out[1].astype(np.int64)), pa.array(out[2].astype(np.int64))], ["doc_id", "s", "n", "back"])


def score(docs: DataFrame, backoff_at_most: int = COMMON) -> DataFrame:
    """(doc_id, n_words, n_backed_off, score): one row for each distinct doc_id of ``docs``.

    Rows of one doc_id (null is one) are one document of several texts.  Null texts are
    empty; a document without words has n_words 0 and score null.  Further columns are
    ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = scratch.save(docs.select("text").mapInArrow(_unigrams, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")))
    total = words.where("w <> 0").agg(F.sum("n")).first()[0] or 0
    # at most backoff_at_most words can have this share
    often = words.where((F.col("n") >= total / backoff_at_most) | (F.col("w") == 0)).orderBy("w").toArrow() if total else None
    table = (often["w"].to_numpy().astype(U), often["n"].to_numpy()) if total else (np.zeros(0, U), np.zeros(0, np.int64))
    common = spark.sparkContext.broadcast(table)
    buckets = max(12, -(-total // BUCKET))
    blocks = docs.mapInArrow(_bigrams(buckets, common), _BLOCK).repartitionById(buckets, F.col("bucket"))
    sums = blocks.mapInArrow(_score_bigrams(buckets, common, total, "sums"), _BLOCK)
    rare = blocks.mapInArrow(_score_bigrams(buckets, common, total, "rare"), _BLOCK)
    rare = rare.unionByName(words.mapInArrow(_unigram_blocks(buckets), _BLOCK)).repartitionById(buckets, F.col("bucket")).mapInArrow(_score_rare(buckets, total), _BLOCK)
    parts = sums.unionByName(rare).repartitionById(buckets, F.col("bucket")).mapInArrow(_add_up, "doc_id long, s double, n long, back long")
    out = docs.select("doc_id").distinct().join(parts, "doc_id", "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select(
        F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), n.alias("n_words"), F.coalesce("back", F.lit(0).cast("long")).alias("n_backed_off"), F.when(n > 0, F.col("s") / n).alias("score")
    )


SCORE_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT doc_id, unnest(list_prepend(' ', w)) AS u, unnest(list_append(w, ' ')) AS v FROM t WHERE len(w) > 0),
k AS (SELECT doc_id, u, v, count(*) AS tf FROM b GROUP BY ALL),
c2 AS (SELECT u, v, sum(tf) AS c FROM k GROUP BY ALL),
c1 AS (SELECT u AS w, count(*) AS c FROM b GROUP BY ALL),
n AS (SELECT sum(c) AS n FROM c1 WHERE w <> ' '),
s AS (SELECT k.doc_id, k.tf, c2.c > k.tf AS hit, ln(CASE WHEN c2.c > k.tf THEN (c2.c - k.tf) / cu.c ELSE 0.4 * cv.c / n.n END) AS x
    FROM k JOIN c2 USING (u, v) JOIN c1 cu ON cu.w = k.u JOIN c1 cv ON cv.w = k.v, n WHERE k.v <> ' ')
SELECT d.doc_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n_words, CAST(coalesce(sum(CASE WHEN hit THEN 0 ELSE tf END), 0) AS BIGINT) AS n_backed_off,
    round(sum(tf * x) / sum(tf), 6) AS score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s ON s.doc_id IS NOT DISTINCT FROM d.doc_id GROUP BY d.doc_id
"""
