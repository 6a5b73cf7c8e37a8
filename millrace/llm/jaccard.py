"""N-gram Jaccard self-join by parity sketches.

A text's set is its distinct five-word shingles, as 64-bit hashes.  Sets that are
equal form one class.  Each class is sketched per size range: every shingle flips
one bit of a sketch made of ``k`` segments of 2**64 / k bits, kept sparsely (a
segment is the exclusive or of mixed positions of the bits flipped an odd number of
times).  The Hamming distance of two sketches never exceeds the symmetric
difference of the sets, so two sets that differ in fewer than ``k`` shingles agree
on a whole segment.  With J = 0.8, |A ^ B| <= (|A| + |B|) / 9, which bounds ``k``
for each range of sizes.  Segments that no shingle hits say nothing and are left
out, except for the few texts that have as many of them as a true partner may
have agreeing segments; so the join on segments loses no link.

Segment keys travel as packed blocks: one row for each batch of texts and bucket.
A bucket's task keeps only keys that several classes share, and of keys that join the
same classes one is enough.  From there on memberships (key, class) and short dense
sketches travel, not sets:

1. every class meets one class of its keys on sketches; what is near is tied for the
   time being, so that a large group of near copies costs one comparison a member;
2. the members of each key that are not tied to its others are compared with them on
   sketches, and only memberships that have a near partner stay;
3. the sets of the classes that are left are made, once, from one text of each class;
4. the ties are verified exactly, then forests of the nearest pairs that join different
   components, and in the end all near pairs that still lie in different components.

Where a key would need very many comparisons (a passage that many texts carry), its
classes must also agree on a segment of a second, independently seeded sketch, and
so on; a large group that stays is dealt out in blocks, so none meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, shuffle_width
from .textblocks import U, mix, mix1, shingle_sets, slices, trim, word_hashes

#: A key of more classes than this is compared in blocks, and refined if it also needs more comparisons than this.
REFINE_CLASSES, REFINE_PAIRS = 1_000, 16_000_000
#: Refinements of a key before its blocks are compared however many they are.
REFINE_LEVELS = 5
_FLUSH_KEYS = 800_000
_STEP = 1.25  # sizes of one band; J >= 0.8 spans two bands at most


def _bands(n: np.ndarray) -> np.ndarray:
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(_STEP) + 1e-9).astype(np.int64)
    return band


def _segments(r: int) -> int:
    """Segments of the sketches of sizes in bands r and r + 1."""
    low, mid, top = _STEP**r, _STEP ** (r + 1), _STEP ** (r + 2)
    most = max(2 * mid, mid + min(mid * _STEP, top)) / 9 + 1e-6  # |A| + |B| of a pair of this range, over 9
    need = int(most) + 1
    # agreeing segments left over for those that are empty: about what such sizes leave empty
    spare = 0
    for _ in range(4):
        spare = int(np.ceil((need + spare) * np.exp(-low / (need + spare)) * 1.3)) if need > 1 else 0
        spare = min(spare, need)
    return need + spare


def _most_differ(r: int) -> int:
    mid, top = _STEP ** (r + 1), _STEP ** (r + 2)
    return int(max(2 * mid, mid + min(mid * _STEP, top)) / 9 + 1e-6)


_K: dict[int, tuple[int, int]] = {}


def _range_of(r: int) -> tuple[int, int]:
    if r not in _K:
        _K[r] = (_segments(r), _most_differ(r))
    return _K[r]


def segment_keys(s: np.ndarray, n: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each set's sketch segments and the set (its place in ``n``) of each.

    ``s`` holds the sorted sets one after the other, ``n`` their sizes.  Two sets
    with J >= 0.8 have a key in common.
    """
    if not len(s):
        return np.zeros(0, U), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    if seed:
        s = mix(s ^ U(mix1(seed)))
        order = np.lexsort((s, owner))
        s = s[order]
    band = _bands(n)
    keys, who = [], []
    for up in (0, 1):  # as the lower and as the upper band of a range
        r = band - up
        distinct, place = np.unique(r, return_inverse=True)
        k = np.array([_range_of(int(x))[0] for x in distinct])[place]
        d = np.array([_range_of(int(x))[1] for x in distinct])[place]
        ks = k[owner].astype(U)
        seg = ((s >> U(32)) * ks) >> U(32)
        new = np.ones(len(s), bool)
        new[1:] = (seg[1:] != seg[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(new)
        value = np.bitwise_xor.reduceat(s, at)
        tag = seg[at] + (r[owner[at]] + 64).astype(U) * U(1 << 40)
        keys.append(mix(value ^ mix(tag + U(mix1(77 + seed)))))
        who.append(owner[at])
        used = np.bincount(owner[at], minlength=len(n))
        for i in np.flatnonzero((k - used >= k - d) & (n > 0)):  # too many empty ones: they count too
            mine = set(seg[at[owner[at] == i]].tolist())
            empty = np.array([x for x in range(int(k[i])) if x not in mine], dtype=np.int64).astype(U)
            keys.append(mix(mix(empty + U(int(r[i]) + 64) * U(1 << 40) + U(mix1(78 + seed)))))
            who.append(np.full(len(empty), i))
    return np.concatenate(keys), np.concatenate(who)


def _class_ids(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 63-bit name of each set, equal for equal sets; 0 for empty ones."""
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(len(n), U)
    full = n > 0
    if full.any():
        at = bounds[:-1][full]
        with np.errstate(over="ignore"):
            out[full] = mix(np.add.reduceat(mix(s ^ U(mix1(5))), at) + np.bitwise_xor.reduceat(s, at) * U(31) + n[full].astype(U)) >> U(1)
        out[full & (out == 0)] = U(1)
    return out.astype(np.int64)


def _sets(column: pa.Array, size: int):
    for a, b, data, offsets in slices(column):
        s, n = shingle_sets(*word_hashes(data, offsets), size)
        yield a, b, s, n


def _each(s: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    bounds = np.concatenate([[0], np.cumsum(n)])
    return [s[x:y] for x, y in zip(bounds[:-1], bounds[1:])]


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s, n in _sets(batch.column("text"), size):
                sketches = pa.array([bit_sketch(x).tobytes() if len(x) else None for x in _each(s, n)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(n, pa.int64()), pa.array(_class_ids(s, n), pa.int64()), sketches], ["doc_id", "th", "n_shingles", "id", "p"]
                )

    return run


_BLOCK = "bucket int, whole boolean, keys binary, ids binary"


def _pack(size: int, buckets: int):
    """Blocks of (key, class): one row for each bucket and flush.

    A key that several classes of one flush share is known to be shared: these rows go
    anywhere as they are (whole), and only the least of them stands for the flush in the
    key's bucket.  So a key that a third of all texts carry is spread over all tasks.
    """

    def flush(keys: np.ndarray, ids: np.ndarray, turn: int) -> pa.RecordBatch:
        bucket = (keys >> U(40)) % U(buckets)
        full = (bucket << U(32)) | (keys & U(0xFFFFFFFF))
        order = np.lexsort((ids, full))
        full, ids = full[order], ids[order]
        once = np.ones(len(full), bool)
        once[1:] = (full[1:] != full[:-1]) | (ids[1:] != ids[:-1])
        full, ids = full[once], ids[once]
        first = np.ones(len(full), bool)
        first[1:] = full[1:] != full[:-1]
        group = np.cumsum(first) - 1
        many = np.bincount(group)[group] > 4
        rows = []
        b = (full >> U(32)).astype(np.int64)
        send = first | ~many
        kb, ki, bb = (full[send] & U(0xFFFFFFFF)).astype(np.uint32), ids[send], b[send]
        cuts = np.searchsorted(bb, np.arange(buckets + 1))
        for x in range(buckets):
            if cuts[x + 1] > cuts[x]:
                rows.append((x, False, kb[cuts[x] : cuts[x + 1]].tobytes(), ki[cuts[x] : cuts[x + 1]].tobytes()))
        wk, wi = full[many], ids[many]
        for j, a in enumerate(range(0, len(wk), 20_000)):
            rows.append(((turn * 7919 + j * 31) % buckets, True, wk[a : a + 20_000].tobytes(), wi[a : a + 20_000].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.binary(), pa.binary()))], ["bucket", "whole", "keys", "ids"])

    def run(batches):
        held, total, turn = [], 0, 0
        for batch in batches:
            for _, _, s, n in _sets(batch.column("text"), size):
                keys, who = segment_keys(s, n)
                ids = _class_ids(s, n)
                if len(keys):
                    held.append((keys, ids[who]))
                    total += len(keys)
                    turn += int(ids[0]) & 0xFFFF
                if total >= _FLUSH_KEYS:
                    yield flush(*map(np.concatenate, zip(*held)), turn)
                    held, total = [], 0
        if held:
            yield flush(*map(np.concatenate, zip(*held)), turn)

    return run


def _shared(batches):
    """(key, id, least) of the keys that more than one class of this task's buckets has; least: one id of the key."""

    def out(key, id_):
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        at = np.flatnonzero(first)
        least = np.repeat(np.minimum.reduceat(id_, at), np.diff(np.append(at, len(key)))) if len(key) else id_
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(id_), pa.array(least)], ["key", "id", "least"])

    keys, ids = [], []
    for batch in batches:
        for bucket, whole, k, i in zip(*(batch.column(c).to_pylist() for c in ("bucket", "whole", "keys", "ids"))):
            i = np.frombuffer(i, np.int64)
            if whole:
                yield out(np.frombuffer(k, U), i)
            else:
                keys.append((U(bucket) << U(32)) | np.frombuffer(k, np.uint32).astype(U))
                ids.append(i)
    if not keys:
        return
    key, id_ = np.concatenate(keys), np.concatenate(ids)
    del keys, ids
    order = np.argsort(key, kind="stable")
    key, id_ = key[order], id_[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    differ = np.minimum.reduceat(id_, at) != np.maximum.reduceat(id_, at)
    keep = np.repeat(differ, np.diff(np.append(at, len(key))))
    key, id_ = key[keep], id_[keep]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    cuts = [0, *(int(at[np.searchsorted(at, x)]) for x in range(200_000, len(key), 200_000) if np.searchsorted(at, x) < len(at)), len(key)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield out(key[a:b], id_[a:b])
    del key, id_, order, first, keep
    trim()


def bit_sketch(s: np.ndarray) -> np.ndarray:
    """Parity sketch of two to four bits a shingle, packed; a power of two of bits, so that sketches can be folded."""
    bits = 1 << max(6, int(np.ceil(np.log2(max(1, 2 * len(s))))))
    at = (s & U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8))


def hamming(p: np.ndarray, q: np.ndarray) -> int:
    """Hamming distance of two sketches, the longer folded to the length of the shorter."""
    n = min(len(p), len(q))
    p, q = (np.bitwise_xor.reduce(x.reshape(-1, n), axis=0) for x in (p, q))
    return int(np.bitwise_count(p ^ q).sum())


def _near_sketches(percent: int):
    """Drops pairs whose sketches differ in more bits than the sets of a link may differ in."""

    def run(batches):
        for batch in batches:
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            keep = [
                hamming(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) * (100 + percent) <= (100 - percent) * n
                for x, y, n in zip(batch.column("pa"), batch.column("pb"), total.tolist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_in_groups(percent: int, mode: str):
    """Rows (key, part, role, id, comp, n, p) sorted by (key, part) to what is near in each group.

    Two rows are near if they are of different components and sizes and sketches allow a
    link.  Mode "flags": (key, id) of rows that have a near one.  "forest": (a, b), only so
    many pairs as join what they can join, the nearest first: if all prove to be links, no
    other pair of the group is needed.  "all": (a, b), all pairs.
    Role 0: the group is whole.  Else it is a block of a large group: 1 and 3 are its own
    rows, 2 and 3 those outside the group's largest component, which every block has.
    """

    def ratios(i, home, m, comp, n):
        """Distance of rows i to rows home, over what a link may have; infinite where no link can be or none is needed."""
        far = np.bitwise_count(m[i][:, None, :] ^ m[None, home, :]).sum(2, dtype=np.int64)
        x, y = n[i][:, None], n[home][None, :]
        ok = (comp[i][:, None] != comp[None, home]) & (far * (100 + percent) <= (100 - percent) * (x + y))
        ok &= 100 * np.minimum(x, y) >= percent * np.maximum(x, y)
        return np.where(ok, (far / (x + y)).astype(np.float32), np.float32(np.inf))

    def near(comp, n, p, role):
        """Places of near pairs; in mode "flags" of each row that has one, twice."""
        least = min(map(len, p))
        m = np.stack([x if len(x) == least else np.bitwise_xor.reduce(x.reshape(-1, least), axis=0) for x in p])
        m = m.view(U) if least % 8 == 0 else m
        comp = np.unique(comp, return_inverse=True)[1]
        home = np.flatnonzero(role != 2)
        step = max(1, 4_000_000 // max(1, m.size))
        while len(home):
            # a pair of two components has a member here
            others = np.flatnonzero(role >= 2) if role[0] else np.flatnonzero(comp != np.bincount(comp).argmax())
            edges, flags = [], np.zeros(len(n), bool)
            for at in range(0, len(others), step):
                i = others[at : at + step]
                d = ratios(i, home, m, comp, n)
                if mode == "forest":
                    best = d.argmin(1)
                    value = d[np.arange(len(i)), best]
                    edges += [(v, a, b) for v, a, b in zip(value.tolist(), i.tolist(), home[best].tolist()) if v != np.inf]
                else:
                    x, y = np.nonzero(np.isfinite(d))
                    if mode == "all":
                        yield i[x], home[y]
                    else:
                        flags[i[x]] = flags[home[y]] = True
            if mode == "flags":
                yield np.flatnonzero(flags), np.flatnonzero(flags)
            if not edges:
                return
            root = list(range(int(comp.max()) + 1))

            def find(c):
                while root[c] != c:
                    root[c] = root[root[c]]
                    c = root[c]
                return c

            used = []
            for _, a, b in sorted(edges):
                x, y = find(int(comp[a])), find(int(comp[b]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    used.append((a, b))
            x, y = np.array(used).T
            yield x, y
            comp = np.unique(np.array([find(c) for c in range(len(root))])[comp], return_inverse=True)[1]

    names = ["key", "id"] if mode == "flags" else ["a", "b"]

    def run(batches):
        held, done = [], []

        def out():
            a, b = (np.concatenate(c) for c in zip(*done))
            done.clear()
            if mode != "flags":
                a, b = np.minimum(a, b), np.maximum(a, b)
            pairs = np.unique(np.stack([a, b]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names)

        def groups(table, cuts):
            key, ids, comp, n, role = (table.column(c).to_numpy() for c in ("key", "id", "comp", "n", "role"))
            p = [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("p")]
            for x, y in zip(cuts[:-1], cuts[1:]):
                for a, b in near(comp[x:y], n[x:y], p[x:y], role[x:y]):
                    if len(a):
                        done.append((key[x:y][a] if mode == "flags" else ids[x:y][a], ids[x:y][b]))

        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = (batch.column(c).to_numpy() for c in ("key", "part"))
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            if held and (held[-1].column("key")[-1].as_py(), held[-1].column("part")[-1].as_py()) != (int(key[0]), int(part[0])):
                groups(pa.Table.from_batches(held).combine_chunks(), [0, sum(x.num_rows for x in held)])
                held = []
            if held and len(cuts):
                held.append(batch.slice(0, int(cuts[0])))
                groups(pa.Table.from_batches(held).combine_chunks(), [0, sum(x.num_rows for x in held)])
                held, batch, cuts = [], batch.slice(int(cuts[0])), cuts - cuts[0]
                cuts = cuts[1:]
            if len(cuts):
                groups(pa.Table.from_batches([batch.slice(0, int(cuts[-1]))]), [0, *cuts.tolist()])
                batch = batch.slice(int(cuts[-1]))
            held.append(batch)
            if sum(len(a) for a, _ in done) > 100_000:
                yield out()
        if held:
            groups(pa.Table.from_batches(held).combine_chunks(), [0, sum(x.num_rows for x in held)])
        if done:
            yield out()
        trim()

    return run


def _emit_sets(size: int):
    def run(batches):
        for batch in batches:
            for a, b, s, n in _sets(batch.column("text"), size):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array([x.tobytes() for x in _each(s, n)], pa.binary())], ["id", "s"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _refine(seed: int):
    """Classes (id, s, hot: their hot keys) to (key, id): a key for each hot key and segment of the sketch of this seed."""

    def run(batches):
        for batch in batches:
            hot = batch.column("hot").to_pylist()
            for i, (id_, s) in enumerate(zip(batch.column("id").to_pylist(), batch.column("s"))):
                s = np.frombuffer(s.as_buffer(), U)
                mine = np.unique(segment_keys(s, np.array([len(s)]), seed)[0])
                new = mix((mix(np.array(hot[i], np.int64).view(U))[:, None] ^ mine[None, :]).ravel())
                for c in range(0, len(new), 100_000):
                    part = new[c : c + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), id_, np.int64))], ["key", "id"])

    return run


def _grouped(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, th, n_shingles, id, component_id, group): every row of ``docs``; th: hash of its text, group: null for an empty set."""
    if not 80 <= percent <= 100:
        raise ValueError("percent: 80 to 100")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    named = scratch.save(hashed.mapInArrow(_describe(size), "doc_id long, th long, n_shingles long, id long, p binary"))
    total = named.agg(F.sum("n_shingles")).first()[0] or 0
    if not total:
        return named.select("doc_id", "th", "n_shingles", "id", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("group"))
    width = shuffle_width(spark)
    buckets = max(2 * width, -(-total // 1_000_000))
    blocks = docs.select("text").mapInArrow(_pack(size, int(buckets)), _BLOCK)
    met = scratch.save(blocks.repartitionById(int(max(width, buckets // 2)), F.col("bucket")).mapInArrow(_shared, "key long, id long, least long"))

    # of each class that shares a key: its size, its sketch, and by its hash the text that stands for it
    classes = named.where("id <> 0").groupBy("id").agg(F.min("th").alias("th"), F.max("n_shingles").alias("n"), F.first("p").alias("p"))
    classes = scratch.save(classes.join(met.select("id").distinct(), "id", "left_semi"))
    sketches = classes.select("id", "n", "p")

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, s) of the classes ``ids`` (id).  Copies of a text fall together before they are moved."""
        want = classes.join(ids.distinct(), "id", "left_semi").select("id", "th")
        texts = hashed.where("text is not null").groupBy("th").agg(F.first("text").alias("text"))
        return scratch.save(want.join(texts, "th").select("id", "text").mapInArrow(_emit_sets(size), "id long, s binary"))

    def near(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose sizes and sketches may belong to links."""
        a, b = (sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}")) for x in "ab")
        return pairs.join(a, "a").join(b, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").mapInArrow(_near_sketches(percent), "a long, b long")

    def once(members: DataFrame) -> DataFrame:
        """Of the keys that join the same classes, one; no key of a single class.  ``members`` (key, id) are distinct."""
        same = members.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("h"), F.min("id").alias("lo"), F.max("id").alias("hi"))
        one = same.where("lo <> hi").groupBy("n", "h", "lo", "hi").agg(F.min("key").alias("key")).select("key")
        return members.join(one, "key", "left_semi")

    def opened(members: DataFrame, comp: DataFrame, sets: DataFrame | None, closed: bool = False) -> tuple[DataFrame, DataFrame]:
        """Memberships (key, id, comp, tied), and the rows (key, part, role, id, comp) to be compared, by groups.

        Keys of one component alone are left out, of the memberships only if not ``closed``.  Hot
        keys are refined by the sets of their classes (made here if they are not given).
        """
        kept, compare, level = [], [], 0
        while True:
            rows = scratch.save(members.join(comp, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"), F.col("comp").isNotNull().alias("tied")))
            per_key = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            keys = scratch.save(per_key.where("lo <> hi").select("key", "n"))
            large = keys.where(f"n > {REFINE_CLASSES}").select("key")
            if not large.limit(1).count():
                kept.append(rows if closed else rows.join(keys, "key", "left_semi"))
                compare.append(rows.join(keys, "key", "left_semi").select("key", F.lit(0).alias("part"), F.lit(0).alias("role"), "id", "comp"))
                break
            sums = rows.join(large, "key", "left_semi").groupBy("key", "comp").agg(F.count("*").alias("m")).groupBy("key").agg(F.sum("m").alias("n"), F.max(F.struct("m", "comp")).alias("top"))
            cost = F.col("n") * (F.col("n") - F.col("top.m"))
            sums = scratch.save(sums.select("key", F.col("top.comp").alias("modal"), F.ceil(F.col("n") / REFINE_CLASSES).cast("int").alias("parts"), ((cost > REFINE_PAIRS) & F.lit(level < REFINE_LEVELS)).alias("hot")))
            hot = sums.where("hot").select("key")
            calm = rows.join(hot, "key", "left_anti")
            kept.append(calm if closed else calm.join(keys, "key", "left_semi"))
            compare.append(rows.join(keys.where(f"n <= {REFINE_CLASSES}"), "key", "left_semi").select("key", F.lit(0).alias("part"), F.lit(0).alias("role"), "id", "comp"))
            # a large group in blocks: what lies outside its largest component goes to all of them
            split = rows.join(sums.where("not hot"), "key").withColumn("home", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
            other = F.col("comp") != F.col("modal")
            split = split.withColumn("part", F.explode(F.when(other, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))))
            compare.append(split.select("key", "part", F.when(~other, 1).when(F.col("part") == F.col("home"), 3).otherwise(2).alias("role"), "id", "comp"))
            if not hot.limit(1).count():
                break
            level += 1
            of = scratch.save(rows.join(hot, "key", "left_semi").groupBy("id").agg(F.collect_set("key").alias("hot")))
            sets = sets_of(of.select("id")) if sets is None else sets
            members = scratch.save(once(scratch.save(sets.join(of, "id").mapInArrow(_refine(level), "key long, id long").distinct())))
        return reduce(DataFrame.union, kept), reduce(DataFrame.union, compare)

    def in_groups(compare: DataFrame, mode: str) -> DataFrame:
        rows = compare.join(sketches, "id").select("key", "part", "role", "id", "comp", "n", "p").repartition("key", "part").sortWithinPartitions("key", "part")
        return rows.mapInArrow(_near_in_groups(percent, mode), "key long, id long" if mode == "flags" else "a long, b long").distinct()

    # every class against one class of its keys
    star = met.groupBy("id").agg(F.min("least").alias("m")).where("id <> m").select(F.col("m").alias("a"), F.col("id").alias("b"))
    star = scratch.save(near(star))
    distinct = scratch.save(met.select("key", "id").distinct())
    scratch.drop(met)
    members = scratch.save(once(distinct))
    scratch.drop(distinct)
    # memberships with a near partner: tied ones, and those that the groups show
    rows, compare = opened(members, components(star, scratch), None, closed=True)
    members = scratch.save(rows.where("tied").select("key", "id").union(in_groups(compare, "flags")).distinct())
    members = scratch.save(once(members))
    ends = star.select("a").union(star.select("b")).union(members.select("id")).toDF("id")
    sets = sets_of(ends)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) that are links."""
        full = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
        return full.mapInArrow(_verify(percent), "a long, b long")

    links = scratch.save(verified(star))
    # two rounds of the nearest pairs leave little to compare in full
    for mode in ("forest", "forest", "all"):
        rows, compare = opened(members, components(links, scratch), sets)
        pairs = scratch.save(in_groups(compare, mode))
        if not pairs.limit(1).count():
            break
        members = scratch.save(rows.select("key", "id"))
        links = scratch.save(links.union(verified(pairs)))

    comp = components(links, scratch)
    # the least doc_id of a component
    least = named.where("id <> 0").groupBy("id").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    roots = comp.join(least, "id").groupBy("comp").agg(F.min("least").alias("root"))
    known = scratch.save(comp.join(roots, "comp").select("id", "comp", "root"))
    repeated = least.where("c > 1 or least is null").select("id", "least")
    roots = scratch.save(known.join(repeated, "id", "full").select("id", "comp", F.coalesce("root", "least").alias("root")))
    scratch.drop(sets)
    root = F.coalesce("root", F.when(F.col("id") != 0, F.col("doc_id")), F.col("doc_id"))
    return named.join(roots, "id", "left").select("doc_id", "th", "n_shingles", "id", root.alias("component_id"), F.coalesce("comp", F.when(F.col("id") != 0, F.col("id"))).alias("group"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): every row of ``docs`` (doc_id, text, ...).

    Two texts are linked when ``100 * |A & B| >= percent * |A | B|`` (percent >= 80).
    Null and empty texts have an empty set, are linked with nothing and are their own
    component.  A null doc_id keeps its row, and its text links like any other;
    component_id is the least doc_id that is not null (null if there is none).  Repeated
    doc_ids keep their rows, each with the component of its own text.  Further
    columns of ``docs`` are ignored; an empty table gives an empty one.
    """
    return _grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, whole: of each group of linked texts the one of the least doc_id.

    Null doc_ids come after all others, ties go by a hash of the text.  Texts that are
    linked with nothing stay, empty and null ones too.  Rows that repeat a doc_id and its
    text are one document: one of them stays; different texts of one doc_id are different
    documents.  An empty table gives an empty one.
    """
    rows = _grouped(docs, size, percent)
    best = rows.where("group is not null").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("b")).select("b.doc_id", "b.th")
    stay = best.union(rows.where("group is null").select("doc_id", "th")).select(F.xxhash64("doc_id", "th").alias("__row"))
    keyed = docs.withColumn("__row", F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))))
    return keyed.join(stay.distinct(), "__row", "left_semi").dropDuplicates(["__row"]).drop("__row")
