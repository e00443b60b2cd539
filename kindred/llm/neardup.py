"""Operator 5: near duplicates by min-max hashing over shingle sets, each link confirmed on the full sets.

Under each permutation a set keeps both its smallest and its largest hash, so half as many permutations are evaluated
for a signature of a given length. Either end agrees between two sets with the probability of their similarity, and
bands of ``ROWS`` smallest or ``ROWS`` largest values find a pair of similarity 0.8 with a probability of 1 - 1.2e-7.

Texts with one set are one class first. Classes that share a band's bucket are linked in two passes, so that a bucket of
any size never makes all its pairs:

1. Each class is compared with its bucket's most central one, that with the most bucket mates over all its bands.
2. In buckets in which more than one component is left, classes of different components are compared within tasks, in
   tiles of about ``TILE`` classes a side: by sizes and signatures first (a pair 5 standard deviations below the
   threshold is passed over), in one bucket of those that they share, then by the sets. What is connected on the way isn't
   compared again, so what leaves a tile is hardly more than its rows, and no pair is left out.

A comparison reads both whole texts and counts the shingles they share. Components come from minimum labels with
shortcuts. Buckets, links and labels stay in tables; nothing that grows reaches the driver.

Cases: a null or empty text, or one of white space, has an empty set, no links, and is kept. A text of fewer words than a
shingle has one shingle, the whole sequence. Rows of one id are one document, linked
by any of their texts; where those differ, the table is written once with numbers for its rows. A row with a null id takes no part: its
component is null and it is kept. An empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import POSITION, materialize, mix, offsets, release, shingle_sets, slices, strings
from kindred.operators import graphs

PERMUTATIONS, ROWS, TILE = 100, 5, 512
#: Shingles of a tile's side, about; a tile of longer texts has fewer classes.
TILE_SHINGLES = 1 << 20
#: Standard deviations below the threshold at which a signature's estimate rules a pair out.
SIGMAS = 5.0

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: the smallest and the largest value under each permutation (sets by permutations)."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    low, high = np.empty((len(sets), PERMUTATIONS), np.uint64), np.empty((len(sets), PERMUTATIONS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PERMUTATIONS):
            x = flat * _A[k] + _B[k]
            x ^= x >> np.uint64(32)
            low[:, k], high[:, k] = np.minimum.reduceat(x, starts), np.maximum.reduceat(x, starts)
    return low, high


def bands(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One 64-bit key a band (sets by bands); the band's number is part of the key."""
    with np.errstate(over="ignore"):
        keys = [(x[:, k : k + ROWS] * POSITION[:ROWS]).sum(axis=1, dtype=np.uint64) + POSITION[40] * np.uint64(k + 1000 * e) for e, x in enumerate((low, high)) for k in range(0, PERMUTATIONS, ROWS)]
        return mix(np.stack(keys, axis=1)).view(np.int64)


def sketch(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles; and where the set isn't empty its digest, its bands' keys and a byte for each value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch, column in slices(batches):
            sets = shingle_sets(column, words)
            full = [k for k, s in enumerate(sets) if len(s)]
            digest, keys, sign = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                low, high = signatures([sets[k] for k in full])
                rows = bands(low, high)
                short = (np.concatenate([low, high], axis=1) & np.uint64(255)).astype(np.uint8)
                for i, k in enumerate(full):
                    digest[k], keys[k], sign[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), rows[i], short[i].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sign, pa.binary())], ["doc_id", "n_shingles", "digest", "keys", "sign"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, sign binary")


def _alike(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """How many signature values of two sets agree, 0 where sizes or signatures rule the pair out."""
    t = percent / 100
    least = 2 * PERMUTATIONS * (t - SIGMAS * (t * (1 - t) / (2 * PERMUTATIONS)) ** 0.5)
    same = (a == b).sum(axis=-1)
    return np.where((100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (same >= least), same, 0)


def _signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sizes and signatures don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                keep = _alike(_signs(x.column(2)), _signs(x.column(3)), x.column(4).to_numpy(), x.column(5).to_numpy(), percent) > 0
                yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(keep)), x.column(1).filter(pa.array(keep))], ["a", "b"])

    left = classes.select(F.col("x").alias("a"), F.col("sign").alias("sa"), F.col("n").alias("na"))
    right = classes.select(F.col("x").alias("b"), F.col("sign").alias("sb"), F.col("n").alias("nb"))
    near = pairs.join(right, "b").filter("b IS NOT NULL").join(left, "a").filter(F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb"))
    return near.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _narrowed(docs: DataFrame, ids: DataFrame, bits: int = 24) -> DataFrame:
    """The rows of ``docs`` whose id is in ``ids``; a bitmap of 2^bits hashed ids (2 MB, however many ids) spares most
    others the shuffle."""
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    # 4096 bits a row.
    word = lambda c: (place(c) / 64).cast("long") % 64
    bitmap = ids.select((place(F.col("x")) / 4096).cast("int").alias("page"), word(F.col("x")).alias("w"), F.expr(f"shiftleft(cast(1 as bigint), cast(pmod(xxhash64(x), {1 << bits}) % 64 as int))").alias("bit"))
    words = bitmap.groupBy("page", "w").agg(F.bit_or("bit").alias("bit"))
    pages = words.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("w", "bit"))).alias("words"))
    table = pages.select("page", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.element_at("words", k.cast("long")), F.lit(0).cast("long"))).alias("bits"))
    at = docs.withColumn("page", (place(F.col("doc_id")) / 4096).cast("int")).join(F.broadcast(table), "page")
    hit = F.expr(f"shiftrightunsigned(bits[cast(floor(pmod(xxhash64(doc_id), {1 << bits}) / 64) % 64 as int)], cast(pmod(xxhash64(doc_id), {1 << bits}) % 64 as int)) & 1 = 1")
    return at.filter(hit).select("doc_id", "text").join(ids.select(F.col("x").alias("doc_id")), "doc_id", "left_semi")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose whole shingle sets reach the threshold."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("x")).distinct())
    # Nothing stands between the joins and their shuffles, so adaptive execution can split a text with very many pairs.
    texts = _narrowed(docs, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for x, tb in slices(batches, "tb"):
            # The pairs come sorted by a, so one that has very many is hashed once a slice.
            _, first, which = np.unique(x.column(0).to_numpy(), return_index=True, return_inverse=True)
            left, right = shingle_sets(strings(x.column(2).take(pa.array(first))), words), shingle_sets(tb, words)
            keep = []
            for k, t in zip(which.tolist(), right, strict=True):
                both = np.intersect1d(left[k], t, assume_unique=True).size
                keep.append(both > 0 and 100 * both >= percent * (len(left[k]) + len(t) - both))
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(keep)), x.column(1).filter(pa.array(keep))], ["a", "b"])

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(x, c) for every end x of a link (a, b), always in rounds: links grow with the documents."""
    return graphs.components(links, small=0)


def _tiled(entries: DataFrame) -> DataFrame:
    """Entries (key, band, m, x, ...) dealt to tiles of their bucket, each tile to its pairs with the others."""
    tiles = F.ceil(F.col("m") / F.lit(TILE)).cast("int")
    placed = entries.withColumn("t", tiles).withColumn("i", F.pmod(F.xxhash64("x", "key"), F.col("t")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    own = [c for c in entries.columns if c not in ("key", "m")]
    return placed.select("key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("side"), *own).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")


def _by_tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (key, lo, hi), a table for each; one may span batches."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table) -> Iterator[pa.Table]:
        table = table.combine_chunks()
        ids = [table.column(k).to_numpy() for k in range(3)]
        at = (np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1).tolist()
        for s, e in zip([0, *at], [*at, table.num_rows], strict=True):
            yield table.slice(s, e - s)

    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch.column(k).to_numpy() for k in range(3)]
        last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in ids]))
        at = int(last[-1]) + 1 if len(last) else 0
        if held and at == 0 and all(held[0].column(k)[0].as_py() == ids[k][0] for k in range(3)):
            held.append(batch)
            continue
        whole = [*held, batch.slice(0, at)]
        if sum(b.num_rows for b in whole):
            yield from cut(pa.Table.from_batches(whole))
        held = [batch.slice(at)]
    if held:
        yield from cut(pa.Table.from_batches(held))


def _open_pairs(t: pa.Table, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of a tile (.., side, band, x, c, n, sign, keys, ..): for a row, the rows to compare it with. They are in other
    components, alike, and share no bucket of a lower band, in which the pair is compared instead."""
    side, band, x, c, n = (t.column(k).to_numpy() for k in range(3, 8))
    if c.min() == c.max():
        return
    sign, keys = _signs(t.column(8).combine_chunks()), t.column(9).combine_chunks().flatten().to_numpy().reshape(len(x), -1)
    rows = np.arange(len(x))
    diagonal = t.column(1)[0].as_py() == t.column(2)[0].as_py()
    left, right = (rows, rows) if diagonal else (rows[~side], rows[side])
    # Rows of small components first, each against all others: the largest component's rows meet no one but those.
    names, size = np.unique(c, return_counts=True)
    big = names[size.argmax()]
    for i in left.tolist():
        if diagonal and c[i] == big:
            continue
        other = right[c[right] != c[i]]
        if diagonal:
            other = other[(c[other] == big) | (x[other] > x[i])]
        other = other[_alike(sign[i], sign[other], n[i], n[other], percent) > 0] if len(other) else other
        if len(other):
            yield i, other[(keys[i] == keys[other]).argmax(axis=1) == band[i]]


def _needed(entries: DataFrame, percent: int) -> DataFrame:
    """(key, x) of the entries that have something to be compared with in their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_tile(batches):
            used: set[int] = set()
            for i, other in _open_pairs(t, percent):
                if len(other):
                    used.update(other.tolist())
                    used.add(i)
            if used:
                k = pa.array(sorted(used))
                yield pa.RecordBatch.from_arrays([t.column(0).take(k).combine_chunks(), t.column(5).take(k).combine_chunks()], ["key", "x"])

    return _tiled(entries).mapInArrow(run, "key long, x long").distinct()


def margin(n: int, m: int, percent: int) -> float:
    """By how much 100 times the shingles of two sets that agree in 32 bits must exceed the threshold before the sets are
    surely alike: n * m / 2^32 are expected to agree by chance, 8 standard deviations more and some are allowed for."""
    chance = n * m / 2**32
    return 1000 + (100 + percent) * (chance + 8 * chance**0.5)


def _cross(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a bucket and whose sets, by 32 bits of each shingle, reach the
    threshold. Those that joins in the same tile connect already are left out, so a tile gives hardly more pairs than it
    has rows. ``entries``: (key, m, band, x, c, n, sign, keys, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_tile(batches):
            x, c, n = (t.column(k).to_numpy() for k in range(5, 8))
            sets = t.column(10).combine_chunks().cast(pa.large_binary())
            starts = offsets(sets) // 4
            own = np.frombuffer(sets.buffers()[2], np.uint32)[starts[0] : starts[-1]]
            starts = starts - starts[0]
            words = np.unique(own)
            place = np.searchsorted(words, own).astype(np.int32)
            mark = np.zeros(len(words), bool)
            parent = {v: v for v in c.tolist()}

            def root(v: int, parent=parent) -> int:
                while parent[v] != v:
                    parent[v] = parent[parent[v]]
                    v = parent[v]
                return v

            out = []
            for i, other in _open_pairs(t, percent):
                other = [k for k in other.tolist() if root(int(c[k])) != root(int(c[i]))]
                if not other:
                    continue
                own = place[starts[i] : starts[i + 1]]
                mark[own] = True
                if len(other) > len(x) // 4:
                    both = np.add.reduceat(mark[place], starts[:-1], dtype=np.int64)[other]
                else:
                    both = np.array([np.count_nonzero(mark[place[starts[k] : starts[k + 1]]]) for k in other])
                mark[own] = False
                over = 100 * both - percent * (n[i] + n[other] - both)
                for k, more in zip(other, over.tolist(), strict=True):
                    a, b = root(int(c[i])), root(int(c[k]))
                    if more >= 0 and a != b:
                        out.append((int(x[i]), int(x[k])))
                        # 32 bits may count shingles too many, so a pair close to the threshold joins nothing yet.
                        if more >= margin(int(n[i]), int(n[k]), percent):
                            parent[max(a, b)] = min(a, b)
            if out:
                a, b = zip(*{(min(p), max(p)) for p in out}, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _tiled(entries).mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(x, set): 32 bits of each shingle of the documents ``ids`` (x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, column in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in shingle_sets(column, words)], pa.binary())], ["x", "set"])

    return _narrowed(docs, ids).mapInArrow(run, "x long, set binary")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links) and kept, for every row."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    sketches = materialize(sketch(docs, words))
    several = sketches.filter("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).filter("a <> b")
    if several.isEmpty():
        return _linked(sketches, docs, words, percent)
    # Ids with different texts: rows are linked under numbers of their own, and ids over the components of their rows.
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"))
    single = rows.filter("doc_id IS NOT NULL").select(F.col("row").alias("doc_id"), "text")
    found = _linked(materialize(sketch(single, words)), single, words, percent).select(F.col("doc_id").alias("row"), "n_shingles", "component_id")
    own = materialize(found.join(rows.select("row", "doc_id"), "row"))
    least = own.groupBy("component_id").agg(F.min("doc_id").alias("b"))
    joined = components(own.filter("n_shingles > 0").join(least, "component_id").select(F.col("doc_id").alias("a"), "b"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    out = own.join(joined, own["doc_id"] == joined["x"], "left").select("doc_id", "n_shingles", component.alias("component_id"))
    rest = sketches.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"))
    return out.union(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _linked(sketches: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The same for documents whose ids have one set each."""
    linked = sketches.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    # One class a set; a group of copies is summed up before it is shuffled.
    reps = materialize(linked.groupBy("digest").agg(F.min("doc_id").alias("x")))
    classes = materialize(
        linked.select("doc_id", "digest", "keys", "sign", F.col("n_shingles").alias("n")).join(reps, (linked["digest"] == reps["digest"]) & (linked["doc_id"] == reps["x"])).select("x", "n", "keys", "sign").dropDuplicates(["x"])
    )
    entries = classes.select(F.posexplode("keys").alias("band", "key"), "x", "n")
    # A bucket's weight: its classes, or by its shingles as many as would fill as many tiles.
    sizes = entries.groupBy("key").agg(F.count("*").alias("k"), F.sum("n").alias("n")).filter("k > 1").select("key", F.greatest("k", F.ceil(F.col("n") / F.lit(TILE_SHINGLES / TILE))).alias("m"), "k")
    shared = materialize(entries.drop("n").join(sizes, "key").select("key", "m", "k", "band", "x"))
    center = shared.groupBy("x").agg(F.sum("k").alias("w"))
    weighed = shared.join(center, "x")
    leaders = weighed.groupBy("key").agg(F.min(F.struct((-F.col("w")).alias("w"), "x"))["x"].alias("a"))
    pairs = shared.join(leaders, "key").filter("a <> x").select(F.least("a", "x").alias("a"), F.greatest("a", "x").alias("b")).distinct()
    first = materialize(_confirmed(materialize(_plausible(pairs, classes.select("x", "n", "sign"), percent)), docs, words, percent))
    # What shares a bucket and isn't connected yet.
    named = shared.join(components(first), "x", "left").withColumn("c", F.coalesce("c", "x"))
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).filter("c0 <> c1").select("key")
    open_ = materialize(named.join(mixed, "key").select("key", "m", "band", "x", "c"))
    full = open_.join(classes, "x").select("key", "m", "band", "x", "c", "n", "sign", "keys")
    needed = materialize(_needed(full, percent))
    ids = materialize(needed.select("x").distinct())
    own = full.join(needed, ["key", "x"]).join(_sets(docs, ids, words), "x").select("key", "m", "band", "x", "c", "n", "sign", "keys", "set")
    second = materialize(_confirmed(materialize(_cross(own, percent)), docs, words, percent))
    found = components(first.union(second))
    named = reps.join(found, "x", "left").select("digest", F.coalesce("c", "x").alias("c"))
    out = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest")).join(named, "digest", "left")
    component = F.coalesce("c", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
