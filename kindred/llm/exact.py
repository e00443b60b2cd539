"""Operator 7: exact deduplication by a cuckoo-filter index of live digests.

A digest is the SHA-256 of a text's UTF-8 bytes. A cuckoo filter keeps a 16-bit fingerprint of each live digest in one of
two buckets of four slots; a fingerprint that is absent proves a digest new. A hit is only a hint: it is verified against
the bucketed content, which holds the whole digest, the length and the row that stays for each fingerprint's bucket.
When insertion finds no slot, the filter is doubled and rebuilt from those stored keys. Deletion removes one fingerprint
and its key, so a digest whose last row goes is new again.

Deduplication indexes each input partition on its own first, so that a group of copies sends one row from each partition
(or from each ``HELD`` digests of it), then indexes the digests of each shard, of which there are as many as the rows that
were sent ask for. An index thus has a bounded size, however large the table is.

Cases: a null text counts as empty, and all empty texts are equal. Of rows with equal ids and equal texts one stays, and
both rows say so. A null id loses to any other and is kept where the group has no other. An empty table gives an empty
result. Only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import materialize

SLOTS, KICKS = 4, 400
#: Digests that one index holds at a time, and rows that are dealt to one shard on average.
HELD, SHARD = 200_000, 50_000


class CuckooIndex:
    """A set of live digests, each with a value: lookups by fingerprint, verified by the stored key.

    ``store[b]`` holds the content of bucket ``b`` by whole key, so a verified lookup reads no other bucket."""

    def __init__(self, expected: int = 64):
        self._make(max(1, int(expected / (SLOTS * 0.9))))
        self.resized = 0

    def _make(self, buckets: int) -> None:
        self.buckets = 1 << (buckets - 1).bit_length() if buckets > 1 else 1
        self.table = [[] for _ in range(self.buckets)]
        self.store: list[dict[bytes, object]] = [{} for _ in range(self.buckets)]
        self.live = 0

    def _places(self, key: bytes) -> tuple[int, int, int]:
        print_ = int.from_bytes(key[:2], "little") or 1
        one = int.from_bytes(key[8:16], "little") % self.buckets
        return print_, one, self._other(print_, one)

    def _other(self, print_: int, bucket: int) -> int:
        return bucket ^ ((print_ * 0x5BD1E995) % self.buckets)

    def get(self, key: bytes):
        """The value of a live key, or None."""
        print_, one, two = self._places(key)
        for b in {one, two}:
            if print_ in self.table[b] and key in self.store[b]:
                return self.store[b][key]
        return None

    def insert(self, key: bytes, value: object) -> bool:
        """Makes ``key`` live with ``value``; False, and the value replaced, where it is live."""
        print_, one, two = self._places(key)
        for b in (one, two):
            if print_ in self.table[b] and key in self.store[b]:
                self.store[b][key] = value
                return False
        while not self._place(key, value):
            self._resize()
        return True

    def _place(self, key: bytes, value: object) -> bool:
        print_, one, two = self._places(key)
        for b in (one, two):
            if len(self.table[b]) < SLOTS:
                self.table[b].append(print_)
                self.store[b][key] = value
                self.live += 1
                return True
        # Evict along a path; undone as a whole where it finds no free slot.
        bucket, held, moved = two, (print_, key, value), []
        for k in range(KICKS):
            slot = (k + held[0]) % SLOTS
            out = self.table[bucket][slot]
            gone = next(x for x in self.store[bucket] if (int.from_bytes(x[:2], "little") or 1) == out)
            moved.append((bucket, slot, out, gone, held))
            leaves = (out, gone, self.store[bucket].pop(gone))
            self.table[bucket][slot] = held[0]
            self.store[bucket][held[1]] = held[2]
            held, bucket = leaves, self._other(out, bucket)
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(held[0])
                self.store[bucket][held[1]] = held[2]
                self.live += 1
                return True
        for at, slot, out, gone, came in reversed(moved):
            self.store[at].pop(came[1])
            self.table[at][slot] = out
            self.store[at][gone], held = held[2], came
        return False

    def _resize(self) -> None:
        kept = [x for s in self.store for x in s.items()]
        buckets = self.buckets * 2
        while True:
            self._make(buckets)
            self.resized += 1
            if all(self._place(k, v) for k, v in kept):
                return
            buckets *= 2

    def delete(self, key: bytes) -> bool:
        """Removes a live key; False where it isn't live, and then nothing changes."""
        print_, one, two = self._places(key)
        for b in {one, two}:
            if print_ in self.table[b] and key in self.store[b]:
                self.table[b].remove(print_)
                del self.store[b][key]
                self.live -= 1
                return True
        return False

    def items(self) -> Iterator[tuple[bytes, object]]:
        for s in self.store:
            yield from s.items()


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the 32 bytes of the text's digest, and its length in bytes."""
    text = F.coalesce(docs[text_col], F.lit(""))
    return docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))


def _largest(a, b):
    return b if a is None else a if b is None else max(a, b)


def _rows(index: CuckooIndex) -> Iterator[pa.RecordBatch]:
    rows = list(index.items())
    for at in range(0, len(rows), 10_000):
        part = rows[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.binary()), *(pa.array([v[c] for _, v in part], pa.int64()) for c in range(3))], ["digest", "n_bytes", "doc_id", "n"])


def _indexed(held: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each digest of a partition a row with the largest id and the sum of the counts; where ``held`` is given, for
    each digest among as many, after which a new index begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex(1024)
        for b in batches:
            for key, n_bytes, doc, n in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                found = index.get(key)
                if found is None:
                    if held is not None and index.live >= held:
                        yield from _rows(index)
                        index = CuckooIndex(held)
                    index.insert(key, [n_bytes, doc, n])
                else:
                    if found[0] != n_bytes:
                        raise ValueError("two texts of different lengths have one SHA-256")
                    found[1], found[2] = _largest(found[1], doc), found[2] + n
        yield from _rows(index)

    return run


KEPT = "digest binary, n_bytes long, doc_id long, n long"


def groups(found: DataFrame) -> DataFrame:
    """(digest, n_bytes, doc_id, n) for rows of :func:`digests`: the row that stays and the size of each group."""
    local = materialize(found.select("digest", "n_bytes", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(_indexed(HELD), KEPT))
    # By now a group of any size is a few rows a partition.
    return local.repartition(max(1, -(-local.count() // SHARD)), "digest").mapInArrow(_indexed(None), KEPT)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; the largest id of equal texts stays.

    Rows of a group whose ids are equal are all marked as kept; :func:`survivors` keeps one of them."""
    found = digests(docs, id_col, text_col)
    # The join deals rows out by digest; adaptive execution splits the partition of a hot one.
    kept = groups(found).select("digest", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    return found.join(kept, "digest").select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with equal ids and texts, one."""
    names = docs.columns
    inside = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), docs[id_col].alias("doc_id"), F.unhex(F.sha2(F.coalesce(docs[text_col], F.lit("")).cast("binary"), 256)).alias("digest"))
    found = digests(docs, id_col, text_col)
    kept = groups(found).select(F.col("digest").alias("own"), F.col("doc_id").alias("keep_id"), "n")
    same = inside.join(kept, (inside["digest"] == kept["own"]) & inside["doc_id"].eqNullSafe(kept["keep_id"]))
    # Ids repeat rarely; only where a group has more rows than one can there be two of one id and text.
    alone = same.filter("n = 1").select("row.*")
    several = same.filter("n > 1").groupBy("digest", "doc_id").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return alone.unionByName(several)


# The index as a table that outlives a run: rows (shard, digest, doc_id), one for each live digest.


def shard(column, shards: int):
    return F.pmod(F.xxhash64(column), F.lit(shards)).cast("int")


def build(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of all texts of ``docs``: shard, digest, n_bytes, doc_id (the row that stays) and n (live rows)."""
    return groups(digests(docs, id_col, text_col)).withColumn("shard", shard(F.col("digest"), shards)).select("shard", "digest", "n_bytes", "doc_id", "n")


def apply_changes(index: DataFrame, changes: DataFrame, shards: int, live: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index after ``changes`` (digest, n_bytes, doc_id, n): n rows of a digest are added, or removed where n < 0.

    Changes are summed by digest first, so each shard reads a digest once. Where a digest's live rows sum to none it is
    deleted. Where rows remain, a larger id that came replaces the row that stays; where the row that stays went, the
    largest id takes its place among the rows of that text in ``live``, the documents after the changes."""
    came, went = F.when(F.col("n") > 0, F.col("doc_id")), F.when(F.col("n") < 0, F.col("doc_id"))
    summed = changes.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max(came).alias("doc_id"), F.max(went).alias("gone"), F.sum("n").alias("n")).withColumn("shard", shard(F.col("digest"), shards))
    hurt = summed.filter("gone IS NOT NULL").select("digest", "gone").join(index.select("digest", F.col("doc_id").alias("old")), "digest").filter("gone >= old").select("digest")
    heirs = digests(live, id_col, text_col).join(hurt, "digest").groupBy("digest").agg(F.max("doc_id").alias("heir"))
    index = index.join(heirs, "digest", "left").withColumn("doc_id", F.coalesce("heir", "doc_id"))
    both = index.select("shard", "digest", "n_bytes", "doc_id", "n", F.lit(0).alias("step")).unionByName(summed.select("shard", "digest", "n_bytes", "doc_id", "n", F.lit(1).alias("step")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("step", kind="stable")
        own = CuckooIndex(int((frame["step"] == 0).sum()))
        for key, n_bytes, doc, n in zip(frame["digest"], frame["n_bytes"], frame["doc_id"], frame["n"], strict=True):
            doc = None if pd.isna(doc) else int(doc)
            found = own.get(key)
            if found is None:
                if n > 0:
                    own.insert(key, [int(n_bytes), doc, int(n)])
            else:
                found[1], found[2] = _largest(found[1], doc), found[2] + int(n)
                if found[2] <= 0:
                    own.delete(key)
        rows = [(int(frame["shard"].iat[0]), k, *v) for k, v in own.items()]
        return pd.DataFrame(rows, columns=["shard", "digest", "n_bytes", "doc_id", "n"]).astype({"doc_id": "Int64"})

    return both.groupBy("shard").applyInPandas(run, "shard int, digest binary, n_bytes long, doc_id long, n long")


def changes(docs: DataFrame, sign: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Insertions (sign 1) or deletions (sign -1) of the rows of ``docs`` for :func:`apply_changes`."""
    found = digests(docs, id_col, text_col)
    return found.groupBy("digest").agg(F.max("n_bytes").alias("n_bytes"), F.max("doc_id").alias("doc_id"), (F.lit(sign) * F.count("*")).cast("long").alias("n"))


def is_known(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and known: whether the index holds the row's text. A probe of fewer columns; adaptive execution splits hot digests."""
    found = digests(docs, id_col, text_col)
    return found.join(index.select("digest", F.lit(True).alias("hit")), "digest", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("known"))

