"""Content-addressed store of token ids.

A document's ids, with the end id, are cut into chunks where a rolling hash of the last ids hits a
mask, within a least and a greatest length, so equal stretches of ids give equal chunks. A chunk's
address is the BLAKE2b digest of its bytes; each distinct chunk is stored once. The store is a
folder of Parquet files:

* ``encoded/kind=chunk``: address, ids (little-endian, 2 bytes where the vocabulary fits, else 4);
* ``encoded/kind=document``: the documents as they were encoded, in no order;
* ``documents``: the recipes in ascending document id: start (ids of all documents before), n_tokens,
  the addresses and lengths of its chunks and their digest, the document's root; range-partitioned into
  parts;
* ``manifest``: for each part its documents, ids and the Merkle root over its documents' leaves, each
  the digest of id, start, n_tokens and root.

Reading first verifies the recipes: every root is computed anew from its addresses and lengths, every
part's Merkle root and counts from its documents, and the store's root from the parts where the caller
states it; what differs from the manifest raises. It then decodes every stored chunk, checks its bytes
against its address, and puts documents together by their recipes; a chunk that is missing or has
another length than the recipe says raises. Checksums of whole documents are composed from the chunks'
checksums and lengths, so that reading moves no ids; ``reconstruct`` returns the ids themselves.

Defined cases: a null or empty text is the end id alone; a null id comes first; rows with one id
are each a document, ordered by checksum; a repeated row repeats its recipe; an empty table gives an
empty store; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairlab.llm.common import bounded_broadcast, cut, new_path, shuffle_partitions, text_slices
from pairlab.llm.tokens import encoder, id_type

#: Fixed values of the file format: chunk lengths in ids, and the mean distance of cuts.
LEAST, MEAN, GREATEST, REACH = 128, 512, 2048, 16
_DIGEST = 16
#: Addresses that a task remembers, to send a repeated chunk's ids once; a bound of memory.
_REMEMBERED = 400_000
#: Documents of a part, about.
_PART_ROWS = 250_000
_SENT = "kind string, address binary, n int, ids binary, doc_id long, n_tokens long, crc long, addresses array<binary>, lengths array<int>, root binary"
_MANIFEST = "part int, documents long, tokens long, root binary"
_NAMES = [f.split()[0] for f in _SENT.split(", ")]
_TYPES = [pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary()]


def address(data: bytes) -> bytes:
    return blake2b(data, digest_size=_DIGEST).digest()


def hits(ids: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end: the hash of the last REACH ids meets the mask.

    The sum of REACH shifted terms is built by doubling. Places within REACH of the start depend on
    what is before, and are never used, for chunks have at least LEAST ids.
    """
    rolling = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(0x9E3779B1)
    rolling ^= rolling >> np.uint32(15)
    step = 1
    while step < REACH:
        moved = rolling[:-step] << np.uint32(step)
        rolling[step:] += moved
        step *= 2
    return np.flatnonzero(rolling >> np.uint32(16) & np.uint32(MEAN - 1) == 0) + 1


def cuts(n: int, places: np.ndarray) -> list[int]:
    """Ends of the chunks of n ids, given the places of hits among them."""
    ends, at, i = [], 0, 0
    places = places.tolist()
    while n - at > LEAST:
        i = bisect_left(places, at + LEAST, i)
        end = places[i] if i < len(places) else n
        at = min(end, at + GREATEST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def document_root(addresses: list[bytes], lengths: list[int]) -> bytes:
    return address(b"".join(addresses) + np.array(lengths, "<i4").tobytes())


def _encode(batches, name: str, end_id: int):
    code, part, number = encoder(name), TaskContext.get().partitionId(), 0
    width = np.dtype(code.dtype).newbyteorder("<")
    seen: set[bytes] = set()
    for b in text_slices(batches):
        keys = b.column(0).to_pylist()
        encoded = [np.append(ids, ids.dtype.type(end_id)).astype(width, copy=False) for ids in code.encode([t or "" for t in b.column(1).to_pylist()])]
        whole = np.concatenate(encoded)
        found, first = hits(whole), 0
        # Places of hits from REACH ids on are the document's own; ends of documents are cuts of their own.
        bounds = np.cumsum([0, *map(len, encoded)])
        lows, highs = np.searchsorted(found, bounds[:-1] + 1).tolist(), np.searchsorted(found, bounds[1:] + 1).tolist()
        chunks, documents = ([], [], []), ([], [], [], [], [], [], [])
        for i, (key, ids) in enumerate(zip(keys, encoded)):
            data, size, at = ids.tobytes(), width.itemsize, 0
            addresses, lengths = [], []
            for end in cuts(len(ids), found[lows[i] : highs[i]] - first):
                piece = data[at * size : end * size]
                own = blake2b(piece, digest_size=_DIGEST).digest()
                addresses.append(own)
                lengths.append(end - at)
                if own not in seen:
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen.add(own)
                    for c, v in zip(chunks, (own, end - at, piece)):
                        c.append(v)
                at = end
            first += len(ids)
            spread = address(f"{part}/{number}".encode())
            number += 1
            for c, v in zip(documents, (spread, key, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), addresses, lengths, document_root(addresses, lengths))):
                c.append(v)
        none, nothing = [None] * len(chunks[0]), [None] * len(keys)
        columns = [
            ["chunk"] * len(chunks[0]) + ["document"] * len(keys), chunks[0] + documents[0], chunks[1] + nothing, chunks[2] + nothing,
            *[none + c for c in documents[1:]],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)


def _once(batches):
    """Of neighbours with one address, the first chunk; all documents."""
    last = None
    for b in batches:
        kinds, addresses = b.column(0).to_pylist(), b.column(1).to_pylist()
        keep = []
        for kind, own in zip(kinds, addresses):
            keep.append(kind != "chunk" or own != last)
            if kind == "chunk":
                last = own
        yield b.filter(pa.array(keep))


def write_store(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> dict:
    """Writes the store to a new folder and returns {path, root, documents, tokens}."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = source.mapInArrow(lambda it: _encode(it, vocabulary, end_id), _SENT)
    # One shuffle takes chunks to their addresses and spreads the recipes, in the same pass over the texts.
    grouped = sent.repartition("address").sortWithinPartitions("kind", "address")
    grouped.mapInArrow(_once, _SENT).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/encoded")
    raw = _kind(spark, path, "document")
    key = F.col("doc_id").asc_nulls_first()
    ordered = raw.select("doc_id", "n_tokens", "crc", "address", "addresses", "lengths", "root")
    parts = max(shuffle_partitions(spark), raw.count() // _PART_ROWS)
    ranged = ordered.repartitionByRange(parts, key, F.col("crc"), F.col("address")).withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row a part
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    running = Window.partitionBy("part").orderBy(key, "crc", "address").rowsBetween(Window.unboundedPreceding, -1)
    recipes = (
        ranged.join(bounded_broadcast(starts, parts), "part")
        .withColumn("start", F.col("part_start") + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
        .select("part", "doc_id", F.col("start").cast("long").alias("start"), "n_tokens", "addresses", "lengths", "root")
        .sortWithinPartitions("part", "start")
    )
    recipes.write.option("compression", "zstd").parquet(f"{path}/documents")

    manifest = _parts(_recipes(spark, path).select("part", "doc_id", "start", "n_tokens", "root"))
    manifest.write.parquet(f"{path}/manifest")
    return _summary(spark, path)


def _parts(documents: DataFrame) -> DataFrame:
    """(part, documents, tokens, root) of each part from its documents' (part, doc_id, start, n_tokens, root)."""

    def roots(pdf):
        import pandas as pd

        pdf = pdf.sort_values("start", kind="stable")
        numbers = zip(pdf["doc_id"].astype("Int64").tolist(), pdf["start"].tolist(), pdf["n_tokens"].tolist())
        leaves = [address(f"{'-' if i is pd.NA else i} {start} {n} ".encode() + root) for (i, start, n), root in zip(numbers, pdf["root"])]
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "documents": [len(pdf)], "tokens": [int(pdf["n_tokens"].sum())], "root": [merkle(leaves)]})

    return documents.groupBy("part").applyInPandas(roots, _MANIFEST)


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def _summary(spark: SparkSession, path: str) -> dict:
    rows = sorted(_manifest(spark, path).collect())  # a row a part
    return {"path": path, "root": merkle([bytes(r.root) for r in rows]).hex(), "documents": sum(r.documents for r in rows), "tokens": sum(r.tokens for r in rows)}


def verify(spark: SparkSession, path: str, root: str | None = None) -> None:
    """Raises ValueError if the recipes don't give the manifest, or the manifest not the stated root."""

    def checked(batches):
        for b in batches:
            d = b.to_pydict()
            for own, addresses, lengths, n in zip(d["root"], d["addresses"], d["lengths"], d["n_tokens"]):
                if document_root(addresses, lengths) != own or sum(lengths) != n:
                    raise ValueError(f"a recipe doesn't match its root {own.hex()}")
            yield b.select(["part", "doc_id", "start", "n_tokens", "root"])

    found = _parts(_recipes(spark, path).mapInArrow(checked, "part int, doc_id long, start long, n_tokens long, root binary"))
    own, told = (x.select("part", F.struct("documents", "tokens", "root").alias(n)) for x, n in ((found, "found"), (_manifest(spark, path), "told")))
    wrong = [r.part for r in own.join(told, "part", "full").filter(~F.col("found").eqNullSafe(F.col("told"))).select("part").limit(5).collect()]
    if wrong:
        raise ValueError(f"the recipes of parts {wrong} don't match the manifest")
    if root is not None and root != _summary(spark, path)["root"]:
        raise ValueError("the manifest doesn't match the store's root")


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node moves up as it is."""
    level = leaves or [address(b"")]
    while len(level) > 1:
        level = [address(b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _kind(spark: SparkSession, path: str, kind: str) -> DataFrame:
    fields = [f for f in _SENT.split(", ") if not f.startswith("kind ")]
    at = f"{path}/encoded/kind={kind}"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    if not there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):  # an empty table
        return spark.createDataFrame([], ", ".join(fields))
    return spark.read.schema(", ".join(fields)).parquet(at)


class _Shift:
    """Checksum of a stretch followed by a given number of zero bytes, as four tables of 256 numbers."""

    def __init__(self):
        self.tables: dict[int, list[list[int]]] = {}

    def __call__(self, crc: int, n_bytes: int) -> int:
        t = self.tables.get(n_bytes) or self._table(n_bytes)
        return t[0][crc & 255] ^ t[1][crc >> 8 & 255] ^ t[2][crc >> 16 & 255] ^ t[3][crc >> 24]

    def _table(self, n: int) -> list[list[int]]:
        zeros = bytes(n)
        base = zlib.crc32(zeros, 0)
        # The checksum is affine in its start, so single bits give the whole map.
        bits = [zlib.crc32(zeros, 1 << i) ^ base for i in range(32)]
        tables = []
        for k in range(4):
            row = [0] * 256
            for v in range(1, 256):
                low = v & -v
                row[v] = row[v ^ low] ^ bits[8 * k + low.bit_length() - 1]
            tables.append(row)
        self.tables[n] = tables
        return tables


_shift = _Shift()


def compose(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of a whole from the (checksum, bytes) of its parts in order."""
    crc = 0
    for own, n in parts:
        crc = _shift(crc, n) ^ own
    return crc


def _contents(b, width: str):
    """(address, number of ids, ids) of a batch of stored chunks, each checked against its address."""
    for own, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
        if address(data) != own:
            raise ValueError(f"a stored chunk doesn't match its address {own.hex()}")
        ids = np.frombuffer(data, width)
        yield own, len(ids), ids


def _decoded(batches, width: str):
    for b in batches:
        out = [(own, n, zlib.crc32(ids.astype("<u4").tobytes())) for own, n, ids in _contents(b, width)]
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int64(), pa.int64()))], names=["address", "n", "crc"])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, doc_id long, start long, n_tokens long, addresses array<binary>, lengths array<int>, root binary").parquet(f"{path}/documents")


def _references(spark: SparkSession, path: str, chunks: DataFrame, value: str) -> DataFrame:
    """(doc_id, start, n_tokens, parts) with the chunks' (k, n, value) in order; a missing or wrong chunk raises."""
    recipes = _recipes(spark, path).select("doc_id", "start", "n_tokens", F.posexplode(F.arrays_zip("addresses", "lengths")).alias("k", "x"))
    refs = recipes.select("doc_id", "start", "n_tokens", "k", F.col("x.addresses").alias("address"), F.col("x.lengths").alias("length"))
    lost = F.raise_error(F.concat(F.lit("a stored chunk is missing or of another length: "), F.hex("address"))).cast("long")
    whole = F.when(F.col("n") == F.col("length"), F.col("n")).otherwise(lost).alias("n")
    return (
        refs.join(chunks, "address", "left").select("doc_id", "start", "n_tokens", "k", whole, value)
        .groupBy("doc_id", "start", "n_tokens").agg(F.sort_array(F.collect_list(F.struct("k", "n", value))).alias("parts"))
    )


def read_digests(spark: SparkSession, path: str, *, width: str = "<u2", root: str | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored chunks; ``root`` is what write_store returned."""
    verify(spark, path, root)
    chunks = _kind(spark, path, "chunk").select("address", "ids").mapInArrow(lambda it: _decoded(it, width), "address binary, n long, crc long")

    def run(batches):
        for b in batches:
            parts = b.column(3).to_pylist()
            tokens = [sum(p["n"] for p in own) for own in parts]
            crcs = [compose([(p["crc"], 4 * p["n"]) for p in own]) for own in parts]
            if tokens != b.column(2).to_pylist():
                raise ValueError("a document's chunks don't have the ids that its recipe says")
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _references(spark, path, chunks, "crc").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def reconstruct(spark: SparkSession, path: str, *, width: str = "<u2", root: str | None = None) -> DataFrame:
    """(doc_id, start, ids) of every document, ids as bytes of the store's width."""
    verify(spark, path, root)

    def checked(batches):
        for b in batches:
            sizes = [x[1] for x in _contents(b, width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(1)], names=["address", "n", "ids"])

    chunks = _kind(spark, path, "chunk").select("address", "ids").mapInArrow(checked, "address binary, n long, ids binary")
    parts = _references(spark, path, chunks, "ids")
    return parts.select("doc_id", "start", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))


def stored_digests(docs: DataFrame, *, path: str | None = None, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, **columns) -> DataFrame:
    """Writes docs to a store and returns what its files hold, as read_digests."""
    spark = docs.sparkSession
    path = path or new_path(spark, "token-store")
    written = write_store(docs, path, vocabulary=vocabulary, end_id=end_id, **columns)
    return read_digests(spark, path, width=np.dtype(id_type(vocabulary)).newbyteorder("<").str, root=written["root"])
