"""A content-addressed store of token ids.

Format, under one folder:

* ``chunks``: address (BLAKE2b-128 of the payload), n, payload (little-endian unsigned ids of ``width`` bytes).  A
  rolling hash over the last ``WINDOW`` ids cuts each document's ids into chunks of about 600; each distinct chunk is
  stored once.
* ``recipes``: in ascending doc_id order, part after part: doc_id, its part and place, ids before it in its part,
  number of ids, chunk addresses and lengths, and the Merkle root over its number of ids and addresses.
* ``blocks``: a row for each ``BLOCK`` documents of a part: how many, their ids, and the Merkle root over theirs.
* ``manifest``: a row for each part (documents, ids, ids before the part, Merkle root over its blocks) and one Merkle
  root over all parts.

Reading (``verify``, called by ``digest`` and ``decode``) checks the root against the parts, each part against its
blocks and each block against the recipes, with counts; then every recipe against its own root and every payload
against its address.  A row that is missing, added, moved or changed anywhere raises.  CRCs of documents are composed
from those of their stored chunks, since CRC-32 is linear.  ``decode`` gives the ids themselves.

Nulls are empty texts (the end id alone); repeated rows are documents of their own that share all chunks; a null
doc_id comes first; ties in doc_id go by number of ids, then a hash of the addresses, then the place where they were
read, and parts may divide them, so no doc_id is too frequent.  An id that ``width`` cannot hold raises.  A document's ids, and its row of addresses,
must fit in memory (a cell of at most 2 GB).  Empty tables give an empty store.  Only doc_id and text are read, so
other columns never clash.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encode import Encoder, in_parts
from .kernels import lean, mix
from .shared import drop, new_path, shuffle_partitions, staged

WINDOW, LEAST, MEAN_BITS, MOST, BLOCK = 16, 64, 9, 4096, 4096
_STEP, _WORD, _RUN = 0x9E3779B97F4A7C15 | 1, 2**64 - 1, 1 << 15
ENCODED = "doc_id long, n_tokens long, addresses array<binary>, sizes array<int>, payloads array<binary>"
RECIPE = "doc_id long, part int, place long, before long, n_tokens long, addresses array<binary>, sizes array<int>, root binary"
BLOCKS = "part int, block long, documents long, ids long, root binary"


def rolling_marks(ids: np.ndarray) -> np.ndarray:
    """Ends, ascending, of the windows of WINDOW ids whose rolling hash asks for a cut.

    The hash of a window is a polynomial; that of 2k ids comes from two of k ids.  Blocks fit the processor's cache."""
    out = []
    for a in range(0, max(len(ids) - WINDOW + 1, 0), _RUN):
        rolled, size, step = mix(ids[a : a + _RUN + WINDOW - 1].astype(np.uint64) + np.uint64(1)), 1, _STEP
        while size < WINDOW:
            rolled = rolled[:-size] * np.uint64(step) + rolled[size:]
            size, step = 2 * size, (step * step) & _WORD
        out.append(np.flatnonzero((mix(rolled) >> np.uint64(64 - MEAN_BITS)) == 0) + a + WINDOW)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def chunk_ends(marks: list[int], start: int, stop: int) -> list[int]:
    """Ends of the chunks of the document at start:stop: the marks that leave no chunk under LEAST or over MOST.  A mark
    that counts is at least LEAST ids into the document, so its window never reaches into another one."""
    out = []
    for end in marks:
        while end - start > MOST:
            start += MOST
            out.append(start)
        if end - start >= LEAST and end < stop:
            out.append(end)
            start = end
    while stop - start > MOST:
        start += MOST
        out.append(start)
    if stop > start:
        out.append(stop)
    return out


def cut_points(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document, by content alone."""
    return chunk_ends(rolling_marks(ids).tolist(), 0, len(ids))


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over leaves; an odd last node moves up unchanged."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [bytes(16)]
    while len(level) > 1:
        paired = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = paired + level[len(level) - len(level) % 2 :]
    return level[0]


def document_root(n_tokens: int, addresses: list[bytes]) -> bytes:
    return merkle_root([n_tokens.to_bytes(8, "little"), *addresses])


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    dtype = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, met = Encoder.of(tokenizer), set()
        for batch in batches:
            texts = batch.column("text")
            for a, b in in_parts(texts):
                ids, stops = encoder.flat(texts.slice(a, b - a), end_id)
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise ValueError(f"id {int(ids.max())} does not fit {width} bytes")
                marks = rolling_marks(ids)
                bound = np.searchsorted(marks, stops).tolist()
                marks, raw = marks.tolist(), ids.astype(dtype, copy=False).tobytes()
                names, payloads, lengths, offsets, start, low = [], [], [], [0], 0, 0
                for stop, high in zip(stops.tolist(), bound):
                    for end in chunk_ends(marks[low:high], start, stop):
                        payload = raw[start * width : end * width]
                        name = address(payload)
                        names.append(name)
                        lengths.append(end - start)
                        payloads.append(None if name in met else payload)  # one task need not send a chunk twice
                        met.add(name)
                        start = end
                    offsets.append(len(names))
                    start, low = stop, high
                if len(met) > 500_000:
                    met.clear()
                at = pa.array(offsets, pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(x, t)) for x, t in ((names, pa.binary()), (lengths, pa.int32()), (payloads, pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(np.diff(stops, prepend=0)), *lists], ["doc_id", "n_tokens", "addresses", "sizes", "payloads"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), ENCODED)


def _recipes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, place, before = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        n = len(batch)
        totals = batch.column("n_tokens").to_numpy(zero_copy_only=False)
        ends = before + np.cumsum(totals)
        roots = [document_root(t, leaves) for t, leaves in zip(totals.tolist(), batch.column("addresses").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.full(n, part, np.int32)), pa.array(np.arange(place, place + n)), pa.array(ends - totals), batch.column("n_tokens"), batch.column("addresses"), batch.column("sizes"), pa.array(roots, pa.binary())],
            ["doc_id", "part", "place", "before", "n_tokens", "addresses", "sizes", "root"],
        )
        place, before = place + n, int(ends[-1]) if n else before


def _block_roots(recipes: DataFrame) -> DataFrame:
    """part, block, documents, ids, root from the recipes as they are; a gap in places or in running counts raises.  A
    group has BLOCK rows of some forty bytes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        place, before, n = (table.column(c).to_numpy() for c in ("place", "before", "n_tokens"))
        whole = (place == key[1].as_py() * BLOCK + np.arange(len(place))).all() and (before[1:] == before[:-1] + n[:-1]).all()
        if not whole:
            raise ValueError(f"recipes of part {key[0].as_py()}, block {key[1].as_py()} are missing, repeated or moved")
        root = merkle_root(table.column("root").to_pylist())
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "documents": pa.array([len(place)], pa.int64()), "ids": pa.array([int(n.sum())], pa.int64()), "root": pa.array([root], pa.binary())})

    rows = recipes.select("part", F.floor(F.col("place") / BLOCK).alias("block"), "place", "before", "n_tokens", "root")
    return rows.groupBy("part", "block").applyInArrow(run, BLOCKS)


def _part_rows(blocks: DataFrame) -> list[tuple]:
    """(part, documents, ids, root over its blocks), ascending.  One row a partition leaves the cluster: as many as
    there are shuffle partitions, however large the input."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        if (table.column("block").to_numpy() != np.arange(len(table))).any():
            raise ValueError(f"blocks of part {key[0].as_py()} are missing, repeated or moved")
        sums = [[int(table.column(c).to_numpy().sum())] for c in ("documents", "ids")]
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "documents": pa.array(sums[0], pa.int64()), "ids": pa.array(sums[1], pa.int64()), "root": pa.array([merkle_root(table.column("root").to_pylist())], pa.binary())})

    rows = blocks.groupBy("part").applyInArrow(run, "part int, documents long, ids long, root binary").collect()
    return sorted((r.part, r.documents, r.ids, bytes(r.root)) for r in rows)


MANIFEST = "part int, documents long, ids long, offset long, part_root binary, root binary, width int"


def _manifest_rows(parts: list[tuple], width: int) -> list[tuple]:
    root, offset, out = merkle_root([p[3] for p in parts]), 0, []
    for part, documents, ids, part_root in parts:
        out.append((part, documents, ids, offset, part_root, root, width))
        offset += ids
    return out


def write(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, width: int = 2) -> None:
    """Write the store of ``docs`` to ``path``.  width: bytes an id, 2 if all ids are below 65536, else 4."""
    spark = docs.sparkSession
    encoded = staged(_encoded(docs, tokenizer, end_id, width), "store-encoded")
    pair = F.explode(F.arrays_zip("addresses", "sizes", "payloads")).alias("c")
    chunks = encoded.select(pair).where("c.payloads IS NOT NULL").select(F.col("c.addresses").alias("address"), F.col("c.sizes").alias("n"), F.col("c.payloads").alias("payload"))
    chunks.dropDuplicates(["address"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    order = (F.col("doc_id").asc_nulls_first(), "n_tokens", "sum", "at")
    ordered = encoded.select("doc_id", "n_tokens", "addresses", "sizes", F.xxhash64("addresses").alias("sum"), F.monotonically_increasing_id().alias("at"))
    ordered = ordered.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("sum", "at").mapInArrow(lean(_recipes), RECIPE)
    ordered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    _block_roots(spark.read.schema(RECIPE).parquet(f"{path}/recipes")).write.parquet(f"{path}/blocks")
    rows = _manifest_rows(_part_rows(spark.read.schema(BLOCKS).parquet(f"{path}/blocks")), width)
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
    for p in encoded.inputFiles()[:1]:
        drop(spark, p.rpartition("/")[0])


def verify(spark: SparkSession, path: str) -> None:
    """Raise unless manifest, blocks and recipes agree, from the recipes' roots up to the manifest's one root."""
    rows = sorted(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in manifest(spark, path).collect())
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    if rows != _manifest_rows(_part_rows(blocks), rows[0][-1] if rows else 2):
        raise ValueError("the manifest does not fit the blocks")
    found = _block_roots(spark.read.schema(RECIPE).parquet(f"{path}/recipes"))
    ours, theirs = (d.select(F.struct(*[F.col(x.split()[0]) for x in BLOCKS.split(", ")]).alias("b")) for d in (blocks, found))
    both = ours.withColumn("side", F.lit(1)).unionByName(theirs.withColumn("side", F.lit(-1)))
    if both.groupBy("b").agg(F.sum("side").alias("s")).where("s <> 0").limit(1).count():
        raise ValueError("the recipes do not fit the blocks")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def _shift_tables() -> np.ndarray:
    """T[k][j][v]: the CRC register with byte j equal v and all others 0, moved on by 2**k zero bytes."""
    poly, step = 0xEDB88320, np.zeros(256, np.uint32)
    for v in range(256):
        c = v
        for _ in range(8):
            c = (c >> 1) ^ (poly if c & 1 else 0)
        step[v] = c
    basis = (np.uint32(1) << np.arange(32, dtype=np.uint32)).astype(np.uint32)
    image = (basis >> np.uint32(8)) ^ step[basis & np.uint32(255)]  # images of the 32 bits under one zero byte
    out = []
    for _ in range(48):
        table = np.zeros((4, 256), np.uint32)
        for j in range(4):
            for bit in range(8):
                table[j] ^= np.where((np.arange(256) >> bit) & 1, image[8 * j + bit], np.uint32(0)).astype(np.uint32)
        out.append(table)
        image = _through(table, image)
    return np.array(out)


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_SHIFT: list[np.ndarray] = []


def crc_shift(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What CRC-32 values contribute when so many bytes follow: crc(a + b) = crc_shift(crc(a), len(b)) ^ crc(b)."""
    if not _SHIFT:
        _SHIFT.append(_shift_tables())
    crc = crc.astype(np.uint32)
    for k in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        on = ((zeros >> k) & 1).astype(bool)
        if on.any():
            crc[on] = _through(_SHIFT[0][k], crc[on])
    return crc


def _checked_chunks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for name, payload in zip(batch.column("address").to_pylist(), batch.column("payload").to_pylist()):
                if address(payload) != name:
                    raise ValueError(f"chunk {name.hex()} does not hold what its address says")
                ids = np.frombuffer(payload, dtype=f"<u{width}")
                crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("address"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["address", "n", "crc"])

    return run


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk of each recipe, the recipe checked against its Merkle root; tail: the ids after the chunk."""
    for batch in batches:
        names, totals = batch.column("addresses"), batch.column("n_tokens").to_numpy(zero_copy_only=False)
        for leaves, total, root in zip(names.to_pylist(), totals.tolist(), batch.column("root").to_pylist()):
            if document_root(total, leaves) != root:
                raise ValueError("a recipe does not fit its Merkle root")
        counts = np.diff(names.offsets.to_numpy())
        take = pa.array(np.repeat(np.arange(len(names)), counts))
        upto = np.cumsum(batch.column("sizes").flatten().to_numpy().astype(np.int64))
        whole = np.append(0, upto)[np.cumsum(counts)]  # ids of the batch up to the end of each document
        if (np.diff(whole, prepend=0) != totals).any():
            raise ValueError("a recipe's lengths do not add up")
        tails = np.repeat(whole, counts) - upto
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in ("doc_id", "part", "place", "before", "n_tokens")], names.flatten(), pa.array(tails)], ["doc_id", "part", "place", "before", "n_tokens", "address", "tail"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc = batch.column("crc").to_numpy(zero_copy_only=False)
        moved = crc_shift(crc, 4 * batch.column("tail").to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.int64)
        names = ["doc_id", "part", "place", "before", "n_tokens", "n"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(moved)], [*names, "crc"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of the store, once they are verified."""
    verify(spark, path)
    parts = manifest(spark, path)
    width = (parts.select("width").first() or [2])[0]
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    key = "doc_id long, part int, place long, before long, n_tokens long"
    positions = recipes.select("doc_id", "part", "place", "before", "n_tokens", "addresses", "sizes", "root").mapInArrow(lean(_positions), key + ", address binary, tail long")
    chunks = spark.read.parquet(f"{path}/chunks").select("address", "payload").mapInArrow(lean(_checked_chunks(width)), "address binary, n long, crc long")
    joined = positions.join(chunks, "address", "left").select("doc_id", "part", "place", "before", "n_tokens", F.expr("coalesce(n, raise_error('a chunk is missing'))").alias("n"), "tail", "crc")
    parted = joined.mapInArrow(lean(_contributions), key + ", n long, crc long")
    docs = parted.groupBy("part", "place", "before", "doc_id", "n_tokens").agg(F.sum("n").alias("read"), F.bit_xor("crc").alias("ids_crc32"))
    docs = docs.where(F.expr("if(read = n_tokens, true, raise_error('a document is not whole'))"))
    docs = docs.join(F.broadcast(parts.select("part", "offset")), "part")
    return docs.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), F.col("read").alias("n_tokens"), "ids_crc32")


def decode(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, place, ids (array) of each document, once the files are verified."""
    verify(spark, path)
    width = (manifest(spark, path).select("width").first() or [2])[0]
    recipes = spark.read.schema(RECIPE).parquet(f"{path}/recipes")
    rows = recipes.select("doc_id", "part", "place", F.posexplode("addresses").alias("seq", "address"))
    joined = rows.join(spark.read.parquet(f"{path}/chunks").select("address", "payload"), "address", "left")
    whole = joined.groupBy("part", "place", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "address", "payload"))).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for chunks in batch.column("c").to_pylist():
                if any(address(c["payload"]) != c["address"] for c in chunks):
                    raise ValueError("a chunk does not hold what its address says")
                out.append(np.frombuffer(b"".join(c["payload"] for c in chunks), dtype=f"<u{width}").astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("place"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "part", "place", "ids"])

    return whole.select("doc_id", "part", "place", "c").mapInArrow(lean(run), "doc_id long, part int, place long, ids array<long>")


def store_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    path = new_path(docs.sparkSession, "token-store")
    write(docs, path, tokenizer, end_id)
    return digest(docs.sparkSession, path)
