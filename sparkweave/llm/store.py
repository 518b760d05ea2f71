"""Content-addressed store of token ids.

A document's id stream is cut where a rolling hash of its last ids says so, so
equal runs of ids give equal chunks wherever they stand. A chunk is stored once
under the digest of its bytes; a recipe lists the addresses of a document's
chunks. Four tables make a store::

    chunks/    address, n_ids, payload     payload: ids, little-endian, ``width`` bytes each
    recipes/   doc_id, start, n_tokens, root, addresses (joined), by ascending doc_id
    manifest/  part, root, n_docs, n_tokens, width
    top/       root, n_docs, n_tokens: one row

Roots are Merkle roots: of a document over its chunks, of a manifest part over its
documents in order (each with its number, id, start, number of ids and root), and
of the store over the parts, level by level.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkweave.llm.tokens import encoder
from sparkweave.operators.scan import prefix_scan
from sparkweave.storage import discard, materialize, new_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Ids that the rolling hash sees, and the sizes of chunks: the hash cuts once in MEAN ids, after MIN and at MAX at the latest.
SEEN, MIN, MEAN, MAX = 16, 256, 1024, 16384
DIGEST = 16
#: Documents under one root of the manifest.
PART = 1024


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs of nodes are hashed with a mark that no leaf has; an odd node moves up alone; no leaves give the digest of nothing."""
    level = [digest(b"\0" + x) for x in leaves]
    while len(level) > 1:
        level = [digest(b"\1" + b"".join(level[i : i + 2])) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else digest(b"")


def _gear(ids: np.ndarray) -> np.ndarray:
    """A mixed 32-bit number for each id."""
    x = ids.astype(np.uint32) + np.uint32(0x9E3779B9)
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. The rolling hash at i is the sum of gear[id] << age over the last ``SEEN`` ids."""
    n = len(ids)
    if n <= MIN:
        return [n] if n else []
    gear = _gear(ids)
    rolling = gear.copy()
    age = 1
    while age < SEEN:  # the sum over 2k ids is the sum over k, and that from k ids before, k bits older
        rolling[age:] += rolling[:-age] << np.uint32(age)
        age *= 2
    marks = (np.flatnonzero(rolling >> np.uint32(16) & np.uint32(MEAN - 1) == 0) + 1).tolist()
    out, last = [], 0
    for mark in [*marks, n]:
        while mark - last > MAX:
            last += MAX
            out.append(last)
        if mark - last >= MIN or mark == n > last:
            out.append(mark)
            last = mark
    return out


def _tokenized(docs: DataFrame, tokenizer: str, width: int) -> DataFrame:
    """A row for each document (root and joined addresses) and for each chunk that its task meets first (address and payload).

    The two kinds have columns of their own, so that who reads one kind doesn't decode the other's bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, met = encoder(tokenizer), END_ID.to_bytes(4, "little"), set()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                row, count, root, listed, address, payload = [], [], [], [], [], []
                for i, encoded in enumerate(known.encode_all([text or "" for text in part.column(1).to_pylist()])):
                    ids = np.frombuffer(encoded + end, "<u4")
                    body = ids.astype(f"<u{width}").tobytes()
                    addresses, last = [], 0
                    for cut in cuts(ids):
                        chunk = body[last * width : cut * width]
                        name = digest(chunk)
                        addresses.append(name)
                        if name not in met:
                            met.add(name)
                            row.append(None)
                            count.append(cut - last)
                            root.append(None)
                            listed.append(None)
                            address.append(name)
                            payload.append(chunk)
                        last = cut
                    if len(met) > 1 << 20:
                        met.clear()
                    row.append(i)
                    count.append(len(ids))
                    root.append(merkle_root(addresses))
                    listed.append(b"".join(addresses))
                    address.append(None)
                    payload.append(None)
                data = [pa.array(count, pa.int64()), *(pa.array(c, pa.binary()) for c in (root, listed, address, payload))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), *data], names=schema.names)

    binary = [T.StructField(c, T.BinaryType()) for c in ("root", "addresses", "address", "payload")]
    schema = T.StructType([T.StructField("doc_id", docs.schema[0].dataType), T.StructField("n_ids", T.LongType()), *binary])
    return docs.mapInArrow(run, schema)


def _first_of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows dealt by address the first of each; every task that made chunks sends an address about once, so none is hot."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for i, address in enumerate(batch.column(0).to_pylist()):
            if address not in seen:
                seen.add(address)
                fresh.append(i)
        yield batch if len(fresh) == batch.num_rows else batch.take(pa.array(fresh, pa.int64()))


def write_store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> None:
    """Encode all texts and write them as a store at ``path``.

    A null text is empty; every document has its end id. A null id comes first;
    rows that repeat an id stand beside each other, ordered by their roots. No
    rows give a store without chunks and recipes.
    """
    width = 2 if encoder(tokenizer).size <= 1 << 16 else 4
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    both = materialize(_tokenized(rows, tokenizer, width), "tokenized")
    chunks = both.where("address IS NOT NULL").select("address", "n_ids", "payload")
    chunks.repartition("address").mapInArrow(_first_of_each, chunks.schema).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = both.where("root IS NOT NULL").select("doc_id", F.col("n_ids").alias("n_tokens"), "root", "addresses")
    sums = {"start": "n_tokens", "number": "one"}
    numbered = prefix_scan(recipes.withColumn("one", F.lit(1)), ["doc_id", "root", "n_tokens"], sums).drop("one")
    ordered = numbered.repartitionByRange("number").sortWithinPartitions("number")
    ordered.select("doc_id", "start", "n_tokens", "root", "addresses", "number").write.option("compression", "zstd").parquet(f"{path}/recipes")
    spark = docs.sparkSession
    _manifest(spark.read.parquet(f"{path}/recipes")).withColumn("width", F.lit(width)).write.parquet(f"{path}/manifest")
    _top(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{path}/top")
    discard(both)


@F.pandas_udf(T.BinaryType())
def _roots(lists):
    return lists.map(lambda leaves: merkle_root([bytes(x) for x in leaves]))


def _leaf(*columns: str) -> Column:
    """A digest of a row's values, nulls told from all others."""
    values = [F.coalesce(F.concat(F.lit("v"), F.hex(c) if c in ("root", "addresses") else F.col(c).cast("string")), F.lit("n")) for c in columns]
    return F.unhex(F.sha2(F.concat_ws("\x1f", *values), 256))


def _level(rows: DataFrame, place: str, leaf: Column, docs: Column) -> DataFrame:
    parts = rows.groupBy(F.expr(f"{place} div {PART}").alias("part")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), leaf.alias("leaf")))).alias("leaves"),  # PART at most
        docs.alias("n_docs"),
        F.sum("n_tokens").alias("n_tokens"),
    )
    return parts.select("part", _roots(F.transform("leaves", lambda x: x["leaf"])).alias("root"), "n_docs", "n_tokens")


def _manifest(recipes: DataFrame) -> DataFrame:
    return _level(recipes, "number", _leaf("number", "doc_id", "start", "n_tokens", "root", "addresses"), F.count("*"))


def _top(manifest: DataFrame) -> DataFrame:
    """(root, n_docs, n_tokens) of the whole store."""
    last = manifest.agg(F.max("part")).first()[0]
    level = manifest.select("part", "root", "n_docs", "n_tokens")
    once = True
    while once or last:
        level = _level(level, "part", _leaf("part", "root", "n_docs", "n_tokens"), F.sum("n_docs"))
        last, once = (last or 0) // PART, False
    return level.select("root", "n_docs", "n_tokens")


def _crc_shift() -> np.ndarray:
    """Tables (bit of a length, byte, value): what a crc becomes under 2**bit zero bytes."""
    one = [zlib.crc32(b"\0", v ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)]
    step = np.array([one, *([v << 8 * byte - 8 for v in range(256)] for byte in (1, 2, 3))], dtype=np.uint64)
    tables = [step]
    for _ in range(40):
        last = tables[-1]
        now = np.zeros_like(last)
        for byte in range(4):
            x = last[byte].astype(np.int64)
            now[byte] = last[0][x & 0xFF] ^ last[1][x >> 8 & 0xFF] ^ last[2][x >> 16 & 0xFF] ^ last[3][x >> 24 & 0xFF]
        tables.append(now)
    return np.stack(tables)


_SHIFT: list[np.ndarray] = []


def crc_join(first: np.ndarray, second: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """crc32 of texts put together, from the crcs of both and the bytes of the second."""
    if not _SHIFT:
        _SHIFT.append(_crc_shift())
    x = first.astype(np.uint64)
    for bit in range(int(n_bytes.max(initial=0)).bit_length()):
        t = _SHIFT[0][bit]
        moved = t[0][x & np.uint64(0xFF)] ^ t[1][x >> np.uint64(8) & np.uint64(0xFF)]
        moved ^= t[2][x >> np.uint64(16) & np.uint64(0xFF)] ^ t[3][x >> np.uint64(24) & np.uint64(0xFF)]
        x = np.where(n_bytes >> bit & 1 == 1, moved, x)
    return x ^ second.astype(np.uint64)


def _checked_chunks(chunks: DataFrame, width: int) -> DataFrame:
    """(address, n_ids, crc) of each stored chunk, read and hashed again; one that isn't what its address says stops the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, crc = [], []
            for address, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest(payload) != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                ids = np.frombuffer(payload, f"<u{width}")
                n.append(len(ids))
                crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], names=["address", "n", "crc"]
            )

    return chunks.select("address", "payload").mapInArrow(run, "address binary, n long, crc long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = batch.column(batch.schema.get_field_index("parts"))
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        inner = parts.flatten()
        n = inner.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
        crc = inner.field("crc").to_numpy(zero_copy_only=False).astype(np.int64)
        address = inner.field("address").to_pylist()
        starts, stops = offsets[:-1], offsets[1:]
        total = np.zeros(len(starts), dtype=np.int64)
        out = np.zeros(len(starts), dtype=np.uint64)
        rows = np.arange(len(starts))
        step = 0
        while len(rows := rows[starts[rows] + step < stops[rows]]):
            at = starts[rows] + step
            out[rows] = crc_join(out[rows], crc[at], n[at] * 4)
            total[rows] += n[at]
            step += 1
        roots = [merkle_root(address[a:b]) for a, b in zip(starts, stops, strict=True)]
        names = [f for f in batch.schema.names if f != "parts"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(total), pa.array(out.astype(np.int64)), pa.array(roots, pa.binary())],
            names=[*names, "read_tokens", "ids_crc32", "read_root"],
        )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files, verified.

    Verified means: every chunk is read once and hashed against its address, a
    document's length and root follow again from its chunks, and all that recipes
    say is under the store's root. Ids aren't put together for that (``reconstruct``
    does): a document's crc32 is combined from those of its chunks. Recipes whose
    chunks are missing, or whose length, root or manifest differ, stop the job.
    """
    recipes, manifest = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    first = manifest.select("width").first()
    if first is None and spark.read.parquet(f"{path}/top").isEmpty():
        return recipes.select("doc_id", "start", "n_tokens", F.lit(0).cast("long").alias("ids_crc32"))
    chunks = _checked_chunks(spark.read.parquet(f"{path}/chunks"), first["width"] if first else 4)
    wrong = (
        _manifest(recipes)
        .withColumnsRenamed({"root": "r", "n_docs": "d", "n_tokens": "t"})
        .join(manifest, "part", "full")
        .where("NOT (root <=> r AND n_docs <=> d AND n_tokens <=> t)")
    )
    if not wrong.isEmpty():
        raise ValueError("the manifest doesn't fit the recipes")
    if _top(manifest).collect() != spark.read.parquet(f"{path}/top").collect():
        raise ValueError("the manifest isn't the one that the store's root is of")
    listed = recipes.select(
        "number",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.expr(f"cast(length(addresses) div {DIGEST} as int) - 1")),
                lambda i: F.substring("addresses", i * DIGEST + 1, F.lit(DIGEST)),
            )
        ).alias("pos", "address"),
    )
    found = listed.join(chunks, "address", "left").groupBy("number").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc", "address"))).alias("parts"))
    schema = "number long, read_tokens long, ids_crc32 long, read_root binary"
    found = found.withColumn("parts", F.transform("parts", lambda p: F.struct(F.coalesce(p["n"], F.lit(-1)).alias("n"), F.coalesce(p["crc"], F.lit(0)).alias("crc"), p["address"].alias("address"))))
    read = found.mapInArrow(_joined, schema)
    fits = F.col("read_tokens").eqNullSafe(F.col("n_tokens")) & F.col("read_root").eqNullSafe(F.col("root"))
    return recipes.join(read, "number", "left").select(
        "doc_id",
        "start",
        "n_tokens",
        F.when(fits, F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("document "), F.col("number"), F.lit(" can't be rebuilt")))).alias("ids_crc32"),
    )


def reconstruct(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): the ids of each document, put together again from its chunks (array of int)."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = spark.read.parquet(f"{path}/chunks")
    first = spark.read.parquet(f"{path}/manifest").select("width").first()
    width = first["width"] if first else 4
    listed = recipes.select(
        "number",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.expr(f"cast(length(addresses) div {DIGEST} as int) - 1")),
                lambda i: F.substring("addresses", i * DIGEST + 1, F.lit(DIGEST)),
            )
        ).alias("pos", "address"),
    )

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(parts):
        return parts.map(lambda ps: np.frombuffer(b"".join(bytes(p) for p in ps), f"<u{width}").astype(np.int32))

    whole = (
        listed.join(chunks, "address")
        .groupBy("number")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "payload"))).alias("parts"))
        .select("number", ids(F.transform("parts", lambda p: p["payload"])).alias("ids"))
    )
    return recipes.join(whole, "number").select("doc_id", "start", "ids")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Write a store in the shared folder and read it back."""
    path = new_path(docs.sparkSession, "store")
    write_store(docs, path, id_col, text_col, tokenizer)
    return read_store(docs.sparkSession, path)
