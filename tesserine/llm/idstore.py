"""A content-addressed store of token ids: unique chunks in packs, documents as recipes, manifests with Merkle roots."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, scratch_path, stored, texts
from .files import Ranges, remove_folder, write_file
from .tokens import chunk_ends, encoder, merkle_root, tokenizer_path

#: Bytes of ids to a compressed frame of a draft pack, and words that a worker remembers.
FRAME, WORDS = 1 << 20, 1_000_000


def chunk_key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _draft(docs: DataFrame, path: str, folder: str, narrow: bool) -> DataFrame:
    """Encode each text once. Rows: doc_id, n_ids, keys (of its chunks, in order), pack and new (chunks this task met first: key, place, n_ids).

    A task writes the chunks that it meets for the first time to a draft pack of compressed frames.
    """
    kind = np.dtype("<u2" if narrow else "<u4")

    def run(batches):
        made, squeeze = encoder(path, WORDS), zstandard.ZstdCompressor(level=1)
        seen: set[bytes] = set()
        uri, out, frame, place = "", None, bytearray(), 0
        for b in batches:
            sizes, packs, keys, new, ends, new_ends = [], [], [], [], [0], [0]
            for text in b.column("text").to_pylist():
                ids = np.frombuffer(made.with_end(text), "<u4").astype(kind)
                start = 0
                for end in chunk_ends(ids):
                    data = ids[start:end].tobytes()
                    k = chunk_key(data)
                    keys.append(k)
                    if k not in seen:
                        seen.add(k)
                        if out is None:
                            uri, out = write_file(folder, ".draft")
                        new.append((k, place, end - start))
                        place += 1
                        frame += data
                        if len(frame) >= FRAME:
                            packed = squeeze.compress(bytes(frame))
                            out.write(len(packed).to_bytes(4, "little") + packed)
                            frame.clear()
                    start = end
                sizes.append(len(ids))
                packs.append(uri)
                ends.append(len(keys))
                new_ends.append(len(new))
            fresh = pa.StructArray.from_arrays([pa.array([x[j] for x in new], t) for j, t in enumerate((pa.binary(), pa.int32(), pa.int32()))], ["key", "place", "n"])
            columns = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.binary())), pa.array(packs, pa.string()), pa.ListArray.from_arrays(pa.array(new_ends, pa.int32()), fresh)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_ids", "keys", "pack", "new"])
        if out is not None:
            if frame:
                packed = squeeze.compress(bytes(frame))
                out.write(len(packed).to_bytes(4, "little") + packed)
            out.close()

    return docs.mapInArrow(run, "doc_id long, n_ids long, keys array<binary>, pack string, new array<struct<key: binary, place: int, n: int>>")


def _settle(owned: DataFrame, folder: str, narrow: bool) -> DataFrame:
    """Copy the chunks that each draft pack owns to a final pack. Rows: key, pack, offset, n."""
    width = 2 if narrow else 4

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        reader, loosen = Ranges(), zstandard.ZstdDecompressor()
        draft = t.column("draft")[0].as_py()
        uri, out = write_file(folder, ".ids")
        own = set(t.column("place").to_pylist())
        at, held, base, offset, offsets = 0, memoryview(b""), 0, 0, []
        # every chunk of the draft, owned or not, tells how far to go on
        for place, n, mine in zip(t.column("place").to_pylist(), t.column("n").to_pylist(), t.column("mine").to_pylist(), strict=True):
            if base == len(held):
                size = int.from_bytes(reader.read(draft, at, 4), "little")
                held, base, at = memoryview(loosen.decompress(reader.read(draft, at + 4, size))), 0, at + 4 + size
            if mine and place in own:
                out.write(held[base : base + n * width])
                offsets.append(offset)
                offset += n * width
            base += n * width
        out.close()
        reader.close()
        mine = t.filter(t.column("mine"))
        return pa.table([mine.column("key").combine_chunks(), pa.array([uri] * len(offsets), pa.string()), pa.array(offsets, pa.int64()), mine.column("n").combine_chunks()], ["key", "pack", "offset", "n"])

    return owned.groupBy("draft").applyInArrow(run, "key binary, pack string, offset long, n int")


def write_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", narrow: bool = False) -> tuple[DataFrame, DataFrame]:
    """Encode all texts into a store; returns (manifest, index).

    manifest: a row per document in ascending doc_id order: doc_id, n_ids, keys (its recipe) and root, the Merkle root of
    the recipe. index: a row per unique chunk: key, pack, offset (in bytes), n. Packs hold unsigned integers, of 16 bits with ``narrow``
    (for vocabularies up to 65,536) and else of 32 bits, little-endian, without headers: readers take byte ranges.

    Chunks are cut by a rolling hash of the ids, so shared passages give shared chunks. A chunk that several tasks
    have met is owned by one; drafts are copied to packs without the others, then removed. Only keys are shuffled, never ids.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    drafts, packs = scratch_path(spark, "drafts"), scratch_path(spark, "packs")
    draft = stored(_draft(texts(docs, id_col, text_col), path or tokenizer_path(), drafts, narrow), "recipes")
    new = draft.select(F.col("pack").alias("draft"), F.explode("new").alias("c")).select("draft", "c.key", "c.place", "c.n")
    owner = new.groupBy("key").agg(F.min(F.struct("draft", "place")).alias("o")).select("o.draft", "o.place", F.lit(True).alias("mine"))
    marked = new.join(owner, ["draft", "place"], "left").withColumn("mine", F.coalesce("mine", F.lit(False)))
    index = stored(_settle(marked, packs, narrow), "index")
    remove_folder(drafts)

    @F.pandas_udf("binary")
    def root(keys):
        return keys.map(lambda x: merkle_root([bytes(k) for k in x]))

    manifest = draft.select("doc_id", "n_ids", "keys", root("keys").alias("root"))
    return stored(manifest.repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root"), "manifest"), index


def read_ids(manifest: DataFrame, index: DataFrame, narrow: bool = False) -> DataFrame:
    """A row per document read back from the packs: doc_id, n_tokens, ids_crc32 (of the ids as 32-bit integers).

    Each chunk's bytes must have its key, and the keys read the document's Merkle root; otherwise the query fails.
    A recipe that many documents have is read once. Recipes are read in the order of their first chunk's place, so neighbours share requests.
    """
    width, kind = (2, "<u2") if narrow else (4, "<u4")
    parts = manifest.select("root", F.posexplode("keys").alias("pos", "key")).distinct()
    located = parts.join(index, "key").select("root", F.struct("pos", "key", "pack", "offset", "n").alias("c"))
    recipes = located.groupBy("root").agg(F.array_sort(F.collect_list("c")).alias("chunks"))
    todo = recipes.withColumn("first", F.col("chunks")[0]).repartition("first.pack").sortWithinPartitions("first.pack", "first.offset").drop("first")

    def run(batches):
        reader = Ranges()
        for b in batches:
            out, lists = [], b.column("chunks")
            ends, parts = lists.offsets.to_pylist(), lists.values
            keys, packs, offsets, sizes = (parts.field(c).to_pylist() for c in ("key", "pack", "offset", "n"))
            for root, i, j in zip(b.column("root").to_pylist(), ends, ends[1:], strict=False):
                whole = []
                for k in range(i, j):
                    data = reader.read(packs[k], offsets[k], sizes[k] * width)
                    if chunk_key(data) != keys[k]:
                        raise ValueError(f"chunk {keys[k].hex()} of {packs[k]} is damaged")
                    whole.append(data)
                if merkle_root(keys[i:j]) != root:
                    raise ValueError(f"the recipe of root {root.hex()} can't be rebuilt")
                ids = np.frombuffer(b"".join(whole), kind)
                out.append((root, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            kinds = (pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], ["root", "n_tokens", "ids_crc32"])
        reader.close()

    read = todo.mapInArrow(run, "root binary, n_tokens long, ids_crc32 long")
    back = manifest.select("doc_id", "root", "n_ids").join(read, "root", "left")
    lost = F.raise_error(F.concat(F.lit("not in the store: document "), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).cast("long")
    return back.select("doc_id", F.when(F.col("n_ids") == F.col("n_tokens"), F.col("n_tokens")).otherwise(lost).alias("n_tokens"), "ids_crc32")


def with_starts(rows: DataFrame) -> DataFrame:
    """``start``: the sum of n_tokens over all rows before in ascending (doc_id, ids_crc32) order, null ids first.

    A range partitioning, a sum per partition (so many rows reach the driver), and a running sum inside each.
    """
    order = ["doc_id", "n_tokens", "ids_crc32"]
    ranged = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "starts")
    base, at = {}, 0
    for r in ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        base[r["part"]] = at
        at += r["n"]
    bases = rows.sparkSession.createDataFrame([(p, b) for p, b in base.items()], "part int, base long")
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(bases), "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def stored_ids(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, read back from the store: doc_id, start, n_tokens, ids_crc32.

    Null text counts as empty: only the end id. Rows repeated are documents each, of the same chunks, one after another; a null id
    comes before all others. An empty table gives no rows.
    """
    path = path or tokenizer_path()
    narrow = Tokenizer.from_file(path).get_vocab_size() <= 1 << 16
    return with_starts(read_ids(*write_ids(docs, path, id_col, text_col, narrow), narrow))
