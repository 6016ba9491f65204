"""Token ids as flat unsigned integer files with 64-bit document offsets, written by Spark tasks, read by memory map.

``part-00000.bin`` holds ids one after another (``uint16`` where the vocabulary fits, else ``uint32``, little-endian);
``part-00000.idx`` the documents' ids (int64), a flag byte per document for a null id, and the offsets (uint64, one
more than documents). Files follow ascending ids; a file's base is the number of ids in the files before it.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import materialise, shared_dir, ship_package
from .pieces import PieceTable, encode_texts
from .wordgrid import chunks

END = 0  # id after every document


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task is the unit of parallel work
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    model, letters = t.model, dict(enumerate(byte_letters()))

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces straight to the library's BPE model, as the byte letters that its pre-tokenizer would hand over."""
        found = [[x.id for x in model.tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for w in words]
        counts = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(counts.sum())), counts

    special = {a.content: i for i, a in t.get_added_tokens_decoder().items()}
    return PieceTable(encode), special, np.dtype("<u2" if t.get_vocab_size() <= 1 << 16 else "<u4")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _put(system, path: str, blobs) -> None:
    """Writes under a name of its own, then renames: a task that is run again replaces the file by an equal one."""
    own = f"{path}.{uuid.uuid4().hex}"
    try:
        with system.open_output_stream(own) as f:
            for blob in blobs:
                f.write(blob)
    except BaseException:
        system.delete_file(own)
        raise
    system.move(own, path)


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encodes and writes all rows in ascending id order (null first, ties by the text's hash, then the text); returns
    ``part, n_docs, n_tokens, width, base``.

    ``folder`` must be shared by all executors. Null and empty texts have the end id alone. An empty table has no files.
    Ids are written as they are made, some million characters at a time, so a task holds its longest text and 25 bytes
    per document. Rows of one id may go to several files, so an id (or null) that many rows share is no single task.
    """
    ship_package(docs.sparkSession)
    path = path or default_path()
    kept = folder.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        counts, ids_of, null_of = [], [], []

        def blobs() -> Iterator[bytes]:
            """Ids of a few texts at a time; what is kept of them is a few numbers per text."""
            for b in batches:
                for lo, hi, texts in chunks(b.column(1)):
                    ids, n = encode_texts(texts.to_pylist(), table, True, special)
                    counts.append(n + 1)
                    ids_of.append(b.column(0).slice(lo, hi - lo).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                    null_of.append(b.column(0).slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False).astype(np.uint8))
                    yield np.insert(ids, np.cumsum(n), END).astype(dtype).tobytes()

        batches = (b for b in batches if b.num_rows)
        head = next(batches, None)
        if head is None:
            return
        batches = chain([head], batches)
        table, special, dtype = _tokenizer(path)
        system, root = _open(kept)
        system.create_dir(root, recursive=True)
        _put(system, f"{root}/part-{part:05d}.bin", blobs())
        n = np.concatenate(counts)
        offsets = np.zeros(len(n) + 1, np.uint64)
        np.cumsum(n, out=offsets[1:], dtype=np.uint64)
        _put(system, f"{root}/part-{part:05d}.idx", (np.concatenate(ids_of).tobytes(), np.concatenate(null_of).tobytes(), offsets.tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([len(n)]), pa.array([int(offsets[-1])]), pa.array([dtype.itemsize], pa.int32())],
            ["part", "n_docs", "n_tokens", "width"])

    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    ordered = keyed.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")
    files = materialise(ordered.select("id", "text").mapInArrow(write, "part int, n_docs long, n_tokens long, width int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per file
    return materialise(files.withColumn("base", F.sum("n_tokens").over(before) - F.col("n_tokens")))


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` per document of the files, read by memory map."""
    ship_package(files.sparkSession)
    kept = folder.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                system, root = _open(kept)
                dtype = np.dtype(f"<u{row['width']}")
                with _map(system, f"{root}/part-{row['part']:05d}.idx") as f:
                    index = f.read()
                n = row["n_docs"]
                doc_ids = np.frombuffer(index, np.int64, n)
                null = np.frombuffer(index, np.uint8, n, 8 * n).astype(bool)
                offsets = np.frombuffer(index[9 * n:], np.uint64).astype(np.int64)
                sums = []
                with _map(system, f"{root}/part-{row['part']:05d}.bin") as f:
                    for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                        f.seek(a * dtype.itemsize)
                        ids = np.frombuffer(f.read_buffer((z - a) * dtype.itemsize), dtype)
                        sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=null), pa.array(row["base"] + offsets[:-1]), pa.array(np.diff(offsets)), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(files.count(), 1)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _map(system, path: str):
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)


def token_files(docs: DataFrame, folder: str | None = None, **parameters) -> DataFrame:
    """Writes the token files and reads them back, in a new folder below the shared one unless given."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_tokens(write_tokens(docs, folder, **parameters), folder)
