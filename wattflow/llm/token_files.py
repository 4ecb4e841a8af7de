"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned and sorted by id (the rows of one id may be
dealt to several partitions); every partition encodes its
texts and streams the ids to one flat file of unsigned integers (16 bits where
the vocabulary fits, else 32).  A manifest with one row per partition is the
commit record: files are named by a fresh id for each attempt, and only those a
successful task reported are in it, so a lost executor leaves at most an unused
file behind.  Prefix sums over the manifest give every partition its base, with
which a second pass writes the offsets: n + 1 unsigned 64-bit starts in the
whole stream for n documents, after n signed 64-bit document ids.

    <folder>/<part>-<attempt>.ids       ids, little-endian
    <folder>/<part>-<attempt>.lengths   tokens of each document, int64 (input of the second pass)
    <folder>/<part>-<attempt>.docs      n x int64 id, n x uint8 null flag, (n + 1) x uint64 offset
    <folder>/manifest                   Parquet: part, file, n_docs, n_tokens, base
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattflow.llm.common import cut, remove_at_exit, shared_folder

END_ID = 0
# Pieces that a Python worker remembers; beyond, it forgets all and begins anew.
REMEMBERED = 1_000_000
# Characters of texts that are encoded together, about.
TOGETHER = 4 << 20
# Pieces that are put together for one call of the library.
JOINED = 32_768
# Documents that are read back at a time.
READ_DOCS = 4096

_MANIFEST = "part int, file string, n_docs long, n_tokens long"
# White space of any kind.
_WHITE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
# Where a space is not a sure edge: before white space, or at the end of the text.
_UNSURE = f" {_WHITE}| $"
_SURE = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")
_JOINABLE = re.compile(r" \S")
# Between a letter and an ASCII mark (but an apostrophe) the byte-level split always starts a new piece.
_MARK = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:-@\[-`{-~])"
# Stands before the name of a piece that follows a letter, not a space.
_GLUED = "\x02"


def local_or_remote(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Filesystem and path of a shared folder's URI (a plain path is a mounted folder)."""
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Encoder:
    """The tokenizers library, asked once for each piece of text that a worker meets.

    Texts are cut before a space that follows a non-space, and between a letter
    and a mark: there the byte-level split always starts a new piece, whatever
    the text around, so the ids of the pieces in order are those of the text.
    The cutting, the numbering of a batch's pieces and the gathering of their
    ids run over whole batches.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # bytes of every id: a byte-level token has one character for each
        self.length = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.length[i] = len(token)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        for i, token in self.tokenizer.get_added_tokens_decoder().items():
            self.length[i] = len(token.content.encode())
        if any(re.search(r"\s", t) for t in special):
            raise ValueError("a special string with white space could span two pieces")
        # texts with such strings are cut before spaces alone
        self.odd = "|".join([_UNSURE, _GLUED, *[re.sub(r"(\W)", r"\\\1", t) for t in special]])
        self._forget()

    def _forget(self) -> None:
        # row of a piece after a space (by its name without it) or a letter (_GLUED and the piece), and of other parts
        self.pieces: dict[str, int] = {"": 0}
        self.others: dict[str, int] = {"": 0}
        # the ids of all rows, and where a row's begin and how many they are; row 0 is empty
        self.ids, self.start, self.size = (_Grown(k) for k in (self.kind, np.int64, np.int64))
        self.start.add(np.zeros(1, np.int64))
        self.size.add(np.zeros(1, np.int64))

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and how many they are of each."""
        if len(self.pieces) + len(self.others) > REMEMBERED:
            self._forget()
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        runs = np.split(np.arange(len(texts)), np.flatnonzero(np.diff(odd)) + 1)
        parts = [(self._odd_rows if odd[r[0]] else self._rows)(texts.slice(r[0], len(r))) for r in runs if len(r)]
        rows, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        size = self.size.array[rows]
        ends = np.cumsum(size)
        flat = self.ids.array[np.repeat(self.start.array[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        last = np.concatenate([[0], ends])[np.cumsum(counts)]
        return np.insert(flat, last, end_id), np.diff(last, prepend=0) + 1

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The rows of the pieces of all texts, and how many they are of each."""
        apart = pc.replace_substring_regex(texts, _MARK, rf"\1 {_GLUED}\2")
        lists = pc.split_pattern(apart, " ")
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        numbered = lists.flatten().dictionary_encode()
        names = numbered.dictionary.to_pylist()
        first = numbered.take(pa.array(offsets[:-1])).to_pylist()
        self._learn({n for n in names if n not in self.pieces}, {n for n in first if n not in self.others})
        rows = np.array([self.pieces[n] for n in names], np.int64)[numbered.indices.to_numpy()]
        rows[offsets[:-1]] = [self.others[n] for n in first]
        return rows, np.diff(offsets)

    def _odd_rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cut_up = [[(c[1:], self.pieces) if _JOINABLE.match(c) and c[1] != _GLUED else (c, self.others)
                   for c in _SURE.split(t)] for t in texts.to_pylist()]
        new = {(c, table is self.pieces) for parts in cut_up for c, table in parts if c not in table}
        self._learn({c for c, after in new if after}, {c for c, after in new if not after})
        return np.array([table[c] for parts in cut_up for c, table in parts], np.int64), np.array([len(p) for p in cut_up])

    def _learn(self, pieces: set[str], others: set[str]) -> None:
        """Encode what is new, pieces after a space put together to long texts.

        Such a piece starts a new one after any other, so the ids of the long
        text, cut by their byte lengths, are those of its pieces.
        """
        glued = [c for c in pieces if c[0] == _GLUED]
        for table, names, alone in ((self.others, list(others), list(others)), (self.pieces, glued, [c[1:] for c in glued])):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]
            if ids:
                self._remember(table, names, np.concatenate([np.array(x, self.kind) for x in ids]), np.array([len(x) for x in ids]))
        spaced = [c for c in pieces if c[0] != _GLUED]
        for at in range(0, len(spaced), JOINED):
            part = spaced[at:at + JOINED]
            text = " " + " ".join(part)
            [e] = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(e.ids, self.kind)
            lengths = map(len, part) if text.isascii() else (len(c.encode()) for c in part)
            ends = np.cumsum(np.fromiter(lengths, np.int64, len(part)) + 1)
            self._remember(self.pieces, part, ids, np.diff(np.searchsorted(np.cumsum(self.length[ids]), ends) + 1, prepend=0))

    def _remember(self, table: dict[str, int], names: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        table.update(zip(names, range(self.start.n, self.start.n + len(names))))
        self.start.add(self.ids.n + np.cumsum(size) - size)
        self.size.add(size)
        self.ids.add(ids)


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.array, self.n = np.zeros(1024, kind), 0

    def add(self, values: np.ndarray) -> None:
        while self.n + len(values) > len(self.array):
            self.array = np.concatenate([self.array, np.zeros(len(self.array), self.array.dtype)])
        self.array[self.n:self.n + len(values)] = values
        self.n += len(values)


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work
    return Encoder(path)


def _groups(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of about TOGETHER characters (bytes) together."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + TOGETHER)))
        yield texts.slice(at, end - at)
        at = end


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
          end_id: int = END_ID, partitions: int | None = None) -> DataFrame:
    """Write the token files of ``docs`` below ``folder`` (a URI all executors share); the manifest.

    Documents stand in ascending order of id (null first; equal ids in any
    order, which the files then fix).
    Every document's ids are followed by ``end_id``; a null text is empty and
    has that id alone.  An empty table has an empty manifest.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the rows of one id may go to several partitions; what tells them apart here needs no text
    ordered = (rows.withColumn("any", F.monotonically_increasing_id())
               .repartitionByRange(*([partitions] if partitions else []), "id", "any")
               .sortWithinPartitions("id", "any").select("id", "text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        fs, path = local_or_remote(folder)
        encoder, ids, lengths = _encoder(tokenizer), [], []
        name, out = f"{part:06d}-{uuid.uuid4().hex}", None
        for batch in batches:
            if out is None:
                fs.create_dir(path, recursive=True)
                out = fs.open_output_stream(f"{path}/{name}.ids")
            for group in _groups(batch["text"].fill_null("")):
                flat, n = encoder.encode(group, end_id)
                out.write(flat.tobytes())
                lengths.append(n)
            ids.append(batch["id"])
        if out is None:
            return
        out.close()
        ids, lengths = pa.chunked_array(ids).combine_chunks(), np.concatenate([np.zeros(0, np.int64), *lengths])
        with fs.open_output_stream(f"{path}/{name}.lengths") as f:
            f.write(lengths.astype("<i8").tobytes())
            f.write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            f.write(ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "file": pa.array([name]), "n_docs": pa.array([len(lengths)], pa.int64()),
            "n_tokens": pa.array([int(lengths.sum())], pa.int64())})

    # one row per partition, written by the tasks that succeeded
    done = cut(ordered.mapInArrow(encode, _MANIFEST), "manifest")
    base = F.coalesce(F.sum("n_tokens").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = done.withColumn("base", base)

    def offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = local_or_remote(folder)
        for pdf in batches:
            for r in pdf.itertuples():
                with fs.open_input_file(f"{path}/{r.file}.lengths") as f:
                    lengths = np.frombuffer(f.read(8 * r.n_docs), "<i8")
                    ids = f.read()
                starts = np.concatenate([[0], np.cumsum(lengths)]) + r.base
                # whole or not at all, and the same bytes in every attempt
                temporary = f"{path}/{r.file}.docs-{uuid.uuid4().hex}"
                with fs.open_output_stream(temporary) as f:
                    f.write(ids[:8 * r.n_docs])
                    f.write(ids[8 * r.n_docs:])
                    f.write(starts.astype("<u8").tobytes())
                fs.move(temporary, f"{path}/{r.file}.docs")
            yield pdf

    spread = based.repartition(max(1, min(200, done.count())), "part")
    manifest = f"{folder}/manifest"
    spread.mapInPandas(offsets, _MANIFEST + ", base long").write.parquet(manifest)
    return spark.read.parquet(manifest)


def _mapped(fs, path: str) -> tuple[np.ndarray | pa.NativeFile, bool]:
    """A local file as mapped memory, else an open file that is read by ranges."""
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r"), True
    return fs.open_input_file(path), False


def _range(file, mapped: bool, at: int, n: int) -> np.ndarray:
    return np.asarray(file[at:at + n]) if mapped else np.frombuffer(file.read_at(n, at), np.uint8)


def read(manifest: DataFrame, folder: str, tokenizer: str) -> DataFrame:
    """(doc_id, start, ids as bytes crc, n): one row per document, from the files alone.

    Columns: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of
    the ids as little-endian unsigned 32-bit integers).  Files are memory-mapped
    and read in slices of documents.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, path = local_or_remote(folder)
        kind = _encoder(tokenizer).kind
        for pdf in batches:
            for r in pdf.itertuples():
                docs, docs_mapped = _mapped(fs, f"{path}/{r.file}.docs")
                ids, ids_mapped = _mapped(fs, f"{path}/{r.file}.ids")
                for at in range(r.first, r.end, READ_DOCS):
                    n = min(READ_DOCS, r.end - at)
                    names = _range(docs, docs_mapped, 8 * at, 8 * n).view("<i8")
                    null = _range(docs, docs_mapped, 8 * r.n_docs + at, n).astype(bool)
                    starts = _range(docs, docs_mapped, 9 * r.n_docs + 8 * at, 8 * (n + 1)).tobytes()
                    starts = np.frombuffer(starts, "<u8").astype(np.int64)
                    crc = []
                    for a, b in zip(starts[:-1] - r.base, starts[1:] - r.base):
                        raw = _range(ids, ids_mapped, int(a) * kind.itemsize, int(b - a) * kind.itemsize)
                        crc.append(zlib.crc32(np.frombuffer(raw.tobytes(), kind).astype("<u4").tobytes()))
                    yield pd.DataFrame({
                        "doc_id": pd.arrays.IntegerArray(names.astype(np.int64), null),
                        "start": starts[:-1], "n_tokens": np.diff(starts), "ids_crc32": crc})

    # a slice of a file per row, so that one large file is read by many tasks
    slices = (manifest.withColumn("first", F.explode(F.sequence(
                  F.lit(0).cast("long"), F.greatest(F.col("n_docs") - 1, F.lit(0)), F.lit(READ_DOCS).cast("long"))))
              .withColumn("end", F.least(F.col("first") + READ_DOCS, F.col("n_docs"))))
    return slices.repartition("part", "first").mapInPandas(
        rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
               partitions: int | None = None) -> DataFrame:
    """Write ``docs`` to a new folder and read it back: doc_id, start, n_tokens, ids_crc32.

    Repeated rows are documents of their own; columns beyond id and text are ignored.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "wattflow-tokens")
    remove_at_exit(spark, folder)
    manifest = write(docs, folder, tokenizer, id_col, text_col, partitions=partitions)
    return read(manifest, folder, tokenizer)
