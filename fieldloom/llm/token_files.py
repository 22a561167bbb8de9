"""Token ids in binary files: ids one after the other, document boundaries by Elias-Fano.

write() deals the documents out by ranges of doc_id, so every task holds a stretch of the order and,
after Spark's sort, tokenizes and writes it. A file holds its documents' ids as little-endian integers (two
bytes each if the vocabulary allows), then the boundaries and the doc_ids as two Elias-Fano sequences (a null
doc_id comes first and is only counted), then a footer with the lengths of these parts. A manifest, written
when all tasks are done, lists the files in order with their numbers of documents and ids. Only files of
attempts that Spark committed are in it, so a lost executor's half-written file is never read.

The reader deals each file out in ranges of documents. A range takes the two sequences, asks them where its
first and last document start, and reads just those bytes of ids. `document()` gets one document so.

Order: ascending doc_id, nulls first, equal ids as they are read from the input. Null and empty texts are the end
id alone; repeated rows are written each; an empty table makes a manifest without files; columns other
than doc_id and text are not read. The folder must be one that pyarrow's file systems reach (local or
mounted paths, hdfs, object stores) from the driver and every executor.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fieldloom.llm.elias_fano import EliasFano
from fieldloom.llm.packing import BYTE_LETTERS

FORMAT, MAGIC, MANIFEST, END_ID = "fieldloom_token_files", b"FLTOKEN1", "manifest.json", 2
#: Ids after which a task begins a new file, and those of a range that is read at once.
FILE_IDS, RANGE_IDS = 1 << 27, 1 << 21
#: Pieces of text whose ids a worker remembers, and the bytes of the longest.
KNOWN, KNOWN_BYTES = 500_000, 64

_SPACE = re.compile(r" (?=[^\s᠎])")
_ODD_SPACE = re.compile(r" (?:[\s᠎]|\Z)")
#: Marks that never begin a contraction nor go on with a word; a row of them is one word.
_MARKS = ".,!?;:"
BYTE_LETTERS_OF_SPACE = chr(BYTE_LETTERS[ord(" ")])


class Encoder:
    """Ids of texts by a byte-level vocabulary whose words begin with the space before them.

    No word of such a vocabulary spans the place before a space that something other than white space follows, so
    what stands between two such places is encoded alone and remembered.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.end = np.array([end_id], self.kind).tobytes()
        #: Ids of pieces with a space before them, and of letters or marks alone without one.
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _merged(self, word: str, spaced: bool = False) -> bytes:
        """Ids of what the vocabulary surely takes as one word, by its merges alone."""
        letters = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
        if spaced:
            letters = BYTE_LETTERS_OF_SPACE + letters
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The same, remembered; for words without a space before them."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) > KNOWN:
                self.words = {}
            ids = self._merged(word)
            if len(word) <= KNOWN_BYTES:
                self.words[word] = ids
        return ids

    def _spaced(self, word: str) -> bytes:
        """The same with the space before it; such a word is a piece itself."""
        ids = self.known.get(word)
        if ids is None:
            ids = self.before.get(word)
            if ids is None:
                ids = self._merged(word, True)
            if len(word) <= KNOWN_BYTES:
                self.known[word] = ids
        return ids

    def _learned(self, missing: dict[str, None], word) -> dict[str, bytes]:
        """Ids of pieces; word() gives those of letters alone. Most are letters and marks that close them, and lone line breaks."""
        out, rest, line_end = {}, [], self._word("\n")
        for piece in missing:
            ids = []
            of = word
            for part in piece.split("\n") if "\n" in piece else (piece,):
                core = part.rstrip(_MARKS)
                if not core.isalpha() or not (core.isascii() or max(core) < "ɐ"):
                    rest.append(piece)
                    break
                ids.append(of(core) if len(core) == len(part) else of(core) + self._word(part[len(core) :]))
                of = self._word
            else:
                out[piece] = ids[0] if len(ids) == 1 else line_end.join(ids)
        out.update(zip(rest, self._encode(rest if word == self._word else [" " + p for p in rest])))
        return out

    def _learn(self, missing: dict[str, None]) -> dict[str, bytes]:
        """Ids of pieces that are not known; those that may come again are known from now on."""
        before, known = self.before, self.known
        out = {p: before[p] for p in missing if p in before}
        if out:
            missing = {p: None for p in missing if p not in out}
        out |= self._learned(missing, self._spaced)
        known.update((p, ids) for p, ids in out.items() if len(p) <= KNOWN_BYTES and "\n" not in p)
        if len(known) > KNOWN:
            self.known, self.before = {}, known
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as bytes, with the end id."""
        out, heads, pieces, found = [self.end] * len(texts), {}, {}, {}
        get, missing = self.known.get, {}
        for k, text in enumerate(texts):
            if not text:
                continue
            if any(s in text for s in self.special):
                out[k] = self._encode([text])[0] + self.end
                continue
            cut = text.split(" ") if not _ODD_SPACE.search(text) else _SPACE.split(text)
            heads[k] = cut[0]
            cut[0] = None
            pieces[k], ids = cut, list(map(get, cut))
            found[k] = ids
            if ids.count(None) > 1:
                missing.update((p, None) for p, i in zip(cut, ids) if i is None)
        missing.pop(None, None)
        new, first = self._learn(missing), self._learned(dict.fromkeys(heads.values()), self._word)
        for k, ids in found.items():
            if ids.count(None) > 1:
                ids = [new.get(p) if i is None else i for p, i in zip(pieces[k], ids)]
            ids[0] = first[heads[k]]
            ids.append(self.end)
            out[k] = b"".join(ids)
        return out


class FileWriter:
    """One file: documents in order, then finish()."""

    def __init__(self, out, kind: str):
        self.out, self.kind, self.size = out, kind, int(kind[-1])
        self.ends, self.docs, self.nulls, self.n_ids = array("Q"), array("q"), 0, 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.nulls += 1
        else:
            self.docs.append(doc_id)
        self.out.write(ids)
        self.n_ids += len(ids) // self.size
        self.ends.append(self.n_ids)

    def finish(self) -> None:
        docs = np.frombuffer(self.docs, np.int64) if self.docs else np.zeros(0, np.int64)
        least = int(docs[0]) if len(docs) else 0
        bounds = EliasFano.of(np.r_[np.zeros(1, np.uint64), np.frombuffer(self.ends, np.uint64)] if self.ends else np.zeros(1, np.uint64))
        names = EliasFano.of((docs - np.int64(least)).view(np.uint64))
        parts = bounds.parts() + names.parts()
        for p in parts:
            self.out.write(p)
        lengths = struct.pack("<8Q", *map(len, parts))
        footer = struct.pack("<BQQQq", self.size, len(self.ends), self.n_ids, self.nulls, least)
        self.out.write(lengths + footer + struct.pack("<I", zlib.crc32(b"".join(parts) + lengths + footer)) + MAGIC)


TAIL = struct.calcsize("<8Q") + struct.calcsize("<BQQQq") + 4 + len(MAGIC)


class File:
    """A file's sequences, and ids by places of documents; `source` is an open random-access file."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < TAIL:
            raise ValueError("not a token file: too short")
        source.seek(size - TAIL)
        tail = source.read(TAIL)
        if tail[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file: no mark at the end")
        lengths = struct.unpack_from("<8Q", tail)
        self.size, self.n_docs, self.n_ids, self.nulls, self.least = struct.unpack_from("<BQQQq", tail, 64)
        source.seek(size - TAIL - sum(lengths))
        raw = source.read(sum(lengths))
        if zlib.crc32(raw + tail[: -4 - len(MAGIC)]) != struct.unpack_from("<I", tail, TAIL - 4 - len(MAGIC))[0]:
            raise ValueError("a token file's boundaries are damaged")
        if size != self.n_ids * self.size + sum(lengths) + TAIL:
            raise ValueError("a token file's length is not what its footer says")
        ends = np.cumsum(lengths)
        parts = [raw[e - n : e] for e, n in zip(ends.tolist(), lengths)]
        self.bounds = EliasFano.of_parts(self.n_docs + 1, parts[:4])
        self.names = EliasFano.of_parts(self.n_docs - self.nulls, parts[4:])

    def starts(self, first: int, last: int) -> np.ndarray:
        """Where documents first..last begin; last may be the number of documents."""
        return self.bounds[np.arange(first, last + 1)].astype(np.int64)

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """The doc_ids of documents first..last-1."""
        known = np.arange(max(first, self.nulls), max(last, self.nulls)) - self.nulls
        values = (self.names[known].view(np.int64) + np.int64(self.least)).tolist() if len(known) else []
        return [None] * max(0, min(last, self.nulls) - first) + values

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from start to before stop, as 32-bit integers."""
        self.source.seek(start * self.size)
        raw = self.source.read((stop - start) * self.size)
        if len(raw) != (stop - start) * self.size:
            raise ValueError("a token file ends too soon")
        return np.frombuffer(raw, f"<u{self.size}").astype("<u4")


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def _manifest(path: str) -> list[dict]:
    system, root = _filesystem(path)
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())["files"]


@dataclass
class Written(WriterCommitMessage):
    files: list


@dataclass
class Range(InputPartition):
    name: str
    first: int
    last: int
    base: int


class TokenFiles(DataSource):
    """Spark's `fieldloom_token_files`: rows (doc_id, ids as bytes) are written, (doc_id, start, n_tokens, ids) are read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("rangeids", RANGE_IDS)))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["width"], int(self.options.get("fileids", FILE_IDS)))


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: str, file_ids: int):
        self.path, self.kind, self.file_ids = path, f"<u{int(width)}", file_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        files: list[dict] = []
        out = writer = None

        def close() -> None:
            nonlocal out, writer
            if writer is not None:
                writer.finish()
                out.close()
                files[-1] |= {"docs": len(writer.ends), "ids": writer.n_ids}
                out = writer = None

        for batch in iterator:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if writer is None:
                    name = f"ids-{task.partitionId():06d}-{len(files):04d}-{uuid.uuid4().hex[:12]}.bin"
                    out = system.open_output_stream(f"{root}/{name}", buffer_size=1 << 20)
                    writer = FileWriter(out, self.kind)
                    files.append({"task": task.partitionId(), "name": name})
                writer.add(doc_id, ids.as_py())
                if writer.n_ids >= self.file_ids:
                    close()
        close()
        return Written(files)

    def commit(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: (f["task"], f["name"]))
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"files": files}).encode())

    def abort(self, messages: list) -> None:
        system, root = _filesystem(self.path)
        for f in (f for m in messages if m is not None for f in m.files):
            system.delete_file(f"{root}/{f['name']}")


class Reader(DataSourceReader):
    def __init__(self, path: str, range_ids: int):
        self.path, self.range_ids = path, range_ids

    def partitions(self) -> list[Range]:
        out, base = [], 0
        for f in _manifest(self.path):
            several = max(1, -(-f["ids"] // self.range_ids))
            marks = [f["docs"] * k // several for k in range(several + 1)]
            out += [Range(f["name"], a, b, base) for a, b in zip(marks, marks[1:]) if b > a]
            base += f["ids"]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks so where there are no ranges
            return
        system, root = _filesystem(self.path)
        with system.open_input_file(f"{root}/{partition.name}") as source:
            file = File(source)
            at = file.starts(partition.first, partition.last)
            k = 0
            while k < len(at) - 1:
                # documents of about a quarter of a range at once, one at least
                stop = max(k + 1, int(np.searchsorted(at, at[k] + self.range_ids // 4, side="right")) - 1)
                ids = file.ids(int(at[k]), int(at[stop])).tobytes()
                begin = at[k:stop]
                pieces = [ids[4 * a : 4 * b] for a, b in zip((begin - at[k]).tolist(), (at[k + 1 : stop + 1] - at[k]).tolist())]
                columns = [
                    pa.array(file.doc_ids(partition.first + k, partition.first + stop), pa.int64()), pa.array(begin + partition.base),
                    pa.array(at[k + 1 : stop + 1] - begin), pa.array(pieces, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
                k = stop


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """A worker's one encoder of that file."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _tokenized(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        gc.disable()  # a task makes millions of strings and no cycles
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    part = batch.slice(low, 64)
                    ids = encoder(path, end_id).ids(part.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        finally:
            gc.enable()

    return run


def write(documents: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Writes all documents' ids to files in the folder path; tokenizer is a vocabulary file's path on every executor."""
    spark = documents.sparkSession
    spark.dataSource.register(TokenFiles)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("at"))
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), "at").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "at")
    ids = ordered.select("doc_id", "text").mapInArrow(_tokenized(tokenizer, end_id), "doc_id long, ids binary")
    width = encoder(tokenizer, end_id).kind[-1]
    ids.write.format(FORMAT).option("width", width).option("fileids", file_ids).mode("append").save(path)


def read(spark: SparkSession, path: str, range_ids: int = RANGE_IDS) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (little-endian unsigned 32 bits) of all documents in path."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).option("rangeids", range_ids).load(path)


def document(path: str, place: int) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of the document at that place of the order, by the select structures alone."""
    system, root = _filesystem(path)
    for f in _manifest(path):
        if place < f["docs"]:
            with system.open_input_file(f"{root}/{f['name']}") as source:
                file = File(source)
                a, b = file.starts(place, place + 1).tolist()
                return file.doc_ids(place, place + 1)[0], file.ids(a, b)
        place -= f["docs"]
    raise IndexError("no document at that place")
