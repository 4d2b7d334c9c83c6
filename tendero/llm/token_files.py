"""Token ids of documents in binary files, with Elias-Fano coded document boundaries.

A file holds the ids of consecutive documents one after the other, in the narrowest type for the
vocabulary, then the boundaries, the document ids and a footer that says where each lies. Files
come in ascending order of document id; a task writes its own and names it in a row that
Spark commits, so a file left by a lost or repeated task is never read.
"""

from __future__ import annotations

import json
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tendero.llm.elias_fano import EliasFano
from tendero.llm.files import create, reader
from tendero.llm.tables import written
from tendero.llm.words import slices
from tendero.sources.shared import new_path

END_ID = 0
#: A file is closed at either of these.
FILE_BYTES, FILE_DOCUMENTS = 512 << 20, 1 << 20
#: Documents whose boundaries are decoded together, and ids that are read at once.
READ_DOCUMENTS, READ_IDS = 4096, 1 << 20
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 1_000_000
CLOSING = ".,;:!?"
#: A closing mark after another mark is part of one piece with it.
RUN = re.compile(rf"(?:[^\w\s]|_)[{CLOSING}]")


class _Uncuttable(Exception):
    """A piece that says nothing about where its text may be cut."""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


class _Pieces(dict):
    """Ids of pieces as bytes; an unknown piece is encoded when it is asked for, and kept while there is room."""

    def __init__(self, tokenizer: Tokenizer, code: str, special: list[str]):
        super().__init__()
        self.tokenizer, self.model, self.code, self.special = tokenizer, tokenizer.model, code, special
        self.letters = _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        spaced = piece[:1] == " "
        word = piece[1:] if spaced else piece
        if word.isascii() and word.isalpha():  # stands for itself but for the space
            ids = [t.id for t in self.model.tokenize(self.letters[32] + word if spaced else word)]
        elif word.isalpha() and max(word) < "\u0530":
            ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        elif piece != "\n" and (not word or word[0].isspace() or word[-1].isspace()) or any(s in piece for s in self.special):
            raise _Uncuttable
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        made = array(self.code, ids).tobytes()
        if len(self) < REMEMBERED:
            self[piece] = made
        return made


class Encoder:
    """Ids of whole texts as bytes, by the tokenizers library.

    Byte-level pre-tokenisation always starts a new piece at a single space between two characters that
    are no space, makes a piece of a line feed between two such, and parts closing punctuation from a letter
    or number before it. So a text is cut there, and each piece is encoded once and remembered.
    A text with other space around a cut, or with the name of a special token, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        self.tokenizer = Tokenizer.from_file(path)
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind, self.code = ("<u2", "H") if small else ("<u4", "I")
        known = json.loads(self.tokenizer.to_str())
        before = known.get("pre_tokenizer") or {}
        special = [x["content"] for x in known.get("added_tokens", [])]
        self.cuts = (before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                     and not known.get("normalizer") and not known.get("post_processor")
                     and not any(s.strip().isalpha() for s in special) and sys.byteorder == "little")
        self.pieces = _Pieces(self.tokenizer, self.code, special)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cuts or "\0" in text:
            return self._whole(text)
        cut = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
        if not RUN.search(text):
            for mark in CLOSING:
                cut = cut.replace(mark, "\0" + mark)
        try:
            return b"".join(map(self.pieces.__getitem__, cut.split("\0")))
        except _Uncuttable:
            return self._whole(text)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Writer:
    """One file: ids as they come, the rest when it is closed."""

    def __init__(self, folder: str, kind: str):
        self.uri, self.kind = f"{folder}/{uuid.uuid4().hex}.ids", kind
        self.out, self.size, self.ends, self.ids = create(self.uri), 0, [0], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.size += len(ids)
        self.ends.append(self.size // np.dtype(self.kind).itemsize)
        self.ids.append(doc_id)

    def close(self) -> tuple[str, int, int]:
        head, parts = EliasFano.of(np.array(self.ends)).parts()
        sink = pa.BufferOutputStream()
        named = pa.record_batch({"doc_id": pa.array(self.ids, pa.int64())})
        with pa.ipc.new_stream(sink, named.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(named)
        parts.append(sink.getvalue().to_pybytes())
        for part in parts:
            self.out.write(part)
        foot = json.dumps(head | {"kind": self.kind, "ids": self.size, "parts": [len(x) for x in parts]}).encode()
        self.out.write(foot + len(foot).to_bytes(8, "little"))
        self.out.close()
        return self.uri, len(self.ids), self.ends[-1]


class TokenFile:
    """Reads one file by ranges."""

    def __init__(self, uri: str):
        self.file = reader(uri)
        size = self.file.size()
        length = int.from_bytes(self.file.read_at(8, size - 8), "little")
        self.head = json.loads(self.file.read_at(length, size - 8 - length))
        at, parts = self.head["ids"], []
        for n in self.head["parts"]:
            parts.append(self.file.read_at(n, at))
            at += n
        self.bounds = EliasFano.from_parts(self.head, parts[:3])
        self.doc_ids = pa.ipc.open_stream(parts[3]).read_all().column("doc_id")
        self.kind = np.dtype(self.head["kind"])

    def __len__(self) -> int:
        return self.bounds.count - 1

    def between(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.kind.itemsize, start * self.kind.itemsize), self.kind)

    def sums(self, bounds: np.ndarray) -> list[int]:
        """CRC of the ids between each boundary and the next, as 32-bit numbers. Short neighbours are read together, a long one in parts."""
        sums, i, last = [], 0, len(bounds) - 1
        while i < last:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + READ_IDS, "right")) - 1)
            if bounds[j] - bounds[i] > READ_IDS:
                crc = 0
                for at in range(int(bounds[i]), int(bounds[j]), READ_IDS):
                    crc = zlib.crc32(self.between(at, min(at + READ_IDS, int(bounds[j]))).astype("<u4").tobytes(), crc)
                sums.append(crc)
            else:
                ids = self.between(int(bounds[i]), int(bounds[j])).astype("<u4")
                cuts = (bounds[i:j + 1] - bounds[i]).tolist()
                sums += [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
            i = j
        return sums

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, read alone."""
        return self.between(self.bounds.select(i), self.bounds.select(i + 1))


def _write(folder: str, tokenizer: str) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = np.array([END_ID], encode.kind).tobytes()
        files, out = [], None
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode.encode(text or "")
                if out and (out.size + len(ids) > FILE_BYTES or len(out.ids) >= FILE_DOCUMENTS):
                    files.append(out.close())
                    out = None
                out = out or _Writer(folder, encode.kind)
                out.add(doc_id, ids + end)
        if out:
            files.append(out.close())
        part = TaskContext.get().partitionId()
        if files:
            uris, docs, tokens = zip(*files, strict=True)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part] * len(files), pa.int32()), "number": pa.array(range(len(files)), pa.int32()),
                "uri": pa.array(uris), "docs": pa.array(docs, pa.int64()), "tokens": pa.array(tokens, pa.int64())})

    return write


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            file = TokenFile(uri)
            for first in range(0, len(file), READ_DOCUMENTS):
                last = min(first + READ_DOCUMENTS, len(file))
                bounds = file.bounds.between(first, last + 1).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": file.doc_ids.slice(first, last - first).combine_chunks(),
                    "start": pa.array(bounds[:-1] + base), "n_tokens": pa.array(np.diff(bounds)),
                    "ids_crc32": pa.array(file.sums(bounds), pa.int64())})


def write_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``uri, base, docs, tokens`` of the files written for ``docs`` (``doc_id``, ``text``), in order.

    ``tokenizer`` is the path of a tokenizers file on every executor. Each text is encoded whole, without special
    tokens, and followed by id 0; a null or empty text is that id alone. Documents come in
    ascending order of id, rows of one id by a hash of the text, rows without id first. ``base`` is the number of ids
    in all files before. No rows give no files. Other columns are ignored.
    """
    folder = new_path(docs.sparkSession, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = texts.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    files = written(ordered.mapInArrow(_write(folder, tokenizer), "part int, number int, uri string, docs long, tokens long"), "token-files")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return written(files.select("uri", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")).alias("base"), "docs", "tokens"), "token-index")


def read_tokens(files: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files."""
    parts = max(1, files.count())
    return files.select("uri", "base").repartition(parts).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
