"""Token ids in binary files: independent zstandard frames, a document index, and a trailing seek table.

A file is a sequence of zstandard frames in the public seekable format, so any zstandard reader can unpack it whole:

* frames of at most FRAME_IDS ids (little-endian, unsigned, 32 bits), each with its own checksum;
* a skippable frame with the document index: doc_id and number of ids of every document, in file order;
* a skippable frame with the seek table: packed size, size and XXH64 of every frame before, and the closing magic number.

Spark's own text writer writes the files, one frame a row, so a task that is repeated leaves one file and any file system that
Spark knows will do. The writer ends each row with a separator, here the single byte 8F: that is the last byte of the
magic number at the end of a file, and elsewhere the content of a skippable frame of one byte that each row ends with.
"""

from __future__ import annotations

import io
import re
import struct
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import accumulate
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from structnet.llm.common import map_rows, texts, written
from structnet.llm.tokens import SPECIAL, vocabulary

# Fixed values of the public seekable format.
SKIPPABLE, SEEK_TABLE, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

INDEX = SKIPPABLE + 1
SEPARATOR = b"\x8f"
FRAME_IDS = 1 << 16
#: UTF-8 bytes of text that a file is made of, about; its ids take half of that, packed.
FILE_BYTES = 128 << 20
END_ID = 0
#: Characters that are encoded at a time, and word pieces whose ids a worker remembers.
PART, MEMO = 1 << 20, 400_000

#: No rule of the vocabulary joins what stands before such a space to what follows.
_BORDER = re.compile(r"(?<=\S)(?= \S)")
#: Texts of ASCII and Latin letters are cut further, always where the vocabulary's pattern parts words: into words with the space before,
#: apostrophes or a second blank with the word that follows, and what else stands between words.
_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_BLANK = " \t\n\r\x0b\x0c"
_PLAIN = re.compile(f"[\x00-\x7f{_L}]*")
_PIECE = re.compile(f" ?[{_L}]+|[^{_L}]*(?:[{_BLANK}] |')[{_L}]+|[^{_L}]+?(?= [{_L}])|[^{_L}]+")
_WORD = re.compile(f" ?[{_L}]+")
_ENTRY = struct.Struct("<III")
_FOOTER = struct.Struct("<IBI")


# --- ids -----------------------------------------------------------------------------------------------------------

def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: its own if it is printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class _Memo(dict):
    """Ids of word pieces, by the tokenizers library; of MEMO pieces or more the older half is forgotten."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.merge = whole.encode, whole.model.tokenize
        self.letters, self.older = _byte_letters(), {}
        self.blank = self.letters[32]
        self.raw = [i.to_bytes(4, "little") for i in range(whole.get_vocab_size())]

    def ids(self, text: str) -> bytes:
        return np.array(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece) or self._new(piece)
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = found
        return found

    def _new(self, piece: str) -> bytes:
        if _WORD.fullmatch(piece):  # one word, so its merges are all there is to do
            if piece.isascii():
                shown = self.blank + piece[1:] if piece[0] == " " else piece
            else:
                shown = piece.encode().decode("latin-1").translate(self.letters)
            return b"".join([self.raw[t.id] for t in self.merge(shown)])
        if piece[-1] in _BLANK:  # a word follows, which the last blank is not part of
            return self.ids(piece + "a")[:-4]
        return self.ids(piece)


@lru_cache(maxsize=2)
def _memo(path: str) -> _Memo:
    return _Memo(path)


def encoded(text: str, path: str) -> Iterator[bytes]:
    """The ids of a text, in parts: little-endian, unsigned, 32 bits.

    They are those of the whole text: it is cut only where the vocabulary's pattern always parts words. A text that
    names the special token is encoded whole.
    """
    memo = _memo(path)
    if SPECIAL in text:
        yield memo.ids(text)
        return
    start = 0
    while start < len(text):
        border = _BORDER.search(text, start + PART)
        stop = border.start() if border else len(text)
        part = text[start:stop] if border or start else text
        plain = _PLAIN.fullmatch(part)
        pieces = _PIECE.findall(part) if plain else _BORDER.split(part)
        last = pieces.pop() if pieces[-1][-1] in _BLANK or not plain else ""  # what follows blanks matters, and here nothing does
        yield b"".join(map(memo.__getitem__, pieces))
        if last:
            yield memo.ids(last)
        start = stop


# --- files ---------------------------------------------------------------------------------------------------------

def _skippable(magic: int, content: bytes) -> bytes:
    """A skippable frame without its last byte, which the separator of rows will be."""
    return struct.pack("<II", magic, len(content) + 1) + content


class _Frames:
    """The rows of one file. Holds at most a frame's ids and the index so far."""

    def __init__(self) -> None:
        self.held, self.docs, self.counts, self.entries = bytearray(), [], [], []
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, parts: Iterable[bytes]) -> Iterator[bytes]:
        n = 0
        for part in parts:
            n += len(part) // 4
            self.held += part
            while len(self.held) >= 4 * FRAME_IDS:
                yield self._frame(4 * FRAME_IDS)
        self.docs.append(doc_id)
        self.counts.append(n)

    def _frame(self, size: int) -> bytes:
        raw = bytes(self.held[:size])
        del self.held[:size]
        packed, gap = self.compressor.compress(raw), _skippable(SKIPPABLE, b"")
        self.entries += [(len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF), (len(gap) + 1, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        return packed + gap

    def close(self) -> Iterator[bytes]:
        if self.held:
            yield self._frame(len(self.held))
        null = np.array([d is None for d in self.docs], np.uint8)
        ids = np.array([d or 0 for d in self.docs], "<i8")
        index = _skippable(INDEX, self.compressor.compress(null.tobytes() + ids.tobytes() + np.array(self.counts, "<u8").tobytes()))
        self.entries.append((len(index) + 1, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        yield index
        table = b"".join(_ENTRY.pack(*e) for e in self.entries) + _FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        yield _skippable(SEEK_TABLE, table[:-1])


class TokenFile:
    """Random access to a file of this format: reads the seek table and the index, then only the frames that a document lies in."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.frames_read = source, 0
        end = source.seek(0, io.SEEK_END)
        n, kind, magic = _FOOTER.unpack(self._bytes(end - _FOOTER.size, _FOOTER.size)) if end >= 17 else (0, 0, 0)
        if magic != SEEKABLE_MAGIC or not kind & HAS_CHECKSUMS:
            raise ValueError("no token file: it does not end in a seek table with checksums")
        table = self._bytes(end - _FOOTER.size - n * _ENTRY.size, n * _ENTRY.size)
        entries = [_ENTRY.unpack_from(table, i * _ENTRY.size) for i in range(n)]
        at = list(accumulate((e[0] for e in entries), initial=0))
        self.frames = [(p, *e) for p, e in zip(at, entries, strict=False) if e[1]]
        self.starts = list(accumulate((f[2] // 4 for f in self.frames), initial=0))
        size = entries[-1][0]
        raw = zstandard.ZstdDecompressor().decompress(self._bytes(at[n - 1] + 8, size - 9))
        n_docs = len(raw) // 17
        null, ids = np.frombuffer(raw, np.uint8, n_docs), np.frombuffer(raw, "<i8", n_docs, n_docs)
        self.counts = np.frombuffer(raw, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.docs = [None if x else int(d) for x, d in zip(null, ids, strict=True)]
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.counts)])[:n_docs]
        self._last: tuple[int, bytes] | None = None

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _frame(self, i: int) -> bytes:
        if self._last is None or self._last[0] != i:
            at, packed, size, check = self.frames[i]
            raw = zstandard.ZstdDecompressor().decompress(self._bytes(at, packed), max_output_size=size)
            if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {i} does not have the checksum of the seek table")
            self.frames_read += 1
            self._last = i, raw
        return self._last[1]

    def ids(self, place: int) -> bytes:
        """The ids of the ``place``-th document of the file."""
        start, n = int(self.first[place]), int(self.counts[place])
        out, i = [], bisect_right(self.starts, start) - 1
        while n > 0:
            at = start - self.starts[i]
            part = self._frame(i)[4 * at:4 * (at + n)]
            out.append(part)
            start, n, i = start + len(part) // 4, n - len(part) // 4, i + 1
        return b"".join(out)


# --- Spark ---------------------------------------------------------------------------------------------------------

def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str | None = None, file_bytes: int = FILE_BYTES) -> None:
    """Encode ``docs(doc_id, text, ...)`` into token files under ``folder``, in ascending order of doc_id over all files.

    Every text, null ones as empty, is followed by the id 0. Null ids come first; rows that share an id stay in the order they are
    read in, and rows that repeat are all written, over several files if they are many. Other columns are ignored. An
    empty table gives no document. A file holds the documents of one range of ids, about ``file_bytes`` of text; a text
    is never cut over files, but over frames.
    """
    path = vocabulary_path or vocabulary()[0]
    docs = texts(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    order = ["doc_id", "row"]
    rows = docs.withColumn("row", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def pieces(rows: Iterator[tuple]) -> Iterator[tuple]:
        frames = None
        for doc_id, text in rows:
            frames = frames or _Frames()

            def parts(text: str = text) -> Iterator[bytes]:
                yield from encoded(text, path)
                yield END_ID.to_bytes(4, "little")

            for piece in frames.add(doc_id, parts()):
                yield (piece,)
        if frames:
            for piece in frames.close():
                yield (piece,)

    out = map_rows(ordered, pieces, ["doc_id", "text"], "piece binary", pa.schema([("piece", pa.binary())]), size=16)
    out.select(F.col("piece").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(folder)


def _scanned(spark: SparkSession, folder: str, found: Callable[[TokenFile], Iterator[tuple]], ddl: str, arrow: pa.Schema, size: int) -> DataFrame:
    """Rows that ``found`` gives for each file, each with the file's number first."""
    files = spark.read.format("binaryFile").load(folder).where("length > 0")
    number = F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for file, content in rows:
            for row in found(TokenFile(io.BytesIO(content))):
                yield file, *row

    return map_rows(files.select(number.alias("file"), "content"), run, ["file", "content"], f"file long, {ddl}", pa.schema([("file", pa.int64()), *arrow]), size)


def file_starts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file: file, n_docs, n_ids, and start, the number of ids in the files before it."""
    sizes = _scanned(spark, folder, lambda f: iter([(len(f.docs), int(f.counts.sum()))]), "n_docs long, n_ids long", pa.schema([("n_docs", pa.int64()), ("n_ids", pa.int64())]), 100)
    # One row a file in this window, which are as many as the writer's tasks.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return written(sizes).withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def read_documents(spark: SparkSession, folder: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document, or of the ``doc_ids`` asked for.

    Of the files, only frames that hold a document asked for are unpacked, and each is held against its checksum; a frame that
    does not match stops the job. ``doc_ids`` travels with the tasks, so it should name some, not a corpus.
    """
    wanted = None if doc_ids is None else frozenset(doc_ids)

    def found(file: TokenFile) -> Iterator[tuple]:
        for place, doc_id in enumerate(file.docs):
            if wanted is None or doc_id in wanted:
                yield doc_id, int(file.first[place]), int(file.counts[place]), file.ids(place)

    arrow = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    docs = _scanned(spark, folder, found, "doc_id long, at long, n_tokens long, ids binary", arrow, 64)
    starts = file_starts(spark, folder).select("file", F.col("start").alias("of_file"))
    # 16 bytes a file, and a file holds FILE_BYTES of text: 13 MB for 100 TB. A shuffle would carry the ids.
    return docs.join(F.broadcast(starts), "file").select("doc_id", (F.col("of_file") + F.col("at")).alias("start"), "n_tokens", "ids")


def new_folder(spark: SparkSession) -> str:
    """A new folder for token files below the session's shared folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    return f"{shared.rstrip('/')}/token-files-{uuid.uuid4().hex}"
