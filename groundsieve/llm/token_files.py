"""Token files: a wavelet matrix per shard.

``write`` range-sorts texts by id, encodes them and stores the ids, each text closed by an end id, as shards of whole texts. A
shard is one file: a header, the ids and lengths of its texts, and one compressed bit-plane per binary digit of the token ids, the
highest first. Below a plane, tokens with a 0 there stand before those with a 1, each part in its old order (the stable partition
of a wavelet matrix), so rank and select on planes answer three questions without restoring the sequence: which token
stands at a place (``access``), how many of a token a range has (``count``), and where they are (``occurrences``). A plane has a
count of ones per 512 bits, built on loading.

Files are written under a temporary name and renamed, and their content depends on the rows only, so a task that is lost and run
again leaves the same file. Spark reads them back as binary files, whole shards each: about ``tokens`` tokens, more only where a single
text has more. Shards have places inside their partition; the bases of partitions are sums over the manifest, a row per
partition.

Only the two named columns are read. Null text counts as empty and has its end id only. Rows of equal id stand in any order of
their texts; null ids come first; repeated rows are written each; texts may have any length; an empty table gives no file and
an empty table back. Where one id holds many rows, the text's digest and the row's number split them over partitions.
"""

import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundsieve.llm.bpe import Cache, _byte_of, encoder
from groundsieve.llm.common import shared_folder, written

MAGIC = b"WAVELET1"
_WORDS = 8  # 64-bit words of a counted stretch


class Plane:
    """A bit sequence with rank and select over arrays of places."""

    def __init__(self, bits: bytes, n: int):
        self.n = n
        size = -(-n // 512) * 64
        self.words = np.frombuffer(bits.ljust(size, b"\0"), "<u8")
        ones = np.bitwise_count(self.words).reshape(-1, _WORDS)
        self.before = np.concatenate([[0], np.cumsum(ones.sum(1, dtype=np.int64))])  # ones before each stretch

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        out, first, last = self.before[at >> 9].copy(), at >> 9 << 3, at >> 6
        for k in range(_WORDS - 1):
            more = first + k < last
            out[more] += np.bitwise_count(self.words[first[more] + k])
        cut = np.flatnonzero(at & 63)
        mask = (np.uint64(1) << (at[cut] & 63).astype(np.uint64)) - np.uint64(1)
        out[cut] += np.bitwise_count(self.words[last[cut]] & mask)
        return out

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the k-th (from 0) one or zero; there must be so many."""
        before = self.before if bit else np.arange(len(self.before)) * 512 - self.before
        words = self.words if bit else ~self.words
        block = np.searchsorted(before, k, "right") - 1
        left, word = k - before[block], block * _WORDS
        for _ in range(_WORDS - 1):
            inside = np.bitwise_count(words[word]).astype(np.int64)
            on = inside <= left
            left, word = left - inside * on, word + on
        bits = np.unpackbits(words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return word * 64 + np.argmax(np.cumsum(bits, 1) > left[:, None], axis=1)


class Shard:
    """One file's texts and tokens."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<I", data, 8)
        self.header = json.loads(data[12 : 12 + size])
        self.n, self.bits, self.zeros, self.part, self.start = (self.header[k] for k in ("n", "bits", "zeros", "part", "start"))
        at, self._sections = 12 + size, []
        for packed, plain in self.header["sections"]:
            self._sections.append((data[at : at + packed], plain))
            at += packed

    def _section(self, k: int) -> bytes:
        packed, plain = self._sections[k]
        return pa.decompress(packed, plain, codec="zstd", asbytes=True) if plain else b""

    @cached_property
    def ids(self) -> pa.Array:
        """The texts' ids, nulls among them."""
        known = np.frombuffer(self._section(1), np.uint8).astype(bool)
        return pa.array(np.frombuffer(self._section(0), "<i8"), pa.int64(), mask=~known)

    @cached_property
    def ends(self) -> np.ndarray:
        """Where each text ends in the shard."""
        return np.cumsum(np.frombuffer(self._section(2), "<i8"))

    @lru_cache(maxsize=None)
    def plane(self, k: int) -> Plane:
        return Plane(self._section(3 + k), self.n)

    def tokens(self) -> np.ndarray:
        """All tokens: planes undone from the lowest up, one stable merge each."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for k in reversed(range(self.bits)):
            bit = np.unpackbits(np.frombuffer(self._section(3 + k), np.uint8), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            above[~bit] = out[: self.zeros[k]]
            above[bit] = out[self.zeros[k] :] | out.dtype.type(1 << (self.bits - 1 - k))
            out = above
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """Tokens at places of the shard."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.uint32)
        for k in range(self.bits):
            bit, ones = self.plane(k).get(at), self.plane(k).ones(at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, self.zeros[k] + ones, at - ones)
        return out

    def _range(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the token's occurrences in [low, high) stand below the last plane."""
        span = np.array([low, high], np.int64)
        if not 0 <= token < 1 << self.bits:
            return 0, 0
        for k in range(self.bits):
            ones = self.plane(k).ones(span)
            span = self.zeros[k] + ones if token >> (self.bits - 1 - k) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        first, last = self._range(token, low, self.n if high is None else high)
        return last - first

    def occurrences(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ascending places of the token: selects from the last plane back to the first."""
        at = np.arange(*self._range(token, low, self.n if high is None else high))
        for k in reversed(range(self.bits)):
            if len(at):
                bit = token >> (self.bits - 1 - k) & 1
                at = self.plane(k).select(at - self.zeros[k] if bit else at, bit)
        return at


def shard(ids: list[int | None], lengths: list[int], tokens: np.ndarray, part: int, start: int) -> bytes:
    """The file of texts with these ids and lengths, whose tokens follow each other."""
    n, bits = len(tokens), max(1, int(tokens.max(initial=0)).bit_length())
    known = np.array([i is not None for i in ids], np.uint8)
    sections = [np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), np.array(lengths, "<i8").tobytes()]
    zeros, now = [], tokens.astype(np.uint16 if bits <= 16 else np.uint32)
    for k in reversed(range(bits)):
        bit = (now >> now.dtype.type(k) & now.dtype.type(1)).astype(bool)
        sections.append(np.packbits(bit, bitorder="little").tobytes())
        low = now[~bit]
        zeros.append(len(low))
        now = np.concatenate([low, now[bit]])
    packed = [pa.compress(s, codec="zstd", asbytes=True) if s else b"" for s in sections]
    header = {"n": n, "bits": bits, "zeros": zeros, "part": part, "start": start, "sections": [[len(p), len(s)] for p, s in zip(packed, sections)]}
    head = json.dumps(header).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, *packed])


class WordIds(dict):
    """Little-endian 32-bit token ids by word; words beyond ``most`` are encoded anew each time.

    The library's model encodes every distinct pre-token once. A word with ``<|`` in it, which may hold a special string, goes
    through the library's whole encoder.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library, self.own, self.most = Tokenizer.from_file(path), encoder(path), most
        self.model = self.library.model
        shown = {b: c for c, b in _byte_of().items()}
        self.shown = str.maketrans({chr(b): c for b, c in shown.items()})
        self.pieces = Cache(self._piece)

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        if "<|" in text:
            value = array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        else:
            value = b"".join(map(self.pieces.__getitem__, self.own._pieces.findall(self.own._normal(text))))
        if len(self) < self.most and len(word) <= 64:
            self[word] = value
        return value

    def _piece(self, piece: str) -> bytes:
        found = self.model.tokenize(piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.shown))
        return array("I", [t.id for t in found]).tobytes()

    def ids(self, text: bytes) -> bytes:
        """A text's ids. No token, composition or special string of the vocabulary spans ASCII white space."""
        return b"".join(map(self.__getitem__, text.split()))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One per process and file."""
    return WordIds(path)


class Files(NamedTuple):
    """Written token files: the folder and its manifest (part, shard, n_docs, n_tokens), a row per file."""

    folder: str
    manifest: DataFrame


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI, by Spark's own file systems."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri


def put(uri: str, data: bytes, attempt: str) -> None:
    """Write a file under a temporary name, then give it its own."""
    files, path = pa.fs.FileSystem.from_uri(uri)
    folder, name = path.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    temporary = f"{folder}/_{attempt}-{name}"
    with files.open_output_stream(temporary) as out:
        out.write(data)
    files.move(temporary, path)


def write(docs: DataFrame, path: str, folder: str | None = None, doc_id: str = "doc_id", text: str = "text", closing: int = 1, tokens: int = 1 << 20) -> Files:
    """Encode ``docs`` into token files under ``folder`` (a new one in the shared folder unless given), in ascending order of ids."""
    spark = docs.sparkSession
    uri = qualified(spark, folder or shared_folder(spark))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    rows = rows.withColumns({"sum": F.crc32("text"), "row": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(n, "doc_id", "sum", "row").sortWithinPartitions("doc_id", "sum", "row")
    ranged = ranged.select("doc_id", "text", F.spark_partition_id().alias("part"))
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        of, end = word_ids(path).ids, np.array([closing], "<u4").tobytes()
        ids, lengths, parts, held, made, start, part = [], [], [], 0, [], 0, 0

        def close() -> None:
            nonlocal ids, lengths, parts, held, start
            data = shard(ids, lengths, np.frombuffer(b"".join(parts), "<u4"), part, start)
            put(f"{uri}/part-{part:06d}-{len(made):06d}.wm", data, uuid4().hex)
            made.append((part, len(made), len(ids), held))
            start, ids, lengths, parts, held = start + held, [], [], [], 0

        for b in batches:
            for ident, t, part in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["part"].to_pylist()):
                data = of(t) + end
                ids.append(ident)
                lengths.append(len(data) // 4)
                parts.append(data)
                held += len(data) // 4
                if held >= tokens:
                    close()
        if ids:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], f.type) for k, f in enumerate(schema)], schema=schema)

    manifest = written(ranged.mapInArrow(build, "part int, shard int, n_docs long, n_tokens long"))
    return Files(uri, manifest)


def bases(files: Files) -> dict[int, int]:
    """Tokens before every partition: one row a partition reaches the driver."""
    sums = {r.part: r.n for r in files.manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    out, before = {}, 0
    for part in sorted(sums):
        out[part], before = before, before + sums[part]
    return out


def shards(files: Files) -> DataFrame:
    """The files' contents, a row each."""
    reader = files.manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.wm").schema(
        "path string, modificationTime timestamp, length long, content binary")
    return reader.load(files.folder).select("content")


def _mapped(files: Files, row_of, schema: pa.Schema, ddl: str) -> DataFrame:
    if not files.manifest.limit(1).count():
        return files.manifest.sparkSession.createDataFrame([], ddl)
    before = bases(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b["content"]:
                s = Shard(content.as_py())
                yield pa.RecordBatch.from_arrays(row_of(s, before[s.part] + s.start), schema=schema)

    return shards(files).mapInArrow(read, ddl)


def texts(files: Files) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every text, from the files' own tokens."""

    def rows(s: Shard, base: int) -> list[pa.Array]:
        data, ends = s.tokens().astype("<u4").tobytes(), s.ends
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        sums = [zlib.crc32(data[4 * lo : 4 * hi]) for lo, hi in zip(first.tolist(), ends.tolist())]
        return [s.ids, pa.array(base + first), pa.array(ends - first), pa.array(sums, pa.int64())]

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    return _mapped(files, rows, schema, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(files: Files, token: int) -> DataFrame:
    """doc_id, position, place: every occurrence of a token, by its place in all ids and in its text, found by select."""

    def rows(s: Shard, base: int) -> list[pa.Array]:
        at = s.occurrences(token)
        doc = np.searchsorted(s.ends, at, "right")
        first = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
        return [s.ids.take(pa.array(doc)), pa.array(base + at), pa.array(at - first[doc])]

    schema = pa.schema([("doc_id", pa.int64()), ("position", pa.int64()), ("place", pa.int64())])
    return _mapped(files, rows, schema, "doc_id long, position long, place long")


def counts(files: Files, wanted: list[int]) -> DataFrame:
    """token, n: occurrences of each wanted token, by rank alone."""

    def rows(s: Shard, base: int) -> list[pa.Array]:
        return [pa.array(wanted, pa.int64()), pa.array([s.count(t) for t in wanted], pa.int64())]

    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])
    return _mapped(files, rows, schema, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
