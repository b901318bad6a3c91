"""Language-model scores from a hierarchical Pitman-Yor model.

Tokens are white-space separated words (A-Z lower-cased) and one end token a text. Every word that was followed by another in
training has a restaurant of its own for the word after it; the end token is the context of a text's first word. Contexts are
exact words, never hashed. They share one context-free word restaurant, whose customers are their tables. Its base distribution
spells a word byte by byte with a byte model of its own: restaurants for contexts of three bytes share the parent of their last
byte, those share the empty context, and that one a uniform base. Every table of the word restaurant sends one spelling to the
byte restaurants, so any word, seen or not, has a probability after any other and all of them add up to 1.

Word pairs are kept in blocks: words fall into slices by hash, a block holds the pairs of one slice of first words and one of
second words, so a frequent word is spread over as many blocks as there are slices. Pairs are shuffled once, with the rows that hold
them; a block is written once and seated and scored where it is, from the files of its two slices. Out of a block come sums by
word and sums by document, packed into one row a range of documents: ``CHUNKS`` ranges a slice, so that rows stay few and long at any
size, and a range is added up in one task. Pairs of two words that each make up more than a ``SHARE``-th of all tokens (at most SHARE x SHARE
pairs) send only their counts; their occurrences stay together by task, and their probabilities are broadcast and looked up there.

Seating is sampled by Gibbs sweeps. In each, every dish's tables are drawn anew from the Chinese-restaurant process given
its parent's probabilities and the restaurants' totals of the sweep before; ``SAMPLES`` states after ``BURN_IN`` sweeps are
kept and their predictive probabilities averaged. The first sweep seats one table a word pair. Draws repeat by seed and block, so
scoring draws a state's tables again instead of storing them. Discounts come from counts of counts. Every distinct word and word
pair is kept; only the spelling's byte contexts, at most 2^18 restaurants, and a block with its slices are held in memory.

Null texts count as empty: one end token. Held-out rows are scored and never counted. Without training rows the words'
probability is their spelling's. Repeated rows count and score each. An empty table gives an empty table.
"""

import math
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import pyarrow.parquet
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from groundsieve.llm.common import shared_folder, written
from groundsieve.llm.token_files import qualified

END = b"\n"  # the end token: no word holds white space
BURN_IN, SAMPLES, SHARE, STRENGTH = 1, 2, 1000, 1.0
BLOCK, _FLUSH, _GATHERED = 1_200_000, 900_000, 20 << 20  # tokens a block holds, about; tokens, and bytes of words to count, that a task gathers
_TEXTS = 500  # texts that go to a task's Python at a time
CHUNKS, _PARTS = 4, 500_000  # ranges of documents a slice; partial sums that a task gathers before it adds them up
_ZSTD, _UNZSTD = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def give_back() -> None:
    """What Arrow has freed goes back to the system: workers live on through all jobs, next to the executor's heap."""
    pa.default_memory_pool().release_unused()


def words(text: str | None) -> list[bytes]:
    """Of one text; ``tokens`` cuts many by the same rule."""
    return (text or "").encode().lower().split()  # on bytes: A-Z and the six ASCII white-space bytes only


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after the other, as ``words`` has them, and how many each text has."""
    cut = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(pa.compute.fill_null(texts, "")))
    real = pa.compute.not_equal(pa.compute.binary_length(cut.values), 0)  # white space at a text's ends leaves empty words
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return cut.values.filter(real).cast(pa.binary()), np.diff(before[cut.offsets.to_numpy()])


def joined(found: pa.Array) -> pa.Array:
    """Words, each with a blank behind it, so that the bytes of some of them are their words joined."""
    return pa.compute.binary_join_element_wise(found, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()))


def text_of(spelled: pa.Array) -> pa.Buffer:
    """The bytes of joined words, the last blank too."""
    _, ends, data = spelled.buffers()
    return data[: int(np.frombuffer(ends, np.int32)[len(spelled)])] if len(spelled) else pa.py_buffer(b"")


def slices_of(spelled: pa.Array, slices: int) -> np.ndarray:
    """Of joined words; as ``crc32`` has it in Spark."""
    return np.fromiter(map(zlib.crc32, text_of(spelled).to_pybytes().split(b" ")[:-1]), np.int64, len(spelled)) % slices


def split(data: bytes) -> pa.Array:
    """The words of a joined text."""
    raw = np.frombuffer(data, np.uint8)
    blank = raw == 32
    ends = np.append(np.flatnonzero(blank), len(raw))
    offsets = np.append(0, ends - np.arange(len(ends))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(raw[~blank].tobytes())])


class Table(NamedTuple):
    """A written table in one folder a slice."""

    rows: DataFrame
    uri: str


def written_by_slice(df: DataFrame) -> Table:
    spark, at = df.sparkSession, shared_folder(df.sparkSession)
    df.write.partitionBy("slice").parquet(at)
    return Table(spark.read.schema(df.schema).parquet(at), qualified(spark, at))


def slice_rows(uri: str, number: int, columns: list[str]) -> list[pa.Array]:
    """``columns`` of one slice by id, read in a task."""
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    at = f"{path}/slice={number}"
    if files.get_file_info(at).type == pyarrow.fs.FileType.NotFound:
        return [pa.array([], pa.int64()) for _ in columns]
    t = pyarrow.parquet.read_table(at, filesystem=files, columns=["id", *columns], partitioning=None, use_threads=False)
    ids = t["id"].to_numpy()  # they run from 0 without gaps
    if (np.diff(ids) < 0).any():
        t = t.take(np.argsort(ids))
    return [t[c].combine_chunks() for c in columns]


def read_slice(uri: str, number: int, columns: list[str]) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in slice_rows(uri, number, columns)]


def numbers(uri: str, number: int, found: pa.Array) -> np.ndarray:
    """Ids of words of one slice."""
    files, path = pyarrow.fs.FileSystem.from_uri(uri)
    t = pyarrow.parquet.read_table(f"{path}/slice={number}", filesystem=files, columns=["id", "word"], partitioning=None, use_threads=False)
    at = pa.compute.index_in(found, value_set=t["word"].combine_chunks())
    if at.null_count:
        raise ValueError(f"a word of slice {number} is not in its table")
    return t["id"].to_numpy()[at.to_numpy()]


def pack(values: np.ndarray) -> bytes:
    """Integers below 2^32 as byte planes, compressed."""
    return _ZSTD.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())  # copied first: ``tobytes`` of a turned array is slow


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_UNZSTD.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pack_wide(values: np.ndarray) -> bytes:
    """64-bit integers or doubles as byte planes, compressed."""
    return _ZSTD.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_wide(data: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_UNZSTD.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def word_table(docs: DataFrame, held_out: str, slices: int) -> Table:
    """(slice, id, word, c, other): every word's number in its slice and its counts in training and in other rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, texts = [], np.zeros(2, np.int64)  # words of a batch with their counts in training texts and in others; texts

        def flush() -> pa.RecordBatch:
            coded = pa.concat_arrays([w for w, *_ in gathered]).dictionary_encode()
            sums = [np.bincount(coded.indices.to_numpy(), np.concatenate(of), len(coded.dictionary)) for of in zip(*(n for _, *n in gathered))]
            made = [pa.array(np.append(n, ends).astype(np.int64)) for n, ends in zip(sums, texts)]
            gathered.clear()
            texts[:] = 0
            return pa.RecordBatch.from_arrays([pa.concat_arrays([coded.dictionary, pa.array([END], pa.binary())]), *made], ["word", "c", "other"])

        for b in batches:
            out = pa.compute.fill_null(b[held_out], False).to_numpy(zero_copy_only=False)
            found, length = tokens(b["text"])
            coded, aside = found.dictionary_encode(), np.repeat(out, length)
            at, kinds = coded.indices.to_numpy(), len(coded.dictionary)
            gathered.append((coded.dictionary, *(np.bincount(at[of], minlength=kinds).astype(np.int32) for of in (~aside, aside))))
            texts += np.bincount(out, minlength=2)
            found = coded = at = aside = None
            if sum(w.nbytes for w, *_ in gathered) > _GATHERED:
                yield flush()
                give_back()
        if gathered:
            yield flush()
            give_back()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at = -1, 0
        for b in batches:
            if not len(b):
                continue
            s = b["slice"].to_numpy()
            ids, new = np.arange(at, at + len(b)), np.flatnonzero(np.diff(s, prepend=current))
            for k, z in zip(new, [*new[1:], len(b)]):
                ids[k:z] = np.arange(z - k)
            current, at = s[-1], ids[-1] + 1
            yield pa.RecordBatch.from_arrays([b["slice"], pa.array(ids), b["word"], b["c"], b["other"]], ["slice", "id", "word", "c", "other"])

    partial = docs.select("text", held_out).mapInArrow(count, "word binary, c long, other long")
    total = partial.groupBy("word").agg(F.sum("c").alias("c"), F.sum("other").alias("other"))
    by_slice = total.select((F.crc32("word") % slices).cast("int").alias("slice"), "word", "c", "other")
    ordered = by_slice.repartition(slices, "slice").sortWithinPartitions("slice", "word")
    return written_by_slice(ordered.mapInArrow(number, "slice int, id long, word binary, c long, other long"))


NONE = pack(np.empty(0))
PAYLOAD = "block int, firsts binary, seconds binary, prev binary, word binary, doc binary, docs binary, often_prev binary, often_word binary, often_c binary"


def payloads(docs: DataFrame, held_out: str, slices: int, often: list[bytes]) -> DataFrame:
    """Pairs of some texts that fall into one block: its words on either side, and each occurrence's two words and text. Pairs of
    two ``often`` words come with their count in training alone; where they occur is in rows of a negative block, by the words'
    places in ``often``. ``docs`` has row, text and ``held_out``."""
    shared = docs.sparkSession.sparkContext.broadcast(often)
    columns = pa.schema([(c.split()[0], pa.int32() if c.endswith(" int") else pa.binary()) for c in PAYLOAD.split(", ")])

    def side(ids: np.ndarray, more: np.ndarray, spelled: pa.Array, a: int, z: int) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The words that occur, joined, and their places there; their numbers are those of one slice, from ``a`` to ``z``."""
        met = np.zeros(z - a, bool)
        met[ids - a] = True
        met[more - a] = True
        at = np.cumsum(met) - 1
        return text_of(spelled.take(pa.array(np.flatnonzero(met) + a)))[:-1].to_pybytes(), at[ids - a], at[more - a]

    def texts_of(doc: np.ndarray, row: np.ndarray) -> tuple[bytes, bytes]:
        """Steps from text to text of ascending occurrences, and the texts' rows."""
        first = np.diff(doc, prepend=-1) > 0
        steps = first.astype(np.int64)
        steps[:1] = 0
        return pack(steps), row[doc[first]].astype("<i8").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, lengths, rows, n = [], [], [], 0

        def flush() -> pa.RecordBatch:
            coded = pa.chunked_array(texts, pa.binary()).combine_chunks().dictionary_encode()
            row, length = np.concatenate(rows), np.concatenate(lengths)  # a row: twice its number, plus one if it is held out
            for gathered in (texts, lengths, rows):
                gathered.clear()
            end, place = pa.array([END], pa.binary()), shared.value
            found = pa.concat_arrays([end, coded.dictionary])
            spelled = joined(found)
            slice_at = slices_of(spelled, slices)
            often_at = pa.compute.fill_null(pa.compute.index_in(found, value_set=pa.array(place, pa.binary())), -1).to_numpy()
            # words are numbered slice by slice
            by_slice = np.argsort(slice_at, kind="stable")
            spelled, slice_at, often_at = spelled.take(pa.array(by_slice)), slice_at[by_slice], often_at[by_slice]
            slice_ends = np.searchsorted(slice_at, np.arange(slices + 1))
            new = np.empty(len(by_slice), np.int32)
            new[by_slice] = np.arange(len(by_slice), dtype=np.int32)
            # the end token stands before the first word and after the last, so texts follow each other by it
            is_word = np.ones(len(coded) + len(row) + 1, bool)
            is_word[0], is_word[np.cumsum(length + 1)] = False, False
            ids = np.full(len(is_word), new[0])
            ids[is_word] = new[coded.indices.to_numpy() + 1]
            prev, word, doc = ids[:-1], ids[1:], np.repeat(np.arange(len(row), dtype=np.int32), length + 1)
            both = (often_at[prev] >= 0) & (often_at[word] >= 0)
            wide = max(1, len(place))  # fewer than ``share`` words: a count for each pair of them fits
            key = often_at[prev[both]].astype(np.int64) * wide + often_at[word[both]]
            met, counted = np.bincount(key, minlength=wide**2), np.bincount(key[(row[doc[both]] & 1) == 0], minlength=wide**2)
            key = np.flatnonzero(met)
            often_c, local_at = counted[key], np.zeros(wide, np.int64)
            local_at[often_at[often_at >= 0]] = np.flatnonzero(often_at >= 0)
            often_prev, often_word = local_at[key // wide], local_at[key % wide]
            made = [(-1 - int(row[0]) // 2 % slices**2, b"", b"", pack(often_at[prev[both]]), pack(often_at[word[both]]), *texts_of(doc[both], row),
                     NONE, NONE, NONE)]
            prev, word, doc = prev[~both], word[~both], doc[~both]
            slice_at = slice_at.astype(np.uint16 if slices <= 256 else np.int64)  # short keys are sorted in linear time
            block, often_block = (slice_at[p] * slices + slice_at[w] for p, w in ((prev, word), (often_prev, often_word)))
            order, often_order = np.argsort(block, kind="stable"), np.argsort(often_block, kind="stable")
            prev, word, doc, block = prev[order], word[order], doc[order], block[order]
            often_block = often_block[often_order]
            blocks = np.union1d(block, often_block)
            cuts, often_cuts = (zip(np.searchsorted(of, blocks), np.searchsorted(of, blocks, "right")) for of in (block, often_block))
            for k, (a, z), (often_a, often_z) in zip(blocks.tolist(), cuts, often_cuts):
                o = often_order[often_a:often_z]
                first, second = divmod(k, slices)
                firsts, p, op = side(prev[a:z], often_prev[o], spelled, *slice_ends[first: first + 2])
                seconds, w, ow = side(word[a:z], often_word[o], spelled, *slice_ends[second: second + 2])
                made.append((k, firsts, seconds, pack(p), pack(w), *texts_of(doc[a:z], row), pack(op), pack(ow), pack(often_c[o])))
            return pa.RecordBatch.from_arrays([pa.array(of, kind) for of, kind in zip(zip(*made), columns.types)], schema=columns)

        for b in batches:
            if not len(b):
                continue
            found, length = tokens(b["text"])
            out = pa.compute.fill_null(b[held_out], False).to_numpy(zero_copy_only=False)
            row, a = 2 * b["row"].to_numpy() + out, 0
            starts = np.append(0, np.cumsum(length))
            ends = starts + np.arange(len(starts))  # tokens before each text
            while a < len(b):
                z = min(len(b), int(np.searchsorted(ends[1:] - ends[a] + n, _FLUSH, "right")) + 1)  # the first text that fills the rest, or all
                texts.append(found.slice(starts[a], starts[z] - starts[a]))
                lengths.append(length[a:z])
                rows.append(row[a:z])
                n += int(ends[z] - ends[a])
                a = z
                if n > _FLUSH:
                    yield flush()
                    give_back()
                    n = 0
        if n:
            yield flush()
            give_back()

    return docs.select("row", "text", held_out).mapInArrow(cut, PAYLOAD)


BLOCKS = "block int, prev binary, word binary, c binary, held binary, doc binary, docs binary"


def blocks(pieces: DataFrame, table: Table, slices: int) -> DataFrame:
    """One row a block: its pairs by word numbers with their counts in training, how many occurrences each has, and their texts.

    Rows of negative blocks stay as they are, one a piece: the two words and the text of each occurrence.
    """
    uri = table.uri

    def merged(block: int, rows: list) -> tuple:
        at = []  # the word numbers of each piece, by side
        for s, texts in zip(divmod(block, slices), zip(*((r.firsts, r.seconds) for r in rows))):
            ends = np.cumsum([text.count(b" ") + 1 for text in texts])
            at.append(np.split(numbers(uri, s, split(b" ".join(texts))), ends[:-1]))
        keys, docs, used, often, often_c, n = [], [], [], [], [], 0
        for r, first, second in zip(rows, *at):
            keys.append(first[unpack(r.prev)] << 32 | second[unpack(r.word)])
            used.append(np.frombuffer(r.docs, "<i8"))  # a text is in one piece only
            docs.append((n + np.cumsum(unpack(r.doc))).astype(np.int32))
            n += len(used[-1])
            often.append(first[unpack(r.often_prev)] << 32 | second[unpack(r.often_word)])
            often_c.append(unpack(r.often_c))
        at = None
        more, more_c = np.concatenate(often), np.concatenate(often_c)
        key = np.concatenate([*keys, more])
        keys = None
        doc = np.concatenate([*docs, np.full(len(more), -1, np.int32)])
        docs = None
        order = np.argsort(key)
        key, doc, used = key[order], doc[order], np.concatenate(used)
        order = None
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        pairs, real = key[starts], doc >= 0
        key = None
        c = np.add.reduceat(real & np.append(used & 1 == 0, False)[doc], starts, dtype=np.int64)
        held = np.add.reduceat(real, starts, dtype=np.int64)
        np.add.at(c, np.searchsorted(pairs, more), more_c)
        return (block, pack(np.diff(pairs >> 32, prepend=0)), pack(pairs & 0xFFFFFFFF), pack(c), pack(held), pack(doc[real]), (used >> 1).tobytes())

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, block, rows = [c.split()[0] for c in BLOCKS.split(", ")], None, []
        for b in batches:
            for r in b.itertuples(index=False):
                if r.block < 0:
                    yield pd.DataFrame([(r.block, r.prev, r.word, NONE, NONE, r.doc, (np.frombuffer(r.docs, "<i8") >> 1).tobytes())], columns=columns)
                    continue
                if rows and r.block != block:
                    yield pd.DataFrame([merged(block, rows)], columns=columns)
                    give_back()
                    rows = []
                block = int(r.block)
                rows.append(r)
        if rows:
            yield pd.DataFrame([merged(block, rows)], columns=columns)
            give_back()

    return written(pieces.repartition(slices * slices, "block").sortWithinPartitions("block").mapInPandas(gather, BLOCKS))


def seated(c: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of c customers of one dish: the n-th opens one with probability weight / (weight + n - discount * tables).

    Up to 16 customers one by one; beyond, an eighth of those seated at a time with a binomial draw.
    """
    c = np.rint(c).astype(np.int64)
    t = np.minimum(c, 1).astype(np.float64)
    active, n = np.flatnonzero(c > 1), 1
    while len(active):
        step = np.minimum(max(1, n // 8), c[active] - n)
        w = weight[active]
        p = w / (w + n - discount * t[active])
        t[active] += rng.binomial(step, np.clip(p, 0.0, 1.0))
        n += max(1, n // 8)
        active = active[c[active] > n]
    return t


def discount(ones: float, twos: float) -> float:
    """From counts of counts, kept off 0 and 1."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


class Bytes(NamedTuple):
    """One sample of the byte model: P(symbol | context) = direct mass of a seen cell + back-off weight x P(symbol | last byte)."""

    cells: np.ndarray  # ascending context << 8 | symbol
    direct: np.ndarray
    back: np.ndarray  # by context
    parent: np.ndarray  # [last byte, symbol]


def grams(spelled: list[bytes] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all symbols of the words, each ended by a blank, and where every word begins."""
    spelled = joined(spelled if isinstance(spelled, pa.Array) else pa.array(spelled, pa.binary()))
    s = np.frombuffer(b"   " + text_of(spelled).to_pybytes(), np.uint8).astype(np.uint32)
    sym, b1 = s[3:], s[2:-1]
    b2 = np.where(b1 == 32, 32, s[1:-2])  # contexts stop at the word's start
    b3 = np.where(b2 == 32, 32, s[:-3])
    mixed = ((b2 * np.uint32(0x9E3779B1)) ^ (b3 * np.uint32(0x85EBCA77))) >> np.uint32(11)
    cell = ((b1 << np.uint32(10) | (mixed & np.uint32(1023))) << np.uint32(8)) | sym
    starts = np.concatenate([[0], np.flatnonzero(sym == 32)[:-1] + 1])
    return cell, starts


def spelling(model: Bytes | None, spelled: list[bytes] | pa.Array) -> np.ndarray:
    """Natural log probability of each word's spelling."""
    cell, starts = grams(spelled)
    if model is None:
        p = np.full(len(cell), 1 / 256)
    else:
        context, last, sym = cell >> np.uint32(8), cell >> np.uint32(18), cell & np.uint32(255)
        p = model.back[context] * model.parent[last, sym]
        if len(model.cells):
            at = np.minimum(np.searchsorted(model.cells, cell), len(model.cells) - 1)
            p = p + np.where(model.cells[at] == cell, model.direct[at], 0.0)
    return np.add.reduceat(np.log(p), starts)


def _restaurants(key: np.ndarray, groups: int, c: np.ndarray, prior: np.ndarray, tables_before: np.ndarray, rng) -> tuple:
    """Seat all cells of one level: (tables per cell, tables per group, direct mass, back-off weight per group)."""
    d = discount(float((c == 1).sum()), float((c == 2).sum()))
    t = seated(c, (STRENGTH + d * tables_before[key]) * prior, d, rng)
    total, tables = np.bincount(key, c, groups), np.bincount(key, t, groups)
    return t, tables, (c - d * t) / (STRENGTH + total[key]), (STRENGTH + d * tables) / (STRENGTH + total)


def seat_bytes(cells: np.ndarray, c: np.ndarray, before: Bytes | None, tables: list[np.ndarray] | None, rng) -> tuple[Bytes, list[np.ndarray]]:
    """One sweep over the byte restaurants, leaves first: tables become the parents' customers."""
    tables = tables or [np.zeros(1), np.zeros(256), np.zeros(1 << 18)]
    context, last, sym = cells >> np.uint32(8), cells >> np.uint32(18), cells & np.uint32(255)
    parent = before.parent if before else np.full((256, 256), 1 / 256)
    t2, tables2, direct2, back2 = _restaurants(context, 1 << 18, c, parent[last, sym], tables[2], rng)
    pair = last.astype(np.int64) << 8 | sym
    c1 = np.bincount(pair, t2, 1 << 16)
    seen1 = np.flatnonzero(c1)
    root = (parent * tables[1][:, None]).sum(0) / tables[1].sum() if tables[1].sum() else np.full(256, 1 / 256)
    t1, tables1, direct1, back1 = _restaurants(seen1 >> 8, 256, c1[seen1], root[seen1 & 255], tables[1], rng)
    c0 = np.bincount(seen1 & 255, t1, 256)
    seen0 = np.flatnonzero(c0)
    _, tables0, direct0, back0 = _restaurants(np.zeros(len(seen0), np.int64), 1, c0[seen0], np.full(len(seen0), 1 / 256), tables[0], rng)
    p0 = np.full(256, back0[0] / 256)
    p0[seen0] += direct0
    p1 = back1[:, None] * p0[None, :]
    p1[seen1 >> 8, seen1 & 255] += direct1
    return Bytes(cells, direct2, back2, p1), [tables0, tables1, tables2]


class State(NamedTuple):
    """What a sweep leaves: the byte model and the word restaurant's table count."""

    model: Bytes | None
    tables: float


def _rng(seed: int, batch: pa.Array) -> np.random.Generator:
    return np.random.default_rng([seed, xxhash.xxh32_intdigest(batch[0].as_py() + b" " + batch[-1].as_py())])


def sweep(counts: DataFrame, state: State, before: "Level | None", d: float, seed: int) -> DataFrame:
    """(cell, n): draw every word's tables, then add up the cells of their spellings; cell -1 carries the number of tables.
    ``state`` and ``before``, which has its spellings' log probabilities, are those of the sweep before."""
    tables = state.tables

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, spelt_there = None, None
        for b in batches:
            if not len(b):
                continue
            if before is None:
                spelt = spelling(None, b["word"])
            else:
                number, ids, spelt = b["slice"].to_numpy(), b["id"].to_numpy(), np.empty(len(b))
                for k in np.unique(number):
                    if k != current:
                        current, (spelt_there,) = k, read_slice(before.uri, k, ["spelt"])
                    spelt[number == k] = spelt_there[ids[number == k]]
            t = seated(b["n"].to_numpy(), (STRENGTH + d * tables) * np.exp(spelt), d, _rng(seed, b["word"]))
            cell, starts = grams(b["word"])
            coded = pa.array(cell).dictionary_encode()
            n = np.bincount(coded.indices.to_numpy(), np.repeat(t, np.diff(np.append(starts, len(cell)))), len(coded.dictionary))
            found = coded.dictionary.to_numpy().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(n, t.sum()))], ["cell", "n"])

    return counts.select("slice", "id", "word", "n").where("n > 0").mapInArrow(draw, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n"))


def probabilities(counts: DataFrame, state: State, d: float, customers: float, seed: int) -> "Level":
    """The words' tables and spellings, written by slice."""
    shared = counts.sparkSession.sparkContext.broadcast(state)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = shared.value
        for b in batches:
            if not len(b):
                continue
            log_base = spelling(state.model, b["word"])
            t = seated(b["n"].to_numpy(), (STRENGTH + d * state.tables) * np.exp(log_base), d, _rng(seed, b["word"]))
            kept = ["slice", "id", "c", "n", "tables"]
            yield pa.RecordBatch.from_arrays([*(b[name] for name in kept), pa.array(t.astype(np.int64)), pa.array(log_base)], [*kept, "t", "spelt"])

    drawn = written_by_slice(counts.mapInArrow(draw, "slice int, id long, c long, n long, tables long, t long, spelt double"))
    sums = drawn.rows.agg(F.sum("t").alias("t"), F.sum(F.when(F.col("c") > 0, F.exp("spelt"))).alias("spelt")).first()
    new = STRENGTH + d * (sums.t or 0)  # of this very draw, so that all probabilities add up to 1
    return Level(drawn.uri, d, new, STRENGTH + customers, max(new / (STRENGTH + customers) * (1 - (sums.spelt or 0.0)), 1e-300))


class Level(NamedTuple):
    """A state of the word restaurant, in slices, and the probability without context of any word that training lacks."""

    uri: str
    d: float
    new: float
    customers: float
    unknown: float

    def of(self, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the words of a slice: count in training, tables they hand on as contexts, log probability without context."""
        c, n, tables, t, spelt = read_slice(self.uri, number, ["c", "n", "tables", "t", "spelt"])
        lp = np.full(len(c), math.log(self.new)) + spelt  # in logs, for spellings whose probability is too small for a double
        seen = np.flatnonzero(n > 0)
        lp[seen] = np.log(n[seen] - self.d * t[seen] + self.new * np.exp(spelt[seen]))
        return c, tables, lp - math.log(self.customers)


def counts_of_counts(table: DataFrame, c: str) -> float:
    few = {r.c: r.n for r in table.where(F.col(c).isin(1, 2)).groupBy(F.col(c).alias("c")).agg(F.count("*").alias("n")).collect()}
    return discount(few.get(1, 0), few.get(2, 0))


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 1) -> Iterator[None]:
    """For jobs that read long rows. A block is megabytes long, so a task holds one at a time and not all those of its files at once."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {name: spark.conf.get(name) for name in sizes}
    try:
        for name, size in sizes.items():
            spark.conf.set(name, size)
        yield
    finally:
        for name, size in before.items():
            spark.conf.set(name, size)


def pairs_in(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.cumsum(unpack(row.prev)), unpack(row.word), unpack(row.c)


def draw_tables(block: int, c: np.ndarray, tables: np.ndarray, lp: np.ndarray, d: float, seed: int) -> np.ndarray:
    """Tables of a block's pairs; ``tables`` and ``lp`` are their first and second words' in the state before."""
    return seated(c, (STRENGTH + d * tables) * np.exp(lp), d, np.random.default_rng([seed, block]))


def seat(kept: DataFrame, table: Table, slices: int, before: Level | None, d: float, seed: int) -> tuple[Table, float]:
    """(slice, id, word, c, n, tables): the customers that every word gets from the pairs it ends, and the tables of those it
    begins; and the pairs' discount by their counts of counts. Without a state before, one table a pair."""
    uri = table.uri

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                prev, word, c = pairs_in(r)
                first, second = divmod(int(r.block), slices)
                if before is None:
                    t = np.minimum(c, 1)
                else:
                    t = draw_tables(int(r.block), c, before.of(first)[1][prev], before.of(second)[2][word], d, seed)
                made = []
                for number, side, ids in ((first, 0, prev), (second, 1, word)):
                    n = np.bincount(ids, t)
                    used = np.flatnonzero(n)
                    made.append((number, side, pack(np.diff(used, prepend=0)), pack(n[used]), int((c == 1).sum()), int((c == 2).sum())))
                yield pd.DataFrame(made, columns=["slice", "side", "ids", "n", "ones", "twos"])
                give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            spelled, c = slice_rows(uri, current, ["word", "c"])
            for a in range(0, len(c), 1 << 16):
                z = min(a + (1 << 16), len(c))
                made = {"slice": np.full(z - a, current, np.int32), "id": np.arange(a, z), "word": spelled[a:z], "c": c[a:z], "n": total[1][a:z], "tables": total[0][a:z]}
                yield pa.RecordBatch.from_pydict(made)

        current, total = None, None
        for b in batches:
            for number, side, ids, n in zip(*(b[name].to_pylist() for name in ("slice", "side", "ids", "n"))):
                if number != current:
                    if current is not None:
                        yield from done()
                    current = number
                    total = np.zeros((2, len(read_slice(uri, current, ["c"])[0])), np.int64)
                total[side][np.cumsum(unpack(ids))] += unpack(n)
        if current is not None:
            yield from done()

    made = kept.where("block >= 0").select("block", "prev", "word", "c").mapInPandas(sums, "slice int, side int, ids binary, n binary, ones long, twos long")
    with few_rows_a_batch(kept.sparkSession):
        if before is None:
            made = written(made)
            few = made.where("side = 0").agg(F.sum("ones").alias("ones"), F.sum("twos").alias("twos")).first()
            d = discount(few.ones or 0, few.twos or 0)
        split = made.select("slice", "side", "ids", "n").repartition(slices, "slice").sortWithinPartitions("slice")
        return written_by_slice(split.mapInArrow(add, "slice int, id long, word binary, c long, n long, tables long")), d


class Fit(NamedTuple):
    """All states, which of them are kept, the pair restaurants' discount and the seed of the draws."""

    levels: list[Level]
    kept: list[int]
    d: float
    seed: int


def fit(kept: DataFrame, table: Table, slices: int, total: int, seed: int = 11) -> Fit:
    levels, state, byte_tables, d1, d2 = [], State(None, 0.0), None, 0.5, 0.5
    rng = np.random.default_rng(seed)
    rounds = BURN_IN + SAMPLES if total else 1
    for k in range(rounds):
        counted, d2 = seat(kept, table, slices, levels[-1] if k else None, d2, seed + 100 + k)
        counts = counted.rows
        if not k:
            d1 = counts_of_counts(counts, "n")
        customers = float(counts.agg(F.sum("n")).first()[0] or 0)
        if total:
            cells = sweep(counts, state, levels[-1] if k else None, d1, seed + k).toPandas().sort_values("cell")  # at most 2^26 cells, whatever the corpus
            word_tables = float(cells.n[cells.cell < 0].sum())
            cells = cells[cells.cell >= 0]
            model, byte_tables = seat_bytes(cells.cell.to_numpy(np.int64).astype(np.uint32), cells.n.to_numpy(), state.model, byte_tables, rng)
            state = State(model, word_tables)
        levels.append(probabilities(counts, state, d1, customers, seed + 200 + k))
    return Fit(levels, list(range(BURN_IN, rounds)) if total else [0], d2, seed)


class Logs(NamedTuple):
    """Of pairs: whether training has the second word, and log10 of the add-one count's and of the model's probability after the
    first, averaged over the states; ``open`` gives an unknown word its spelling's."""

    known: np.ndarray
    base: np.ndarray
    lp: np.ndarray
    open: np.ndarray


def pair_logs(block: int, prev: np.ndarray, word: np.ndarray, c: np.ndarray, fitted: Fit, slices: int, denominator: int) -> Logs:
    first, second = divmod(block, slices)
    wanted = sorted({j for k in fitted.kept for j in (max(k - 1, 0), k)})
    at = {j: (fitted.levels[j].of(first)[:2], fitted.levels[j].of(second)) for j in wanted}
    ((context, _), (count, *_)), seen, spelled, unknown = at[wanted[0]], 0.0, [], []
    share = STRENGTH + context[prev]
    for k in fitted.kept:
        (_, tables), (_, _, lp) = at[k]
        t = np.minimum(c, 1)
        if k:
            (_, tables_before), (_, _, lp_before) = at[k - 1]
            t = draw_tables(block, c, tables_before[prev], lp_before[word], fitted.d, fitted.seed + 100 + k)
        back = (STRENGTH + fitted.d * tables[prev]) / share
        seen = seen + (c - fitted.d * t) / share + back * np.exp(lp[word])
        spelled.append(np.log(back) + lp[word])
        unknown.append(np.log(back) + math.log(fitted.levels[k].unknown))
    mean = lambda logs: (np.logaddexp.reduce(logs) - math.log(len(logs))) / math.log(10)
    known = count[word] > 0
    open_ = np.where(c > 0, np.log10(np.maximum(seen, 1e-300) / len(fitted.kept)), mean(spelled))
    return Logs(known.astype(float), np.log10((count[word] + 1) / denominator), np.where(known, open_, mean(unknown)), open_)


SUMS = "k long, known double, base double, lp double, open double"
PACKED = ["rows", "ks", "knowns", "bases", "lps", "opens"]


def packed_sums(rows: np.ndarray, k: np.ndarray, known: np.ndarray, *logs: np.ndarray) -> tuple:
    return (pack_wide(np.diff(rows, prepend=0)), pack(k), pack(known), *map(pack_wide, logs))


def unpacked_sums(r) -> tuple[np.ndarray, np.ndarray]:
    """The rows, and one line each for k and the fields of ``Logs``."""
    logs = [unpack_wide(data, "<f8") for data in (r.bases, r.lps, r.opens)]
    return np.cumsum(unpack_wide(r.rows, "<i8")), np.stack([unpack(r.ks).astype(float), unpack(r.knowns).astype(float), *logs])


def block_scores(kept: DataFrame, fitted: Fit, slices: int, denominator: int, often: list[tuple[int, int]]) -> DataFrame:
    """Sums by row over the pairs of each block, packed by chunk (the row's number modulo the number of chunks), which stands in
    ``row``; and, with row -1, the logs of each pair of ``often`` words, by their places."""
    place = {at: k for k, at in enumerate(often)}
    chunks = CHUNKS * slices

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                prev, word, c = pairs_in(r)
                first, second = divmod(int(r.block), slices)
                logs = pair_logs(int(r.block), prev, word, c, fitted, slices, denominator)
                held, doc, rows = unpack(r.held), unpack(r.doc), np.frombuffer(r.docs, "<i8")
                sums = [np.bincount(doc, minlength=len(rows)), *(np.bincount(doc, np.repeat(of, held), len(rows)) for of in logs)]
                chunk = rows % chunks
                order = np.lexsort([rows, chunk])
                ends = np.searchsorted(chunk[order], np.arange(chunks + 1))
                made = [(k, *packed_sums(rows[at], *(of[at] for of in sums))) for k in range(chunks) if len(at := order[ends[k]: ends[k + 1]])]
                yield pd.DataFrame(made, columns=["row", *PACKED]).reindex(columns=columns)
                bare = np.flatnonzero(held == 0)  # only pairs of two often words come without texts
                listed = pd.DataFrame({"row": -1, "a": [place[first, k] for k in prev[bare].tolist()], "b": [place[second, k] for k in word[bare].tolist()], "k": 0,
                                       **{f: getattr(logs, f)[bare] for f in Logs._fields}})
                yield listed.reindex(columns=columns)
                give_back()

    schema = f"row long, a int, b int, {SUMS}, {', '.join(f'{c} binary' for c in PACKED)}"
    columns = [c.split()[0] for c in schema.split(", ")]
    with few_rows_a_batch(kept.sparkSession):
        return written(kept.where("block >= 0").mapInPandas(score, schema))


def added(sums: DataFrame, slices: int) -> DataFrame:
    """Each row's sums over all blocks: a chunk in one task, ``_PARTS`` partial sums at a time."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gathered, n, least, current = [], 0, _PARTS, None

        def merged() -> tuple[np.ndarray, np.ndarray]:
            rows, at = np.unique(np.concatenate([r for r, _ in gathered]), return_inverse=True)
            return rows, np.stack([np.bincount(at, np.concatenate(of), len(rows)) for of in zip(*(v for _, v in gathered))])

        def done() -> pd.DataFrame:
            rows, (k, *logs) = merged()
            return pd.DataFrame({"row": rows, "k": k.astype(np.int64), **dict(zip(Logs._fields, logs))})

        for b in batches:
            for r in b.itertuples(index=False):
                if r.row != current:
                    if gathered:
                        yield done()
                    gathered, n, least, current = [], 0, _PARTS, r.row
                gathered.append(unpacked_sums(r))
                n += len(gathered[-1][0])
                if n > least:
                    gathered = [merged()]
                    n = len(gathered[0][0])
                    least = n + _PARTS
        if gathered:
            yield done()

    chunked = sums.where("row >= 0").select("row", *PACKED).repartition(CHUNKS * slices, "row").sortWithinPartitions("row")
    return chunked.mapInPandas(add, f"row long, {SUMS}")


class Prepared(NamedTuple):
    table: Table
    kept: DataFrame
    slices: int
    often: list  # rows (slice, id, word)
    total: int
    kinds: int


def prepared(numbered: DataFrame, held_out: str, share: int = SHARE, block: int = BLOCK) -> Prepared:
    """Words and blocks of ``numbered``: row, text and ``held_out``."""
    size = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, math.ceil(math.sqrt(size / 6 / block)))
    with few_rows_a_batch(numbered.sparkSession, _TEXTS):
        table = word_table(numbered, held_out, slices)
    whole = table.rows.agg(F.sum("c").alias("c"), F.sum("other").alias("other"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, other = int(whole.c or 0), int(whole.other or 0)
    often = table.rows.where((F.col("c") + F.col("other")) * share > total + other).select("slice", "id", "word").collect()  # fewer than ``share`` words
    pieces = payloads(numbered, held_out, slices, [bytes(r.word) for r in often])
    with few_rows_a_batch(numbered.sparkSession, _TEXTS):
        kept = blocks(pieces, table, slices)
    return Prepared(table, kept, slices, often, total, int(whole.v or 0))


def scored(docs: DataFrame, held_out: str, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, ``held_out``, n_tokens, n_known, train_tokens, base_score, score, open_score of every row of ``docs``.

    ``docs`` has doc_id, text and ``held_out``; other columns are not read. In ``score`` a word that training lacks counts as one
    more type, as in the base score: its probability is that of meeting any such word. ``open_score`` gives it the probability of
    its spelling.
    """
    # ids go through pandas as text: a null must not turn the others into doubles
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string"), "text", held_out)
    made = prepared(numbered, held_out, share, block)
    fitted = fit(made.kept, made.table, made.slices, made.total)
    sums = block_scores(made.kept, fitted, made.slices, made.total + 1 * (made.kinds + 1), [(r["slice"], r.id) for r in made.often])
    pairs = sums.where("row < 0").select("a", "b", *Logs._fields).toPandas()  # fewer than share x share
    key = pairs.a.to_numpy(np.int64) * len(made.often) + pairs.b.to_numpy(np.int64)
    order = np.argsort(key)
    shared = docs.sparkSession.sparkContext.broadcast((key[order], pairs[list(Logs._fields)].to_numpy()[order]))
    n_often = len(made.often)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, values = shared.value
        for b in batches:
            for r in b.itertuples(index=False):
                found = np.searchsorted(keys, unpack(r.prev) * n_often + unpack(r.word))
                doc, rows = np.cumsum(unpack(r.doc)), np.frombuffer(r.docs, "<i8")
                part = {f: np.bincount(doc, values[found, k], len(rows)) for k, f in enumerate(Logs._fields)} if len(rows) else {}
                yield pd.DataFrame({"row": rows, "k": np.bincount(doc, minlength=len(rows)), **part}, columns=["row", "k", *Logs._fields])

    found = made.kept.where("block < 0").mapInPandas(look_up, f"row long, {SUMS}")
    parts = found.unionByName(added(sums, made.slices))
    parts = parts.unionByName(numbered.select("row", "doc_id", F.col(held_out).alias("held")), allowMissingColumns=True)
    total = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held").alias("held"), *[F.sum(f).alias(f) for f in ("k", *Logs._fields)])
    return total.select(
        F.col("doc_id").cast("long"), F.col("held").alias(held_out), F.col("k").alias("n_tokens"), F.round("known").cast("long").alias("n_known"),
        F.lit(made.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("lp").alias("score"), F.col("open").alias("open_score"))
