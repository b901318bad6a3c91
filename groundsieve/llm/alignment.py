"""Alignment of two tokenizers over a corpus, scored by inverted pair bitmaps.

Every text is encoded by a byte-level vocabulary A (a space before the text) and a piece vocabulary B (which adds that space
itself). Byte offsets where tokens of both end cut the text into groups; every A and B token of a group are linked.

``index`` numbers texts inside blocks of at most 65,536 and keeps one row per id pair and block: a compressed bitmap for every
binary digit of the pair's multiplicity in a text (``planes``: sorted 16-bit slots, or a bitset from 4,096 slots on). The planes
OR-merged are the texts that hold the pair and their popcount its document count; the planes' popcounts weighted by their
digit are its link count. ``pair_scores`` adds these up over blocks, by partial aggregation of numbers only. ``aligned`` sends
a pair's score back along its postings: a block's rows stream through one task, which adds scores to one cell per text.

A pair has at most one row per block, so no pair is a hot key; frequent words and texts only make bitmaps fuller. Encoding is
memoised by chunk: both encoders split before a space or line feed that stands alone between other characters (no piece of B
holds a space or line feed after another character; the vocabulary is checked for it), so a chunk's groups are the same in every text.

Only the two named columns are read: other columns, of whatever name, play no part. Null and empty texts, and those whose
tokens do not spell the text (U+2581 in it), have no tokens: zeros and an empty digest. Repeated rows count and are
returned each; a null id is an id like others; texts may have any length (one text's links must fit in a task's memory);
an empty table gives an empty table.
"""

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from groundsieve.llm.bpe import Cache, _byte_of
from groundsieve.llm.common import written

SLOTS = 1 << 16  # texts of a block; a slot fits in 16 bits
DENSE = 1 << 12  # slots from which a plane is a bitset of SLOTS bits
WORDS = 1 << 20  # chunk occurrences after which a block is closed
_CHUNKS = re.compile(r"(?<=\S)(?=[ \n]\S)")
_B = 15  # bits of a B id inside a pair code


#: Fixed value: how vocabulary A cuts a text into pre-tokens.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


class Encoders:
    """Both encoders of a process, and what they found for every chunk so far.

    A chunk is named by itself, or without its leading space where no other white space is in it. Per chunk: whether both spell it,
    counts, the groups as text, and its link codes at ``links[ends[k]:ends[k + 1]]``.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path_a)
        self.model = library.model
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        special = {i for i, t in library.get_added_tokens_decoder().items() if t.special}
        self.bytes_a = {i: t.encode() if i in special else bytes(byte_of[c] for c in t) for t, i in library.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if len(pieces) > 1 << _B or max(self.bytes_a) >= 1 << 31 - _B:
            raise ValueError("a vocabulary is too large for 31-bit pair codes")
        self.size_a, self.size_b = {i: len(x) for i, x in self.bytes_a.items()}, list(map(len, self.bytes_b))
        self.said_a, self.said_b = {i: str(i) for i in self.bytes_a}, list(map(str, range(len(pieces))))
        self.splits = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.shown = str.maketrans({chr(b): c for c, b in byte_of.items()})
        self.pre_tokens = Cache(self._pre_token)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.good, self.n_a, self.n_b, self.n_groups, self.ends = array("b"), array("i"), array("i"), array("i"), array("q", [0])
        self.links, self.said = array("i"), []

    def _pre_token(self, piece: str) -> list[int]:
        """A's ids of a pre-token, by the library's own model."""
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]

    def chunks(self, text: str) -> list[str]:
        """The names of the text's chunks: it and its leading space, cut where both encoders always cut."""
        if not self.splits:
            return [" " + text]
        words, n = text.split(), text.count(" ") + text.count("\n")
        if len(words) == n + 1 and len("".join(words)) == len(text) - n:  # no white space but single spaces and line feeds
            return text.replace("\n", " \n").split(" ")
        return _CHUNKS.split(" " + text)

    def learn(self, fresh: list[str]) -> None:
        """Encode chunks met for the first time."""
        # B adds the space itself; before a line feed it stays a token of its own, which is none of the text's
        ids_b = self.b.encode([c[1:] if c[0] == " " else c for c in fresh], num_threads=1)
        for name, b in zip(fresh, ids_b):
            chunk = name
            if name[0] == "\n":
                if not b or self.bytes_b[b[0]] != b" ":
                    raise ValueError("vocabulary B does not keep a line feed apart")
                b = b[1:]
            elif name[0] != " ":
                chunk = " " + name
            self.known[name] = len(self.good)
            a: list[int] = []
            for piece in PIECES.findall(chunk):
                a += self.pre_tokens[piece]
            self._keep(chunk.encode(), a, b)

    def _keep(self, data: bytes, a: list[int], b: list[int]) -> None:
        good = b"".join(map(self.bytes_a.__getitem__, a)) == data == b"".join(map(self.bytes_b.__getitem__, b))
        groups, add = [], self.links.append
        if good:
            size_a, size_b, said_a, said_b = self.size_a, self.size_b, self.said_a, self.said_b
            i = j = at_a = at_b = from_a = from_b = 0
            for x in a:
                at_a += size_a[x]
                i += 1
                while at_b < at_a:
                    at_b += size_b[b[j]]
                    j += 1
                if at_a == at_b:
                    if i - from_a == 1 == j - from_b:
                        y = b[from_b]
                        groups.append(f"{said_a[x]}|{said_b[y]}")
                        add(x << _B | y)
                    else:
                        left, right = a[from_a:i], b[from_b:j]
                        groups.append(",".join(map(said_a.__getitem__, left)) + "|" + ",".join(map(said_b.__getitem__, right)))
                        for u in left:
                            for y in right:
                                add(u << _B | y)
                    from_a, from_b = i, j
        self.good.append(good)
        self.n_a.append(len(a))
        self.n_b.append(len(b))
        self.n_groups.append(len(groups))
        self.said.append(";".join(groups))
        self.ends.append(len(self.links))


@lru_cache(maxsize=2)
def encoders(path_a: str, path_b: str) -> Encoders:
    """One pair of encoders per process, kept from task to task."""
    return Encoders(path_a, path_b)


def packed_planes(slots: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Bitmaps of ascending slots, cut at ``starts`` (whose last entry is the number of slots), as binary values."""
    sizes = np.diff(starts)
    dense = np.flatnonzero(sizes >= DENSE)
    width = sizes * 2
    if not len(dense):
        data = slots.astype("<u2").tobytes()
    else:
        parts, at = [], 0
        for k in dense:
            lo, hi = starts[k], starts[k + 1]
            bits = np.zeros(SLOTS, np.uint8)
            bits[slots[lo:hi]] = 1
            parts += [slots[at:lo].astype("<u2").tobytes(), np.packbits(bits, bitorder="little").tobytes()]
            at = hi
        data = b"".join([*parts, slots[at:].astype("<u2").tobytes()])
        width[dense] = SLOTS // 8
    ends = np.concatenate([[0], np.cumsum(width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def plane_slots(planes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(slots, how many of every bitmap) of binary bitmaps; the inverse of ``packed_planes``."""
    ends = np.frombuffer(planes.buffers()[1], np.int32)[planes.offset : planes.offset + len(planes) + 1]
    size = np.diff(ends)
    data = np.frombuffer(planes.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(ends) else np.zeros(0, np.uint8)
    dense = np.flatnonzero(size == SLOTS // 8)
    n = size // 2
    if not len(dense):
        return data.view("<u2"), n
    parts, at = [], 0
    for k in dense:
        lo, hi = ends[k] - ends[0], ends[k + 1] - ends[0]
        found = np.flatnonzero(np.unpackbits(data[lo:hi], bitorder="little")).astype("<u2")
        parts += [data[at:lo].view("<u2"), found]
        n[k], at = len(found), hi
    return np.concatenate([*parts, data[at:].view("<u2")]), n


def pair_rows(codes: np.ndarray, slots: np.ndarray) -> dict[str, pa.Array]:
    """One row per pair code: its bitmaps and counts, from the block's link occurrences in any order."""
    keys = np.sort(codes.astype(np.int64) << 16 | slots)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(keys)))  # the pair's multiplicity in each text
    keys = keys[first]
    code, slot = keys >> 16, keys & (SLOTS - 1)
    pair_at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    # digit by digit: which (pair, text) have it, grouped by pair and then digit
    digits = range(int(times.max()).bit_length()) if len(times) else range(0)
    number = np.cumsum(np.concatenate([[0], (code[1:] != code[:-1]).astype(np.int64)])) if len(code) else code
    has = [np.flatnonzero(times >> k & 1) for k in digits]
    entry = np.concatenate(has) if has else np.zeros(0, np.int64)
    digit = np.repeat(np.arange(len(has)), [len(h) for h in has])
    width = len(has) + 1
    entry = entry[np.argsort(number[entry] * width + digit, kind="stable")]
    most = int(number[-1]) + 1 if len(number) else 0
    held = np.stack([np.bincount(number[h], minlength=most) for h in has], 1) if most else np.zeros((0, 0), np.int64)
    planes = held.shape[1] - np.argmax(held[:, ::-1] > 0, axis=1) if most else np.zeros(0, np.int64)  # up to the highest digit
    kept = np.arange(held.shape[1])[None, :] < planes[:, None] if most else np.zeros((0, 0), bool)
    starts = np.concatenate([[0], np.cumsum(held[kept])])
    lists = np.concatenate([[0], np.cumsum(planes)]).astype(np.int32)
    return {"pair": pa.array(code[pair_at]), "n_docs": pa.array(np.diff(np.append(pair_at, len(code)))),
            "n_links": pa.array((held << np.arange(held.shape[1])).sum(1) if most else np.zeros(0, np.int64)),
            "planes": pa.ListArray.from_arrays(pa.array(lists), packed_planes(slot[entry], starts))}


_INDEX = ("block long, pair long, n_docs long, n_links long, planes array<binary>, slot int, doc_id long, n_a long, n_b long, n_groups long, "
          "doc_links long, groups_sha256 string")
_ARROW = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n_docs", pa.int64()), ("n_links", pa.int64()), ("planes", pa.list_(pa.binary())),
                    ("slot", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                    ("doc_links", pa.int64()), ("groups_sha256", pa.string())])


def _table(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def index(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", chunks: int = 400_000) -> DataFrame:
    """The written index: a row per (pair, block), and a row per text (pair null) with its place and own counts."""
    numbered = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders(path_a, path_b)
        ids: list[int | None] = []  # the block's texts
        said: list[str] = []
        at: list[int] = []  # their chunks, one after the other
        ends: list[int] = []
        part, block, held = 0, 0, 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal ids, said, at, ends, block, held
            if not ids:
                return
            n, chunk, cuts = len(ids), np.array(at, np.int64), np.array([0, *ends])
            slot = np.repeat(np.arange(n), np.diff(cuts))
            total = lambda of: np.bincount(slot, np.frombuffer(of, of.typecode)[chunk], n).astype(np.int64)
            stops = np.frombuffer(own.ends, "q")
            sizes = (stops[1:] - stops[:-1])[chunk]
            where = np.arange(sizes.sum()) + np.repeat(stops[chunk] - np.cumsum(sizes) + sizes, sizes)
            codes = np.frombuffer(own.links, "i")[where] if len(where) else np.zeros(0, np.int32)
            rows = pair_rows(codes, np.repeat(slot, sizes))
            name = part << 32 | block
            known = {"n_a": total(own.n_a), "n_b": total(own.n_b), "n_groups": total(own.n_groups), "doc_links": np.bincount(slot, sizes, n).astype(np.int64)}
            pairs = len(rows["pair"])
            made = [_table(n, block=pa.array(np.full(n, name)), slot=pa.array(np.arange(n)), doc_id=pa.array(ids, pa.int64()),
                           groups_sha256=pa.array(said, pa.string()), **{c: pa.array(x) for c, x in known.items()})]
            if pairs:
                made.append(_table(pairs, block=pa.array(np.full(pairs, name)), **rows))
            ids, said, at, ends, block, held = [], [], [], [], block + 1, 0
            if len(own.good) > chunks:
                own.clear()
            for whole in made:
                yield from (whole.slice(k, 50_000) for k in range(0, whole.num_rows, 50_000))

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                few = batch.slice(lo, 500)
                part = few["part"][0].as_py()
                cut = [own.chunks(t) if t else [] for t in few["text"].to_pylist()]
                if fresh := set().union(*cut).difference(own.known):
                    own.learn(sorted(fresh))
                for ident, names in zip(few["doc_id"].to_pylist(), cut):
                    found = list(map(own.known.__getitem__, names))
                    if not all(map(own.good.__getitem__, found)):
                        found = []
                    ids.append(ident)
                    said.append(hashlib.sha256(";".join(map(own.said.__getitem__, found)).encode()).hexdigest() if found else "")
                    at += found
                    ends.append(len(at))
                if len(ids) > SLOTS - 500 or len(at) >= WORDS:
                    yield from close()
        yield from close()

    return written(numbered.mapInArrow(build, _INDEX))


def pair_scores(made: DataFrame) -> DataFrame:
    """(pair, a, b, n_docs, n_links, best) of an index; best: no pair of the same A id is in more texts."""
    pairs = made.where("pair is not null").groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    pairs = pairs.select("pair", F.shiftright("pair", _B).cast("int").alias("a"), F.col("pair").bitwiseAND((1 << _B) - 1).cast("int").alias("b"), "n_docs", "n_links")
    top = pairs.groupBy("a").agg(F.max("n_docs").alias("top"))  # a row per A id: as many as the vocabulary has, 65,536 at most
    return pairs.join(F.broadcast(top), "a").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_docs") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    Work starts at the call: the index and the pair table are written to the shared folder.
    """
    made = index(docs, path_a, path_b, doc_id, text)
    scores = written(pair_scores(made)).select("pair", F.col("n_docs").alias("score"), "best")
    postings = made.where("pair is not null").select("block", "pair", "planes").join(scores, "pair")
    texts = made.where("pair is null").drop("pair", "n_docs", "n_links", "planes")
    both = postings.unionByName(texts, allowMissingColumns=True)
    both = both.repartition("block").sortWithinPartitions(F.col("block"), F.col("pair").asc_nulls_last())
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                     ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, best = None, None, None
        for batch in batches:
            blocks = batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if blocks[lo] != now:  # rows of a block are together, its postings before its texts
                    now, sums, best = blocks[lo], np.zeros(SLOTS), np.zeros(SLOTS)
                part = batch.slice(lo, hi - lo)
                n = hi - lo - part["pair"].null_count
                if n:
                    rows = part.slice(0, n)
                    planes = rows["planes"]
                    starts = planes.offsets.to_numpy()
                    sizes = np.diff(starts)
                    slots, held = plane_slots(planes.values.slice(starts[0], starts[-1] - starts[0]))
                    digit = np.arange(starts[-1] - starts[0]) - np.repeat(starts[:-1] - starts[0], sizes)
                    row = np.repeat(np.arange(n), sizes)
                    weight = np.ldexp(1.0, digit)
                    score = rows["score"].to_numpy().astype(float)
                    top = rows["best"].to_numpy(zero_copy_only=False).astype(float)
                    sums += np.bincount(slots, np.repeat(weight * score[row], held), SLOTS)
                    best += np.bincount(slots, np.repeat(weight * top[row], held), SLOTS)
                if n < hi - lo:
                    texts = part.slice(n)
                    at = texts["slot"].to_numpy()
                    cols = [texts["doc_id"], texts["n_a"], texts["n_b"], texts["n_groups"], texts["doc_links"],
                            pa.array(best[at].astype(np.int64)), pa.array(sums[at].astype(np.int64)), texts["groups_sha256"]]
                    yield pa.RecordBatch.from_arrays(cols, schema=out)

    return both.mapInArrow(add, schema)
