"""Exact n-gram Jaccard join by prefix trees, and the components of its links.

A text's set holds the hashes of its distinct five-word shingles. Equal sets form one class; classes link when
100 * intersection >= 80 * union. Steps:

1. One pass gives every row its set size, class signature and parity bitmap (the exclusive or of one bit per shingle), and
   every task's frequent shingles. Frequent ones (at most ``HOT``) come last in the global order; the rest go by hash.
2. Two linked sets share a shingle among the first n - ceil(0.8 n) + 1 of each. Those postings are shuffled once, frequent
   shingles salted. Within a posting list every class meets the list's leader only (a star), so a list of any size gives
   as many pairs as it has members.
3. Pairs whose sizes or bitmaps rule a link out go: sets differ in at least as many shingles as their bitmaps in bits.
4. The rest is verified by a prefix tree: a leader's members are stored as a tree over the global order, the leader's set
   walks it, siblings share the overlap of their common prefix, and branches that cannot reach the threshold are cut.
5. Lists whose classes are not all in one component by then are compared in full, by bitmap, in blocks of bounded size
   and across components only. Each class's likeliest pairs are verified first, which joins most of what belongs together. Classes with pairs still open form neighbourhoods, and each of these is settled once by
   prefix trees, block against block. So no link that joins two components is lost, whatever a list's size.

Null texts and texts without words have an empty set, link with nothing and are their own component. Repeated rows are
exact copies. A null id never names a component unless every id in it is null. An empty table gives an empty table.
"""

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from groundsieve.llm.common import written
from groundsieve.llm.components import components

WIDTH, HOT, SALTS, BLOCK, MEMBERS, GROUP = 5, 1 << 17, 32, 1024, 256, 512
LIKELY, ROUNDS = 3, 2  # likeliest pairs that are verified before whole lists are settled: speed only
BITS = 2048  # of a parity bitmap
KEEP = 2_000_000  # class signatures that are broadcast at most (16 MB); beyond, sets are picked by a join
_MULTIPLIERS = [np.uint64(m | 1) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


_BASE, _CHUNK = 0x5851F42D4C957F2D, 1 << 20
_BLANK = bytes(k in (9, 10, 11, 12, 13, 32) for k in range(256))
_powers = np.ones(0, np.uint64), np.ones(0, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2^64, grown when a longer chunk comes."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 14, 2 * n)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers = tuple(np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(size - 1, x))) for x in (np.uint64(_BASE), np.uint64(inverse)))
    return _powers


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[0]
    return h ^ (h >> np.uint64(29))


def _chunk_hashes(data: bytes) -> np.ndarray:
    b, blank = np.frombuffer(data, np.uint8), np.frombuffer(b"\x01" + data.translate(_BLANK) + b"\x01", np.uint8)
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    power, inverse = _power_tables(len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * power[: len(b)], out=total[1:])
    first, after = edges[::2], edges[1::2]
    return _mixed((total[after] - total[first]) * inverse[first] + (after - first).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word, from all bytes at once: a polynomial in the place inside the word, then mixed."""
    data = text.encode().lower()  # on bytes: A-Z only, and the six ASCII white-space bytes part words
    if len(data) <= _CHUNK:
        return _chunk_hashes(data)
    parts, at = [], 0
    while at < len(data):
        end = len(data)
        if end - at > _CHUNK and (cut := re.compile(rb"[\t-\r ]").search(data, at + _CHUNK)):
            end = cut.end()
        parts.append(_chunk_hashes(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingles(text: str | None) -> np.ndarray:
    """The ascending array of a text's distinct shingle hashes."""
    h = word_hashes(text or "")
    if not len(h):
        return h
    n, width = max(1, len(h) - WIDTH + 1), min(WIDTH, len(h))
    s = np.full(n, width, np.uint64)
    for k in range(width):
        s = (s + h[k : k + n]) * _MULTIPLIERS[k]
        s ^= s >> np.uint64(31)
    s.sort()
    return s[np.append(True, s[1:] != s[:-1])]


def signature(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), seed=len(s) & 0xFFFFFFFF) - (1 << 63)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the set's hashes by bucket: ``BITS`` buckets, for sets above half as many at least two a shingle."""
    size = max(BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else BITS
    at = ((s * _MULTIPLIERS[1]) >> np.uint64(16)) & np.uint64(size - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=size).astype(np.uint8) & 1).tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A longer bitmap as one of ``words`` longs: buckets are taken modulo the size, so halves are added up."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def _links(overlap, a, b):
    return 9 * overlap >= 4 * (a + b)


def prefix_size(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _ordered(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """``s`` in the global order: by hash, those of ``hot`` (ascending hashes in hot[0], ranks in hot[1]) last, by rank."""
    if not len(hot[0]):
        return s
    at = np.minimum(np.searchsorted(hot[0], s), len(hot[0]) - 1)
    common = hot[0][at] == s
    return np.concatenate([s[~common], s[common][np.argsort(hot[1][at[common]], kind="stable")]])


class PrefixTree:
    """Sets as paths over the global order, sorted: neighbours share the path of their common prefix, as in a tree."""

    def __init__(self, sets: list[np.ndarray], hot: np.ndarray):
        self.alphabet = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]))
        rank = np.empty(len(self.alphabet), np.int64)
        rank[np.searchsorted(self.alphabet, _ordered(self.alphabet, hot))] = np.arange(len(self.alphabet))
        self.rank = rank
        paths = [np.sort(rank[np.searchsorted(self.alphabet, s)]) for s in sets]
        self.order = sorted(range(len(sets)), key=lambda i: paths[i].astype(">u4").tobytes())
        self.paths = [paths[i] for i in self.order]

    def walk(self, probe: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Which of the sets that are ``asked`` for link with ``probe``.

        The overlap of a shared prefix is carried from path to path, and a branch is left as soon as what remains of
        path and probe cannot lift it to the threshold.
        """
        size, alphabet = len(probe), self.alphabet
        in_probe = np.zeros(len(alphabet), np.int64)
        if len(alphabet):
            at = np.minimum(np.searchsorted(alphabet, probe), len(alphabet) - 1)
            in_probe[self.rank[at[alphabet[at] == probe]]] = 1
        below = np.append(0, np.cumsum(in_probe))  # probe shingles before a rank
        out, path, overlap = np.zeros(len(self.paths), bool), np.empty(0, np.int64), np.zeros(1, np.int64)
        for i, p in zip(self.order, self.paths):
            if not asked[i]:
                continue
            m = min(len(p), len(path))
            same = p[:m] == path[:m]
            shared = m if same.all() else int(same.argmin())
            carried = overlap[shared]
            left = below[-1] - (below[p[shared - 1] + 1] if shared else 0)
            if not _links(carried + min(len(p) - shared, left), size, len(p)):
                path, overlap = p[:shared], overlap[: shared + 1]
                continue
            overlap = np.concatenate([overlap[: shared + 1], carried + np.cumsum(in_probe[p[shared:]])])
            path = p
            out[i] = _links(overlap[-1], size, len(p))
        return out


def tree_links(probe: np.ndarray, sets: list[np.ndarray], hot: np.ndarray) -> np.ndarray:
    """Which of ``sets`` link with ``probe``."""
    return PrefixTree(sets, hot).walk(probe, np.ones(len(sets), bool))


class Merged:
    """Union-find over small integers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def roots(self) -> np.ndarray:
        while (self.up != (further := self.up[self.up])).any():
            self.up = further
        return self.up


def _may_link(a_n, b_n, a_bits, b_bits) -> np.ndarray:
    """Bound by sizes and bitmaps: rows of equal count, or one row against many."""
    apart = np.bitwise_count(a_bits ^ b_bits).sum(-1).astype(np.int64)
    return _links(np.minimum(np.minimum(a_n, b_n), (a_n + b_n - apart) // 2), a_n, b_n)


class Bitmaps:
    """Bitmaps of many sets: all folded to the common size, and the long ones as they are."""

    def __init__(self, column):
        self.full = [np.frombuffer(b, np.uint64) for b in column]
        self.base = np.stack([folded(b, BITS // 64) for b in self.full]) if self.full else np.empty((0, BITS // 64), np.uint64)

    def may_link(self, n: np.ndarray, rows: np.ndarray, other: "Bitmaps", m: np.ndarray, others: np.ndarray) -> np.ndarray:
        """For pairs of a row here and a row of ``other``, whether sizes and bitmaps leave a link open; n and m are set sizes."""
        ok = _may_link(n[rows], m[others], self.base[rows], other.base[others])
        for k in np.flatnonzero(ok & (np.maximum(n[rows], m[others]) > BITS // 2)):
            a, b = self.full[rows[k]], other.full[others[k]]
            words = min(len(a), len(b))
            ok[k] = _may_link(n[rows[k]], m[others[k]], folded(a, words), folded(b, words))
        return ok


def described(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (row, doc_id, text): row, doc_id, n, sig, bits; besides, rows (token, times) of each batch's frequent shingles."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t) for t in b.text]
            yield pd.DataFrame({"row": b.row, "doc_id": b.doc_id.to_numpy(object, na_value=None), "n": [len(s) for s in sets], "sig": [signature(s) for s in sets],
                                "bits": [bitmap(s) for s in sets], "token": pd.array([None] * len(b), "Int64"), "times": pd.array([None] * len(b), "Int64")})
            classes = list({(len(s), signature(s)): s for s in sets}.values())
            tokens, times = np.unique(np.concatenate([np.empty(0, np.uint64), *classes]), return_counts=True)
            tokens, times = tokens[times > 3].view(np.int64), times[times > 3]
            nothing = pd.array([None] * len(tokens), "Int64")
            if len(tokens):
                yield pd.DataFrame({"row": nothing, "doc_id": [None] * len(tokens), "n": nothing, "sig": nothing, "bits": [None] * len(tokens), "token": tokens, "times": times})

    # ids go through pandas as text: a null must not turn the others into doubles
    named = docs.select("row", F.col("doc_id").cast("string"), "text")
    made = named.mapInPandas(describe, "row long, doc_id string, n long, sig long, bits binary, token long, times long")
    return written(made.withColumn("doc_id", F.col("doc_id").cast("long")))


def frequent(rows: DataFrame) -> np.ndarray:
    """Frequent shingles, at most ``HOT``, as ascending hashes and their ranks by count."""
    counts = written(rows.where("token is not null").groupBy("token").agg(F.sum("times").alias("times")).where("times >= 8"))
    octaves = {r.o: r.n for r in counts.groupBy(F.floor(F.log2("times")).cast("int").alias("o")).agg(F.count("*").alias("n")).collect()}
    least, total = 3, 0
    for o in sorted(octaves, reverse=True):
        total += octaves[o]
        if total > HOT:
            least = o + 1
            break
    found = counts.where(F.col("times") >= 2**least).toPandas()  # at most HOT rows
    token, times = found.token.to_numpy(np.int64).view(np.uint64), found.times.to_numpy(np.int64)
    order = np.lexsort([token, times])
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    at = np.argsort(token)
    return np.stack([token[at], rank[at]])


def postings(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(token, salt, sig): the prefix of every class, once per task. Frequent tokens are salted by class, others have salt -1."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot, seen = shared.value, set()
        for b in batches:
            tokens, sigs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for t in b.text:
                s = shingles(t)
                sig = signature(s)
                if len(s) and sig not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    prefix = _ordered(s, hot)[: prefix_size(len(s))]
                    tokens.append(prefix)
                    sigs.append(np.full(len(prefix), sig, np.int64))
            token, sig = np.concatenate(tokens), np.concatenate(sigs)
            salt = np.where(np.isin(token, hot[0]), sig % SALTS, -1)
            yield pd.DataFrame({"token": token.view(np.int64), "salt": salt, "sig": sig})

    return docs.select("text").mapInPandas(post, "token long, salt long, sig long")


def stars(posted: DataFrame) -> DataFrame:
    """Postings that are shared, with their list's leader: one shuffle. A salted list keeps single members too."""
    lists = Window.partitionBy("token", "salt")
    led = posted.withColumns({"leader": F.min("sig").over(lists), "last": F.max("sig").over(lists)})
    return written(led.where("leader <> last or salt >= 0").select("token", "salt", "sig", "leader").distinct())


def star_pairs(shared: DataFrame) -> DataFrame:
    """(a, b): each member with its leader, and the leaders of a salted token with the smallest of them."""
    plain = shared.where("sig <> leader").select(F.col("leader").alias("a"), F.col("sig").alias("b"))
    leaders = shared.where("salt >= 0").select("token", "leader").distinct()
    heads = leaders.join(leaders.groupBy("token").agg(F.min("leader").alias("head")), "token").where("head <> leader")
    return plain.union(heads.select(F.col("head").alias("a"), F.col("leader").alias("b"))).distinct()


def bounded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that sizes and bitmaps leave open."""
    side = lambda x: classes.select(F.col("sig").alias(x), F.col("n").alias(f"{x}_n"), F.col("bits").alias(f"{x}_bits"))
    wide = pairs.join(side("a"), "a").where("a_n > 0").join(side("b"), "b").where("5 * a_n >= 4 * b_n and 5 * b_n >= 4 * a_n")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            every = np.arange(len(p))
            ok = Bitmaps(p.a_bits).may_link(p.a_n.to_numpy(), every, Bitmaps(p.b_bits), p.b_n.to_numpy(), every)
            yield p.loc[ok, ["a", "b"]]

    return wide.select("a", "b", "a_n", "b_n", "a_bits", "b_bits").mapInPandas(check, "a long, b long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sig, items) of the wanted classes: one more pass; the wanted signatures are broadcast up to ``KEEP``, else joined."""
    few = wanted.limit(KEEP + 1).count() <= KEEP
    sigs = np.sort(wanted.toPandas().sig.to_numpy(np.int64)) if few else None
    shared = docs.sparkSession.sparkContext.broadcast(sigs)

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sigs, seen = shared.value, set()
        for b in batches:
            rows = []
            for t in b.text:
                s = shingles(t)
                sig = signature(s)
                at = 0 if sigs is None or not len(sigs) else min(int(np.searchsorted(sigs, sig)), len(sigs) - 1)
                if sig not in seen and (sigs is None or (len(sigs) and sigs[at] == sig)):
                    if len(seen) < 1_000_000:
                        seen.add(sig)
                    rows.append((sig, s.tobytes()))
            yield pd.DataFrame(rows, columns=["sig", "items"])

    made = docs.select("text").mapInPandas(make, "sig long, items binary")
    if not few:
        made = made.join(wanted, "sig", "left_semi")
    return written(made.groupBy("sig").agg(F.first("items").alias("items")))


def verified(pairs: DataFrame, sets: DataFrame, hot: np.ndarray) -> DataFrame:
    """Pairs that link, by prefix trees of about ``MEMBERS`` sets; a larger star is cut by salt, small ones share a group."""
    groups = max(1, -(-pairs.count() // GROUP))
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    members = pairs.join(sizes, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"), F.col("b").alias("sig"))
    heads = sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("sig"))
    rows = members.union(heads).join(sets, "sig").withColumn("g", F.pmod(F.xxhash64("a", "part"), F.lit(groups)))
    shared = pairs.sparkSession.sparkContext.broadcast(hot)

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        stars: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for a, part, sig, items in zip(g.a, g.part, g.sig, g["items"]):
            stars.setdefault((a, part), {})[sig] = np.frombuffer(items, np.uint64)
        a_out, b_out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for (a, _), found in stars.items():
            probe = found.pop(a)
            if found:
                ok = np.fromiter(found, np.int64)[tree_links(probe, list(found.values()), shared.value)]
                a_out.append(np.full(len(ok), a))
                b_out.append(ok)
        return pd.DataFrame({"a": np.concatenate(a_out), "b": np.concatenate(b_out)})

    return rows.groupBy("g").applyInPandas(walk, "a long, b long")


def residual(shared: DataFrame, labels: DataFrame, classes: DataFrame, best: int = 0) -> DataFrame:
    """Pairs (a, b) of posting lists whose classes are in different components and not ruled out by bitmap.

    With ``best``, each member outside a list's largest component gives its ``best`` likeliest pairs. Without, members
    that have an open pair are given with whom they hang together by such pairs: every such member is named.
    Lists are compared in blocks of about ``BLOCK`` members and give a number of rows linear in them.
    """
    named = shared.select("token", "sig").join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    lists = named.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("m"),
                                       F.bit_xor(F.xxhash64("sig")).alias("members")).where("low <> high and m > 2")  # a pair has met as a star
    lists = lists.groupBy("m", "members").agg(F.min("token").alias("token"))  # lists of the same classes are compared once
    blocks = F.ceil(F.col("m") / BLOCK)
    own = F.pmod(F.xxhash64("sig"), F.col("blocks"))
    placed = named.join(lists.select("token", blocks.alias("blocks")), "token").withColumn("own", own)
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = placed.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "label").join(classes, "sig")
    groups = max(1, -(-int(lists.agg(F.sum(F.col("m") * blocks).alias("n")).first().n or 0) // (8 * BLOCK)))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("token", "i", "j"), F.lit(groups)))

    def neighbourhoods(maps, n, label, sig, own, apart: bool) -> list[tuple[int, int]]:
        _, of, sizes = np.unique(label, return_inverse=True, return_counts=True)
        order = np.lexsort([of, -sizes[of]])  # the largest component first: only the rest starts comparisons
        place, n, of, sig, own = order, n[order], of[order], sig[order], own[order]
        size = np.empty(len(n), np.int64)
        size[place] = n
        merged, touched, likely = Merged(len(sig)), np.zeros(len(sig), bool), []
        for k in range(int(sizes.max()), len(of)):
            before = np.flatnonzero((of[:k] != of[k]) & (5 * n[:k] >= 4 * n[k]) & (5 * n[k] >= 4 * n[:k]))
            if apart:
                before = before[own[before] != own[k]]
            hit = before[maps.may_link(size, place[before], maps, size, np.full(len(before), place[k]))]
            if best:
                apart_bits = np.bitwise_count(maps.base[place[hit]] ^ maps.base[place[k]]).sum(1) / (n[hit] + n[k])
                likely += [(min(sig[h], sig[k]), max(sig[h], sig[k])) for h in hit[np.argsort(apart_bits, kind="stable")[:best]]]
                continue
            touched[hit], touched[k] = True, touched[k] or len(hit) > 0
            for h in hit:
                merged.join(k, h)
        roots = merged.roots()
        return likely or [(sig[roots[k]], sig[k]) for k in np.flatnonzero(touched)]

    def compare(g: pd.DataFrame) -> pd.DataFrame:
        at, g = _segments(g, ["token", "i", "j"])
        maps, columns = list(g["bits"]), [g[c].to_numpy() for c in ("n", "label", "sig", "own")]
        apart = g.i.to_numpy() != g.j.to_numpy()
        found = [e for x, y in at for e in neighbourhoods(Bitmaps(maps[x:y]), *[c[x:y] for c in columns], bool(apart[x]))]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.select("g", "token", "i", "j", "own", "sig", "label", "n", "bits").groupBy("g").applyInPandas(compare, "a long, b long").distinct()


def _segments(g: pd.DataFrame, keys: list[str]) -> tuple[list[tuple[int, int]], pd.DataFrame]:
    """``g`` in order of ``keys`` and the row ranges of equal keys."""
    g = g.sort_values(keys, kind="stable")
    at = np.flatnonzero(np.append(True, (np.diff(g[keys].to_numpy(), axis=0) != 0).any(1)))
    return list(zip(at, np.append(at[1:], len(g)))), g


def settled(docs: DataFrame, neighbours: DataFrame, labels: DataFrame, hot: np.ndarray) -> DataFrame:
    """Links (a, b) that join two components, from ``neighbours``: members that hang together through open pairs.

    Each neighbourhood is compared once, in blocks of about ``BLOCK`` sets; a walk asks only for sets that its own
    block has not joined yet, so a neighbourhood of m members yields at most m - 1 links a block.
    """
    near = components(neighbours).withColumnRenamed("node", "sig").withColumnRenamed("label", "near")
    known = near.join(labels.withColumnRenamed("node", "sig"), "sig", "left").select("near", "sig", F.coalesce("label", "sig").alias("label"))
    blocks = near.groupBy("near").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = known.join(blocks, "near").withColumn("own", F.pmod(F.xxhash64("sig"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("near", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "sig", "label")
    groups = max(1, -(-placed.count() // GROUP))  # a few megabytes of sets each
    rows = placed.join(sets_of(docs, near.select("sig")), "sig").withColumn("g", F.pmod(F.xxhash64("near", "i", "j"), F.lit(groups)))
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def join(sets, label, sig, own, apart: bool) -> list[tuple[int, int]]:
        _, of = np.unique(label, return_inverse=True)
        merged, links = Merged(int(of.max()) + 1), []
        n, maps = np.array([len(s) for s in sets]), Bitmaps([bitmap(s) for s in sets])
        tree = PrefixTree(sets, shared.value)
        for k in range(1, len(sets)):
            roots = merged.roots()[of]
            asked = np.zeros(len(sets), bool)
            before = np.flatnonzero((roots[:k] != roots[k]) & ((own[:k] != own[k]) | (not apart)))
            asked[before] = maps.may_link(n, before, maps, n, np.full(len(before), k))
            if asked.any():
                links += [(sig[h], sig[k]) for h in np.flatnonzero(tree.walk(sets[k], asked)) if merged.join(of[h], of[k])]
        return links

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        at, g = _segments(g, ["near", "i", "j"])
        sets, columns = [np.frombuffer(x, np.uint64) for x in g["items"]], [g[c].to_numpy() for c in ("label", "sig", "own")]
        apart = g.i.to_numpy() != g.j.to_numpy()
        found = [e for x, y in at for e in join(sets[x:y], *[c[x:y] for c in columns], bool(apart[x]))]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return rows.select("g", "near", "i", "j", "own", "sig", "label", "items").groupBy("g").applyInPandas(solve, "a long, b long")


def labelled(docs: DataFrame) -> DataFrame:
    """row, doc_id, n and label of every row of ``docs`` (row, doc_id, text): equal labels are linked, null ones are empty."""
    rows = described(docs)
    hot = frequent(rows)
    per_row = rows.where("token is null")
    classes = written(per_row.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("bits").alias("bits")))
    shared = stars(postings(docs, hot))
    open_pairs = written(bounded(star_pairs(shared), classes))
    ends = lambda p: p.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
    links = written(verified(open_pairs, sets_of(docs, ends(open_pairs)), hot))
    labels = components(links)
    for _ in range(ROUNDS):
        likely = written(residual(shared, labels, classes, best=LIKELY))
        links = written(links.union(verified(likely, sets_of(docs, ends(likely)), hot)))
        labels = components(links)
    more = written(residual(shared, labels, classes))
    if more.limit(1).count():
        links = written(links.union(settled(docs, more, labels, hot)))
        labels = components(links)
    named = per_row.join(labels.withColumnRenamed("node", "sig"), "sig", "left")
    return named.select("row", "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "sig")).alias("label"))


def _numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """Rows numbered by their place in storage: ``docs`` must come straight from files, so that a repeated read agrees."""
    return docs.select(F.monotonically_increasing_id().alias("row"), *columns)


def join_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (columns doc_id, text)."""
    named = labelled(_numbered(docs, "doc_id", "text"))
    first = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("first"))
    linked = named.join(first, "label", "left")
    return linked.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def one_per_component(docs: DataFrame) -> DataFrame:
    """``docs`` without near duplicates: of each component the row with the smallest id stays (nulls last, ties by place)."""
    named = written(labelled(_numbered(docs, "doc_id", "text")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = named.where("label is not null").groupBy("label").agg(F.min(order).alias("best"))
    kept = best.select(F.col("best.row").alias("row")).union(named.where("label is null").select("row"))
    return _numbered(docs, *docs.columns).join(kept, "row", "left_semi").select(*docs.columns)
