"""N-gram Jaccard join: which documents share enough of their word shingles.

Documents are sets of hashed shingles of ``k`` words.  Equal sets are one
class.  Two classes of sizes a and b that link differ in at most
``(1 - t) / (1 + t) * (a + b)`` shingles.  So, when the shingles of a size
band are dealt by hash to more parts than that, some part is the same in both:
classes that share a part's content become candidates.  That needs no caps, and
words or passages that many documents hold make no candidates by themselves.
Empty parts count only for the rare sets with too few others; there are enough
parts for that, or else every two sets of a size would share an empty one.

Hashed signatures bound each overlap from above: of the shingles that hash to a
bit they hold the parity, so sets differ in one shingle at least for each bit in
which their signatures differ, and large sets, whose signatures are wider, don't fill them.  Among the classes that share a part only
signatures are compared, in blocks where there are many.  Near copies share
most of their parts, so large groups of about one size that hang together are
merged into one wherever that makes fewer pairs than the groups have by
themselves: each pair is looked at once then.  What the bound lets through hangs together in clusters.
A cluster is dealt to tiles: pairs of blocks of at most ``TILE`` classes of one
or of neighbouring size bands, so no task gets more than two blocks.  Inside a
tile wider signatures bound the overlaps again, and pairs that nothing has
linked yet are decided by intersecting their sorted arrays, nearest ones first.

Tiles return a spanning forest of the links; its components are the result.

Defined results: a text of fewer than ``k`` words has one shingle, all its
words; a null or wordless text has none, is linked with nothing and is its own
component; very long texts are whole sets like others; a similarity of exactly
``t`` links; repeated rows are copies; the component id is the least non-null id
of the component; an empty table gives an empty result; further columns are
ignored, whatever their names.  Shingles are told apart by 64-bit polynomial
hashes over random byte words, which texts made to collide could defeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._bytes import U, flat, mixed, pieces, prefix_sums, run_hash
from ._components import components
from ._util import discarded, text_key, unused, written

#: Classes of a block; a tile has two blocks at most.
TILE = 512
#: The same for groups of classes that share a part, of which only signatures are compared.
BLOCK = 1024
#: Sizes of a band grow by this factor.
BAND = 1.5
#: Parts beyond the number that a link can differ in, so that empty parts need no key: so many, and so many times the parts expected to be empty.
#: All unrelated sets of a band share the keys of empty parts, which makes pairs by the square of the table.
SPARE, EMPTY = 2, 5
#: Bits of a signature that is sent, wider for large sets, and of the widest one that is sent or that a tile makes.
SIGNATURE, MAX_SIGNATURE = 2048, 1 << 15
#: Candidates whose sets are intersected first, and elements that are intersected at once.
FIRST, ELEMENTS = 4, 1 << 18
#: Groups of more classes are merged where that saves pairs, and compared one by one.
LARGE = 64
#: Pairs of small groups that are compared at once.
PAIRS = 1 << 16
#: Digests that a task remembers so as to describe copies once; copies beyond are described again.
REMEMBERED = 1 << 17

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a piece."""
    n_docs = len(off) - 1
    if len(buf) == 0:
        yield from (np.zeros(0, np.uint64) for _ in range(n_docs))
        return
    buf = LOWER[buf]
    word = ~SPACE[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    first[cuts] = word[cuts]
    last[cuts - 1] = word[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    w = run_hash(prefix_sums(buf), starts, ends)
    bound = np.searchsorted(starts, off)
    if len(w) >= k:
        s = np.zeros(len(w) - k + 1, np.uint64)
        for j in range(k):
            s = (s + w[j : len(w) - k + 1 + j]) * U(0xD6E8FEB86659FD93 + 2 * j)
        s = mixed(s)
    for i in range(n_docs):
        a, b = int(bound[i]), int(bound[i + 1])
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        elif b > a:
            h = U(b - a)
            for x in w[a:b]:
                h = mixed((np.atleast_1d(h) + x) * U(0xA0761D6478BD642F))[0]
            yield np.atleast_1d(h)
        else:
            yield np.zeros(0, np.uint64)


def band_of(n: int) -> tuple[int, int]:
    """(band, least size of the next band)."""
    band = 0
    top = 2
    while n >= top:
        band += 1
        top = int(top * BAND) + 1
    return band, top


def n_parts(differ: int, t: float) -> int:
    """Parts for sets that differ in at most ``differ`` elements: more by ``SPARE``, and by some times the parts that the largest sets leave empty."""
    return differ + 1 + SPARE + int(EMPTY * differ * np.exp(-(1 + t) / (1 - t) / 2))


def part_keys(s: np.ndarray, t: float) -> np.ndarray:
    """Keys of the parts of a set; sets with a Jaccard similarity of ``t`` or more share one, unless they are equal."""
    n = len(s)
    band, top = band_of(n)
    homes = [(band, top)]
    while n / t >= homes[-1][1] - 1e-9:  # it can link with sets of the next band
        homes.append((homes[-1][0] + 1, int(homes[-1][1] * BAND) + 1))
    out = []
    spread = mixed(s ^ U(0x51AFD7ED558CCD01))
    for home, above in homes:
        differ = int((1 - t) / (1 + t) * 2 * (above - 1) + 1e-9)
        if differ == 0:
            continue  # only equal sets link
        m = n_parts(differ, t)
        part = (s % U(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        counts = np.bincount(part, minlength=m)
        full = np.flatnonzero(counts)
        sums = np.add.reduceat(spread[order], (np.cumsum(counts) - counts)[full])
        label = U((home * 1_000_003 + 7) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        out.append(mixed(mixed(sums + counts[full].astype(np.uint64)) + full.astype(np.uint64) * U(0xD1B54A32D192ED03) + label))
        # With any set of this home that it links with, it differs in at most ``own``: of more full parts one is the same in both.
        own = int((1 - t) / (1 + t) * (n + min(above - 1, int(n / t + 1e-9))) + 1e-9)
        if len(full) <= own:
            none = np.setdiff1d(np.arange(m), full).astype(np.uint64)
            out.append(mixed(mixed(none + U(0x1234567)) + none * U(0xD1B54A32D192ED03) + label))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_id(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def width_for(n: int, t: float) -> int:
    """Bits of the signature of a set: unrelated sets differ in half of them, and that must be more than sets that link differ in."""
    need = min(int(2.4 * (1 - t) / t * n), MAX_SIGNATURE)
    return max(SIGNATURE, 1 << max(need - 1, 0).bit_length())


def signature(s: np.ndarray, width: int = SIGNATURE) -> np.ndarray:
    """The parities of a set's hashed elements, as words: two sets differ in as many elements at least as their signatures do in bits."""
    odd = np.bincount(((s >> U(20)) % U(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(bool)).view(np.uint64)


def folded(sigs: np.ndarray, words: int) -> np.ndarray:
    """Signatures (one a row) at a smaller width."""
    return np.bitwise_xor.reduce(sigs.reshape(len(sigs), -1, words), axis=1)


class Wider:
    """The signatures of a batch that are wider than ``SIGNATURE``, to look again at pairs that may link."""

    def __init__(self, sigs: np.ndarray, size: np.ndarray, t: float):
        self.size, self.t = size, t
        self.words = np.array([0 if x is None else len(x) for x in sigs], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words[self.words > 0]).tolist():
            place, rows = np.zeros(len(sigs), np.int64), np.flatnonzero(self.words >= w)
            place[rows] = np.arange(len(rows))
            self.at[w] = place, np.concatenate([folded(sigs[r][None], w) for r in rows])

    def may_link(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) may still link, by the widest signatures that both have."""
        fine = np.ones(len(j), bool)
        if not self.at:
            return fine
        common = np.minimum(self.words[i], self.words[j])
        for w, (place, table) in self.at.items():
            here = np.flatnonzero(common == w)
            step = max(1, PAIRS * (SIGNATURE // 64) // w)
            for k in (here[a : a + step] for a in range(0, len(here), step)):
                apart = np.bitwise_count(table[place[i[k]]] ^ table[place[j[k]]]).sum(axis=1, dtype=np.int64)
                fine[k] = may_link(self.size[i[k]], self.size[j[k]], apart, self.t)
        return fine


def may_link(size_a: np.ndarray, size_b: np.ndarray, apart: np.ndarray, t: float) -> np.ndarray:
    """Whether sets whose signatures differ in ``apart`` bits can be as similar as ``t``: the bits bound the overlap from above.  Unknown sizes are -1."""
    both = size_a + size_b
    most = np.minimum((both - apart) // 2, np.minimum(size_a, size_b))
    return (most * (1 + t) >= t * both - 1e-6) | (np.minimum(size_a, size_b) < 0)


def _forest(node: np.ndarray, size: np.ndarray, sig: np.ndarray, side: np.ndarray, wider: Wider, first: int, t: float) -> list[tuple[int, int]]:
    """Places of pairs that connect what the bound lets through among the classes of one group, whose first row is ``first`` in ``wider``."""
    root = np.unique(node, return_inverse=True)[1]
    out = []
    for i in range(1, len(root)):
        near = np.flatnonzero((root[:i] != root[i]) & ((side[:i] == 0) | (side[:i] != side[i])))
        if not len(near):
            continue
        apart = np.bitwise_count(sig[near] ^ sig[i]).sum(axis=1, dtype=np.int64)
        near = near[may_link(size[near], size[i], apart, t)]
        for j in near[wider.may_link(np.full(len(near), first + i), first + near)]:
            if root[j] != root[i]:
                out.append((i, int(j)))
                root[root == root[j]] = root[i]
    return out


def _forests(ends: np.ndarray, node: np.ndarray, size: np.ndarray, sig: np.ndarray, side: np.ndarray, wider: Wider, t: float) -> list[tuple[int, int]]:
    """The same for many small groups, given by first place and end: groups of one size are compared at once."""
    out: list[tuple[int, int]] = []
    lens = ends[:, 1] - ends[:, 0]
    for g in np.unique(lens[lens > 1]).tolist():
        i, j = np.tril_indices(g, -1)
        starts = ends[lens == g, 0]
        step = max(1, PAIRS // len(i))
        for a in range(0, len(starts), step):
            x, y = (starts[a : a + step, None] + i).ravel(), (starts[a : a + step, None] + j).ravel()
            meet = (node[x] != node[y]) & ((side[x] == 0) | (side[x] != side[y]))
            x, y = x[meet], y[meet]
            apart = np.bitwise_count(sig[x] ^ sig[y]).sum(axis=1, dtype=np.int64)
            fine = np.flatnonzero(may_link(size[x], size[y], apart, t))
            fine = fine[wider.may_link(x[fine], y[fine])]
            root: dict[int, int] = {}
            for p, q in zip(x[fine].tolist(), y[fine].tolist()):
                while (r := root.get(p, p)) != p:
                    p = r
                while (r := root.get(q, q)) != q:
                    q = r
                if p != q:
                    root[p] = q
                    out.append((p, q))
    return out


def _bounded(batches: Iterator[pa.RecordBatch], t: float) -> Iterator[pa.RecordBatch]:
    """Rows (tile, side, node, n, sig) in order of tile, to pairs (a, b) of classes that may link."""
    held: list[np.ndarray] | None = None

    def solve(cols: list[np.ndarray], cut: np.ndarray) -> pa.RecordBatch:
        _, side, node, size, sig, wide = cols
        wider = Wider(wide, size, t)
        lens = np.diff(cut)
        small = lens <= LARGE
        pairs = [np.zeros((0, 2), np.int64)]
        ends = np.stack([cut[:-1][small], cut[1:][small]], axis=1)
        if len(ends):
            pairs.append(np.array(_forests(ends, node, size, sig, side, wider, t), np.int64).reshape(-1, 2))
        for a, b in zip(cut[:-1][~small].tolist(), cut[1:][~small].tolist()):
            found = _forest(node[a:b], size[a:b], sig[a:b], side[a:b], wider, a, t)
            if found:
                pairs.append(np.array(found, np.int64) + a)
        x = np.sort(node[np.concatenate(pairs)], axis=1)
        out = np.unique(x, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        buf, off = flat(b.column(4))
        lens = np.diff(off)
        sig, wide = np.zeros((b.num_rows, SIGNATURE // 64), np.uint64), np.full(b.num_rows, None, object)
        for n in np.unique(lens).tolist():
            rows = np.flatnonzero(lens == n)
            full = buf[off[rows][:, None] + np.arange(n)].view(np.uint64)
            sig[rows] = folded(full, SIGNATURE // 64)
            if n > SIGNATURE // 8:
                for r, x in zip(rows.tolist(), full):
                    wide[r] = x
        cols = [*(b.column(k).to_numpy() for k in range(4)), sig, wide]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        starts = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        last = int(starts[-1])  # its group may go on in the next batch
        held = [x[last:] for x in cols]
        yield solve([x[:last] for x in cols], starts)
    if held is not None:
        yield solve(held, np.array([0, len(held[0])]))


def _described(batches: Iterator[pa.RecordBatch], k: int, t: float) -> Iterator[pa.RecordBatch]:
    """(key, id, text) to (key, id, n, set, sig); of a task's copies only the first has a signature."""
    seen: set[bytes] = set()
    for b in batches:
        buf, off = flat(b.column(2))
        for i, j in pieces(off):
            sizes, ids, sigs = [], [], []
            for s in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k):
                sizes.append(len(s))
                ids.append(set_id(s) if len(s) else None)
                sigs.append(signature(s, width_for(len(s), t)).tobytes() if len(s) and ids[-1] not in seen else None)
                if len(seen) < REMEMBERED:
                    seen.add(ids[-1])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(sigs, pa.binary())],
                ["key", "id", "n", "set", "sig"],
            )


def _parted(batches: Iterator[pa.RecordBatch], k: int, t: float) -> Iterator[pa.RecordBatch]:
    """(text) to (node, part): the part keys of each set, once for a task's copies."""
    seen: set[bytes] = set()
    for b in batches:
        buf, off = flat(b.column(0))
        for i, j in pieces(off):
            nodes, keys = [], []
            for s in shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k):
                if len(s) and (x := set_id(s)) not in seen:
                    if len(seen) < REMEMBERED:
                        seen.add(x)
                    keys.append(part_keys(s, t))
                    nodes.append(np.full(len(keys[-1]), int.from_bytes(x[:8], "big", signed=True), np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(keys).view(np.int64))], ["node", "part"])


def tile_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps of a tile's sets, about 16 bits for each element of the largest one, so that the bound is tight."""
    most = max((len(s) for s in sets), default=1)
    width = min(MAX_SIGNATURE, max(SIGNATURE, 1 << (16 * most - 1).bit_length()))
    out = np.zeros((len(sets), width // 64), np.uint64)
    bits = np.zeros(width, bool)
    for i, s in enumerate(sets):
        at = (s >> U(20)) % U(width)
        bits[at] = True
        out[i] = np.packbits(bits).view(np.uint64)
        bits[at] = False
    return out


def shared_with(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted array with others, as many at once as have ``ELEMENTS`` together."""
    lens = np.array([len(x) for x in others], np.int64)
    part = (np.cumsum(lens) - lens) // ELEMENTS
    out = np.zeros(len(others), np.int64)
    for k in np.unique(part):
        here = np.flatnonzero(part == k)
        every = np.concatenate([others[i] for i in here])
        found = s[np.minimum(np.searchsorted(s, every), len(s) - 1)] == every
        out[here] = np.add.reduceat(found, np.cumsum(lens[here]) - lens[here], dtype=np.int64)
    return out


def tile_links(ids: list[bytes], sets: list[np.ndarray], sides: list[int], t: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links of a tile.  Sides 1 and 2 are two blocks, only pairs across are looked at; side 0 is one block."""
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
    ids, sets, side = [ids[i] for i in order], [sets[i] for i in order], np.array([sides[i] for i in order])
    size = np.array([len(s) for s in sets], np.int64)
    sig = tile_signatures(sets)
    root = np.arange(len(sets))
    links = []
    for i in range(1, len(sets)):
        lo = int(np.searchsorted(size, t * size[i] - 1e-9))
        near = np.arange(lo, i)
        near = near[(root[near] != root[i]) & ((side[near] == 0) | (side[near] != side[i]))]
        if not len(near):
            continue
        apart = np.bitwise_count(sig[near] ^ sig[i]).sum(axis=1).astype(np.int64)
        fine = may_link(size[near], size[i], apart, t)
        near = near[fine][np.argsort(apart[fine], kind="stable")]
        few = FIRST  # the nearest ones first: what they link needs no look at the rest
        while len(near):
            now, near = near[:few], near[few:]
            shared = shared_with(sets[i], [sets[j] for j in now])
            for j in now[links_at(shared, size[now], size[i], t)]:
                if root[j] != root[i]:
                    links.append((ids[i], ids[j]))
                    root[root == root[j]] = root[i]
            near = near[root[near] != root[i]]
            few *= 4
    return links


def links_at(shared, a, b, t: float):
    """shared / (a + b - shared) >= t, in whole thousandths of t."""
    return 1000 * shared >= round(1000 * t) * (a + b - shared)


def _tiles(batches: Iterator[pa.RecordBatch], k: int, t: float) -> Iterator[pa.RecordBatch]:
    """Rows (tile, set, side, text) in order of tile, to links (a, b)."""
    tile, ids, sets, sides, seen = None, [], [], [], set()
    out: list[tuple[bytes, bytes]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())], ["a", "b"])

    for b in batches:
        buf, off = flat(b.column(3))
        names, sets_in, side_in = (b.column(c).to_pylist() for c in range(3))
        for i, j in pieces(off):
            for r, s in zip(range(i, j), shingle_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], k)):
                if names[r] != tile:
                    out += tile_links(ids, sets, sides, t)
                    tile, ids, sets, sides, seen = names[r], [], [], [], set()
                    if len(out) > 10_000:
                        yield batch()
                        out.clear()
                if sets_in[r] not in seen:
                    seen.add(sets_in[r])
                    ids.append(sets_in[r])
                    sets.append(s)
                    sides.append(side_in[r])
    out += tile_links(ids, sets, sides, t)
    yield batch()


def _groups(parts: DataFrame) -> DataFrame:
    """(tile, side, node): the groups of nodes that share a part (node, part), large ones merged where it saves pairs, and cut into pairs of blocks."""
    own = Window.partitionBy("part")
    shared = parts.select("part", "node", F.min("node").over(own).alias("lo"), F.max("node").over(own).alias("hi"), F.count(F.lit(1)).over(own).alias("c"))
    shared = written(shared.where("lo <> hi").select("part", "node", "lo", "c"), "jac-shared")
    # Large groups hang together with others of about their size only, or common passages would join them all.
    level = F.floor(F.log2("c"))
    large = shared.where(F.col("c") > LARGE).select("part", "node", "c", F.xxhash64(level, "node").alias("x"), F.xxhash64(level, "lo").alias("first"))
    hang = components(large.select(F.col("x").alias("a"), F.col("first").alias("b"))).withColumnRenamed("node", "x")
    # Each row of a group of c stands for c of its pairs; all pairs of a merged group are n * n.
    named = large.select("part", "node", "c", "x").join(hang.hint("merge"), "x")
    cost = named.groupBy("root").agg(F.sum("c").alias("pairs")).join(hang.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "root")
    merged = cost.where(F.col("n") * F.col("n") <= F.col("pairs")).select("root", "n")
    named = named.join(merged.hint("merge"), "root", "left")
    named = named.select("node", F.when(F.col("n").isNotNull(), F.xxhash64(F.lit("merged"), "root")).otherwise(F.col("part")).alias("part"), F.coalesce("n", "c").alias("c")).distinct()
    groups = shared.where(F.col("c") <= LARGE).select("node", "part", "c").unionByName(named)
    groups = groups.withColumn("nb", F.ceil(F.col("c") / BLOCK).cast("int")).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pair = lambda i, j, side: F.struct(F.xxhash64("part", i, j).alias("tile"), F.lit(side).alias("side"))
    s = F.col("blk")
    blocks_of = F.transform(
        F.sequence(F.lit(0), F.col("nb") - 1),
        lambda x: F.when(x == s, pair(s, s, 0)).when(x > s, pair(s, x, 1)).otherwise(pair(x, s, 2)),
    )
    out = written(groups.select("node", F.inline(blocks_of)), "jac-groups")
    discarded(shared)
    return out


def _dealt(df: DataFrame, order: str | None = None) -> DataFrame:
    """``df`` with the rows of each tile together."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, "tile").sortWithinPartitions("tile", *([order] if order else []))


def _blocks(members: DataFrame, t: float) -> DataFrame:
    """Homes (tile, set, key, side) of clusters (set, key, n, cluster): one tile for a small cluster, pairs of blocks for a large one."""
    step = float(np.log(1 / t)) if t < 1 else 1.0
    banded = members.withColumn("band", F.floor(F.log("n") / F.lit(step)))
    sizes = banded.groupBy("cluster", "band").agg(F.count(F.lit(1)).alias("c"))
    sizes = sizes.withColumn("all", F.sum("c").over(Window.partitionBy("cluster")))
    blocks = sizes.select("cluster", "band", "all", F.when(F.col("all") <= TILE, F.lit(1)).otherwise(F.ceil(F.col("c") / TILE)).cast("int").alias("nb"))
    next_nb = blocks.select("cluster", (F.col("band") - 1).alias("band"), F.col("nb").alias("up"))
    prev_nb = blocks.select("cluster", (F.col("band") + 1).alias("band"), F.col("nb").alias("down"))
    blocks = blocks.join(next_nb, ["cluster", "band"], "left").join(prev_nb, ["cluster", "band"], "left").na.fill(0, ["up", "down"])
    m = banded.join(blocks, ["cluster", "band"]).withColumn("blk", F.pmod(F.xxhash64("set"), F.col("nb")).cast("int"))
    tile = lambda b1, s1, b2, s2, side: F.struct(F.concat_ws(":", "cluster", b1.cast("string"), s1.cast("string"), b2.cast("string"), s2.cast("string")).alias("tile"), F.lit(side).alias("side"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    b, s = F.col("band"), F.col("blk")
    many = F.concat(
        F.array(tile(b, s, b, s, 0)),
        F.transform(F.filter(upto(F.col("nb")), lambda x: x > s), lambda x: tile(b, s, b, x, 1)),
        F.transform(F.filter(upto(F.col("nb")), lambda x: x < s), lambda x: tile(b, x, b, s, 2)),
        F.transform(upto(F.col("up")), lambda x: tile(b, s, b + 1, x, 1)),
        F.transform(upto(F.col("down")), lambda x: tile(b - 1, x, b, s, 2)),
    )
    single = F.array(tile(F.lit(0), F.lit(0), F.lit(0), F.lit(0), 0))
    return m.select("key", "set", F.inline(F.when(F.col("all") <= TILE, single).otherwise(many))).select("tile", "set", "key", "side")


def jaccard_components(docs: DataFrame, k: int = 5, t: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, key (of the text)."""
    texts = docs.select(text_key(F.col(text_col)).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.mapInArrow(partial(_described, k=k, t=t), "key binary, id long, n long, set binary, sig binary")
    rows = written(rows, "jac-rows")
    base = rows.select("key", "id", "n", "set")
    # Nodes of the candidate graph are 64 bits of the class id.  Where two classes share them, the node may link with anything (n = -1).
    node = F.conv(F.hex(F.substring("set", 1, 8)), 16, -10).cast("long")
    alone = F.min("set") == F.max("set")
    sigs = rows.where("sig is not null").groupBy(node.alias("node")).agg(F.when(alone, F.min("n")).otherwise(F.lit(-1)).alias("n"), F.min("sig").alias("sig"))
    # The texts are read again for their parts: those take more room than the texts, and go before signatures are sent.
    grouped = _groups(texts.select("text").mapInArrow(partial(_parted, k=k, t=t), "node long, part long"))
    sent = grouped.join(sigs.hint("merge"), "node").select("tile", "side", "node", "n", "sig")
    close = written(_dealt(sent, "n").mapInArrow(partial(_bounded, t=t), "a long, b long"), "jac-close")
    discarded(grouped)
    clusters = components(close)
    classes = base.where("n > 0").groupBy("set").agg(F.min("key").alias("key"), F.min("n").alias("n"), F.min("id").alias("least")).withColumn("node", node)
    classes = written(classes, "jac-classes")
    members = classes.join(clusters, "node").select("set", "key", "n", F.col("root").alias("cluster"))
    homes = written(_blocks(members, t), "jac-homes")
    # Texts of the candidates only, one for each class.  Merge joins at every size: a broadcast of few members would not outlive growth.
    wanted = texts.where("key is not null").join(homes.select("key").distinct().hint("merge"), "key").dropDuplicates(["key"]).select("key", "text")
    tiles = _dealt(homes.join(wanted.hint("merge"), "key").select("tile", "set", "side", "text"))
    links = written(tiles.mapInArrow(partial(_tiles, k=k, t=t), "a binary, b binary"), "jac-links")
    linked = components(links)
    # -- classes, then rows
    named = classes.join(linked.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set"))
    heads = named.groupBy("root").agg(F.min("least").alias("component"))
    named = written(named.join(heads, "root").select("set", "component"), "jac-named")
    discarded(classes, close, homes, links)
    out = base.join(named, "set", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), "key")


def keep_one(docs: DataFrame, k: int = 5, t: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row of each component: the one with the least id.

    Rows without shingles or without an id all stay; of repeated rows of the least id, one stays.
    """
    found = jaccard_components(docs, k, t, id_col, text_col)
    key, i = unused(docs, "text_key", "id_of")
    keep = found.where((F.col("n_shingles") > 0) & (F.col(id_col) == F.col("component_id"))).select(F.col(id_col).alias(i), F.col("key").alias(key))
    # Equal ids with different texts of one component: the least text key stays.
    keep = keep.groupBy(i).agg(F.min(key).alias(key))
    bare = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) == 0
    cols = docs.columns
    alone = docs.where(bare | F.col(id_col).isNull())
    rest = docs.where(~bare & F.col(id_col).isNotNull()).withColumn(key, text_key(F.col(text_col))).withColumn(i, F.col(id_col).cast("long"))
    kept = rest.join(keep, [i, key]).dropDuplicates([i])
    return kept.select(*cols).unionByName(alone.select(*cols))
