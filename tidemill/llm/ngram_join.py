"""Jaccard join of word-shingle sets with prefix trees, returned as connected components.

1. Equal sets become one class (a 128-bit digest of the sorted 64-bit shingle hashes).
2. Candidates: of each class the SKETCH smallest hashes. Of two sets with Jaccard 3/4 or more each of
   the smallest hashes of their union lies in both with probability 3/4 or more, so they share at
   least NEEDED of the SKETCH smallest, but for a probability below 1e-15 (less than that of a
   collision of the hashes themselves); sets up to SMALL shingles are compared whole, where sharing
   three quarters is certain. A prefix filter over these, rarest hash first, leaves few hashes of a set
   that link it to others; a hash that belongs to no other set never does.
3. Blocks: a hash stands for the smallest class that has it in its prefix. First each class is held
   against the smallest block it is in, which joins up nearly all of a group of near copies; then
   every block that still holds members of several components is searched.
4. Within a block the whole sets stand in a prefix tree, commonest shingle first. From a pivot set the
   tree is walked once, overlaps shared along its paths, and subtrees left when their remaining length
   can no longer reach half. Jaccard distance is a metric: a set linked to the pivot, and nearer to it by
   more than 1/4 than any unlinked one, has no further links to find. Then the next pivot, until all
   that are left are known to be connected. Links are decided on the whole sets, in whole numbers.
5. A block of more than BLOCK_SETS sets or CHUNK_HASHES hashes is dealt to chunks, each searched by itself. Then pivots, a few from
   each label that isn't the block's commonest, are held against all chunks, and in the end all sets
   that aren't of the commonest label: a stated query set against all rows, in chunks. After that no
   two sets of a block with different labels are left uncompared.

No pairs within a block are emitted, only pivot stars; components follow from these. Null and empty
texts: no shingles, linked with nothing. Repeated rows fall into one class. Empty table: empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.base import AT, FILE, Lookup, Scratch, WordTable, flat_words, join_groups, located, slices, text_slices, without
from tidemill.llm.components import connected_components

WORDS, NUMERATOR = 5, 75
SKETCH, NEEDED = 64, 17
SMALL = SKETCH * NUMERATOR // 100
BLOCK_SETS, PIVOTS, SPREAD_SETS = 64, 32, 400
#: Cells of the table of shingles by pivots that one walk of a tree may fill, and of what it gathers from it at once.
WALK_CELLS = 4_000_000
#: Hashes of a chunk, about (two sets at least): a worker takes some 60 bytes for each, and holds a chunk and as many pivots.
CHUNK_HASHES = 500_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_words = WordTable(_hash_words, alone=True)


def split(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes both follow ASCII: A-Z, and white space 0x20 and 0x09 to 0x0D


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, starts = flat_words(texts, split)
    if not words:
        return [np.zeros(0, np.uint64)] * len(texts)
    h = _words.of(words)
    n = max(0, len(h) - WORDS + 1)
    r = np.full(n, WORDS, np.uint64)
    for k in range(WORDS):
        r = (r ^ h[k : k + n]) * _P
        r ^= r >> np.uint64(32)
    r = _mix(r)
    out = []
    for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if z - a >= WORDS:
            out.append(np.unique(r[a : z - WORDS + 1]))
        elif z > a:
            v = np.array([z - a], np.uint64)
            for x in h[a:z]:
                v = (v ^ x) * _P
                v ^= v >> np.uint64(32)
            out.append(_mix(v))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _digest(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, digest, parts = [], [], []
        for _, _, texts in text_slices(b):
            for s in shingle_sets(texts):
                n.append(len(s))
                digest.append(_digest(s))
                parts.append(s[:SKETCH].view(np.int64))
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
        yield pa.record_batch({**{c: b.column(b.schema.get_field_index(c)) for c in ("doc_id", FILE, AT)}, "n_shingles": pa.array(n, pa.int64()), "digest": pa.array(digest, pa.binary()), "sketch": pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))})


def _whole_sets(lookup: Lookup):
    """FILE, AT, text -> cid, hashes of the rows that the lookup has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = lookup.reader()
        for b in batches:
            rows, found = find(b)
            if found is None:
                continue
            out = [s.tobytes() for _, _, texts in text_slices(b.take(pa.array(rows))) for s in shingle_sets(texts)]
            yield pa.record_batch({"cid": found.column("cid").combine_chunks(), "hashes": pa.array(out, pa.binary())})

    return run


class PrefixTree:
    """Sets in a global order (commonest hash first, ties by hash) as paths of a compressed trie."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.lexsort((values, -counts))] = np.arange(len(values))
        codes = rank[codes]
        ends = np.cumsum([len(s) for s in sets])
        self.sets = [np.sort(x) for x in np.split(codes, ends[:-1])]
        self.n_values = len(values)
        order = sorted(range(len(sets)), key=lambda i: self.sets[i].astype(">u4").tobytes())
        # nodes: set that spells the node, its first and last position there, parent
        spell, lo, hi, parent, terminal = [], [], [], [], [0] * len(sets)
        stack: list[int] = []  # nodes from the root to the last set's end
        last: np.ndarray | None = None
        for i in order:
            s = self.sets[i]
            if last is None:
                common = 0
            else:
                m = min(len(s), len(last))
                differ = np.flatnonzero(s[:m] != last[:m])
                common = int(differ[0]) if len(differ) else m
            while stack and lo[stack[-1]] >= common:
                stack.pop()
            if stack and hi[stack[-1]] > common:  # split the node at the common depth
                top = stack[-1]
                spell.append(spell[top])
                lo.append(lo[top])
                hi.append(common)
                parent.append(parent[top])
                new = len(spell) - 1
                lo[top], parent[top] = common, new
                stack[-1] = new
            if common < len(s):
                spell.append(i)
                lo.append(common)
                hi.append(len(s))
                parent.append(stack[-1] if stack else -1)
                stack.append(len(spell) - 1)
            terminal[i] = stack[-1]
            last = s
        self._arrange(spell, lo, hi, parent, terminal)

    def _arrange(self, spell, lo, hi, parent, terminal) -> None:
        """Nodes by depth, with the tokens of each, and the shortest and longest set below each."""
        n = len(spell)
        depth = [-1] * n
        for v in range(n):
            path = []
            while v >= 0 and depth[v] < 0:
                path.append(v)
                v = parent[v]
            d = depth[v] if v >= 0 else -1
            for x in reversed(path):
                d += 1
                depth[x] = d
        by = sorted(range(n), key=depth.__getitem__)
        place = [0] * n
        for k, v in enumerate(by):
            place[v] = k
        self.parent = np.array([place[parent[v]] if parent[v] >= 0 else -1 for v in by])
        level = np.array([depth[v] for v in by])
        self.levels = np.searchsorted(level, np.arange(level[-1] + 2))
        self.deep = np.array([hi[v] for v in by])
        self.tokens = np.concatenate([self.sets[spell[v]][lo[v] : hi[v]] for v in by])
        self.at = np.cumsum([0, *[hi[v] - lo[v] for v in by]])
        self.final = self.tokens[self.at[1:] - 1]
        self.terminal = np.array([place[t] for t in terminal])
        self.size = np.array([len(s) for s in self.sets])
        self.longest, self.shortest = np.zeros(n, np.int64), np.full(n, 1 << 60)
        np.maximum.at(self.longest, self.terminal, self.size)
        np.minimum.at(self.shortest, self.terminal, self.size)
        for k in range(len(self.levels) - 2, 0, -1):
            own = slice(self.levels[k], self.levels[k + 1])
            np.maximum.at(self.longest, self.parent[own], self.longest[own])
            np.minimum.at(self.shortest, self.parent[own], self.shortest[own])

    def overlaps(self, pivots: list[int]) -> np.ndarray:
        """Size of each set's intersection with each pivot (a row for each); -1 where their Jaccard is
        below a half. One walk of the tree serves all pivots."""
        n_p = len(pivots)
        mark = np.zeros((self.n_values, n_p), np.uint8)
        left = np.empty((len(self.final), n_p), np.int32)  # of a pivot beyond each node
        for k, p in enumerate(pivots):
            mark[self.sets[p], k] = 1
            left[:, k] = len(self.sets[p]) - np.searchsorted(self.sets[p], self.final, side="right")
        size = self.size[pivots].astype(np.int32)
        overlap = np.full((len(self.parent), n_p), -1, np.int32)
        for k in range(len(self.levels) - 1):
            nodes = np.arange(self.levels[k], self.levels[k + 1])
            above = overlap[self.parent[nodes]] if k else np.zeros((len(nodes), n_p), np.int32)
            live = (above >= 0).any(axis=1)
            nodes, above = nodes[live], above[live]
            if not len(nodes):
                break
            got, n = above.copy(), self.at[nodes + 1] - self.at[nodes]
            for lo, hi in slices(n, WALK_CELLS // max(n_p, 16)):  # a node's tokens are distinct: no more cells than mark has
                first = np.cumsum(n[lo:hi]) - n[lo:hi]
                tokens = self.tokens[np.repeat(self.at[nodes[lo:hi]] - first, n[lo:hi]) + np.arange(n[lo:hi].sum())]
                got[lo:hi] += np.add.reduceat(mark[tokens], first, axis=0, dtype=np.int32)
            best = got + np.minimum(left[nodes], np.maximum(self.longest[nodes] - self.deep[nodes], 0)[:, None])
            union = size + np.maximum(self.shortest[nodes][:, None], best) - best
            overlap[nodes] = np.where((above >= 0) & (2 * best >= union), got, -1)
        return overlap[self.terminal].T


def block_links(sets: list[np.ndarray], labels: list[int] | None = None, pivots: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (pivot, member) that connect exactly what the links of a block connect. labels: sets with
    the same one are known to be connected; the search ends when all that are left are. pivots: only
    these are held against the others."""
    label = np.arange(len(sets)) if labels is None else np.array(labels)
    if len(np.unique(label)) < 2:
        return []
    tree, out = PrefixTree(sets), []
    active, queue = np.arange(len(sets)), list(pivots) if pivots is not None else None
    ahead: dict[int, np.ndarray] = {}
    together, limit = 1, max(1, WALK_CELLS // tree.n_values)
    while queue != [] and len(np.unique(label[active])) > 1:
        if queue is not None and len(queue) and (label == label[queue[0]]).all():
            break
        p = int(active[0]) if queue is None else queue[0]
        if p not in ahead:
            batch = (active.tolist() if queue is None else queue)[:together]
            ahead = dict(zip(batch, tree.overlaps(batch), strict=True))
            together = min(4 * together, limit)
        inter = ahead[p][active]
        union = len(sets[p]) + tree.size[active] - inter
        far = inter < 0
        linked = ~far & (100 * inter >= NUMERATOR * union)
        for x in active[linked & (label[active] != label[p])]:
            if label[x] != label[p]:
                out.append((p, int(x)))
                label[label == label[x]] = label[p]
        if queue is not None:
            queue.pop(0)
            continue
        distance = np.where(far, 0.5, 1 - inter / union)  # of the pruned ones at least a half
        nearest = distance[~linked].min() if (~linked).any() else np.inf
        done = linked & (distance < nearest - (1 - NUMERATOR / 100) - 1e-9)
        done[0] = True
        active = active[~done]
    return out


def _linked_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, part, chunk, cid, label, pivot, hashes) sorted by the first three -> edges; a chunk ends
    where the next begins. If it has pivots, only these are held against the rest."""
    held: dict[int, tuple[int, bool, np.ndarray]] = {}
    now = None

    def edges() -> pa.RecordBatch:
        ids = sorted(held)
        only = [k for k, i in enumerate(ids) if held[i][1]]
        pairs = block_links([held[i][2] for i in ids], [held[i][0] for i in ids], only or None)
        return pa.record_batch({"u": pa.array([ids[a] for a, _ in pairs], pa.int64()), "v": pa.array([ids[b] for _, b in pairs], pa.int64())})

    for b in batches:
        for block, part, chunk, cid, label, pivot, s in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("block", "part", "chunk", "cid", "label", "pivot", "hashes")), strict=True):
            if (block, part, chunk) != now:
                if len(held) > 1:
                    yield edges()
                held, now = {}, (block, part, chunk)
            held[cid] = label, pivot or (cid in held and held[cid][1]), np.frombuffer(s, np.uint64)
    if len(held) > 1:
        yield edges()


def _search(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges of rows (block, part, chunk, cid, label, pivot)."""
    key = ["block", "part", "chunk"]
    placed = rows.join(sets, "cid").select(*key, "cid", "label", "pivot", "hashes").repartition(*key).sortWithinPartitions(*key, "cid")
    return placed.mapInArrow(_linked_blocks, "u long, v long")


def _relabelled(edges: DataFrame, work: Scratch, name: str, n: int) -> DataFrame:
    """cid, label: of each node of an edge (n at most) the smallest node within a few steps. Nodes with the same
    label are connected; connected ones may still differ."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = work.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-near", n)
    second = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
    second = work.save(second, f"{name}-second", n)
    jump = second.join(near.select(F.col("u").alias("m"), F.col("m").alias("m2")), "m", "left")
    return work.save(jump.select(F.col("u").alias("cid"), F.least("u", "m", "m2").alias("label")), f"{name}-labels", n)


def _dealt(n: Column, hashes: Column, most: int, salt: int) -> tuple[Column, Column]:
    """Number of parts of at most about `most` rows and CHUNK_HASHES hashes, but two rows, and a row's part."""
    parts = F.least(F.ceil(n / 2), F.ceil(F.greatest(n / F.lit(most), hashes / F.lit(CHUNK_HASHES)))).cast("int")
    return parts, F.pmod(F.xxhash64("cid", F.lit(salt)), parts).cast("int")


def _links(rows: DataFrame, sets: DataFrame, work: Scratch, phase: str, n_rows: int, most: int, pivot_rounds: int) -> DataFrame:
    """Edges (u, v) that connect what links within the blocks of rows (block, cid, size, label, guest; n_rows
    at most) connect, but for what the labels connect already. Rows that aren't guests were held against each
    other before, so without guests a block has nothing to find."""
    sizes = work.save(rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if("guest").alias("g"), F.sum("size").alias("h")).where("n > 1 AND g > 0"), f"{phase}-sizes", n_rows)
    rows = rows.join(sizes, "block")
    chunks, chunk = _dealt(F.col("n"), F.col("h"), most, 9)
    rows = work.save(rows.select("block", F.lit(0).alias("part"), chunk.alias("chunk"), "cid", "size", "label", "guest", (F.col("g") == F.col("n")).alias("fresh"), chunks.alias("chunks")), f"{phase}-rows", n_rows)
    edges = work.save(_search(rows.where("chunks = 1 OR fresh").withColumn("pivot", F.col("guest") & ~F.col("fresh")), sets), f"{phase}-edges")
    large = rows.where("chunks > 1").select("block", "cid", "size", "label", "guest")
    for k in range(pivot_rounds + 1):
        if large.isEmpty():
            break
        known = _relabelled(edges.unionByName(rows.where("cid <> label").select(F.col("cid").alias("u"), F.col("label").alias("v"))), work, f"{phase}-{k}", n_rows)
        now = work.save(large.drop("label").join(known, "cid", "left").select("block", "cid", "size", F.coalesce("label", "cid").alias("label"), "guest"), f"{phase}-{k}-large", n_rows)
        guests = F.sum(F.when(F.col("guest"), F.col("size")).otherwise(0))
        counts = now.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("guest").alias("g"), F.sum("size").alias("h"), guests.alias("gh"))
        largest = F.max(F.struct("n", "label", "h"))
        mains = counts.groupBy("block").agg(largest.alias("most"), *(F.sum(c).alias(c) for c in ("n", "g", "h", "gh")), F.count(F.lit(1)).alias("labels"))
        # guests against all, or all that aren't of the main label against all, whichever are fewer
        by_guest = F.col("g") < F.col("n") - F.col("most.n")
        against = F.when(by_guest, F.struct(F.col("g").alias("p"), F.col("gh").alias("ph"))).otherwise(F.struct((F.col("n") - F.col("most.n")).alias("p"), (F.col("h") - F.col("most.h")).alias("ph")))
        mains = work.save(mains.where("labels > 1").select("block", F.col("most.label").alias("main"), "n", "h", by_guest.alias("by_guest"), against["p"].alias("p"), against["ph"].alias("ph")), f"{phase}-{k}-mains", n_rows)
        large = work.save(now.join(mains, "block"), f"{phase}-{k}-left", n_rows)
        others = large.where(F.when(F.col("by_guest"), F.col("guest")).otherwise(F.col("label") != F.col("main")))
        chunks, chunk = _dealt(F.col("n"), F.col("h"), SPREAD_SETS, 9)
        if k < pivot_rounds:
            parts, part = F.lit(1), F.lit(0)
            pivots = F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(F.lit(CHUNK_HASHES) * F.col("n") / F.col("h")))).cast("int")
            others = others.groupBy("block", F.pmod(F.xxhash64("cid", F.lit(k)), pivots).alias("salt")).agg(F.min("cid").alias("cid"), F.min_by("label", "cid").alias("label"), F.first("n").alias("n"), F.first("h").alias("h"))
        else:
            parts, part = _dealt(F.col("p"), F.col("ph"), SPREAD_SETS, 10)
        numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        members = large.select("block", numbers(parts).alias("part"), chunk.alias("chunk"), "cid", "label", F.lit(False).alias("pivot"))
        spread = others.select("block", part.alias("part"), numbers(chunks).alias("chunk"), "cid", "label", F.lit(True).alias("pivot"))
        edges = edges.unionByName(work.save(_search(members.unionByName(spread), sets), f"{phase}-{k}-edges"))
        large = large.select("block", "cid", "size", "label", "guest")
    return edges


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_sets: int = BLOCK_SETS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included; null
    where all of them are)."""
    work = Scratch(docs.sparkSession, "shingles")
    rows, classes = _components(located(docs, work), id_col, text_col, block_sets, work)
    linked = join_groups(rows.where("digest is not null").select("doc_id", "n_shingles", "digest"), classes, "digest", "n_rows")
    alone = rows.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.select("doc_id", "n_shingles", F.col("first.id").alias("component_id")).unionByName(alone)


def _components(docs: DataFrame, id_col: str, text_col: str, block_sets: int, work: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, FILE, AT, n_shingles, digest; null without shingles), and classes (digest, n_rows,
    first: id and place of the first row of the class's component, null ids last)."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), FILE, AT, F.col(text_col).alias("text"))
    rows = work.save(read.mapInArrow(_sketches, f"doc_id long, {FILE} long, {AT} long, n_shingles long, digest binary, sketch array<long>"), "sketches")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), FILE, AT)
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min(first).alias("first"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("n_rows"))
    classes = work.save(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")

    hashes = classes.select("cid", F.explode("sketch").alias("t"))
    shared = work.save(hashes.groupBy("t").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    lists = hashes.join(shared, "t").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("l"))  # SKETCH at most
    need = F.when(F.col("n") <= SMALL, F.ceil(F.col("n") * NUMERATOR / 100)).otherwise(NEEDED).cast("int")
    lists = lists.where(F.size("l") >= 1).join(classes.select("cid", need.alias("need"), F.col("n").alias("size")), "cid").where("size(l) >= need")
    prefix = work.save(lists.select("cid", "size", F.explode(F.slice("l", F.lit(1), F.expr("size(l) - need + 1"))).alias("x")).select("cid", "size", F.col("x.t").alias("t")), "prefix")
    work.drop("shared")
    owners = work.save(prefix.groupBy("t").agg(F.min("cid").alias("block"), F.count(F.lit(1)).alias("c")).where("c > 1").select("t", "block"), "owners")
    blocks = work.save(prefix.join(owners, "t").select("block", "cid", "size").distinct(), "blocks")
    sizes = work.save(blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("block"), "sizes")
    blocks = work.save(blocks.join(sizes, "block"), "several")
    work.drop("prefix", "owners", "blocks", "sizes")
    n = blocks.count()  # no table of what stands in blocks has more rows

    wanted = blocks.select("cid").distinct().join(classes.select("cid", "first"), "cid").select("cid", F.col("first")[FILE].alias(FILE), F.col("first")[AT].alias(AT))
    lookup = Lookup(wanted, work, "wanted")
    sets = work.save(lookup.scanned(read.select(FILE, AT, "text")).mapInArrow(_whole_sets(lookup), "cid long, hashes binary"), "sets")

    rows1 = blocks.groupBy("cid").agg(F.min("block").alias("block"), F.first("size").alias("size")).select("block", "cid", "size", F.col("cid").alias("label"), F.lit(True).alias("guest"))
    first = _links(rows1, sets, work, "first", n, block_sets, 1)
    labels = work.save(connected_components(first, work).select(F.col("node").alias("cid"), F.col("component").alias("label")), "labels", n)
    least = rows1.select("cid", F.col("block").alias("least"))
    told = work.save(blocks.join(least, "cid").join(labels, "cid", "left").select("block", "cid", "size", F.coalesce("label", "cid").alias("label"), (F.col("block") != F.col("least")).alias("guest")), "told", n)
    mixed = work.save(told.groupBy("block").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("block"), "mixed", n)
    second = _links(told.join(mixed, "block"), sets, work, "second", n, block_sets, 0)
    edges = work.save(labels.select(F.col("cid").alias("u"), F.col("label").alias("v")).unionByName(second), "edges", n)
    comps = work.save(connected_components(edges, work), "components", n)
    named = comps.join(classes.select(F.col("cid").alias("node"), "first"), "node")
    firsts = work.save(named.groupBy("component").agg(F.min("first").alias("of_component"), F.count(F.lit(1)).alias("n")), "firsts", n)
    of_class = work.save(join_groups(comps, firsts, "component", "n").select(F.col("node").alias("cid"), "of_component"), "of-class", n)
    classes = classes.select("cid", "digest", "n_rows", "first").join(of_class, "cid", "left")
    return rows, work.save(classes.select("digest", "n_rows", F.coalesce("of_component", "first").alias("first")), "named")


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: one with the smallest id, a null one only where all are null.
    Texts without words stay. Every column as it was; no text is shuffled."""
    work = Scratch(docs.sparkSession, "near")
    places = located(docs, work)
    rows, classes = _components(places, id_col, text_col, BLOCK_SETS, work)
    found = join_groups(rows.where("digest is not null").select("digest", FILE, AT), classes, "digest", "n_rows")
    return without(places, found.where((F.col(FILE) != F.col("first")[FILE]) | (F.col(AT) != F.col("first")[AT])), work)


# The components by brute force in SQL; for small tables only.
ORACLE_SMALL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_distinct([w[i : i + 4] for i in range(1, len(w) - 3)]) END AS s FROM w),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM i JOIN s p ON p.doc_id = u JOIN s q ON q.doc_id = v WHERE 100 * c >= 75 * (len(p.s) + len(q.s) - c)),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.u, r.c FROM r JOIN l ON l.v = r.doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, m.c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) m USING (doc_id)"""
