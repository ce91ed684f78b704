"""SimHash near-duplicates, searched with BK-trees.

Each document gets a 64-bit fingerprint: the majority bit of the XXH64 hashes of
its word shingles, repeats included (in ``similar_documents``, each once).  Fingerprints at Hamming distance
``radius`` or less are linked, and documents are grouped by reachability.

Different fingerprints are cut into ``radius + 2`` bit blocks.  Two within the
radius agree on two of them at least, so every pair of blocks is a sharding key
and the links are found inside shards.  A shard's BK-tree keys each child by its
integer distance to the parent, and a probe follows only edges within the radius
of its own distance.  Shards over ``shard_rows`` fingerprints are split; each of
their trees (of bounded size) is then sent to every probe block of the same key -
to those alone, as all trees together grow with the corpus and may not be broadcast.
A shard emits the links of a spanning forest only, so a group never becomes all
its pairs, and no link between different fingerprints is lost.

A document without words has fingerprint zero, linked like any other; null texts
are empty.  Copies share one fingerprint and never meet in a task.  Rows with a
null id get a component id like all others (the smallest id reachable, null if
none has one).  An empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import materialize, table, text_or_empty
from quillspark.llm.components import connected_components

SEED = 42
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 15
#: Probes that walk a forest together.
PROBES = 1 << 9
#: Shard members that are handled together in memory.
MEMBERS = 1 << 14
#: Bytes kept of a shingle's hash for the exact comparison, and bytes of such sets in a part of a shard, and in memory together.
WIDTH, SHARD_BYTES, SET_BYTES = 6, 1 << 23, 1 << 24
#: Standard deviations by which the estimate of a pair may fall below the similarity before the pair is not compared.
DOUBT = 4
#: Slots of a signature, the value of an empty one, and multipliers of the min-hashes that key shards.
SLOTS, EMPTY = 128, np.uint16(0xFFFF)
ODDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of every word shingle of a UTF-8 text, repeats included; one of the empty text without words."""
    found = text.lower().split()  # on bytes: A-Z only, and exactly [\x20\x09-\x0D]
    shingles = [b" ".join(found)] if len(found) < words else map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=">u8")


def majority(hashes: np.ndarray) -> int:
    """Majority bits of big-endian hashes, as an unsigned integer."""
    rows = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), CHUNK):
        ones += np.unpackbits(rows[at : at + CHUNK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprint(text: bytes, words: int = 3) -> int:
    """Majority fingerprint of a UTF-8 text, as an unsigned integer."""
    return majority(shingle_hashes(text, words)) if text.strip() else 0


def fingerprint_column(text: Column, words: int = 3) -> Column:
    @F.arrow_udf(T.LongType())
    def prints(texts: pa.Array) -> pa.Array:
        values = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts]
        return pa.array(np.array(values, dtype=np.uint64).view(np.int64))

    return prints(text)


class BKForest:
    """BK-trees over the distinct values of each group, built and probed level by level."""

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.values = values
        n = len(values)
        order = np.argsort(groups, kind="stable")
        first = np.concatenate([[True], groups[order][1:] != groups[order][:-1]]) if n else np.zeros(0, bool)
        roots = order[first]
        self.root = np.zeros(n, dtype=np.int64)
        if n:
            self.root[order] = np.repeat(roots, np.diff(np.concatenate([np.flatnonzero(first), [n]])))
        waiting = order[~first]
        at = self.root[waiting]
        keys, kids = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        while len(waiting):
            edge = at * 65 + np.bitwise_count(values[waiting] ^ values[at])
            new, pick, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(new)
            kids.append(waiting[pick])
            at = waiting[pick][back]
            rest = at != waiting
            waiting, at = waiting[rest], at[rest]
        key = np.concatenate(keys)
        by = np.argsort(key)
        self.key, self.kid = key[by], np.concatenate(kids)[by]

    def probe(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) within the radius, each query starting at its root."""
        hits_q, hits_n = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for start in range(0, len(queries), PROBES):
            q = np.arange(start, min(start + PROBES, len(queries)))
            node = roots[q]
            while len(q):
                apart = np.bitwise_count(queries[q] ^ self.values[node]).astype(np.int64)
                near = apart <= radius
                hits_q.append(q[near])
                hits_n.append(node[near])
                low = np.searchsorted(self.key, node * 65 + np.maximum(apart - radius, 0))
                kids = np.searchsorted(self.key, node * 65 + np.minimum(apart + radius, 64), side="right") - low
                q = np.repeat(q, kids)
                node = self.kid[np.repeat(low - np.cumsum(kids) + kids, kids) + np.arange(len(q))]
        return np.concatenate(hits_q), np.concatenate(hits_n)


def spanning_links(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable place of every place: roots found so far, joined by links a-b."""
    a, b = low[a], low[b]  # links between the trees there are
    while len(a):
        old = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (old == low).all():
            break
    return low[low]


def _flat(rows: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Sizes of the lists (null: 0), and their members end to end."""
    sizes = np.array([len(r) if r.is_valid else 0 for r in rows], dtype=np.int64)
    return sizes, rows.flatten()


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``MEMBERS`` members, or ``SET_BYTES`` of sets, each."""
    weight = np.zeros(len(batch))
    for column in ("tree", "other"):
        sizes, members = _flat(batch.column(column))
        held = pc.fill_null(pc.binary_length(members.field(3)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        total = np.concatenate([[0.0], np.cumsum(held / SET_BYTES + 1 / MEMBERS)])
        weight += total[ends] - total[ends - sizes]
    number = (np.cumsum(weight) - weight).astype(np.int64)
    starts = np.flatnonzero(np.diff(number, prepend=-1)).tolist()
    for start, end in zip(starts, [*starts[1:], len(number)], strict=True):
        yield batch.slice(start, end - start)


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int, similarity: float | None) -> Iterator[pa.RecordBatch]:
    """For rows of (tree members, probe members or null): links of a spanning forest of each row.

    Members are ``(node, fp, sig, set)``; with ``similarity``, a link also needs
    sets of at least that Jaccard similarity.
    """
    for batch in (part for whole in batches for part in _portions(whole)):
        (size, tree), (extra, other) = _flat(batch.column("tree")), _flat(batch.column("other"))
        both = [pa.concat_arrays([tree.field(i), other.field(i)]) for i in range(4)]
        nodes, prints = both[0].to_numpy(), both[1].to_numpy().view(np.uint64)
        rows = np.arange(len(size))
        groups = np.repeat(rows, size)
        forest = BKForest(prints[: len(tree)], groups)
        top = np.full(len(size), -1, dtype=np.int64)
        top[groups] = forest.root
        own = np.flatnonzero((extra == 0)[groups])  # a shard probed with its own members
        probes = np.concatenate([own, np.arange(len(tree), len(prints))])
        sigs = None if similarity is None else np.frombuffer(b"".join(both[2].to_pylist()), dtype=np.uint16).reshape(len(nodes), -1)
        low = np.arange(len(nodes))
        for start in range(0, len(probes), PROBES):
            part = probes[start : start + PROBES]
            q, b = forest.probe(prints[part], np.where(part < len(tree), forest.root[np.minimum(part, len(tree) - 1)], top[_row_of(part, len(tree), rows, extra)]), radius)
            a = part[q]
            new = low[a] != low[b]  # the others are connected already
            a, b = a[new], b[new]
            low = spanning_links(low, a, b) if sigs is None else _similar_links(low, a, b, sigs, both[3], similarity)
        moved = np.flatnonzero(low != np.arange(len(low)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[low[moved]])], ["u", "v"])


def _row_of(places: np.ndarray, trees: int, rows: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """Row that a probe member belongs to (0 for tree members, whose row is known already)."""
    owner = np.repeat(rows, extra)
    return owner[places - trees] if len(owner) and (places >= trees).all() else np.array([owner[p - trees] if p >= trees else 0 for p in places.tolist()], dtype=np.int64)


def _similar_links(low: np.ndarray, a: np.ndarray, b: np.ndarray, sigs: np.ndarray, sets: pa.Array, similarity: float) -> np.ndarray:
    """``spanning_links`` by those of the pairs a-b whose sets are that similar; pairs that are connected by then are not compared."""
    below = b < a  # shards probed with their own members meet every pair twice
    a, b, share = _plausible(sigs, a[below], b[below], similarity)
    by = np.lexsort((-share, a))
    a, b, take = a[by], b[by], 1
    while len(a):
        first = np.flatnonzero(np.diff(a, prepend=-1))
        now = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a)))) < take  # each probe's likeliest
        same = np.array([_is_similar(_read_set(sets, i), _read_set(sets, j), similarity) for i, j in zip(a[now].tolist(), b[now].tolist(), strict=True)], dtype=bool)
        low = spanning_links(low, a[now][same], b[now][same])
        left = ~now & (low[a] != low[b])
        a, b, take = a[left], b[left], 2 * take
    return low


def _plausible(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose estimated similarity is not too far below, with the estimate."""
    share, keep = np.zeros(len(a)), np.zeros(len(a), dtype=bool)
    for at in range(0, len(a), CHUNK):
        x, y = sigs[a[at : at + CHUNK]], sigs[b[at : at + CHUNK]]
        filled = ((x != EMPTY) | (y != EMPTY)).sum(axis=1)
        agree = ((x == y) & (x != EMPTY)).sum(axis=1)
        share[at : at + CHUNK] = agree / filled
        keep[at : at + CHUNK] = agree >= similarity * filled - DOUBT * np.sqrt(similarity * (1 - similarity) * filled)
    return a[keep], b[keep], share[keep]


def _read_set(sets: pa.Array, i: int) -> np.ndarray:
    rows = np.frombuffer(sets[i].as_buffer(), dtype=np.uint8).reshape(-1, WIDTH)
    return np.pad(rows, ((0, 0), (0, 8 - WIDTH))).view("<u8").ravel()


def _is_similar(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def _blocks(radius: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, 64, radius + 3).round().astype(int).tolist()
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def sharded_links(keyed: DataFrame, radius: int, shard_rows: int, similarity: float | None = None, sets_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links ``(u, v)`` between the nodes of ``keyed(t, key, node, fp, sig, size, row)`` that share a shard ``(t, key)``.

    ``size`` is the length of a node's set; ``sets_of`` gives ``(node, set)`` for ``(node, row)``.
    """
    cuts = F.ceil(F.greatest(F.count("*") / shard_rows, F.sum("size") * WIDTH / SHARD_BYTES)).cast("int")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("count"), cuts.alias("cuts")).where("count > 1").drop("count")
    dealt = keyed.join(sizes, ["t", "key"]).withColumn("cut", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    if sets_of is None:
        dealt = dealt.withColumn("set", F.lit(None).cast("binary"))
    else:
        dealt = materialize(dealt, "dealt")
        dealt = dealt.join(sets_of(dealt.select("node", "row").distinct()), "node")
    shards = materialize(dealt.groupBy("t", "key", "cuts", "cut").agg(F.collect_list(F.struct("node", "fp", "sig", "set")).alias("tree")), "shards")
    work = shards.select("tree", F.lit(None).cast(shards.schema["tree"].dataType).alias("other"))
    # Around a circle, each part of a split shard meets the next half of the parts: every two once, and as many for each part.
    step = F.explode(F.sequence(F.lit(1), F.floor(F.col("cuts") / 2).cast("int")))
    split = shards.where("cuts > 1")
    near = split.select("t", "key", "cuts", "cut", "tree", step.alias("step")).where("2 * step < cuts or cut < step").withColumn("met", F.expr("(cut + step) % cuts"))
    far = split.select("t", "key", F.col("cut").cast("int").alias("met"), F.col("tree").alias("other"))
    work = work.unionByName(near.join(far, ["t", "key", "met"]).select("tree", "other"))
    return work.mapInArrow(lambda it: _shard_links(it, radius, similarity), "u bigint, v bigint").distinct()


def fingerprint_links(prints: DataFrame, radius: int = 2, shard_rows: int = 2048) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the different ``fp`` values within ``radius`` of each other, transitively."""
    masks = []
    for picked in combinations(_blocks(radius), 2):
        mask = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in picked)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    shares = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)))
    keyed = prints.select("fp", F.explode(shares).alias("s")).select("s.t", "s.key", F.col("fp").alias("node"), "fp", F.lit(None).cast("binary").alias("sig"), F.lit(0).alias("size"))
    return sharded_links(keyed, radius, shard_rows)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, shard_rows: int = 2048) -> DataFrame:
    """One row per input row: ``id_col``, ``fp`` (signed 64-bit) and ``component_id``."""
    rows = materialize(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_or_empty(text_col), words).alias("fp")), "fingerprints")
    firsts = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = materialize(connected_components(fingerprint_links(firsts.select("fp"), radius, shard_rows)), "roots").select(F.col("node").alias("fp"), "root")
    named = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    classes = _classes(named, "fp")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _classes(named: DataFrame, node: str) -> DataFrame:
    """``(node, root, component_id)`` of ``named(node, root, first)``, the smallest ``first`` of each root.

    Both steps are written out, so that the joins have shuffles of their own,
    which adaptive execution may split where a group or a node is hot.
    """
    lowest = materialize(named.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")
    return materialize(named.join(lowest, "root").select(node, "root", "component_id"), "classes")


def sketch(text: bytes, words: int) -> tuple[int, bytes, list[int], int, int]:
    """Of the set of a text's word shingles: fingerprint, signature (one-permutation min-hash), shard keys (min-hashes), hash and size."""
    hashes = np.unique(shingle_hashes(text, words).astype(np.uint64))
    sig = np.full(SLOTS, EMPTY, dtype=np.uint16)
    np.minimum.at(sig, (hashes >> np.uint64(57)).astype(np.int64), np.minimum((hashes >> np.uint64(16)).astype(np.uint16), EMPTY - 1))
    keys = [int((hashes * np.uint64(odd)).min()) - (1 << 63) for odd in ODDS]
    whole = xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)
    return majority(hashes.astype(">u8")) if text.strip() else 0, sig.tobytes(), keys, whole, len(hashes)


def shingle_set(text: bytes, words: int) -> bytes:
    """The set of a text's word shingles, sorted, by ``WIDTH`` bytes of each hash."""
    hashes = np.unique(shingle_hashes(text, words).astype(np.uint64) & np.uint64((1 << 8 * WIDTH) - 1))
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def row_hash(id_col: str, text_col: str) -> Column:
    """A row by its id and text; null texts are empty."""
    return F.xxhash64(F.col(id_col), text_or_empty(text_col))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, radius: int = 22, shard_rows: int = 2048) -> DataFrame:
    """Like ``near_duplicates``, for shingle similarity rather than a few bits: ``id_col, fp, component_id, row, root``.

    ``row`` is the ``row_hash`` of id and text, ``root`` tells groups apart.

    A Jaccard similarity of 0.8 leaves fingerprints 10 bits apart on average, too
    far for shards by equal bit blocks.  Shards are keyed by four min-hashes here
    (documents that similar share one with probability 0.998) and their BK-trees
    are probed with a radius over four standard deviations wider.  Signatures
    only tell which pairs are worth a comparison; a link needs sets of shingles
    that are that similar.  Documents with the same set are one node.
    """
    kinds = {"fp": T.LongType(), "sig": T.BinaryType(), "keys": T.ArrayType(T.LongType()), "node": T.LongType(), "size": T.IntegerType()}

    @F.arrow_udf(T.StructType([T.StructField(n, k) for n, k in kinds.items()]))
    def sketches(texts: pa.Array) -> pa.Array:
        rows = [sketch(t.as_buffer().to_pybytes() if t.is_valid else b"", words) for t in texts]
        prints = np.array([r[0] for r in rows], dtype=np.uint64).view(np.int64)
        rest = [pa.array([r[i] for r in rows], k) for i, k in ((1, pa.binary()), (2, pa.list_(pa.int64())), (3, pa.int64()), (4, pa.int32()))]
        return pa.StructArray.from_arrays([pa.array(prints), *rest], list(kinds))

    @F.arrow_udf(T.BinaryType())
    def sets(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_set(t.as_buffer().to_pybytes(), words) for t in texts], pa.binary())

    named_row = row_hash(id_col, text_col).alias("row")

    def sets_of(wanted: DataFrame) -> DataFrame:
        found = docs.select(named_row, text_or_empty(text_col).alias("text")).join(wanted, "row").select("node", sets("text").alias("set"))
        return found.dropDuplicates(["node"])  # rows alike in id and text; the join by node needs this shuffle anyhow

    rows = materialize(docs.select(F.col(id_col).alias("id"), named_row, sketches(text_or_empty(text_col)).alias("s")).select("id", "row", "s.*"), "sketches")
    nodes = rows.groupBy("node").agg(F.min(F.struct("fp", "sig", "keys", "size", "row")).alias("s")).select("node", "s.*")
    keyed = nodes.select("node", "fp", "sig", "size", "row", F.posexplode("keys").alias("t", "key"))
    roots = materialize(connected_components(sharded_links(keyed, radius, shard_rows, similarity, sets_of)), "roots")
    firsts = rows.groupBy("node").agg(F.min("id").alias("first"))
    classes = _classes(firsts.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "node")
    return rows.join(classes, "node").select(F.col("id").alias(id_col), "fp", "component_id", "row", "root")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
