"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full shingle sets, connected groups.

A document's set is its distinct 5-word shingles, A to Z lower-cased; with fewer words, the whole sequence as one; without words it
is empty and links with nothing. Documents are linked if 100 * intersection >= 75 * union, and a group is all that links reach.

1. Signatures. Each shingle draws a random permutation of the m slots, level by level; its value in the slot of level j is j plus a
   fraction. A slot keeps the least value. As values of level j are at least j, a text stops at the first level after which every slot
   is filled (early stopping), two or three levels for a text of usual length.
2. Texts with one set (128-bit set digest and size) are one node from here on, the smallest id of them.
3. Banding. `bands` buckets of `rows` slots a node. A pair at the threshold 0.75 shares no bucket with
   probability (1 - 0.75 ** rows) ** bands, about 1e-8 for the defaults.
4. Candidates and verification without all pairs of a bucket. In a round, each bucket that still holds nodes of more than one group names
   a leader, and the nodes of other groups are compared with it, on full sets. Copies of one text so become one group after a number
   of comparisons in proportion to their number. Buckets that hold more than one group after the rounds get all their pairs from
   different groups compared where they stand, in blocks of bounded size: on 32-bit hashes of the full sets, which can only take a pair for too similar,
   but for pairs whose signatures agree in so few slots that a pair at the threshold would have to be six standard deviations off. A pair is taken in the
   first bucket that it shares, and what is left is verified like all others. So no bucket is cut or dropped, and pairs that aren't links are no rows.
5. Groups are found by union-find over the links, as rounds over tables in shared storage: each node takes the least label among its neighbours' (union),
   then the label of its label (find, by pointer jumping), until no label changes.

Scale: what a large share of the rows may have in common (a bucket's key, a leader, a group, a set of many copies) is dealt to parts wherever rows are joined by it
(shared.join_hot).

Rows with a null doc_id take no part: component_id is null and they are kept. Rows that repeat a doc_id are one node; each row
gets the group of its text. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillflow.llm import chunks, words
from quillflow.llm.shared import bounded_batches, drop_path, each_salt, join_hot, only, salt, salts, written

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 48, 4
LEADER_ROUNDS, BLOCK_NODES = 3, 1000
#: Levels for which an element's permutation is followed back through its swaps; beyond, it is held as a row of slots.
TRACED = 6


def shingle_hashes(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, joined, sorted within a text; and their numbers."""
    w = words.split_words(texts)
    h = words.hash_strings(w.names)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    n, starts = w.counts, np.cumsum(w.counts) - w.counts
    per_text = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(n)), per_text)
    first = np.arange(per_text.sum()) - np.repeat(np.cumsum(per_text) - per_text, per_text) + np.repeat(starts, per_text)
    length = np.minimum(n, size)[owner]
    value = np.zeros(len(first), np.uint64)
    for k in range(size):
        there = length > k
        at = first[there] + k
        value[there] = (value[there] ^ h[at]) * np.uint64(0x9FB21C651E98DF25) + np.uint64(k + 1)
    value = words.mix(value)
    order = np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=len(n)).astype(np.int64)


def signatures(hashes: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """A row of m slots for each set; the values are level << 24 | fraction. m is 256 at most."""
    sig = np.full((len(counts), m), 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(len(counts)), counts)
    live, h, swaps, slots = owner, hashes, [], None
    for j in range(m):
        if not len(h):
            break
        z = words.mix(h + np.uint64((j * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF))
        k = (j + (((z & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.int16)
        if slots is None:
            at = k.copy()
            for t in range(j - 1, -1, -1):
                at[at == swaps[t]] = t
            swaps.append(k)
        else:
            rows = np.arange(len(h))
            at = slots[rows, k].astype(np.int16)
            slots[rows, k] = slots[:, j]
        value = (np.uint32(j) << np.uint32(24)) | (z >> np.uint64(40)).astype(np.uint32)
        flat = live * m + at
        np.minimum.at(sig.reshape(-1), flat, value)
        full = sig.max(axis=1) < np.uint32(min(j + 1, 255)) << np.uint32(24)
        on = ~full[live]
        live, h, swaps = live[on], h[on], [s[on] for s in swaps]
        if slots is not None:
            slots = slots[on]
        elif j + 1 == TRACED and len(h):
            slots, rows = np.tile(np.arange(m, dtype=np.uint8), (len(h), 1)), np.arange(len(h))
            for t, s in enumerate(swaps):
                slots[:, t], slots[rows, s] = slots[rows, s], slots[:, t].copy()
            swaps = []
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    key = np.broadcast_to(words.mix(np.arange(bands, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        key = words.mix(key ^ sig[:, r : bands * rows : rows].astype(np.uint64))
    return key.view(np.int64)


def _sketch(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in chunks.blocks(batches, "text", 6 << 20):
            hashes, counts = shingle_hashes(block.column("text").combine_chunks())
            some = counts > 0
            sig = signatures(hashes, counts, bands * rows)
            keys = band_keys(sig, bands, rows)[some]
            short = sig.astype(np.uint8)  # the low byte of each slot
            lists = pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum(some * bands)]).astype(np.int32), pa.array(keys.reshape(-1))
            )
            a = chunks.sums(words.mix(hashes), counts).view(np.int64)
            b = chunks.sums(words.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), counts).view(np.int64)
            ids = block.column("doc_id").combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            batch = pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(a), pa.array(b), lists, pa.array([x.tobytes() for x in short], pa.binary()), pa.array(block.column("version").to_numpy())], names=["doc_id", "n_shingles", "a", "b", "bands", "slots", "version"])
            yield from (batch.slice(k, 1000) for k in range(0, len(batch), 1000))

    return run


def _short_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set): the set as sorted 32-bit hashes."""
    for block in chunks.blocks(batches, "text", 6 << 20):
        hashes, counts = shingle_hashes(block.column("text").combine_chunks())
        short, ends = (hashes >> np.uint64(32)).astype(np.uint32), np.cumsum(counts)
        sets = [np.unique(short[e - c : e]).tobytes() for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.array(block.column("node").to_pylist(), pa.int64()), pa.array(sets, pa.binary())], names=["node", "set"])
        yield from (batch.slice(k, 1000) for k in range(0, len(batch), 1000))


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                both = pa.concat_arrays([part.column("left_text"), part.column("right_text")])
                coded = both.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False)
                hashes, counts = shingle_hashes(coded.dictionary)
                ends = np.cumsum(counts)
                sets = [hashes[e - c : e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                n = len(part)
                good = []
                for i in range(n):
                    x, y = sets[code[i]], sets[code[n + i]]
                    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                        good.append(False)
                        continue
                    common = int(np.isin(x, y, assume_unique=True).sum())
                    good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield pa.RecordBatch.from_arrays([part.column("x"), part.column("y")], names=["x", "y"]).filter(pa.array(good))

    return run


def _block_pairs(percent: int):
    """Pairs from different groups, of the two sides of one block of a bucket, that share no earlier bucket and are similar enough by their signatures
    and by 32-bit hashes of their sets."""

    def run(table: pa.Table) -> pa.Table:
        ids, comp, side = (table.column(c).to_numpy() for c in ("node", "comp", "side"))
        key = table.column("key")[0].as_py()
        keys = np.array(table.column("bands").to_pylist(), np.int64)
        slots = np.frombuffer(b"".join(table.column("slots").to_pylist()), np.uint8).reshape(len(ids), -1)
        sets = [np.frombuffer(x, np.uint32) for x in table.column("set").to_pylist()]
        sizes = np.array([len(x) for x in sets], np.int64)
        m, share = slots.shape[1], percent / 100
        least = m * share - 6 * (m * share * (1 - share)) ** 0.5
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == (1 if (side == 1).any() else 0))
        out: tuple[list, list] = ([], [])
        for i in left:
            hit = right[comp[right] != comp[i]]
            hit = hit[(slots[hit] == slots[i]).sum(axis=1) >= least]
            shared = keys[hit] == keys[i]
            hit = hit[keys[i][shared.argmax(axis=1)] == key]
            if len(hit):
                common = chunks.sums(np.isin(np.concatenate([sets[k] for k in hit]), sets[i]).astype(np.int64), sizes[hit])
                hit = hit[100 * common >= percent * (sizes[i] + sizes[hit] - common)]
            out[0].extend([int(ids[i])] * len(hit))
            out[1].extend(ids[hit].tolist())
        return pa.table({"x": pa.array(out[0], pa.int64()), "y": pa.array(out[1], pa.int64())})

    return run


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose full shingle sets are similar enough."""
    left = texts.select(F.col("node").alias("x"), F.col("text").alias("left_text"))
    right = texts.select(F.col("node").alias("y"), F.col("text").alias("right_text"))
    joined = join_hot(join_hot(pairs, left, "x", "y"), right, "y", "x", pairs).select("x", "y", "left_text", "right_text")
    return joined.mapInArrow(_confirm(percent), "x bigint, y bigint")


def groups(edges: DataFrame) -> tuple[DataFrame, str]:
    """(node, comp) of all nodes of the edges (x, y); comp is the least node that can be reached. In shared storage."""
    spark = edges.sparkSession
    both, both_path = written(edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    labels, path = written(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        heard = join_hot(both, labels.withColumnRenamed("node", "y"), "y", "x").groupBy("x").agg(F.min("comp").alias("heard"))
        better = labels.join(heard, F.col("node") == F.col("x")).select("node", F.col("comp").alias("old"), F.least("comp", "heard").alias("comp"))
        better, better_path = written(better, "heard")
        root = labels.select(F.col("node").alias("comp"), F.col("comp").alias("r_comp"))
        jumped = join_hot(better, root, "comp", "node").select("node", "old", F.least("comp", "r_comp").alias("comp"))
        table, next_path = written(jumped, "labels")
        drop_path(spark, better_path)
        drop_path(spark, path)
        labels, path = table.select("node", "comp"), next_path
        if table.where("old != comp").isEmpty():
            drop_path(spark, both_path)
            return labels, path


def text_version(text: Column | str) -> Column:
    """Tells the texts of rows with the same doc_id apart."""
    return F.xxhash64(text)


def near_duplicates(
    docs: DataFrame,
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = PERCENT,
    leader_rounds: int = LEADER_ROUNDS,
    block_nodes: int = BLOCK_NODES,
    versions: bool = False,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text); with versions, also version, text_version() of the row's text.

    Nodes are sets, numbered by a 64-bit hash of their digest, since rows of different texts may have the same doc_id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = only(docs, "doc_id", "text").withColumn("version", text_version("text"))
    schema = "doc_id bigint, n_shingles bigint, a bigint, b bigint, bands array<bigint>, slots binary, version bigint"
    sketches, _ = written(docs.mapInArrow(_sketch(bands, rows), schema), "sketches")
    known = sketches.where("doc_id IS NOT NULL AND n_shingles > 0")
    nodes = known.groupBy("a", "b", "n_shingles").agg(F.min(F.struct("doc_id", "version", "bands", "slots")).alias("m"))
    nodes, _ = written(nodes.select("a", "b", "n_shingles", F.xxhash64("a", "b", "n_shingles").alias("node"), "m.doc_id", "m.version", F.col("m.bands").alias("bands"), F.col("m.slots").alias("slots")), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("last"), salts("node").alias("parts")).where("leader < last")
    dealt = shared.select("key", "leader", each_salt(F.col("parts")).alias("_salt"))
    members, members_path = written(buckets.withColumn("_salt", salt("node")).join(dealt, ["key", "_salt"]).select("key", "node", "leader"), "members")
    chosen = nodes.select("node", "doc_id", "version").join(members.select("node").distinct(), "node", "left_semi")
    texts, texts_path = written(docs.join(chosen, ["doc_id", "version"]).select("node", "text"), "texts")
    edges_path: list[str] = []
    tried_path: list[str] = []

    def verify(pairs: DataFrame) -> bool:
        """Compare the pairs that were not compared before. Whether there are new links."""
        fresh = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        if tried_path:
            fresh = fresh.join(spark.read.parquet(*tried_path), ["x", "y"], "left_anti")
        fresh, path = written(fresh, "pairs")
        tried_path.append(path)
        found, path = written(confirm(fresh, texts, percent), "links")
        edges_path.append(path)
        return not found.isEmpty()

    def link() -> DataFrame:
        return groups(spark.read.parquet(*edges_path))[0]

    verify(members.where("node != leader").select(F.col("node").alias("x"), F.col("leader").alias("y")))
    comps = link()
    for n in range(1, leader_rounds + 1):
        open_ = open_members(members, comps)
        open_, open_path = written(open_, "open")
        if open_.isEmpty():
            break
        if n < leader_rounds:
            # Another leader in each bucket: the least by a hash that differs from round to round.
            lead = open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(n)).alias("h"), "node", "comp")).alias("l"))
            lead = lead.select("key", F.col("l.node").alias("y"), F.col("l.comp").alias("y_comp"))
            pairs = join_hot(open_, lead, "key", "node").where("comp != y_comp").select(F.col("node").alias("x"), "y")
        else:
            pairs = all_open_pairs(open_, nodes, texts, block_nodes, percent)
        if verify(pairs):
            comps = link()
        drop_path(spark, open_path)
    drop_path(spark, texts_path)
    drop_path(spark, members_path)
    placed, placed_path = written(nodes.select("node", F.col("doc_id").alias("own")).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "placed")
    least = placed.groupBy("comp").agg(F.min("own").alias("least"))
    found, _ = written(join_hot(placed, least, "comp", "node").select("node", F.col("least").alias("comp")), "found")
    drop_path(spark, placed_path)
    out = ["doc_id", "n_shingles", "component_id", *(["version"] if versions else [])]
    rows_ = sketches.select("doc_id", "n_shingles", F.xxhash64("a", "b", "n_shingles").alias("node"), "version")
    linked = join_hot(rows_.where("doc_id IS NOT NULL AND n_shingles > 0"), found, "node", "doc_id").withColumn("component_id", F.col("comp")).select(*out)
    alone = rows_.where("doc_id IS NULL OR n_shingles = 0").withColumn("component_id", F.col("doc_id")).select(*out)
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def open_members(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, node, comp) of the buckets that hold nodes of more than one group."""
    placed, _ = written(members.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp")), "members-now")
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi AND n > 2")
    return join_hot(placed, mixed.select("key", "n"), "key", "node")


def all_open_pairs(open_: DataFrame, nodes: DataFrame, texts: DataFrame, block_nodes: int, percent: int) -> DataFrame:
    """Pairs of the nodes of a bucket from different groups, found in blocks of at most 2 * block_nodes nodes or so."""
    parts = F.ceil(F.col("n") / block_nodes).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    placed = open_.withColumn("parts", parts).withColumn("own", own)
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    blocks = placed.select("key", "node", "comp", "own", others).select(
        "key",
        "node",
        "comp",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"),
    )
    sets = texts.join(open_.select("node").distinct(), "node", "left_semi").mapInArrow(_short_sets, "node bigint, set binary")
    about = nodes.select("node", "bands", "slots").join(sets, "node")
    full = blocks.join(about, "node").select("key", "i", "j", "side", "node", "comp", "bands", "slots", "set")
    return full.groupBy("key", "i", "j").applyInArrow(_block_pairs(percent), "x bigint, y bigint")

