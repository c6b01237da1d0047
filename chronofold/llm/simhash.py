"""SimHash near-duplicates: 64-bit fingerprints, tiled exact comparison, components.

Fingerprints that differ in at most ``radius`` bits agree on at least one of radius + 1 bit blocks, so each distinct
fingerprint joins one group for each block value. A group is compared in tiles: a tile holds fingerprints of one
population count (of one salt, where there are many), a pair of tiles whose counts differ by more than the radius is never
formed, and the rest are compared by numpy exclusive-or and bit counts. Out of a tile pair comes a spanning forest of its
links, never all its pairs, so the number of links is at most linear in what was read.

``without_near_duplicates`` looks for a similarity of 4/5 of the five-word shingles. There, texts lie some 39 of 256 bits
apart, too far for any exact cut into blocks, so fingerprints have PRINTS words of 64 bits, TABLES choices of TABLE_BITS bits
each choose groups (two texts of similarity 0.8 meet with a probability of 0.99, of 0.85 with 0.999), and groups are compared
as above. Links within SURE bits are taken; those within REACH are checked by the whole shingle sets of the two texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import private, slices, written
from chronofold.llm.graph import components

RADIUS, WORDS, SEED = 4, 4, 42
#: Settings for near copies by similarity: words of a shingle, the least similarity as a fraction, 64-bit words of a
#: fingerprint, choices of bits and bits of each, bits within which a link is looked at and is taken unchecked.
SHINGLE, LEAST, PRINTS, TABLES, TABLE_BITS, REACH, SURE = 5, (4, 5), 4, 64, 16, 64, 24
#: Rows that are compared at a time, and rows of a table up to which it is broadcast.
CHUNK, BROADCAST = 8192, 100_000
_U = np.uint64
#: Fingerprints of one block value up to which they are compared as one group, tile by tile within a task.
TILE = 1024


def shingles(text: str, words: int, seed: int) -> np.ndarray:
    """Hashes of the text's word shingles in order; of a shorter text the one of all its words, of none nothing."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # on bytes: A-Z only, and ASCII white space only
    n, digest = max(1, len(found) - words + 1) if found else 0, xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(found[i : i + words]), seed) for i in range(n)), _U, n)


def majority(hashes: np.ndarray) -> np.ndarray:
    """hashes (n, words of 64 bits) -> the bits set in over half of the rows."""
    n, total = len(hashes), np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, n, 255):  # so many rows are counted in single bytes
        total += np.unpackbits(hashes[at : at + 255].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > n, bitorder="little").view(_U)


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's word shingles, repeats included; no words: 0."""
    found = shingles(text, words, seed)
    return int(majority(found[:, None])[0]) if len(found) else 0


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fp long, the 64 bits as a signed integer). A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x or "") for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, "doc_id long, fp long")


def forest(left: np.ndarray, right: np.ndarray, radius: int, rows: int = 256) -> list[tuple[int, int]]:
    """Links that join whatever of the two tiles is within the radius: a spanning forest, at most one fewer than values.

    Both sides are ordered by population count, and ``rows`` fingerprints at a time meet only that stretch of the other
    side whose counts are within the radius.
    """
    values = np.unique(np.concatenate([left, right]))
    label, out = np.arange(len(values)), []
    left, right = (x[np.argsort(np.bitwise_count(x), kind="stable")] for x in (left, right))
    a, b, ones, pops = np.searchsorted(values, left), np.searchsorted(values, right), np.bitwise_count(left).astype(int), np.bitwise_count(right).astype(int)
    for at in range(0, len(left), rows):
        lo, hi = np.searchsorted(pops, ones[at] - radius), np.searchsorted(pops, ones[min(at + rows, len(left)) - 1] + radius, "right")
        bits = np.bitwise_count(left[at : at + rows, None] ^ right[None, lo:hi])
        close = (bits <= radius) & (bits > 0)
        for i in np.flatnonzero(close.any(axis=1)):
            own, near = a[at + i], b[lo:hi][close[i]]
            joined, first = np.unique(label[near], return_index=True)
            for k in first[joined != label[own]]:
                out.append((int(values[own]), int(values[near[k]])))
                old, new = sorted((label[own], label[near[k]]), reverse=True)
                label[label == old] = new
    return out


def _block(fp: Column, i: int, blocks: int) -> Column:
    lo, hi = 64 * i // blocks, 64 * (i + 1) // blocks
    return F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """fps(fp), distinct -> links (a, b) that give the same components as all pairs within the radius."""
    n = radius + 1
    blocks = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), _block(F.col("fp"), i, n).alias("v")) for i in range(n))))
    keyed = fps.select("fp", F.bit_count("fp").alias("pop"), blocks.alias("k")).select("fp", "pop", (F.col("k.v") * n + F.col("k.i")).alias("key"))
    sizes = keyed.groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n"))
    # per block value at most 65 counts; those of one value only are compared with nothing
    groups = sizes.groupBy("key").agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("pop", "n"))).alias("by")).where(F.col("all") > 1)
    keyed = keyed.join(groups, "key")
    salts = lambda pop: F.ceil(F.coalesce(F.try_element_at("by", pop), F.lit(0)) / F.lit(float(tile))).cast("int")
    salt = F.pmod(F.xxhash64("fp"), salts(F.col("pop")).cast("long")).cast("int")
    others = F.flatten(F.transform(F.sequence(F.lit(-radius), F.lit(radius)), lambda d: F.transform(F.filter(F.sequence(F.lit(0), salts(F.col("pop") + d)), lambda s: s < salts(F.col("pop") + d)), lambda s: (F.col("pop") + d) * F.lit(1 << 40) + s)))
    own = F.col("pop") * F.lit(1 << 40) + salt
    pair = F.when(F.col("all") <= tile, F.array(F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("y")))).otherwise(F.transform(others, lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y"))))
    dealt = keyed.select("key", "fp", "pop", own.alias("own"), F.explode(pair).alias("p")).select("key", "p.x", "p.y", "own", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            own, fp = (np.concatenate([h[i] for h in held]) for i in range(2))
            fp = fp.view(np.uint64)
            if last[1] >= 0:
                left, right = fp[own == last[1]], fp[own == last[2]]
                found = forest(left, right, radius)
            else:
                found = forest(fp, fp, radius)
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            key, x, y, own, fp = (batch.column(i).to_numpy() for i in range(5))
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)], strict=True):
                now = (int(key[a]), int(x[a]), int(y[a]))
                if last is not None and now != last:
                    yield from flush()
                    held = []
                last = now
                held.append((own[a:b], fp[a:b]))
        if held:
            yield from flush()

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(compare, "a long, b long")


def _rooted(nodes: DataFrame, found: DataFrame, node: str, least: str) -> DataFrame:
    """nodes(<node>, <least>) with root, and as <least> the smallest of the component; a node without links is its own root.

    The minima are written before they are joined: two written tables can be split where one component has very many nodes.
    """
    rooted = written(nodes.join(found.withColumnsRenamed({"node": node}), node, "left").withColumn("root", F.coalesce("root", node)), "rooted")
    minima = written(rooted.groupBy("root").agg(F.min(least).alias(least)), "minima")
    return rooted.drop(least).join(minima, "root")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest doc_id that links of at most ``radius`` differing bits reach, itself included. Texts that
    are null, empty or blank have fingerprint zero and link like any other. Equal fingerprints are one node from the start,
    so copies and repeated rows cost nothing but their rows. A null doc_id stays null and never becomes a component's id
    unless all are null. Very long texts are hashed whole, an empty table gives an empty result, other columns are not read.
    """
    rows = written(fingerprints(docs), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("component_id")), "nodes")
    named = written(_rooted(nodes, components(links(nodes.select("fp"), radius)), "fp", "component_id").select("fp", "component_id"), "groups")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def wide(distinct: np.ndarray) -> np.ndarray:
    """PRINTS words of fingerprint from distinct shingle hashes: the hashes themselves, and bijections of them."""
    out = np.empty((len(distinct), PRINTS), _U)
    for i in range(PRINTS):
        x = distinct + _U(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
        out[:, i] = distinct if i == 0 else x ^ (x >> _U(32))
    return majority(out) if len(distinct) else np.zeros(PRINTS, _U)


def _choices() -> np.ndarray:
    """Which bits each table looks at: permutations of all bits, cut into pieces."""
    r, bits = np.random.default_rng(7), 64 * PRINTS
    return np.concatenate([r.permutation(bits) for _ in range(-(-TABLES * TABLE_BITS // bits))])[: TABLES * TABLE_BITS].reshape(TABLES, TABLE_BITS)


def table_keys(prints: np.ndarray) -> np.ndarray:
    """(rows, PRINTS) fingerprints -> (rows, TABLES) group keys."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")[:, _choices()]
    return bits.astype(np.int32) @ (1 << np.arange(TABLE_BITS, dtype=np.int32)) + (np.arange(TABLES, dtype=np.int32) << TABLE_BITS)


def close_pairs(group: np.ndarray, side: np.ndarray, prints: np.ndarray, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """(place, place, differing bits) of rows of one group within reach; two rows whose sides are both set must differ in side.

    Rows are ordered by population count, so a row meets only those whose counts are within reach.
    """
    pops = np.bitwise_count(prints).sum(axis=1, dtype=np.int64)
    order = np.lexsort((pops, group))
    group, side, prints, pops = group[order], side[order], prints[order], pops[order]
    out, at, shift = [], np.arange(len(order)), 0
    while True:
        shift += 1
        at = at[at + shift < len(order)]
        at = at[(group[at] == group[at + shift]) & (pops[at + shift] - pops[at] <= reach)]
        if not len(at):
            break
        bits = np.bitwise_count(prints[at] ^ prints[at + shift]).sum(axis=1, dtype=np.int64)
        near = (bits <= reach) & ((side[at] < 0) | (side[at] != side[at + shift]))
        out.append((order[at[near]], order[at[near] + shift], bits[near]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def spanning(a: np.ndarray, b: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs make a spanning forest of n rows, nearest first: it joins what any closer bound would join."""
    order, label, kept = np.argsort(bits, kind="stable"), np.arange(n), []
    for level in np.split(order, np.flatnonzero(np.diff(bits[order])) + 1):
        x, y = label[a[level]], label[b[level]]
        differ = x != y
        if not differ.any():
            continue
        level, x, y = level[differ], x[differ], y[differ]
        _, first = np.unique(np.minimum(x, y) * n + np.maximum(x, y), return_index=True)
        parent: dict[int, int] = {}

        def root(i: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.get(i, i)) != i:
                parent[i] = i = parent.get(up, up)
            return i

        for k in first:
            u, v = root(int(x[k])), root(int(y[k]))
            if u != v:
                parent[max(u, v)] = min(u, v)
                kept.append(level[k])
        table = np.arange(n)
        touched = np.fromiter(parent, np.int64)
        table[touched] = [root(int(i)) for i in touched]
        label = table[label]
    return np.array(kept, np.int64)


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), _U).reshape(-1, PRINTS)


def near_links(nodes: DataFrame, tile: int = TILE) -> DataFrame:
    """nodes(sid, print) -> (a, b, bits): for each group a nearest-first spanning forest of the pairs within REACH."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, None):
            yield pa.RecordBatch.from_arrays([pa.array(table_keys(_prints(batch.column(0))).ravel())], names=["key"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, None):
            found = table_keys(_prints(batch.column(1)))
            again = pa.array(np.repeat(np.arange(len(found)), TABLES))
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), batch.column(0).take(again), batch.column(1).take(again)], names=["key", "sid", "print"])

    counts = nodes.select("print").mapInArrow(keys, "key int").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = written(counts.where(F.col("n") > tile).select("key", F.ceil(F.col("n") * 2 / tile).cast("int").alias("parts")), "large")
    rows = nodes.select("sid", "print").mapInArrow(dealt, "key int, sid long, print binary")
    if large.isEmpty():
        rows = rows.select("key", F.lit(-1).alias("x"), F.lit(-1).alias("y"), F.lit(-1).alias("side"), "sid", "print")
    else:  # a large group is dealt into tiles, and each pair of tiles compared
        side = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least("side", o).alias("x"), F.greatest("side", o).alias("y")))
        alone = F.array(F.struct(F.lit(-1).alias("x"), F.lit(-1).alias("y")))
        rows = rows.join(bounded(large), "key", "left").withColumn("side", F.coalesce(side, F.lit(-1)))
        rows = rows.withColumn("p", F.explode(F.when(F.col("side") < 0, alone).otherwise(tiles)))
        rows = rows.select("key", "p.x", "p.y", F.when(F.col("p.x") == F.col("p.y"), -1).otherwise(F.col("side")).alias("side"), "sid", "print")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> pa.RecordBatch:
            key, x, y, side, sid = (table.column(i).to_numpy() for i in range(5))
            group = np.concatenate([[0], np.cumsum((np.diff(key) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0))])
            a, b, bits = close_pairs(group, side, _prints(table.column(5)))
            kept = spanning(a, b, bits, len(sid))
            a, b = sid[a[kept]], sid[b[kept]]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(bits[kept].astype(np.int32))], names=["a", "b", "bits"])

        for batch in batches:
            held.append(batch)
            if sum(h.num_rows for h in held) < CHUNK:
                continue
            table = pa.Table.from_batches(held)
            spots = np.stack([table.column(i).to_numpy() for i in range(3)])
            ends = np.flatnonzero((np.diff(spots, axis=1) != 0).any(axis=0))  # the last group may go on
            at = 0
            while len(ends) and at <= ends[-1]:
                last = ends[min(len(ends) - 1, max(np.searchsorted(ends, at), np.searchsorted(ends, at + CHUNK, "right") - 1))]
                yield flush(table.slice(at, last + 1 - at))
                at = last + 1
            held = table.slice(at).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    found = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(compare, "a long, b long, bits int")
    return written(found.groupBy("a", "b").agg(F.min("bits").alias("bits")), "near")


def bounded(df: DataFrame, rows: int = BROADCAST) -> DataFrame:
    """df, to be broadcast if it has few rows; else Spark joins it as it sees fit."""
    return F.broadcast(df) if df.count() <= rows else df


def _checked(pairs: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs(a, b) whose whole shingle sets are as similar as asked; only the texts of these pairs are read again."""
    ids = written(pairs.select("a").union(pairs.select("b")).toDF("sid").distinct().join(nodes.select("sid", "row"), "sid").select("sid", "row.*"), "asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.unique(shingles(t or "", SHINGLE, SEED)).view(np.int64) for t in batch.column(1).to_pylist()]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.empty(0, np.int64), *found])))], names=["sid", "s"])

    texts = rows.join(bounded(ids), ["key", "check"]).select("sid", "text").dropDuplicates(["sid"])  # a row may be repeated
    found = written(texts.mapInArrow(sets, "sid long, s array<long>"), "sets")
    a, b = (found.select(F.col("sid").alias(x), F.col("s").alias(f"s{x}")) for x in "ab")
    both, (up, down) = F.size(F.array_intersect("sa", "sb")), LEAST
    return written(pairs.join(a, "a").join(b, "b").where(both * (up + down) >= (F.size("sa") + F.size("sb")) * up).select("a", "b"), "checked")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, all columns: that of the smallest doc_id (then smallest hash of the text).

    Links are of texts that share 4/5 or more of their sets of five-word shingles (shorter texts: of all their words), as far
    as fingerprints find them; equal sets are one node from the start. Null, empty and blank texts have the empty set and are
    one group. Null ids come last; of rows repeated in id and text one stays. An empty table gives an empty result; other
    columns are carried along, whatever their names.
    """
    names = private(docs, "key", "check")
    key, check = F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)), F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    marked = docs.withColumns(dict(zip(names, (key, check), strict=True)))
    rows = marked.select(F.col(names[0]).alias("key"), F.col(names[1]).alias("check"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            found = [np.unique(shingles(t or "", SHINGLE, SEED)) for t in batch.column(2).to_pylist()]
            sids = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in found], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids), pa.array([wide(x).tobytes() for x in found], pa.binary())], names=["key", "check", "sid", "print"])

    known = written(rows.mapInArrow(run, "key long, check long, sid long, print binary"), "prints")
    nodes = written(known.groupBy("sid").agg(F.min(F.struct("key", "check")).alias("row"), F.first("print").alias("print")), "nodes")
    near = near_links(nodes)
    sure = components(near.where(F.col("bits") <= SURE).select("a", "b"))
    root = lambda x: sure.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    open_ = near.where(F.col("bits") > SURE).join(root("a"), "a", "left").join(root("b"), "b", "left")
    open_ = written(open_.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "open")
    found = sure if open_.isEmpty() else components(sure.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_checked(open_, nodes, rows)))
    rooted = nodes.join(found.withColumnsRenamed({"node": "sid"}), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    kept = rooted.groupBy("root").agg(F.min("row").alias("row")).select(*(F.col(f"row.{c}").alias(n) for c, n in zip(("key", "check"), names, strict=True)))
    return marked.join(kept, list(names), "left_semi").dropDuplicates(list(names)).select(*(F.col(f"`{c}`") for c in docs.columns))
