"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes a set of word shingles with ``HASHES`` minima. Bands of full minima give candidate keys; of each
   minimum only the low 4 bits stay, packed into 64 bytes. Texts with equal sets are one node from here on.
2. Nodes that share a band key meet in tasks of bounded size. Equal nibbles are counted with bit operations and corrected
   for chance collisions; pairs within five standard errors of the threshold connect candidates. A task emits
   each component it finds as a star, not all pairs.
3. Within each connected group of candidates, links are confirmed on the full sets, again component by
   component: documents already reached are not compared again, documents not reached are compared with every other one.
4. Components of the confirmed links are the classes.

Band keys and candidate groups beyond a task's size are cut in chunks, and every pair of chunks meets in a task of its
own. A pair at the threshold is missed with probability (1 - s^r)^bands < 1e-6 by the bands, and about as much by the
five standard errors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regulith.llm.graphs import Scratch, connected_components
from regulith.llm.kernel import U64, mix, rolling_ids, within, word_bounds, word_ids
from regulith.llm.packed import Batch, batches, bounded_batches

HASHES, BITS = 128, 4
MEMBERS = 2048  # nodes of a band key in one task
SET_BYTES = 2 << 20  # of sets in one chunk of a candidate group


def band_rows(share: float) -> int:
    """Most rows per band that miss a pair at the threshold less than once in a million."""
    return max(r for r in range(1, 17) if r == 1 or (1 - share**r) ** (HASHES // r) < 1e-6)


def floor_matches(share: float) -> int:
    """Least number of equal nibbles of a pair at the threshold, five standard errors below the mean."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * share
    return max(0, math.floor(HASHES * p - 5 * math.sqrt(HASHES * p * (1 - p))))


def shingle_sets(batch: Batch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of the batch's texts, text after text in sorted order, and the first of each text."""
    first, end, edges = word_bounds(batch.data, batch.starts, batch.ends)
    words = word_ids(batch.data, first, end, lower=True)
    text = np.repeat(np.arange(len(batch)), np.diff(edges))
    at = np.flatnonzero(within(edges, width))
    keys, owner = rolling_ids(words, width)[at], text[at]
    counts = np.diff(edges)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        whole = np.zeros(len(short), U64)
        for i, t in enumerate(short):
            for w in words[edges[t] : edges[t + 1]]:
                whole[i : i + 1] = mix(whole[i : i + 1] * U64(31) + w)
        keys = np.append(keys, mix(whole ^ counts[short].astype(U64)))
        owner = np.append(owner, short)
    by = np.lexsort((keys, owner))
    keys, owner = keys[by], owner[by]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[new], owner[new]
    return keys, np.searchsorted(owner, np.arange(len(batch) + 1))


def set_marks(keys: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that have shingles, and a 64-bit fingerprint of each one's set."""
    full = np.flatnonzero(np.diff(edges) > 0)
    if not len(full):
        return full, np.zeros(0, U64)
    sums = np.add.reduceat(mix(keys ^ U64(0x5851F42D4C957F2D)), edges[full])
    return full, mix(sums + np.diff(edges)[full].astype(U64))


def sketches(parts: Iterator[pa.RecordBatch], width: int, rows: int) -> Iterator[pa.RecordBatch]:
    constants = mix(np.arange(1, 2 * HASHES + 1, dtype=U64))
    for batch in batches(parts):
        keys, edges = shingle_sets(batch, width)
        full, marks = set_marks(keys, edges)
        n = len(full)
        minima = np.empty((HASHES, n), np.uint64)
        low, step = 0, 1 << 15
        cuts = np.searchsorted(edges[full], np.arange(0, len(keys) + step, step)) if n else np.zeros(1, int)
        for a, b in zip(cuts[:-1], cuts[1:]):  # some texts at a time, so that the values stay in the processor's cache
            if b > a:
                low, high = edges[full[a]], edges[full[b - 1] + 1]
                values, heads = keys[low:high], edges[full[a:b]] - low
                for k in range(HASHES):
                    minima[k, a:b] = np.minimum.reduceat((values * (constants[k] | U64(1)) + constants[HASHES + k]) >> U64(32), heads)
        nibbles = (mix(minima) & U64(15)).astype(np.uint8)
        packed = np.ascontiguousarray((nibbles[0::2] | (nibbles[1::2] << 4)).T)
        bands = []
        for band in range(HASHES // rows):
            key = np.full(n, band + 1, U64)
            for k in range(rows):
                key = mix(key * U64(0x9E3779B97F4A7C15) + minima[band * rows + k])
            bands.append(key)
        sizes = np.diff(edges)
        at = np.full(len(batch), -1)
        at[full] = np.arange(n)
        some = at >= 0
        mark = np.zeros(len(batch), np.int64)
        mark[full] = marks.view(np.int64)
        table = np.stack(bands, axis=1).view(np.int64) if n else np.zeros((0, HASHES // rows), np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.where(some, HASHES // rows, 0))), pa.int32()), pa.array(table.ravel()))
        signs = pa.array([packed[i].tobytes() if i >= 0 else None for i in at], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.id_array(), pa.array(sizes.astype(np.int64)), pa.array(mark, mask=~some), lists, signs], names=["id", "n", "node", "bands", "sign"])


def equal_nibbles(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = many ^ one
    x |= x >> U64(1)
    x |= x >> U64(2)
    x &= U64(0x1111111111111111)
    return HASHES - np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def walk(n: int, linked) -> list[tuple[int, int]]:
    """Components of n nodes as (least node, other node); ``linked(i, rest)`` tells which of the rest are linked with node i."""
    root, rest, out = 0, np.arange(1, n), []
    queue = [0]
    while len(rest):
        if not queue:
            root, rest = int(rest[0]), rest[1:]
            queue = [root]
            continue
        hit = linked(queue.pop(), rest)
        found = rest[hit].tolist()
        out += [(root, j) for j in found]
        queue += found
        rest = rest[~hit]
    return out


def grouped(parts: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: rows arrive sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        columns = [part.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        new = np.zeros(part.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        if held:
            new[0] = any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != c[0] for k, c in enumerate(columns))
        cuts = np.flatnonzero(new)
        if len(cuts):
            if cuts[-1] > 0:
                held.append(part.slice(0, int(cuts[-1])))
            if held:
                yield pa.Table.from_batches(held)
            held = [part.slice(int(cuts[-1]))]
        else:
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def group_edges(table: pa.Table, keys: int) -> np.ndarray:
    """First row of each group, and the number of rows."""
    n = table.num_rows
    new = np.ones(n, bool)
    new[1:] = False
    for k in range(keys):
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def edge_batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*pairs) if pairs else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def similar_signs(parts: Iterator[pa.RecordBatch], floor: int) -> Iterator[pa.RecordBatch]:
    """(band, i, j, node, sign) sorted by the first three: candidate links."""
    for table in grouped(parts, 3):
        nodes = table.column("node").to_numpy()
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), U64).reshape(len(nodes), -1)
        edges = group_edges(table, 3)
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        near = equal_nibbles(signs[two], signs[two + 1]) >= floor
        pairs = [(nodes[two[near]], nodes[two[near] + 1])]
        for low, size in zip(edges[:-1][sizes > 2], sizes[sizes > 2]):
            own = signs[low : low + size]
            found = walk(int(size), lambda i, rest, own=own: equal_nibbles(own[i], own[rest]) >= floor)
            if found:
                a, b = np.array(found).T
                pairs.append((nodes[low + a], nodes[low + b]))
        yield edge_batch(pairs)


def similar_sets(parts: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(group, i, j, node, keys) sorted by the first three: links confirmed on whole sets."""
    for table in grouped(parts, 3):
        nodes, edges = table.column("node").to_numpy(), group_edges(table, 3)
        column = table.column("keys")
        pairs = []
        for low, high in zip(edges[:-1], edges[1:]):
            sets = [np.frombuffer(column[int(i)].as_py(), U64) for i in range(low, high)]
            size = np.array([len(s) for s in sets])
            _, local = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.append(0, np.cumsum(size))
            present = np.zeros(int(local.max()) + 1, bool)

            held = {"rest": np.zeros(0, np.int64)}

            def linked(i, rest):
                own = local[start[i] : start[i + 1]]
                present[own] = True
                if len(rest) < 0.7 * len(held["rest"]) or not len(held["rest"]):  # lay out anew the sets that are left
                    heads = np.append(0, np.cumsum(size[rest])[:-1])
                    items = np.repeat(start[rest] - heads, size[rest]) + np.arange(int(size[rest].sum()))
                    held.update(rest=rest, heads=heads, items=local[items])
                shared = np.add.reduceat(present[held["items"]], held["heads"], dtype=np.int64)
                shared = shared[np.searchsorted(held["rest"], rest)]
                present[own] = False
                return 100 * shared >= percent * (size[i] + size[rest] - shared)

            found = walk(int(high - low), linked)
            if found:
                a, b = np.array(found).T
                pairs.append((nodes[low + a], nodes[low + b]))
        yield edge_batch(pairs)


def paired_chunks(df: DataFrame, key: str, node: str, chunks) -> DataFrame:
    """Rows with the tasks (i, j) in which they meet: one for a single chunk, else one for each other chunk."""
    own = F.pmod(F.xxhash64(node), F.col("_chunks"))
    other = F.explode(F.when(F.col("_chunks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("_chunks") - 1), lambda x: x != F.col("_own"))))
    return (
        df.withColumn("_chunks", chunks.cast("bigint")).withColumn("_own", own).withColumn("_other", other)
        .withColumn("i", F.least("_own", "_other")).withColumn("j", F.greatest("_own", "_other"))
        .repartition(key, "i", "j").sortWithinPartitions(key, "i", "j", node)
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of documents linked by 100 * |A & B| >= percent * |A | B| on their sets of ``width``-word shingles.

    Words are lower-cased (A-Z) runs of anything but [\\x20\\x09-\\x0D]; a text with fewer words than a shingle is one shingle.
    Returns one row per input row: the id, n_shingles, component_id (smallest id of its class) and kept (id equals
    component_id). Other columns are not read. Null and empty texts are linked with nothing. A null id counts as larger than
    all others; a class of null ids only has a null component_id and its rows are kept. Rows that repeat an id are
    separate texts under one id. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark)
    rows, floor = band_rows(percent / 100), floor_matches(percent / 100)
    slim = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    sketch = slim.mapInArrow(lambda parts: sketches(parts, width, rows), "id bigint, n bigint, node bigint, bands array<bigint>, sign binary")
    sketch, _ = scratch.keep(sketch, "sketches")
    nodes = sketch.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"))

    signs = sketch.where("node is not null").groupBy("node").agg(F.first("sign").alias("sign"), F.first("bands").alias("bands"))
    signs, signs_path = scratch.keep(signs, "signs")
    bands = signs.select("node", F.explode("bands").alias("band"))
    full = bands.groupBy("band").agg(F.count("*").alias("members")).where("members > 1")
    members = bands.join(full, "band").join(signs.select("node", "sign"), "node")
    tasks = paired_chunks(members, "band", "node", F.ceil(F.col("members") / MEMBERS)).select("band", "i", "j", "node", "sign")
    candidates = tasks.mapInArrow(lambda parts: similar_signs(parts, floor), "a bigint, b bigint")
    groups, groups_path = connected_components(candidates, scratch)
    scratch.drop(signs_path)

    member = groups.join(nodes, "node")
    room = member.groupBy("component").agg(F.sum("n").alias("total"))
    member = member.join(room, "component").select("node", "component", "id", F.greatest(F.lit(1), F.ceil(F.col("total") * 8 / SET_BYTES)).alias("chunks"))
    member, member_path = scratch.keep(member, "members")

    def sets(parts):
        for batch in batches(parts):
            keys, edges = shingle_sets(batch, width)
            texts, marks = set_marks(keys, edges)
            for low in range(0, len(texts), 256):  # bounded output batches
                some = texts[low : low + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks[low : low + 256].view(np.int64)), pa.array([keys[edges[t] : edges[t + 1]].tobytes() for t in some], pa.binary())], names=["node", "keys"])

    ids = member.select(F.col("id").alias("_id")).distinct()
    texts = slim.join(ids, slim["id"].eqNullSafe(ids["_id"]), "left_semi").mapInArrow(sets, "node bigint, keys binary")
    texts = texts.groupBy("node").agg(F.first("keys").alias("keys"))
    tasks = paired_chunks(member.join(texts, "node"), "component", "node", F.col("chunks")).select("component", "i", "j", "node", "keys")
    links = tasks.mapInArrow(lambda parts: similar_sets(parts, percent), "a bigint, b bigint")
    classes, _ = connected_components(links, scratch)
    scratch.drop(member_path)
    scratch.drop(groups_path)

    least_id = classes.join(nodes, "node").groupBy("component").agg(F.min("id").alias("least"))
    in_class = classes.join(least_id, "component").select("node", "least")
    named = nodes.join(in_class, "node", "left").select("node", F.when(F.col("least") < F.col("id"), F.col("least")).otherwise(F.coalesce("id", "least")).alias("component_id"))
    out = sketch.select("id", "n", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
