"""Operator 7: near-duplicate documents by b-bit MinHash.

Method: of HASHES minima of a document's shingle set, BITS low bits each are packed into a signature; bands of whole
minima give candidate buckets. Buckets that share a document form a group, without any pair of a bucket being written
out. In a group, similarities estimated from counts of equal bits, corrected for chance collisions, say which pairs to
confirm on the full sets. Links confirmed in a group's blocks are joined into components.

How it holds up: documents with equal sets become one (a copy made a thousand times costs one row for each task). Only
small rows are bucketed. Groups of more than BLOCK documents are dealt out as pairs of blocks, so no task gets a whole
large group; inside a task, pairs that are connected already aren't confirmed again. The comparison of signatures in a
group grows with the square of the group's distinct texts, at 0.2 microseconds a pair; links are never capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import common, shingles, worker
from loomline.llm.components import components

#: Bands of ROWS minima: a pair of similarity 0.85 shares no bucket with probability (1 - 0.85**6)**32 = 3e-7.
BANDS, ROWS, BITS = 32, 6, 4
HASHES = BANDS * ROWS
BLOCK = 1024
_rng = np.random.RandomState(20240607)
_MULTIPLY = _rng.randint(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FLIP = _rng.randint(0, 1 << 62, HASHES, dtype=np.int64).astype(np.uint64)
_BAND = shingles.mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def minima(s: np.ndarray) -> np.ndarray:
    out = np.empty(HASHES, np.uint64)
    step = max(1, min(HASHES, (1 << 16) // max(1, len(s))))
    for k in range(0, HASHES, step):
        out[k : k + step] = ((s[None, :] ^ _FLIP[k : k + step, None]) * _MULTIPLY[k : k + step, None]).min(axis=1)
    return out


def signature(least: np.ndarray) -> bytes:
    """BITS low bits of each minimum (mixed first), packed."""
    low = (shingles.mix(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[::2] << 4 | low[1::2]).tobytes()


def bands(least: np.ndarray) -> np.ndarray:
    h = _BAND.copy()
    for column in least.reshape(BANDS, ROWS).T:
        h = shingles.mix(h * np.uint64(0x9E3779B97F4A7C15) + column)
    return h.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of a to each of b (packed signatures as 64-bit words)."""
    ones = np.uint64(0x1111111111111111)
    equal = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        x = a[:, k, None] ^ b[None, :, k]
        x |= x >> np.uint64(2)
        x |= x >> np.uint64(1)
        equal += 16 - np.bitwise_count(x & ones)
    chance = 2.0**-BITS
    return (equal / HASHES - chance) / (1 - chance)


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("minhash")
        for batch in batches:
            for part in common.slices(batch, 1):
                rows = []
                with np.errstate(over="ignore"):
                    for s in shingles.shingle_sets(part.column(1).to_pylist()):
                        if len(s):
                            least = minima(s)
                            rows.append((len(s), *shingles.set_hash(s), signature(least), bands(least)))
                        else:
                            rows.append((0, 0, 0, b"", np.zeros(0, np.int64)))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], names=["doc_id", "n", "h1", "h2", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """id, grp, n_blocks, sig and the full set of each row whose text has the set h1, h2; repeated rows once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part in common.slices(batch, 6):
                keys = list(zip(part.column(0).to_pylist(), part.column(4).to_pylist(), part.column(5).to_pylist(), strict=True))
                keep, out = [], []
                for k, s in enumerate(shingles.shingle_sets(part.column(6).to_pylist())):
                    if keys[k] not in seen and shingles.set_hash(s) == keys[k][1:]:
                        seen.add(keys[k])
                        keep.append(k)
                        out.append(s.tobytes())
                part = part.take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(out, pa.binary())], names=["id", "grp", "n_blocks", "sig", "hashes"])

    return docs.select("id", "grp", "n_blocks", "sig", "h1", "h2", "text").mapInArrow(run, "id long, grp long, n_blocks int, sig binary, hashes binary")


def _confirm(ids: list, block: list, sigs: list, sets: list, percent: int, least: float) -> list[tuple[int, int]]:
    """ids may repeat, with other sets. Links that connect what links among these documents connect; between blocks where there are two."""
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out: list[tuple[int, int]] = []
    words = np.frombuffer(b"".join(sigs), np.uint64).reshape(len(ids), -1)
    sizes, side = np.array([len(s) for s in sets]), np.array(block)
    two = len(set(block)) > 1
    order = np.argsort(sizes, kind="stable")
    words, sizes, side = words[order], sizes[order], side[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(ids), 64):
        # In order of size: no partner of these can be larger than size / percent.
        end = int(np.searchsorted(sizes, sizes[min(at + 64, len(ids)) - 1] * 100 // percent, side="right"))
        e = estimates(words[at : at + 64], words[at:end])
        x, y = np.nonzero(e >= least)
        ok = (y > x) & (100 * sizes[at + x] >= percent * sizes[at + y])
        if two:
            ok &= side[at + x] != side[at + y]
        x, y = x[ok], y[ok]
        found.append((order[at + x], order[at + y], e[x, y]))
    x, y, e = (np.concatenate(c) for c in zip(*found, strict=True))
    best = np.argsort(-e, kind="stable")
    for p, q in zip(x[best].tolist(), y[best].tolist(), strict=True):
        r, t = root(p), root(q)
        if r != t:
            both = shingles.common_count(sets[p], sets[q])
            if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                up[r] = t
                out.append((ids[p], ids[q]))
    return out


def _links(rows: DataFrame, percent: int, least: float) -> DataFrame:
    """Confirmed links of each (grp, i, j), whose rows come one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def close() -> pa.RecordBatch:
            links = _confirm(*map(list, zip(*held.values(), strict=True)), percent, least)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], names=["a", "b"])

        for batch in batches:
            for g, i, j, doc, block, sig, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != key:
                    if len(held) > 1:
                        yield close()
                    key, held = (g, i, j), {}
                held[doc, hashes] = (doc, block, sig, np.frombuffer(hashes, np.uint64))
        if len(held) > 1:
            yield close()

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, folder: str, percent: int = 85, margin: float = 0.17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs.

    Documents whose sets have 100 * intersection >= percent * union are linked; component_id is the smallest id that
    links reach. A pair is confirmed unless its estimate is below the threshold by margin, five standard errors. An
    empty or null text has no shingles and no links. A row without id takes no part: no component, kept. Repeated rows
    are all returned; texts of one id are one document, linked by what links any of them. An empty table gives an empty result; other columns aren't read. Tables for the run are written
    to folder.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = common.written(_sketches(docs), f"{folder}/sketch", compression="none")
    first = F.min(F.struct("doc_id", "n", "sig", "bands")).alias("r")
    reps = common.written(sketch.filter("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(first).select(F.col("r.doc_id").alias("id"), "r.n", "h1", "h2", "r.sig", "r.bands"), f"{folder}/reps", compression="none")
    entries = reps.select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("bucket", "a")
    stars = entries.join(shared, "bucket").filter("id > a").select("a", F.col("id").alias("b")).distinct()
    groups = common.written(components(stars, f"{folder}/groups").withColumnRenamed("component", "grp"), f"{folder}/group-of")
    sizes = groups.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    members = groups.join(sizes, "grp").join(reps.select("id", "h1", "h2", "sig"), "id")
    rows = _sets(members.join(docs.withColumnRenamed("doc_id", "id"), "id"))
    # Block of a document, and the pairs of blocks that its block is in: (0, 0) alone for all but large groups.
    own = F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda k: F.struct(F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j"))))
    dealt = rows.withColumn("block", own).withColumn("pair", pair).select("grp", "pair.i", "pair.j", "id", "block", "sig", "hashes")
    dealt = dealt.repartition(common.partitions(docs.sparkSession), "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "id")
    links = common.written(_links(dealt, percent, percent / 100 - margin), f"{folder}/confirmed")
    found = components(links, f"{folder}/components")
    classes = reps.select("h1", "h2", "id").join(found, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("component"))
    out = sketch.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
