"""Operator 4: benchmark decontamination by latent semantic retrieval.

Method: passages of SPAN words, a new one every SPAN/2, as TF-IDF vectors over the benchmark's words (a word that no item
has can't bring a passage nearer to one); a randomised SVD of the matrix of all passages, its products summed up by
Spark; cosine search of every passage against the items in latent space; then, for the candidates, the longest common
subsequence of words and a check of the item's answer. The benchmark is handled in blocks of a bounded number of items,
which alone are broadcast.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import common, shingles, worker

SPAN, HALF = 32, 16
#: Latent dimensions, columns of the random test matrix, items in one block, and words in one of its vocabularies.
RANK, WIDTH, ITEMS, WORDS = 64, 72, 2000, 65_000
#: Values of one byte that tell which item has which word; cosines or sums in memory at once; words of a long item.
HELD, SUMS, LONG_ITEM = 1 << 26, 1 << 22, 4096
#: Share of an item's terms, the rarest, of which a passage's neighbourhood must have all but what may be missing.
RARE = 0.6
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.full(256, 32, np.uint8)
_FOLD[_WORD] = np.arange(256)[_WORD]
_FOLD[65:91] = np.arange(97, 123)


def _hashes(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many texts (A-Z lower-cased; words: runs of letters, digits and characters beyond ASCII), and how
    many words each has."""
    joined = _FOLD[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
    h, start = shingles.word_hashes(joined.tobytes())
    ends = np.cumsum([len(r) + 1 for r in raws])
    return h, np.diff(np.searchsorted(start, ends), prepend=0)


@dataclass
class Items:
    """A block of the benchmark: sorted hashes of its words, and each item's words as places in them."""

    ids: list
    words: list[np.ndarray]
    answers: list[np.ndarray | None]
    hashes: np.ndarray


def _block(rows: list, answer_col: str | None) -> Items:
    rows = [r for r in rows if r.text and r.item_id is not None]
    texts = [r.text.encode(errors="surrogatepass") for r in rows] + [((r[answer_col] if answer_col else None) or "").encode(errors="surrogatepass") for r in rows]
    if not rows:
        return Items([], [], [], np.zeros(0, np.uint64))
    h, n = _hashes(texts)
    known, place = np.unique(h, return_inverse=True)
    each = np.split(place, np.cumsum(n)[:-1])
    keep = [k for k in range(len(rows)) if len(each[k])]
    answers = [each[len(rows) + k] if len(each[len(rows) + k]) else None for k in keep]
    return Items([rows[k].item_id for k in keep], [each[k] for k in keep], answers, known)


def _tokens(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """doc_id and the places of a text's words in known, len(known) for others, packed."""
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most WORDS hashes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.enter("decontaminate")
        squeeze, known = zstandard.ZstdCompressor(level=1), shared.value
        size = len(known)
        for batch in batches:
            out = []
            for part in common.slices(batch, 1, 1 << 19):
                h, counts = _hashes([(t.as_py() or "").encode(errors="surrogatepass") for t in part.column(1)])
                place = np.searchsorted(known, h)
                place[place == size] = 0
                ids = np.where(known[place] == h, place, size).astype(np.uint32)
                out += [squeeze.compress(x.tobytes()) for x in np.split(ids, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


class Passages:
    """The passages of some documents: half passages follow one another, and each passage is one or two of them."""

    def __init__(self, docs: list[np.ndarray], weight: np.ndarray):
        lengths = np.array([len(d) for d in docs])
        halves = np.maximum(1, -(-lengths // HALF))
        first = np.cumsum(halves) - halves
        ids = np.concatenate(docs) if len(docs) else np.zeros(0, np.uint32)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        half = np.repeat(first, lengths) + place // HALF
        used = np.flatnonzero(weight[ids] > 0)
        # A word counts once in a half passage, so one that is repeated doesn't outweigh all others.
        pair = np.unique(half[used] * len(weight) + ids[used])
        self.ids, self.half = pair % len(weight), pair // len(weight)
        self.weight = weight[self.ids]
        total = int(halves.sum())
        last = np.zeros(total + 1, bool)
        last[first + halves - 1] = True
        alone = np.zeros(total + 1, bool)
        alone[first[halves == 1]] = True
        self.n_halves = total
        self.start = np.flatnonzero((~last | alone)[:total])
        self.second = np.where(alone[self.start], total, self.start + 1)
        self.doc = np.repeat(np.arange(len(docs)), halves)[self.start] if total else np.zeros(0, int)
        self.first, self.after = first, first + halves

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Each passage's TF-IDF vector times vectors."""
        sums = np.zeros((self.n_halves + 1, vectors.shape[1]), vectors.dtype)
        if len(self.ids):
            rows = vectors[self.ids] * self.weight[:, None].astype(vectors.dtype)
            first = np.flatnonzero(np.concatenate([[True], self.half[1:] != self.half[:-1]]))
            n = np.diff(np.append(first, len(self.half)))
            for k in range(int(n.max())):  # the k-th term of all halves at once; a half has at most HALF
                at = first[n > k] + k
                sums[self.half[at]] += rows[at]
        return sums[self.start] + sums[self.second]

    def spread(self, y: np.ndarray, size: int) -> np.ndarray:
        """The transposed matrix of the passages times y."""
        by_half = np.zeros((self.n_halves + 1, y.shape[1]), np.float32)
        by_half[self.start] += y
        by_half[self.second] += y
        out = np.zeros((size, y.shape[1]))
        if len(self.ids):
            order = np.argsort(self.ids, kind="stable")
            ids = self.ids[order]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            rows = by_half[self.half[order]]
            rows *= self.weight[order, None].astype(np.float32)
            out[ids[first]] = np.add.reduceat(rows, first)
        return out

    def shared_terms(self, window: np.ndarray, item: np.ndarray, reach: np.ndarray, held: np.ndarray) -> np.ndarray:
        """For pairs of a passage and an item: how many terms (held[term, item], bytes) the passage and reach[item] halves
        to both sides have in common with it; a term in several halves counts in each."""
        doc = self.doc[window]
        low = np.maximum(self.first[doc], self.start[window] - reach[item])
        high = np.minimum(self.after[doc], self.start[window] + 2 + reach[item])
        if not len(window):
            return np.zeros(0, np.int32)
        out = np.zeros(len(window), np.int32)
        # Only the halves that are reached and items that a passage is near, so many of them that the sums are bounded.
        begin, end = int(low.min()), int(high.max())
        a, b = np.searchsorted(self.half, [begin, end])
        half, ids = self.half[a:b] - begin, self.ids[a:b]
        first = np.flatnonzero(np.concatenate([[True], half[1:] != half[:-1]])) if len(half) else np.zeros(0, int)
        n = np.diff(np.append(first, len(half)))
        near, column = np.unique(item, return_inverse=True)
        terms, ids = np.unique(ids, return_inverse=True)
        held = held.take(terms, axis=0)
        step = max(1, SUMS // (end - begin + 1))
        for at in range(0, len(near), step):
            own = held.take(near[at : at + step], axis=1)
            sums = np.zeros((end - begin + 1, own.shape[1]), np.uint8)  # a half has at most HALF terms
            for t in range(int(n.max(initial=0))):
                place = first[n > t] + t
                sums[half[place] + 1] += own.take(ids[place], axis=0)
            upto = np.cumsum(sums, axis=0, dtype=np.int32)
            own = np.flatnonzero((column >= at) & (column < at + step))
            out[own] = upto[high[own] - begin, column[own] - at] - upto[low[own] - begin, column[own] - at]
        return out


def _batches(batches: Iterator[pa.RecordBatch], words: int = 1 << 16) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents with their ids, at most 64 and, unless one alone has more, so many words at a time."""
    read, docs, ids, n = zstandard.ZstdDecompressor(), [], [], 0
    for batch in batches:
        for doc, packed in zip(*batch.columns, strict=True):
            own = np.frombuffer(read.decompress(packed.as_py()), np.uint32)
            if docs and (len(docs) == 64 or n + len(own) > words):
                yield docs, ids
                docs, ids, n = [], [], 0
            docs.append(doc.as_py())
            ids.append(own)
            n += len(own)
    if docs:
        yield docs, ids


def _frequencies(tokens: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many documents each word is, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 2, np.int64)
        for _, docs in _batches(batches):
            for d in docs:
                total[: size + 1] += np.bincount(d, minlength=size + 1) > 0
            total[size + 1] += len(docs)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2), pa.int32()), pa.array(total)], names=["term", "n"])

    out = np.zeros(size + 2, np.int64)
    for r in tokens.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out[:size], int(out[size + 1])


def _weights(found: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, and a last 0 for unknown words. All are at least 1: documents that hold an item's
    words in many copies must not make these words count for nothing."""
    return np.append(1.0 + np.log((2.0 + n) / (1.0 + found)), 0.0)


def _sum_of_products(tokens: DataFrame, weight: np.ndarray, vectors: np.ndarray, twice: bool) -> np.ndarray:
    """A'A times vectors if twice, else vectors' A'A vectors, A being the passages' matrix. Values for a bounded
    vocabulary reach the driver."""
    size, width = vectors.shape
    rows = size if twice else width
    shared = tokens.sparkSession.sparkContext.broadcast((weight, vectors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, vectors = shared.value
        padded = np.vstack([vectors, np.zeros((1, width))]).astype(np.float32)
        total = np.zeros((rows, width))
        for _, docs in _batches(batches):
            p = Passages(docs, weight)
            y = p.project(padded)
            total += p.spread(y, size) if twice else (y.T @ y)
        seen = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), *(pa.array(total[seen, j]) for j in range(width))], names=["term"] + [f"v{j}" for j in range(width)])

    names = [f"v{j}" for j in range(width)]
    out = np.zeros((rows, width))
    # Each task sends its sums, so tasks grow with the cluster and not with the corpus.
    few = tokens.coalesce(8 * tokens.sparkSession.sparkContext.defaultParallelism)
    sums = few.mapInArrow(run, "term int, " + ", ".join(f"{c} double" for c in names)).groupBy("term").agg(*(F.sum(c).alias(c) for c in names))
    for r in sums.collect():
        out[r.term] = r[1:]
    return out


def latent_space(tokens: DataFrame, weight: np.ndarray, rank: int = RANK, width: int = WIDTH) -> np.ndarray:
    """The leading right singular vectors of the passages' TF-IDF matrix, by a random test matrix and one power step."""
    size = len(weight) - 1
    width = min(width, size)
    test = np.random.RandomState(11).standard_normal((size, width)) * (weight[:size, None] > 0)
    q, _ = np.linalg.qr(_sum_of_products(tokens, weight, test, twice=True))
    values, turn = np.linalg.eigh(_sum_of_products(tokens, weight, q, twice=False))
    return q @ turn[:, np.argsort(-values)[:rank]]


class Masks:
    """The places of an item's words as bits. Of a long item they are made when asked for, as all together would take
    memory with the square of its length."""

    def __init__(self, words: np.ndarray):
        self.m, self.places, self.bits = len(words), {}, {}
        for k, w in enumerate(words.tolist()):
            self.places.setdefault(w, []).append(k)
        if self.m <= LONG_ITEM:
            self.bits = {w: self._make(places) for w, places in self.places.items()}

    @staticmethod
    def _make(places: list[int]) -> int:
        out = bytearray(places[-1] // 8 + 1)
        for k in places:
            out[k >> 3] |= 1 << (k & 7)
        return int.from_bytes(out, "little")

    def get(self, w: int) -> int:
        if self.m <= LONG_ITEM:
            return self.bits.get(w, 0)
        return self._make(self.places[w]) if w in self.places else 0

    def subsequence(self, words: list[int]) -> int:
        """Length of the longest common subsequence of words and the item."""
        full = (1 << self.m) - 1
        row = full
        for w in words:
            hit = self.get(w)
            if hit:
                u = row & hit
                row = (row + u | row - u) & full
        return self.m - row.bit_count()


HITS = "doc_id long, item_id long, start_word long, end_word long, cosine double, common_words long, item_words long, answer_found boolean"


def _search(tokens: DataFrame, items: Items, weight: np.ndarray, space: np.ndarray, cosine: float, similar: float, paraphrase: float) -> DataFrame:
    shared = tokens.sparkSession.sparkContext.broadcast((items, weight, space))  # ITEMS items and their words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, space = shared.value
        size = len(space)
        padded = np.vstack([space, np.zeros((1, space.shape[1]))]).astype(np.float32)
        unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        # A passage can't be near an item of many times its length, so long items are searched by their own passages.
        own = [(k, w[a : a + SPAN] if len(w) > 2 * SPAN else w) for k, w in enumerate(items.words) for a in range(0, len(w), SPAN if len(w) > 2 * SPAN else len(w))]
        begins = np.flatnonzero(np.diff([k for k, _ in own], prepend=-1))
        goal = unit(np.stack([(padded[w] * weight[w, None]).sum(axis=0) for _, w in own])).astype(np.float32)
        masks = [Masks(w) for w in items.words]
        held = np.zeros((size + 1, len(items.words)), np.uint8)
        for k, w in enumerate(items.words):
            terms = np.unique(w)
            held[terms[np.argsort(-weight[terms], kind="stable")][: math.ceil(RARE * len(terms))], k] = 1
        length = np.array([len(w) for w in items.words])
        reach = -(-length // HALF)
        # Of an item's words, so many may be missing; each of its terms that isn't there is one of them. Its rarest terms
        # are asked for first, as common ones stand nearly everywhere.
        missing = (1 - min(similar, paraphrase)) * length
        enough = held.sum(axis=0) - missing
        # The item's last words stand for an answer that isn't given.
        answers = [Masks(a if a is not None else w[len(w) - max(1, len(w) // 4) :]) for a, w in zip(items.answers, items.words, strict=True)]
        for ids, docs in _batches(batches):
            p = Passages(docs, weight)
            place = unit(p.project(padded))
            found = []
            for first in range(0, len(place), step := max(1, SUMS // len(goal))):
                near = place[first : first + step] @ goal.T
                if len(begins) < len(own):
                    near = np.maximum.reduceat(near, begins, axis=1)  # the nearest passage of each item
                window, item = np.nonzero(near >= cosine)
                value, window = near[window, item], window + first
                likely = p.shared_terms(window, item, reach, held) >= enough[item]
                window, item = window[likely], item[likely]
                found += zip(p.doc[window].tolist(), item.tolist(), p.start[window].tolist(), value[likely].tolist(), strict=True)
            rows = []
            for (doc, k), group in itertools.groupby(sorted(found), lambda x: x[:2]):
                m = len(items.words[k])
                # Over at most one and a half times the item's length, so that chance matches far apart don't add up.
                wide, step = m + m // 2, max(1, m // 4)
                best, starts, checked, value = None, set(), {}, 0.0
                own, needed, all_words = masks[k].places.keys(), len(masks[k].places) - missing[k], docs[doc]
                for _, _, at, cosine_here in group:
                    value = max(value, cosine_here)
                    at = int(at - p.first[doc]) * HALF
                    low = max(0, at - m) // step
                    if low not in checked:  # windows near each other ask for the same words
                        checked[low] = len(own & set(all_words[low * step : low * step + step + SPAN + 2 * m].tolist())) >= needed
                    if checked[low]:
                        starts.update(range(low, (at + SPAN) // step + 1))
                n = answers[k].m
                for begin in sorted(s * step for s in starts):
                    region = all_words[begin : begin + wide + n].tolist()
                    if len(own & set(region[:wide])) < needed:
                        continue
                    length = masks[k].subsequence(region[:wide])
                    if best is None or length > best[0]:
                        best = (length, begin, min(begin + wide, len(all_words)), value, answers[k].subsequence(region) >= 0.8 * n)
                if best and (best[0] >= similar * m or best[0] >= paraphrase * m and best[4]):
                    rows.append((ids[doc], items.ids[k], best[1], best[2], float(best[3]), best[0], m, bool(best[4])))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in HITS.split(", ")])

    return tokens.mapInArrow(run, HITS)


def _item_blocks(benchmark: DataFrame, columns: list[str]) -> Iterator[list]:
    """Rows of the benchmark in blocks of at most ITEMS items, WORDS words and HELD products of both, unless one item alone
    has more words."""
    block, words = [], 0
    for row in benchmark.select(*columns).toLocalIterator():
        more = sum(int(n) for n in _hashes([(row[c] or "").encode(errors="surrogatepass") for c in columns[1:]])[1])
        if block and (len(block) >= ITEMS or words + more > WORDS or (len(block) + 1) * (words + more) > HELD):
            yield block
            block, words = [], 0
        block.append(row)
        words += more
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, folder: str, cosine: float = 0.4, similar: float = 0.8, paraphrase: float = 0.7, answer_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, the words in which it was found
    (start_word, end_word), cosine, common_words, item_words, answer_found.

    Retrieval is by the benchmark's words alone: a passage without most of an item's words fails the check of
    subsequences anyway, so an item told wholly in other words isn't found. Memory is bounded whatever a document's or an
    item's length; the benchmark is read a block at a time, and each block passes over the corpus.

    An item is found where a common subsequence has at least the share similar of its words, or the share paraphrase
    and the answer too (answer_col of the benchmark, else its last quarter). Null or empty texts, and items without
    words or id, hold and match nothing; equal items are all reported; repeated rows of docs give repeated rows; empty
    tables give none. Of docs and benchmark only the named columns are read. Tables for the run are written to folder.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col))
    benchmark = benchmark.withColumn("item_id", F.col("item_id").cast("long"))
    found = spark.createDataFrame([], HITS)
    for k, rows in enumerate(_item_blocks(benchmark, ["item_id", "text"] + ([answer_col] if answer_col else []))):
        items = _block(rows, answer_col)
        if not items.ids:
            continue
        tokens = common.written(_tokens(docs, items.hashes), f"{folder}/tokens-{k}", compression="none")
        weight = _weights(*_frequencies(tokens, len(items.hashes)))
        space = latent_space(tokens, weight)
        found = found.unionByName(common.written(_search(tokens, items, weight, space, cosine, similar, paraphrase), f"{folder}/hits-{k}"))
        common.remove(spark, f"{folder}/tokens-{k}")
    return found
