"""Benchmark decontamination by spaced-seed hashing.

A seed is the tokens at the positions that a fixed mask keeps; the positions it ignores may hold anything. Seeds of the
benchmark meet the seeds of every document position, and around each hit the two token sequences are compared along
their common diagonal: the stretch with the most equal tokens among those that are similar enough is the overlap. The
benchmark is handed to the tasks in slices of bounded size; a larger benchmark takes more slices, one after the other,
each joined with all documents, so nothing is left out and a task holds one slice at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from .common import short_batches, written

#: The masks; 1 keeps a token, 0 ignores it.
MASKS = ("1101011001", "1110010101", "1011000111")
#: Fixed value: the mask of two neighbours; seeds with two kept neighbours that no item has are refused before they are hashed.
PAIR = "11"
#: Tokens of a slice of the benchmark, about, at most: its seeds and texts are what is broadcast.
SLICE_TOKENS = 500_000
#: An overlap counts from this many equal tokens (or all of a shorter item's), and this share of its length.
MIN_TOKENS = 13
MIN_SIMILARITY = 0.8
#: A match counts 1, a mismatch this much less: a stretch sums to 0 or more exactly if its share of matches is MIN_SIMILARITY.
MISMATCH = 4
#: Marks that are stripped from the ends of words.
MARKS = "!?.,;:*#$%&@~|\"'()[]{}<>-_=+"
#: Bytes of text whose words are numbered at once, a longer text excepted.
GROUP_BYTES = 1 << 20
#: Pairs of a seed's places that are held at once.
HELD_PAIRS = 1_000_000

HIT = "item_id long, doc_start int, doc_end int, item_start int, matches int, similarity double"


def tokens_of(text: str | None) -> list[str]:
    """Words in lower case without marks at either end; bare marks are no tokens."""
    return [w for w in (w.lower().strip(MARKS) for w in (text or "").split()) if w]


def groups_of(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, in parts of which all but the last text have less than GROUP_BYTES."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // GROUP_BYTES)) + 1).tolist(), len(texts)]
    for start, stop in zip(cuts, cuts[1:]):
        yield texts.slice(start, stop - start)


def numbers_of(texts: pa.Array, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of all texts one after the other, as places in `words` from 1, or 0; and where each text's begin and end.

    They are those of tokens_of: Arrow splits at the white space of Python, and the lower case of a letter does not depend
    on what is beyond white space, so whole texts are put in lower case.
    """
    lower = pa.array([(t.as_py() or "").lower() for t in texts], pa.string())
    split = pc.utf8_split_whitespace(lower)
    bare = pc.ascii_trim(split.flatten(), characters=MARKS)
    numbers = pc.fill_null(pc.index_in(bare, value_set=words), -1).to_numpy(zero_copy_only=False) + 1
    tokens = pc.binary_length(bare).to_numpy(zero_copy_only=False) > 0
    return numbers[tokens], np.concatenate([[0], np.cumsum(tokens)])[split.offsets.to_numpy()]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the known ones, which are in ascending order."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _goes_on(at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the seed before lies one token before and is equal."""
    out = np.zeros(len(at), dtype=bool)
    out[1:] = (at[1:] == at[:-1] + 1) & (hashes[1:] == hashes[:-1])
    return out


def _first_of(item: np.ndarray, diagonal: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (item, diagonal) with the least position of each."""
    order = np.lexsort((first, diagonal, item))
    item, diagonal, first = item[order], diagonal[order], first[order]
    new = np.ones(len(item), dtype=bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1])
    return item[new], diagonal[new], first[new]


class SeedIndex:
    """Seeds and texts of one slice of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = [(i, tokens_of(t)) for i, t in items]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, t in texts for w in t}), 1)}
        self.ids = [i for i, _ in texts]
        self.starts = np.concatenate([[0], np.cumsum([len(t) for _, t in texts])]).astype(np.int64)
        self.tokens = np.array([self.vocabulary[w] for _, t in texts for w in t], dtype=np.int64)
        self.weights = np.random.default_rng(20).integers(1, 2**63, size=16, dtype=np.uint64) | np.uint64(1)
        self.pairs = np.unique(self.hashes(self.tokens, PAIR)[1])
        self.seeds = []
        for mask in MASKS:
            at, hashes = self.hashes(self.tokens, mask)
            fits = np.searchsorted(self.starts, at, "right") == np.searchsorted(self.starts, at + len(mask) - 1, "right")
            at, hashes = at[fits], hashes[fits]
            # a place whose seed also lies one token before it
            goes_on = _goes_on(at, hashes)
            order, heads = np.argsort(hashes, kind="stable"), np.flatnonzero(~goes_on)
            heads = heads[np.argsort(hashes[heads], kind="stable")]
            self.seeds.append(((hashes[order], at[order]), (hashes[heads], at[heads])))
        # items shorter than a mask have no seed; they are found by their whole sequence
        self.short = {}
        for k, (_, t) in enumerate(texts):
            if 0 < len(t) < max(map(len, MASKS)):
                self.short.setdefault((self.vocabulary[t[0]], len(t)), []).append(k)

    def hashes(self, tokens: np.ndarray, mask: str, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the seeds whose kept tokens are all in the vocabulary and, where `pairs` tells which
        tokens make a pair of the benchmark with the next, whose kept neighbours are such pairs."""
        kept = [i for i, c in enumerate(mask) if c == "1"]
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        inside = tokens > 0
        needed = [inside[i : i + n] for i in kept]
        if pairs is not None:
            needed += [pairs[i : i + n] for i in kept if i + 1 in kept]
        at = np.flatnonzero(np.logical_and.reduce(needed))
        sums = np.zeros(len(at), dtype=np.uint64)
        for i in kept:
            sums = (sums ^ (sums >> np.uint64(29))) * self.weights[i] + tokens[at + i].astype(np.uint64)
        return at, sums

    def known_pairs(self, tokens: np.ndarray) -> np.ndarray:
        """Whether each token makes a pair of the benchmark with the next."""
        at, hashes = self.hashes(tokens, PAIR)
        pairs = np.zeros(len(tokens), dtype=bool)
        pairs[at[_among(hashes, self.pairs)]] = True
        return pairs

    def meets(self, tokens: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which documents have a seed of the benchmark or a whole short item; the others have no overlaps.

        The tokens of all documents stand one after the other; `starts` tells where each begins, and the end of the last.
        """
        pairs, places = self.known_pairs(tokens), []
        for mask, ((seeds, _), _) in zip(MASKS, self.seeds, strict=True):
            at, hashes = self.hashes(tokens, mask, pairs)
            places.append((at[_among(hashes, seeds)], len(mask)))
        for (first, n), items in self.short.items():
            begins = np.flatnonzero(tokens[: max(0, len(tokens) - n + 1)] == first)
            for k in items:
                at = begins
                for i in range(1, n):
                    at = at[tokens[at + i] == self.tokens[self.starts[k] + i]]
                places.append((at, n))
        met = np.zeros(len(starts) - 1, dtype=bool)
        for at, n in places:
            document = np.searchsorted(starts, at, "right") - 1
            met[document[at + n <= starts[document + 1]]] = True
        return met

    def find_all(self, texts: pa.Array, words: pa.Array) -> list[list[tuple[int, int, int, int, int, float]]]:
        """The overlaps of each text; `words` is the vocabulary in order."""
        found = []
        for part in groups_of(texts):
            tokens, starts = numbers_of(part, words)
            met = self.meets(tokens, starts)
            found += [self.find(tokens[starts[d] : starts[d + 1]]) if met[d] else [] for d in range(len(part))]
        return found

    def find(self, tokens: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        """Verified overlaps of a document's tokens (vocabulary numbers) with the items.

        Where nearly a whole item is found, seeds of that item that begin inside the stretch lead to no further overlap,
        so that text of endless repeats is covered once by an item of repeats.
        """
        pairs = self.known_pairs(tokens)
        parts = [x for mask, known in zip(MASKS, self.seeds, strict=True) for x in self.diagonals(tokens, pairs, mask, known)]
        found, covered = [], {}
        if parts:
            item, diagonal, first = _first_of(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            for n in np.argsort(first, kind="stable"):
                k = int(item[n])
                if first[n] < covered.get(k, 0):
                    continue
                for hit in self.overlaps(tokens, k, int(diagonal[n])):
                    found.append(hit)
                    if hit[4] >= MIN_SIMILARITY * (self.starts[k + 1] - self.starts[k]):
                        covered[k] = max(covered.get(k, 0), hit[2])
        if self.short:
            found += self.find_short(tokens)
        return found

    def diagonals(self, tokens: np.ndarray, pairs: np.ndarray, mask: str, known: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, diagonal, document position of a seed on it) of the places where seeds of the document and of items meet.

        A seed that repeats from one token to the next, in the document and in an item, stays on its diagonal; such pairs
        are left out but for the first, so long runs of one token make few pairs.
        """
        at, hashes = self.hashes(tokens, mask, pairs)
        goes_on = _goes_on(at, hashes)
        for rows, (seeds, places) in ((~goes_on, known[0]), (goes_on, known[1])):
            left, right = np.searchsorted(seeds, hashes[rows], "left"), np.searchsorted(seeds, hashes[rows], "right")
            some = right > left
            here, left, many = at[rows][some], left[some], (right - left)[some]
            ends = np.cumsum(many)
            start = 0
            while start < len(here):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD_PAIRS, "right")))
                n = many[start:stop]
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                place = places[np.repeat(left[start:stop], n) + within]
                item = np.searchsorted(self.starts, place, "right") - 1
                first = np.repeat(here[start:stop], n)
                yield _first_of(item, first - (place - self.starts[item]), first)
                start = stop

    def overlaps(self, tokens: np.ndarray, k: int, diagonal: int) -> Iterator[tuple[int, int, int, int, int, float]]:
        """Overlaps of the document with item k, whose first token lies at document position `diagonal`."""
        item = self.tokens[self.starts[k] : self.starts[k + 1]]
        low, high = max(0, -diagonal), min(len(item), len(tokens) - diagonal)
        same = item[low:high] == tokens[low + diagonal : high + diagonal]
        least = min(MIN_TOKENS, len(item))
        while np.count_nonzero(same) >= least:  # the stretch with most matches, then that of what lies outside it
            total = np.concatenate([[0], np.cumsum(np.where(same, 1, -MISMATCH))])
            count = np.concatenate([[0], np.cumsum(same)])
            # for every end the earliest start from which the sum is not negative: no other start has more matches
            starts = np.searchsorted(-np.minimum.accumulate(total), -total, "left")
            matched = count - count[starts]
            end = int(matched.argmax())
            matches = int(matched[end])
            if matches < least:
                return
            start = int(starts[end])
            start += int(same[start:end].argmax())  # the end is the first with so many matches, so it is a match itself
            at = low + diagonal + start
            yield self.ids[k], at, at + end - start, low + start, matches, matches / (end - start)
            same = same.copy()
            same[start:end] = False

    def find_short(self, tokens: np.ndarray) -> list[tuple[int, int, int, int, int, float]]:
        found = []
        for (first, n), items in self.short.items():
            for at in np.flatnonzero(tokens[: max(0, len(tokens) - n + 1)] == first):
                for k in items:
                    if (tokens[at : at + n] == self.tokens[self.starts[k] : self.starts[k + 1]]).all():
                        found.append((self.ids[k], int(at), int(at) + n, 0, n, 1.0))
        return found


def _slices(benchmark: DataFrame, slice_tokens: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The items of each slice, and whether it is the only one."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    many = -(-total // (6 * slice_tokens)) or 1  # about six characters to a token
    for k in range(many):
        part = items if many == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == k)
        yield sorted(map(tuple, part.collect())), many == 1


def _with_hits(docs: DataFrame, items: list[tuple[int, str]], text_col: str, name: str) -> DataFrame:
    """docs with a column of overlaps with the items of one slice."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = StructType.fromDDL(HIT)
    names = [f.name for f in kind]
    at = docs.columns.index(text_col)
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("doc_start", pa.int32()), ("doc_end", pa.int32()), ("item_start", pa.int32()), ("matches", pa.int32()), ("similarity", pa.float64())]))
    shared = spark.sparkContext.broadcast(SeedIndex(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        words = pa.array(list(index.vocabulary), pa.string())
        for batch in batches:
            found = [[dict(zip(names, h, strict=True)) for h in hits] for hits in index.find_all(batch.column(at), words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow)], [*batch.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, ArrayType(kind))]))


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """One row per overlap: id, item_id, doc_start, doc_end, item_start (token positions), matches, similarity.

    Null and empty texts have no overlaps, nor has anything when the benchmark is empty; items with a null id or text
    are ignored. An item shorter than a mask must occur whole. Repeated rows give their overlaps each; other columns are
    ignored. Slices beyond the first are done one by one, and what they find is written before the next.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for items, alone in _slices(benchmark, slice_tokens):
        hits = _with_hits(rows, items, "text", "hits").select("id", F.explode("hits").alias("hit")).select("id", "hit.*")
        hits = hits if alone else written(hits)
        found = hits if found is None else found.unionByName(hits)
    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", slice_tokens: int = SLICE_TOKENS) -> DataFrame:
    """docs without the rows that overlap a benchmark item; all columns stay, whatever their names."""
    name = "__hits"
    while name in docs.columns:
        name = "_" + name
    for items, alone in _slices(benchmark, slice_tokens):
        docs = _with_hits(docs, items, text_col, name).where(F.size(name) == 0).drop(name)
        docs = docs if alone else written(docs)
    return docs
