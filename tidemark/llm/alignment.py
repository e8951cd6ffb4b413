"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how usual each pairing is.

Both tokenizers see a text as bytes, and a link joins two tokens whose byte ranges overlap. Neither has a token that
reaches over a space between two other characters, so a text is cut there and each distinct chunk is encoded once a worker.
Scan tasks write the links of a batch of documents in stripes: a pair of ids belongs to the stripe of its B id, counted
round and round, so neighbouring (equally usual) ids go to different stripes. Each stripe's counts are added up in a dense
int64 matrix of its B ids by all A ids, whose size the vocabularies fix, and row maxima mark the best partners. The links
then come to their stripe's counts; the sums that leave there are added up for each document.

A pair that holds a large share of all links is one cell of its stripe for each batch, however often it occurs there, and a
stripe with many batches is dealt to several tasks, each with the stripe's counts.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from .common import discard, written

#: Cells of a stripe's matrix (8 bytes each).
STRIPE_CELLS = 1 << 23
#: Documents and bytes of one batch of links; links of a stripe that one task scores, about.
BATCH_DOCS = 4096
BATCH_BYTES = 2_000_000
TASK_LINKS = 50_000_000
#: Chunks that a worker remembers, and links from which on it forgets them; chunks encoded at once; pairs that a counting task holds; sums that a scoring task holds.
CACHE_CHUNKS = 300_000
CACHE_LINKS = 8_000_000
LEARN_CHUNKS = 20_000
HELD_PAIRS = 4_000_000
HELD_DOCS = 2_000_000
#: sentencepiece's mark of a space, and its pieces for single bytes.
SPACE = "▁"
#: A space between two other characters: no token of either tokenizer has it inside.
_cut = re.compile(r"(?<=\S) (?=\S)").split


def byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenizerPair:
    """Both tokenizers with the bytes of their tokens: A from a tokenizers file (byte-level), B from a sentencepiece file."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.size_a, self.size_b = 1 + max(vocabulary.values()), self.b.get_piece_size()
        self.bytes_a = [b""] * self.size_a
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(alphabet.__getitem__, token))
        pieces = map(self.b.id_to_piece, range(self.size_b))
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(pieces)]
        self.stripes = -(-self.size_b * self.size_a // STRIPE_CELLS)
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        ids = [range(self.size_a), range(self.size_a), range(self.size_b), range(self.size_b)]
        self.written = [f"{i}{end}" for own, end in zip(ids, ",|,;") for i in own]  # ids as groups have them, by side and place
        self.widths = np.array([len(x) for x in self.written], np.int64)
        self.forget()

    def forget(self) -> None:
        """Empties the memory of chunks: their places, groups, sizes (n_a, n_b, n_groups, n_links; n_a -1 where bytes differ) and links."""
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes = np.zeros((0, 4), np.int64)
        self.starts, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def key(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Stripe and cell of a pair of ids as one number, stripe first."""
        return (b % self.stripes) * STRIPE_CELLS + (b // self.stripes) * self.size_a + a

    def _tokens(self, ids: list[list[int]], table: list[bytes], lengths: np.ndarray, data: list[bytes], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, how many each chunk has, and whether their bytes are the chunk's."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, n.sum())
        ends = np.concatenate([[0], np.cumsum(lengths[flat])])[np.cumsum(n)]
        if np.array_equal(ends, bounds) and b"".join(map(table.__getitem__, flat.tolist())) == b"".join(data):
            return flat, n, np.ones(len(ids), bool)
        return flat, n, np.array([b"".join(map(table.__getitem__, own)) == x for own, x in zip(ids, data)])

    def learn(self, chunks: list[str]) -> None:
        """Encodes chunks, each after a space, and aligns them all at once: their tokens as if they followed each other."""
        data = [b" " + x.encode() for x in chunks]
        size = np.fromiter(map(len, data), np.int64, len(data))
        a = [e.ids for e in self.a.encode_batch_fast([" " + x for x in chunks], add_special_tokens=False)]
        ids_a, n_a, good_a = self._tokens(a, self.bytes_a, self.lengths_a, data, np.cumsum(size))
        b = self.b.encode(chunks, num_threads=1)
        ids_b, n_b, good_b = self._tokens(b, self.bytes_b, self.lengths_b, data, np.cumsum(size))
        good = good_a & good_b
        if not good.all():
            ids_a, ids_b, size = ids_a[np.repeat(good, n_a)], ids_b[np.repeat(good, n_b)], size * good
            n_a, n_b = n_a * good, n_b * good
        ends_a, ends_b = np.cumsum(self.lengths_a[ids_a]), np.cumsum(self.lengths_b[ids_b])
        marks = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.int8)
        marks[ends_a] = 1
        marks[ends_b] += 2
        cuts, both = np.flatnonzero(marks), np.flatnonzero(marks == 3)
        # every stretch between cuts lies in one token of each side: a link
        links = self.key(ids_a[np.searchsorted(ends_a, cuts)], ids_b[np.searchsorted(ends_b, cuts)])
        upto, groups = (np.searchsorted(x, np.cumsum(size), "right") for x in (cuts, both))
        n_links, n_groups = np.diff(upto, prepend=0), np.diff(groups, prepend=0)
        self.starts = np.concatenate([self.starts, len(self.links) + upto - n_links])
        self.links = np.concatenate([self.links, links])
        self.sizes = np.concatenate([self.sizes, np.stack([np.where(good, n_a, -1), n_b, n_groups, n_links], axis=1)])
        # groups in writing: A's ids of a group, then B's
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)] = ids_a + self.size_a * (marks[ends_a] == 3)
        code[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")] = 2 * self.size_a + ids_b + self.size_b * (marks[ends_b] == 3)
        text = "".join(map(self.written.__getitem__, code.tolist()))
        at = np.concatenate([[0], np.cumsum(self.widths[code])])[np.cumsum(n_a + n_b)].tolist()
        first = len(self.known)
        self.known.update(zip(chunks, range(first, first + len(chunks))))
        self.groups += [text[i : j - 1] if j > i else "" for i, j in zip([0, *at], at)]

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """n_a, n_b, n_groups, n_links (a row a text) and groups of texts; and sorted (key, slot of the text) with their numbers."""
        chunks = [_cut(x) if x else [] for x in texts]
        new = list(dict.fromkeys(c for own in chunks for c in own if c not in self.known))
        if new and (len(self.known) + len(new) > CACHE_CHUNKS or len(self.links) > CACHE_LINKS):
            self.forget()
            new = list(dict.fromkeys(c for own in chunks for c in own))
        for i in range(0, len(new), LEARN_CHUNKS):
            self.learn(new[i : i + LEARN_CHUNKS])
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(chunks)), np.int64, lengths.sum())
        slot = np.repeat(np.arange(len(texts)), lengths)
        bad = np.zeros(len(texts), bool)
        bad[slot[self.sizes[at, 0] < 0]] = True
        ends, places = np.cumsum(lengths).tolist(), at.tolist()
        groups = [";".join(map(self.groups.__getitem__, places[i:j])) if not no else "" for i, j, no in zip([0, *ends], ends, bad.tolist())]
        good = ~bad[slot]
        at, slot = at[good], slot[good]
        sizes = np.zeros((len(texts), 4), np.int64)
        for k in range(4):
            np.add.at(sizes[:, k], slot, self.sizes[at, k])
        pairs, times = np.unique(at << 16 | slot, return_counts=True)  # a chunk's repeats in a text
        at = pairs >> 16
        lengths = self.sizes[at, 3]
        place = np.repeat(self.starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
        links = self.links[place] << 16 | np.repeat(pairs & 0xFFFF, lengths)
        order = np.argsort(links)
        links, times = links[order], np.repeat(times, lengths)[order]
        first = np.flatnonzero(np.r_[True, links[1:] != links[:-1]]) if len(links) else np.empty(0, np.int64)
        links = links[first]
        return sizes, groups, links >> 16, links & 0xFFFF, np.add.reduceat(times, first) if len(first) else times


@cache
def _tokenizers(path_a: str, path_b: str) -> TokenizerPair:
    return TokenizerPair(path_a, path_b)


def _documents_type(id_field: StructField) -> StructType:
    counts = [StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    return StructType([StructField("id", id_field.dataType), *counts, StructField("groups", StringType())])


_LINKS = ["cells", "sizes", "slots", "times"]


def linked(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, groups: str) -> DataFrame:
    """Batches of documents: a row of stripe -1 with their counts and groups, and one for each stripe with links.

    A stripe's row has its cells (ascending), how many texts have each cell, and the slot of each such text in the batch
    with the number of its links there, all as packed numbers.
    """
    one = _documents_type(docs.schema[id_col])
    schema = StructType([StructField("batch", StringType()), StructField("stripe", IntegerType()), StructField("docs", ArrayType(one)), StructField("links", LongType()), *(StructField(n, BinaryType()) for n in _LINKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        pair, target = _tokenizers(path_a, path_b), to_arrow_schema(schema)
        for batch in batches:
            ids, texts = batch.columns
            at, sizes = 0, pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            while at < len(ids):
                upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at : at + BATCH_DOCS]), BATCH_BYTES)))
                sizes_of, text, keys, slots, times = pair.align(texts[at:upto].to_pylist())
                own = ids[at : min(upto, len(ids))]
                at = upto
                if groups == "sha256":
                    text = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in text]
                fields = [own, *(pa.array(x) for x in sizes_of.T.copy()), pa.array(text, pa.string())]
                packed = pa.StructArray.from_arrays(fields, fields=list(target.field("docs").type.value_type))
                docs_column = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), packed)
                stripe, cells = keys // STRIPE_CELLS, keys % STRIPE_CELLS
                edges = np.flatnonzero(np.r_[True, stripe[1:] != stripe[:-1], True]) if len(keys) else [0]
                columns: dict[str, list] = {n: [None] for n in _LINKS}
                stripes, links = [-1], [0]
                for i, j in zip(edges, edges[1:]):
                    first = np.flatnonzero(np.r_[True, cells[i + 1 : j] != cells[i : j - 1]])
                    stripes.append(int(stripe[i]))
                    links.append(int(j - i))
                    parts = cells[i:j][first].astype("<i4"), np.diff(np.r_[first, j - i]).astype("<u2"), slots[i:j].astype("<u2"), times[i:j].astype("<u4")
                    for n, x in zip(_LINKS, parts):
                        columns[n].append(x.tobytes())
                name, rest = uuid.uuid4().hex, len(stripes) - 1
                lists = pa.concat_arrays([docs_column.cast(target.field("docs").type), pa.nulls(rest, target.field("docs").type)])
                yield pa.RecordBatch.from_arrays([pa.array([name] * (rest + 1)), pa.array(stripes, pa.int32()), lists, pa.array(links, pa.int64()), *(pa.array(columns[n], pa.binary()) for n in _LINKS)], schema=target)

    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def _unpacked(sizes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(sizes, "<u2").astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stripe, cells, counts) of what a task reads, each cell once as long as the held pairs fit."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> pa.RecordBatch:
        rows = []
        for stripe, parts in held.items():
            cells, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.zeros(len(cells), np.int64)
            np.add.at(counts, place, np.concatenate([n for _, n in parts]))
            rows.append((stripe, cells.astype("<i4").tobytes(), counts.astype("<i8").tobytes()))
        held.clear()
        columns = zip(*rows) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], ["stripe", "cells", "counts"])

    for batch in batches:
        for stripe, cells, sizes, times in zip(*(c.to_pylist() for c in batch.columns)):
            sizes, times = _unpacked(sizes, times)
            starts = np.cumsum(sizes) - sizes
            held.setdefault(stripe, []).append((np.frombuffer(cells, "<i4"), np.add.reduceat(times, starts)))
            size += len(sizes)
        if size > HELD_PAIRS:
            yield out()
            size = 0
    yield out()


def _by_stripe(rows: int, width: int):
    """A function that adds up each stripe's counts in a dense matrix; stripes come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, now = np.zeros(rows * width, np.int64), None

        def out() -> pa.RecordBatch:
            cells = np.flatnonzero(matrix)
            counts = matrix[cells]
            best = counts == matrix.reshape(rows, width).max(axis=1)[cells // width]
            matrix[cells] = 0
            columns = [pa.array([x]) for x in (now, cells.astype("<i4").tobytes(), counts.tobytes(), best.tobytes())]
            return pa.RecordBatch.from_arrays([columns[0].cast(pa.int32()), *columns[1:]], ["stripe", "cells", "counts", "best"])

        for batch in batches:
            for stripe, cells, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if now is not None and stripe != now:
                    yield out()
                now = stripe
                np.add.at(matrix, np.frombuffer(cells, "<i4"), np.frombuffer(counts, "<i8"))
        if now is not None:
            yield out()

    return run


def stripe_counts(links: DataFrame, pair: TokenizerPair) -> DataFrame:
    """(stripe, cells, counts, best), one row per stripe: the linked pairs of ids, packed; best: none of its row counts more."""
    partial = links.where("stripe >= 0").select("stripe", "cells", "sizes", "times").mapInArrow(_partial_counts, "stripe int, cells binary, counts binary")
    together = partial.repartition("stripe").sortWithinPartitions("stripe")
    rows = -(-pair.size_b // pair.stripes)
    return together.mapInArrow(_by_stripe(rows, pair.size_a), "stripe int, cells binary, counts binary, best binary")


def _scores(cells_most: int):
    """A function that looks up the links of a task in their stripe's counts, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = np.zeros(cells_most, np.int64), np.zeros(cells_most, bool)
        known = np.empty(0, np.int32)
        held: dict[str, np.ndarray] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = []
            for name, sums in held.items():
                slots = np.flatnonzero(sums[1])
                rows.append((name, slots.astype("<u2").tobytes(), sums[0, slots].astype("<u4").tobytes(), sums[1, slots].tobytes()))
            held.clear()
            columns = zip(*rows) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.binary(), pa.binary(), pa.binary()))], ["batch", "slots", "n_best", "sums"])

        for rows in batches:
            for name, cells, counts, good, sizes, slots, times in zip(*(c.to_pylist() for c in rows.columns)):
                cells = np.frombuffer(cells, "<i4")
                if name is None:
                    count[known], best[known] = 0, False
                    count[cells], best[cells], known = np.frombuffer(counts, "<i8"), np.frombuffer(good, bool), cells
                    continue
                sizes, times = _unpacked(sizes, times)
                slots = np.frombuffer(slots, "<u2").astype(np.int64)
                sums = held.get(name)
                if sums is None or sums.shape[1] <= slots.max():
                    wide = np.zeros((2, int(slots.max()) + 1), np.int64)
                    if sums is not None:
                        wide[:, : sums.shape[1]] = sums
                        size -= sums.shape[1]
                    sums = held[name] = wide
                    size += wide.shape[1]
                np.add.at(sums[0], slots, np.repeat(best[cells], sizes) * times)
                np.add.at(sums[1], slots, np.repeat(count[cells], sizes) * times)
            if size > HELD_DOCS:
                yield out()
                size = 0
        yield out()

    return run


def _summed(schema: StructType):
    """A function that adds a batch's partial sums to its documents, which come first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, docs, sums = to_arrow_schema(schema), None, np.zeros((2, 0), np.int64)

        def out() -> pa.RecordBatch:
            columns = docs.flatten()
            added = [pa.array(x, pa.int64()) for x in sums]
            return pa.RecordBatch.from_arrays([*columns[:5], *added, columns[5]], schema=target)

        for rows in batches:
            for i, (slots, n_best, part) in enumerate(zip(*(rows.column(n).to_pylist() for n in ("slots", "n_best", "sums")))):
                if slots is None:
                    if docs is not None:
                        yield out()
                    docs = rows.column("docs").slice(i, 1).flatten()
                    sums = np.zeros((2, len(docs)), np.int64)
                else:  # a batch has each slot once
                    at = np.frombuffer(slots, "<u2")
                    sums[0, at] += np.frombuffer(n_best, "<u4")
                    sums[1, at] += np.frombuffer(part, "<i8")
        if docs is not None:
            yield out()

    return run


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", groups: str = "text") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups: one row per row of docs.

    A encodes a space and the text, B the text, before which it puts a space itself. Byte offsets where tokens of both end
    cut them into groups, written `a1,a2|b1;a3|b2,b3` (groups="sha256": their digest in place of the text). Links are all
    pairs of tokens with overlapping bytes, repeats included; the count of a pair of ids is how many links of all documents
    it has; n_best are the document's links whose count no other pair of that B id exceeds, count_sum sums over its links.

    Null and empty texts, and texts whose bytes either tokenizer does not give back, have zeros and no groups. Repeated rows
    count as often as they occur and give a row each; texts of any length are read whole; ties are all best; other columns
    are ignored; an empty table gives no rows. Ids of any type, null too.
    """
    pair = _tokenizers(path_a, path_b)
    links = written(linked(docs, path_a, path_b, id_col, text_col, groups), "zstd")
    counts = written(stripe_counts(links, pair), "zstd")
    total = links.agg(F.sum("links")).first()[0] or 0
    salts = max(1, -(-total // (pair.stripes * TASK_LINKS)))
    own = links.where("stripe >= 0").select("batch", "stripe", *_LINKS).withColumn("salt", F.expr(f"pmod(xxhash64(batch), {salts})"))
    copies = counts.withColumn("salt", F.explode(F.expr(f"sequence(0L, {salts - 1}L)")))
    met = own.unionByName(copies, allowMissingColumns=True).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("batch").asc_nulls_first())
    rows = -(-pair.size_b // pair.stripes)
    parts = met.select("batch", "cells", "counts", "best", "sizes", "slots", "times").mapInArrow(_scores(rows * pair.size_a), "batch string, slots binary, n_best binary, sums binary")
    one = _documents_type(docs.schema[id_col])
    schema = StructType([*one.fields[:5], StructField("n_best", LongType()), StructField("count_sum", LongType()), one.fields[5]])
    whole = links.where("stripe = -1").select("batch", "docs").unionByName(parts, allowMissingColumns=True)
    whole = whole.repartition("batch").sortWithinPartitions("batch", F.col("slots").asc_nulls_first())
    return whole.mapInArrow(_summed(schema), schema)


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n, best): every pair of ids that docs link, how often, and whether no other pair of its B id is linked more often."""
    pair = _tokenizers(path_a, path_b)
    links = written(linked(docs, path_a, path_b, id_col, text_col, "sha256"), "zstd")
    width, stripes = pair.size_a, pair.stripes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, cells, counts, best in zip(*(c.to_pylist() for c in batch.columns)):
                cells = np.frombuffer(cells, "<i4").astype(np.int64)
                columns = [cells % width, cells // width * stripes + stripe, np.frombuffer(counts, "<i8"), np.frombuffer(best, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "b", "n", "best"])

    schema = StructType([StructField(n, LongType()) for n in ("a", "b", "n")] + [StructField("best", BooleanType())])
    found = written(stripe_counts(links, pair).mapInArrow(run, schema))
    discard(links)
    return found
