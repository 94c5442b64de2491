"""Parity sketches of word multisets: the signatures that problems 3 and 5 join on.

Each occurrence of a word ("the" first, "the" second, ...) is an element with a 64-bit hash. A sketch is
the XOR over elements, so an element shared by two documents cancels out of their difference and only the
symmetric difference D is left:

* ``bits``: 512 parities. The Hamming distance of two documents' bits is at most D, so a pair further apart than
  the largest D the threshold allows is rejected without looking at words.
* ``keys``: pigeonhole segments. The elements are split by hash into S segments, each XORed to one key; D differing
  elements can touch at most D segments, so with D < S one key is equal for certain. Up to ``LONG`` words S grows with the
  size band, and a document signs in its own band and the next larger one, so that any two sizes the threshold
  allows share a band; all longer documents share one band. Sentences of ``SENTENCE_WORDS`` words are segments as well: edits
  that come in one piece leave the other sentences' keys untouched, even where all documents share them.
* ``keys``, too: ``GROUPS`` groups of ``DEEP`` least hashes of the elements, for edits scattered all over long texts, where
  D may be half the words. A group is equal with probability j^DEEP, j the texts' Jaccard similarity, whatever the
  length; at a similarity of 0.75 (j = 0.6) one of the groups is with 1 - (1 - 0.6^DEEP)^GROUPS = 0.95, at 0.775 with 0.98, at
  0.8 with 0.995. Words that more than ``COMMON`` of all documents have come last there (``common_words``): what most
  postings say makes no candidates, and a group of near copies may still be a third of all rows.
* ``class_id``: a hash of the sum over elements and of n; the same for the same multiset of words.
* ``words``: the 32-bit element hashes, for the exact check.

Of copies that one task meets, only the first carries keys and words (``lead``): a text that a third of all rows
repeat then costs one row of keys per task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from vocandra.llm.lines import NO_LETTERS, NO_SCOPE, frequent_lines, line_hashes, repeated_lines, scopes
from vocandra.session import is_small, stage, unstage

#: Twice the words in common over all words of both.
THRESHOLD = 0.75
#: Neighbouring size bands are this factor apart: the largest ratio of sizes within the threshold.
BAND = (2 - THRESHOLD) / THRESHOLD
#: Words a segment has on average, by the size up to which it holds: short texts can afford many small segments.
SEGMENT_WORDS = ((40, 3), (100, 10))
#: Words from which on all documents share one band, and its segments.
LONG, LONG_SEGMENTS = 100, 5
SENTENCE_WORDS = 16
#: Groups of least hashes, and hashes a group.
GROUPS, DEEP = 38, 5
#: Wide enough for the distance of two texts of a few hundred words not to saturate.
BITS = 512
#: Share of all documents from which on a word's hashes are not below ``FLOOR``, half of their range: the least hashes are
#: those of other words, if there are some.
COMMON, FLOOR = 0.35, 1 << 63
#: Bytes of the frequent lines' file up to which their hashes are sent to the workers; beyond, lines are cut by a join.
SENT_BYTES = 16 << 20
#: Texts that are signed at a time: their elements stay in the processor's cache.
AT_ONCE = 256

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[\n.!?;]+")
#: Lower-cases ASCII letters, keeps digits, marks ends of sentences and puts blanks for all else.
ASCII = {i: chr(i).lower() if chr(i).isalnum() else "\1" if chr(i) in "\n.!?;" else " " for i in range(128)}
U = np.uint64
SCHEMA = "job_id long, class_id long, row_id long, lead boolean, n int, " + "".join(f"bits{i} long, " for i in range(BITS // 64)) + "keys array<long>, words binary"
#: Class ids a task remembers to tell first from later copies; forgetting only costs a repeated row of keys.
REMEMBERED = 1_000_000


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser; different seeds give independent hashes."""
    x = (x ^ U((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(29))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


MULTIPLIERS = mix(np.arange(1, GROUPS * DEEP + 1, dtype=U), 12) | U(1)


def least_hashes(element: np.ndarray, starts: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """(documents, GROUPS): a key of each group, of elements grouped by document; every document has one at least.

    floor: 0, or for common words the half of the range that their hashes can't go below.
    """
    x = mix(element, 13)
    level = np.empty_like(x)
    out = np.empty((len(starts), GROUPS), U)
    for g in range(GROUPS):
        key = np.full(len(starts), g + 1, U)
        for m in MULTIPLIERS[g * DEEP : (g + 1) * DEEP]:
            np.multiply(x, m, out=level)
            np.bitwise_or(level, floor, out=level)
            key = mix(key ^ np.minimum.reduceat(level, starts), 14)
        out[:, g] = key
    return out


def segments_of(n: int) -> list[tuple[int, int]]:
    """(band, number of segments) of the one or two bands a document of n words signs in."""
    last = int(math.log(LONG) / math.log(BAND))
    band = min(int(math.log(max(n, 1)) / math.log(BAND) + 1e-9), last)
    words = {b: next(w for size, w in SEGMENT_WORDS if BAND**b <= size) for b in (band, band + 1) if b < last}
    return [(b, max(5, round(BAND**b / w))) for b, w in words.items()] + [(last, LONG_SEGMENTS)] * (band >= last - 1)


class Words(dict):
    """Numbers words as they come, with their hashes and floors; the first two are ends, not words."""

    def __init__(self, common: set[str]) -> None:
        super().__init__()
        self.common = common
        self.hashes: list[int] = []
        self.floors: list[int] = []
        self["\0"], self["\1"]

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self.floors.append(FLOOR if word in self.common else 0)
        return number


class Signer:
    """Turns texts into signature columns. common: words whose hashes have a floor."""

    def __init__(self, common: set[str] = frozenset()) -> None:
        self.words = Words(common)
        self.met: set[tuple[int, int]] = set()
        self.rows = 0

    def sign(self, ids: list[int], texts: list[str], parts: list[int]) -> pd.DataFrame:
        return self.sign_arrow(ids, texts, parts).to_pandas()

    def sign_arrow(self, ids: list[int], texts: list[str], parts: list[int]) -> pa.Table:
        batches = [self._some(ids[i : i + AT_ONCE], texts[i : i + AT_ONCE], parts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE)]
        return pa.concat_tables(batches) if batches else pa.table({})

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """(document, element, floor) of all words, grouped by document, the documents' numbers of words, and
        (document, key) of the long sentences."""
        if len(self.words) > 1_000_000:
            self.words = Words(self.words.common)
        found = " \0 ".join([*map(spaced_words, texts), ""]).split()
        number = np.fromiter(map(self.words.__getitem__, found), np.int64, len(found))
        hashes = np.array(self.words.hashes, U)
        ends = np.flatnonzero(number < 2)
        lengths = np.diff(np.concatenate([[-1], ends])) - 1
        owner = np.cumsum(number[ends] == 0) - (number[ends] == 0)  # of each sentence
        n = np.bincount(owner, lengths, minlength=len(texts)).astype(np.int64)
        plain = np.delete(number, ends)
        long = np.flatnonzero(lengths >= SENTENCE_WORDS)
        mixed = np.concatenate([mix(hashes, 8)[plain], np.zeros(1, U)])
        first = np.cumsum(lengths) - lengths
        spans = np.stack([first[long], first[long] + lengths[long]], 1).ravel()
        sentences = mix(np.bitwise_xor.reduceat(mixed, spans)[::2], 9) if len(long) else np.zeros(0, U)

        order = (np.repeat(np.arange(len(texts)), n) << 32) | plain
        order.sort()
        d, plain = order >> 32, order & 0xFFFFFFFF
        first = np.ones(len(order), bool)
        first[1:] = order[1:] != order[:-1]
        run = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        occurrence = (np.arange(len(order)) - run).astype(U)
        element = mix(hashes[plain] + occurrence * U(0x632BE59BD9B4E019), 1)
        return d, element, np.array(self.words.floors, U)[plain], n, (owner[long], sentences)

    def _some(self, ids: list[int], texts: list[str], parts: list[int]) -> pa.Table:
        d, element, floor, n, sentences = self._read(texts)
        docs = len(texts)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        filled = n > 0
        sums = []
        for seed in (2, 3):
            out = np.zeros(docs, U)
            if len(element):
                out[filled] = np.add.reduceat(mix(element, seed), starts[filled])
            sums.append(out)
        class_id = mix(sums[0] ^ mix(sums[1], 4), 10).view(np.int64)
        lead = []
        for c in zip(class_id.tolist(), parts):
            lead.append(c not in self.met)
            if len(self.met) >= REMEMBERED:
                self.met.clear()
            self.met.add(c)
        lead = np.array(lead)
        parity = np.bincount(d * BITS + (element & U(BITS - 1)).astype(np.int64), minlength=docs * BITS) & 1
        bits = np.packbits(parity.astype(np.uint8).reshape(docs, BITS), axis=1, bitorder="little").view(np.int64).reshape(docs, BITS // 64)

        # Later copies have no keys and words, so the rest looks at leads only.
        d, element, floor, n = d[lead[d]], element[lead[d]], floor[lead[d]], n
        m = np.where(lead, n, 0)
        starts = np.concatenate([[0], np.cumsum(m)[:-1]])
        owners, keys = self._segment_keys(d, element, m)
        told = lead[sentences[0]]
        owners.append(sentences[0][told])
        keys.append(sentences[1][told])
        some = np.flatnonzero(m)
        if len(some):
            owners.append(np.repeat(some, GROUPS))
            keys.append(least_hashes(element, starts[some], floor).ravel())
        owner, key = np.concatenate(owners), np.concatenate(keys)
        key = key[np.argsort(owner, kind="stable")].view(np.int64)
        key_ends = np.cumsum(np.bincount(owner, minlength=docs))
        words = (element >> U(32)).astype(np.uint32)
        number = self.rows + np.arange(docs) + ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 33)
        self.rows += docs
        offsets = lambda ends: pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
        columns = {
            "job_id": pa.array(ids, pa.int64()),
            "class_id": pa.array(class_id),
            "row_id": pa.array(number),
            "lead": pa.array(lead),
            "n": pa.array(n.astype(np.int32)),
            **{f"bits{i}": pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITS // 64)},
            "keys": pa.ListArray.from_buffers(pa.list_(pa.int64()), docs, [None, offsets(key_ends)], children=[pa.array(key)]),
            "words": pa.BinaryArray.from_buffers(pa.binary(), docs, [None, offsets(4 * np.cumsum(m)), pa.py_buffer(words)]),
        }
        return pa.table(columns)

    def _segment_keys(self, d: np.ndarray, element: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        owners, keys = [], []
        h = mix(element, 5)
        sizes = {int(x): segments_of(int(x)) for x in np.unique(n)}
        for which in (0, 1):
            # A document with one band has no segments in the second.
            segments = np.array([sizes[x][which][1] if which < len(sizes[x]) else 0 for x in n.tolist()], np.int64)
            bands = np.array([sizes[x][which][0] if which < len(sizes[x]) else 0 for x in n.tolist()], np.int64)
            inside = segments[d] > 0
            doc, own = d[inside], h[inside]
            base = np.concatenate([[0], np.cumsum(segments)])
            place = base[doc] + ((own >> U(33)) % segments[doc].astype(U)).astype(np.int64)
            by = np.argsort(place, kind="stable")
            at = np.flatnonzero(np.r_[True, place[by][1:] != place[by][:-1]]) if len(by) else np.zeros(0, int)
            if len(at):
                xor = np.bitwise_xor.reduceat(own[by], at)
                owner = doc[by][at]
                number = (place[by][at] - base[owner]).astype(U)
                owners.append(owner)
                keys.append(mix(xor + number * U(0x2545F4914F6CDD1D) + (bands[owner].astype(U) << U(48)), 7))
        return owners, keys


def spaced_words(text: str) -> str:
    """The lower-cased words (runs of letters and digits) of a text and its ends of sentences, parted by blanks."""
    if text.isascii():
        return text.translate(ASCII).replace("\1", " \1 ")
    return " \1 ".join([" ".join(WORD.findall(part)) for part in SENTENCE.split(text.lower())])


def alike_text(title: str | None, company: str | None, kept_lines: list[str]) -> str:
    return "\n".join([title or "", company or "", *kept_lines])


def common_words(jobs: DataFrame) -> set[str]:
    """The words that more than ``COMMON`` of the documents have; counts are of all documents.

    At most (mean words per document) / ``COMMON`` words can have that share, however many documents there are.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        documents = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for title, company, text in zip(*[batch.column(c).to_pylist() for c in ("title", "company", "description")]):
                held.update(set(spaced_words(alike_text(title, company, [text])).split()))
                documents += 1
            if len(held) > 300_000:
                yield flush()
        held["\0"] = documents
        yield flush()

    rows = jobs.filter(F.col("description").rlike(r"\S")).select("title", "company", "description")
    # The number of documents rides along as a word of its own.
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1")
    counts = stage(counts, "word-counts")
    total = counts.filter(F.col("word") == "\0").select(F.col("n").alias("documents"))
    found = counts.crossJoin(F.broadcast(total)).filter((F.col("n") > COMMON * F.col("documents")) & (F.col("word") > "\1"))  # one row
    out = {r["word"] for r in found.select("word").collect()}
    unstage(counts)
    return out


def signatures(jobs: DataFrame, frequent: DataFrame | None = None, part: Column | None = None, carry: tuple[str, ...] = (), common: set[str] | None = None) -> DataFrame:
    """Signatures of the jobs with non-blank descriptions, over title, company and the lines that are not frequent.

    Jobs without any word in these are left out: they have no words in common with anything. ``part`` splits the table;
    each part has its own first copies. Columns in ``carry`` are taken along. Rows whose part is null are left out.
    ``frequent`` (staged) and ``common`` are found in ``jobs`` unless given.
    """
    frequent = frequent_lines(jobs) if frequent is None else frequent
    common_at = jobs.sparkSession.sparkContext.broadcast(common_words(jobs) if common is None else common)
    source, company = scopes(jobs)
    rows = jobs.filter(F.col("description").rlike(r"\S")).withColumn("_part", F.lit(0) if part is None else part).filter("_part IS NOT NULL")
    columns = ["job_id", "title", "company", "description", "_part", *carry]
    if is_small(frequent, SENT_BYTES):
        table = frequent.toPandas()
        wanted = np.unique(mix(table["scope"].to_numpy(np.int64).view(U), 11) ^ table["line"].to_numpy(np.int64).view(U))
        wanted_at = jobs.sparkSession.sparkContext.broadcast(wanted)
        rows = rows.select(*columns, source.alias("by_source"), F.coalesce(company, F.lit(NO_SCOPE)).alias("by_company"), line_hashes(F.col("description")).alias("lines"))
    else:
        wanted_at = None
        cut = repeated_lines(jobs, frequent).groupBy("job_id").agg(F.collect_set("line_no").alias("cut"))
        rows = rows.select(*columns).join(cut, "job_id", "left")

    def kept_texts(batch: pa.RecordBatch) -> list[str]:
        given = [batch.column(c).to_pylist() for c in ("title", "company", "description")]
        if wanted_at is None:
            gone = [set(x or ()) for x in batch.column("cut").to_pylist()]
            return [alike_text(t, c, [x for i, x in enumerate(text.split("\n"), 1) if i not in cut]) for t, c, text, cut in zip(*given, gone)]
        lists = batch.column("lines")
        counts = np.diff(lists.offsets.to_numpy())
        line = lists.flatten().to_numpy().view(U)
        hit = np.zeros(len(line), bool)
        for by in ("by_source", "by_company"):
            scope = np.repeat(batch.column(by).to_numpy(), counts)
            hit |= (scope != NO_SCOPE) & np.isin(mix(scope.view(U), 11) ^ line, wanted_at.value)
        hit &= line != np.array([NO_LETTERS], np.int64).view(U)[0]
        out, at = [], 0
        for title, name, text, m in zip(*given, counts.tolist()):
            gone = hit[at : at + m]
            at += m
            out.append(alike_text(title, name, [x for x, g in zip(text.split("\n"), gone.tolist()) if not g]) if gone.any() else alike_text(title, name, [text]))
        return out

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(common_at.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 8 * AT_ONCE):
                some = batch.slice(start, 8 * AT_ONCE)
                part = some.column("_part")
                signed = signer.sign_arrow(some.column("job_id").to_pylist(), kept_texts(some), part.to_pylist())
                signed = signed.append_column("part", part)
                for c in carry:
                    signed = signed.append_column(c, some.column(c))
                yield from signed.filter(pa.compute.greater(signed["n"], 0)).to_batches()

    schema = StructType([*StructType.fromDDL(SCHEMA), StructField("part", IntegerType()), *[jobs.schema[c] for c in carry]])
    return rows.mapInArrow(sign, schema)
