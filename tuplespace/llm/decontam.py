"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max WAND.

Test items are cut into units of at most ``UNIT_WORDS`` words (the last one of a longer
item is as long as the others and overlaps the one before it) and indexed: postings
per term in unit order, in blocks of ``BLOCK_UNITS`` units, each with its largest
impact. Impacts are divided by the unit's own best score, so that a threshold means
a share of a perfect match. Every document is cut into overlapping passages, long
enough that any unit lies whole in one of them. A passage is a query. A unit's
commonest terms, up to the share ``COMMON`` of its score, can't lift it over the
threshold alone, so only postings of its other terms start a search: their block
maxima bound the score of each (passage, block), their impacts that of each
(passage, unit) of the blocks that remain, always with the common terms' share
added, and only what can still reach the threshold is scored in full. Units only find
candidates: an item with a unit above the threshold is verified as a whole on word
runs, by the shares of its question's and of its answer's five-word shingles found. An
item of one unit is looked for in each passage, a longer one in all passages of the
document that hold a unit of it, each widened by the item's words around that unit.

An index shard holds about ``SHARD_UNITS`` units at most (an item that alone has more is a shard with few
others); it is read to the driver under that bound and sent with the tasks. More items
make more shards, one pass and one written table of matches each, so that the driver holds one index at a time.

Words are runs of bytes but white space and ASCII punctuation, A-Z lower-cased. The
answer is an item's last sentence, the question all before it; an item of one
sentence is all question.

Cases: null or empty texts match nothing, nor do items without a word. An item with fewer than five words is one
shingle, its whole sequence. Repeated rows match alike. Matches of a null id
are returned with the null. Further columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuplespace.llm.common import (
    SHINGLE_WORDS, WHITE_SPACE, byte_set, hash_spans, shingle_hashes, small_batches, string_view, text_blocks, word_spans)
from tuplespace.session import cut_lineage

UNIT_WORDS = 128
BLOCK_UNITS = 32
SHARD_UNITS = 2_000
SCORE_SHARE = 0.5
COMMON = 0.25
OVERLAP = 0.75
K1, B = 1.2, 0.75

_WORD_BREAKS = byte_set(WHITE_SPACE + "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_SENTENCE_END = re.compile(r"[.!?]+(?=\s|$)|\n")


def text_words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of every word."""
    data, offsets = string_view(array)
    starts, ends, documents = word_spans(data, offsets, _WORD_BREAKS)
    return hash_spans(data, starts, ends), documents


def question_and_answer(text: str) -> tuple[str, str]:
    cuts = [m.end() for m in _SENTENCE_END.finditer(text.rstrip()) if text[m.end():].strip()]
    return (text[: cuts[-1]], text[cuts[-1]:]) if cuts else (text, "")


def _grams(words: np.ndarray) -> tuple[np.ndarray, int]:
    size = min(SHINGLE_WORDS, len(words))
    if not size:
        return np.zeros(0, np.uint64), 0
    return np.unique(shingle_hashes(words, np.zeros(len(words), np.int64), size)[0]), size


class _Lists:
    """Posting lists: for each term its (target, weight) pairs, targets being units or blocks."""

    def __init__(self, term: np.ndarray, target: np.ndarray, weight: np.ndarray, terms: int):
        order = np.lexsort((target, term))
        self.target, self.weight = target[order], weight[order]
        self.size = np.bincount(term, minlength=terms)
        self.first = np.cumsum(self.size) - self.size

    def sums(self, passage: np.ndarray, term: np.ndarray, targets: int, allow=None):
        """(passage, target, weight sum) over the postings of the (passage, term) rows that ``allow`` admits."""
        size = self.size[term]
        row = np.repeat(np.arange(len(term)), size)
        at = np.repeat(self.first[term] - (np.cumsum(size) - size), size) + np.arange(len(row))
        p, target, weight = passage[row], self.target[at], self.weight[at]
        if allow is not None:
            keep = allow(p, target)
            p, target, weight = p[keep], target[keep], weight[keep]
        key, place = np.unique(p * targets + target, return_inverse=True)
        return key // targets, key % targets, np.bincount(place, weight, len(key))


class ItemIndex:
    """Inverted index of one shard of test units."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[int] = []
        self.grams = []  # per item ((question grams, run length), (answer grams, run length))
        self.units = []  # per unit (its item's place in ``items``, words of the item before it, words after it)
        bags = []
        for item_id, text in items:
            q, a = question_and_answer(text or "")
            words, owner = text_words(pa.array([q, a]))
            q, a = words[owner == 0], words[owner == 1]
            if not len(words):
                continue
            if len(q) < SHINGLE_WORDS:  # too little to ask: the whole item is the question
                q, a = words, words[:0]
            whole = np.concatenate([q, a])
            for end in range(UNIT_WORDS, len(whole) + UNIT_WORDS, UNIT_WORDS):
                end = min(end, len(whole))
                begin = max(end - UNIT_WORDS, 0)
                self.units.append((len(self.items), begin, len(whole) - end))
                bags.append(whole[begin:end])
            self.items.append(item_id)
            self.grams.append((_grams(q), _grams(a)))
        units = len(bags)
        self.unit_words = max([SHINGLE_WORDS, *map(len, bags)])
        self.blocks = -(-units // BLOCK_UNITS)
        if not units:
            self.terms = np.zeros(0, np.uint64)
            return
        lengths = np.array([len(b) for b in bags], float)
        terms, codes = np.unique(np.concatenate(bags), return_inverse=True)
        owner = np.repeat(np.arange(units), lengths.astype(int))
        posting, tf = np.unique(codes * units + owner, return_counts=True)
        term, unit = posting // units, posting % units
        df = np.bincount(term, minlength=len(terms))
        idf = np.log(1 + (units - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[unit])
        impact /= np.bincount(unit, impact, units)[unit]
        self.terms = terms
        self.bag = [dict(zip(term[k].tolist(), impact[k].tolist(), strict=True))
                    for k in np.split(np.argsort(unit, kind="stable"), np.cumsum(np.bincount(unit, minlength=units))[:-1])]
        # Within each unit from the commonest term on: which are common, and their share.
        order = np.lexsort((-df[term], unit))
        sums = np.cumsum(impact[order])
        head = np.searchsorted(unit[order], np.arange(units))
        sums -= np.repeat(sums[head] - impact[order][head], np.bincount(unit, minlength=units))
        leads = np.ones(len(order), bool)
        leads[order[sums <= COMMON]] = False
        self.common = np.bincount(unit[~leads], impact[~leads], units)
        self.postings = _Lists(term[leads], unit[leads], impact[leads], len(terms))
        # Block maxima: per term and block the largest impact of its leading postings.
        key, at = np.unique(term[leads] * self.blocks + unit[leads] // BLOCK_UNITS, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, at, impact[leads])
        self.block_postings = _Lists(key // self.blocks, key % self.blocks, most, len(terms))
        self.block_common = np.zeros(self.blocks)
        np.maximum.at(self.block_common, np.arange(units) // BLOCK_UNITS, self.common)

    def search(self, words: np.ndarray, documents: np.ndarray, share: float):
        """(passage begin, passage end, unit, score) with score at least ``share``; begin and end are places in ``words``."""
        if not len(words) or not len(self.terms):
            return
        place = np.searchsorted(self.terms, words)
        place[place == len(self.terms)] = 0
        known = np.flatnonzero(self.terms[place] == words)
        # Cells of unit_words words; a passage is a cell and the next one of its document.
        head = np.flatnonzero(np.r_[True, documents[1:] != documents[:-1]])
        inside = np.arange(len(words)) - np.repeat(head, np.diff(np.r_[head, len(words)]))
        begins = np.flatnonzero(inside % self.unit_words == 0)
        ends = np.r_[begins[1:], len(words)]
        paired = np.r_[documents[begins[1:]] == documents[begins[:-1]], False]
        passage = paired | np.r_[True, ~paired[:-1]]  # the last cell only if it has no predecessor
        leading = known[self.block_postings.size[place[known]] > 0]
        pairs = np.unique((np.searchsorted(begins, leading, side="right") - 1) * len(self.terms) + place[leading])
        cell, term = pairs // len(self.terms), pairs % len(self.terms)
        second = (cell > 0) & paired[cell - 1]
        cell, term = np.concatenate([cell, cell[second] - 1]), np.concatenate([term, term[second]])
        cell, term = cell[passage[cell]], term[passage[cell]]

        at, block, bound = self.block_postings.sums(cell, term, self.blocks)
        live = bound + self.block_common[block] >= share
        open_ = np.sort(at[live] * self.blocks + block[live])
        at, unit, bound = self.postings.sums(cell, term, len(self.bag), lambda p, u: np.isin(
            p * self.blocks + u // BLOCK_UNITS, open_))
        live = bound + self.common[unit] >= share
        for p, u in zip(at[live].tolist(), unit[live].tolist(), strict=True):
            begin, end = int(begins[p]), int(ends[p + 1] if paired[p] else ends[p])
            a, b = np.searchsorted(known, (begin, end))
            bag = self.bag[u]
            score = sum(bag.get(t, 0.0) for t in set(place[known[a:b]].tolist()))
            if score >= share:
                yield begin, end, u, score

    def overlaps(self, item: int, words: np.ndarray, spans: list[tuple[int, int]]) -> tuple[float, float | None]:
        """Shares of the item's question and answer shingles in the ``spans`` of ``words``; None without an answer."""
        joined = []
        for begin, end in sorted(spans):
            if joined and begin <= joined[-1][1]:
                joined[-1] = joined[-1][0], max(end, joined[-1][1])
            else:
                joined.append((begin, end))
        near = np.concatenate([words[begin:end] for begin, end in joined])
        owner = np.repeat(np.arange(len(joined)), [end - begin for begin, end in joined])
        out = []
        for grams, size in self.grams[item]:
            out.append(float(np.isin(grams, shingle_hashes(near, owner, size)[0]).mean()) if size else None)
        question, answer = out
        return (answer, None) if question is None else (question, answer)

    def matches(self, words: np.ndarray, documents: np.ndarray, share: float, overlap: float):
        """(document, item's place in ``items``, best score of a unit, question and answer overlap) of the items found."""
        found: dict = {}
        for begin, end, unit, score in self.search(words, documents, share):
            item, before, after = self.units[unit]
            document = int(documents[begin])
            if before or after:
                first, last = np.searchsorted(documents, (document, document + 1))
                begin, end = max(begin - before, int(first)), min(end + after, int(last))
            # An item of one unit is looked for in each passage by itself.
            spans, scores = found.setdefault((document, item, -1 if before or after else begin), ([], []))
            spans.append((begin, end))
            scores.append(score)
        for (document, item, _), (spans, scores) in found.items():
            question, answer = self.overlaps(item, words, spans)
            if question >= overlap and (answer is None or answer >= overlap):
                yield document, item, max(scores), question, answer


def index_shards(benchmark: DataFrame, size: int = SHARD_UNITS):
    """ItemIndex of items with about ``size`` units at most, dealt by hash; read one shard at a time."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    # A word and its separator take two bytes at least, so no item has more units than this.
    units = F.ceil((F.octet_length("text") + 1) / (2 * UNIT_WORDS))
    total = items.agg(F.sum(units)).first()[0] or 0
    shards = max(1, -(-2 * total // size))  # half full on average, so that no hashed shard passes the bound by much
    items = items.withColumn("_shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)))
    if shards > 1:
        items = cut_lineage(items, "items", partition_by=("_shard",))
    for k in range(shards):
        rows = items.where(F.col("_shard") == k).select("item_id", "text").collect()  # at most about ``size`` units
        if rows:
            yield ItemIndex(sorted(((r.item_id, r.text) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = SCORE_SHARE, overlap: float = OVERLAP) -> DataFrame:
    """One row per (doc_id, item_id) whose question and answer the document holds: doc_id, item_id, bm25_share (best of
    the item's units), question_overlap, answer_overlap (best of the document's passages)."""
    small_batches(docs.sparkSession)
    kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = (f"doc_id {kind}, item_id {item_kind}, bm25_share double, question_overlap double, answer_overlap double")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out, last = docs.sparkSession.createDataFrame([], schema), None
    for index in index_shards(benchmark):
        if last is not None:  # of several shards each is searched and written before the next one is read
            out = out.unionByName(cut_lineage(last, "matches"))
        last = texts.mapInArrow(_matcher(index, share, overlap), schema)
    out = out if last is None else out.unionByName(last)
    return out.groupBy("doc_id", "item_id").agg(
        *(F.max(c).alias(c) for c in ("bm25_share", "question_overlap", "answer_overlap")))


def _matcher(index: ItemIndex, share: float, overlap: float):
    def run(batches):
        for block in text_blocks(batches):
            words, documents = text_words(block.column("text"))
            rows, matched = [], []
            for document, item, *figures in index.matches(words, documents, share, overlap):
                rows.append(document)
                matched.append((index.items[item], *figures))
            items, scores, questions, answers = zip(*matched, strict=True) if matched else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(items, pa.int64()),
                 pa.array(scores, pa.float64()), pa.array(questions, pa.float64()), pa.array(answers, pa.float64())],
                names=["doc_id", "item_id", "bm25_share", "question_overlap", "answer_overlap"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a test item (rows with a null id stay unless an item is in a null-id row)."""
    hits = contaminated(docs, benchmark).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hits, docs.doc_id.eqNullSafe(hits["_hit"]), "left_anti")
