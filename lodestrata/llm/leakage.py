"""Held-out passages inside a corpus: SimHash windows, multi-index Hamming blocks, exact check.

Every document and every held-out passage is cut into overlapping windows of 20
words, the least leak to be found, and each window gets a 64-bit SimHash.  Four
16-bit blocks index the item windows; of two fingerprints within distance 11, some
block differs in at most two bits, so trying every block with up to one bit changed
on either side finds every such pair.  A window that was edited in more places than
the radius bears is found by one of its short windows of six words, indexed the same
way with radius 3.

A candidate pair is then checked on its words: matching word triples near one
diagonal are chained, and the chain must cover about ``least`` words, most of its
span, and most of its weight, where a word triple weighs more the fewer items hold it.

Windows of a document in which more than ``foreign`` words occur in no item are not
fingerprinted: that many words are changed there, at least, against any item.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import stage

BLOCKS, BLOCK_BITS = 4, 16
CHUNK_WORDS = 1 << 17


@dataclass(frozen=True)
class Scale:
    """Windows of ``words`` words: pairs within ``radius`` bits are found, in document windows of at most ``foreign`` unknown words."""

    words: int
    radius: int
    foreign: int

    @property
    def flips(self) -> list[int]:
        """Changes of a block that are tried on either side: none, or any one bit where a block may differ in two."""
        most = self.radius // BLOCKS
        if most > 2:
            raise ValueError(f"a radius of at most {3 * BLOCKS - 1} is guaranteed, not {self.radius}")
        return [0] + ([1 << k for k in range(BLOCK_BITS)] if most else [])


SCALES = (Scale(20, 11, 4), Scale(6, 3, 1))

_TAG = re.compile(r"</?[A-Za-z!][^<>]{0,200}>")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})|\\[nrtbf\"'/\\]")
_WORD = re.compile(r"[^\W_]+")


def leak_words(text: str | None) -> list[str]:
    """Lower-case words, without markup, entities and escapes; null gives none."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)) if m.group(1) else " ", text)
    return _WORD.findall(text.lower())


class Vocabulary:
    """Words as numbers, each with its 64 hash bits spread over 64 bytes (as eight 64-bit lanes)."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.lanes = np.empty((0, 8), np.uint64)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The words' numbers; new words are added."""
        known = self.number
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        if fresh:
            known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
            self.lanes = np.concatenate([self.lanes, spread(hashes)])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def forget(self, first: int) -> None:
        """Drop all words behind the ``first`` ones."""
        self.number = dict(list(self.number.items())[:first])
        self.lanes = self.lanes[:first].copy()


def spread(hashes: np.ndarray) -> np.ndarray:
    """The 64 bits of each hash as 64 bytes, in eight 64-bit lanes."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)


def running(lanes: np.ndarray) -> np.ndarray:
    """Running sums of the lanes, from 0; differences of up to 255 places are exact in every byte, as sums wrap as one number."""
    out = np.zeros((len(lanes) + 1, 8), np.uint64)
    np.cumsum(lanes, axis=0, out=out[1:])
    return out


def window_prints(sums: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """64-bit SimHash of the windows of ``width`` words that begin ``at``: a bit is set where more than half of the words set it."""
    ones = sums[at + width] - sums[at]
    over = (ones + np.uint64((127 - width // 2) * 0x0101010101010101)) >> np.uint64(7)
    bits = (over & np.uint64(0x0101010101010101)).view(np.uint8).reshape(-1, 64)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def simhashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """64-bit SimHash of each window of ``width`` word hashes."""
    n = len(hashes) - width + 1
    return window_prints(running(spread(hashes)), np.arange(n), width) if n > 0 else np.empty(0, np.uint64)


class PrintIndex:
    """Item windows of one scale by their blocks."""

    def __init__(self, scale: Scale, prints: list[np.ndarray], owners: list[int]):
        self.scale = scale
        self.prints = np.concatenate(prints) if prints else np.empty(0, np.uint64)
        self.owner = np.concatenate([np.full(len(p), k, np.int32) for k, p in zip(owners, prints)]) if prints else np.empty(0, np.int32)
        self.place = np.concatenate([np.arange(len(p), dtype=np.int32) for p in prints]) if prints else np.empty(0, np.int32)
        self.order, self.start = [], []
        flips = np.array(scale.flips, np.int64)
        for b in range(BLOCKS):
            values = (self._block(self.prints, b)[:, None] ^ flips).ravel()
            self.order.append((np.argsort(values, kind="stable") // len(flips)).astype(np.int32))
            self.start.append(np.concatenate([[0], np.cumsum(np.bincount(values, minlength=1 << BLOCK_BITS))]))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(b * BLOCK_BITS)) & np.uint64(0xFFFF)).astype(np.int64)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item window) pairs within the radius, each once."""
        pairs = []
        for b in range(BLOCKS):
            block = self._block(prints, b)
            for flip in self.scale.flips:
                values = block ^ flip
                lo = self.start[b][values]
                n = self.start[b][values + 1] - lo
                hit = np.flatnonzero(n)
                if not len(hit):
                    continue
                n = n[hit]
                i = np.repeat(hit, n)
                j = self.order[b][np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                ok = np.bitwise_count(prints[i] ^ self.prints[j]) <= self.scale.radius
                pairs.append(i[ok] * len(self.prints) + j[ok])
        found = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
        return found // max(len(self.prints), 1), found % max(len(self.prints), 1)


class ItemIndex:
    """Words, weights and block indexes of a bounded slice of items.

    counted: of a slice, the number of all items and the triples that several of them
    hold; without it, the items are all there are.
    """

    def __init__(self, items: list[tuple], scales: tuple[Scale, ...] = SCALES, counted: tuple[int, dict[tuple, int]] | None = None):
        self.ids, self.words, self.vocabulary = [], [], Vocabulary()
        self.width = min(s.words for s in scales)
        for item_id, words in items:
            if len(words) >= self.width:
                self.ids.append(item_id)
                self.words.append(words)
        sums = [running(self.vocabulary.lanes[numbers]) for words in self.words for numbers in [self.vocabulary.numbers(words)]]
        self.known = len(self.vocabulary.number)
        self.scales = []
        for s in scales:
            mine = [k for k, words in enumerate(self.words) if len(words) >= s.words]
            self.scales.append(PrintIndex(s, [window_prints(sums[k], np.arange(len(self.words[k]) - s.words + 1), s.words) for k in mine], mine))
        seen: Counter = Counter()
        self.triples: list[dict[tuple, list[int]]] = []
        for words in self.words:
            at: dict[tuple, list[int]] = defaultdict(list)
            for j in range(len(words) - 2):
                at[tuple(words[j : j + 3])].append(j)
            seen.update(at.keys())
            self.triples.append(dict(at))
        n, holders = counted or (max(len(self.words), 1), seen)
        self.weight = {t: math.log(1 + n / holders.get(t, 1)) for t in seen}
        self.size = np.array([len(words) for words in self.words], np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.size)[:-1]]) if self.words else np.empty(0, np.int64)
        self.flat = np.concatenate([self.vocabulary.numbers(words) for words in self.words]) if self.words else np.empty(0, np.int64)
        self.flat_weight = np.array([self.weight[tuple(words[j : j + 3])] if j + 3 <= len(words) else 0.0 for words in self.words for j in range(len(words))])

    def around(self, numbers: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray, owner: np.ndarray, place: np.ndarray, width: int, reach: int = 10) -> np.ndarray:
        """Weight share of the item's word triples around each window pair that the document has at the same place."""
        out = np.empty(len(at))
        steps = np.arange(-reach, width + reach)
        for first in range(0, len(at), 20_000):
            part = slice(first, first + 20_000)
            p, q, m = at[part, None] + steps, place[part, None] + steps, self.size[owner[part], None]
            mine = self.base[owner[part], None] + np.clip(q, 0, m - 1)
            same = (p >= low[part, None]) & (p < high[part, None]) & (q >= 0) & (q < m) & (numbers[np.clip(p, 0, len(numbers) - 1)] == self.flat[mine])
            weight = np.where((q >= 0) & (q < m), self.flat_weight[mine], 0.0)[:, :-2]
            out[part] = (weight * (same[:, :-2] & same[:, 1:-1] & same[:, 2:])).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-9)
        return out

    def leaked(self, k: int, words: list[str], at: int, least: int) -> tuple[int, float]:
        """(words covered, share of weight) of the best chain of item ``k`` around document word ``at``; (0, 0.0) if too little."""
        item = self.triples[k]
        m = len(self.words[k])
        lo, hi = max(0, at - m - 12), min(len(words), at + m + 12)
        diagonals: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i in range(lo, hi - 2):
            for j in item.get(tuple(words[i : i + 3]), ()):
                diagonals[i - j].append((i, j))
        best = (0, 0.0)
        for d in diagonals:
            hits = sorted({j for e in range(d - 4, d + 5) for _, j in diagonals.get(e, ())})
            run: list[int] = []
            for j in [*hits, 1 << 30]:
                if run and j - run[-1] > 8:
                    covered = len({x for y in run for x in (y, y + 1, y + 2)})
                    span = run[-1] + 3 - run[0]
                    total = sum(self.weight[tuple(self.words[k][x : x + 3])] for x in range(run[0], run[-1] + 1))
                    share = sum(self.weight[tuple(self.words[k][x : x + 3])] for x in run) / total
                    if covered >= least and covered >= 0.7 * span and (covered, share) > best:
                        best = (covered, share)
                    run = []
                run.append(j)
        return best


def item_passages(items: DataFrame, key: str, text: str, shared: int = 3) -> DataFrame:
    """(``item_key``, ``passage``): the items' texts without their first and last lines where at least ``shared`` distinct texts begin or end with them.

    Lines between them stay, whatever holds them.  An item of one or two lines keeps
    its longest one, so that no item with a text is left empty.
    """
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n"), F.trim), lambda x: x != "")
    texts = items.select(F.col(key).alias("item_key"), lines.alias("lines")).distinct().withColumns({"first": F.try_element_at("lines", F.lit(1)), "last": F.try_element_at("lines", F.lit(-1))})
    ends = texts.select("lines", F.explode(F.array_distinct(F.array("first", "last"))).alias("line")).distinct().groupBy("line").agg(F.count("*").alias("holders")).filter(F.col("holders") >= shared)
    marked = texts.join(ends.select(F.col("line").alias("first"), F.lit(True).alias("cut_first")), "first", "left").join(ends.select(F.col("line").alias("last"), F.lit(True).alias("cut_last")), "last", "left")
    size, longest = F.size("lines"), F.array_max(F.transform("lines", F.length))
    cut = F.filter("lines", lambda x, i: ~((i == 0) & F.col("cut_first").isNotNull() | (i == size - 1) & F.col("cut_last").isNotNull()) | (size <= 2) & (F.length(x) == longest))
    return marked.groupBy("item_key").agg(F.concat_ws("\n", F.array_sort(F.collect_set(F.concat_ws("\n", cut)))).alias("passage"))


def _triples(words: list[str]) -> set[tuple]:
    return {tuple(words[j : j + 3]) for j in range(len(words) - 2)}


def triple_holders(passages: DataFrame, width: int) -> DataFrame:
    """(``triple``, ``holders``): word triples, words parted by blanks, that more than one of the passages of at least ``width`` words hold."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([" ".join(t) for p in b["passage"] if len(words := leak_words(p)) >= width for t in _triples(words)], columns=["triple"])

    return passages.select("passage").mapInPandas(run, "triple string").groupBy("triple").agg(F.count("*").alias("holders")).filter("holders > 1")


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str, item_key: str, doc_text: str = "text", item_text: str = "text", scales: tuple[Scale, ...] = SCALES, least: int = 15, weight_share: float = 0.5, slice_items: int = 5000, slice_chars: int = 8_000_000) -> DataFrame:
    """All (``doc_key``, ``item_key``, ``covered_words``, ``weight_share``) of documents that hold about ``least`` or more consecutive words of an item.

    Items go to the executors in slices of about ``slice_items`` items and
    ``slice_chars`` characters at most (one item is never split), and the corpus is
    scanned once per slice, whole texts, without a shuffle; word triples are weighed
    over the items of all slices.
    Null and short texts hold nothing; repeated documents each give their own row;
    an item given twice under one key counts once.
    """
    spark = docs.sparkSession
    width = min(s.words for s in scales)
    passages = stage(item_passages(items, item_key, item_text), "passages")
    n, chars = passages.agg(F.count("*"), F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()
    slices = max(1, math.ceil(n / slice_items), math.ceil(chars / slice_chars))
    kinds = dict(docs.dtypes)[doc_key], dict(items.dtypes)[item_key]
    schema = f"doc_key {kinds[0]}, item_key {kinds[1]}, covered_words int, weight_share double"
    if slices > 1:
        holders = stage(triple_holders(passages, width), "triples")
        indexed = passages.select("passage").mapInPandas(lambda bs: (pd.DataFrame({"n": [sum(len(leak_words(p)) >= width for p in b["passage"])]}) for b in bs), "n long").agg(F.sum("n")).first()[0]
    found = None
    for part in range(slices):
        mine = passages.filter(F.pmod(F.xxhash64("item_key"), F.lit(slices)) == part) if slices > 1 else passages
        rows = sorted(((r["item_key"], leak_words(r["passage"])) for r in mine.select("item_key", "passage").collect()), key=lambda x: (x[0] is None, x))
        counted = None
        if slices > 1:
            here = spark.createDataFrame([(" ".join(t),) for t in sorted(set().union(*(_triples(words) for _, words in rows)))], "triple string")
            counted = max(indexed, 1), {tuple(r["triple"].split(" ")): r["holders"] for r in holders.join(here, "triple", "left_semi").collect()}
        shared = spark.sparkContext.broadcast((rows, counted))

        def run(batches, shared=shared):
            index = ItemIndex(shared.value[0], scales, shared.value[1])
            for b in batches:
                out = []
                pending: list[tuple] = []
                size = 0
                for key, text in zip(b["k"], b["t"]):
                    words = leak_words(text)
                    if len(words) < width:
                        continue
                    pending.append((key, words))
                    size += len(words)
                    if size >= CHUNK_WORDS:
                        out += _scan(index, pending, least, weight_share)
                        pending, size = [], 0
                out += _scan(index, pending, least, weight_share)
                yield pd.DataFrame(out, columns=["doc_key", "item_key", "covered_words", "weight_share"])

        part_rows = docs.select(F.col(doc_key).alias("k"), F.col(doc_text).alias("t")).mapInPandas(run, schema)
        found = part_rows if found is None else found.unionByName(part_rows)
    return found.select(F.col("doc_key").alias(doc_key), F.col("item_key").alias(item_key), "covered_words", "weight_share")


def _scan(index: ItemIndex, docs: list[tuple], least: int, weight_share: float) -> list[tuple]:
    if not docs or not index.words:
        return []
    lengths = np.array([len(w) for _, w in docs])
    numbers = index.vocabulary.numbers([w for _, words in docs for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner_doc = np.repeat(np.arange(len(docs)), lengths)
    left = starts[owner_doc] + lengths[owner_doc] - np.arange(len(numbers))  # words from here to the end of the document
    foreign = np.concatenate([[0], np.cumsum(numbers >= index.known)])
    candidates = []
    sums = None
    for scale in index.scales:
        width = scale.scale.words
        last = len(numbers) - width + 1
        if last <= 0 or not len(scale.prints):
            continue
        at = np.flatnonzero((foreign[width : width + last] - foreign[:last] <= scale.scale.foreign) & (left[:last] >= width))
        if not len(at):
            continue
        sums = running(index.vocabulary.lanes[numbers]) if sums is None else sums
        w, j = scale.near(window_prints(sums, at, width))
        w, owner, place = at[w], scale.owner[j], scale.place[j].astype(np.int64)
        low = starts[owner_doc[w]]
        # a chain with half of its weight has far more than this in line with some window of it
        likely = index.around(numbers, low, low + lengths[owner_doc[w]], w, owner, place, width) >= 0.08
        candidates.append(np.stack([owner_doc[w], owner, w - low, w - low - place], axis=1)[likely])
    if len(index.vocabulary.number) > index.known + 400_000:
        index.vocabulary.forget(index.known)
    tried: dict[tuple, list[int]] = defaultdict(list)
    out: dict[tuple, tuple] = {}
    for d, k, at, g in sorted(map(tuple, np.concatenate(candidates).tolist())) if candidates else []:
        if any(abs(g - x) <= 4 for x in tried[d, k]):
            continue
        tried[d, k].append(g)
        covered, share = index.leaked(k, docs[d][1], at, least)
        if covered and share >= weight_share and (covered, share) > out.get((d, k), (0, 0.0)):
            out[d, k] = (covered, share)
    return [(docs[d][0], index.ids[k], c, s) for (d, k), (c, s) in out.items()]
