"""Benchmark decontamination with training suffix arrays.

The training corpus is cut into shards of whole documents. Each shard gets a suffix array over its words (sorted by prefix
doubling to ``DEPTH`` words, only unresolved suffixes are sorted again); every suffix of the test texts is looked up by binary
search over the words, which gives its longest verbatim match and all places where its window stands. Documents stay whole
in their shard, so verdicts need no shuffle.

A window is ``window`` consecutive words of one item; an item with fewer words, but not none, is one window. Each place found
is confirmed on the words themselves, hence no hash collision can mark a word.

The test set is sent to all executors. Its size is checked first: in blocks of at most ``BLOCK_BYTES`` of text, each block
makes its own pass and the passes are added up, so a test set of any size can be used.

Defined cases: a null or empty text has no words and is never contaminated; items without words have no windows; items
may repeat or share ids, ids are counted once; a null item id counts as the string ``null``; repeated documents are judged
alike; empty tables on either side give zeros or no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K
from pagewright.llm._shared import Masked, keyed, named, release, without, write_table

WINDOW = 10
#: Words up to which suffixes are in order; at least the window.
DEPTH = 16
BLOCK_BYTES = 32 << 20
#: A span is the first word of a match in the document, its length, and the first word in the item.
SPAN = "struct<item:string,item_start:int,start:int,n:int>"


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Start positions in the order of their first ``depth`` codes; a suffix that ends sorts before its extensions."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    rank = np.empty(n, np.int64)
    new = np.ones(n, bool)
    new[1:] = codes[order][1:] != codes[order][:-1]
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    span = 1
    while span < depth:
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, n))
        tied = np.repeat(size > 1, size)
        places = np.flatnonzero(tied)
        if not len(places):
            break
        members = order[places]
        after = members + span
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(rank[members] * np.int64(n + 1) + key)
        members, key = members[by], key[by]
        order[places] = members
        fresh = np.ones(len(places), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[places] |= fresh
        rank[members] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[places]
        span *= 2
    return order


class Tests:
    """All suffixes of the test items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, str]], window: int, depth: int):
        texts = pa.array([t for _, t in items], pa.large_string())
        data, offsets = K.column_buffers(texts)
        words = K.Words(K.LOWER[data[offsets[0] : offsets[-1]]], offsets - offsets[0], K.ALNUM_WORDS)
        self.ids = [i for i, _ in items]
        self.lists = [K.LOWER[data[a:b]].tobytes() for a, b in zip(words.starts + offsets[0], words.ends + offsets[0], strict=True)]
        count = words.counts[words.row]
        at = np.arange(len(words)) - words.first[words.row]
        need = np.minimum(count, window)
        use = at + need <= count
        self.item, self.at, self.need = words.row[use], at[use], need[use]
        self.word = np.flatnonzero(use)
        reach = np.minimum(count - at, depth)[use]
        self.codes = np.zeros((len(self.word), depth), K.U)
        padded = np.append(words.hash, np.zeros(depth, K.U))
        for j in range(depth):
            self.codes[:, j] = np.where(j < reach, padded[self.word + j], 0)
        self.reach = reach
        self.window = window


def _bounds(codes: np.ndarray, order: np.ndarray, want: np.ndarray, need: np.ndarray):
    """First and last+1 place of suffixes that start with the first ``need`` words of each row of ``want``."""
    n, depth = len(order), want.shape[1]
    out = []
    for right in (False, True):
        lo, hi = np.zeros(len(want), np.int64), np.full(len(want), n, np.int64)
        while True:
            open_ = lo < hi
            if not open_.any():
                break
            mid = (lo + hi) >> 1
            place = order[np.minimum(mid, n - 1)]
            less, more = np.zeros(len(want), bool), np.zeros(len(want), bool)
            for j in range(depth):
                undecided = ~(less | more) & (j < need)
                if not undecided.any():
                    break
                have = np.where(place + j < n, codes[np.minimum(place + j, n - 1)], 0)
                less |= undecided & (have < want[:, j])
                more |= undecided & (have > want[:, j])
            go_right = less | (~more if right else False)
            lo = np.where(open_ & go_right, mid + 1, lo)
            hi = np.where(open_ & ~go_right, mid, hi)
        out.append(lo)
    return out


def _search(tests_value, depth: int):
    def run(batches):
        release()
        tests: Tests = tests_value.value
        for batch in batches:
            for at, raw, offsets in K.slices(batch.column(2)):
                data = K.LOWER[raw]
                words = K.Words(data, offsets, K.ALNUM_WORDS)
                rows = len(offsets) - 1
                spans = [[] for _ in range(rows)]
                n_hit = np.zeros(rows, np.int64)
                if len(words) and len(tests.word):
                    # rows are kept apart by a code that no test word has; it differs from row to row
                    spot = words.first[1:-1] + np.arange(rows - 1)
                    h = np.where(words.hash == 0, K.U(1), words.hash)
                    codes = np.insert(h, words.first[1:-1], np.zeros(rows - 1, K.U)) if rows > 1 else h
                    row_of = np.repeat(np.arange(rows), words.counts + (np.arange(rows) < rows - 1))
                    del spot
                    _judge(words, codes, row_of, tests, depth, spans, n_hit)
                flat = [s for row in spans for s in row]
                ends = np.append(0, np.cumsum([len(s) for s in spans])).astype(np.int32)
                struct = pa.array(flat, pa.struct([("item", pa.string()), ("item_start", pa.int32()), ("start", pa.int32()), ("n", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), batch.column(1).slice(at, rows), batch.column(3).slice(at, rows), pa.array(words.counts), pa.array(n_hit), pa.ListArray.from_arrays(pa.array(ends), struct)],
                    names=["_k1", "_k2", "_carry", "n_words", "n_hit", "spans"],
                )

    return run


def _judge(words, codes, row_of, tests, depth, spans, n_hit):
    order = suffix_array(codes, depth)
    # a suffix of the tests can only be found if all words of its window stand in the shard
    known = np.isin(tests.codes, codes)
    whole = np.logical_or(known, np.arange(depth)[None, :] >= tests.need[:, None]).all(axis=1)
    ask = np.flatnonzero(whole)
    if not len(ask):
        return
    want = tests.codes[ask]
    lo, hi = _bounds(codes, order, want, tests.need[ask])
    found = np.flatnonzero(hi > lo)
    hit = np.zeros(len(words) + 1, np.int64)
    matches = []
    for f in found:
        q = ask[f]
        need, first = int(tests.need[q]), int(tests.word[q])
        window = tests.lists[first : first + need]
        for place in order[lo[f] : hi[f]].tolist():
            row = int(row_of[place])
            w = place - row  # one code between rows
            if [words.data[a:b].tobytes() for a, b in zip(words.starts[w : w + need].tolist(), words.ends[w : w + need].tolist())] != window:
                continue
            hit[w] += 1
            hit[w + need] -= 1
            matches.append((row, int(tests.item[q]), w - int(words.first[row]) - int(tests.at[q]), int(tests.at[q]), need))
    covered = np.append(0, np.cumsum(np.cumsum(hit[:-1]) > 0))
    n_hit[:] = covered[words.first[1:]] - covered[words.first[:-1]]
    # windows of one item that follow each other in one document make one longest match
    matches.sort()
    run = None
    for row, item, shift, start, need in matches + [(None,) * 5]:
        if run and row == run[0] and item == run[1] and shift == run[2] and start <= run[3] + run[4]:
            run[4] = max(run[4], start + need - run[3])
            continue
        if run:
            spans[run[0]].append({"item": tests.ids[run[1]], "item_start": run[3], "start": run[3] + run[2], "n": run[4]})
        run = [row, item, shift, start, need]


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """The test set as lists of (id, text) with at most ``BLOCK_BYTES`` of text, or a single longer item."""
    rows = items.select(F.coalesce(named(id_col).cast("string"), F.lit("null")).alias("i"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-size // (BLOCK_BYTES // 2)))
    if parts == 1:
        yield [(r["i"], r["t"]) for r in rows.collect()]
        return
    rows = write_table(rows.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))), "items")
    for part in range(parts):
        yield [(r["i"], r["t"]) for r in rows.where(F.col("part") == part).collect()]


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``id_col``, carried columns, ``n_words``, ``n_hit``, ``spans`` (longest matches), ``items`` (sorted ids)."""
    texts = keyed(docs, id_col, text_col, carry).select("_k1", "_k2", "_text", "_carry")
    depth = max(DEPTH, window)
    kind = texts.schema["_carry"].dataType.simpleString()
    schema = f"_k1 long, _k2 long, _carry {kind}, n_words long, n_hit long, spans array<{SPAN}>"
    passes = []
    for block in _blocks(items, item_col, item_text_col):
        tests = docs.sparkSession.sparkContext.broadcast(Tests(block, window, depth))
        passes.append(texts.mapInArrow(_search(tests, depth), schema))
    out = passes[0]
    if len(passes) > 1:
        # copies of a row agree in every pass, so one of them stands for all; the count of hit words is taken over all spans
        for more in passes[1:]:
            out = out.unionByName(more)
        hits = F.size(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
        each = out.groupBy("_k1", "_k2").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"))
        each = each.withColumn("n_hit", hits.cast("long"))
        out = texts.select("_k1", "_k2", "_carry").join(each, ["_k1", "_k2"])
    ids = F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["item"])))
    return out.select("_carry.*", "n_words", "n_hit", "spans", ids.alias("items"))


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without any word inside a window of the test set, with their own columns."""
    m = Masked(docs, id_col, text_col)
    texts = keyed(m.docs, m.id, m.text).select("_text", "_k1", "_k2")
    bad = find_leaks(texts, items, window, "_k1", "_text", item_col="item_id", item_text_col="text", carry=["_k2"]).where("n_hit > 0").select("_k1", "_k2")
    rows = keyed(m.docs, m.id, m.text, m.columns).select("_k1", "_k2", "_carry")
    return m.back(without(rows, write_table(bad.distinct(), "contaminated")).select("_carry.*"))
