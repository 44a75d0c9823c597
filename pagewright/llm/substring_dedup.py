"""Substring dedup by super-k-mer partitioning.

A window is ``width`` consecutive words of one text. Each window has a minimiser, the least of the hashes of its
``m`` word grams; consecutive windows that share one travel as a single packed string (a super-k-mer, its words joined by one
byte) to the minimiser's bucket. There all windows are sorted by hash, neighbours are compared byte by byte, and a window
that starts in two places or more is repeated. Every word under a repeated window is removed; windows are judged on the
input and not on what is left.

Skew: a gram that stands in a large share of the corpus would make one bucket hot, so a first pass counts all grams in a
table of fixed size, and grams above a multiple of the mean are no minimisers. A window that has no other gram goes by the
least of its grams of ``LONG_GRAM`` words, which deals such windows out again.
Equal super-k-mers of one slice are merged before the shuffle (the merged ones are known to be repeated), hence a passage
that every text holds reaches its bucket once per slice. Of the texts, only those with repeated windows (and few others, sieved by
a bitmap of fixed size) are shuffled to their marks. Memory is bounded by a slice, a bucket or the longest text.

Defined cases: a null or empty text has no words and gives an empty result; a text shorter than a window keeps all words;
repeated rows are counted as separate texts, so that their windows repeat; ids may be null or repeat; an empty table
gives an empty result; columns other than those named are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K
from pagewright.llm._shared import Masked, keyed, release, sieve, write_table

WIDTH = 35
GRAM, LONG_GRAM = 4, 16
SLOT_BITS = 20
#: A slot of the gram table is hot from this multiple of the mean count on.
HOT_TIMES = 16
#: Bytes of packed strings that one bucket gets on the average, and the growth of text by packing.
BUCKET_BYTES = 4 << 20
PACKED_TIMES = 3
#: Bytes of text that are packed at a time.
PACK_BYTES = 2 << 20


def _grams(words: K.Words, m: int) -> np.ndarray:
    """Hash of the ``m`` words from each word on; row ends are not looked at."""
    h = words.hash
    n = max(0, len(h) - m + 1)
    out = np.zeros(n, K.U)
    for j in range(m):
        out = out * K.U(K.WORD_BASE) + h[j : j + n]
    return K.mix(out)


def _load(m: int):
    """Counts of grams by slot, as far as they stand out in this partition; slot -1 has all grams, -2 all bytes."""

    def run(batches):
        release()
        counts, size = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            for _, data, offsets in K.slices(batch.column(0)):
                words = K.Words(data, offsets, K.SPACE_WORDS)
                size += len(data)
                slots = (_grams(words, m) >> K.U(64 - SLOT_BITS)).astype(np.int64)
                counts += np.bincount(slots, minlength=1 << SLOT_BITS)
        high = np.flatnonzero(counts >= 4 * counts.mean() + 4)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(high, [-1, -2]), pa.int64()), pa.array(np.append(counts[high], [counts.sum(), size]), pa.int64())], names=["slot", "n"])

    return run


def _runs(words: K.Words, width: int, m: int, hot: np.ndarray):
    """Super-k-mers: first window, window after the last, minimiser."""
    n = len(words) - width + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, K.U)
    grams = _grams(words, m)
    late = hot[(grams >> K.U(64 - SLOT_BITS)).astype(np.int64)]
    order = (K.mix(grams) >> K.U(1)) | (late.astype(K.U) << K.U(63))
    least = K.sliding_min(order, width - m + 1)
    if (all_hot := least >> K.U(63) == 1).any():
        long = min(LONG_GRAM, width)
        least = np.where(all_hot, K.sliding_min(_grams(words, long), width - long + 1) | K.U(1 << 63), least)
    whole = words.row[:n] == words.row[width - 1 :]
    opens, closes = whole.copy(), whole.copy()
    same = (least[1:] == least[:-1]) & (words.row[1:n] == words.row[: n - 1])
    opens[1:] &= ~(same & whole[:-1])
    closes[:-1] &= ~(same & whole[1:])
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) + 1, least[first]


def _merge(row: np.ndarray, start: np.ndarray, stop: np.ndarray):
    """Union of word ranges by row."""
    if not len(row):
        return row, start, stop
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], stop[order]
    # running maximum of stops inside a row, made to restart by an offset for each row
    shift = row * (int(stop.max()) + 1)
    reach = np.maximum.accumulate(stop + shift) - shift
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], np.maximum.reduceat(reach, at)


_META = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("n", "<i4"), ("many", "?")])
_MARK = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<i4"), ("stop", "<i4")])


def _pack(width: int, m: int, buckets: int, hot_bits):
    def run(batches):
        release()
        hot = np.unpackbits(np.frombuffer(hot_bits.value, np.uint8)).astype(bool)
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at, data, offsets in K.slices(batch.column(2), PACK_BYTES):
                words = K.Words(data, offsets, K.SPACE_WORDS)
                first, stop, least = _runs(words, width, m, hot)
                if not len(first):
                    continue
                row, last = words.row[first], stop + width - 1
                sums, down = K.prefix_sums(words.hash)
                lead, many, every = _equal_runs(words, K.run_hash(sums, down, first, last), first, last)
                out = {"bucket": [], "text": [], "meta": []}
                member = np.flatnonzero(many[lead])  # runs with copies in this slice: repeated without asking the bucket
                r, s, e = _merge(row[member], first[member] - words.first[row[member]], last[member] - words.first[row[member]])
                if len(r):
                    marks = np.zeros(len(r), _MARK)
                    marks["k1"], marks["k2"], marks["start"], marks["stop"] = k1[at + r], k2[at + r], s, e
                    out["bucket"].append(int(k2[at] % buckets))
                    out["text"].append(None)
                    out["meta"].append(squeeze.compress(marks.tobytes()))
                bucket = (K.mix(least[every]) % K.U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                every, bucket = every[order], bucket[order]
                meta = np.zeros(len(every), _META)
                meta["k1"], meta["k2"] = k1[at + row[every]], k2[at + row[every]]
                meta["start"], meta["n"], meta["many"] = first[every] - words.first[row[every]], stop[every] - first[every], many[every]
                size = last[every] - first[every]
                member = K.ranges(first[every], size)
                packed = K.gather(data, words.starts[member], words.ends[member], gap=10)
                edge = np.append(0, np.cumsum(words.ends[member] - words.starts[member] + 1))[np.append(0, np.cumsum(size))]
                cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    out["bucket"].append(int(bucket[a]))
                    out["text"].append(squeeze.compress(packed[edge[a] : edge[b]].tobytes()))
                    out["meta"].append(squeeze.compress(meta[a:b].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["text"], pa.binary()), pa.array(out["meta"], pa.binary())], names=list(out))

    return run


def _equal_runs(words: K.Words, key: np.ndarray, first: np.ndarray, last: np.ndarray):
    """For each run the first run of this slice with the same words; which of those stand for several; the distinct ones."""
    order = np.argsort(key, kind="stable")
    near = np.zeros(len(order), bool)
    a, b = order[:-1], order[1:]
    near[1:] = (key[a] == key[b]) & (last[a] - first[a] == last[b] - first[b])
    at = np.flatnonzero(near)
    if len(at):  # word by word
        x, y = order[at - 1], order[at]
        size = last[x] - first[x]
        equal = K.same_words(words, K.ranges(first[x], size), words, K.ranges(first[y], size))
        near[at] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
    head = np.flatnonzero(~near)
    group = np.cumsum(~near) - 1
    lead = np.empty(len(order), np.int64)
    lead[order] = order[head][group]
    many = np.zeros(len(order), bool)
    many[order[head]] = np.diff(np.append(head, len(order))) > 1
    return lead, many, np.sort(order[head])


def _count(width: int):
    def run(table: pa.Table) -> pa.Table:
        loose = zstandard.ZstdDecompressor()
        done, texts, metas = [], [], []
        for text, meta in zip(table.column("text").to_pylist(), table.column("meta").to_pylist(), strict=True):
            if text is None:
                done.append(np.frombuffer(loose.decompress(meta), _MARK))
            else:
                texts.append(loose.decompress(text))
                metas.append(np.frombuffer(loose.decompress(meta), _META))
        if texts:
            meta = np.concatenate(metas)
            data = np.frombuffer(b"".join(texts), np.uint8)
            texts.clear()
            words = K.Words(data, np.array([0, len(data)]), K.SPACE_WORDS)
            size = meta["n"] + (width - 1)
            first = np.cumsum(size) - size
            window = K.ranges(first.astype(np.int64), meta["n"].astype(np.int64))
            again = _repeated(words, window, width)
            again &= ~np.repeat(meta["many"], meta["n"])
            at = np.flatnonzero(again)
            run_of = np.repeat(np.arange(len(meta)), meta["n"])[at]
            offset = window[at] - first[run_of]
            r, s, e = _merge(run_of, offset, offset + 1)
            marks = np.zeros(len(r), _MARK)
            marks["k1"], marks["k2"] = meta["k1"][r], meta["k2"][r]
            marks["start"], marks["stop"] = meta["start"][r] + s, meta["start"][r] + e + (width - 1)
            done.append(marks)
        all_marks = np.concatenate(done) if done else np.zeros(0, _MARK)
        return pa.table({"_k1": pa.array(all_marks["k1"], pa.int64()), "_k2": pa.array(all_marks["k2"], pa.int64()), "start": pa.array(all_marks["start"], pa.int32()), "stop": pa.array(all_marks["stop"], pa.int32())})

    return run


def _repeated(words: K.Words, window: np.ndarray, width: int) -> np.ndarray:
    """Whether each window (index of its first word) has the same words as another one; words are one byte apart."""
    sums, down = K.prefix_sums(words.hash)
    key = K.run_hash(sums, down, window, window + width)
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(key[1:] == key[:-1])
    out = np.zeros(len(window), bool)
    odd = []
    for k in range(0, len(at), 1 << 16):
        some = at[k : k + (1 << 16)]
        x, y = order[some], order[some + 1]
        same = K.same_spans(words.eight, words.starts[window[x]], words.ends[window[x] + width - 1], words.eight, words.starts[window[y]], words.ends[window[y] + width - 1])
        out[x[same]] = out[y[same]] = True
        odd.extend(np.unique(key[some[~same]]).tolist())
    for value in set(odd):  # two contents under one hash: their windows are told apart by content
        seen: dict = {}
        for i in order[np.searchsorted(key, K.U(value)) : np.searchsorted(key, K.U(value), side="right")].tolist():
            seen.setdefault(words.data[words.starts[window[i]] : words.ends[window[i] + width - 1]].tobytes(), []).append(i)
        for places in seen.values():
            out[places] = len(places) > 1
    return out


def _remove(with_clean: bool):
    """Apply the marks: words counted, kept words joined by one space, and the text without the removed words' bytes."""

    def run(batches):
        for batch in batches:
            marks, n_rows = batch.column(1), batch.num_rows
            kept_text, clean, n_words, n_removed = [], [], np.zeros(n_rows, np.int64), np.zeros(n_rows, np.int64)
            ends = marks.offsets.to_numpy()
            inner = marks.values
            start, stop = (inner.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            has = np.asarray(marks.is_valid())
            for at, data, offsets in K.slices(batch.column(0)):
                words = K.Words(data, offsets, K.SPACE_WORDS)
                rows = len(offsets) - 1
                gone = np.zeros(len(words) + 1, np.int64)
                some = np.flatnonzero(has[at : at + rows] & (ends[at + 1 : at + rows + 1] > ends[at : at + rows]))
                if len(some):
                    size = ends[at + some + 1] - ends[at + some]
                    which = K.ranges(ends[at + some].astype(np.int64), size.astype(np.int64))
                    base = np.repeat(words.first[some], size)
                    np.add.at(gone, base + start[which], 1)
                    np.add.at(gone, base + stop[which], -1)
                keep = np.cumsum(gone[:-1]) == 0
                left = np.add.reduceat(np.append(keep, False).astype(np.int64), words.first[:-1]) * (words.counts > 0)
                n_words[at : at + rows], n_removed[at : at + rows] = words.counts, words.counts - left
                joined = K.gather(data, words.starts[keep], words.ends[keep], gap=32)
                sizes = np.append(0, np.cumsum((words.ends - words.starts + 1)[keep]))
                edge = sizes[np.append(0, np.cumsum(left))]
                raw = joined.tobytes()
                kept_text += [raw[a : max(a, b - 1)] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                if with_clean:
                    mask = np.zeros(len(data) + 1, np.int64)
                    out = np.flatnonzero(~keep)
                    to = np.minimum(np.append(words.starts[1:], len(data))[out], offsets[1:][words.row[out]])
                    np.add.at(mask, words.starts[out], 1)
                    np.add.at(mask, to, -1)
                    stay = np.cumsum(mask[:-1]) == 0
                    edge = np.append(0, np.cumsum(stay))[offsets]
                    raw = data[stay].tobytes()
                    clean += [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            columns = [batch.column(2), pa.array(n_words), pa.array(n_removed), pa.array(kept_text, pa.binary()).cast(pa.string())]
            names = ["_carry", "n_words", "n_removed", "kept_text"]
            if with_clean:
                columns.append(pa.array(clean, pa.binary()).cast(pa.string()))
                names.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def repeated_ranges(texts: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Ranges of words (``start`` up to ``stop``) of keyed texts that stand under a repeated window."""
    spark = texts.sparkSession
    m = min(gram, width)
    loads = texts.select("_text").mapInArrow(_load(m), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # every slot here stood out in some partition; the table has 2**SLOT_BITS slots at most, whatever the input
    found = {int(r["slot"]): int(r["n"]) for r in loads.collect()}
    grams, size = found.pop(-1, 0), found.pop(-2, 0)
    hot = np.zeros(1 << SLOT_BITS, bool)
    hot[[slot for slot, n in found.items() if n >= HOT_TIMES * grams / (1 << SLOT_BITS) + HOT_TIMES]] = True
    buckets = max(1, -(-size * PACKED_TIMES // BUCKET_BYTES))
    bits = spark.sparkContext.broadcast(np.packbits(hot).tobytes())
    packed = texts.select("_k1", "_k2", "_text").mapInArrow(_pack(width, m, buckets, bits), "bucket long, text binary, meta binary")
    return packed.groupBy("bucket").applyInArrow(_count(width), "_k1 long, _k2 long, start int, stop int")


def _with_marks(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Keyed texts that have no repeated window, and the others (or some more) with ``marks``, the ranges of their words."""
    marks = repeated_ranges(texts, width).groupBy("_k1", "_k2").agg(F.collect_list(F.struct("start", "stop")).alias("marks"))
    marks = write_table(marks, "marks")
    fingers = marks.select("_k2")
    return sieve(texts, "_k2", fingers, inside=False), sieve(texts, "_k2", fingers).join(marks, ["_k1", "_k2"], "left")


def dedup_substrings(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, with_clean: bool = False) -> DataFrame:
    """One row per document: ``id_col`` and the carried columns, ``n_words``, ``n_removed``, ``kept_text``; ``clean_text`` on request.

    ``kept_text`` has the kept words joined by one space, ``clean_text`` the original text without the removed words.
    """
    texts = keyed(docs, id_col, text_col, carry)
    whole, marked = _with_marks(texts, width)
    none = F.lit(None).cast("array<struct<start:int,stop:int>>")
    both = whole.select("_text", none.alias("marks"), "_carry").union(marked.select("_text", "marks", "_carry"))
    kind = texts.schema["_carry"].dataType.simpleString()
    schema = f"_carry {kind}, n_words long, n_removed long, kept_text string" + ", clean_text string" * with_clean
    return both.mapInArrow(_remove(with_clean), schema).select("_carry.*", "n_words", "n_removed", "kept_text", *["clean_text"] * with_clean)


def without_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their own columns; words under repeated windows are cut out of the text (a null text stays null)."""
    m = Masked(docs, id_col, text_col)
    rest = [c for c in m.columns if c != m.text]
    has = F.col(m.text).isNotNull().alias("_has")
    texts = keyed(m.docs.select("*", has), m.id, m.text, [*rest, "_has"])
    whole, marked = _with_marks(texts, width)
    kind = texts.schema["_carry"].dataType.simpleString()
    cut = marked.select("_text", "marks", "_carry").mapInArrow(_remove(True), f"_carry {kind}, n_words long, n_removed long, kept_text string, clean_text string")
    text = lambda column: F.when(F.col("_carry._has"), F.col(column))
    back = lambda rows, column: rows.select(*[text(column).alias(c) if c == m.text else F.col(f"_carry.{c}").alias(c) for c in m.columns])
    return m.back(back(whole, "_text").union(back(cut, "clean_text")))
