"""Near-duplicate detection with bottom-k sketches from one hash function.

Each text is the set of its word shingles. Texts with equal sets fall into one class at once; equality of sets is told by two
independent 64-bit sums over the shingles' bytes. A class keeps the ``K`` least hashes of its set (its sketch). Inverted lists
propose overlaps: a list stands under ``RUN`` retained values that follow each other in the sketch, so that texts which share
only some common shingles rarely meet. An estimate from the union of the two sketches filters the pairs; the exact Jaccard
similarity of the full sets, with the words of shared shingles compared byte by byte, verifies what is left. The verified
links make groups.

Why a list finds a pair: go through the union of two similar sets by rising hash. At most a fifth of it is in one set only, so
at least one run of three shared shingles stands between them as soon as the union has six shingles (smaller unions: two, for
which sets of up to five shingles have lists as well). That is certain as long as both sketches hold the union's part in
question, that is up to a union of 104 shingles; above, all of the first 64 places of the union must be without such a run,
which has the probability 1.3e-10 at similarity 0.8 and less above. The estimate loses a pair at similarity 0.8 with probability 6e-12.

Links are sought in rounds. A list of two is a pair. In the first ``STARS`` rounds each longer list has a head: first its least
member, then its first one in a drawn order of all nodes, so that lists of like members have the same head. A node is compared
with one head only, the one that it meets in most lists, so these rounds make no more pairs than there are nodes, however large
a group is; a large group of near copies thus becomes one. Then all members of a list that are still in different groups
are compared with each other: lists of up to ``SHORT`` members emit those pairs, longer ones compare them block by block and emit
links only, each of which makes two groups one, so that there are fewer of them than groups. A long list of unlike texts is walked in full.

Skew: lists are counted with a map-side combine, members are dealt out by a join that splits hot lists, and only members of
lists of three or more go into it (a bitmap of fixed size sieves them before the shuffle; where it is full, more rows pass).

Defined cases: a null, empty or wordless text has the empty set, size 0, and is linked with nothing; a text with fewer words
than a shingle is one shingle of its whole sequence; copies and repeated rows are one class; a null id stands behind all
other ids; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K
from pagewright.llm._shared import NO_ID, Masked, keyed, release, sieve, write_table
from pagewright.llm.components import components

SKETCH = 64
#: Retained values in a row that make the key of a list, and the same for sets of up to ``TINY`` shingles beside it.
RUN, RUN_TINY, TINY = 3, 2, 5
STARS = 2
#: Members up to which a list compares all that are still apart as pairs; longer lists do so in blocks of this many shingles.
SHORT = 32
BLOCK_SHINGLES = 500_000
#: A member's shingles are counted through their holders where those are fewer than all shingles of the block divided by this.
DENSE = 4
#: Least estimate, in hundredths, that goes on to the exact check.
CUT = 42
LAST = (1 << 63) - 1


def _sets(words: K.Words, width: int):
    """For each row the sorted distinct 63-bit shingle hashes, and the first word of one occurrence of each."""
    h = words.hash
    n = max(0, len(h) - width + 1)
    grams = np.zeros(n, K.U)
    for j in range(width):
        grams = grams * K.U(K.WORD_BASE) + h[j : j + n]
    grams = K.mix(grams) >> K.U(1)
    for first, count in zip(words.first[:-1].tolist(), words.counts.tolist(), strict=True):
        if count >= width:
            out, at = np.unique(grams[first : first + count - width + 1], return_index=True)
            yield out, at + first
        elif count:  # the whole sequence, told apart from longer shingles by its length
            whole = K.U(count)
            with np.errstate(over="ignore"):
                for x in h[first : first + count]:
                    whole = whole * K.U(K.BYTE_BASE) + x
            yield K.mix(np.array([whole], K.U)) >> K.U(1), np.array([first])
        else:
            yield h[:0], np.zeros(0, np.int64)


def _words(data: np.ndarray, offsets: np.ndarray) -> K.Words:
    return K.Words(K.LOWER[data], offsets, K.SPACE_WORDS)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int):
    """For each row the sorted distinct 63-bit shingle hashes."""
    for s, _ in _sets(_words(data, offsets), width):
        yield s


def _sketches(width: int):
    def run(batches):
        release()
        for batch in batches:
            for at, data, offsets in K.slices(batch.column(2)):
                words = _words(data, offsets)
                other = words.hash_of(seed=1)
                # a second hash of the shingle that starts at each word, of its words up to the width or the text's end
                left = words.first[1:][words.row] - np.arange(len(words))
                second = np.zeros(len(words), K.U)
                for j in range(width):
                    inside = left > j
                    second[inside] = K.mix(second[inside] + other[np.flatnonzero(inside) + j])
                size, d1, d2, kept = [], [], [], []
                for s, spot in _sets(words, width):
                    size.append(len(s))
                    d1.append(int(K.mix(s + K.U(1)).sum(dtype=K.U).view(np.int64)))
                    d2.append(int(second[spot].sum(dtype=K.U).view(np.int64)))
                    kept.append(s[:SKETCH].view(np.int64))
                ends = np.append(0, np.cumsum([len(x) for x in kept])).astype(np.int32)
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
                rows = [batch.column(i).slice(at, len(size)) for i in (0, 1, 3)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(size, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["_k1", "_k2", "_carry", "size", "d1", "d2", "sketch"])

    return run


def _run_keys(batches):
    """One row for each run of retained values: its hash, the node and its size."""
    for batch in batches:
        node, size, sketch = (batch.column(i).to_numpy(zero_copy_only=False) if i < 2 else batch.column(i) for i in range(3))
        values, offsets = sketch.values.to_numpy().view(K.U), sketch.offsets.to_numpy()
        row = np.repeat(np.arange(len(node)), np.diff(offsets))
        values = values[offsets[0] : offsets[-1]]
        place = np.arange(len(values))
        keys, nodes = [], []
        for run in (RUN, RUN_TINY):
            n = max(0, len(values) - run + 1)
            whole = (row[:n] == row[run - 1 :][:n]) & ((run == RUN) | (size[row[:n]] <= TINY))
            at = place[:n][whole]
            key = np.full(len(at), run, K.U)
            for j in range(run):
                key = K.mix(key * K.U(K.WORD_BASE) + values[at + j])
            keys.append(key)
            nodes.append(row[at])
        nodes = np.concatenate(nodes)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(node[nodes]), pa.array(size[nodes])], names=["key", "node", "size"])


def _lists(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from lists of two, and the members (``key``, ``node``, ``size``) of longer lists with the least of them (``lo``) and their number."""
    rows = classes.where(F.size("sketch") >= RUN_TINY).select("node", "size", "sketch").mapInArrow(_run_keys, "key long, node long, size int")
    heads = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    heads = write_table(heads.where("n > 1"), "heads")
    long = heads.where("n > 2").select("key", "n", "lo")
    members = write_table(sieve(rows, "key", long.select("key")).join(long, "key"), "lists")
    return heads.where("n = 2").select(F.col("lo").alias("u"), F.col("hi").alias("v")), members


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def _star(lists: DataFrame, turn: int) -> DataFrame:
    """A pair for each node: with that head of another group that it meets in most lists.

    The head of a list is its least member, in later turns the first in an order drawn for the turn. What a star leaves out is
    compared after the stars.
    """
    if turn == 0:
        met = lists.where("node <> lo").select("node", F.col("lo").alias("head"))
    else:
        drawn = F.xxhash64(F.lit(turn), "node")
        head = lists.groupBy("key").agg(F.min_by("node", drawn).alias("head"), F.min_by("label", drawn).alias("head_label"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
        met = lists.join(head.select("key", "head", "head_label"), "key").where("label <> head_label").select("node", "head")
    times = met.groupBy("node", "head").agg(F.count("*").alias("times"))
    return times.groupBy("node").agg(F.max_by("head", F.struct("times", "head")).alias("head")).select(*_pair("head", "node"))


def _across(lists: DataFrame) -> DataFrame:
    """Pairs of members of a list of at most ``SHORT`` that are still in different groups."""
    mixed = lists.where(F.col("n") <= SHORT).groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    rows = lists.join(mixed.select("key"), "key")
    x, y = (rows.select("key", *[F.col(c).alias(f"{c}{k}") for c in ("node", "label")]) for k in (1, 2))
    return x.join(y, (x["key"] == y["key"]) & (F.col("label1") < F.col("label2"))).select(*_pair("node1", "node2"))


def _long_lists(lists: DataFrame, classes: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """Links that make one of all groups with similar members in a longer list, by the hashes of their full sets.

    A list is cut into blocks of about ``BLOCK_SHINGLES`` shingles; each two blocks meet in a group of their own, where the
    full sets are compared without any pair being emitted but links between groups that no earlier link has joined.
    """
    lists = lists.where(F.col("n") > SHORT).select("key", "node", "size", "label")
    mixed = lists.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("key")
    lists = write_table(lists.join(mixed, "key"), "long")
    if lists.isEmpty():
        return lists.select(F.col("node").alias("u"), F.col("node").alias("v"))
    some = write_table(_texts_of(lists.select("node").distinct(), classes, own), "texts")
    blocks = lists.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    rows = lists.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), "block", "node", "label")
    return rows.join(some, "node").groupBy("key", "b1", "b2").applyInArrow(_compare(width), "u long, v long")


def _compare(width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        column = lambda name: table.column(name).combine_chunks() if table.num_rows else pa.array([])
        nodes, blocks, labels = (np.asarray(column(c)) for c in ("node", "block", "label"))
        across = table.column("b1")[0].as_py() != table.column("b2")[0].as_py()
        group = np.unique(labels, return_inverse=True)[1]
        texts = column("_text")
        sets = [s for _, data, off in K.slices(texts) for s in shingle_sets(data, off, width)]
        sizes = np.array([len(s) for s in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        first = np.cumsum(sizes) - sizes
        # the members that have each shingle, one shingle after another
        holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(codes, kind="stable")]
        held = np.bincount(codes)
        at = np.cumsum(held) - held
        mark = np.zeros(len(codes) + 1, np.int32)
        u, v = [], []
        # members of the commonest group, also those that a link brings in, need no search of their own: the others find them
        most = np.bincount(group).argmax()
        for x in range(len(group)):
            if group[x] == most:
                continue
            mine = codes[first[x] : first[x] + sizes[x]]
            if DENSE * held[mine].sum() < len(codes):  # few members have its shingles, so only those are looked at
                both = np.bincount(holders[K.ranges(at[mine], held[mine])], minlength=len(group))
            else:
                mark[mine] = 1
                both = np.add.reduceat(mark[codes], first)
                mark[mine] = 0
            linked = (group != group[x]) & (100 * both >= 80 * (sizes + sizes[x] - both))
            if across:
                linked &= blocks != blocks[x]
            for y in np.flatnonzero(linked):
                if group[x] == group[y] or not _alike(texts, x, y, width):
                    continue
                u.append(min(nodes[x], nodes[y]))
                v.append(max(nodes[x], nodes[y]))
                gone, stays = (group[x], most) if group[y] == most else (group[y], group[x])
                group[group == gone] = stays
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs of like size whose similarity, as estimated from the union of their sketches, reaches the cut."""
    nodes = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))
    some = write_table(sieve(classes.select("node", "size", "sketch"), "node", nodes), "some")
    a = some.select(F.col("node").alias("u"), F.col("size").alias("m"), F.col("sketch").alias("su"))
    b = some.select(F.col("node").alias("v"), F.col("size").alias("n"), F.col("sketch").alias("sv"))
    both = pairs.join(a, "u").join(b, "v").where(F.least("m", "n") * 100 >= F.greatest("m", "n") * 80)
    return both.select("u", "v", "su", "sv").mapInArrow(_overlap, "u long, v long")


def _overlap(batches):
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        keep = []
        for i in range(batch.num_rows):
            a, b = left[i].values.to_numpy(), right[i].values.to_numpy()
            union = np.union1d(a, b)[:SKETCH]
            shared = np.intersect1d(a, b, assume_unique=True)
            keep.append(100 * np.searchsorted(shared, union[-1], side="right") >= CUT * len(union))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])


def _confirmed(left: K.Words, right: K.Words, a: tuple, b: tuple, width: int) -> bool:
    """Whether two sets, each with the first words of its shingles, have a similarity of 0.8 or more."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    total = len(a[0]) + len(b[0])
    if not len(x) or 100 * len(x) < 80 * (total - len(x)):
        return False
    x, y = a[1][x], b[1][y]
    same = np.ones(len(x), bool)
    # a text of fewer words than a shingle is one sequence
    for j in range(min(width, left.counts[left.row[x[0]]], right.counts[right.row[y[0]]])):
        same &= K.same_words(left, x + j, right, y + j)
    both = int(same.sum())
    return 100 * both >= 80 * (total - both)


def _alike(texts: pa.Array, x: int, y: int, width: int) -> bool:
    """Whether two rows of ``texts`` are confirmed, each on its own."""
    left, right = (_words(data, ends) for i in (x, y) for _, data, ends in K.slices(texts.slice(i, 1)))
    return _confirmed(left, right, *next(zip(_sets(left, width), _sets(right, width), strict=True)), width)


def _verify(width: int):
    def run(batches):
        for batch in batches:
            keep = []
            columns = [K.column_buffers(batch.column(i)) for i in (2, 3)]
            for at, to in K.runs_of(sum(np.diff(ends) for _, ends in columns), K.SLICE_BYTES):
                left, right = (_words(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]) for data, ends in columns)
                keep += [_confirmed(left, right, a, b, width) for a, b in zip(_sets(left, width), _sets(right, width), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return run


def _texts_of(nodes: DataFrame, classes: DataFrame, own: DataFrame) -> DataFrame:
    """``node`` and ``_text`` of classes; of the documents' texts only theirs (and few others) leave the scan."""
    want = write_table(classes.select("node", "least").join(nodes, "node", "left_semi").select("node", F.col("least.a").alias("_a"), F.col("least.b").alias("_b")), "want")
    some = sieve(own, "_b", want.select("_b"))
    return some.join(want, ["_a", "_b"]).dropDuplicates(["node"]).select("node", "_text")


def _verified(pairs: DataFrame, classes: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """Pairs with an exact Jaccard similarity of 0.8 or more."""
    pairs = write_table(pairs, "candidates")
    need = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    some = write_table(_texts_of(need, classes, own), "texts")
    a = some.select(F.col("node").alias("u"), F.col("_text").alias("tu"))
    b = some.select(F.col("node").alias("v"), F.col("_text").alias("tv"))
    return write_table(pairs.join(a, "u").join(b, "v").select("u", "v", "tu", "tv").mapInArrow(_verify(width), "u long, v long"), "links")


def _first_id(k1: str = "_k1") -> Column:
    """The id as it is compared: null behind all others."""
    return F.when(F.col(k1) == NO_ID, F.lit(LAST)).otherwise(F.col(k1))


def _grouped(texts: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The documents (``_k1``, ``_k2``, ``_carry``, ``size``, ``d1``, ``d2``) and the classes of equal sets (``d1``, ``d2``, ``first``).

    ``first`` is the least document of the class's group: its id, nulls last, and the fingerprint of its text. Texts without
    words are in no class.
    """
    carry = texts.schema["_carry"].dataType.simpleString()
    made = texts.select("_k1", "_k2", "_text", "_carry").mapInArrow(_sketches(width), f"_k1 long, _k2 long, _carry {carry}, size int, d1 long, d2 long, sketch array<bigint>")
    made = write_table(made, "sketches")
    least = F.min(F.struct(_first_id().alias("a"), F.col("_k2").alias("b"))).alias("least")
    classes = made.where("size > 0").groupBy("d1", "d2").agg(least, F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    # a written number is stable: whatever is read later has it
    classes = write_table(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    own = texts.select(_first_id().alias("_a"), F.col("_k2").alias("_b"), "_text")
    twos, lists = _lists(classes)

    groups = links = judged = None
    # stars, then what is still apart
    for turn in range(STARS + 1):
        labelled = lists.withColumn("label", F.col("node"))
        if groups is not None:
            labelled = write_table(lists.join(groups, "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
        pairs = _star(labelled, turn) if turn < STARS else _across(labelled)
        pairs = (pairs if judged is not None else pairs.union(twos)).distinct()
        if judged is not None:
            pairs = pairs.join(judged, ["u", "v"], "left_anti")
        pairs = write_table(pairs, "pairs")
        close = _estimated(pairs, classes)
        if turn == STARS:
            close = close.union(_long_lists(labelled, classes, own, width)).distinct()
        found = _verified(close, classes, own, width)
        judged = pairs if judged is None else judged.union(pairs)
        links = found if links is None else links.union(found)
        if groups is None or not found.isEmpty():
            groups = write_table(components(links), "groups")

    linked = classes.select("d1", "d2", "least", "node").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = linked.groupBy("label").agg(F.min("least").alias("first"))
    return made, write_table(linked.join(first, "label").select("d1", "d2", "first"), "members")


def near_duplicates(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``id_col``, the carried columns, ``n_shingles`` and ``component_id`` (least id of its group)."""
    made, members = _grouped(keyed(docs, id_col, text_col, carry), width)
    of = members.select("d1", "d2", F.col("first.a").alias("least"))
    out = made.select("_k1", "_carry", "size", "d1", "d2").join(of, ["d1", "d2"], "left")
    least = F.when(F.col("size") == 0, _first_id()).otherwise(F.col("least"))
    return out.select("_carry.*", F.col("size").cast("long").alias("n_shingles"), F.when(least != LAST, least).alias("component_id"))


def keep_first(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near duplicates: of each group one row stays.

    It is the one with the least id, nulls last, then the one with the least fingerprint of its text; of rows that agree in both
    the one with the least fingerprint of all columns, maps aside. A text without words has no duplicates, its rows all stay.
    """
    m = Masked(docs, id_col, text_col)
    made, members = _grouped(keyed(m.docs, m.id, m.text), width)
    mine = F.struct(_first_id().alias("a"), F.col("_k2").alias("b")) == F.col("first")
    keys = made.select("_k1", "_k2", "size", "d1", "d2").join(members, ["d1", "d2"], "left")
    keys = keys.groupBy("_k1", "_k2").agg(F.count("*").alias("n"), F.bool_and(mine).alias("is_first"), F.max("size").alias("size"))
    # only rows that go, or that stand there several times, are shuffled
    doubtful = write_table(keys.where((F.col("size") > 0) & (~F.col("is_first") | (F.col("n") > 1))).select("_k1", "_k2", "is_first"), "doubtful")
    rows = keyed(m.docs, m.id, m.text, m.columns).select("_k1", "_k2", "_carry")
    fingers = doubtful.select("_k2")
    rest = sieve(rows, "_k2", fingers).join(doubtful, ["_k1", "_k2"], "left")
    plain = [F.col(f"_carry.{c}") for c, kind in m.docs.dtypes if "map<" not in kind and "variant" not in kind]
    several = rest.where("is_first").select("_k1", "_k2", F.xxhash64(*plain).alias("order"), "_carry").groupBy("_k1", "_k2").agg(F.min_by("_carry", "order").alias("_carry"))
    kept = sieve(rows, "_k2", fingers, inside=False).select("_carry").union(rest.where("is_first is null").select("_carry")).union(several.select("_carry"))
    return m.back(kept.select("_carry.*"))
