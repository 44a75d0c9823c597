"""Language identification by word-first backoff.

Training counts words per language over all labelled rows given (a map-side combined aggregation), and from them character
n-grams of every length up to ``MAX_GRAM``, words being padded with a blank on both sides. A known word scores by its log
frequency in each language. For an unseen word the longest n-grams are tried first: at the first length at which the model
knows any of them, the mean log frequency of the known ones is the word's score. The text's scores are sums over its words;
the answer is the best language and its share after softmax of the sum divided by the square root of the number of words.

The whole tables of words and n-grams stand in the shared folder and grow with the rows. A head of each, the most frequent
units with their true counts in all languages, is broadcast; it has at most ``MAX_CELLS`` numbers (units times languages, at
most ``MAX_LANGS`` languages). A word outside the head first scores by its n-grams; if the table of words has it, the difference
between its own score and that one is added by a join. Where the n-grams are more than the head holds, words outside the head
meet the tables of words and n-grams in joins. So the bound is one of the broadcast only, and no count is cut.

Words are runs of letters (Unicode category L, with combining marks), in lower case. Defined cases: a null text, or one
without a letter, is ``und`` with score 0; so is every text if nothing was learned; ties go to the first language in
alphabetic order; rows with a null language are not learned from; repeated rows count as often as they stand there; an empty
table gives an empty result; other columns are not looked at; words of any length are learned and looked up.
"""

from __future__ import annotations

import hashlib
import itertools
import secrets

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K
from pagewright.llm._shared import Masked, kept_by_worker, keyed, named, without, write_table

MAX_GRAM = 4
MAX_CELLS = 1 << 21
MAX_LANGS = 200
#: Bits of a character in the key of an n-gram.
POINT_BITS = 21
WORD = r"\p{L}[\p{L}\p{M}]*"
UNKNOWN = "und"
#: Words kept by a worker, in numbers (words times languages), and words looked up at a time.
MEMO_CELLS = 1 << 19
STEP_CELLS = 1 << 20


def _head(units: DataFrame, most: int) -> tuple[pa.Table, bool]:
    """``lang``, ``unit``, ``n``, ``size`` of the most frequent units, as many whole frequency classes as fit into ``most`` units; whether those are all.

    Classes are eighths of powers of two of the count over all languages, so a few hundred counts say where to cut.
    """
    whole = units.groupBy("unit").agg(F.sum("n").alias("total")).withColumn("class", F.floor(F.log2("total") * 8).cast("int"))
    whole = write_table(whole.select("unit", "class"), "classes")
    room, least = most, None
    for r in whole.groupBy("class").agg(F.count("*").alias("units")).orderBy(F.desc("class")).collect():
        room -= r["units"]
        if room < 0:
            break
        least = r["class"]
    if least is None:
        return units.limit(0).select("lang", "unit", "n", "size").toArrow(), room >= 0
    if room < 0:
        units = units.join(whole.where(F.col("class") >= least).select("unit"), "unit")
    return units.select("lang", "unit", "n", "size").toArrow(), room >= 0


def _fingerprints(words: list[str]) -> np.ndarray:
    if not words:
        return np.zeros(0, K.U)
    raw = "\n".join(words).encode()
    w = K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), _LINES)
    return w.hash


#: Any byte but the one between words.
_LINES = np.ones(256, dtype=bool)
_LINES[0x0A] = False


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", max_cells: int = MAX_CELLS) -> dict:
    """The model: languages, and log frequencies of a head of words and n-grams, small and on the driver.

    ``words`` and ``grams`` are the whole tables where the head is not all, else None.
    """
    found = F.explode(F.regexp_extract_all(F.lower(named(text_col).cast("string")), F.lit(WORD), F.lit(0)))
    some = rows.where(named(lang_col).isNotNull()).select(named(lang_col).cast("string").alias("lang"), found.alias("unit"))
    words = write_table(some.groupBy("lang", "unit").agg(F.count("*").alias("n")).withColumn("size", F.lit(0)), "words")
    of_lang = {r["lang"]: r["n"] for r in words.groupBy("lang").agg(F.sum("n").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(of_lang) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    padded = F.concat(F.lit(" "), F.col("unit"), F.lit(" "))

    def all_of(k):
        return F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, k))

    spots = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(MAX_GRAM), F.length(padded))), all_of))
    grams = words.select("lang", "n", F.explode(spots).alias("unit")).where("trim(unit) <> ''").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    grams = write_table(grams.withColumn("size", F.length("unit")), "grams")
    langs = sorted(of_lang)
    totals = {(0, x): n for x, n in of_lang.items()}
    for r in grams.groupBy("lang", "size").agg(F.sum("n").alias("n")).collect():
        totals[r["size"], r["lang"]] = r["n"]
    most = max_cells // max(1, len(langs))
    # half a count for what a language lacks, at one common scale, so that small languages gain nothing by their size
    total = np.array([[max(1, totals.get((k, x), 1)) for x in langs] for k in range(MAX_GRAM + 1)], float).reshape(MAX_GRAM + 1, len(langs))
    floor = 0.5 / total.max(axis=1, initial=1)

    def logs(table: pa.Table) -> tuple[list[str], np.ndarray]:
        unit = table.column("unit").combine_chunks().dictionary_encode()
        unit = unit.chunk(0) if isinstance(unit, pa.ChunkedArray) else unit
        code, size, n = unit.indices.to_numpy(), table.column("size").to_numpy(), table.column("n").to_numpy()
        lang = np.searchsorted(np.array(langs, object), np.array(table.column("lang").to_pylist(), object)) if len(code) else np.zeros(0, np.int64)
        own_size = np.zeros(len(unit.dictionary), np.int64)
        own_size[code] = size
        out = np.repeat(np.log(floor[own_size])[:, None], len(langs), axis=1)
        out[code, lang] = np.log(n / total[size, lang])
        return unit.dictionary.to_pylist(), out

    (top_words, all_words), (top_grams, all_grams) = (_head(t, most) for t in (words, grams))
    (known, word_logs), (parts, gram_logs) = logs(top_words), logs(top_grams)
    h = _fingerprints(known)
    order = np.argsort(h)
    return {
        "langs": langs, "word_hash": h[order], "word_logs": word_logs[order], "grams": parts, "gram_logs": gram_logs,
        "total": total, "floor": floor, "words_table": None if all_words else words, "grams_table": None if all_grams else grams,
    }


def _levels(grams: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The n-grams as a trie: for each length the sorted keys of all beginnings (number of the beginning less its last character, and that character) and their rows, -1 for what is no n-gram."""
    points = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4").astype(np.int64)
    sizes = np.array([len(g) for g in grams], np.int64)
    starts, node, out = np.cumsum(sizes) - sizes, np.zeros(len(grams), np.int64), []
    for k in range(MAX_GRAM):
        has = np.flatnonzero(sizes > k)
        keys, at = np.unique(node[has] << POINT_BITS | points[starts[has] + k], return_inverse=True)
        node[has] = at
        rows = np.full(len(keys), -1, np.int32)
        whole = sizes[has] == k + 1
        rows[at[whole]] = has[whole]
        out.append((keys, rows))
    return out


class Scorer:
    def __init__(self, model: dict):
        self.langs, self.hash, self.logs = model["langs"], model["word_hash"], model["word_logs"]
        self.levels, self.gram_logs = model["levels"], model["gram_logs"]
        self.find = regex.compile(WORD)
        self.most = MEMO_CELLS // max(1, len(self.langs))
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))
        self.tail = np.zeros(0, bool)

    def by_grams(self, words: list[str]) -> np.ndarray:
        """The scores of words that are not known."""
        out = np.zeros((len(words), len(self.langs)))
        sizes = np.array([len(w) + 3 for w in words], np.int64)
        for a, b in K.runs_of(sizes, STEP_CELLS // 4):
            # no n-gram has the line break between words
            points = np.frombuffer("\n".join(f" {w} " for w in words[a:b]).encode("utf-32-le"), "<u4").astype(np.int64)
            word = np.cumsum(points == 0x0A)
            at, node, found = np.arange(len(points)), np.zeros(len(points), np.int64), []
            for k, (keys, rows) in enumerate(self.levels):
                if k:
                    has = at + k < len(points)
                    at, node = at[has], node[has]
                key = node << POINT_BITS | points[at + k]
                node = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
                has = keys[node] == key if len(keys) else np.zeros(len(key), bool)
                at, node = at[has], node[has]
                row = rows[node]
                found.append((word[at[row >= 0]], row[row >= 0]))
            open_ = np.ones(b - a, bool)
            for of, row in reversed(found):
                of, row = of[left := open_[of]], row[left]
                n = np.bincount(of, minlength=b - a)
                hit = n > 0
                for j in range(len(self.langs)):
                    out[a:b, j][hit] = np.bincount(of, self.gram_logs[row, j], b - a)[hit] / n[hit]
                open_[hit] = False
        return out

    def look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by the head, and which of them are not in the head of words."""
        h = _fingerprints(words)
        at = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        has = self.hash[at] == h if len(self.hash) else np.zeros(len(h), bool)
        out = np.zeros((len(words), len(self.langs)))
        out[has] = self.logs[at[has]]
        out[~has] = self.by_grams([words[i] for i in np.flatnonzero(~has).tolist()])
        return out, ~has

    def judge(self, counts: np.ndarray, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and share of each text by its number of words and the sums of their scores."""
        share = np.zeros(len(counts))
        if not self.langs:
            return [UNKNOWN] * len(counts), share
        mean = sums / np.sqrt(np.maximum(counts, 1))[:, None]
        odds = np.exp(mean - mean.max(axis=1, keepdims=True))
        best = mean.argmax(axis=1)
        share = np.where(counts > 0, odds[np.arange(len(counts)), best] / odds.sum(axis=1), 0.0)
        return [self.langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), counts.tolist())], share

    def sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray]:
        """For each text the number of words and the sums of their scores; texts, words and times of those outside the head."""
        counts, sums = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.langs)))
        outside: list[tuple[np.ndarray, list[str], np.ndarray]] = []
        step = max(1, STEP_CELLS // max(1, len(self.langs)))
        group, size = [], 0
        for k, text in enumerate(texts):
            found = self.find.findall(text.lower())
            counts[k] = len(found)
            if not self.langs:
                continue
            for a in range(0, len(found), step):
                part = found[a : a + step] if len(found) > step else found
                if size + len(part) > step:
                    self._add(group, sums, outside)
                    group, size = [], 0
                group.append((k, part))
                size += len(part)
        self._add(group, sums, outside)
        row = np.concatenate([np.zeros(0, np.int64), *(x for x, _, _ in outside)])
        word = [w for _, part, _ in outside for w in part]
        times = np.concatenate([np.zeros(0, np.int64), *(x for _, _, x in outside)])
        return counts, sums, row.astype(np.int32), word, times.astype(np.int32)

    def _add(self, group: list[tuple[int, list[str]]], sums: np.ndarray, outside: list) -> None:
        """Adds the scores of the words of some texts to the texts' sums; what is outside the head goes to ``outside``. New words of all the texts are looked up at once."""
        if not group:
            return
        every = set().union(*(part for _, part in group))
        new = [w for w in every if w not in self.memo]
        if len(self.memo) + len(new) > self.most:
            self.forget()
            new = list(every)
        if new:
            scores, tail = self.look_up(new)
            base = len(self.memo)
            if base + len(new) > len(self.rows):
                room = max(2 * base, base + len(new), 1 << 12)
                self.rows = np.concatenate([self.rows[:base], np.zeros((room - base, len(self.langs)))])
                self.tail = np.concatenate([self.tail[:base], np.zeros(room - base, bool)])
            self.rows[base : base + len(new)], self.tail[base : base + len(new)] = scores, tail
            self.memo.update(zip(new, range(base, base + len(new))))
        get, sizes = self.memo.__getitem__, [len(part) for _, part in group]
        flat = itertools.chain.from_iterable(part for _, part in group)
        places = np.fromiter(map(get, flat), np.int64, sum(sizes))
        text, first = np.array([k for k, _ in group], np.int64), np.cumsum([0, *sizes[:-1]])
        np.add.at(sums, text, np.add.reduceat(self.rows[places], first, axis=0))
        at = np.flatnonzero(self.tail[places])
        if len(at):
            own = np.repeat(text, sizes)[at]
            _, once, n = np.unique(own * len(self.memo) + places[at], return_index=True, return_counts=True)
            spot = at[once]
            of = np.searchsorted(first, spot, side="right") - 1
            outside.append((own[once], [group[g][1][i] for g, i in zip(of.tolist(), (spot - first[of]).tolist())], n))


def _scorer(model) -> Scorer:
    """The scorer of this process for this model."""
    name, tables = model.value
    return kept_by_worker(name, lambda: Scorer(tables))


def _slices(column: pa.Array):
    for at, data, offsets in K.slices(column):
        raw = data.tobytes()
        yield at, [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), pa.array(rows.ravel()))


def _predict(model):
    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            for at, texts in _slices(batch.column(0)):
                langs, share = scorer.judge(*scorer.sums(texts)[:2])
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.array(langs, pa.string()), pa.array(share)], names=["_carry", "lang_pred", "score"])

    return run


def _ask(model):
    """Rows of two kinds: texts with the sums by the head, and the words of a text outside the head."""
    names = ["_slice", "_row", "_carry", "words", "sums", "word", "times"]

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            for at, texts in _slices(batch.column(0)):
                counts, sums, row, word, times = scorer.sums(texts)
                rows, n, name = len(texts), len(row), secrets.randbits(62)
                carry = batch.column(1).slice(at, rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, name)), pa.array(np.arange(rows, dtype=np.int32)), carry, pa.array(counts), _lists(sums), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int32())], names=names)
                for a in range(0, n, 1 << 16):
                    m = min(n - a, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(m, name)), pa.array(row[a : a + m]), pa.nulls(m, carry.type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.list_(pa.float64())), pa.array(word[a : a + m], pa.string()), pa.array(times[a : a + m])], names=names)

    return run


def _less_grams(model):
    """The scores of known words less those by their n-grams, which the texts' sums already have."""

    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                own = batch.column(1).flatten().to_numpy().reshape(len(words), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(own - scorer.by_grams(words))], names=["word", "more"])

    return run


def _table(units: DataFrame, langs: list[str], total: np.ndarray, floor: np.ndarray, size: int) -> DataFrame:
    """``unit`` and ``scores``, an array in the order of the languages, of all units of a size."""
    parts = [F.log(F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))) / float(t), F.lit(float(floor[size])))) for x, t in zip(langs, total[size])]
    return units.where(F.col("size") == size).groupBy("unit").agg(F.array(*parts).alias("scores"))


def _from_tables(asked: DataFrame, words: DataFrame, model: dict, sent) -> DataFrame:
    """``word`` and ``more``: what the tables add to the score of a word outside the head."""
    langs, total, floor = model["langs"], model["total"], model["floor"]
    if model["grams_table"] is None:
        return words.mapInArrow(_less_grams(sent), "word string, more array<double>")
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    asked = write_table(asked.select("word").distinct(), "asked")
    words = write_table(asked.join(words, "word"), "known")
    open_ = asked.join(words, "word", "left_anti")
    spots = None

    def all_of(k):
        return F.transform(F.sequence(F.lit(1), F.length(padded) - k + 1), lambda i: F.substring(padded, i, k))

    for k in range(1, MAX_GRAM + 1):
        grams = open_.where(F.length(padded) >= k).select("word", F.explode(all_of(k)).alias("unit"))
        part = grams.groupBy("word", "unit").agg(F.count("*").alias("times")).join(_table(model["grams_table"], langs, total, floor, k), "unit")
        sums = [(F.sum(F.col("scores")[i] * F.col("times")) / F.sum("times")) for i in range(len(langs))]
        part = part.groupBy("word").agg(F.array(*sums).alias("scores")).withColumn("size", F.lit(k))
        spots = part if spots is None else spots.union(part)
    scores = words.union(spots.groupBy("word").agg(F.max_by("scores", "size").alias("scores")))
    return scores.mapInArrow(_less_grams(sent), "word string, more array<double>")


def _judge(model):
    def run(batches):
        scorer = _scorer(model)
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
            langs, share = scorer.judge(batch.column(1).to_numpy(), sums)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(share)], names=["_carry", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``id_col``, the carried columns, ``lang_pred`` and ``score`` (0 to 1)."""
    return _predicted(keyed(docs, id_col, text_col, carry), model)


def _predicted(texts: DataFrame, model: dict) -> DataFrame:
    texts, langs = texts.select("_text", "_carry"), model["langs"]
    kind = texts.schema["_carry"].dataType.simpleString()
    small = {k: model[k] for k in ("langs", "word_hash", "word_logs", "gram_logs")} | {"levels": _levels(model["grams"])}
    name = hashlib.sha256(b"".join([repr(langs).encode(), small["word_hash"].tobytes(), small["word_logs"].tobytes(), "\n".join(model["grams"]).encode(), small["gram_logs"].tobytes()])).hexdigest()
    sent = texts.sparkSession.sparkContext.broadcast((name, small))
    out = f"_carry {kind}, lang_pred string, score double"
    if not langs or (model["words_table"] is None and model["grams_table"] is None):
        return texts.mapInArrow(_predict(sent), out).select("_carry.*", "lang_pred", "score")
    made = write_table(texts.mapInArrow(_ask(sent), f"_slice long, _row int, _carry {kind}, words long, sums array<double>, word string, times int"), "asking")
    asked = made.where("word is not null").select("_slice", "_row", "word", "times")
    # the words of the head are never asked for; they need not be in the table here
    table = model["words_table"]
    words = _table(table, langs, model["total"], model["floor"], 0).select(F.col("unit").alias("word"), "scores") if table is not None else made.where("false").select("word", F.col("sums").alias("scores"))
    joined = asked.join(_from_tables(asked, words, model, sent), "word")
    more = joined.groupBy("_slice", "_row").agg(F.array(*[F.sum(F.col("more")[i] * F.col("times")) for i in range(len(langs))]).alias("more"))
    summed = made.where("word is null").join(more, ["_slice", "_row"], "left")
    both = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda a, b: a + b))
    return summed.select("_carry", "words", both.alias("sums")).mapInArrow(_judge(sent), out).select("_carry.*", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: dict, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, whose language is identified with a score of at least ``least``."""
    m = Masked(docs, id_col, text_col)
    texts = keyed(m.docs, m.id, m.text).select("_text", F.struct("_k1", "_k2").alias("_carry"))
    bad = _predicted(texts, model).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select("_k1", "_k2")
    rows = keyed(m.docs, m.id, m.text, m.columns).select("_k1", "_k2", "_carry")
    return m.back(without(rows, write_table(bad.distinct(), "rejected")).select("_carry.*"))
