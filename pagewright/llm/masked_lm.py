"""LM scoring by masked pseudo-likelihood.

Every token of a text is predicted from the ``SIDE`` tokens on either side, it being masked itself; the score of a document is
the sum of the log-probabilities of its tokens. The network has one input table for each place of the window, a tanh layer, and
a softmax in two steps (group of the token, then token within the group). It is trained in numpy in ``ROUNDS`` rounds, each over
its part of all texts: learners start from common weights, take a pass of stochastic gradient descent over their texts, and
their weights are averaged, weighted by tokens, for the next round. A learner has about ``LEARNER_TOKENS`` tokens or more in a
round, however the table is cut into files, so that each goes a good way; the number of learners grows with the corpus. Weights are
added up in a tree, ``FAN`` sets at a time.

Tokens are words (letters, digits and all non-ASCII characters, A-Z in lower case), told apart by a 64-bit fingerprint. Words are
counted over the whole corpus; the most frequent ones have an id of their own, all others share ``SHARED`` ids by their hash.
The ids and the network are of fixed size, whatever the corpus. The table of counts holds every word and grows with the corpus;
it stands in the shared folder. A word that shares an id has the probability of the id times its share: its count over all of
theirs and one more. The counts of the ``HEAD`` most frequent words are broadcast; a word beyond them is looked up in
the table by a join, one request for each text that has it, and counts ``UNSEEN`` if the table lacks it too.

Defined cases: a null, empty or wordless text has no tokens, log-likelihood 0 and a null mean; places outside the text have an
id of their own; texts of any length are scored whole; repeated rows train as often as they stand there and score alike; an
empty corpus leaves the start weights; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import secrets

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K
from pagewright.llm._shared import keyed, named, write_table

SIDE = 2
HIDDEN = 8
GROUPS, MEMBERS = 32, 64
SIZE = GROUPS * MEMBERS
SHARED = 256
BATCH = 2048
RATE = 1.0
ROUNDS = 2
LEARNER_TOKENS = 1 << 19
FAN = 64
EDGE = SIZE
HEAD = 1 << 19
#: Tokens that are scored at a time, so few that their numbers stay in a core's cache; scores do not depend on it.
SCORED = 1 << 11
#: Count of a word that the table lacks.
UNSEEN = 0.5


class Vocabulary:
    """Ids by word fingerprint: the frequent words by falling count, then the shared ids."""

    def __init__(self, frequent: list[int]):
        words = np.array(frequent, np.int64).view(K.U)[: SIZE - SHARED]
        order = np.argsort(words)
        self.words, self.ids = words[order], order.astype(np.int64)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        shared = (h % K.U(SHARED)).astype(np.int64) + (SIZE - SHARED)
        if not len(self.words):
            return shared
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.ids[at], shared)


class Net:
    """Weights: input tables (place, token, hidden), bias, group softmax, member softmax of each group."""

    SHAPES = [(2 * SIDE, SIZE + 1, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, MEMBERS), (GROUPS, MEMBERS)]

    def __init__(self, flat: np.ndarray | None = None):
        sizes = [int(np.prod(s)) for s in self.SHAPES]
        if flat is None:
            flat = np.random.default_rng(3).normal(0, 0.1, sum(sizes)).astype(np.float32)
        self.flat = flat.astype(np.float32)
        parts = np.split(self.flat, np.cumsum(sizes)[:-1])
        self.tables, self.bias, self.up, self.up_bias, self.in_, self.in_bias = (p.reshape(s) for p, s in zip(parts, self.SHAPES))
        self._room = None

    def _ordered(self, context: np.ndarray, target: np.ndarray):
        """The tokens' order by group; in that order their contexts (a row for each place), hidden layer and ones (a row for each
        unit), group and member, and for each group that has tokens its range."""
        group = (target // MEMBERS).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        group = group[order]
        cut = np.searchsorted(group, np.arange(GROUPS + 1, dtype=np.uint16)).tolist()
        ranges = [(g, slice(a, b)) for g, (a, b) in enumerate(zip(cut, cut[1:])) if a < b]
        context = np.take(context.T, order, axis=1)
        z = self.bias + np.take(self.tables[0], context[0], axis=0)
        for p in range(1, 2 * SIDE):
            z += np.take(self.tables[p], context[p], axis=0)
        hidden = np.ones((HIDDEN + 1, len(order)), np.float32)
        np.tanh(z.T, out=hidden[:HIDDEN])
        return order, context, hidden, group, target[order] % MEMBERS, ranges

    def _sums(self, hidden: np.ndarray, ranges: list) -> tuple[np.ndarray, np.ndarray]:
        """What goes into the softmax over the groups and into that over the members of each token's group, a column for each token."""
        n = hidden.shape[1]
        if self._room is None or self._room.shape[1] != n:
            self._room = np.empty((GROUPS + MEMBERS, n), np.float32)
        by_group, by_member = self._room[:GROUPS], self._room[GROUPS:]
        np.matmul(np.vstack([self.up, self.up_bias]).T, hidden, out=by_group)
        inner = np.concatenate([self.in_, self.in_bias[:, None]], axis=1).transpose(0, 2, 1)
        for g, at in ranges:
            np.matmul(inner[g], hidden[:, at], out=by_member[:, at])
        return by_group, by_member

    def score(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target."""
        order, _, hidden, group, member, ranges = self._ordered(context, target)
        sums, column = np.zeros(len(order)), np.arange(len(order))
        for z, own in zip(self._sums(hidden, ranges), (group, member)):
            z -= z.max(axis=0)
            sums += z[own, column]
            sums -= np.log(np.exp(z, out=z).sum(axis=0))
        out = np.empty(len(order))
        out[order] = sums
        return out

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        """One step of gradient descent; each row of a table moves by the mean over its tokens."""
        order, context, hidden, group, member, ranges = self._ordered(context, target)
        n, column = len(order), np.arange(len(order))
        by_group, by_member = self._sums(hidden, ranges)
        for z, own in ((by_group, group), (by_member, member)):
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= z.sum(axis=0)
            z[own, column] -= 1
        back = self.up @ by_group
        moved = RATE / n * (hidden @ by_group.T)
        self.up -= moved[:HIDDEN]
        self.up_bias -= moved[HIDDEN]
        inner, moved = np.empty_like(back), np.zeros((GROUPS, HIDDEN + 1, MEMBERS), np.float32)
        for g, at in ranges:
            err = by_member[:, at]
            np.matmul(self.in_[g], err, out=inner[:, at])
            np.matmul(hidden[:, at], err.T, out=moved[g])
            moved[g] *= RATE / (at.stop - at.start)
        self.in_ -= moved[:, :HIDDEN]
        self.in_bias -= moved[:, HIDDEN]
        back += inner
        back *= 1 - hidden[:HIDDEN] ** 2
        self.bias -= RATE / n * back.sum(axis=1)
        back = back.astype(np.float64)
        for p in range(2 * SIDE):
            total = np.array([np.bincount(context[p], unit, SIZE + 1) for unit in back])
            total *= RATE / (np.bincount(context[p], minlength=SIZE + 1) + 8)
            self.tables[p] -= total.T


def windows(words: K.Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Context ids of each token (left to right, without itself) and its own id."""
    ids = vocabulary(words.hash)
    place = np.arange(len(ids)) - words.first[words.row]
    left = words.counts[words.row] - 1 - place
    padded = np.concatenate([np.full(SIDE, EDGE), ids, np.full(SIDE, EDGE)])
    context = np.empty((len(ids), 2 * SIDE), np.int64)
    for k, shift in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
        inside = place + shift >= 0 if shift < 0 else left >= shift
        context[:, k] = np.where(inside, padded[SIDE + shift : SIDE + shift + len(ids)], EDGE)
    return context, ids


def _words(column: pa.Array):
    for at, data, offsets in K.slices(column):
        yield at, len(offsets) - 1, K.Words(K.LOWER[data], offsets, K.ALNUM_WORDS)


def _count(batches):
    """Counts of words by fingerprint, combined within a slice."""
    for batch in batches:
        for _, _, words in _words(batch.column(0)):
            h, n = np.unique(words.hash, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (fingerprint) and ``n`` of every word of the corpus, as a table in the shared folder."""
    return write_table(texts.select("_text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")


def frequent_words(counts: DataFrame) -> tuple[list[int], np.ndarray]:
    """Fingerprints of the most frequent words, by falling count, and the start weights.

    The start predicts each id by its frequency in the corpus: the output biases are log frequencies.
    """
    head = counts.orderBy(F.desc("n"), "word").limit(SIZE - SHARED).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = np.full(SIZE, 1.0)
    own[: len(head)] += [r["n"] for r in head]
    own[SIZE - SHARED :] += (total - sum(r["n"] for r in head)) / SHARED
    net, by_group = Net(), own.reshape(GROUPS, MEMBERS)
    net.up_bias[:] = np.log(by_group.sum(axis=1) / own.sum())
    net.in_bias[:] = np.log(by_group / by_group.sum(axis=1, keepdims=True))
    return [r["word"] for r in head], net.flat


def shares(counts: DataFrame, frequent: list[int]) -> dict:
    """What tells words of a shared id apart: counts of the ``HEAD`` most frequent words (as whole classes of an eighth of a power
    of two), whether those are all, and for each shared id the count of all its words."""
    classed = counts.withColumn("class", F.floor(F.log2("n") * 8))
    room, least = HEAD, None
    for r in classed.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["class"]
    head = classed.where(F.lit(False) if least is None else F.col("class") >= least).select("word", "n").toArrow()
    words, n = head.column("word").to_numpy().view(K.U), head.column("n").to_numpy()
    order = np.argsort(words)
    total = np.ones(SHARED)
    rest = counts.where(~F.col("word").isin(frequent)) if frequent else counts
    # SHARED is a power of two, so that the remainder is that of the unsigned number
    for r in rest.groupBy(F.pmod("word", F.lit(SHARED)).alias("id")).agg(F.sum("n").alias("n")).collect():
        total[r["id"]] += r["n"]
    return {"words": words[order], "log_n": np.log(n[order]), "log_total": np.log(total), "whole": room >= 0}


def _train(sent):
    def run(batches):
        vocabulary, start = sent.value
        net, tokens, part = Net(start.copy()), 0, 0
        draw = np.random.default_rng(5)
        for batch in batches:
            if batch.num_rows:
                part = batch.column(1)[0].as_py()
            for _, _, words in _words(batch.column(0)):
                context, ids = windows(words, vocabulary)
                order = draw.permutation(len(ids))
                for a in range(0, len(ids), BATCH):
                    net.step(context[order[a : a + BATCH]], ids[order[a : a + BATCH]])
                tokens += len(ids)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tokens], pa.int64()), pa.array([(net.flat.astype(np.float64) * tokens).tobytes()], pa.binary())], names=["part", "tokens", "weights"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.zeros(sum(int(np.prod(s)) for s in Net.SHAPES))
    for chunk in table.column("weights").chunks:
        for raw in chunk:
            total += np.frombuffer(raw.as_py(), np.float64)
    tokens = sum(table.column("tokens").to_pylist())
    return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "tokens": pa.array([tokens], pa.int64()), "weights": pa.array([total.tobytes()], pa.binary())})


def train(docs: DataFrame, text_col: str = "text") -> dict:
    """The model: frequent words, the averaged weights and the head of counts, small and on the driver, and the table of all words (``words``)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(named(text_col).cast("string"), F.lit("")).alias("_text"))
    counts = word_counts(texts)
    frequent, weights = frequent_words(counts)
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    schema = "part int, tokens long, weights binary"
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((Vocabulary(frequent), weights))
        some = texts.where(F.pmod(F.xxhash64("_text"), F.lit(ROUNDS)) == turn).coalesce(max(1, tokens // ROUNDS // LEARNER_TOKENS))
        sums = some.select("_text", F.spark_partition_id().alias("part")).mapInArrow(_train(sent), schema)
        sums, learners = write_table(sums, "learners"), max(1, tokens // ROUNDS // LEARNER_TOKENS)
        while learners > FAN:
            sums, learners = sums.groupBy(F.expr(f"cast(part / {FAN} as int)")).applyInArrow(_add, schema), -(-learners // FAN)
        total, weighted = 0, None
        for r in sums.toLocalIterator():  # at most FAN rows of the network's size, one partition at a time
            total += r["tokens"]
            weighted = np.frombuffer(r["weights"], np.float64) + (0 if weighted is None else weighted)
        if total:
            weights = (weighted / total).astype(np.float32)
    return {"frequent": frequent, "weights": weights, "words": counts, "shares": shares(counts, frequent)}


def _score(model):
    """Rows of two kinds: texts with their sums, and words of a text beyond the head of counts (only if the model has shares)."""
    names = ["_slice", "_row", "_carry", "n_tokens", "sum", "word", "times"]

    def run(batches):
        vocabulary, net, share = Vocabulary(model.value["frequent"]), Net(model.value["weights"]), model.value["shares"]
        for batch in batches:
            for at, rows, words in _words(batch.column(0)):
                context, ids = windows(words, vocabulary)
                scores = np.zeros(len(ids) + 1)
                for a in range(0, len(ids), SCORED):
                    scores[a : min(len(ids), a + SCORED)] = net.score(context[a : a + SCORED], ids[a : a + SCORED])
                name, carry = secrets.randbits(62), batch.column(1).slice(at, rows)
                beyond = np.zeros(0, np.int64)
                if share is not None and len(shared := np.flatnonzero(ids >= SIZE - SHARED)):
                    h = words.hash[shared]
                    spot = np.minimum(np.searchsorted(share["words"], h), max(len(share["words"]) - 1, 0))
                    known = share["words"][spot] == h if len(share["words"]) else np.zeros(len(h), bool)
                    own = np.full(len(h), np.log(UNSEEN))
                    own[known] = share["log_n"][spot[known]]
                    scores[shared] += own - share["log_total"][ids[shared] - (SIZE - SHARED)]
                    beyond = shared[~known] if not share["whole"] else beyond
                total = np.add.reduceat(scores, words.first[:-1]) * (words.counts > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, name)), pa.array(np.arange(rows, dtype=np.int32)), carry, pa.array(words.counts), pa.array(total), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int32())], names=names)
                if len(beyond):
                    order = beyond[np.lexsort((words.hash[beyond], words.row[beyond]))]
                    h, row = words.hash[order], words.row[order]
                    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
                    n = len(first)
                    times = np.diff(np.append(first, len(order)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, name)), pa.array(row[first].astype(np.int32)), pa.nulls(n, carry.type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(h[first].view(np.int64)), pa.array(times.astype(np.int32))], names=names)

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, words: bool = True) -> DataFrame:
    """One row per document: ``id_col``, carried columns, ``n_tokens``, ``log_likelihood`` and ``mean_log_probability``.

    The probabilities are those of the words; with ``words=False`` those of their ids alone.
    """
    texts = keyed(docs, id_col, text_col, carry).select("_text", "_carry")
    kind = texts.schema["_carry"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast({"frequent": model["frequent"], "weights": model["weights"], "shares": model["shares"] if words else None})
    made = texts.mapInArrow(_score(sent), f"_slice long, _row int, _carry {kind}, n_tokens long, sum double, word long, times int")
    total = F.col("sum")
    if words and not model["shares"]["whole"]:
        made = write_table(made, "scored")
        asked = made.where("word is not null").select("_slice", "_row", "word", "times").join(model["words"], "word")
        more = asked.groupBy("_slice", "_row").agg(F.sum((F.log("n") - float(np.log(UNSEEN))) * F.col("times")).alias("more"))
        made = made.where("word is null").join(more, ["_slice", "_row"], "left")
        total = total + F.coalesce("more", F.lit(0.0))
    return made.select("_carry.*", "n_tokens", total.alias("log_likelihood"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_log_probability"))
