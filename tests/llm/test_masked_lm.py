import re

import numpy as np

from pagewright.llm import kernels as K
from pagewright.llm import masked_lm as M

SF = "/root/testdata/sf0.01"


def fingerprint(word):
    raw = np.frombuffer(word.encode(), np.uint8)
    return K.Words(raw, np.array([0, len(raw)]), K.ALNUM_WORDS).hash


def plain_score(text, model):
    """Token by token, in double precision."""
    net, vocabulary = M.Net(model["weights"]), M.Vocabulary(model["frequent"])
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    ids = []
    for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low):
        ids.append(int(vocabulary(fingerprint(w))[0]))
    total = 0.0
    for i, target in enumerate(ids):
        around = [ids[j] if 0 <= j < len(ids) else M.EDGE for j in (i - 2, i - 1, i + 1, i + 2)]
        h = np.tanh(net.bias.astype(float) + sum(net.tables[p][x].astype(float) for p, x in enumerate(around)))
        g, m = divmod(target, M.MEMBERS)
        for z, k in ((h @ net.up + net.up_bias, g), (h @ net.in_[g] + net.in_bias[g], m)):
            total += z[k] - np.log(np.exp(z).sum())
    return len(ids), total


def test_learns_and_scores_exactly(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = M.train(docs)
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(30).collect()]
    odd = [(5000, None), (5001, ""), (5002, "!!"), (5003, "one"), (None, "The of")]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows + odd], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: r for r in M.score(df, model, words=False).collect()}
    for k, t in rows[:8] + odd:
        n, total = plain_score(t, model)
        assert got[k]["n_tokens"] == n and np.isclose(got[k]["log_likelihood"], total, rtol=1e-4, atol=1e-4)
    assert got[5000]["mean_log_probability"] is None and got[5000]["log_likelihood"] == 0
    # the start weights know how frequent each id is; the trained ones must know more, from the words on either side
    start = M.frequent_words(model["words"])[1]
    before = {r["doc_id"]: r["log_likelihood"] for r in M.score(df, {**model, "weights": start}, words=False).collect()}
    ratio = [got[k]["log_likelihood"] / before[k] for k, _ in rows]
    assert np.mean(ratio) < 0.97 and np.mean([x < 1 for x in ratio]) > 0.9


def test_gradient():
    """A step lowers the loss on its own batch."""
    r = np.random.default_rng(0)
    net = M.Net()
    context, target = r.integers(0, M.SIZE + 1, (500, 4)), r.integers(0, M.SIZE, 500)
    losses = []
    for _ in range(15):
        losses.append(-net.score(context, target).mean())
        net.step(context, target)
    assert losses[-1] < losses[0] - 0.2 and all(b < a + 0.02 for a, b in zip(losses, losses[1:]))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = M.train(df)
    assert model["frequent"] == [] and M.score(df, model).collect() == []


def test_words_that_share_an_id(spark, monkeypatch):
    """With the table of counts, words of one id differ by their counts, and unseen words come last."""
    common = [f"w{i}" for i in range(M.SIZE - M.SHARED)]
    rare = [f"r{i}" for i in range(600)]
    texts = [" ".join(common * 3)] + [" ".join(rare[i::20]) for i in range(20)] + [f"{rare[0]} {rare[0]}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    model = M.train(docs)
    count = dict.fromkeys(rare, 1) | {rare[0]: 3}

    def bucket(w):
        return int(M.Vocabulary(model["frequent"])(fingerprint(w))[0])

    shared = [w for w in rare if bucket(w) >= M.SIZE - M.SHARED]
    first = shared[0]
    rest = {}
    for w in shared:
        rest[bucket(w)] = rest.get(bucket(w), 0) + count[w]
    unseen = next(w for i in range(100000) if bucket(w := f"zq{i}") == bucket(first))
    rows = [(0, first), (1, unseen), (2, f"{unseen} {common[5]} {first} {first}"), (3, None), (4, "!"), (0, first)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = {r["doc_id"]: r["log_likelihood"] for r in M.score(df, model, words=False).collect()}
    got = M.score(df, model).collect()
    # without a head of counts, the join brings them
    monkeypatch.setattr(M, "HEAD", 5)
    joined = {**model, "shares": M.shares(model["words"], model["frequent"])}
    assert model["shares"]["whole"] and not joined["shares"]["whole"] and len(joined["shares"]["words"]) <= 5
    assert np.allclose(model["shares"]["log_total"], joined["shares"]["log_total"])
    again = sorted((str(r["doc_id"]), r["n_tokens"], r["log_likelihood"]) for r in M.score(df, joined).collect())
    assert np.allclose([r[2] for r in again], [r[2] for r in sorted((str(r["doc_id"]), r["n_tokens"], r["log_likelihood"]) for r in got)])
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == [(0, 1), (0, 1), (1, 1), (2, 4), (3, 0), (4, 0)]
    one, other = np.log(count[first] / (rest[bucket(first)] + 1)), np.log(M.UNSEEN / (rest[bucket(first)] + 1))
    want = {0: one, 1: other, 2: other + 2 * one, 3: 0, 4: 0}
    assert all(np.isclose(r["log_likelihood"] - by_id[r["doc_id"]], want[r["doc_id"]]) for r in got)
    assert np.isclose(by_id[0], by_id[1]) and other < one


def mean_score(docs, model):
    r = M.score(docs, model, words=False).selectExpr("sum(log_likelihood) as s", "sum(n_tokens) as n").first()
    return r["s"] / r["n"]


def test_learns_at_any_partitioning(spark, monkeypatch):
    """64 partitions learn as much as one; and where there are many learners, their average still gains on the start."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    few, many = (docs.repartition(n, "doc_id") for n in (1, 64))
    one = M.train(few)
    start = mean_score(docs, {**one, "weights": M.frequent_words(one["words"])[1]})
    scores = [mean_score(docs, m) for m in (one, M.train(many))]
    assert scores[0] > start + 0.3 and abs(scores[1] / scores[0] - 1) < 0.02
    monkeypatch.setattr(M, "LEARNER_TOKENS", 20_000)
    monkeypatch.setattr(M, "FAN", 3)
    assert mean_score(docs, M.train(many)) > start + 0.03


def test_clashing_columns_repeated_rows_and_a_long_text(spark):
    long = "the quick fox " * 100_000
    rows = [(1, "a b c", 5), (1, "a b c", 5), (None, None, None), (2, long, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int").withColumnsRenamed({"part": "_text"})
    got = M.score(df, M.train(df), carry=["_text"]).collect()
    assert sorted(((r["doc_id"], r["n_tokens"], r["_text"]) for r in got), key=str) == sorted([(1, 3, 5), (1, 3, 5), (None, 0, None), (2, 300_000, 1)], key=str)
    assert len({r["log_likelihood"] for r in got if r["doc_id"] == 1}) == 1


class PlainNet(M.Net):
    """A step and scores with whole rows, group by group, in plain terms."""

    def softmax(self, h, up, bias):
        z = np.exp((h @ up + bias).astype(float))
        return z / z.sum(axis=1, keepdims=True)

    def layer(self, context):
        return np.tanh(self.bias + sum(self.tables[p][context[:, p]] for p in range(2 * M.SIDE)))

    def score(self, context, target):
        h = self.layer(context)
        first = self.softmax(h, self.up, self.up_bias)
        return np.array([np.log(first[i, t // M.MEMBERS] * self.softmax(h[i : i + 1], self.in_[t // M.MEMBERS], self.in_bias[t // M.MEMBERS])[0, t % M.MEMBERS]) for i, t in enumerate(target)])

    def step(self, context, target):
        h, n, group, member = self.layer(context), len(target), target // M.MEMBERS, target % M.MEMBERS
        err = self.softmax(h, self.up, self.up_bias) - np.eye(M.GROUPS)[group]
        back = err @ self.up.T
        self.up -= M.RATE * h.T @ err / n
        self.up_bias -= M.RATE * err.mean(axis=0)
        for g in np.unique(group):
            at = np.flatnonzero(group == g)
            err = self.softmax(h[at], self.in_[g], self.in_bias[g]) - np.eye(M.MEMBERS)[member[at]]
            back[at] += err @ self.in_[g].T
            self.in_[g] -= M.RATE * h[at].T @ err / len(at)
            self.in_bias[g] -= M.RATE * err.mean(axis=0)
        back *= 1 - h * h
        self.bias -= M.RATE * back.mean(axis=0)
        for p in range(2 * M.SIDE):
            for x in np.unique(context[:, p]):
                at = context[:, p] == x
                self.tables[p][x] -= M.RATE * back[at].sum(axis=0) / (at.sum() + 8)


def test_steps_and_scores_of_a_plain_network():
    """Batches of any size, also with a single token or with one group alone, move the weights as the plain network's."""
    r = np.random.default_rng(2)
    one, other = M.Net(), PlainNet()
    for n, most in ((700, M.SIZE), (1, M.SIZE), (300, 40), (700, 300), (33, M.SIZE)):
        context, target = r.integers(0, min(most, M.SIZE) + 1, (n, 4)), r.integers(0, most, n)
        one.step(context, target)
        other.step(context, target)
        assert np.allclose(one.flat, other.flat, atol=1e-4)
        assert np.allclose(one.score(context, target), other.score(context, target), atol=1e-3)


def test_a_step_works_on_one_block_of_memory():
    """The numbers of a batch's softmaxes stand in one block that the next batch uses again."""
    r = np.random.default_rng(4)
    net, made = M.Net(), []
    for _ in range(3):
        net.step(r.integers(0, M.SIZE, (M.BATCH, 4)), r.integers(0, M.SIZE, M.BATCH))
        made.append(net._room)
    assert made[0] is made[1] is made[2] and made[0].nbytes == M.BATCH * (M.GROUPS + M.MEMBERS) * 4
