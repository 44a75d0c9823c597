"""URL filters by a Bloom filter cascade: exact membership of the corpus's keys in a rule list, without a join.

A rule is a host and the beginning of a path; it fits its host, all subdomains, and paths that start so. The keys of a url
are its host and each parent domain, each followed by as much of the path as some rule has. The complete universe is the
set of keys of all urls of the corpus.

Level 1 encodes the listed keys; level 2 the keys of the universe that level 1 takes for listed by mistake (one pass over the
corpus finds them); level 3 the listed keys that level 2 takes for such a mistake, and so on in turn until none is left.
A key's answer is the parity of the first level that lacks it, exact for every key of the universe and of the list. A
second cascade over the listed keys alone tells those that block from those that allow. The longest listed key of a url is its
rule, of equally long ones that with the longer host; a url without one is not listed and is allowed.

The list is sent to the driver; its length is checked against ``MAX_RULES`` first. The first level is made so exact that its
mistakes number about as many as the list; they are counted before they are fetched, and the level is made twice as exact
as long as they are too many. So what is collected and broadcast is bounded by the list, whatever the corpus.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed; an empty table gives an empty
result; repeated urls get the same answer; very long urls have as many keys as they have host labels times path lengths of
rules; other columns are not looked at. A rule listed both to block and to allow is an error.
"""

from __future__ import annotations

import hashlib
import math
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm._shared import named

MAX_RULES = 500_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parse_rule(rule: str) -> tuple[str, str]:
    """``example.com/en/7`` as host and path; the path begins with the first slash."""
    host, slash, rest = rule.partition("/")
    return host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), slash + rest


def keys_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys of a url, longest first. A key has a blank between host and path, so that none has two readings."""
    if not host:
        return []
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    out = [f"{s} {path[:n]}" for s in suffixes for n in lengths if n <= len(path)]
    return sorted(out, key=len, reverse=True)


class Bloom:
    def __init__(self, keys: list[str], rate: float, salt: int):
        rate = min(0.5, max(rate, 1e-15))
        self.salt = salt.to_bytes(4, "little")
        self.bits = max(64, math.ceil(len(keys) * -math.log(rate) / math.log(2) ** 2))
        self.hashes = max(1, round(self.bits / max(1, len(keys)) * math.log(2)))
        self.field = bytearray(-(-self.bits // 8))
        for key in keys:
            for i in self._spots(key):
                self.field[i >> 3] |= 1 << (i & 7)

    def _spots(self, key: str):
        raw = hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=16, salt=self.salt).digest()
        a, b = int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little") | 1
        return [(a + i * b) % (1 << 64) % self.bits for i in range(self.hashes)]

    def __contains__(self, key: str) -> bool:
        return all(self.field[i >> 3] >> (i & 7) & 1 for i in self._spots(key))


class Cascade:
    """Levels of Bloom filters. ``listed`` and ``others`` (those keys of the universe that level 1 has) are told apart exactly."""

    def __init__(self, first: Bloom, listed: list[str], others: list[str]):
        self.levels = [first]
        inside, mistaken = listed, others
        while mistaken:
            level = Bloom(mistaken, 0.5, len(self.levels))
            self.levels.append(level)
            # the keys encoded a level before that this level takes as well are encoded by the next one
            inside, mistaken = mistaken, [k for k in inside if k in level]

    def __contains__(self, key: str) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def _mistaken(sent):
    def run(batches):
        first, listed, lengths = sent.value
        seen: set = set()
        for batch in batches:
            out = set()
            for host, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.update(k for k in keys_of(host, path, lengths) if k in first and k not in listed)
            out -= seen
            if len(seen) < 1 << 20:
                seen |= out
            yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], names=["key"])

    return run


def build(urls: DataFrame, rules: list[tuple[str, str]], url_col: str = "url") -> dict:
    """The filter for all urls of the corpus: two cascades and the path lengths of rules. ``rules``: (verdict, rule)."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules, more than {MAX_RULES}")
    verdicts: dict[str, str] = {}
    for verdict, rule in rules:
        if verdict not in ("block", "allow"):
            raise ValueError(f"no verdict: {verdict}")
        if verdicts.setdefault(" ".join(parse_rule(rule)), verdict) != verdict:
            raise ValueError(f"{rule} is listed to block and to allow")
    listed = sorted(verdicts)
    lengths = sorted({len(k.partition(" ")[2]) for k in listed})
    parts = urls.select(host_of(named(url_col)).alias("host"), path_of(named(url_col)).alias("path"))
    # as many keys as there can be: host suffixes times path lengths
    universe = parts.agg(F.sum((F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1) * len(lengths))).first()[0] or 1
    rate = max(1, len(listed)) / max(1, universe)
    while True:
        first = Bloom(listed, rate, 0)
        sent = urls.sparkSession.sparkContext.broadcast((first, frozenset(listed), lengths))
        wrong = parts.mapInArrow(_mistaken(sent), "key string").distinct().limit(4 * len(listed) + 1000)
        others = [r["key"] for r in wrong.collect()]
        if len(others) < 4 * len(listed) + 1000:
            break
        rate /= 2 * max(2, len(others) / max(1, len(listed)))
    blocked = [k for k in listed if verdicts[k] == "block"]
    allowed = [k for k in listed if verdicts[k] == "allow"]
    kinds = Bloom(blocked, 0.5, 1 << 16)
    return {"lengths": lengths, "listed": Cascade(first, listed, sorted(others)), "block": Cascade(kinds, blocked, [k for k in allowed if k in kinds])}


def _judge(sent):
    def run(batches):
        known = sent.value
        listed, block, lengths = known["listed"], known["block"], known["lengths"]
        for batch in batches:
            rules, verdicts = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                rule = next((k for k in keys_of(host, path, lengths) if k in listed), None)
                rules.append(rule and rule.replace(" ", "", 1))
                verdicts.append("block" if rule and rule in block else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["_carry", "host", "path", "rule", "verdict"])

    return run


def judge(urls: DataFrame, known: dict, id_col: str = "page_id", url_col: str = "url", carry: list[str] | None = None) -> DataFrame:
    """One row per url: ``id_col``, the carried columns, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``."""
    kept = [named(c) for c in dict.fromkeys([id_col, *(carry or [])])]
    rows = urls.select(F.struct(*kept).alias("_carry"), host_of(named(url_col)).alias("host"), path_of(named(url_col)).alias("path"))
    kind = rows.schema["_carry"].dataType.simpleString()
    sent = urls.sparkSession.sparkContext.broadcast(known)
    return rows.mapInArrow(_judge(sent), f"_carry {kind}, host string, path string, rule string, verdict string").select("_carry.*", "host", "path", "rule", "verdict")
