"""Byte-level BPE encoding and decoding; merges are found with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold ``rank * width + position`` of the pair that starts at each position. The root thus yields the
leftmost pair of the lowest rank; merging it changes at most three leaves, each updated up to the root in logarithmic time.
The loop ends when no mergeable pair is left. Words of up to ``WIDE`` bytes run side by side in numpy, one merge of every word
at a time; longer ones have a tree of their own. Codes of words seen before are kept in a bounded memo of the worker.

The vocabulary is the JSON of a byte-level BPE tokenizer without normalizer; its path is a parameter and is read on the driver,
its size (below ``VOCAB_BYTES``) is checked and it is broadcast. Special tokens in a text are taken as such.

Defined cases: a null text is the empty text and has no codes; texts of any length are cut at safe places into pieces of
``PIECE`` characters; bytes that are no UTF-8 after decoding become replacement characters; repeated rows give equal results;
an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm import kernels as K
from pagewright.llm._shared import kept_by_worker, keyed, named

#: The public pattern that splits text before byte-level merges, white space as Unicode defines it.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
WIDE = 64
NONE = np.int64(1) << np.int64(62)
#: Words kept by a worker, and words whose codes are sought at a time.
MEMO = 100_000
GROUP = 1 << 17
PIECE = 1 << 20
VOCAB_BYTES = 64 << 20


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary: itself if printable in Latin-1, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def load_spec(path: str) -> dict:
    """The vocabulary as plain tables, read on the driver."""
    with open(path, "rb") as f:
        raw = f.read(VOCAB_BYTES + 1)
    if len(raw) > VOCAB_BYTES:
        raise ValueError(f"{path} is larger than {VOCAB_BYTES} bytes, too large to broadcast")
    spec = json.loads(raw)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
        raise ValueError(f"{path} is no plain byte-level BPE")
    for t in spec["added_tokens"]:
        if t["lstrip"] or t["rstrip"] or t["single_word"]:
            raise ValueError(f"{path}: special token {t['content']} strips its surroundings")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
    table = [b""] * size
    for token, i in vocab.items():
        table[i] = bytes(alphabet[c] for c in token)
    for t in spec["added_tokens"]:
        table[t["id"]] = t["content"].encode()
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    single = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda x: x[1])]
    return {
        "table": table, "single": single, "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
        "left": [vocab[a] for a, _ in pairs], "right": [vocab[b] for _, b in pairs], "to": [vocab[a + b] for a, b in pairs],
    }


class Bpe:
    def __init__(self, spec: dict):
        self.size = len(spec["table"])
        self.single = np.array(spec["single"], np.int64)
        self.to = np.array(spec["to"], np.int64)
        key = np.array(spec["left"], np.int64) * self.size + np.array(spec["right"], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = np.append(key[order], -1), np.append(order, 0)
        self.rank_of = dict(zip(reversed(key.tolist()), range(len(key) - 1, -1, -1)))
        self.special = spec["special"]
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.memo: dict[str, bytes] = {s: np.uint32(i).tobytes() for s, i in self.special.items()}
        self.bytes = np.frombuffer(b"".join(spec["table"]), np.uint8)
        self.ends = np.cumsum([len(t) for t in spec["table"]])
        self.starts = np.append(0, self.ends[:-1])

    def pieces(self, text: str):
        """Words of the text before merging, as lists of the words of a piece; special tokens are words of their own."""
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                yield [part]
                continue
            while len(part) > PIECE:
                # before a single blank between other characters a word always ends
                at = regex.search(r"(?<=\P{White_Space}) (?=\P{White_Space})", part, pos=PIECE)
                if not at:
                    break
                yield self.split.findall(part[: at.start()])
                part = part[at.start() :]
            yield self.split.findall(part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Codes of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        group: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for words in self.pieces(text):
                group.append((k, words))
                size += len(words)
                if size > GROUP:
                    self._codes(group, out)
                    group, size = [], 0
        self._codes(group, out)
        return [b"".join(parts) for parts in out]

    def _codes(self, group: list[tuple[int, list[str]]], out: list[list[bytes]]) -> None:
        every = set().union(*(words for _, words in group))
        new = [w for w in every if w not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo = {s: np.uint32(i).tobytes() for s, i in self.special.items()}
            new = [w for w in every if w not in self.memo]
        del every
        for a in range(0, len(new), 1 << 16):
            part = new[a : a + (1 << 16)]
            self.memo.update(zip(part, self.merge([w.encode() for w in part])))
        get = self.memo.__getitem__
        for k, words in group:
            out[k].append(b"".join(map(get, words)))

    def merge(self, words: list[bytes]) -> list[bytes]:
        out: list[bytes] = [b""] * len(words)
        sizes = np.array([len(w) for w in words])
        width = 2
        while width <= WIDE:
            at = np.flatnonzero((sizes <= width) & (sizes > (width // 2 if width > 2 else 0)))
            for a in range(0, len(at), step := (1 << 17) // width):
                part = at[a : a + step]
                ids, alive = self._side_by_side([words[i] for i in part], width)
                count = alive.sum(axis=1)
                raw, edge = ids[alive].astype("<u4").tobytes(), np.append(0, np.cumsum(count)) * 4
                for i, x, y in zip(part.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
                    out[i] = raw[x:y]
            width *= 2
        for i in np.flatnonzero(sizes > WIDE).tolist():
            out[i] = self._alone(words[i])
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.key[:-1], key)
        return np.where(self.key[at] == key, self.rank[at], NONE)

    def _side_by_side(self, words: list[bytes], width: int):
        n = len(words)
        flat = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        size = np.array([len(w) for w in words])
        ids, place = self.single[flat], np.arange(width)
        alive = place[None, :] < size[:, None]
        after = np.where(place[None, :] + 1 < size[:, None], place + 1, width)
        before = np.broadcast_to(place - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        paired = (after[:, :-1] < width) & (rank < NONE)
        tree[:, width : 2 * width - 1] = np.where(paired, rank * width + place[:-1], NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        go = np.flatnonzero(tree[:, 1] < NONE)
        while len(go):
            root = tree[go, 1]
            i = root % width
            j = after[go, i]
            k = after[go, j]
            made = self.to[root // width]
            ids[go, i], after[go, i], alive[go, j] = made, k, False
            inner = k < width
            before[go[inner], k[inner]] = i[inner]
            tree[go, width + j] = NONE
            nxt = self._ranks(made, ids[go, np.minimum(k, width - 1)])
            tree[go, width + i] = np.where(inner & (nxt < NONE), nxt * width + i, NONE)
            p = before[go, i]
            has = p >= 0
            q = np.maximum(p, 0)
            prev = self._ranks(ids[go, q], made)
            leaf = np.where(prev < NONE, prev * width + q, NONE)
            tree[go[has], width + q[has]] = leaf[has]
            nodes = [(width + x) >> 1 for x in (i, j, q)]
            while nodes[0][0] >= 1:
                for node in nodes:
                    tree[go, node] = np.minimum(tree[go, 2 * node], tree[go, 2 * node + 1])
                nodes = [node >> 1 for node in nodes]
            go = go[tree[go, 1] < NONE]
        return ids, alive

    def _alone(self, word: bytes) -> bytes:
        n = len(word)
        width = 1 << (n - 1).bit_length()
        none, rank_of, size = int(NONE), self.rank_of, self.size
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = self._ranks(np.array(ids[:-1]), np.array(ids[1:]))
        leaves = np.where(leaves < NONE, leaves * width + np.arange(n - 1), NONE)
        levels = [np.append(leaves, np.full(width - n + 1, NONE))]
        while len(levels[-1]) > 1:
            levels.append(np.minimum(levels[-1][::2], levels[-1][1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        alive = bytearray(b"\1") * n

        def put(leaf: int, value: int) -> None:
            node = width + leaf
            tree[node] = value
            while node > 1:
                node >>= 1
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b

        def pair(a: int) -> int:
            b = after[a]
            found = rank_of.get(ids[a] * size + ids[b]) if b < n else None
            return none if found is None else found * width + a

        while tree[1] < none:
            rank, i = divmod(tree[1], width)
            j = after[i]
            ids[i], after[i], alive[j] = int(self.to[rank]), after[j], 0
            if after[i] < n:
                before[after[i]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        return np.array([x for x, a in zip(ids, alive) if a], "<u4").tobytes()

    def decode(self, codes: list[bytes]) -> list[str]:
        ids = np.frombuffer(b"".join(codes), "<u4").astype(np.int64)
        starts, ends = self.starts[ids], self.ends[ids]
        sizes = np.append(0, np.cumsum(ends - starts))
        raw = K.gather(self.bytes, starts, ends).tobytes()
        edge = sizes[np.append(0, np.cumsum([len(c) // 4 for c in codes]))].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(edge[:-1], edge[1:])]


def _of(spec) -> Bpe:
    """One tokenizer for each vocabulary and worker, so that its memo outlives a task."""
    name, tables = spec.value
    return kept_by_worker(name, lambda: Bpe(tables))


def _texts(column: pa.Array):
    for at, data, offsets in K.slices(column, 2 << 20):
        raw = data.tobytes()
        yield at, [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def _encode(spec):
    def run(batches):
        bpe = _of(spec)
        for batch in batches:
            for at, texts in _texts(batch.column(0)):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.array(bpe.encode(texts), pa.binary())], names=["_carry", "ids"])

    return run


def _round_trip(spec):
    def run(batches):
        bpe = _of(spec)
        for batch in batches:
            for at, texts in _texts(batch.column(0)):
                ids = bpe.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(texts)), pa.array(ids, pa.binary()), pa.array(bpe.decode(ids), pa.string())], names=["_carry", "ids", "decoded"])

    return run


def _decode(spec):
    def run(batches):
        bpe = _of(spec)
        for batch in batches:
            for at, data, offsets in K.slices(batch.column(0)):
                raw = data.tobytes()
                codes = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                rows = [batch.column(i).slice(at, len(codes)) for i in (1, 0)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(bpe.decode(codes), pa.string())], names=["_carry", "ids", "decoded"])

    return run


def _spec_of(df: DataFrame, path: str):
    spec = load_spec(path)
    return df.sparkSession.sparkContext.broadcast((hashlib.sha256(repr(spec).encode()).hexdigest(), spec))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``id_col``, the carried columns and ``ids``, its codes as little-endian unsigned 32-bit integers."""
    texts = keyed(docs, id_col, text_col, carry).select("_text", "_carry")
    kind = texts.schema["_carry"].dataType.simpleString()
    return texts.mapInArrow(_encode(_spec_of(docs, path)), f"_carry {kind}, ids binary").select("_carry.*", "ids")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``encode`` and, from the codes alone, ``decode`` in one pass: ``id_col``, the carried columns, ``ids`` and ``decoded``.

    One worker process and one memo for each core do both, where ``decode(encode(...))`` has two.
    """
    texts = keyed(docs, id_col, text_col, carry).select("_text", "_carry")
    kind = texts.schema["_carry"].dataType.simpleString()
    return texts.mapInArrow(_round_trip(_spec_of(docs, path)), f"_carry {kind}, ids binary, decoded string").select("_carry.*", "ids", "decoded")


def decode(codes: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """The frame with ``decoded``, the text of ``ids_col`` (null: empty); special tokens are kept.

    A column ``decoded`` of the input is replaced; if ``ids_col`` has that name, ``ValueError`` is raised.
    """
    if ids_col == "decoded":
        raise ValueError("the codes cannot be in a column named decoded")
    rest = [named(c) for c in codes.columns if c not in (ids_col, "decoded")]
    rows = codes.select(F.coalesce(named(ids_col), F.lit(b"")).alias("ids"), F.struct(*rest).alias("_carry"))
    kind = rows.schema["_carry"].dataType.simpleString()
    return rows.mapInArrow(_decode(_spec_of(codes, path)), f"_carry {kind}, ids binary, decoded string").select("_carry.*", F.col("ids").alias(ids_col), "decoded")
