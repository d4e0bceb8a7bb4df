"""BPE encoding and decoding by dynamic programming over prefixes, for a vocabulary with word ends."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinelake.llm.common import slices
from cinelake.llm.words import SPECIAL, Pretokens, span_hashes

#: Fixed value: the mark that the vocabulary puts after the last symbol of a word.
WORD_END = "</w>"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by the published rule."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token ids are merge ranks. Holds the automaton of token suffixes and the tables of the pair test."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.names = [""] * len(vocab)
        for name, i in vocab.items():
            self.names[i] = name
        symbols, n = byte_symbols(), len(vocab)
        self.special = [t["id"] for s in SPECIAL for t in spec["added_tokens"] if t["content"] == s]
        self.left, self.right = np.arange(n, dtype=np.int64), np.arange(n, dtype=np.int64)
        keys = np.empty(len(merges), np.int64)
        ids = np.empty(len(merges), np.int64)
        for k, (a, b) in enumerate(merges):
            i = vocab[a + b]
            self.left[i], self.right[i] = vocab[a], vocab[b]
            keys[k], ids[k] = vocab[a] << 17 | vocab[b], i
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], ids[order]
        bare = [x.removesuffix(WORD_END) if x.endswith(WORD_END) and len(x) > len(WORD_END) else x for x in self.names]
        closed = [len(b) < len(x) for b, x in zip(bare, self.names, strict=True)]
        self.size = np.array([len(b) for b in bare], np.int64)
        self._automaton([[symbols[c] for c in b] for b in bare], closed)
        self.seen = np.full(1 << 18, -1, np.int64)  # pair tests already made, direct mapped
        self.said = np.zeros(1 << 18, bool)

    def _automaton(self, tokens: list[list[int]], closed: list[bool]) -> None:
        """Trie of all tokens with failure links, made complete: the state after a prefix is its longest suffix in it."""
        used = sorted({b for t in tokens for b in t})
        self.column = np.zeros(256, np.int64)
        self.column[used] = np.arange(len(used))
        column, width = self.column.tolist(), len(used)
        child: list[dict[int, int]] = [{}]
        token = [-1]  # token that ends at the node, open and closed
        token_end = [-1]
        depth_of = [0]
        for i, t in enumerate(tokens):
            at = 0
            for b in t:
                nxt = child[at].get(column[b])
                if nxt is None:
                    nxt = child[at][column[b]] = len(child)
                    child.append({})
                    token.append(-1), token_end.append(-1), depth_of.append(depth_of[at] + 1)
                at = nxt
            (token_end if closed[i] else token)[at] = i
        nodes = len(child)
        self.delta = np.zeros((nodes, width), np.int32)
        fail = np.zeros(nodes, np.int64)
        self.open, self.closed = np.array(token), np.array(token_end)
        shorter = np.full(len(tokens), -1, np.int64)
        level = [0]
        while level:
            parents = np.array(level)
            for p in level:
                for c, k in child[p].items():
                    fail[k] = self.delta[fail[p], c] if p else 0
            if level[0]:
                self.delta[parents] = self.delta[fail[parents]]
            below = []
            for p in level:
                for c, k in child[p].items():
                    self.delta[p, c] = k
                    below.append(k)
            if below:
                k = np.array(below)
                for own in (self.open, self.closed):
                    has = own[k] >= 0
                    shorter[own[k[has]]] = own[fail[k[has]]]
                    own[k[~has]] = own[fail[k[~has]]]
            level = below
        self.shorter = shorter

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether byte-pair merging of the two tokens' bytes gives exactly (a, b): undo merges at the seam, newest first,
        and look for a merge across it that would have come before."""
        key = a << 17 | b
        slot = (key * 0x2545F491 >> 9) & (len(self.seen) - 1)
        out = self.said[slot]
        todo = np.flatnonzero(self.seen[slot] != key)
        if len(todo):
            found = self._test(a[todo], b[todo])
            out[todo] = found
            self.seen[slot[todo]] = key[todo]
            self.said[slot[todo]] = found
            # two pairs of one batch may share a slot; keep only what the slot's key says
            bad = self.seen[slot[todo]] != key[todo]
            if bad.any():
                lost = np.unique(slot[todo][bad])
                self.seen[lost] = -1
        return out

    def _test(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40, np.int64)
        result = np.ones(len(a), bool)
        live = np.arange(len(a))
        top = len(self.pair_keys) - 1
        while len(live):
            x, y = a[live], b[live]
            key = x << 17 | y
            at = np.minimum(np.searchsorted(self.pair_keys, key), top)
            broken = (self.pair_keys[at] == key) & (self.pair_ids[at] < limit[live])
            result[live[broken]] = False
            live, x, y = live[~broken], x[~broken], y[~broken]
            undo_left = x > y
            left_whole, right_whole = self.right[x] == x, self.left[y] == y
            # the newer token is undone; if it is a single symbol, the other one is
            go_left = (undo_left & ~left_whole) | (~undo_left & right_whole & ~left_whole)
            go_right = (~undo_left & ~right_whole) | (undo_left & left_whole & ~right_whole)
            limit[live] = np.where(go_left, x, y + 1)
            a[live] = np.where(go_left, self.right[x], x)
            b[live] = np.where(go_right, self.left[y], y)
            live = live[go_left | go_right]
        return result

    def encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each word (a span of bytes, not empty), and where each word's ids start (one more at the end).

        For every prefix of every word, the unique last token is stored: of the tokens that are suffixes of the prefix,
        longest first, the one that is compatible with the last token of what remains. All words advance together.
        """
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        begin, size = starts[order], size[order]
        base = np.concatenate([[0], np.cumsum(size + 1)])
        last = np.full(base[-1], -1, np.int64)
        count = np.zeros(base[-1], np.int64)
        state = np.zeros(len(order), np.int64)
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # words of at least i bytes
        for i in range(1, longest + 1):
            k = int(alive[i - 1])
            more = int(alive[i]) if i < longest else 0
            state[:k] = self.delta[state[:k], self.column[data[begin[:k] + i - 1]]]
            candidate = np.where(np.arange(k) < more, self.open[state[:k]], self.closed[state[:k]])
            pending = np.arange(k)
            while len(pending):
                t = candidate[pending]
                before = base[pending] + i - self.size[t]
                fits = before == base[pending]
                rest = np.flatnonzero(~fits)
                if len(rest):
                    fits[rest] = self.compatible(last[before[rest]], t[rest])
                done = pending[fits]
                last[base[done] + i] = t[fits]
                count[base[done] + i] = count[before[fits]] + 1
                pending = pending[~fits]
                candidate[pending] = self.shorter[candidate[pending]]
        tokens = count[base[:-1] + size]
        offsets = np.zeros(len(order) + 1, np.int64)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        offsets[1:] = np.cumsum(tokens[back])
        ids = np.empty(offsets[-1], np.uint32)
        at, put, live = base[:-1] + size, offsets[1:][order] - 1, np.arange(len(order))
        while len(live):
            t = last[at[live]]
            ids[put[live]] = t
            at[live] -= self.size[t]
            put[live] -= 1
            live = live[at[live] > base[live]]
        return ids, offsets


class Encoder:
    """Encodes and decodes texts as the tokenizers library does with this vocabulary and add_special_tokens=False.

    Texts split at the special tokens' strings; the rest is normalised (NFC, white space, lower case) and cut into
    pre-tokens. Each distinct pre-token is encoded once and kept, up to ``most_words`` of them; then the store starts
    anew, which bounds memory and changes no result.
    """

    def __init__(self, path: str, most_words: int = 200_000):
        from tokenizers import Tokenizer

        self.vocabulary = Vocabulary(path)
        library = Tokenizer.from_file(path)
        self.normalize, self.pieces = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.most_words = most_words
        self._reset()

    def _reset(self) -> None:
        v = self.vocabulary
        self.row = {1: 0, 2: 1}
        self.ids = [np.array([i], np.uint32).tobytes() for i in v.special]
        self.text = [s.encode() for s in SPECIAL]

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each pre-token of the batch: its row in ``ids`` and ``text``; and where each text's pre-tokens start."""
        if len(self.row) > self.most_words:
            self._reset()
        p = Pretokens(texts, self._cut)
        keys = np.where(p.special > 0, p.special.astype(np.uint64), span_hashes(p.data, p.starts, p.ends))
        distinct, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        row = self.row
        known = np.array([row.get(x, -1) for x in distinct.tolist()], np.int64)
        new = np.flatnonzero(known < 0)
        if len(new):
            v = self.vocabulary
            ids, off = v.encode_words(p.data, p.starts[at[new]], p.ends[at[new]])
            raw, offs, names = ids.tobytes(), off.tolist(), v.names
            tokens = ids.tolist()
            first = len(self.ids)
            for k, x in enumerate(distinct[new].tolist()):
                a, b = offs[k], offs[k + 1]
                self.ids.append(raw[4 * a : 4 * b])
                self.text.append(" ".join([names[t] for t in tokens[a:b]]).encode())
                row[x] = first + k
            known[new] = first + np.arange(len(new))
        bounds = np.searchsorted(p.owner, np.arange(len(texts) + 1))
        return known[inverse], bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        rows, bounds = self.rows(texts)
        rows, get = rows.tolist(), self.ids.__getitem__
        return [b"".join(map(get, rows[a:b])) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8: the vocabulary has no decoder, so its tokens' names are joined by spaces."""
        v = self.vocabulary
        special = dict(zip(v.special, SPECIAL, strict=True))
        return " ".join([special.get(i) or v.names[i] for i in np.frombuffer(ids, "<u4").tolist()]).encode()

    def _cut(self, text: str) -> list[str]:
        """Pre-tokens as the library cuts them, whose letters are those of its own version of Unicode."""
        text = self.normalize(text)
        return [text[a:b] for _, (a, b) in self.pieces(text)]

    def encode_and_decode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """The ids of each text and the text they decode to. Names of tokens don't depend on their neighbours, so the
        decoded text is joined from the decoded words."""
        rows, bounds = self.rows(texts)
        rows, ids, text = rows.tolist(), self.ids.__getitem__, self.text.__getitem__
        return [(b"".join(map(ids, rows[a:b])), b" ".join(map(text, rows[a:b]))) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    return Encoder(path)


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Encodes and decodes every whole text. A row per input row: id, n_tokens, and ids (array of long) and decoded text,
    or with ``digests`` their SHA-256 (ids as little-endian unsigned 32-bit integers, text as UTF-8).

    Null and empty texts have no ids and decode to an empty text. Repeated rows and null ids stay as they are. Other
    columns are not read. vocabulary: the path of the vocabulary file on every executor.
    """
    kind = dict(df.dtypes)[id_col]
    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<long>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch, texts in slices(batches, "__text"):
            found = enc.encode_and_decode(texts.to_pylist())
            n = pa.array([len(i) // 4 for i, _ in found], pa.int64())
            if digests:
                cols = [pa.array([hashlib.sha256(x[k]).hexdigest() for x in found], pa.string()) for k in (0, 1)]
            else:
                cols = [pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i, _ in found], pa.list_(pa.int64())), pa.array([d.decode() for _, d in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, *cols], [id_col, "n_tokens", *[c.split()[0] for c in rest.split(", ")[1:]]])

    return df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text")).mapInArrow(run, f"`{id_col}` {kind}, {rest}")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``encode_texts`` of all documents as digests: doc_id, n_tokens, ids_sha256, decoded_sha256. Null and empty texts have no
    ids; repeated rows, null ids and empty tables as stated there."""
    import public_tokenizers

    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
