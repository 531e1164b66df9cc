"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces of a public model go into a double-array trie over their UTF-8 bytes. A text is marked (a marker in front
and in place of each blank) and split into the pieces with the largest sum of log scores. A character that is no piece
costs ``least score - 10`` and becomes the pieces of its bytes. Equal sums prefer the path whose last piece starts
earliest. Scores of a unigram model are used as they are; a model of merges has ranks in place of log scores, and a
piece of rank r then has probability in proportion to ``1 / (r + 1)``.

Where no piece of the vocabulary joins a character to a following marker, every run of markers starts a word of its
own, and line feeds stand alone if no longer piece has one (both are checked on start). Then the best path of a text is
that of its words one after another; words seen before come from a bounded cache and new ones are searched together:
one array operation for each start and length, not for each word. Words of more than ``LONG`` bytes, and whole texts
where the vocabulary doesn't allow the cuts, take the same search one text at a time.

Decoding joins the pieces' bytes, turns markers into blanks and drops the one in front. Defined results: a null text
has no pieces and decodes to null; an empty text has no pieces and decodes to the empty text; the marker character in
a text decodes to a blank, any other text decodes to itself.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptwatch.llm.shared import fresh, kept, text_chunks

MARK = "▁"
LONG = 64
CACHE_WORDS = 1 << 19
#: How much less a character outside the vocabulary scores than the least piece.
UNKNOWN_COST = 10.0


class DoubleArray:
    """A trie of byte strings in two arrays: the child of s by byte b is t = base[s] + b, if check[t] = s."""

    def __init__(self, keys: list[bytes], values: list[int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in zip(keys, values):
            node = 0
            for b in key:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = v
        size = len(children) * 2 + 1024
        base, check, out = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        place, low = {0: 0}, 1
        for node in range(len(children)):
            s = place[node]
            out[s] = value[node]
            if not (own := children[node]):
                continue
            codes = sorted(own)
            at = max(1, low - codes[0])
            while True:
                at = used.find(0, at + codes[0]) - codes[0]
                if at + 256 >= len(used) or at < 0:
                    grow = len(used)
                    used += bytearray(grow)
                    base, check, out = (np.concatenate([x, np.full(grow, f, np.int32)]) for x, f in ((base, 0), (check, -1), (out, -1)))
                    at = max(at, 1)
                    continue
                if all(not used[at + c] for c in codes):
                    break
                at += 1
            base[s] = at
            for c in codes:
                used[at + c] = 1
                check[at + c] = s
                place[own[c]] = at + c
            low = max(low, used.find(0, low))
        self.base, self.check, self.value = base, check, out

    def child(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether they exist)."""
        t = self.base[state] + byte
        return t, self.check[t] == state


_WIDTH = np.ones(256, np.int64)
_WIDTH[0xC0:0xE0], _WIDTH[0xE0:0xF0], _WIDTH[0xF0:] = 2, 3, 4


class Pieces:
    """The vocabulary of a SentencePiece model, ready to encode and decode."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        names, raw = [p.id_to_piece(i) for i in range(n)], np.array([p.get_score(i) for i in range(n)])
        self.byte = np.array([p.is_byte(i) for i in range(n)])
        other = np.array([p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in range(n)])
        normal = np.flatnonzero(~self.byte & ~other)
        self.of_byte = np.full(256, p.unk_id(), np.int64)
        for i in np.flatnonzero(self.byte):
            self.of_byte[int(names[i][3:5], 16)] = i
        ranks = bool(np.all(raw[normal] == np.floor(raw[normal]))) and raw[normal].min(initial=0) < -1000
        self.score = raw.copy()
        if ranks:
            share = 1 / (1 - raw[normal])
            self.score[normal] = np.log(share / share.sum())
        self.unknown = float(self.score[normal].min()) - UNKNOWN_COST
        self.trie = DoubleArray([names[i].encode() for i in normal], normal.tolist())
        longer = [names[i] for i in normal if len(names[i]) > 1]
        self.cuts = not any(MARK in x.lstrip(MARK) for x in longer)
        self.lines = not any("\n" in x for x in longer)
        self.bytes = [names[i].replace(MARK, " ").encode() for i in range(n)]
        for i in np.flatnonzero(other):
            self.bytes[i] = b""
        for b, i in enumerate(self.of_byte):
            if self.byte[i]:
                self.bytes[i] = bytes([b])
        self.cache: dict[str, bytes] = {}
        self.line = b"".join([self.viterbi(b"\n").astype("<i4").tobytes()])

    def viterbi(self, word: bytes) -> np.ndarray:
        """Best pieces of one marked word or text, by a plain forward pass."""
        n, base, check, value = len(word), self.trie.base, self.trie.check, self.trie.value
        best = [-np.inf] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        i = 0
        while i < n:
            state, here, width = 0, best[i], int(_WIDTH[word[i]])
            single = False
            for j in range(i, n):
                t = int(base[state]) + word[j]
                if check[t] != state:
                    break
                state = t
                if (v := int(value[t])) >= 0:
                    single |= j + 1 - i == width
                    if here + self.score[v] > best[j + 1]:
                        best[j + 1], back[j + 1] = here + self.score[v], (i, v)
            if not single and here + self.unknown > best[i + width]:
                best[i + width], back[i + width] = here + self.unknown, (i, -1)
            i += width
        path, at = [], n
        while at:
            a, v = back[at]
            path += [v] if v >= 0 else self.of_byte[np.frombuffer(word[a:at], np.uint8)][::-1].tolist()
            at = a
        return np.array(path[::-1], np.int64)

    def viterbi_all(self, words: list[bytes]) -> list[bytes]:
        """Best pieces of many short marked words, little-endian 32-bit ids each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        off = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        data = np.frombuffer(b"\0".join(words) + b"\0", np.uint8).astype(np.int32)
        best = np.full(len(data), -np.inf)
        best[off] = 0.0
        start, piece = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        for i in range(int(size.max(initial=0))):
            live = np.flatnonzero(size > i)
            live = live[(data[off[live] + i] & 0xC0) != 0x80]
            at = off[live] + i
            here, width, end = best[at], _WIDTH[data[at]], size[live]
            single = np.zeros(len(live), bool)
            go, state, j = np.arange(len(live)), np.zeros(len(live), np.int32), i
            while len(go):
                t, ok = self.trie.child(state, data[at[go] + (j - i)])
                go, state = go[ok], t[ok]
                v = self.trie.value[state]
                known = np.flatnonzero(v >= 0)
                g, v = go[known], v[known]
                single[g] |= j + 1 - i == width[g]
                self._better(best, start, piece, at[g], at[g] + (j + 1 - i), here[g] + self.score[v], v)
                j += 1
                inside = end[go] > j
                go, state = go[inside], state[inside]
            g = np.flatnonzero(~single)
            self._better(best, start, piece, at[g], at[g] + width[g], here[g] + self.unknown, np.full(len(g), -1))
        out, piece, start = [], piece.tolist(), start.tolist()
        for word, a, n in zip(words, off.tolist(), size.tolist()):
            path, e = [], a + n
            while e > a:
                s, v = start[e], piece[e]
                if v >= 0:
                    path.append(v)
                else:
                    path += self.of_byte[np.frombuffer(word[s - a : e - a], np.uint8)][::-1].tolist()
                e = s
            out.append(np.array(path[::-1], "<i4").tobytes())
        return out

    @staticmethod
    def _better(best, start, piece, a, b, value, v) -> None:
        won = value > best[b]
        b = b[won]
        best[b], start[b], piece[b] = value[won], a[won], v[won]

    _WORD = re.compile(" +[^ ]*")

    def _split(self, text: str) -> list[str]:
        """Words of a text: a leading blank is the marker in front; a line feed is a word; others follow a line feed."""
        if not self.cuts:
            return [" " + text]
        words: list[str] = []
        for k, line in enumerate(text.split("\n") if self.lines else [text]):
            if k:
                words.append("\n")
                if line[:1] != " ":
                    first, _, line = line.partition(" ") if " " in line else (line, "", None)
                    if first:
                        words.append(first)
                    if line is None:
                        continue
                else:
                    line = line[1:]
            words += self._WORD.findall(" " + line) if "  " in line or line[:1] == " " or line[-1:] == " " or not line else [" " + w for w in line.split(" ")]
        return words

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        self.cache["\n"] = self.line
        split = [self._split(t) if t else [] for t in texts]
        new = list({w for words in split for w in words}.difference(self.cache))
        marked = [w.replace(" ", MARK).encode("utf-8", "replace") for w in new]
        short = sorted((i for i, m in enumerate(marked) if len(m) <= LONG), key=lambda i: len(marked[i]))
        for lo in range(0, len(short), 1 << 15):
            group = short[lo : lo + (1 << 15)]
            for i, ids in zip(group, self.viterbi_all([marked[i] for i in group])):
                self.cache[new[i]] = ids
        extra = {new[i]: self.viterbi(m).astype("<i4").tobytes() for i, m in enumerate(marked) if len(m) > LONG}
        get = (self.cache | extra if extra else self.cache).__getitem__
        return [b"".join(map(get, words)) for words in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; bytes that are no UTF-8 become replacement characters."""
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def pieces(model_file: str) -> Pieces:
    """The vocabulary and its cache of words, which a worker keeps."""
    return kept(("pieces", model_file), lambda: Pieces(model_file))


RESULT = "struct<ids:array<int>,decoded:string>"
#: Bytes of text that are encoded together.
BLOCK_BYTES = 1 << 20


def encode_texts(docs: DataFrame, model_file: str, text: str = "text", into: str = "pieces") -> DataFrame:
    """Append ``into``: piece ids of each text, and the text they decode to."""
    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = pieces(model_file)
        for column in batches:
            ids, decoded = [], []
            for _, _, texts in text_chunks(column, BLOCK_BYTES):
                for data in model.encode(texts):
                    ids.append(np.frombuffer(data, "<i4"))
                    decoded.append(model.decode(ids[-1]))
            if column.null_count:
                decoded = [None if empty else t for empty, t in zip(column.is_null().to_pylist(), decoded)]
            size = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(size), pa.array(flat)), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return docs.withColumn(into, run(F.col(text)))


def digests(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, n_pieces, n_bytes (byte pieces), ids_crc32, decoded_sha256 and whether the text came back whole."""
    schema = pa.struct([
        ("n_pieces", pa.int64()), ("n_bytes", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_()),
    ])

    @F.arrow_udf("struct<n_pieces:bigint,n_bytes:bigint,ids_crc32:bigint,decoded_sha256:string,round_trip:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        model = pieces(model_file)
        for column in batches:
            rows = []
            for _, _, texts in text_chunks(column, BLOCK_BYTES):
                for t, data in zip(texts, model.encode(texts)):
                    ids = np.frombuffer(data, "<i4")
                    back = model.decode(ids)
                    rows.append({
                        "n_pieces": len(ids), "n_bytes": int(model.byte[ids].sum()), "ids_crc32": zlib.crc32(data),
                        "decoded_sha256": hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(),
                        "round_trip": back == t.replace(MARK, " "),
                    })
            yield pa.array(rows, schema)

    return docs.select("doc_id", run(F.col("text")).alias("d")).select("doc_id", "d.*")


def encoded(docs: DataFrame, model_file: str) -> DataFrame:
    """The documents with their piece ids; ``text`` is what the ids decode to."""
    own = fresh(docs, "__pieces")
    found = encode_texts(docs, model_file, into=own)
    return found.withColumn("piece_ids", F.col(own)["ids"]).withColumn("text", F.col(own)["decoded"]).drop(own)
