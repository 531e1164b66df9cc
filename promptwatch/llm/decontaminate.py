"""Benchmark decontamination with an FM-index of each training shard.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased. A benchmark item's windows are
its runs of ``window`` consecutive words; a shorter item is one window itself. A document word inside an occurrence of
any window is hit; neighbouring hit words form a removal span.

A shard is a run of documents with a bounded number of bytes (or one longer document). Its text becomes a sequence of
word numbers; a word that no item has ends every occurrence, so runs of item words shorter than the shortest window
are left out and a separator stands between the others. Over that sequence the shard gets a suffix array, its
Burrows-Wheeler transform as a wavelet matrix with rank counts, and sampled suffix positions. All windows are searched
backward at once; occurrences are located by walking to the next sampled position, and spans are merged by a running
sum. Every step is a few array operations for all windows or rows.

The benchmark goes to the tasks in blocks of ``BLOCK_BYTES`` text at most, one after another, so a benchmark of any size
has bounded broadcasts; spans and items of the blocks are united by row.

Defined results: a null or wordless text has no words and no hits; null or wordless items have no windows; an item
without an id marks words but is not listed; repeated item ids count once; an empty benchmark leaves everything clean.
Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptwatch.llm.shared import fresh, lower_ascii, text_chunks, word_hashes

WINDOW = 10
SHARD_BYTES = 1 << 20
BLOCK_BYTES = 16 << 20
#: Every so many positions of a shard's sequence a suffix position is kept.
SAMPLE = 8

_LOWER = lower_ascii()
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def tokenise(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of the words of lower-cased UTF-8 bytes."""
    return word_hashes(data, _WORD)


class Phrases:
    """Windows of a block of benchmark items as word numbers, and which items have them."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        hashed = [(name, tokenise(_LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)])[2]) for name, text in items]
        hashed = [(name, h) for name, h in hashed if len(h)]
        self.words = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.zeros(0, np.uint64)
        found: dict[tuple, set] = {}
        for name, h in hashed:
            ids = (np.searchsorted(self.words, h) + 1).tolist()
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                found.setdefault(tuple(ids[i : i + size]), set()).add(name)
        order = sorted(found, key=lambda w: (len(w), w))
        self.names = sorted({n for names in found.values() for n in names if n is not None})
        place = {n: i for i, n in enumerate(self.names)}
        listed = [[place[n] for n in found[w] if n is not None] for w in order]
        self.by_length = {}
        for size in sorted({len(w) for w in order}):
            at = [i for i, w in enumerate(order) if len(w) == size]
            self.by_length[size] = (np.array([order[i] for i in at], np.int64), np.array(at))
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in listed])]).astype(np.int64)
        self.items = np.array([i for x in listed for i in x], np.int64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.words >> np.uint64(48)).astype(np.int64)] = True

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """1-based number of each word among the items' words, else 0."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(some) and len(self.words):
            own = hashes[some]
            at = np.minimum(np.searchsorted(self.words, own), len(self.words) - 1)
            out[some] = np.where(self.words[at] == own, at + 1, 0)
        return out


class FMIndex:
    """Backward search over a sequence of numbers; 0 is a separator that no phrase may contain."""

    def __init__(self, seq: np.ndarray):
        n, top = len(seq), int(seq.max(initial=0)) + 1
        rank = seq.astype(np.int64) + n
        at0 = np.flatnonzero(seq == 0)
        rank[at0] = np.arange(len(at0))  # each separator differs from the others, so no suffix is compared beyond one
        step = 1
        order = np.argsort(rank, kind="stable")
        while True:
            ordered = rank[order]
            rank = np.empty(n, np.int64)
            fresh = np.concatenate([[0], (ordered[1:] != ordered[:-1])]).cumsum()
            rank[order] = fresh
            if fresh[-1] == n - 1:
                break
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            rank = rank * (n + 1) + after
            order = np.argsort(rank, kind="stable")
            step *= 2
        self.n, self.suffix = n, order
        self.bwt = seq[order - 1]  # the first suffix's predecessor is the last entry, a separator
        self.before = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=top))])
        self.levels = max(1, (top - 1).bit_length())
        self.ones, self.zeros, current = [], [], self.bwt
        for bit in range(self.levels - 1, -1, -1):
            one = (current >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(one)]))
            self.zeros.append(int(n - self.ones[-1][-1]))
            current = np.concatenate([current[one == 0], current[one == 1]])
        starts = np.concatenate([[True], seq[:-1] == 0])
        kept = (np.arange(n) % SAMPLE == 0) | starts
        self.sampled = kept[order]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i of the transform."""
        lo, hi = np.zeros_like(i), i.copy()
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.levels - 1 - level)) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + lo1, lo - lo1), np.where(one, zeros + hi1, hi - hi1)
        return hi - lo

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the phrase, first and end index among the suffixes) of every phrase that occurs."""
        live = np.arange(len(phrases))
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[live, j]
            known = s < len(self.before) - 1
            live, s, lo, hi = live[known], s[known], lo[known], hi[known]
            lo, hi = self.before[s] + self.rank(s, lo), self.before[s] + self.rank(s, hi)
            alive = lo < hi
            live, lo, hi = live[alive], lo[alive], hi[alive]
            if not len(live):
                break
        return live, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence of suffix rows, by walking back to the nearest sampled one."""
        steps, rows = np.zeros(len(rows), np.int64), rows.copy()
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            r = rows[walking]
            s = self.bwt[r]
            rows[walking] = self.before[s] + self.rank(s, r)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.suffix[rows] + steps


def scan(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str], int]]:
    """For each text of a shard: words, hit spans in bytes (end exclusive), items, hit words."""
    n = len(texts)
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    data = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    start, end, hashes = tokenise(data)
    words = np.searchsorted(start, offset)
    result = [(int(c), [], [], 0) for c in np.diff(words)]
    number = phrases.number(hashes)
    least = min(phrases.by_length, default=0)
    known = np.flatnonzero(number)
    if not least or not len(known):
        return result
    doc = np.searchsorted(offset, start[known], side="right") - 1
    breaks = np.flatnonzero((np.diff(known) != 1) | (np.diff(doc) != 0)) + 1
    runs = np.diff(np.concatenate([[0], breaks, [len(known)]]))
    long = np.repeat(runs >= least, runs)
    known, doc = known[long], doc[long]
    if not len(known):
        return result
    breaks = np.flatnonzero((np.diff(known) != 1) | (np.diff(doc) != 0)) + 1
    seq = np.insert(number[known], np.append(breaks, len(known)), 0)
    word_at = np.insert(known, np.append(breaks, len(known)), -1)
    doc_at = np.insert(doc, np.append(breaks, len(known)), -1)
    index = FMIndex(seq)
    mark = np.zeros(len(start) + 1, np.int64)
    pairs = []
    for size, (windows, names) in phrases.by_length.items():
        live, lo, hi = index.search(windows)
        count = hi - lo
        if not len(live):
            continue
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at = index.locate(rows)
        np.add.at(mark, word_at[at], 1)
        np.add.at(mark, word_at[at] + size, -1)
        pairs.append(np.unique(doc_at[at] * len(phrases.first) + np.repeat(names[live], count)))
    if not pairs:
        return result
    hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    owner = np.searchsorted(offset, start[hit], side="right") - 1
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(hit)]]) - 1
    spans: dict[int, list] = {}
    for d, a, b in zip(owner[first].tolist(), start[hit[first]].tolist(), end[hit[last]].tolist()):
        spans.setdefault(d, []).append((a - int(offset[d]), b - int(offset[d])))
    pair = np.unique(np.concatenate(pairs))
    d, w = pair // len(phrases.first), pair % len(phrases.first)
    many = phrases.first[w + 1] - phrases.first[w]
    which = np.repeat(phrases.first[w] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    items: dict[int, set] = {}
    for k, i in zip(np.repeat(d, many).tolist(), phrases.items[which].tolist()):
        items.setdefault(k, set()).add(phrases.names[i])
    hits = np.bincount(owner, minlength=n)
    return [(c, spans.get(i, []), sorted(items.get(i, ())), int(hits[i])) for i, (c, *_) in enumerate(result)]


def blocks(benchmark: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[str | None, str]]]:
    """The items in blocks of ``BLOCK_BYTES`` each; an item belongs to one block."""
    items = benchmark.select(F.col(item_id).cast("string").alias("name"), F.col(text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = 1 + 2 * size // BLOCK_BYTES
    for i in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == i)
        yield [(r["name"], r["text"]) for r in own.collect()]


RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>,cleaned:string>"
_TYPE = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("cleaned", pa.string()),
])


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, into: str = "contamination", clean: bool = False) -> DataFrame:
    """Append ``into``: words, hit words, items, merged spans (bytes of the UTF-8 text) and, if asked, the text without them."""
    spark = docs.sparkSession
    parts = [spark.sparkContext.broadcast(Phrases(b, window)) for b in blocks(benchmark, item_id, item_text)]

    @F.arrow_udf(RESULT)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = []
            for _, _, texts in text_chunks(column, SHARD_BYTES):
                shard = [t.encode("utf-8", "surrogatepass") for t in texts]
                found = [scan(shard, part.value) for part in parts]
                for i, t in enumerate(shard):
                    rows.append(_united(t, [f[i] for f in found], clean))
            if clean:
                for row, alone in zip(rows, column.is_null().to_pylist()):
                    row["cleaned"] = None if alone else row["cleaned"]
            yield pa.array(rows, _TYPE)

    return docs.withColumn(into, find(F.col(text)))


def _united(text: bytes, found: list, clean: bool) -> dict:
    words, spans, items, hits = found[0]
    if len(found) > 1 and any(f[1] for f in found):
        items = sorted({i for f in found for i in f[2]})
        start, end, _ = tokenise(_LOWER[np.frombuffer(text, np.uint8)])
        mark = np.zeros(len(start) + 1, np.int64)
        for f in found:
            for a, b in f[1]:
                mark[np.searchsorted(start, a)] += 1
                mark[np.searchsorted(end, b) + 1] -= 1
        hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        cut = np.flatnonzero(np.diff(hit) != 1) + 1
        spans = list(zip(start[hit[np.concatenate([[0], cut])]].tolist(), end[hit[np.concatenate([cut, [len(hit)]]) - 1]].tolist()))
        hits = len(hit)
    row = {"n_words": words, "n_hit": hits, "items": items, "spans": [{"start": a, "end": b} for a, b in spans], "cleaned": None}
    if clean:
        out, done = [], 0
        for a, b in spans:
            out.append(text[done:a])
            done = b
        row["cleaned"] = (b"".join(out) + text[done:]).decode("utf-8", "surrogatepass")
    return row


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the spans, over all rows."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(c["items"], ",").cast("binary"), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row, with all hit spans cut out of its text."""
    own = fresh(docs, "__found")
    return contamination(docs, benchmark, into=own, clean=True).withColumn("text", F.col(own)["cleaned"]).drop(own)
