"""Token ids as flat binary files: unsigned integers beside unsigned 64-bit document offsets.

Layout of a folder, for each part p in ascending order of doc_id:

* ``p.ids``: the ids of its documents, little-endian and nothing else: unsigned 16-bit where the vocabulary and the
  end id fit, unsigned 32-bit otherwise;
* ``p.offsets``: documents + 1 little-endian unsigned 64-bit numbers, where each document starts among the ids of
  *all* parts (the part's base from the prefix sum is already in them) and where the part ends;
* ``p.docs``: the doc_ids as 64-bit integers, in the same order;
* ``parts``: a Parquet table with a row for each part: documents, rows without a doc_id (they come first), base,
  bytes of an id.

Files are first written under a name of the task's attempt and then renamed, so a repeated attempt replaces a part
by equal bytes and a lost executor leaves nothing half-written under a final name. Reading maps the files into memory
where the folder is a mounted one and streams them from any other store.

Defined results: a null text is encoded as empty (the end id alone); rows with a null doc_id come first; equal doc_ids
are ordered by text; an empty table gives no part. Texts are encoded in pieces cut at blanks and line feeds, which
the tokenizer drops and never joins across, so a very long text needs no long buffer of its own.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from promptwatch.llm.shared import folder, kept, materialize, posix, strings

#: Encoded words that a worker keeps.
CACHE_WORDS = 1 << 20
#: Documents that are encoded and written together.
BLOCK = 256


def _encoder(path: str) -> "Words":
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("tokenizer", path), lambda: Words(path))


class Words:
    """Encodes texts word by word with the given tokenizer; each new word is encoded once.

    Only used for tokenizers that drop white space before anything is matched (checked on start): then the ids of a
    text are those of its words one after another. Others encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.cache: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_word = steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and r"[^\s" in (steps[0].get("pattern") or {}).get("Regex", "")
        mark = self.tokenizer.encode("\0", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def _new(self, words: list[str]) -> None:
        """Encode unseen words, many to a call with a mark between them."""
        plain = [w for w in words if "\0" not in w] if self.mark is not None else []
        for lo in range(0, len(plain), 8192):
            groups = [plain[i : i + 256] for i in range(lo, min(lo + 8192, len(plain)), 256)]
            for group, e in zip(groups, self.tokenizer.encode_batch_fast([" \0 ".join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(e.ids, self.kind)
                cut = np.flatnonzero(ids == self.mark)
                if len(cut) != len(group) - 1:  # a word holds the mark's id itself
                    for w in group:
                        self.cache[w] = self._plain(w)
                    continue
                data, width = ids.tobytes(), ids.itemsize
                for w, a, b in zip(group, [-1, *cut.tolist()], [*cut.tolist(), len(ids)]):
                    self.cache[w] = data[width * (a + 1) : width * b]
        for w in words if self.mark is None else [w for w in words if "\0" in w]:
            self.cache[w] = self._plain(w)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned ids of each text, of the kind that the vocabulary needs."""
        if not self.by_word:
            return [self._plain(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {"": b""}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self._new(list({w for words in split for w in words}.difference(self.cache)))
        get = self.cache.__getitem__
        return [b"".join(map(get, words)) for words in split]


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> str:
    """Encode ``docs`` in ascending order of ``doc_id`` into a folder at ``path``; returns ``path``.

    The rows are range-partitioned and sorted, each partition becomes a part, and the parts' bases are prefix sums of
    their token counts: one row for each part passes the window.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    fs, root = posix(path)
    fs.create_dir(root, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = posix(path)
        words, part = _encoder(tokenizer), TaskContext.get().partitionId()
        final = f"{root}/{part:010d}"
        trial = f"{final}.{uuid.uuid4().hex}"
        if end_id >= 1 << 16 and words.kind == "<u2":
            raise ValueError("the end id does not fit the vocabulary's integers")
        end = np.array([end_id], words.kind).tobytes()
        width = len(end)
        lengths, ids, empty = [], [], 0
        with fs.open_output_stream(f"{trial}.ids") as out:
            for batch in batches:
                texts = strings(batch.column(1))
                for lo in range(0, len(texts), BLOCK):
                    for b in words.encode(texts[lo : lo + BLOCK]):
                        out.write(b)
                        out.write(end)
                        lengths.append(len(b) // width + 1)
                empty += batch.column(0).null_count
                ids.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if not lengths:
            fs.delete_file(f"{trial}.ids")
            return
        for name, value in (("lengths", np.array(lengths, "<u8")), ("docs", np.concatenate(ids))):
            with fs.open_output_stream(f"{trial}.{name}") as out:
                out.write(value.tobytes())
        for name in ("ids", "lengths", "docs"):
            fs.move(f"{trial}.{name}", f"{final}.{name}")
        yield pa.RecordBatch.from_pylist([{
            "part": part, "documents": len(lengths), "without_id": empty, "tokens": int(sum(lengths)), "width": width,
        }], pa.schema([("part", pa.int32()), ("documents", pa.int64()), ("without_id", pa.int64()), ("tokens", pa.int64()), ("width", pa.int32())]))

    placed = (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    )
    written = materialize(placed.mapInArrow(encode, "part int, documents bigint, without_id bigint, tokens bigint, width int"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    based = written.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    based.coalesce(1).write.parquet(f"{path}/parts")

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = posix(path)
        for batch in batches:
            for row in batch.to_pylist():
                final = f"{root}/{row['part']:010d}"
                with fs.open_input_file(f"{final}.lengths") as f:
                    lengths = np.frombuffer(f.read(), "<u8")
                trial = f"{final}.{uuid.uuid4().hex}.offsets"
                with fs.open_output_stream(trial) as out:
                    out.write((np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + np.uint64(row["base"])).tobytes())
                fs.move(trial, f"{final}.offsets")
                yield pa.RecordBatch.from_pylist([{"part": row["part"]}], pa.schema([("part", pa.int32())]))

    table = spark.read.parquet(f"{path}/parts")
    table.repartition(parts, "part").mapInArrow(offsets, "part int").agg(F.count("part")).collect()
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """A row for each document of the folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs

        fs, root = posix(path)
        local = isinstance(fs, pyarrow.fs.LocalFileSystem)
        for batch in batches:
            for part in batch.to_pylist():
                final = f"{root}/{part['part']:010d}"

                def opened(kind, final=final):
                    return pa.memory_map(f"{final}.{kind}") if local else fs.open_input_file(f"{final}.{kind}")

                with opened("ids") as ids, opened("offsets") as f, opened("docs") as g:
                    offset, docs = np.frombuffer(f.read(), "<u8").astype(np.int64), np.frombuffer(g.read(), "<i8")
                    width = part["width"]
                    for lo in range(0, len(docs), 4096):
                        hi = min(lo + 4096, len(docs))
                        out: dict[str, list] = {k: [] for k, _ in kinds}
                        for i in range(lo, hi):
                            ids.seek(width * int(offset[i] - offset[0]))
                            data = ids.read_buffer(width * int(offset[i + 1] - offset[i]))
                            own = np.frombuffer(data, f"<u{width}").astype("<u4")
                            out["doc_id"].append(int(docs[i]) if i >= part["without_id"] else None)
                            out["start"].append(int(offset[i]))
                            out["n_tokens"].append(int(offset[i + 1] - offset[i]))
                            out["ids_crc32"].append(zlib.crc32(own))
                            if with_ids:
                                out["ids"].append(own.astype(np.int64))
                        yield pa.RecordBatch.from_pydict(out, pa.schema(kinds))

    table = spark.read.parquet(f"{path}/parts")
    return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").mapInArrow(rows, schema)


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the documents' ids into a new folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    path = folder(docs.sparkSession, "tokens")
    return read_tokens(docs.sparkSession, write_tokens(docs, tokenizer, end_id, path))
