"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans follow fixed patterns and always stay. Looser patterns propose further candidates of the same kinds. Six
labelers (strict pattern, shape, checksum, gazetteer, context words, neighbours) vote +1, -1 or abstain on every
candidate. Votes of all documents are counted by pattern (at most ``4 * 3**6 * 16`` distinct ones, whatever the input),
EM on those counts estimates each labeler's reliability by kind, and a logistic regression on the span's features is
fitted to the resulting probabilities, weighted by count. A candidate that is no base span is added where the
classifier gives ``threshold`` or more and nothing of its kind that is already taken overlaps it.

Offsets are code points, ends exclusive. Defined results: a null text is empty and has no spans; a corpus without
candidates of a kind adds none; repeated rows get equal results; texts are searched whole, and every pattern is either
anchored or bounded, so time grows with the length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptwatch.llm.shared import text_chunks

KINDS = ("email", "ip", "card", "phone")
VOTERS = 6
#: Bytes of text that are Python strings at once.
CHUNK_BYTES = 1 << 20
#: Characters of context on the left that the context labeler reads.
WINDOW = 48

# The base patterns, as the contract of the query states them.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Looser candidates.
_AT = re.compile(r"[\[(]at[\])]", re.I)
_LOOSE_EMAIL = re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64} ?[\[(]at[\])] ?[\w-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[\w-]{1,63}){1,5}", re.I)
_LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.(-])\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9.-])")

# Words and prefixes of the gazetteer and context labelers.
_TLDS = frozenset("com org net edu gov io de fr es uk eu info co us ch at it nl be pl ru cn jp br in au ca biz dev".split())
_ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "62", "2221", "2720")
_FOR = {
    "email": re.compile(r"e-?mail|contact|write|reach|correo|schreib|courriel", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|adresse|client", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta|payment", re.I),
    "phone": re.compile(r"phone|\btel|call|mobile|\bfax|handy|anruf|appel|llam", re.I),
}
_AGAINST = re.compile(r"version|isbn|order|token|hash|sha|sku|serial|build|key|password|part no", re.I)


def luhn(digits: str) -> bool:
    """The check-sum of card numbers."""
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one '@', so the text is walked from '@' to '@'; the local part never reaches behind the last match."""
    taken, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            taken = m.end()
        else:
            taken = max(taken, at + 1)
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by kind, then start; matches that fail their test are dropped and not retried."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def _octet(part: str) -> bool:
    return len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255


def _loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if _AT.search(text):
        out += [("email", *m.span()) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        if ":" in text:
            out += [("ip", *m.span()) for m in _LOOSE_IP.finditer(text)]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(digits_of(m[0])) <= 19]
        out += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text)]
    return out


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is a base span), each span once."""
    base = base_spans(text)
    have = set(base)
    return [(*s, True) for s in base] + [(*s, False) for s in _loose_spans(text) if s not in have]


def votes(text: str, kind: str, a: int, b: int, base: bool) -> tuple[int, ...]:
    """The six labelers' votes on a span: strict, shape, check, gazetteer, context, neighbours."""
    span = text[a:b]
    digits = digits_of(span)
    strict = 1 if base else 0
    shape = -1 if digits and len(set(digits)) <= 2 and kind != "ip" else (1 if b - a <= 64 else -1)
    if kind == "card":
        check = 1 if luhn(digits) else -1
        known = 1 if digits.startswith(_ISSUERS) else -1
    elif kind == "phone":
        check = 1 if 9 <= len(digits) <= 15 else -1
        known = 1 if span[:1] in "+(" else (-1 if digits[:1] in "01" else 0)
    elif kind == "ip":
        check = 1 if ":" in span or all(_octet(p) for p in span.split(".")) else -1
        known = -1 if span.startswith(("0.", "127.", "255.")) else 0
    else:
        top = re.split(r"[.\s\])]+", span.rstrip("])"))[-1].lower()
        check = 1 if top.isalpha() and 2 <= len(top) <= 24 else -1
        known = 1 if top in _TLDS else 0
    left = text[max(0, a - WINDOW) : a]
    context = 1 if _FOR[kind].search(left) else (-1 if _AGAINST.search(left) else 0)
    joined = (a > 0 and (text[a - 1].isalnum() or text[a - 1] == "_")) or (b < len(text) and (text[b].isalnum() or text[b] == "_"))
    return strict, shape, check, known, context, -1 if joined else 0


def _code(text: str, kind: str, a: int, b: int, base: bool) -> int:
    """Votes and further features of a span as one small number."""
    code = 0
    for v in votes(text, kind, a, b, base):
        code = code * 3 + v + 1
    length = (b - a > 12) + (b - a > 20) + (b - a > 32)
    alone = a == 0 or text[a - 1].isspace()
    ended = b == len(text) or text[b].isspace() or text[b] in ".,;:)]"
    return (code * 4 + length) * 4 + 2 * alone + ended


def _unpack(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(votes by labeler, features for the regression) of packed codes."""
    rest, code = codes % 16, codes // 16
    v = np.stack([code // 3 ** (VOTERS - 1 - i) % 3 - 1 for i in range(VOTERS)], axis=1)
    length = rest // 4
    x = np.concatenate([
        np.ones((len(codes), 1)), v == 1, v == -1, length[:, None] == np.arange(1, 4),
        (rest % 4 // 2)[:, None], (rest % 2)[:, None],
    ], axis=1).astype(float)
    return v, x


def reliabilities(v: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over counted vote patterns: P(personal | votes) by pattern, prior, and P(vote | class) by labeler.

    Starts from the majority of votes, which also fixes which class is which. One imagined vote of each outcome keeps
    probabilities off 0.
    """
    total = v.sum(axis=1)
    p = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.5))
    table = np.zeros((2, VOTERS, 3))
    for _ in range(rounds):
        prior = float((n @ p + 1) / (n.sum() + 2))
        for c, w in ((0, n * (1 - p)), (1, n * p)):
            for o in range(3):
                table[c, :, o] = (w @ (v == o - 1) + 1) / (w.sum() + 3)
        log = [np.log(q) + sum(np.log(table[c, j, v[:, j] + 1]) for j in range(VOTERS)) for c, q in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return p, prior, table


def regression(x: np.ndarray, p: np.ndarray, n: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression on soft labels with counts, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (p - q)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(docs: DataFrame, text: str = "text") -> dict[str, list[float]]:
    """Weights of the span classifier by kind, from the votes on all candidates of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, _, texts in text_chunks(batch.column(0), CHUNK_BYTES):
                for t in texts:
                    seen.update((KINDS.index(k), _code(t, k, a, b, base)) for k, a, b, base in candidates(t))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in seen], pa.int32()), pa.array([c for _, c in seen], pa.int32()), pa.array(seen.values(), pa.int64())],
                ["kind", "code", "n"],
            )

    found = (
        docs.select(F.col(text).alias("text")).where("text is not null")
        .mapInArrow(count, "kind int, code int, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    ).collect()  # patterns, not spans: 4 * 3**6 * 16 at most
    weights = {}
    for k, kind in enumerate(KINDS):
        own = sorted((r["code"], r["n"]) for r in found if r["kind"] == k)
        if own:
            codes, n = np.array([c for c, _ in own]), np.array([m for _, m in own], float)
            v, x = _unpack(codes)
            weights[kind] = regression(x, reliabilities(v, n)[0], n).tolist()
    return weights


def find(text: str, weights: dict[str, list[float]], threshold: float = 0.5) -> tuple[list, list]:
    """(base spans, all spans) of a text, both by kind, then start."""
    base = base_spans(text)
    every = list(base)
    have = set(base)
    for kind, a, b in _loose_spans(text):
        if (kind, a, b) in have or kind not in weights or any(k == kind and a < e and s < b for k, s, e in every):
            continue
        x = _unpack(np.array([_code(text, kind, a, b, False)]))[1][0]
        if 1 / (1 + np.exp(-float(x @ weights[kind]))) >= threshold:
            every.append((kind, a, b))
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


RESULT = "struct<base:array<struct<kind:string,start:int,end:int>>,spans:array<struct<kind:string,start:int,end:int>>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def annotate(docs: DataFrame, weights: dict[str, list[float]], text: str = "text", into: str = "pii", threshold: float = 0.5) -> DataFrame:
    """Append ``into``: base spans and all spans of each row's text."""

    @F.arrow_udf(RESULT)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            both = [find(t, weights, threshold) for _, _, texts in text_chunks(column, CHUNK_BYTES) for t in texts]
            yield pa.StructArray.from_arrays([
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in pair[i]] for pair in both], _SPANS) for i in (0, 1)
            ], ["base", "spans"])

    return docs.withColumn(into, spans(F.col(text)))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    if not text or not spans:
        return text
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and spans, over all rows."""
    docs = docs.select("doc_id", "text")
    found = annotate(docs, fit(docs))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii.base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(_joined(F.col("pii.base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("pii.spans")).alias("spans")
    )


def without_personal_data(docs: DataFrame) -> DataFrame:
    """Every row, with personal data in its text replaced by the kind's name."""
    weights = fit(docs)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([t and redact(t, find(t, weights)[1]) for t in column.to_pylist()], pa.string())

    return docs.withColumn("text", clean(F.col("text")))
