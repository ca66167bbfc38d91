"""A quality classifier by co-training on two views of a document.

The text view sees the characters: hashed byte trigrams, as shares. The metadata view sees
what is known without reading: language, source and the measures of the page (size, lines,
words, and the shares of blanks, digits, capitals and signs). Each view has a logistic
classifier. In each round both score all documents that have no label; what one view is sure
of becomes a training row of the other, unless that one is sure already or holds the opposite. At the end both are calibrated on labelled rows that
none of them was fitted on, and one logistic function of the two gives every document's score.

Scoring and the search for sure documents cover all rows in every round. Only fitting is
bounded: ``SAMPLE`` labelled rows, and of what a view is sure of in a round ``EXCHANGED`` rows
(half of each class), without those that have a label, all in the order of a hash of the id.

Toxic documents are told by single words, which trigram shares hide: words that far more of the
toxic labelled documents have than of the others, by their log odds; the sum over a document's
different words is calibrated on held-out labels. Without ``toxic`` labels nothing is toxic.

Edge cases: a null text counts as empty; a document without a row in ``labels`` (or with a
null one) is unlabelled; of several labels the mean decides, and a tie is good; with labels
of one class only, or none, nothing is rejected and every score is 1; a null language or
source is a value of its own, and so is a missing column; a document with a
null id is scored and unlabelled; texts of any length are taken whole; no documents give no
rows; other columns are ignored by ``scores`` and kept by ``accepted``.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.shared import settled
from auditloom.llm.words import LETTERED, SPACED, Words, slices

HASHED, LANGS, SOURCES = 512, 16, 32
SAMPLE, EXCHANGED, ROUNDS = 6_000, 1_000, 2
SURE, AGAINST = 0.98, 0.1
THRESHOLD = 0.5
TOXIC_DOCS, TOXIC_ODDS = 5, 2.5

_LINE, _DIGIT, _CAPITAL, _SIGN, _LETTER = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[10] = _LINE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _CAPITAL
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = _SIGN
_KIND[97:123] = _KIND[128:] = _LETTER


def text_view(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; the shares of words that repeat the
    word before, that the text has more than once, and that are one byte long."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    keys = (data[:-2] * np.uint32(0x01000193) ^ data[1:-1]) * np.uint32(0x01000193) ^ data[2:]
    keys = (keys * np.uint32(0x9E3779B1)) >> np.uint32(23)
    inside = owner[:-2] == owner[2:]
    counts = np.bincount(owner[:-2][inside] * HASHED + keys[inside], minlength=len(texts) * HASHED).reshape(-1, HASHED)
    shares = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    words = Words(texts, SPACED, fold=True)
    of, h = words.text_of_words(), words.hashes
    again = np.bincount(of[1:][(h[1:] == h[:-1]) & (of[1:] == of[:-1])], minlength=len(texts))
    order = np.lexsort((h, of))
    more = np.bincount(of[order][1:][(h[order][1:] == h[order][:-1]) & (of[order][1:] == of[order][:-1])], minlength=len(texts))
    short = np.bincount(of[words.ends - words.starts == 1], minlength=len(texts))
    total = np.maximum(words.counts, 1)
    return np.hstack([np.sqrt(shares), *(3 * np.sqrt(c / total)[:, None] for c in (again, more, short))]).astype(np.float32)


def metadata_view(texts: list[bytes], langs: list, sources: list) -> np.ndarray:
    """Language, source and measures of the page."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    kinds = _KIND[data]
    count = {k: np.bincount(owner[kinds == k], minlength=len(texts)) for k in (_LINE, _DIGIT, _CAPITAL, _SIGN, _LETTER)}
    words = np.bincount(owner[np.diff(SPACED[data], prepend=np.int8(0)) == 1], minlength=len(texts))
    n = np.maximum(sizes, 1)
    measures = np.stack(
        [
            np.log1p(sizes) / 12,
            np.log1p(words) / 10,
            np.log1p(words / count[_LINE]) / 8,  # the line's end that joins texts counts for each
            (sizes - words) / n / 10,
            count[_DIGIT] / n,
            count[_CAPITAL] / n,
            count[_SIGN] / n,
            count[_LETTER] / n,
            count[_SIGN] / np.maximum(words, 1) / 4,
            count[_CAPITAL] / np.maximum(words, 1) / 4,
        ],
        1,
    )
    named = np.zeros((len(texts), LANGS + SOURCES))
    for i, (lang, source) in enumerate(zip(langs, sources, strict=True)):
        named[i, zlib.crc32(repr(lang).encode()) % LANGS] = 0.2
        named[i, LANGS + zlib.crc32(repr(source).encode()) % SOURCES] = 0.2
    return np.hstack([measures, np.square(measures), np.sqrt(np.abs(measures)), named]).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 25) -> np.ndarray:
    """Weights of a logistic classifier (the last one constant), by Newton steps."""
    x = np.hstack([x.astype(np.float64), np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(x) + penalty * w / len(x) * 10
        curve = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve((x.T * curve) @ x / len(x) + np.diag(penalty * 10 / len(x) + 1e-9), gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class Model:
    """Weights of the two views and of what joins them; empty: everything is good."""

    text: np.ndarray | None = None
    metadata: np.ndarray | None = None
    joined: np.ndarray | None = None
    exchanged: list[tuple[int, int]] = field(default_factory=list)

    def score(self, text: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        if self.joined is None:
            return np.ones(len(text))
        both = np.stack([logits(text, self.text), logits(metadata, self.metadata)], 1)
        return chance(logits(both, self.joined))


_WIDTHS = (HASHED + 3, 3 * 10 + LANGS + SOURCES)


def _pack(x: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in x.astype(np.float16)]


def _unpack(rows: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float16).reshape(len(rows), width).astype(np.float32)


def _cut(batches):
    """Batches of 1,000 rows at most: their numbers take more room than their packed form."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1_000):
            yield batch.slice(at, 1_000)


def _given(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def column(name):
        return (F.col(f"`{name}`").cast("string") if name in docs.columns else F.lit(None).cast("string"))

    return docs.select(F.col(f"`{id_col}`").alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"), column(source_col).alias("source"))


def _views(batch: pa.RecordBatch, text: int, lang: int | None, source: int | None):
    """The rows of a batch in turn: first row, texts, text view, metadata view."""
    for at, texts in slices(batch.column(text)):
        named = [batch.column(c).slice(at, len(texts)).to_pylist() if c is not None else [None] * len(texts) for c in (lang, source)]
        yield at, texts, text_view(texts), metadata_view(texts, *named)


def _different(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each different word of each text: the number of the text, and the hash."""
    words = Words(texts, LETTERED, fold=True)
    of, h = words.text_of_words(), words.hashes
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[new], h[new]


def _held(ids) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode()) % 4 == 0 for i in ids], bool)


@dataclass
class Toxicity:
    """Words of toxic documents (hashes in order), their log odds, and what calibrates the sum; empty: nothing is toxic."""

    words: np.ndarray | None = None
    odds: np.ndarray | None = None
    line: np.ndarray | None = None

    def sums(self, texts: list[bytes]) -> np.ndarray:
        of, h = _different(texts)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        hit = self.words[at] == h
        return np.bincount(of[hit], weights=self.odds[at[hit]], minlength=len(texts))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.zeros(len(texts)) if self.line is None else chance(logits(self.sums(texts)[:, None], self.line))


def learn_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> Toxicity:
    """From the texts of ``sample`` labelled documents at most; words are counted in tasks."""
    if label_col not in labels.columns or text_col not in docs.columns:
        return Toxicity()
    known = _known(labels, label_id, label_col)
    some = _sampled(known, known.count(), sample)
    y, held = np.array([r["y"] for r in some]), _held(r["id"] for r in some)
    if len(set(y[~held])) < 2:
        return Toxicity()
    chosen = docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in some], known.schema)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")

    def rows(batches):
        for batch in batches:
            for at, own in slices(batch.column(1)):
                part = batch.slice(at, len(own))
                yield own, np.asarray(part.column(2)), _held(part.column(0).to_pylist())

    def counted(batches):
        for own, toxic, out in rows(batches):
            of, h = _different(own)
            of, h = of[~out[of]], h[~out[of]]
            words, which = np.unique(h, return_inverse=True)
            n, m = np.bincount(which, minlength=len(words)), np.bincount(which, weights=toxic[of], minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(m), pa.array(n - m)], ["word", "toxic", "other"])

    total = texts.mapInArrow(counted, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    n_toxic, n_other = int(y[~held].sum()), int((1 - y[~held]).sum())
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    found = total.withColumn("odds", odds).filter((F.col("toxic") >= TOXIC_DOCS) & (F.col("odds") >= TOXIC_ODDS)).select("word", "odds").collect()
    if not found:
        return Toxicity()
    words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Toxicity(words[order], np.array([r["odds"] for r in found])[order])

    def summed(batches):
        for own, toxic, out in rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(model.sums(own)), pa.array(toxic.astype(np.int32)), pa.array(out)], ["x", "y", "held"])

    seen = texts.mapInArrow(summed, "x double, y int, held boolean").collect()
    x, y, held = (np.array([r[c] for r in seen]) for c in ("x", "y", "held"))
    check = held if len(set(y[held])) == 2 else np.ones(len(y), bool)
    model.line = fit(x[check][:, None], y[check].astype(np.float64), ridge=1e-3)
    return model


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", toxicity: Toxicity | None = None) -> DataFrame:
    """Both views of every document as packed numbers of 16 bits, and the chance of being toxic."""
    toxic = docs.sparkSession.sparkContext.broadcast(toxicity or Toxicity())

    def run(batches):
        for batch in batches:
            for at, texts, text, metadata in _views(batch, 1, 2, 3):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(text)), pa.array(_pack(text)), pa.array(_pack(metadata)), pa.array(toxic.value.score(texts))],
                    ["id", "content", "page", "toxic"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return _given(docs, id_col, text_col, lang_col, source_col).mapInArrow(run, f"id {kind}, content binary, page binary, toxic double")


def _known(labels: DataFrame, label_id: str, label_col: str) -> DataFrame:
    """One label (0 or 1) for each id that has any."""
    given = labels.select(F.col(f"`{label_id}`").alias("id"), F.col(f"`{label_col}`").cast("double").alias("y"))
    return given.filter("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))


def _below(total: int, n: int) -> Column:
    """A condition on the hash of the id that about ``n`` of ``total`` rows, and few less, meet."""
    share = min(1.0, (n + 5 * n**0.5 + 10) / max(total, 1))
    return F.xxhash64("id") <= F.lit(min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63)))


def _sampled(rows: DataFrame, total: int, n: int) -> list:
    """``n`` rows at most by the order of a hash of the id; few more than those leave the tasks."""
    return sorted(rows.withColumn("order", F.xxhash64("id")).filter(_below(total, n)).collect(), key=lambda r: (r["order"], str(r["id"])))[:n]


def co_train(seen: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE, exchanged: int = EXCHANGED, rounds: int = ROUNDS) -> Model:
    """The model from the ``features`` of all documents and the labels (0 or 1) of some."""
    known = _known(labels, label_id, label_col)
    chosen = seen.sparkSession.createDataFrame([(r["id"], r["y"]) for r in _sampled(known, known.count(), sample)], known.schema)
    rows = seen.join(F.broadcast(chosen), "id").collect()
    rows = list({r["id"]: r for r in rows}.values())
    y = np.array([r["y"] for r in rows], np.float64)
    if len(set(y)) < 2:
        return Model()
    x = [_unpack([r[c] for r in rows], w) for c, w in zip(("content", "page"), _WIDTHS, strict=True)]
    held = _held(r["id"] for r in rows)
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    own = [(x[v][~held], y[~held]) for v in (0, 1)]
    model = Model(fit(*own[0]), fit(*own[1]))
    kind = seen.schema["id"].dataType.simpleString()
    for _ in range(rounds):
        weights = (model.text, model.metadata)

        def sure(batches, weights=weights):
            for batch in _cut(batches):
                both = [
                    chance(logits(_unpack(batch.column(c).to_pylist(), w), weights[v]))
                    for v, (c, w) in enumerate(zip(("content", "page"), _WIDTHS, strict=True))
                ]
                for v in (0, 1):  # what view v is sure of teaches the other one
                    p = both[v]
                    for label, picked in ((1, p >= SURE), (0, p <= 1 - SURE)):
                        other = both[1 - v] if label else 1 - both[1 - v]  # for that label; none if it is against
                        at = pa.array(np.flatnonzero(picked & (other < SURE) & (other > AGAINST)))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(at), batch.column("page" if v == 0 else "content").take(at),
                             pa.array(np.full(len(at), v), pa.int32()), pa.array(np.full(len(at), label), pa.int32())],
                            ["id", "x", "teacher", "y"],
                        )

        found = seen.mapInArrow(sure, f"id {kind}, x binary, teacher int, y int")
        totals = {(r["teacher"], r["y"]): r["count"] for r in found.groupBy("teacher", "y").count().collect()}
        wanted = F.lit(False)
        for (teacher, label), total in totals.items():
            wanted |= (F.col("teacher") == teacher) & (F.col("y") == label) & _below(total, exchanged // 2)
        by_kind: dict[tuple, list] = {}
        for r in found.withColumn("order", F.xxhash64("id")).filter(wanted).collect():
            by_kind.setdefault((r["teacher"], r["y"]), []).append(r)
        first = [r for some in by_kind.values() for r in sorted(some, key=lambda r: (r["order"], str(r["id"])))[: exchanged // 2]]
        asked = seen.sparkSession.createDataFrame([(r["id"],) for r in first], known.select("id").schema).distinct()
        labelled = {r["id"] for r in known.join(F.broadcast(asked), "id").collect()}
        taught = []
        for teacher in (0, 1):
            learner = 1 - teacher
            some = [r for r in first if r["teacher"] == teacher and r["id"] not in labelled]
            taught.append(len(some))
            if some:
                own[learner] = (
                    np.vstack([own[learner][0], _unpack([r["x"] for r in some], _WIDTHS[learner])]),
                    np.concatenate([own[learner][1], [r["y"] for r in some]]),
                )
        model = Model(fit(*own[0]), fit(*own[1]), exchanged=[*model.exchanged, tuple(taught)])
    check = held if held.any() else np.ones(len(y), bool)
    both = np.stack([logits(x[0][check], model.text), logits(x[1][check], model.metadata)], 1)
    model.joined = fit(both, y[check], ridge=1e-3)
    return model


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """Per document row: its id, ``score`` (chance of being good), ``accepted`` by it, ``toxic_score``,
    and ``kept``: accepted and not toxic."""
    toxicity = learn_toxicity(docs, labels, id_col, columns.get("text_col", "text"))
    seen = settled(features(docs, id_col, **columns, toxicity=toxicity))
    model = docs.sparkSession.sparkContext.broadcast(co_train(seen, labels))

    def run(batches):
        for batch in _cut(batches):
            both = [_unpack(batch.column(c).to_pylist(), w) for c, w in zip(("content", "page"), _WIDTHS, strict=True)]
            score = model.value.score(*both).astype(np.float64)
            good, toxic = score >= threshold, np.asarray(batch.column("toxic"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(score), pa.array(good), pa.array(toxic), pa.array(good & (toxic < threshold))],
                ["id", "score", "accepted", "toxic_score", "kept"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return seen.mapInArrow(run, f"id {kind}, score double, accepted boolean, toxic_score double, kept boolean").withColumnRenamed("id", id_col)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents, all columns, without those the classifier rejects and the toxic ones."""
    toxic = docs.sparkSession.sparkContext.broadcast(learn_toxicity(docs, labels, id_col, text_col))
    seen = settled(features(docs, id_col, text_col, lang_col, source_col))
    model = docs.sparkSession.sparkContext.broadcast(co_train(seen, labels))
    places = [docs.columns.index(c) if c in docs.columns else None for c in (text_col, lang_col, source_col)]

    def run(batches):
        for batch in batches:
            keep = [
                (model.value.score(_unpack(_pack(text), _WIDTHS[0]), _unpack(_pack(page), _WIDTHS[1])) >= threshold)
                & (toxic.value.score(texts) < threshold)
                for _, texts, text, page in _views(batch, *places)
            ]
            yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch

    return docs.mapInArrow(run, docs.schema)
