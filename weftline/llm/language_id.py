"""Language identification: averaged hashed subword embeddings under a linear softmax.

Letters are kept, everything else becomes a space; the byte n-grams of the spaced words are hashed into buckets.
A text is the average of its buckets' embeddings, classified by a linear softmax. Embeddings and weights are trained
together by stochastic gradient descent in numpy, on pieces of a bounded sample of labelled texts. A temperature
and a rejection bound are calibrated on sampled texts that training left out.

As the classifier is linear, a bucket's embedding times the weights is a fixed vector of scores; prediction averages
those vectors, so whole texts of any length need one pass and memory for one block.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import small_batches, text_blocks

#: Labelled texts of each language that training and calibration may see, and the longest of them in characters.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS = 400, 20_000
#: Languages that the sample may have; rarer ones beyond it are not learned.
LANGUAGES = 400
BUCKETS, DIMENSIONS, GRAMS = 1 << 15, 24, (2, 3, 4)
UNDETERMINED = "und"

_ASCII_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_ASCII_LETTER, _OTHER = re.compile("[A-Za-z]"), re.compile(r"[^\W\x00-\x7F]+")


def buckets(text: bytes, limit: int = 1 << 22):
    """Hashed byte n-grams of a text's words, framed by spaces, block by block; at most `limit` bytes are held."""
    words = b" ".join(text.translate(_ASCII_LETTERS).split())
    for at in range(0, max(len(words), 1), limit):
        part = np.frombuffer(b" " * (at == 0) + words[at : at + limit + max(GRAMS) - 1] + b" ", np.uint8).astype(np.uint64)
        out, rolled = [], part
        for k in range(2, max(GRAMS) + 1):
            rolled = (rolled[:-1] << np.uint64(8)) | part[k - 1 :]
            if len(rolled) and k in GRAMS:
                with np.errstate(over="ignore"):
                    out.append(((rolled * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) ^ (rolled >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - 15))
        if out:
            yield np.concatenate(out).astype(np.int64)


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter (Unicode category L; numbers like a half or a Roman eight are none)."""
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for m in _OTHER.finditer(text) for c in m.group()))


class Model:
    """Languages, score vectors of buckets, temperature and rejection bound."""

    def __init__(self, languages: list[str], scores: np.ndarray, bias: np.ndarray, temperature: float, bound: float):
        self.languages, self.scores, self.bias, self.temperature, self.bound = languages, scores, bias, temperature, bound

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for found in buckets(text.encode()):
            counts = np.bincount(found, minlength=BUCKETS)
            total += counts @ self.scores
            n += len(found)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, probability, rejected); a text without letters is undetermined, with score 0, and rejected."""
        if not has_letter(text):
            return UNDETERMINED, 0.0, True
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.bound)


def _pieces(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Bucket counts of random pieces of the texts (sparse), from single words to hundreds."""
    out, y = [], []
    for text, label in zip(texts, labels.tolist(), strict=True):
        words = text.split()
        for size in (2, 8, 30, 120, len(words)):
            at = int(rng.integers(0, max(1, len(words) - size + 1)))
            found = [*buckets(" ".join(words[at : at + size]).encode())]
            if found and sum(map(len, found)):
                ids, counts = np.unique(np.concatenate(found), return_counts=True)
                out.append((ids, counts / counts.sum()))
                y.append(label)
    return out, np.array(y)


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 11, epochs: int = 6, rate: float = 0.5, batch: int = 32) -> Model:
    """Fit on labelled texts (null texts and labels are for the caller to leave out); the order of rows doesn't matter."""
    pairs = sorted({(t, y) for t, y in zip(texts, labels, strict=True) if has_letter(t)}, key=lambda x: (x[1], x[0]))
    languages = sorted({y for _, y in pairs})
    if not pairs:
        return Model([UNDETERMINED], np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    rng.shuffle(pairs)
    y = np.array([languages.index(k) for _, k in pairs])
    apart = np.arange(len(pairs)) % 5 == 4
    rows, target = _pieces([t for (t, _), a in zip(pairs, apart, strict=True) if not a], y[~apart], rng)
    e, w = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    e_sum, w_sum = np.full(BUCKETS, 1e-3), 1e-3
    weight = len(target) / (len(languages) * np.maximum(np.bincount(target, minlength=len(languages)), 1))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        step = rate * (1 - epoch / epochs) + 0.05
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            hidden = np.stack([rows[i][1] @ e[rows[i][0]] for i in some])
            wrong = _softmax(hidden @ w)
            wrong[np.arange(len(some)), target[some]] -= 1
            wrong *= (weight[target[some]] / len(some))[:, None]
            back = wrong @ w.T
            grad = hidden.T @ wrong
            w_sum += float((grad**2).mean())
            w -= step * grad / np.sqrt(w_sum)
            for k, i in enumerate(some):
                ids, share = rows[i]
                change = share[:, None] * back[k]
                e_sum[ids] += (change**2).mean(axis=1)
                e[ids] -= step * change / np.sqrt(e_sum[ids])[:, None]
    model = Model(languages, e @ w, np.zeros(len(languages)), 1.0, 0.0)
    # pieces of all sizes: short texts must not be rejected for being short
    held, truth = _pieces([t for (t, _), a in zip(pairs, apart, strict=True) if a], y[apart], rng)
    if held:
        z = np.stack([share @ model.scores[ids] for ids, share in held])
        grid = np.geomspace(0.02, 20, 60)
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
        # among equally good temperatures the largest is the most modest
        model.temperature = float(grid[np.flatnonzero(np.array(loss) <= min(loss) + 1e-3)[-1]])
        p = _softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        # reject only below what nearly all right answers reach, and below even odds
        model.bound = float(min(0.5, right[int(0.001 * len(right))] * 0.9)) if len(right) else 0.0
    return model


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4


def sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> tuple[list[str], list[str]]:
    """At most `per_language` labelled texts of each language, of at most `chars` characters: those of the least id hashes.

    Only rows whose id leaves a remainder other than 2 count; of rows alike in id and language the least text. Beyond
    `languages` languages the rarest are not learned, of equally rare ones those last by name. Ids are chosen first, by
    a bound on their hashes that follows each language's number of ids, so no language is ever sorted whole.
    """
    usable = documents.select("doc_id", "lang", "text").where(remainder() != 2).where("lang is not null and text is not null").where(F.length("text") <= chars)
    sizes = usable.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.05).alias("ids")).orderBy(F.desc("ids"), "lang").limit(languages).collect()
    if not sizes:
        return [], []
    # four times the rows needed pass the bound on average, so too few do hardly ever; a list of rows would start a Python daemon of its own
    shares = pa.table({"of": [r["lang"] for r in sizes], "share": [min(1.0, 4 * per_language / max(r["ids"], 1)) for r in sizes]})
    shares = usable.sparkSession.createDataFrame(shares)
    spread = F.xxhash64("doc_id")
    near = usable.join(F.broadcast(shares), F.col("lang") == F.col("of")).where((spread / F.lit(2.0**64) + 0.5) <= F.col("share"))
    order = Window.partitionBy("lang").orderBy(spread, "doc_id")
    chosen = near.select("lang", "doc_id").distinct().withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_language)
    # at most per_language * languages ids
    chosen = chosen.select(F.col("lang").alias("l"), F.col("doc_id").alias("d"))
    found = usable.join(F.broadcast(chosen), (F.col("doc_id") == F.col("d")) & (F.col("lang") == F.col("l"))).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    texts, labels = [], []
    for r in found.toLocalIterator():
        texts.append(r["text"])
        labels.append(r["lang"])
    return texts, labels


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Per document row: doc_id, held_out, lang_pred, score, rejected.

    The prediction sees the text alone, the whole of it however long. A null or empty text, or one without letters, is
    `und` with score 0 and rejected; a null doc_id is not held out. Of equally probable languages the first by name
    wins. Repeated rows repeat their result; further columns are ignored, whatever their names; an empty table gives an
    empty result, as does training on none: then all texts with letters are `und` with score 1.
    """
    handle = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known: Model = handle.value
        for batch in text_blocks(batches):
            found = [known.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = small_batches(documents.select("doc_id", F.coalesce(remainder() == 2, F.lit(False)).alias("held_out"), "text"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(documents: DataFrame, model: Model) -> DataFrame:
    """The rows that the model does not reject, all columns as they are; a null lang is filled with the prediction.

    Texts null, empty or without letters are rejected. Repeated rows are kept or rejected alike, in their number.
    """
    handle = documents.sparkSession.sparkContext.broadcast(model)
    place = documents.columns.index("lang") if "lang" in documents.columns else None

    def run(batches):
        known: Model = handle.value
        for batch in text_blocks(batches):
            found = [known.predict(t) for t in batch.column("text").to_pylist()]
            if place is not None:
                lang = pa.array([own if own is not None else x[0] for own, x in zip(batch.column(place).to_pylist(), found, strict=True)], batch.schema.field(place).type)
                batch = batch.set_column(place, batch.schema.field(place), lang)
            yield batch.filter(pa.array([not x[2] for x in found], pa.bool_()))

    return small_batches(documents).mapInArrow(run, documents.schema)
