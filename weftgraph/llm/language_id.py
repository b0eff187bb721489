"""Language identification: averaged hashed subword embeddings under a linear softmax.

A document is the average of the embeddings of its subwords: all runs of one to four characters of
its lower-cased words, a word's edges among them, hashed into BUCKETS rows. A linear softmax
reads the language from that average. Both are trained by stochastic gradient descent in numpy, on
at most ROWS labelled documents (equally many a language, those whose texts hash lowest, equal
texts once); their features are taken in tasks. A fifth of the sample, chosen by text, is kept
from training: it sets the temperature that makes the score a probability, and the score below
which a prediction is marked `rejected`, so that what is left is right in PRECISION of the cases.

For prediction the embeddings are multiplied by the softmax once, in fixed point, so that a document costs
sums of whole numbers and its result depends on nothing but its text.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every document
where nothing is labelled. Texts of any length are read whole. A null lang, and a null id (which
has no remainder, and so is neither held out), teach nothing. Ties between languages go to the
first by name; repeated rows are predicted each by itself; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import chunks_of, text_struct, texts_of, worker_cache

UNKNOWN = "und"
#: Labelled documents that a model is fitted on, at most.
ROWS = 4096
BUCKETS, DIM, ORDERS = 1 << 16, 16, 4
EPOCHS, RATE, SEED = 4, 8.0, 11
#: The share of accepted predictions that is to be right.
PRECISION = 0.99
#: Of the sample, one in so many texts calibrates.
CALIBRATION = 5
_POINT = 1 << 16


def _letters() -> np.ndarray:
    cache = worker_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return cache["letters"]


def subwords(texts: list[bytes]):
    """For each order: the rows of its subwords, and where each text's begin and end among them."""
    lower = [t.decode("utf-8", "replace").lower() for t in texts]
    code = np.frombuffer(("\0" + "\0".join(lower) + "\0\0\0\0").encode("utf-32-le"), dtype="<u4")
    letter = _letters()[code]
    # separators belong to the text before them; no subword of two texts passes one
    edges = np.cumsum([1, *(len(t) + 1 for t in lower)])
    code = np.where(letter, code, 0).astype(np.uint32)
    n = len(code) - ORDERS
    hashed = np.zeros(n, dtype=np.uint32)
    inner = {1: letter[:n], 2: letter[:n] | letter[1 : n + 1], 3: letter[1 : n + 1], 4: letter[1 : n + 1] & letter[2 : n + 2]}
    for order in range(1, ORDERS + 1):
        hashed = (hashed + np.uint32(order)) * np.uint32(0x01000193) ^ code[order - 1 : n + order - 1] * np.uint32(0x9E3779B1)
        at = np.flatnonzero(inner[order])
        row = hashed[at]
        row = (row ^ (row >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(16)
        anchor = at + (~letter[at] if order == 2 else order > 2)
        yield row.astype(np.int64), np.searchsorted(anchor, edges)


def _counted(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct rows and their counts, of each text."""
    orders = list(subwords(texts))
    parts = [np.concatenate([rows[cut[k] : cut[k + 1]] for rows, cut in orders]) for k in range(len(texts))]
    return [np.unique(p, return_counts=True) for p in parts]


class Model:
    """Languages in order, embeddings, softmax weights and offsets, temperature, least accepted score."""

    def __init__(self, languages: list[str]):
        draw = np.random.default_rng(SEED)
        self.languages = languages
        self.rows = draw.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.weights, self.offsets = draw.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
        self.temperature, self.floor = 1.0, 0.0

    def logits(self, row: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (count / max(1, count.sum())) @ self.rows[row] @ self.weights + self.offsets

    def step(self, row: np.ndarray, count: np.ndarray, language: int, rate: float) -> None:
        share, held = (count / count.sum()).astype(np.float32), self.rows[row]
        mean = share @ held
        wrong = _softmax(mean @ self.weights + self.offsets)
        wrong[language] -= 1
        back = self.weights @ wrong
        self.weights -= rate * 0.1 * np.outer(mean, wrong)
        self.offsets -= rate * 0.01 * wrong
        # rows of a document are distinct; the root keeps those of common subwords from taking all
        self.rows[row] = held - np.outer(np.float32(0.2 * rate) * np.sqrt(share), back.astype(np.float32))

    def calibrate(self, samples: list) -> None:
        """Temperature of least loss, with targets short of certainty (n + 1) / (n + 2); then the least score that keeps the precision."""
        if not samples:
            return
        logits = np.stack([self.logits(r, c) for r, c, _ in samples])
        truth = np.array([y for _, _, y in samples])
        sure = (len(truth) + 1) / (len(truth) + 2)
        target = np.full(logits.shape, (1 - sure) / max(1, logits.shape[1] - 1))
        target[np.arange(len(truth)), truth] = sure
        losses = {t: -(target * np.log(_softmax(logits / t) + 1e-300)).sum() for t in np.geomspace(0.05, 20, 121)}
        self.temperature = float(min(losses, key=losses.get))
        score = _softmax(logits / self.temperature)
        right = score.argmax(1) == truth
        score = score.max(1)
        order = np.argsort(-score, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= PRECISION * np.arange(1, len(order) + 1))
        self.floor = float(score[order[good[-1]]]) if len(good) else 1.0

    def table(self) -> tuple[np.ndarray, np.ndarray | None]:
        """What a subword adds, in fixed point: to the logits, or to the average where that is shorter; and what then multiplies it."""
        few = len(self.languages) <= DIM
        return np.rint((self.rows @ self.weights if few else self.rows) * _POINT).astype(np.int32), None if few else self.weights


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def predictor(model: Model | None):
    """A function from texts to columns lang_pred, score and rejected."""
    if model is None:
        return lambda texts: {"lang_pred": [UNKNOWN] * len(texts), "score": np.zeros(len(texts)), "rejected": np.ones(len(texts), dtype=bool)}
    table, weights = model.table()
    languages, offsets, temperature, floor = [*model.languages, UNKNOWN], model.offsets, model.temperature, model.floor

    def sums(texts):
        total, n = np.zeros((len(texts), table.shape[1]), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        for rows, cut in subwords(texts):
            held = np.flatnonzero(np.diff(cut))
            if len(held):
                total[held] += np.add.reduceat(table[rows], cut[:-1][held], axis=0, dtype=np.int64)
                n[held] += np.diff(cut)[held]
        return total, n

    def run(texts):
        parts = [sums(texts[s:e]) for s, e in chunks_of(texts)]
        total = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, table.shape[1]), dtype=np.int64)
        n = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        mean = total / (_POINT * np.maximum(n, 1))[:, None]
        score = _softmax(((mean if weights is None else mean @ weights) + offsets) / temperature)
        best = np.where(n > 0, score.argmax(1), len(languages) - 1)
        score = np.where(n > 0, score.max(1), 0.0)
        return {"lang_pred": [languages[k] for k in best], "score": score, "rejected": (n == 0) | (score < floor)}

    return run


# ---- learning ---------------------------------------------------------------------------


def held_out(doc_id) -> F.Column:
    """Whether the document is kept from learning: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def _sampled(batches):
    seen = set()
    for batch in batches:
        lang, key = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        new = []
        for k, who in enumerate(zip(lang, key)):
            if who not in seen:
                seen.add(who)
                new.append(k)
        counted = _counted(texts_of(batch.column(2).take(pa.array(new, pa.int64()))))
        full = [(k, c) for k, c in zip(new, counted) if len(c[0])]
        yield pa.record_batch(
            {
                "lang": pa.array([lang[k] for k, _ in full], pa.string()), "key": pa.array([key[k] for k, _ in full], pa.int64()),
                "rows": pa.array([c[0].astype("<i4").tobytes() for _, c in full], pa.binary()), "counts": pa.array([c[1].astype("<i4").tobytes() for _, c in full], pa.binary()),
            }
        )


def sample(docs: DataFrame, rows: int = ROWS) -> list:
    """Features of the labelled documents to learn from, at most `rows` of distinct texts, and equally many a language."""
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row a class of the model
    if not sizes:
        return []
    each = max(1, rows // len(sizes))
    # texts below a share of all hashes: twice as many as asked for, so that what follows is bounded
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * each / n))])
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    few = labelled.select("lang", key.alias("key"), "text").filter(F.pmod("key", F.lit(1 << 30)) < bound[F.col("lang")] * (1 << 30))
    few = few.mapInArrow(_sampled, "lang string, key long, rows binary, counts binary").dropDuplicates(["lang", "key"])
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    return few.withColumn("at", first).filter(F.col("at") <= each).orderBy("key", "lang").collect()


def fit(docs: DataFrame, rows: int = ROWS) -> Model | None:
    """A model of documents' lang by their text; None where nothing is labelled."""
    found = sample(docs, rows)
    if not found:
        return None
    languages = sorted({r["lang"] for r in found})
    at = {lang: k for k, lang in enumerate(languages)}
    model = Model(languages)
    all_ = [(np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["counts"], "<i4"), at[r["lang"]], r["key"]) for r in found]
    kept = [x[:3] for x in all_ if x[3] % CALIBRATION]
    held = [x[:3] for x in all_ if not x[3] % CALIBRATION]
    draw, done, steps = np.random.default_rng(SEED), 0, EPOCHS * max(1, len(kept))
    for _ in range(EPOCHS):
        for k in draw.permutation(len(kept)).tolist():
            model.step(*kept[k], RATE * (1 - done / steps))
            done += 1
    model.calibrate(held or kept)
    return model


def identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every document."""
    # as a literal of the task: at most BUCKETS * min(languages, DIM) whole numbers of 4 bytes
    run = predictor(model)
    found = text_struct(lambda: run, "lang_pred string, score double, rejected boolean")(F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found")).select("doc_id", "held_out", "found.*")
