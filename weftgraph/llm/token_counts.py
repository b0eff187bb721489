"""Token counts of a unigram model without the tokens: Viterbi that carries only a count.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at each character. The
best score of a prefix is the best over pieces that end there; among equal scores the piece
that starts first wins, as in the tokenizer, whose search runs forward and replaces a path
only by a better one. A character without a piece of its own costs ten below the lowest score,
and counts as its UTF-8 bytes if the model falls back to bytes. The pieces are those of the
vocabulary file; nothing is trained. A file of merge ranks has no probabilities, so the score
of a piece is the logarithm of Zipf's law at its rank (`zipf_scores`); a unigram file's own
scores are taken as they are. Sums are in double precision, where the library's
single-precision sums of very long texts round.

Defined cases: a null or empty text has 0 tokens; ties are decided as above; repeated rows are
counted each by itself; extra columns are not read. Texts are cut at space marks only where
no piece of the vocabulary crosses, so whole texts are counted in memory of one part.
"""

from __future__ import annotations

import math
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_struct, worker_cache
from .piece_codec import KEPT, PARTS
from .pieces import NORMAL, SPACE, ModelFile

#: Fixed value: what a character without a piece costs below the lowest score.
UNKNOWN_PENALTY = 10.0


#: Fixed value: the model type of a unigram file.
UNIGRAM = 1


def zipf_scores(model: ModelFile) -> list[float]:
    """log p of each piece if p falls as 1 / rank; pieces are ranked by score, then by id. As 32-bit floats."""
    normal = sorted((i for i, k in enumerate(model.kinds) if k == NORMAL), key=lambda i: (-model.scores[i], i))
    total = math.log(sum(1 / r for r in range(1, len(normal) + 1))) if normal else 0.0
    out = [0.0] * len(model.kinds)
    for rank, i in enumerate(normal, 1):
        out[i] = struct.unpack("<f", struct.pack("<f", -math.log(rank) - total))[0]
    return out


class Counter:
    def __init__(self, path: str):
        import ahocorasick

        self.model = ModelFile(path)
        self.automaton = ahocorasick.Automaton()
        self.scores = self.model.scores if self.model.trainer.get(3, UNIGRAM) == UNIGRAM else zipf_scores(self.model)
        scores = [s for s, k in zip(self.scores, self.model.kinds) if k == NORMAL]
        self.unknown = min(scores, default=0.0) - UNKNOWN_PENALTY
        self.single = set()
        for piece, score, kind in zip(self.model.pieces, self.scores, self.model.kinds):
            if kind == NORMAL and piece:
                self.automaton.add_word(piece, (len(piece), score))
                if len(piece) == 1:
                    self.single.add(piece)
        self.automaton.make_automaton()
        self.split = self.model.by_word and self.model.normalizer.plain
        self.known: dict[str, tuple[int, float]] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        cache = worker_cache()
        if (k := ("counter", path)) not in cache:
            cache[k] = cls(path)
        return cache[k]

    def part(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(text)
        best: list = [None] * (n + 1)
        count = [0] * (n + 1)
        best[0] = 0.0
        single, done = self.single, 0
        fallback = self.model.byte_fallback

        def lone(upto: int) -> None:
            for at in range(done, upto):
                if text[at] not in single and best[at] is not None:
                    score = best[at] + self.unknown
                    if best[at + 1] is None or score > best[at + 1]:
                        best[at + 1], count[at + 1] = score, count[at] + (len(text[at].encode("utf-8", "replace")) if fallback else 1)

        # pieces of one end come longest first, so the earliest start is seen first
        for last, (length, score) in self.automaton.iter(text):
            if last > done:
                lone(last)
                done = last
            start = last + 1 - length
            if best[start] is None:
                continue
            score += best[start]
            if best[last + 1] is None or score > best[last + 1]:
                best[last + 1], count[last + 1] = score, count[start] + 1
        lone(n)
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if not self.split:
            return self.part(self.model.normalizer(text.encode())[0].decode("utf-8", "replace"))
        known, n, total = self.known, 0, 0.0
        if len(known) > KEPT:
            known.clear()
        for p in PARTS.findall(SPACE + text.replace(" ", SPACE)):
            have = known.get(p)
            if have is None:
                have = known[p] = self.part(p)
            n += have[0]
            total += have[1]
        return n, total

    def counts(self, texts: list[bytes]) -> dict:
        both = [self.text(t.decode("utf-8", "replace")) for t in texts]
        return {"n_tokens": pa.array([b[0] for b in both], pa.int64()), "score": pa.array([b[1] for b in both], pa.float64())}


def counts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: tokens of its best segmentation, and that segmentation's score."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    udf = text_struct(lambda: Counter.of(path).counts, "n_tokens long, score double")
    return rows.select("doc_id", udf("text").alias("s")).select("doc_id", "s.*")
