"""SentencePiece encoding with byte spans of the source, and decoding.

A text is normalised by longest prefix through the compiled character map, which records the
source byte of every byte written. The normalised text is cut before space marks that follow
another character: no piece of such a vocabulary crosses that place, so each part is encoded
on its own, and its ids and their offsets within it are kept for later texts. A piece's byte span is the alignment at its
ends; the byte pieces of one character all get that character's span.

Defined cases: a null or empty text has no tokens and decodes to ""; a mark U+2581 in the text
is a space, as in the library; of merges with equal scores the leftmost is first, as there; texts of any length are
encoded whole, part by part; repeated rows are encoded each by itself; an empty table gives an empty result; extra columns are not
read. A model whose pieces cross spaces, or that squeezes spaces, is encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_struct, worker_cache
from .pieces import BYTE, NORMAL, SPACE, ModelFile

PARTS = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Parts whose ids a worker keeps; the memory is bounded, the results are not affected.
KEPT = 300_000
#: Texts that are encoded together, and their bytes.
GROUP, GROUP_BYTES = 256, 1 << 20


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        self.model = ModelFile(path)
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.split = self.model.by_word and self.model.normalizer.plain
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.model.pieces, self.model.kinds)], dtype=np.int64)
        self.odd = np.array([k != NORMAL for k in self.model.kinds], dtype=bool)
        self.said = [str(k) for k in range(len(self.model.pieces))]
        self.known: dict[str, tuple] = {}
        self.back: dict[str, str] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        cache = worker_cache()
        if (k := ("codec", path)) not in cache:
            cache[k] = cls(path)
        return cache[k]

    def learn(self, parts: set[str]) -> None:
        """Ids and offsets of parts; the library adds the first mark itself."""
        if len(self.known) > KEPT:
            self.known.clear()
        new = [p for p in parts if p not in self.known]
        if not new:
            return
        ids = [i if p != SPACE else [self.library.piece_to_id(SPACE)] for p, i in zip(new, self.library.encode([p[1:] for p in new], num_threads=1))]
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64)
        counts = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        cuts = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum(self.sizes[flat])
        base = np.repeat(np.concatenate(([0], ends))[cuts[:-1]], counts)
        places = np.stack((ends - self.sizes[flat] - base, ends - base), axis=1).astype("<i4").tobytes()
        heads = np.stack((counts, [len(p.encode()) for p in new]), axis=1).astype("<i4").tobytes()
        cuts = (8 * cuts).tolist()
        said = [",".join(map(self.said.__getitem__, i)) for i in ids]
        self.known.update(zip(new, zip(said, [places[s:e] for s, e in zip(cuts, cuts[1:])], [heads[k : k + 8] for k in range(0, 8 * len(new), 8)])))
        # byte pieces share their character's span, and what else is no plain piece is decoded by the library
        odd = np.unique(np.repeat(np.arange(len(new)), counts)[self.odd[flat]]).tolist()
        for k in odd:
            said, _, head = self.known[new[k]]
            self.known[new[k]] = said, self.offsets(ids[k]).tobytes(), head
            if any(self.model.kinds[i] != BYTE and self.odd[i] for i in ids[k]) or not self.model.byte_fallback:
                self.back[new[k]] = " " + self.library.decode(ids[k])

    def offsets(self, ids: list[int]) -> array:
        """Where each id begins and ends in the normalised bytes, in turn; the byte pieces of one character share its own."""
        out, at, sizes = array("i"), 0, self.sizes
        waiting: list[int] = []
        for i in ids:
            if self.model.kinds[i] == BYTE:
                waiting.append(i)
                if _whole(bytes(int(self.model.pieces[b][3:5], 16) for b in waiting)):
                    out.extend((at, at + len(waiting)) * len(waiting))
                    at, waiting = at + len(waiting), []
            else:
                out.append(at)
                at += int(sizes[i])
                out.append(at)
        return out

    def encoded(self, texts: list[str]):
        """Of each text: its ids, comma-separated; what they decode to; and the source byte span of each id.

        Plain and byte pieces spell the normalised text, so it is what they decode to, but for the
        first mark and with spaces for marks; only parts with other pieces need the library for it.
        """
        normal = [self.model.normalizer(t.encode()) for t in texts]
        if not self.split:
            for t, (_, align) in zip(texts, normal):
                ids = self.library.encode(t)
                yield ",".join(map(str, ids)), self.library.decode(ids), np.asarray(align, dtype="<i8")[np.array(self.offsets(ids), dtype=np.int64)].reshape(-1, 2)
            return
        marked = [n.decode() for n, _ in normal]
        cut = [PARTS.findall(n) for n in marked]
        self.back: dict[str, str] = {p: d for p, d in self.back.items() if p in self.known}
        self.learn({p for parts in cut for p in parts})
        known, back = self.known, self.back
        for text, parts, (_, align) in zip(marked, cut, normal):
            said, within, heads = zip(*[known[p] for p in parts]) if parts else ((),) * 3
            counts, sizes = np.frombuffer(b"".join(heads), dtype="<i4").reshape(-1, 2).T
            begins = np.repeat(np.cumsum(sizes) - sizes, 2 * counts)
            places = np.frombuffer(b"".join(within), dtype="<i4") + begins
            spelt = "".join(back.get(p, p) for p in parts) if back and not back.keys().isdisjoint(parts) else text
            yield ",".join(said), spelt.replace(SPACE, " ")[1:], np.asarray(align, dtype="<i8")[places].reshape(-1, 2)

    def encode(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids, and the source byte span of each."""
        ((said, _, spans),) = self.encoded([text])
        return [int(i) for i in said.split(",") if i], [(s, e) for s, e in spans.tolist()]

    def digests(self, texts: list[bytes]) -> dict:
        n, ids_sha, text_sha, spans_sha = [], [], [], []
        for s, e in _groups(texts):
            for said, back, spans in self.encoded([t.decode("utf-8", "replace") for t in texts[s:e]]):
                n.append(len(spans))
                ids_sha.append(hashlib.sha256(said.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                spans_sha.append(hashlib.sha256(spans.tobytes()).hexdigest())
        return {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string()), "spans_sha256": pa.array(spans_sha, pa.string())}


def _groups(texts: list[bytes]):
    """Ranges of texts that are encoded together: at most GROUP of them, and about GROUP_BYTES bytes."""
    start = total = 0
    for k, t in enumerate(texts):
        if k > start and (k - start == GROUP or total + len(t) > GROUP_BYTES):
            yield start, k
            start, total = k, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


def _whole(b: bytes) -> bool:
    try:
        b.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: number of ids, and digests of the ids, of what they decode to, and of the spans.

    spans_sha256 is of each id's source byte span in turn: where it begins and ends, as little-endian words of 64 bits.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    udf = text_struct(lambda: Codec.of(path).digests, "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string")
    return rows.select("doc_id", udf("text").alias("s")).select("doc_id", "s.*")


def encode(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: ids, and of each id where its source bytes begin and end."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def make():
        codec = Codec.of(path)

        def run(texts: list[bytes]) -> dict:
            both = [codec.encode(t.decode("utf-8", "replace")) for t in texts]
            lists = [b[0] for b in both]
            return {
                "ids": pa.array(lists, pa.list_(pa.int32())),
                "span_starts": pa.array([[s for s, _ in b[1]] for b in both], pa.list_(pa.int64())),
                "span_ends": pa.array([[e for _, e in b[1]] for b in both], pa.list_(pa.int64())),
            }

        return run

    udf = text_struct(make, "ids array<int>, span_starts array<bigint>, span_ends array<bigint>")
    return rows.select("doc_id", udf("text").alias("s")).select("doc_id", "s.*")
