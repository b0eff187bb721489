"""Best-fit packing of tokenized documents into sequences, planned over run-length-coded lists.

A document is its token ids and an end id. Only documents longer than a sequence are cut, into
full sequences and a rest; these pieces are packed whole.

*Rounds.* They run on the driver, over counts and not over rows: pieces sorted by length, open sequences by gap. A round takes the longest
length that is left; the successor of that length among the gaps is the tightest fit. All
pieces of the length are matched at once: by rank they fill the gaps of the successor class
in order (as many to a gap as best fit would put there), then those of the next class, then
new sequences; the gaps shrink and the next round begins. Pieces of one length are alike, so
both sorted lists are run-length coded: a round handles counts, and its outcome equals
sequential best fit decreasing. The lists have one entry a length, at most `capacity`, and the
plan at most 4 * capacity ** 2 rows at any size of the table; that bounds what goes to the
driver and into each task.

*Ranks.* A piece's rank within its length is its row number within (length, salt) plus the
counts of the smaller salts, so no task holds all pieces of one length.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each by
itself; ties in rank follow the salt, then id, piece and checksum; an empty table has no
sequences; a text of any length is tokenized whole, and its pieces are rows of their own; extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import checkpointed, chunks_of, partitions, texts_of, worker_cache

CAPACITY, END_ID = 2048, 0
#: Words of a generation: a worker keeps those of this and the last one, so its memory is bounded; results are not affected.
KEPT = 300_000
#: Texts that are encoded together, and about how many bytes of them; longer texts are encoded in parts, cut between words.
GROUP, GROUP_BYTES = 256, 1 << 19
#: Between words: these never join a word's tokens, so words are encoded each by itself.
BLANKS = " \t\n\r"
_BLANKS = str.maketrans("\t\n\r", "   ")
#: Letters below this code point have one lower-case letter and are composed already, whatever stands beside them; but for one.
_PLAIN_BELOW, _NOT_PLAIN = "\u0250", "\u0130"
#: The vocabulary's cuts of a text, and below _PLAIN_BELOW its classes of letters, numbers and white space.
CUTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_ODD = re.compile(f"[^\x00-{chr(ord(_PLAIN_BELOW) - 1)}]|{_NOT_PLAIN}").search
_LETTERS, _NUMBERS, _SPACES = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be printed, else the next from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b if b in shown else 256 + others.index(b)) for b in range(256)}


class WordTokenizer:
    """Ids of whole texts from ids of words, which are kept.

    A text of plain letters is lower-cased and cut as the vocabulary does it, and its words are
    split by the merges alone, many at a time. A word with any other letter, or with the string
    of a special token, goes through the library's whole chain. Both give the library's ids.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.merges = None
        if _is_lower_byte_level(spec):
            self.merges = Tokenizer(self.library.model)
            self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            vocabulary, suffix = self.library.get_vocab(with_added_tokens=False), self.library.model.end_of_word_suffix
            self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
            self.ends[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True
            self.letters = _byte_letters()
            # most words are letters, which no other cut begins with: they are tried first
            contractions, letters, others = CUTS.partition("|[\\p{L}]+")
            cuts = f"{letters[1:]}|{contractions}{others}".replace("\\p{L}", _LETTERS).replace("\\p{N}", _NUMBERS).replace("\\s", _SPACES)
            self.cut = re.compile(cuts).findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        cache = worker_cache()
        if (k := ("words", path)) not in cache:
            cache[k] = cls(path)
        return cache[k]

    def _plain(self, text: str) -> bool:
        if self.merges is None or not (text.isascii() or _ODD(text) is None):
            return False
        return not any(t in text for t in self.special)

    def _words(self, text: str, odd: set[str]) -> list[str]:
        """The text's words; those for the library hold a letter or a token that others do not, and go to `odd` too."""
        if self._plain(text):
            return self.cut(text.lower())
        out: list[str] = []
        run: list[str] = []
        for word in text.translate(_BLANKS).split(" "):
            if self._plain(word):
                run.append(word)
            else:
                if run:
                    out += self.cut(" ".join(run).lower())
                    run = []
                out.append(word)
                odd.add(word)
        return out + self.cut(" ".join(run).lower()) if run else out

    def _learn(self, new: set[str], odd: set[str]) -> None:
        known, old = self.known, self.old
        if old:
            again = [w for w in new if w in old]
            known.update(zip(again, map(old.__getitem__, again)))
            new.difference_update(again)
        whole = list(new & odd)
        for s in range(0, len(whole), 4096):
            some = whole[s : s + 4096]
            for w, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False)):
                known[w] = np.array(e.ids, dtype="<u4").tobytes()
        words = list(new - odd)
        for s in range(0, len(words), 4096):
            some = words[s : s + 4096]
            shown = [w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.letters) for w in some]
            ids = np.array(self.merges.encode(" ".join(shown), add_special_tokens=False).ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw = ids.tobytes()
            known.update(zip(some, [raw[s:e] for s, e in zip([0, *cuts[:-1]], cuts, strict=True)], strict=True))

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KEPT:
            self.known, self.old = {}, self.known
        odd: set[str] = set()
        words = [self._words(t, odd) for t in texts]
        held = list(set().union(*words))
        ids = dict(zip(held, map(self.known.get, held)))  # small enough for the processor's cache
        new = [w for w, have in ids.items() if have is None]
        self._learn(set(new), odd)
        ids.update(zip(new, map(self.known.__getitem__, new)))
        return [b"".join(map(ids.__getitem__, w)) for w in words]

    def rest(self) -> None:
        """Between tasks one generation is kept: the next task meets half of its words again, and a worker that goes on to other operators holds no more."""
        self.known, self.old = {}, self.known

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        out: list[bytes] = []
        for s, e in chunks_of(texts, GROUP_BYTES):
            for k in range(s, e, GROUP):
                some = [t.decode("utf-8", "replace") for t in texts[k : min(e, k + GROUP)]]
                out += self._group(some) if len(some) > 1 or len(some[0]) <= 2 * GROUP_BYTES else [b"".join(self._group([p])[0] for p in _parts(some[0]))]
        return out


def _parts(text: str):
    """A long text in parts of about GROUP_BYTES characters, cut at blanks; what has none stays whole."""
    start = 0
    while len(text) - start > GROUP_BYTES:
        at = re.compile(f"[{BLANKS}]").search(text, start + GROUP_BYTES)
        if at is None:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


def _is_lower_byte_level(spec: dict) -> bool:
    """Whether a tokenizer lower-cases composed text, cuts it by CUTS, maps bytes to letters, and marks ends of words."""
    chain = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    cuts = any(s.get("type") == "Split" and s["pattern"].get("Regex") == CUTS and s.get("invert") and s.get("behavior") == "Removed" for s in splits)
    mapped = any(s.get("type") == "ByteLevel" and not s.get("use_regex") and not s.get("add_prefix_space") for s in splits)
    model = spec.get("model") or {}
    return chain == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and cuts and mapped and bool(model.get("end_of_word_suffix")) and not model.get("ignore_merges")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches):
        tokenizer = WordTokenizer.of(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), texts_of(batch.column(1))
            for s, e in chunks_of(texts, GROUP_BYTES):
                rows = []
                for doc, ids in zip(docs[s:e], tokenizer.ids(texts[s:e])):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                keep = 6 if with_ids else 5
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols[:keep], kinds)], names=names[:keep])
        tokenizer.rest()

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, and with `with_ids` the ids as bytes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cut(path, capacity, end_id, with_ids), PIECES + (", ids binary" if with_ids else ""))


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """The plan: rows (length, first rank, end rank, pieces a sequence, first sequence, offset).

    Piece `rank` of a row goes to sequence `first + (rank - first rank) // pieces`, at `offset`
    plus the lengths of those before it there.
    """
    plan = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    open_gaps = np.zeros(capacity + 1, dtype=bool)
    sequences = 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps[gap].append((first, n))
            open_gaps[gap] = True

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = np.flatnonzero(open_gaps[length:])
            if len(fits):
                gap = length + int(fits[0])
                first, n = gaps[gap].pop()
                open_gaps[gap] = bool(gaps[gap])
            else:
                gap, first, n = capacity, sequences, -(-left // (capacity // length))
                sequences += n
            each = gap // length
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            plan.append((length, rank, rank + placed, each, first, capacity - gap))
            full, rest = divmod(placed, each)
            leave(gap - each * length, first, full)
            if rest:
                leave(gap - rest * length, first + full, 1)
            leave(gap, first + used, n - used)
            rank += placed
            left -= placed
    return plan


def _place(plan: list):
    arrays = [np.array(x, dtype=np.int64) for x in zip(*sorted(plan))] if plan else [np.zeros(0, np.int64)] * 6

    def run(batches):
        length, first, _, each, sequence, offset = arrays
        keys = (length << 44) + first
        for batch in batches:
            own, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(keys, (own << 44) + rank, side="right") - 1
            step = rank - first[at]
            out = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            out += [pa.array(sequence[at] + step // each[at]), pa.array(offset[at] + step % each[at] * own)]
            yield pa.record_batch(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row a piece, with its sequence_id and offset."""
    cut = checkpointed(pieces(docs, path, capacity, end_id))
    salts = 4 * partitions(docs.sparkSession)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    sums = salted.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("row", F.row_number().over(within)).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("row") - 1)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_place(best_fit(counts, capacity)), PIECES + ", sequence_id long, offset long")
