"""Secret scans: fixed patterns, and a guess cost for values in a credential's context.

The value that follows a credential word is cut into the segmentation that an attacker would
guess soonest: words of a list (COMMON_WORDS, then the words of two public vocabularies), dates,
repeats, keyboard walks, separators, pronounceable letters and brute-force spans over the value's
alphabets, by dynamic programming over log10 guesses. A value that still costs `min_cost` decades is a
secret; a placeholder such as "password123" is not.

What people write is told from what is drawn at random: words of one case, joined or not (`case-insensitive`),
are a secret only if they cost PROSE decades a letter, more than the letters of any language cost that are guessed one after the other;
an e-mail address is none; of a path or an address of the web each part is judged by itself.

Defined cases: a null text is empty and has no spans; spans are code points, end exclusive;
ties in cost keep the earlier segmentation and do not change the verdict; texts of any length are scanned whole, a
value in time linear in its length; repeated rows are scanned each by itself; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import free_name, text_struct, worker_cache
from .pieces import NORMAL, SPACE, ModelFile

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs of these classes are taken whole, so a least length gives the same matches as a later check of it.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth|login)["']?[ \t]*(?:[:=]|\bis\b)[ \t]*["']?([^\s"']{6,})""",
    re.I | re.A,
)
#: A text without any of these cannot match ASSIGN or CONTEXT.
HINTS = ("pass", "pwd", "secret", "token", "credential", "key", "auth", "login")
#: Words that guessers try first, by rank.
COMMON_WORDS = (
    "password passwd secret admin root user test demo example sample changeme default letmein welcome login token master guest public private "
    "key api access null none true false your here the and for you with this that from have not are but was all can her his one our out day get "
    "has him how man new now old see two way who boy did its let put say she too use dragon monkey shadow sunshine princess football baseball "
    "superman batman trustno hunter ranger killer soccer hockey summer winter spring autumn flower orange banana cookie cheese pepper ginger "
    "love money happy lucky angel hello world system server client database backup service account string value insert replace placeholder"
).split()
#: Rows of a keyboard.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("@4301!5$7", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
#: Alphabets of brute-force characters; a value is guessed over those that it holds. Others count as a hundred.
ALPHABETS = ((re.compile(r"[0-9]"), 10), (re.compile(r"[a-z]"), 26), (re.compile(r"[A-Z]"), 26), (re.compile(r"[!-/:-@\[-`{-~]"), 33), (re.compile(r"[^!-~]"), 100))
#: log10 guesses of one more segment, of a run of equal separators, and of a capital among pronounceable letters.
SEGMENT, SEPARATOR, CAPITAL = 1.0, 0.5, 1.0
SEPARATORS = "-_./:,;+&'"
#: Least decades a letter of a secret that looks like words.
PROSE = 1.2
#: Letters of one case (or capitalised), up to three digits after them, in one part or several joined by single signs; addresses; paths and addresses of the web.
WORDS = re.compile(r"(?:[^\W\d_][^\W\d_A-Z]*|[A-Z]+)\d{0,3}(?:[-_./'\u2019&+:,;](?:(?:[^\W\d_][^\W\d_A-Z]*|[A-Z]+)\d{0,3}|\d{1,3}))*")
MAIL = re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+")
PATH = re.compile(r"(?:[a-z][a-z0-9+.-]*://|~?\.{0,2}/|[a-z]:[\\/])\S*", re.I)
PARTS = re.compile(r"[/\\?&=#:@]+")
#: The word list after COMMON_WORDS: pieces of LEAST_WORD ASCII letters or more of these files, those that stand alone as words before parts of words.
WORD_FILES, LEAST_WORD = ("piece_bpe_32k.model", "word_bpe_49k.json"), 3

LETTERS = "abcdefghijklmnopqrstuvwxyz"
_NO_SEPARATORS = dict.fromkeys(map(ord, SEPARATORS))
_NEXT = {(a, b) for row in ROWS for x in (row, row[::-1]) for a, b in zip(x, x[1:])}


def ranks() -> tuple[dict[str, int], int]:
    """The rank of each word of the list, and the longest word's length; read once by a worker."""
    cache = worker_cache()
    if "secret words" not in cache:
        import public_tokenizers

        model = ModelFile(public_tokenizers.path(WORD_FILES[0]))
        pieces = [(p.removeprefix(SPACE), p.startswith(SPACE)) for p, k in zip(model.pieces, model.kinds) if k == NORMAL]
        with open(public_tokenizers.path(WORD_FILES[1]), encoding="utf-8") as f:
            pieces += [(p.removesuffix("</w>"), p.endswith("</w>")) for p in json.load(f)["model"]["vocab"]]
        pieces = [(w.lower(), alone) for w, alone in pieces if len(w) >= LEAST_WORD and w.isascii() and w.isalpha()]
        words = dict.fromkeys([*COMMON_WORDS, *(w for w, alone in pieces if alone), *(w for w, alone in pieces if not alone)])
        cache["secret words"] = {w: k + 1 for k, w in enumerate(words)}, max(map(len, words))
    return cache["secret words"]


def letters() -> dict[str, float]:
    """log10 guesses of a letter after the two before it (`^` where there are fewer): half by these two, half by the last, in the words of the list; learnt once by a worker."""
    cache = worker_cache()
    if "secret letters" not in cache:
        seen: Counter = Counter()
        for word in ranks()[0]:
            text = f"^^{word}"
            for k in range(2, len(text)):
                seen.update((text[k - 2 : k + 1], text[k - 2 : k] + "*", text[k - 1 : k + 1], text[k - 1] + "*"))
        share = lambda c, n: (c + 0.5) / (n + 13)
        pairs = {a + b for a in "^" + LETTERS for b in "^" + LETTERS}
        cache["secret letters"] = {p + c: -math.log10((share(seen[p + c], seen[p + "*"]) + share(seen[p[1] + c], seen[p[1] + "*"])) / 2) for p in pairs for c in LETTERS}
    return cache["secret letters"]


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest segmentation. Linear in the value's length."""
    n = len(value)
    rank_of, longest = ranks()
    next_letter = letters()
    # separators are segments of their own, so they do not widen the alphabet of the rest
    rest = value.translate(_NO_SEPARATORS) or value
    char = math.log10(max(1, sum(size for kind, size in ALPHABETS if kind.search(rest))))
    low = value.lower()
    # letters without their accents, one for one
    bare = "".join(c if c in LETTERS else unicodedata.normalize("NFD", c)[0] for c in low) if not low.isascii() else low
    bare = bare if len(bare) == n else low
    plain = low.translate(LEET)
    dates = {}
    for at in range(n):
        if m := DATE.match(value, at):
            for end in {m.end(), min(m.end(), at + 4)}:
                dates.setdefault(end, []).append(at)
    best = [0.0] + [math.inf] * n  # cheapest cost of the first k characters
    brute = [math.inf] * (n + 1)  # the same, ending in a brute-force span
    spoken = [math.inf] * (n + 1)  # the same, ending in pronounceable letters
    run = walk = 0  # where the repeat and the keyboard walk that end here began
    for end in range(1, n + 1):
        last = end - 1
        extra = lambda start: SEGMENT if start else 0.0
        brute[end] = min(best[last] + extra(last), brute[last]) + char
        cost = brute[end]
        if bare[last] in LETTERS:
            before = "".join(c if c in LETTERS else "^" for c in ("^^" + bare[max(0, last - 2) : last])[-2:])
            spoken[end] = min(best[last] + extra(last), spoken[last]) + next_letter[("^" if before[1] == "^" else before[0]) + before[1] + bare[last]] + (CAPITAL if low[last] != value[last] else 0.0)
            cost = min(cost, spoken[end])
        if value[last] in SEPARATORS:
            start = last
            while start and end - start < 3 and value[start - 1] == value[last]:
                start -= 1
            cost = min(cost, *(best[k] + SEPARATOR for k in range(start, end)))
        for start in range(max(0, end - longest), end):
            word = plain[start:end]
            if (rank := rank_of.get(word)) and best[start] < cost:
                bent = value[start:end] != low[start:end], low[start:end] != word
                cost = min(cost, best[start] + extra(start) + math.log10(rank * (1 + 2 * sum(bent))))
        for start in dates.get(end, ()):
            cost = min(cost, best[start] + extra(start) + math.log10(365 * 120 if end - start > 4 else 120))
        if last and low[last] != low[last - 1]:
            run = last
        if end - run >= 3:
            cost = min(cost, best[run] + extra(run) + math.log10(40 * (end - run)))
        if last and (low[last - 1], low[last]) not in _NEXT:
            walk = last
        if end - walk >= 3:
            cost = min(cost, best[walk] + extra(walk) + math.log10(50 * (end - walk)))
        for unit in range(2, min(16, end // 2) + 1):  # a unit said again, as abcabc
            if low[end - unit : end] == low[end - 2 * unit : end - unit]:
                cost = min(cost, best[end - unit] + math.log10(2))
        best[end] = cost
    return best[n]


def judged(value: str, min_cost: float) -> tuple[float, bool]:
    """A value's guess cost, and whether it is a secret."""
    if MAIL.fullmatch(value):
        return 0.0, False
    if PATH.fullmatch(value):
        parts = [judged(p, min_cost) for p in PARTS.split(value) if p]
        return max((c for c, _ in parts), default=0.0), any(hit for _, hit in parts)
    cost = guess_cost(value)
    least = PROSE * sum(map(str.isalpha, value)) + sum(map(str.isdigit, value)) if WORDS.fullmatch(value) else 0.0
    return cost, len(value) >= 6 and cost >= max(min_cost, least)


def base_spans(text: str, hinted: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    out = []
    if hinted:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def spans_of(text: str, min_cost: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Base spans, all spans, and the largest guess cost seen."""
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    base = base_spans(text, hinted)
    added, most = [], 0.0
    if hinted:
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".,;:!?)]}>")
            cost, secret = judged(value, min_cost)
            most = max(most, cost)
            if secret:
                added.append((m.start(1), 3, m.start(1) + len(value)))
    return base, sorted(base + added), most


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(min_cost: float):
    def run(texts: list[bytes]) -> dict:
        out = {"n_assign": [], "n_access": [], "n_hex": [], "n_guess": [], "base_sha256": [], "spans": [], "max_cost": []}
        for t in texts:
            base, spans, most = spans_of(t.decode("utf-8", "replace"), min_cost)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(x[1] == k for x in base))
            out["n_guess"].append(len(spans) - len(base))
            out["base_sha256"].append(hashlib.sha256(_said(base).encode()).hexdigest())
            out["spans"].append(_said(spans))
            out["max_cost"].append(most)
        types = {"base_sha256": pa.string(), "spans": pa.string(), "max_cost": pa.float64()}
        return {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}

    return run


SCAN = "n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, max_cost double"


def scan(docs: DataFrame, text: str = "text", min_cost: float = 8.0, doc_id: str = "doc_id") -> DataFrame:
    """One row a document: its id, counts by kind, spans, and the largest guess cost seen."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.select("doc_id", text_struct(lambda: _scan(min_cost), SCAN)("text").alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", min_cost: float = 8.0) -> DataFrame:
    """docs with every span, overlapping ones merged, replaced by the mark; `n_chars` follows if there is one. A null text stays null."""

    def make():
        def run(texts: list[bytes]) -> dict:
            out = []
            for t in texts:
                s = t.decode("utf-8", "replace")
                parts, at = [], 0
                for start, _, end in spans_of(s, min_cost)[1]:
                    if start >= at:
                        parts += [s[at:start], mark]
                    at = max(at, end)
                out.append("".join(parts) + s[at:])
            return {"text": pa.array(out, pa.string())}

        return run

    name = free_name(docs, "redacted")
    clean = docs.withColumn(name, text_struct(make, "text string")(F.col(text)))
    new = F.when(F.col(text).isNull(), F.lit(None).cast("string")).otherwise(F.col(f"{name}.text"))
    cols = {text: new} | ({"n_chars": F.when(F.col(text).isNull() | F.col("n_chars").isNull(), F.col("n_chars")).otherwise(F.length(F.col(f"{name}.text")).cast(docs.schema["n_chars"].dataType))} if "n_chars" in docs.columns else {})
    return clean.select(*[cols[c].alias(c) if c in cols else F.col(f"`{c}`") for c in docs.columns])
