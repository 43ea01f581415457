"""Secret scans by grammar inference.

Base patterns find the credentials that label themselves (a key word before, a fixed prefix, a
long hexadecimal run). A bounded sample of them, per kind, is the training set: its prefix tree
is folded into a probabilistic automaton by merging statistically compatible states (ALERGIA,
Carrasco and Oncina, 1994). A second automaton is learned from ordinary tokens. Every token of
every text is then scored by its format likelihood under each grammar against the ordinary one,
and what is a credential by far more likely, rare as credentials are, becomes a span beside the
base ones. As the ordinary sample holds unlabelled secrets too, each half of it is judged by an
automaton of the other half first, and what reads like a credential is left out.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import string
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.session import checkpoint_dir, ship_package

#: Kinds of base spans, in the order in which spans of equal start are listed; learned ones last.
KINDS = ("assign", "access", "hex", "grammar")

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
                    r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What may be a credential: a token of these characters, of at least so many (as base credentials).
MIN_TOKEN = 6
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}")

#: Credentials of a kind (distinct values), and occurrences of ordinary tokens, that training takes
#: at most (least hashes first), and characters of them; a text offers every STRIDE-th token.
SAMPLE, TRAIN_CHARS, STRIDE = 1000, 400_000, 61
#: Significance of ALERGIA's Hoeffding test.
ALPHA = 0.05
#: A token is a secret if it is one with so much probability, given how rare credentials are among
#: the corpus's tokens ...
SURE = 0.99
#: ... and its likelihood is typical of what the grammar makes: within so many standard deviations,
#: to both sides. What is more regular than any credential (digits alone under a grammar of hex
#: digits) is none.
TYPICAL = 2.58
#: Tokens per credential where no corpus was counted.
RARITY = 1000.0

# Character classes that the grammars read: digit, a-f, g-z, A-F, G-Z; a sign is its own class.
_CLASSES = str.maketrans({c: k for k, cs in (("0", string.digits), ("a", "abcdef"), ("g", string.ascii_lowercase[6:]), ("A", "ABCDEF"), ("G", string.ascii_uppercase[6:]))
                          for c in cs})


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then by kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[0], x[2]))
    return [(a, b, KINDS[k]) for a, b, k in found]


def shape(word: str) -> str:
    """The classes of a word's characters; words of one shape score alike."""
    return word.translate(_CLASSES)


def learn(sample: list[str], alpha: float = ALPHA) -> tuple[list[dict], list[float]]:
    """ALERGIA: (transitions, end probabilities) of the automaton of a sample. A state maps a
    symbol to (next state, probability). Equal samples give equal automata."""
    kids: list[dict[str, int]] = [{}]
    arrive, stop = [0], [0]
    for word in sorted(sample):
        s = 0
        arrive[0] += 1
        for c in shape(word):
            if c not in kids[s]:
                kids[s][c] = len(kids)
                kids.append({})
                arrive.append(0)
                stop.append(0)
            s = kids[s][c]
            arrive[s] += 1
        stop[s] += 1
    flow = [{c: arrive[t] for c, t in k.items()} for k in kids]
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > bound * (n1 ** -0.5 + n2 ** -0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            if differ(stop[x], arrive[x], stop[y], arrive[y]):
                return False
            for c in set(kids[x]) | set(kids[y]):
                if differ(flow[x].get(c, 0), arrive[x], flow[y].get(c, 0), arrive[y]):
                    return False
                if c in kids[x] and c in kids[y]:
                    todo.append((kids[x][c], kids[y][c]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            arrive[x] += arrive[y]
            stop[x] += stop[y]
            for c, t in kids[y].items():
                flow[x][c] = flow[x].get(c, 0) + flow[y][c]
                if c in kids[x]:
                    todo.append((kids[x][c], t))
                else:
                    kids[x][c] = t

    red, blue = [0], [(0, c) for c in sorted(kids[0])]
    while blue:
        src, c = blue.pop(0)
        b = kids[src][c]
        if b in red:
            continue
        for r in red:
            if compatible(r, b):
                kids[src][c] = r
                fold(r, b)
                break
        else:
            red.append(b)
        blue = [(r, s) for r in red for s in sorted(kids[r]) if kids[r][s] not in red]
    number = {r: i for i, r in enumerate(red)}
    states, ends = [], []
    for r in red:
        total = arrive[r] + 0.5 * 8  # unseen symbols keep some mass
        states.append({c: (number[t], (flow[r][c] + 0.5) / total) for c, t in kids[r].items()})
        ends.append((stop[r] + 0.5) / total)
    return states, ends


def score(grammar: tuple[list[dict], list[float]], word: str) -> float:
    """Log likelihood per character, its end counting as one; a step that the grammar lacks costs as much as e ** -6 and
    leads back to its start."""
    states, ends = grammar
    s, total = 0, 0.0
    for c in shape(word):
        to, p = states[s].get(c, (0, 0.0025))
        total += math.log(p)
        s = to
    return (total + math.log(ends[s])) / (len(word) + 1)


def strangeness(grammar: tuple[list[dict], list[float]], word: str) -> float:
    """How many standard deviations the log likelihood of a word's characters lies off what the
    states on its way make on average, steps of under 1 % aside; one that the grammar lacks counts
    as in ``score``."""
    states, _ = grammar
    s, off, spread = 0, 0.0, 1e-9
    for c in shape(word):
        ways = [p for _, p in states[s].values() if p >= 0.01]
        mean = sum(p * math.log(p) for p in ways) / max(sum(ways), 1e-9)
        spread += sum(p * (math.log(p) - mean) ** 2 for p in ways) / max(sum(ways), 1e-9)
        to, p = states[s].get(c, (0, 0.0025))
        off += math.log(p) - mean
        s = to
    return off / math.sqrt(spread) if abs(off) > 1e-6 else 0.0


def _bounded(words: list[str]) -> list[str]:
    """Words up to TRAIN_CHARS characters in all, whole ones."""
    out, n = [], 0
    for w in words:
        n += len(w)
        if n > TRAIN_CHARS and out:
            break
        out.append(w)
    return out


class Grammars:
    """An automaton for each kind of credential and one for ordinary tokens.

    ``samples``: words by kind, ``ordinary`` the occurrences of other tokens. ``rarity``: tokens per
    credential in the corpus."""

    def __init__(self, samples: dict[str, list[str]], rarity: float = RARITY):
        self.evidence = math.log(max(rarity, 1.0)) + math.log(SURE / (1 - SURE))
        self.kinds = {}
        for kind in sorted(set(samples) - {"ordinary"}):
            words = _bounded([w for w in samples[kind] if len(w) >= MIN_TOKEN])
            if len(words) >= 20:
                self.kinds[kind] = learn(words)
        ordinary = _bounded(samples.get("ordinary", [])) or ["word"]
        for _ in range(2):
            halves = ordinary[::2], ordinary[1::2]
            grammars = [learn(half or ["word"]) for half in halves]
            ordinary = [w for n, half in enumerate(halves) for w in half if not self.reads(w, grammars[1 - n])] or ["word"]
        self.ordinary = learn(ordinary)

    def reads(self, word: str, plain: tuple[list[dict], list[float]]) -> bool:
        """Whether a word reads like a credential of some kind rather than by the grammar ``plain``."""
        usual = score(plain, word)
        return any((score(g, word) - usual) * (len(word) + 1) >= self.evidence and abs(strangeness(g, word)) <= TYPICAL for g in self.kinds.values())

    def secret(self, word: str) -> bool:
        return self.reads(word, self.ordinary)


def _hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=7).digest(), "big")


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to SAMPLE values of each kind that a task sees, those of the least hashes: distinct
    credentials, occurrences of ordinary tokens; and how many of both there are (h null)."""
    heaps: dict[str, list] = defaultdict(list)
    held: dict[str, set] = defaultdict(set)
    seen = Counter()

    def offer(kind: str, word: str, h: int) -> None:
        item = (-h, word)
        if item in held[kind]:
            return
        if len(heaps[kind]) < SAMPLE:
            heapq.heappush(heaps[kind], item)
            held[kind].add(item)
        elif item > heaps[kind][0]:
            held[kind].add(item)
            held[kind].discard(heapq.heapreplace(heaps[kind], item))

    for batch in batches:
        for text in batch.column("text").to_pylist():
            text = text or ""
            spans = base_spans(text)
            for a, b, kind in spans:
                word = text[a:b]
                word = ASSIGN.match(word)[2] if kind == "assign" else word
                offer(kind, word, _hash(word))
            words = _free(text, spans) if spans else TOKEN.findall(text)
            seen.update({"credentials": len(spans), "tokens": len(words)})
            seed = zlib.crc32(text.encode())
            for n in range(seed % STRIDE, len(words), STRIDE):
                word = words[n][2] if spans else words[n]
                offer("ordinary", word, zlib.crc32(word.encode(), seed + n & 0xFFFFFFFF))
    rows = [(k, w, -h) for k, heap in heaps.items() for h, w in heap] + [(k, str(n), None) for k, n in seen.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in
                                      enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "word", "h"])


def _free(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, token) of the tokens that no base span touches; both go by start."""
    out, at, far = [], 0, 0
    for m in TOKEN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            far, at = max(far, spans[at][1]), at + 1
        if far <= m.start():
            out.append((m.start(), m.end(), m[0]))
    return out


def _scan(batches: Iterator[pa.RecordBatch], grammars: Grammars) -> Iterator[pa.RecordBatch]:
    known: dict[str, bool] = {}

    def secret(word: str) -> bool:
        form = shape(word)
        if form not in known:
            if len(known) > 200_000:
                known.clear()
            known[form] = grammars.secret(word)
        return known[form]

    for batch in batches:
        cols: list[list] = [[], [], [], [], []]
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            # most texts hold no token of a credential's shape
            some = grammars.kinds and any(map(secret, set(TOKEN.findall(text))))
            more = [(a, b, "grammar") for a, b, word in _free(text, base) if secret(word)] if some else []
            n = Counter(k for _, _, k in base)
            said = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
            every = ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]))))
            for col, v in zip(cols, (n["assign"], n["access"], n["hex"], hashlib.sha256(said.encode()).hexdigest(), every), strict=True):
                col.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))],
                                         ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def train(texts: DataFrame) -> Grammars:
    """Grammars from a bounded sample: per kind the SAMPLE values of the least hashes; how rare
    credentials are is counted over all tokens."""
    found = texts.select("text").mapInArrow(_samples, "kind string, word string, h long").checkpoint()
    counts = {r.kind: r.n for r in found.where("h is null").groupBy("kind").agg(F.sum(F.col("word").cast("long")).alias("n")).collect()}
    w = Window.partitionBy("kind").orderBy("h", "word")
    rows = (found.where("h is not null").distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= SAMPLE)
            .select("kind", "word", "rank").collect())
    samples: dict[str, list[str]] = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.kind, r["rank"])):
        samples[r.kind].append(r.word)
    return Grammars(samples, counts.get("tokens", 0) / max(counts.get("credentials", 0), 1))


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_assign, n_access, n_hex, base_sha256, spans).

    spans lists kind:start:end, comma-joined, by start and then by kind (KINDS order): all base
    spans, and as kind ``grammar`` the tokens outside them that a learned grammar accepts.
    Offsets count code points, the end is exclusive. A null or empty text has no span. With
    fewer than 20 credentials of a kind, no grammar of that kind is learned. Repeated rows
    stay rows of their own; other columns are ignored; an empty table gives an empty result.
    Two passes over whole texts, no shuffle but that of the bounded samples."""
    checkpoint_dir(docs.sparkSession)
    ship_package(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(partial(_scan, grammars=train(texts)),
                            f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
