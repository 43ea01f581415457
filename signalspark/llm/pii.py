"""Personal data by a semi-Markov conditional random field.

Base patterns give sure spans. Where they leave numbers or an at-sign over (a match that swallows
its neighbour and so fails, say), a field over segments decides: features of the whole span score
every candidate, and a dynamic program over segments of bounded length chooses boundaries and
types jointly. Its weights are fitted on regions that the base patterns label.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalspark.llm.common import chunks
from signalspark.session import ship_package

# Kinds in the order in which spans are told, and their base patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
# a match can't begin inside a run of digits that fails as a whole, and giving digits back never helps
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

#: Texts (by hash) that training reads about, regions of each class that it takes at most.
TRAIN_TEXTS, TRAIN_REGIONS = 40_000, 400
#: Tokens of an entity at most; posterior probability that a learned span needs.
MAX_TOKENS, SURE = 40, 0.9
EPOCHS, RATE, DECAY = 6, 0.3, 1e-3
#: Characters around a span that its features see.
CONTEXT = 16

_NUMBERS, _ADDRESS_RUN = re.compile(r"[0-9+(][0-9\x20().+-]*"), re.compile(r"[A-Za-z0-9._%+@-]*")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_NUMERIC, _ADDRESS = set("0123456789 ().+-"), re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[A-Za-z]+")

Span = tuple[int, int, int]  # kind, start, end in code points, end exclusive


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the e-mail pattern, found from their at-signs: a local part holds none, so the
    leftmost match of an at-sign starts where its run of local characters (or the rest of it) does."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _matches(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, holds) of all matches of the base patterns, failing ones too."""
    for s, e in _emails(text):
        yield 0, s, e, True
    for m in _IP.finditer(text):
        yield 1, *m.span(), all(map(_octet, m[0].split(".")))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        yield 2, *m.span(), CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)
    for m in _PHONE.finditer(text):
        yield 3, *m.span(), PHONE_DIGITS[0] <= sum(map(len, _DIGITS.findall(m[0]))) <= PHONE_DIGITS[1]


def base_spans(text: str) -> list[Span]:
    """Spans that the base patterns are sure of, by kind, then start."""
    return [(k, s, e) for k, s, e, holds in _matches(text) if holds]


def regions(text: str) -> list[tuple[int, int]]:
    """Runs of characters that an entity beyond letters can hold, overlapping ones joined.

    Every entity holds a digit or an at-sign and lies inside one run, so outside of them the best
    segmentation is none, and the regions can be decoded one by one."""
    runs, at = [m.span() for m in _NUMBERS.finditer(text)], text.find("@")
    while at >= 0:
        end = _ADDRESS_RUN.match(text, at).end()
        start = at
        while start > 0 and _LOCAL.match(text, start - 1):
            start -= 1
        runs.append((start, end))
        at = text.find("@", end)
    joined: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if joined and s <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(e, joined[-1][1]))
        else:
            joined.append((s, e))
    return joined


def _open(piece: str) -> bool:
    """Whether a piece can hold an entity at all."""
    digits = sum(map(len, _DIGITS.findall(piece)))
    return "@" in piece or digits >= 7 or (digits >= 4 and piece.count(".") >= 3)


def _side(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "d" if c in "0123456789" else "a" if c.isalpha() else "s" if c.isspace() else c


def _features(kind: int, span: str, before: str, after: str) -> list[str]:
    """Features of a whole span as one kind, with the text around it."""
    parts = _DIGITS.findall(span)
    digits = "".join(parts)
    rough = _LETTERS.sub("a", _DIGITS.sub("d", span))
    exact = rough if kind == 0 else _DIGITS.sub(lambda m: f"d{len(m[0])}", span)
    sound = (_DOMAIN.fullmatch(span.rpartition("@")[2]) is not None if kind == 0 else all(map(_octet, parts)) if kind == 1
             else luhn(digits) and CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] if kind == 2 else PHONE_DIGITS[0] <= len(digits) <= PHONE_DIGITS[1])
    word = _LETTERS.findall(before[-CONTEXT:])
    told = ["", f"exact {exact}" if kind else "", f"rough {rough}", f"digits {min(len(digits), 20) if kind else min(len(digits), 1)}", f"sound {sound}",
            f"first {_side(span, 0)}", f"left {_side(before, len(before) - 1)}", f"right {_side(after, 0)}",
            f"sides {_side(before, len(before) - 1)} {_side(after, 0)}", f"word {word[-1].lower() if word else ''}"]
    return [f"{kind} {f}" for f in told]


def _kinds(span: str, digits: int) -> list[int]:
    """Kinds that a span can be at all, by its alphabet and its number of digits."""
    out = []
    if _NUMERIC.issuperset(span) and span[-1] in "0123456789":
        dots = span.count(".")
        if dots == 3 and len(_DIGITS.findall(span)) == 4 and not set(span) & set(" ()+-") and digits <= 12:
            out.append(1)
        if 12 <= digits <= 19 and span[0] in "0123456789" and not set(span) & set("().+"):
            out.append(2)
        if 7 <= digits <= 15:
            out.append(3)
    return out


def candidates(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """Tokens of a piece of text, and its candidate segments (first token, token after the last, kind)."""
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    out = []
    for i, (s, _) in enumerate(tokens):
        if text[s] in "0123456789+(":
            digits = 0
            for j in range(i, min(i + MAX_TOKENS, len(tokens))):
                a, b = tokens[j]
                if text[a] not in _NUMERIC:
                    break
                if text[a] in "0123456789":
                    digits += b - a
                    if digits > 19:
                        break
                    out += [(i, j + 1, k) for k in _kinds(text[s:b], digits)]
        if text[s] != "@":
            sign = text.find("@", s, tokens[min(i + MAX_TOKENS, len(tokens)) - 1][1])
            if sign > 0 and _ADDRESS.match(text[s:sign]):
                for j in range(i + 1, min(i + MAX_TOKENS, len(tokens))):
                    a, b = tokens[j]
                    if a > sign:
                        if not (text[a].isascii() and text[a].isalnum()) and text[a] not in "._%+-":
                            break
                        if text[a].isascii() and text[a].isalnum():
                            out.append((i, j + 1, 0))
    return tokens, out


class Lattice:
    """Candidate segments of one piece with their features, to score, sum over and decode.

    A path goes from token to token by single tokens outside of entities (score 0) and by
    candidates; the kind of the segment before (or none) scores too, as a transition."""

    def __init__(self, text: str, start: int, end: int, index: dict[str, int], grow: bool = False):
        self.tokens, self.segments = candidates(text, start, end)
        put = (lambda f: index.setdefault(f, len(index))) if grow else index.get
        self.features, self.ending = [], [[] for _ in range(len(self.tokens) + 1)]
        for c, (i, j, k) in enumerate(self.segments):
            s, e = self.tokens[i][0], self.tokens[j - 1][1]
            found = _features(k, text[s:e], text[max(0, s - CONTEXT):s], text[e:e + 1])
            self.features.append([f for f in map(put, found) if f is not None])
            self.ending[j].append(c)

    def spans(self) -> list[Span]:
        return [(k, self.tokens[i][0], self.tokens[j - 1][1]) for i, j, k in self.segments]

    def scores(self, weights: np.ndarray) -> list[float]:
        return [float(weights[f].sum()) for f in self.features]

    def marginals(self, scores: list[float], between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of every segment and expected transitions (by forward and backward sums)."""
        n, none = len(self.tokens), len(KINDS)
        ahead = np.full((n + 1, none + 1), -np.inf)
        ahead[0, none] = 0.0
        for p in range(1, n + 1):
            ahead[p, none] = np.logaddexp.reduce(ahead[p - 1])
            for c in self.ending[p]:
                i, _, k = self.segments[c]
                ahead[p, k] = np.logaddexp(ahead[p, k], scores[c] + np.logaddexp.reduce(ahead[i] + between[:, k]))
        back = np.full((n + 1, none + 1), -np.inf)
        back[n] = 0.0
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (i, _, _) in enumerate(self.segments):
            starting[i].append(c)
        for p in range(n - 1, -1, -1):
            back[p] = back[p + 1, none]
            for c in starting[p]:
                _, j, k = self.segments[c]
                back[p] = np.logaddexp(back[p], between[:, k] + scores[c] + back[j, k])
        total = np.logaddexp.reduce(ahead[n])
        likely, moves = np.zeros(len(self.segments)), np.zeros_like(between)
        for c, (i, j, k) in enumerate(self.segments):
            each = np.exp(ahead[i] + between[:, k] + scores[c] + back[j, k] - total)
            likely[c] = each.sum()
            moves[:, k] += each
        return likely, moves

    def decode(self, scores: list[float], between: np.ndarray) -> list[int]:
        """Segments of the best path."""
        n, none = len(self.tokens), len(KINDS)
        best = np.full((n + 1, none + 1), -np.inf)
        best[0, none] = 0.0
        came: dict[tuple[int, int], tuple[int, int, int]] = {}
        for p in range(1, n + 1):
            from_ = int(best[p - 1].argmax())
            best[p, none], came[p, none] = best[p - 1, from_], (p - 1, from_, -1)
            for c in self.ending[p]:
                i, _, k = self.segments[c]
                ways = best[i] + between[:, k]
                way = int(ways.argmax())
                if ways[way] + scores[c] > best[p, k]:
                    best[p, k], came[p, k] = ways[way] + scores[c], (i, way, c)
        out, at = [], (n, int(best[n].argmax()))
        while at[0] > 0:
            p, k, c = came[at]
            if c >= 0:
                out.append(c)
            at = (p, k)
        return out[::-1]


class Field:
    """Weights of span features and transitions, fitted by stochastic gradients on labelled pieces."""

    def __init__(self, pieces: Iterable[tuple[str, int, int, list[Span]]]):
        self.index: dict[str, int] = {}
        work = []
        for text, start, end, spans in pieces:
            lattice = Lattice(text, start, end, self.index, grow=True)
            where = {s: c for c, s in enumerate(lattice.spans())}
            gold = [where[s] for s in spans if s in where]
            if lattice.segments and len(gold) == len(spans):
                work.append((lattice, gold))
        self.weights, self.between = np.zeros(len(self.index)), np.zeros((len(KINDS) + 1, len(KINDS)))
        self.fitted = any(gold for _, gold in work)
        past, past_between = np.full(len(self.index), 1e-6), np.full(self.between.shape, 1e-6)
        rng = np.random.default_rng(7)
        for _ in range(EPOCHS if self.fitted else 0):
            for n in rng.permutation(len(work)):
                lattice, gold = work[n]
                likely, moves = lattice.marginals(lattice.scores(self.weights), self.between)
                slope, before = np.zeros(len(self.index)), (0, len(KINDS))
                touched = sorted({f for found in lattice.features for f in found})
                for c, found in enumerate(lattice.features):
                    slope[found] -= likely[c]
                for c in gold:
                    slope[lattice.features[c]] += 1
                    i, j, k = lattice.segments[c]
                    moves[before[1] if before[0] == i else len(KINDS), k] -= 1
                    before = (j, k)
                slope[touched] -= DECAY * self.weights[touched]
                past[touched] += slope[touched] ** 2
                self.weights[touched] += RATE * slope[touched] / np.sqrt(past[touched])
                slope_between = -moves - DECAY * self.between
                past_between += slope_between ** 2
                self.between += RATE * slope_between / np.sqrt(past_between)

    def more_spans(self, text: str, base: list[Span]) -> list[Span]:
        """Learned spans beside the base ones: entities of the best path that are sure enough."""
        if not self.fitted:
            return []
        taken = sorted((s, e) for _, s, e in base)
        out = []
        for start, end in regions(text):
            for s, e in _free(start, end, taken):
                if not _open(text[s:e]):
                    continue
                lattice = Lattice(text, s, e, self.index)
                if lattice.segments:
                    scores = lattice.scores(self.weights)
                    path = lattice.decode(scores, self.between)
                    if path:
                        likely, _ = lattice.marginals(scores, self.between)
                        spans = lattice.spans()
                        out += [spans[c] for c in path if likely[c] >= SURE]
        return out


def _free(start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Parts of start to end that no span of ``taken`` (by start) covers."""
    at = start
    for s, e in taken[max(0, bisect.bisect_left(taken, (start, start)) - len(KINDS)):]:
        if s >= end:
            break
        if e > at:
            if s > at:
                yield at, min(s, end)
            at = max(at, e)
    if at < end:
        yield at, end


def _labelled(text: str) -> Iterator[tuple[str, int, int, list[Span]]]:
    """(class, start, end, spans) of the regions of a text that the base patterns label surely.

    Not those where a number pattern fails for too many digits: it has swallowed a neighbour."""
    found = list(_matches(text))
    swallowed = sorted((s, e) for k, s, e, holds in found if not holds and k >= 2
                       and sum(map(len, _DIGITS.findall(text, s, e))) > (CARD_DIGITS, PHONE_DIGITS)[k - 2][1])
    sure = sorted(((k, s, e) for k, s, e, holds in found if holds), key=lambda x: (x[1], -x[2]))
    n = m = 0
    for start, end in regions(text):
        while n < len(sure) and sure[n][2] <= start:
            n += 1
        while m < len(swallowed) and swallowed[m][1] <= start:
            m += 1
        if m < len(swallowed) and swallowed[m][0] < end or not _open(text[start:end]):
            continue
        inside, at = [], start
        for k, s, e in sure[n:]:
            if s >= end:
                break
            if s >= at and e <= end:
                inside.append((k, s, e))
                at = e
        yield KINDS[inside[0][0]] if inside else "none", start, end, inside


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled regions of some texts, cut out with their surroundings: class, text, start, end, spans."""
    for part in chunks(batches, "text"):
        rows = []
        for text in part.column("text").to_pylist():
            for name, s, e, spans in _labelled(text or ""):
                cut = max(0, s - CONTEXT)
                told = ",".join(f"{k}:{a - cut}:{b - cut}" for k, a, b in spans)
                rows.append((name, text[cut:e + 1], s - cut, e - cut, told))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(
            zip(*rows) if rows else [()] * 5, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["class", "text", "start", "end", "spans"])


def fit(docs: DataFrame) -> Field:
    """The field of the corpus, from a bounded sample: texts whose hash falls into a share that
    gives about TRAIN_TEXTS, of their labelled regions TRAIN_REGIONS a class (least hashes first)."""
    texts = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    share = min(1.0, TRAIN_TEXTS / max(1, docs.count()))
    drawn = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    found = drawn.mapInArrow(_sample, "class string, text string, start long, end long, spans string").distinct()
    order = Window.partitionBy("class").orderBy(F.xxhash64("text", "start", "end"), "text", "start", "end")
    rows = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= TRAIN_REGIONS).drop("_n").collect()
    rows.sort(key=lambda r: (r["class"], r.text, r.start))
    return Field((r.text, r.start, r.end, [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]) for r in rows)


def _tell(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def _mask(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for k, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if e > at:
            out += [text[at:s], f"<{KINDS[k]}>"] if s >= at else []
            at = e
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch], field: Field, masked: bool) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        counts, base, spans, texts = [], [], [], []
        for text in part.column("text").to_pylist():
            sure = base_spans(text or "")
            every = sure + field.more_spans(text or "", sure)
            counts.append([sum(k == n for k, _, _ in sure) for n in range(len(KINDS))])
            base.append(_tell(sure))
            spans.append(_tell(every))
            if masked:
                texts.append(None if text is None else _mask(text, every))
        columns = [part.column("doc_id"), *(pa.array([c[n] for c in counts], pa.int64()) for n in range(len(KINDS))), pa.array(base, pa.string()), pa.array(spans, pa.string())]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(texts, pa.string())] if masked else []),
                                         ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", *(["masked"] if masked else [])])


def find_pii(docs: DataFrame, field: Field | None = None, masked: bool = False) -> DataFrame:
    """Personal data of every text: doc_id, n_email, n_ip, n_card, n_phone (base spans), base and
    spans (base and learned ones) as kind:start:end by kind, then start, joined by commas, and, if
    ``masked``, the text with each span replaced by its kind in angle brackets.

    Without a ``field`` one is fitted on the corpus (see ``fit``). Learned spans never overlap base
    ones. A null text counts as empty (its mask stays null); a row is treated by its text alone, so
    repeated rows fare alike; texts are read whole, in time linear in their length; an empty table
    gives an empty result. Other columns of ``docs`` are not read."""
    ship_package(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    field = field or fit(rows)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, {counts}, base string, spans string" + (", masked string" if masked else "")
    return rows.mapInArrow(partial(_scan, field=field, masked=masked), schema)
