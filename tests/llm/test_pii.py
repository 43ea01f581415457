"""Personal data: base spans against the plain patterns, the field against all segmentations, planted spans."""

import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from signalspark.llm import pii, queries

SCHEMA = "doc_id long, text string, base string, spans string, field string"


def _plain(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        even = sum(int(c) for c in d[-1::-2]) + sum(sum(map(int, str(2 * int(c)))) for c in d[-2::-2])
        out += [(2, *m.span())] if 13 <= len(d) <= 19 and even % 10 == 0 else []
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub(r"\D", "", m[0])) <= 15]


def test_base_equals_plain_patterns():
    rng = random.Random(2)
    pieces = ["a@b.co", "@", "..", "1.2.3.4", "256", "0255", ".", "+1 (555) 010-0000", "+", " ", "-", "4539578763621486", "4539 5787-6362 1486", "x", "é", "\n", "%", "9" * 12, "(", ")", "1", "b-", "co"]
    for n in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == _plain(text), text
    for long in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "+" * 200_000, "1.1." * 60_000, "(1 " * 60_000):  # linear, not quadratic
        pii.base_spans(long)
        pii.regions(long)


def _paths(lattice):
    """All segmentations, as lists of segments."""
    def grow(at):
        if at == len(lattice.tokens):
            yield []
        else:
            yield from grow(at + 1)
            for c, (i, j, _) in enumerate(lattice.segments):
                if i == at:
                    yield from ([c, *rest] for rest in grow(j))
    return list(grow(0))


@pytest.mark.parametrize("text", ["+1 (2 34-5678) 9", "a.b@c.d 1234567", "12 34 56 789 12 345678", "1.2.3.4 5.6.7.8"])
def test_dynamic_program_equals_all_segmentations(text):
    rng = np.random.default_rng(len(text))
    lattice = pii.Lattice(text, 0, len(text), {}, grow=True)
    scores, between = rng.normal(size=len(lattice.segments)).tolist(), rng.normal(size=(5, 4))

    def score(path):
        total, last = 0.0, (0, 4)
        for c in path:
            i, j, k = lattice.segments[c]
            total += scores[c] + between[last[1] if last[0] == i else 4, k]
            last = (j, k)
        return total
    paths = _paths(lattice)
    assert len(paths) > 3 and len(lattice.segments) > 1
    best = max(paths, key=score)
    assert math.isclose(score(lattice.decode(scores, between)), score(best))
    likely, moves = lattice.marginals(scores, between)
    weigh = {c: 0.0 for c in range(len(scores))}
    total = sum(math.exp(score(p)) for p in paths)
    for p, c in itertools.chain.from_iterable([(p, c) for c in p] for p in paths):
        weigh[c] += math.exp(score(p)) / total
    assert np.allclose(likely, list(weigh.values())) and math.isclose(moves.sum(), likely.sum())


def _luhn(rng):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(d + c for c in "0123456789" if pii.luhn(d + c))


def _texts(n):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    said = lambda k: " ".join(word() for _ in range(k))
    phone = lambda: f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"
    ip = lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4))
    rows, swallowed = [], {}
    for i in range(n):
        kind = i % 8
        one = [phone(), ip(), _luhn(rng), f"{word()}.{rng.randint(1, 99)}@mail.example.com", f"{rng.randint(10**15, 10**16 - 1)}", said(2), f"{rng.randint(1, 31)}-{rng.randint(1, 12)}-2024", ""][kind]
        if i % 40 == 0:
            first, second = phone(), _luhn(rng)
            one, swallowed[i] = f"{first} {second}", (first, second)
        rows.append((i, f"{said(5)} {one} {said(5)}", "b", "s", "f"))
    return rows, swallowed


def test_field_finds_what_patterns_swallow(spark):
    rows, swallowed = _texts(1600)
    odd = [(5000, None), (5001, ""), (5002, "a@b.co " * 9000), (5003, "+1 (555) 010-0000"), (None, "1.2.3.4"), (5003, "+1 (555) 010-0000"), (5004, "7 " * 3000)]
    df = spark.createDataFrame([*rows, *((i, t, "b", "s", "f") for i, t in odd)], SCHEMA).repartition(4)
    got = pii.find_pii(df, masked=True).collect()
    assert len(got) == len(rows) + len(odd)
    texts = {i: t for i, t, *_ in rows}
    hit = wrong = 0
    for r in got:
        text = texts.get(r.doc_id) or dict(odd).get(r.doc_id) or ""
        sure = _plain(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, _, _ in sure) for n in range(4))
        assert r.base == ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in sorted(sure)) and set(filter(None, r.base.split(","))) <= set(filter(None, r.spans.split(",")))
        more = {text[int(s):int(e)] for _, s, e in (x.split(":") for x in set(r.spans.split(",")) - set(r.base.split(",")) if x)}
        hit += len(more & set(swallowed.get(r.doc_id, ())))
        wrong += len(more - set(swallowed.get(r.doc_id, ())))
    assert hit >= 1.8 * len(swallowed) and wrong == 0
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by_id[5000].masked is None and by_id[5000].spans == "" and by_id[5003].masked == "<phone>" and by_id[40].masked.count("<") == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find_pii(empty).count() == 0
    alone = pii.find_pii(spark.createDataFrame([(1, "no number here", "b", "s", "f")], SCHEMA)).first()
    assert alone.spans == "" and alone.n_phone == 0


def test_query(spark):
    rows = queries.op13_pii(spark, "/root/testdata/sf0.001").collect()
    assert all(r.base_sha256 != hashlib.sha256(b"").hexdigest() for r in rows if r.n_email + r.n_ip + r.n_card + r.n_phone)
