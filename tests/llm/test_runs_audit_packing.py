"""Periodic runs, the filter audit and best-fit packing against plain versions."""

import bisect
import hashlib
import random
import struct
import zlib
from fractions import Fraction
from itertools import permutations

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from latewise.llm import audit, packing, periodic

from .conftest import ROWS

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# -- periodic runs ---------------------------------------------------------------------

def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def texts_with_runs(r, sizes, n_lists):
    out = []
    for _ in range(n_lists):
        n, v = r.choice(sizes), r.choice([1, 2, 3, 50, 5000])
        w = [b"%d" % r.randrange(v) for _ in range(n)]
        for _ in range(r.randint(0, 3)):
            if n > 30:
                a = r.randrange(n)
                p = r.randint(1, max(1, (n - a) // 3))
                for i in range(a + p, a + min(n - a, p * r.randint(2, 8) + r.randint(0, p))):
                    w[i] = w[i - p]
        out.append(w)
        if r.random() < 0.2:
            out.append(list(w))
    return out


@pytest.mark.parametrize("block", [8, 16, 512])
def test_runs_equal_brute_force(block, monkeypatch):
    """Short and long periods, nested and neighbouring runs, equal texts side by side; small
    blocks stand for the larger scales of very long texts."""
    monkeypatch.setattr(periodic, "BLOCK", block)
    r, finder, seen = random.Random(block), periodic.Finder(), 0
    for _ in range(12):
        lists = texts_with_runs(r, [0, 1, 5, 23, 24, 25, 60, 100, 300, 900], 14)
        got = finder(lists)
        for w, g in zip(lists, got, strict=True):
            assert [tuple(x) for x in g.tolist()] == plain_runs(w)
            seen += len(g)
    assert seen > 40


def test_runs_at_the_limits():
    """24 words, three periods, and one word less of each; neighbouring runs that overlap."""
    w = lambda s: [c.encode() for c in s]
    other = [b"%d" % i for i in range(1000)]
    lists = [w("a" * 24), w("a" * 23), other[:8] * 3, other[:8] * 2 + other[:7], other[:200] * 3, (other[:200] * 3)[:-1],
             w("ab" * 20) + w("cb" * 20), w("ab" * 12) + other + w("ba" * 12), w("aab" * 9) + w("aab" * 9)]
    got = [[tuple(x) for x in g.tolist()] for g in periodic.Finder()(lists)]
    assert got == [plain_runs(x) for x in lists]
    assert got[0] == [(0, 24, 1)] and got[1] == [] and got[2] == [(0, 24, 8)] and got[3] == [] and got[4] == [(0, 600, 200)] and got[5] == []


def test_transform_is_exact():
    import numpy as np
    rng = np.random.default_rng(0)
    for n in (16, 64, 1024):
        x = rng.integers(0, periodic.P, (3, n)).astype(float)
        root = pow(3, (periodic.P - 1) // n, periodic.P)
        want = [[sum(int(v) * pow(root, i * k, periodic.P) for i, v in enumerate(row)) % periodic.P for k in range(n)] for row in x[:1]]
        y = periodic.Transform(n)(x.copy())
        assert y[0].astype(int).tolist() == want[0]
        assert ((periodic.Transform(n, inverse=True)(y) * pow(n, -1, periodic.P)) % periodic.P == x).all()


def plain_op11(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], sha("".join("%d,%d,%d\n" % x for x in found).encode()), sha(b" ".join(kept)))


def test_op11_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in periodic.op11_periodic_runs(spark, SF).collect())
    short = {r[0] for r in docs if len((r[1] or "").split()) < 3000}
    assert [g for g in got if g[0] in short] == sorted(plain_op11(*r) for r in docs if r[0] in short) and len(got) == len(docs)
    assert sum(g[1] for g in got) > len(docs) / 12


def test_runs_odd_rows(odd, empty):
    got = periodic.periodic_runs(odd).collect()
    assert periodic.periodic_runs(empty).count() == 0
    assert sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in got), key=str) == \
        sorted(((i, plain_runs((t or "").encode().split()) if i != 8 else []) for i, t, *_ in ROWS), key=str)
    assert all(r.collapsed == " ".join((t or "").encode().split() and [x.decode() for x in (t or "").encode().split()])
               for r in got for i, t, *_ in ROWS if i == r.doc_id and not r.runs and i is not None)


# -- filter audit ----------------------------------------------------------------------

def plain_audit(rows, labels):
    import re
    texts = [(i, p or "", t or "") for i, t, p in rows]
    least = {}
    for i, _, t in texts:
        if i is not None:
            least[t] = min(i, least.get(t, i))
    good, toxic = ({x[0] for x in labels if x[0] is not None and x[k] == 1} for k in (1, 2))
    docs = []
    for i, p, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                 bool(re.search("[#$%&*|]", t)), i is not None and least[t] < i]
        docs.append((p, {f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    out = []
    for part in {d[0] for d in docs}:
        mine, steps, total = [d for d in docs if d[0] == part], [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in mine if f in d[1]]
                total[f] += len(here)
                steps.append((part, "".join(order), step, len(left), len(here), len(failing) - len(here),
                              sum(d[1] == {f} for d in mine), sum(d[2] for d in here), sum(d[3] for d in here)))
        out += [(*s, total[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def test_audit_odd_rows(spark, odd, empty, labels):
    more = [(30 + i, "Same words again", "en", None) for i in range(40)] + [(90, "A B C D #", None, None), (91, "A B C D #", "", None), (None, "Same words again", "en", None)]
    docs = odd.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    plain = [(r[0], r[1], r[2]) for r in [*ROWS, *more]]
    marks = [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in audit.audit(docs, labels).collect()) == plain_audit(plain, marks)
    assert audit.audit(empty, labels).count() == 0
    assert {r.good_lost + r.toxic_lost for r in audit.audit(odd, labels.limit(0)).collect()} == {0}


def test_shapley_of_a_known_game():
    # three players: 1 and 2 remove the same ten, 3 another four
    game = [0, 10, 10, 10, 4, 14, 14, 14]
    assert audit.shapley(game) == [5, 5, 4]
    assert audit.shapley([0, 1, 0, 1, 0, 1, 0, 2]) == [Fraction(4, 3), Fraction(1, 3), Fraction(1, 3)]


# -- packing ---------------------------------------------------------------------------

def plain_best_fit(lengths, size):
    """The rooms that best-fit decreasing leaves, piece by piece."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else size
        bisect.insort(rooms, room - n)
    return rooms


def test_plan_is_best_fit_decreasing():
    r = random.Random(2)
    for size, n in ((10, 50), (64, 3000), (64, 40), (100, 1000), (2048, 4000), (7, 1000), (1, 5)):
        for shape in (lambda: r.randint(1, size), lambda: min(size, 1 + int(r.expovariate(4 / size))), lambda: r.choice([size, 1, (size + 1) // 2, max(1, size // 3)])):
            lengths = [shape() for _ in range(n)]
            counts = {x: lengths.count(x) for x in set(lengths)}
            plan = packing.best_fit(counts, size)
            keys, fill = plan[:, 0].tolist(), {}
            for length, m in counts.items():
                for rank in range(m):
                    at = bisect.bisect_right(keys, length * packing.RANKS + rank) - 1
                    key, first, each, room = plan[at].tolist()
                    j = rank - key % packing.RANKS
                    fill.setdefault(first + j // each, []).append((size - room + j % each * length, length))
            for parts in fill.values():
                parts.sort()
                assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
            assert sorted(size - sum(n for _, n in p) for p in fill.values()) == plain_best_fit(lengths, size)
            assert sorted(fill) == list(range(len(fill)))


def test_capacities_find_the_tightest():
    r, tree, rooms = random.Random(4), packing.Capacities(100), []
    for _ in range(2000):
        if r.random() < 0.55 or not rooms:
            room = r.randint(1, 100)
            tree.add(room, 0, 1)
            bisect.insort(rooms, room)
        else:
            need = r.randint(1, 100)
            at = bisect.bisect_left(rooms, need)
            got = tree.tightest(need)
            assert got == (rooms[at] if at < len(rooms) else None)
            if got:
                tree.take(got)
                rooms.pop(at)


def check_packed(rows, packed, size):
    tok = Tokenizer.from_file(TOKENIZER)
    tok.no_truncation(), tok.no_padding()
    want = []
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want += [(i, k // size, k, len(ids[k:k + size]), struct.pack(f"<{len(ids[k:k + size])}I", *ids[k:k + size])) for k in range(0, len(ids), size)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in packed), key=str) == sorted(want, key=str)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) <= size
    assert len(bins) == len(plain_best_fit([w[3] for w in want], size))
    return bins


def test_packing_odd_rows(spark, odd, empty):
    rows = [(r[0], r[1]) for r in ROWS] + [(70, "<|endoftext|> a<|startoftext|>b  it's 1234 <|endoftext"), (71, "x\x1cy\x85z\xa0w　v i̇ É é ́a")]
    docs = odd.unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string"), allowMissingColumns=True)
    for size in (64, 2048):
        packed = packing.pack(docs, TOKENIZER, size)
        got = packed.collect()
        bins = check_packed(rows, got, size)
        joined = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
        assert {k: len(v) // 4 for k, v in joined.items()} == {k: sum(n for _, n in p) for k, p in bins.items()}
        assert all(joined[r.sequence_id][4 * r.offset:][:4 * r.length] == bytes(r.ids) for r in got)
    assert packing.pack(empty, TOKENIZER, 64).count() == 0


def test_op13_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = packing.op13_best_fit(spark, SF)
    packed = packing.pack(docs, TOKENIZER, 2048)
    check_packed([tuple(r) for r in docs.collect()], packed.collect(), 2048)
    digest = packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    assert sorted(tuple(r) for r in got.drop("sequence_id", "offset").collect()) == sorted(tuple(r) for r in digest.collect())
    assert got.agg(F.countDistinct("sequence_id")).first()[0] == packed.agg(F.countDistinct("sequence_id")).first()[0]
