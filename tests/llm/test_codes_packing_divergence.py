"""Vector codes, packing and the divergence audit against plain code, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from memloom.llm import codebooks, divergence, packing

# Vector codes


def coded_plainly(rows, rounds=6):
    """Codes, errors and the digest of rows of (vec_id, whole-number vector)."""
    size = len(rows[0][1]) // 8
    parts = lambda v: [v[k * size : (k + 1) * size] for k in range(8)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[parts(v)[k] for _, v in sorted(rows)[:16]] for k in range(8)]
    nearest = lambda book, p: min((distance(p, e), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k, book in enumerate(books):
            groups = defaultdict(list)
            for _, v in rows:
                groups[nearest(book, parts(v)[k])[1]].append(parts(v)[k])
            for j, own in groups.items():
                book[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = {}
    for i, v in rows:
        best = [nearest(book, p) for book, p in zip(books, parts(v), strict=True)]
        found[i] = ("".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best))
    return found, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, vector string, total string")


@pytest.mark.parametrize("spread", [1, 3, 40])
def test_codes_equal_plain_code(spark, spread):
    """Components from few values, so that many distances are equal."""
    rng = random.Random(spread)
    rows = [(i, [rng.randint(-spread, spread) / 4096 for _ in range(24)], rng.choice([None, 1, 2]), "a", "b") for i in range(300)]
    got = codebooks.compress(vectors_of(spark, rows)).collect()
    want, digest = coded_plainly([(i, [round(4096 * x) for x in v]) for i, v, *_ in rows])
    assert {r["vec_id"]: (r["code"], r["error"]) for r in got} == want
    assert {r["codebooks_sha256"] for r in got} == {digest}
    by_label = Counter()
    for i, _, label, *_ in rows:
        by_label[label] += want[i][1]
    assert all(r["label_error"] == by_label[r["label"]] for r in got)


def test_tree_finds_the_lowest_of_equals():
    rng = np.random.default_rng(3)
    for _ in range(40):
        entries = rng.integers(-2, 3, (rng.integers(1, 17), 3))
        points = rng.integers(-3, 4, (200, 3))
        index, best = codebooks.Tree(entries).nearest(points)
        d = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def test_codes_of_awkward_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [0.5, -0.25, 1.0, 2.0, 0.0, -1.0, 0.125, 3.0]
    rows = [
        (1, None, 1, "", ""), (2, [], 1, "", ""), (3, [None] + good[1:], 1, "", ""), (4, [nan] + good[1:], 1, "", ""), (5, [-inf] + good[1:], 1, "", ""),
        (6, good[:7], 1, "", ""), (7, good * 2, 1, "", ""), (8, good, None, "", ""), (8, good, None, "", ""), (None, [3e38] + good[1:], 2, "", ""),
    ]
    got = codebooks.compress(vectors_of(spark, rows)).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 8, 8]
    assert {r["code"] for r in got if r["vec_id"] == 8} == {"00" * 8}
    assert all(r["error"] >= 0 for r in got)
    empty = codebooks.compress(vectors_of(spark, rows[:6]))
    assert empty.columns == codebooks.compress(vectors_of(spark, rows)).columns and not empty.count()
    assert not codebooks.compress(vectors_of(spark, [])).count()


# Packing


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def packed_rightly(rows, texts, capacity):
    """Checks pieces against the texts and sequences for gaps; the number of sequences."""
    by_id, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in texts.items():
        ids = ids_of(text)
        want = [ids[k : k + capacity] for k in range(0, len(ids), capacity)]
        own = sorted(by_id.pop(i), key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in own] == [
            (k, k * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for k, p in enumerate(want)
        ]
    assert not by_id
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(sequences)


ODD = [None, "", " \n\t ", "a", "It's the U.S. 3.14, don't!", "<|endoftext|> and|pipes || | <|startoftext|>", "é ÉÅ  x y\x1cz\x85w", "word" * 40 + ".", "ΟΔΟΣ ΟΔΟΣ. Straße 漢字かな 🙂🙂", "x " * 3000, "\x00 \x0b\x0c\r\n q"]


def test_word_ids_are_those_of_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    known = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    letters = "abcdefghijklmnop ABC '.,|éß́ \n\t0123-_🙂漢"
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 300))) for _ in range(200)]
    for begin in range(0, len(texts), 20):
        some = texts[begin : begin + 20]
        for text, ids in zip(some, known.of_texts(some), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == ids_of(text)[:-1]


@pytest.mark.parametrize("shard", [16_384, 40])
def test_packing(spark, monkeypatch, shard):
    monkeypatch.setattr(packing, "SHARD_PIECES", shard)
    rng = random.Random(8)
    texts = dict(enumerate(ODD + [" ".join(rng.choice(["alpha", "beta", "gamma."]) for _ in range(rng.choice([3, 20, 60, 200]))) for _ in range(300)]))
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in texts.items()], "doc_id long, text string, piece string, length int")
    rows = packing.pack(docs, capacity=128).collect()
    n = packed_rightly(rows, texts, 128)
    least = -(-sum(r["length"] for r in rows) // 128)
    assert n <= least * (1.01 if shard > 40 else 1.05) + 1


def test_packing_of_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "three"), (None, None)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 1), (0, 2), (1, 3), (1, 3)]
    assert len({r["sequence_id"] for r in rows}) == 1
    assert sorted(r["offset"] for r in rows)[0] == 0
    assert not packing.pack(docs.limit(0)).count()


def test_pieces_go_where_squares_are_least():
    """Against a loop over all open sequences."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        lengths = rng.integers(1, 21, 60)
        sequence, offset, gaps = packing.sum_of_squares(lengths, 20)
        count, now = Counter(), []
        for at in np.argsort(-lengths, kind="stable").tolist():
            n = int(lengths[at])
            cost = {}
            for gap in sorted({g for g in now if g >= n}):
                after = count.copy()
                after[gap] -= 1
                after[gap - n] += gap > n
                cost[gap] = sum(x * x for x in after.values())
            gap = min(cost, key=lambda g: (cost[g], g)) if cost else 20
            if cost:
                now.remove(gap)
                count[gap] -= 1
            if gap > n:
                count[gap - n] += 1
            now.append(gap - n)
            assert offset[at] == 20 - gap
        assert sorted(now) == sorted(gaps.tolist())


# Divergence


def audited_plainly(rows, least=3, top=200):
    docs, groups, counts = defaultdict(Counter), set(), defaultdict(Counter)
    for text, lang, source in ((t or "", a or "", s or "") for t, a, s in rows):
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {a for a, _ in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        own = {s: {t: counts[lang, s][t] for t in kept} for a, s in groups if a == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (n + 1) // (sum(c.values()) + len(kept)) for t, n in c.items()}
        p, q = {s: share(c) for s, c in own.items()}, share(whole)
        for s in own:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, rank) for rank, (value, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 3, "TILE_TERMS": 7, "TILE_POSTINGS": 20, "COUNTED_BYTES": 2000}])
def test_divergence(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(divergence, name, value)
    rng = random.Random(6)
    common = [f"w{a}" for a in "abcdefghij"]
    rows = []
    for k in range(220):
        source = rng.choice(["s0"] * 4 + [f"s{j}" for j in range(11)])
        rare = [f"{source}rare", "Éa" + rng.choice("xyzuvw"), rng.choice("qrstu") * 2 + rng.choice("abcdef")]
        rows.append((" ".join(rng.choice(common + rare) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de"]), source))
    rows += [(None, "en", "s1"), ("", None, None), ("12 34", None, "alone"), ("Only OnlY", "fr", "x"), ("one", "fr", "y")] + [("Twice\x00twice twice~TWICE", "es", None)] * 4 + [("x" * 5000, "es", "long")] * 3
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "text string, lang string, source string, n int, term string")
    got = sorted(tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == audited_plainly(rows)
    assert {r[2] for r in got} == {"pair", "term"}


def test_divergence_of_no_rows_and_short_lists(spark):
    docs = spark.createDataFrame([("a b c d e", "en", s) for s in "xxxyyy"], "text string, lang string, source string")
    assert not divergence.audit(docs.limit(0)).count()
    more = docs.union(spark.createDataFrame([("a a b b b c", "en", "x")], docs.schema))
    got = divergence.audit(more, top=1).where(F.col("part") == "term").collect()
    assert all(r["rank"] == 1 for r in got)


def test_shares_don_t_overflow(spark):
    n, total = 3_000_000_000_000, 8_000_000_000_000_000
    want = 1 + 10**9 * (n + 1) // total
    assert divergence._shares(np.array([n]), np.array([total]))[0] == want
    assert spark.range(1).select(divergence._share(F.lit(n), F.lit(total)).alias("p")).first()["p"] == want
