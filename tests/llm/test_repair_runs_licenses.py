import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import conversation_repair as repair
from spanloom.llm import license_scan as licenses
from spanloom.llm import periodic_runs as periodic

TURNS = "conv_id bigint, turn bigint, role string, text string"


def turn(rng):
    text = rng.choice(("hi.", "well?", "cut off", "", " \t", "no! ", None, "x"))
    return rng.choice(("user", "assistant", "system", "user", "assistant", "tool", None)), text


def by_hand(rows):
    """What repair has to find for one conversation's rows (turn, role, text), by a plain dynamic programme over whole rows."""
    rows = sorted(((t, role or " ", " " if text is None else text) for t, role, text in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    known = sorted({r[0] for r in rows if r[0] is not None})
    counts = Counter(gaps=known[-1] - known[0] + 1 - len(known) if known else 0)
    faults = []
    for k, (_, role, text) in enumerate(rows):
        shown = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not shown else "duplicate" if (role, text) in [r[1:] for r in rows[:k]] else "truncated" if shown[-1] not in ".!?" else "")
    counts.update(f for f in faults if f)
    counts["illegal"] = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    legal = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}
    names = {"u": "user", "a": "assistant"}
    least = lambda found: {s: min(w for t, w in found if t == s) for s in {t for t, _ in found}}

    def inserted(found):
        for _ in range(3):
            found = found + [(x, (c + 2, a + "I", (*out, f"{names[x]}:"))) for s, (c, a, out) in found for x in legal[s] if x in names]
        return least(found)

    best = inserted([("", (0, "", ()))])
    for (_, role, text), fault in zip(rows, faults, strict=True):
        found = []
        for s, (c, a, out) in best.items():
            found.append((s, (c + 3, a + "D", out)))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                found += [(x, (c + 2 + more, a + "R", (*out, f"{names[x]}:{text}"))) for x in legal[s] if x in names]
                found += [(x, (c + more, a + "K", (*out, f"{role}:{text}"))) for x in legal[s] if x == role[:1]]
        best = inserted(found)
    cost, audit, out = min(best[s] for s in ("", "a") if s in best)
    return (*(counts[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal")), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def summary(df):
    return {r.conv_id: tuple(r)[1:] for r in repair.summaries(repair.repair_conversations(df)).collect()}


def conversations(rng, sizes):
    return {c: [(rng.choice((None, k, k, k + 1)), *turn(rng)) for k in range(n)] for c, n in sizes.items()}


def test_repair(spark):
    """Random conversations, ties and nulls in any column, repeated rows, a null conversation, and clashing columns."""
    rng = random.Random(5)
    data = conversations(rng, {k: rng.randrange(1, 9) for k in range(80)} | {None: 4})
    rows = [(c, *r, 1) for c, turns in data.items() for r in turns]
    df = spark.createDataFrame(rows, f"{TURNS}, n int").withColumns({c: F.lit(7) for c in ("conv", "part", "cut", "what", "seen", "audit")}).repartition(6)
    assert summary(df) == {c: by_hand(turns) for c, turns in data.items()}
    assert len(summary(df.filter("conv_id is null"))) == 1 and summary(df.limit(0)) == {}


def test_repair_of_a_long_conversation(spark, monkeypatch):
    """A conversation that fills many tasks, next to short ones; rows that stand several times or not at all."""
    rng = random.Random(6)
    data = conversations(rng, {1: 3, 2: 700, 3: 2})
    rows = [(c, *r, 1) for c, turns in data.items() for r in turns] + [(4, 0, "user", "gone", 0), (5, 3, "user", "twice.", 2)]
    df = spark.createDataFrame(rows, f"{TURNS}, n int")
    data |= {4: [], 5: [(3, "user", "twice.")] * 2}
    want = {c: by_hand(turns) for c, turns in data.items()}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        parts = repair.repair_conversations(df)
        assert parts.filter("conv_id = 2").count() > 4
        assert {r.conv_id: tuple(r)[1:] for r in repair.summaries(parts).collect()} == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert want[4] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_ways_of_blocks(monkeypatch):
    rng = random.Random(7)
    for _ in range(40):
        turns = [repair.Turn(role or " ", text or "", rng.choice(("", "", "blank", "truncated", "duplicate"))) for role, text in (turn(rng) for _ in range(rng.randrange(30)))]
        whole = repair.cheapest_whole(turns)
        monkeypatch.setattr(repair, "BLOCK", rng.randrange(1, 6))
        assert repair.cheapest_whole(turns) == whole
        monkeypatch.undo()


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(10)] + [(None, None, None, None)]
    got = {(r.conv_id, r.turn): (r.role, r.text, r.n) for r in repair.damaged(spark.createDataFrame(rows, TURNS)).collect()}
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = {0: (role, text, 0), 1: (role, "", 1), 2: (role, text.replace(".", "").replace("!", ""), 1), 3: (role, text, 2), 4: ("user", text, 1)}.get(k, (role, text, 1))
        assert got[c, t] == want


def slow_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        k = 0
        while k < len(w) - q:
            end = k
            while end < len(w) - q and w[end] == w[end + q]:
                end += 1
            if end > k and end + q - k >= max(24, 3 * q):
                found.setdefault((k, end + q - k), q)
            k = max(end, k + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def repetitive(rng):
    w = [rng.randrange(rng.choice((1, 2, 3, 12))) for _ in range(rng.randrange(160))]
    for _ in range(rng.randrange(4)):
        a, p = rng.randrange(len(w) + 1), rng.randrange(1, 20)
        for i in range(a, min(len(w), a + rng.randrange(100))):
            w[i] = w[a + (i - a) % p]
    return w


@pytest.mark.parametrize("setting", ["plain", "pieces", "collisions"])
def test_runs(monkeypatch, setting):
    """Against all periods and positions; with grids in pieces; with hashes that collide all the time."""
    if setting == "pieces":
        monkeypatch.setattr(periodic, "KEPT_GRID", 8)
        monkeypatch.setattr(periodic, "PIECE", 40)
    if setting == "collisions":
        monkeypatch.setattr(periodic, "PRIMES", (7, 5))
        monkeypatch.setattr(periodic, "BASES", (3, 2))
        periodic._powers.cache_clear()
    rng = random.Random(8)
    cases = [repetitive(rng) for _ in range(400)] + [[0] * 23, [0] * 24, [], [k % 9 for k in range(27)], [k % 9 for k in range(26)]]
    for w in cases:
        assert periodic.runs_of(np.array(w, np.int32)) == slow_runs(w)
    periodic._powers.cache_clear()


def test_periodic_runs(spark, clashing, empty):
    rng = random.Random(9)
    texts = {k: " ".join(f"w{x}" for x in repetitive(rng)) for k in range(60)} | {60: None, 61: "", 62: " \n\t", 63: " a\x0b" * 30, 64: "z " * 70_000}
    df = spark.createDataFrame([*texts.items(), (5, texts[5])], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("runs", "n_words", "collapsed", "h", "g")})
    got = [(r.doc_id, r) for r in periodic.periodic_runs(df).collect()]
    assert Counter(k for k, _ in got) == Counter([*texts, 5])
    for k, r in got:
        words = (texts[k] or "").split()
        runs = slow_runs(words) if k != 64 else [(0, 70_000, 1)]
        assert [tuple(x) for x in r.runs] == runs and r.n_words == len(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (tuple(r.strongest) if r.strongest else None) == best
    assert periodic.periodic_runs(clashing).count() == clashing.count() and periodic.periodic_runs(empty).isEmpty()


def test_looped(spark):
    texts = {k: " ".join(f"w{x}" for x in range(k % 60)) for k in range(300)} | {None: "a b c", 300: None}
    for r in periodic.looped(spark.createDataFrame([*texts.items()], "doc_id bigint, text string")).collect():
        words = (texts[r.doc_id] or "").split()
        if r.doc_id is not None and words and (h := zlib.crc32(str(r.doc_id).encode())) % 10 == 0:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        assert (r.text or "").split() == words


def all_blocks(text, order):
    """Every block with every template of its size, by sets."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" or c > "\x7f" else " " for c in words).split(" ")
    words = [w for w in words if w]
    out = []
    for step in sorted({licenses.block_step(len(t.split())) for _, t in licenses.TEMPLATES}):
        for start in range(0, max(1, len(words) - step), step) if words else ():
            block = set(words[start : start + 2 * step])
            found = []
            for k, (label, t) in enumerate(licenses.TEMPLATES):
                share = Fraction(len(block & set(t.split())), len(set(t.split())))
                if licenses.block_step(len(t.split())) == step and share >= Fraction(4, 5):
                    found.append(((share, len(t.split()), -k), (start, len(words[start : start + 2 * step]), label, float(share))))
            if found:
                out.append(max(found)[1])
    return len(words), sorted(out)


def test_licenses(spark, clashing, empty):
    """Whole, changed, shuffled and cut notices among other words, against every block with every template."""
    rng = random.Random(10)
    common = "the of and to in this is software license provided that by with you use a work under licensed".split()
    texts = {}
    for k in range(150):
        notice = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randrange(len(notice) // 3 + 1)):
            notice[rng.randrange(len(notice))] = rng.choice(common)
        if k % 3 == 0:
            rng.shuffle(notice)
        around = [[rng.choice(common) for _ in range(rng.randrange(60))] for _ in range(2)]
        texts[k] = rng.choice((" ", ", ", "\n")).join([*around[0], *notice, *around[1]]).upper() + rng.choice(("", " MIT License.", " the mit-license, Apache\tLicense"))
    texts |= {150: None, 151: "", 152: "?!", 153: "General Public License general public license", 154: "été MIT\x00License ÀMIT license", 155: "of the " * 40_000 + " ".join(licenses.TEMPLATES[5][1].split())}
    df = spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("places", "blocks", "n_words", "word", "n")}).repartition(4)
    got = licenses.scan_licenses(df).collect()
    assert Counter(r.doc_id for r in got) == Counter([*texts, 3])
    for r in got:
        n, blocks = all_blocks(texts[r.doc_id], None)
        assert (r.n_words, sorted(tuple(b) for b in r.blocks)) == (n, blocks), r.doc_id
    by_id = {r.doc_id: r for r in got}
    assert [tuple(p) for p in by_id[153].places] == [(0, "gpl"), (3, "gpl")]
    assert [tuple(p) for p in by_id[154].places] == [(1, "mit")]
    assert by_id[155].blocks[0].label == "gpl"
    assert licenses.scan_licenses(clashing).count() == clashing.count() and licenses.scan_licenses(empty).isEmpty()


def test_closest_license_counts(spark):
    said = {0: ("Licensed under CC BY 4.0.", "cc-by"), 1: ("Licensed under CC BY-NC 4.0.", "cc-by-nc"), 2: (licenses.TEMPLATES[6][1], "lgpl"), 3: (licenses.TEMPLATES[7][1], "agpl"), 4: ("a quiet day under the sun, by and by", None)}
    df = spark.createDataFrame([(k, t) for k, (t, _) in said.items()], "doc_id bigint, text string")
    for r in licenses.scan_licenses(df).collect():
        assert {b.label for b in r.blocks} == ({said[r.doc_id][1]} if said[r.doc_id][1] else set())
