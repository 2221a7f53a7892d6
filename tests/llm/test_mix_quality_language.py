import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing
from spanloom.llm.language_id import predict, train
from spanloom.llm.mixing import mix, mixed_documents
from spanloom.llm.quality import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def targets(sizes):
    """Shares by weight; what passes twice a source's size is shared anew until nothing does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        left = total - sum(full.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 2.0 * sizes[s] for s in over}


def test_mix(docs, rows, clashing, empty):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = targets(sizes)
    found = mix(docs).collect()
    assert len(found) == len(rows)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in found:
        s = source[r.id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert sorted((r.id is None, r.id, r.size) for r in found) == sorted((r[0] is None, r[0], len(words(r[1]))) for r in rows)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK
    row = lambda x: sorted(map(str, x.collect()))
    assert row(mix(docs.repartition(3))) == row(mix(docs)) == row(mix(clashing))
    assert mix(empty).isEmpty()


def test_sources_of_many_pools(docs, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "SHARD", 128)
    monkeypatch.setattr(mixing, "POOL", 3)
    source, taken = {r[0]: r[3] for r in rows}, Counter()
    found = mix(docs).collect()
    for r in found:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.id]] += r.taken
    target = {source[r.id]: r.target for r in found}
    size = {source[r.id]: r.source_size for r in found}
    assert all(abs(taken[s] - t) <= 0.05 * size[s] for s, t in target.items())
    assert mix(empty).isEmpty()


def test_apportionment_is_highest_quotients(spark):
    import heapq
    import random

    rng = random.Random(3)
    for seats, n in ((0, 3), (1, 4), (57, 6), (1000, 5), (5000, 40)):
        votes = [rng.choice((0.0, rng.random() * 10, rng.random() * 1000)) for _ in range(n)]
        won, heap = [0] * n, [(-v, k) for k, v in enumerate(votes)]
        heapq.heapify(heap)
        for _ in range(seats if sum(votes) else 0):
            _, k = heapq.heappop(heap)
            won[k] += 1
            heapq.heappush(heap, (-votes[k] / (2 * won[k] + 1), k))
        items = spark.createDataFrame([(0, k, v, seats) for k, v in enumerate(votes)], "grp int, item int, votes double, seats bigint")
        got = {r.item: r.quota for r in spark.sql(mixing.step_sql(mixing.APPORTION, mixing.SPARK, "s"), items=items).collect()}
        assert [got[k] for k in range(n)] == won


def test_mixed_documents(docs, clashing, empty):
    out = mixed_documents(clashing)
    assert out.columns == clashing.columns
    times = Counter(r.doc_id for r in out.collect())
    assert times and max(n for k, n in times.items() if k != 3) <= 2
    assert mixed_documents(empty).isEmpty()


def test_whole_documents_of_many_blocks_meet_the_targets(spark):
    """A hot source with a ratio below 0.5 keeps its share although its texts have many blocks."""
    import random

    rng = random.Random(9)
    sizes = {s: [rng.randrange(300, 3000) for _ in range(n)] for s, n in {"a": 200, "c": 132, "d": 200, "e": 66, "f": 132}.items()}
    sizes["b"] = [rng.randrange(5000, 12000) for _ in range(60)]
    data = [(f"{s}{k}", "w " * n, s) for s, all_sizes in sizes.items() for k, n in enumerate(all_sizes)]
    df = spark.createDataFrame(data, "doc_id string, text string, source string").repartition(4)
    target = {r.source_size: r.target for r in mix(df).collect()}
    got, times = Counter(), Counter()
    for r in mixed_documents(df).select("doc_id", "source", F.size(F.split(F.trim("text"), " ")).alias("n")).collect():
        got[r.source] += r.n
        times[r.doc_id] += 1
    ratio = {s: target[sum(x)] / sum(x) for s, x in sizes.items()}
    assert ratio["b"] < 0.5
    assert max(times.values()) <= 2
    for s, x in sizes.items():
        shards = -(-sum(x) // mixing.SHARD)
        assert abs(got[s] - target[sum(x)]) <= (shards + 1) * max(x), (s, got[s], target[sum(x)])


def test_base_statistics(docs, rows, clashing, empty):
    want = []
    for r in rows:
        text, w = r[1] or "", words(r[1])
        lines = [x for x in text.split("\n") if words(x)]
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    key = lambda r: tuple((x is None, x) for x in r)
    for df in (docs, clashing):
        found = quality(df)
        got = [tuple(r) for r in found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
        assert not found.filter("base_failed and kept").count()
    assert quality(empty).isEmpty()


def test_divergence_tells_junk_from_prose(spark):
    import random

    from .conftest import prose

    rng = random.Random(5)
    data = [(k, prose(rng, 300), "en") for k in range(60)]
    data += [(100, " ".join("### $$$ %%% ***".split() * 60) + " " + " ".join(str(k) for k in range(200)), "en"), (101, " ".join(f"{k}zq{k * 7 % 1000}" for k in range(300)), "en")]
    got = {r.doc_id: r.kept for r in quality(spark.createDataFrame(data, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[k] for k in range(60)) and not got[100] and not got[101]


def test_language_held_out(spark):
    import random

    rng = random.Random(6)
    make = lambda stems: " ".join(rng.choice(stems) + rng.choice(stems) for _ in range(60))
    stems = {"en": ["th", "ing", "wh", "ow"], "de": ["sch", "ung", "ei", "ß"], "xx": ["qa", "zu", "ki"]}
    data = [(k, make(stems[lang]), lang) for k, lang in enumerate(rng.choice(list(stems)) for _ in range(300))]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string").repartition(4)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    found = predict(df.filter(held), train(df.filter(~held))).join(df.select("doc_id", "lang"), "doc_id").collect()
    assert {r.doc_id for r in found} == {d[0] for d in data if zlib.crc32(str(d[0]).encode()) % 4 == 2}
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in found)


def test_language_of_odd_texts(docs, rows, clashing, empty):
    model = train(docs)
    assert model[0] == ["de", "en"]
    found = predict(clashing, model)
    assert found.count() == len(rows)
    got = {r.doc_id: r for r in found.collect()}
    for k in (20, 21, 22, 24):
        assert (got[k].lang_pred, got[k].score) == ("und", 0.0)
    assert got[26].lang_pred in ("de", "en") and got[25].lang_pred != "und"
    assert predict(empty, model).isEmpty()
    none = predict(docs, train(empty))
    assert {r.lang_pred for r in none.collect()} == {"und"}


def test_long_texts_are_read_whole(spark):
    from spanloom.llm import language_id

    text = "".join(chr(97 + k % 26) for k in range(3000))
    whole = sum(len(b) for b, _ in language_id._grams([text]))
    old, language_id.CHUNK = language_id.CHUNK, 100
    try:
        assert sum(len(b) for b, _ in language_id._grams([text])) == whole
    finally:
        language_id.CHUNK = old


def test_language_against_counts_by_hand(spark):
    """Whole predictions and scores by dictionaries of n-grams."""
    import math
    import random
    from collections import Counter

    from spanloom.llm.language_id import BUCKETS, LENGTHS, predict, train

    def buckets(text):
        text = " " + " ".join(text.lower().split()) + " "
        for n in LENGTHS:
            for i in range(len(text) - n + 1):
                value = 0
                for k, c in enumerate(text[i : i + n]):
                    value = (value * 0x9E3779B97F4A7C15 + ord(c) + k + 1) % (1 << 64)
                yield (value * 0xBF58476D1CE4E5B9 % (1 << 64)) >> 49

    rng = random.Random(61)
    some = {"en": "the of and to that", "fr": "le la é que un", "de": "der die das ü ist"}
    rows = [(k, " ".join(rng.choice(some[lang].split() + ["x1", "Ab"]) for _ in range(rng.randrange(0, 12))), lang) for k, lang in enumerate(rng.choices(list(some), k=60))]
    rows += [(100, None, "en"), (101, "12 34", "de"), (102, "mixed the le der", None)]
    counts, n = {x: Counter() for x in some}, Counter()
    for _, text, lang in rows:
        if lang:
            counts[lang].update(buckets(text or ""))
            n[lang] += 1
    want = {}
    for k, text, _ in rows:
        if text is None or not any(map(str.isalpha, text)):
            want[k] = ("und", 0.0)
            continue
        logs = {x: math.log(n[x] / sum(n.values())) + sum(math.log((counts[x][b] + 1) / (sum(counts[x].values()) + BUCKETS)) for b in buckets(text)) for x in sorted(some)}
        best = max(logs, key=logs.get)
        want[k] = (best, 1 / sum(math.exp(v - logs[best]) for v in logs.values()))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs, train(docs)).collect()}
    assert {k: x for k, (x, _) in found.items()} == {k: x for k, (x, _) in want.items()}
    assert all(abs(found[k][1] - s) < 1e-9 for k, (_, s) in want.items())
