import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n, words="the of and to in is that for it as with by on at from this be are or an was not have which one had you were all".split()):
    return " ".join(rng.choice(words) + rng.choice(("", "ly", "er", "ing", "tion", "ness")) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and wordless texts, copies, near copies, shared passages, ties and repeated rows, and one long text."""
    rng = random.Random(11)
    out = [[k, prose(rng, rng.choice((3, 30, 120, 400))), rng.choice(("en", "de", None)), rng.choice(("a", "b", "c", None)), 0] for k in range(60)]
    passage = prose(rng, 90)
    for k in (5, 17, 23, 41):
        out[k][1] = prose(rng, 40) + " " + passage + " " + prose(rng, 40)
    copy = prose(rng, 150)
    for k in (2, 7, 8, 30):
        out[k][1] = copy
    near = prose(rng, 200).split()
    for k in (12, 13, 14):
        out[k][1] = " ".join(near[:190] + [f"w{k}"] + near[191:])
    out[20][1], out[21][1], out[22][1], out[24][1], out[25][1] = None, "", " \t\n", "!!! 123 --", "Été ñandú ß　日本語 😀 é don't I'LL\x1cx\x85y  z"
    out[26][1] = prose(rng, 9000)
    out[27][1] = "ab" * 900
    out[28][1] = "x" * 1500
    out[29][1] = "line one\nline two\nline one\n\n  \nline two two two two two two"
    out += [list(out[3]), list(out[3]), [None, out[4][1], "en", "a", 0], [61, "▁mark  two spaces ", "en", "a", 0], [62, "say <|endoftext|> or <|startoftext|>!", "en", "a", 0]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with more columns, named like those that operators use inside."""
    from pyspark.sql import functions as F

    more = "row id rid sha rest group chunk ended key fp node sketch label size h1 h2 sid shard spans own own_rid row_id words seed at ids kept n".split()
    return docs.withColumns({c: F.lit(k) for k, c in enumerate(more)})
