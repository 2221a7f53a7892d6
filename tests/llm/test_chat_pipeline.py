import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm.chat import format_preferences, pair_conversations
from spanloom.llm.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def show(role, text):
    return f"<|{role or ''}|>\n{text or ''}<|end|>\n"


def test_preferences(spark):
    u, a = ("user", "hi"), ("assistant", "one")
    data = {0: [u, a, u], 1: [u, ("assistant", "two")], 2: [u, a], 3: [u, a, ("user", None)], 4: [(None, "x"), a], 5: [(None, "x"), a], 6: [u], 9: [a]}
    rows = [(c, k, *t) for c, turns in data.items() for k, t in enumerate(turns)] + [(None, 0, "user", "lost")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    got = {r.pair_id: r for r in format_preferences(pair_conversations(df)).collect()}
    text = lambda segments: "".join(s.text for s in segments)
    r = got[0]
    assert (r.n_common, r.prompt, text(r.chosen_completion), text(r.rejected_completion)) == (1, show(*u), show(*a) + show(*u), show("assistant", "two"))
    assert [s.train for s in r.chosen_completion] == [True, False]
    assert (got[1].n_common, text(got[1].chosen_completion), text(got[1].rejected_completion)) == (2, "", show("user", None))
    assert got[2].n_common == 2 and got[2].prompt == show(None, "x") + show(*a)
    assert (got[3].chosen_id, got[3].rejected_id, got[3].n_common, text(got[3].chosen_completion)) == (6, None, 0, show(*u))
    assert (got[4].chosen_id, got[4].rejected_id, text(got[4].rejected_completion)) == (None, 9, show(*a))
    assert text(got[None].chosen_completion) == show("user", "lost")
    assert format_preferences(pair_conversations(df.limit(0))).isEmpty()


def test_null_sides_and_more_columns(spark):
    turn = "array<struct<role:string,text:string>>"
    df = spark.createDataFrame([(1, None, [("assistant", "x")]), (2, [], None)], f"side int, chosen {turn}, rejected {turn}")
    got = {r.side: r for r in format_preferences(df).collect()}
    assert got[1].n_common == 0 and got[1].chosen_completion == [] and got[1].rejected_completion[0].train
    assert got[2].rejected_completion == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    value = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    row = lambda r, cols: tuple(value(r[cols.index(c)]) for c in sorted(cols))
    assert sorted(names) == sorted(df.columns)
    assert Counter(row(r, df.columns) for r in df.collect()) == Counter(row(r, names) for r in found.fetchall())


def test_stages(spark, docs):
    """Each stage on what the one before kept: its decision takes effect, its columns stay, clean documents stay."""
    start = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).withColumn("lang", F.lit("en"))
    texts = {r.doc_id: r.text for r in start.collect()}
    named, frame, out = dict(corpus_pipeline.STAGES), start, {}
    for name, stage in list(named.items())[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, "").collect(), start.schema)
        out[name] = [r.doc_id for r in frame.collect()]
        assert frame.columns == start.columns
    assert set(texts) - set(out["language_id"]) == {k for k, t in texts.items() if not any(map(str.isalpha, t or ""))}
    by_text = {}
    for k in out["language_id"]:
        by_text[texts[k]] = max(k, by_text.get(texts[k], k))
    assert sorted(out["exact_dedup"]) == sorted(by_text.values())
    assert set(out["exact_dedup"]) - set(out["near_dedup"]) == {13, 14}
    assert set(out["source_mix"]) <= set(out["near_dedup"]) and max(Counter(out["source_mix"]).values()) <= 2
    last = named["sentencepiece"](spark, frame, "").collect()
    assert Counter(r.doc_id for r in last) == Counter(out["source_mix"]) and all(r.n_tokens == len(r.ids) > 0 for r in last)


def test_stages_of_no_documents(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").isEmpty()


def test_stages_leave_nothing_behind(spark, docs, tmp_path):
    """After a run only the last stage's input and own tables are left; the result equals that of the stages one by one."""
    docs.filter("doc_id is not null").withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    own = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + f"/spanloom/{spark.sparkContext.applicationId}"
    before = set(os.listdir(own)) if os.path.isdir(own) else set()
    found = sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(own)) - before}
    assert left & {name for name, _ in corpus_pipeline.STAGES} == set()
    assert {name for name in left if name.startswith("stage-")} == {"stage-source_mix"}
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
    assert found == sorted((r.doc_id, r.n_tokens) for r in frame.collect())


def test_stages_with_more_columns(spark, clashing):
    """Columns named like those that operators use inside stay as they were, through all stages but the last."""
    frame = clashing.filter("doc_id is not null").withColumn("lang", F.lit("en"))
    columns = frame.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == columns
    assert frame.count() > 0 and frame.filter("rid <> 2 or n <> 27").isEmpty()
