"""The registered text queries: against SQL where there is some, and the pipeline stage by stage."""

import glob
import os

import duckdb
import pytest

import corpus_pipeline
from trialweave.llm import decontaminate, pieces, quality, secrets
from trialweave.llm.oracle import SQL
from trialweave.llm.queries import REGISTRY

from test_text_operators import brute_components

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = REGISTRY[name](spark, FOLDER)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    at = [names.index(n) for n in sorted(names)]
    assert sorted(df.columns) == sorted(names)
    got = sorted(map(repr, (tuple(r) for r in df.select(*sorted(names)).collect())))
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - set(SQL) - {"pipeline"}))
def test_gives_rows(spark, name):
    assert REGISTRY[name](spark, FOLDER).count() > 0


def test_every_stage_works_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], FOLDER).cache())
    assert all(s.columns == columns for s in steps[:-1])
    texts = [{r.doc_id: r for r in s.collect()} for s in steps[:-1]]

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    good = {r.doc_id for r in quality.classify(docs, labels).where("predicted = 1").collect()}
    assert set(texts[1]) == good

    ids = sorted(texts[1])
    root, _ = brute_components([texts[1][i].text for i in ids])
    assert set(texts[2]) == {ids[r] for r in root}

    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    leaks = {r.doc_id for r in decontaminate.leaks(steps[2], bench).collect()}
    assert set(texts[3]) == set(texts[2]) - leaks
    items = [r.text for r in bench.collect()]
    assert all(i in leaks for i, r in texts[2].items() if any(t in r.text for t in items))

    assert set(texts[4]) == set(texts[3])
    scanned = {r.doc_id: r for r in secrets.scan(steps[3]).collect()}
    for i, r in texts[4].items():
        assert (r.text != texts[3][i].text) == (scanned[i].n_live > 0) and r.n_chars == len(r.text)

    tokens = steps[5].collect()
    own = pieces.Pieces(pieces.read_model(pieces.MODEL))
    assert {r.doc_id: own.decode(r.token_ids) for r in tokens} == {i: r.text for i, r in texts[4].items()}
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(r.doc_id for r in tokens)
