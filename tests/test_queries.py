"""Every registered query against its SQL, at the smallest scale; and the library without the training-data folder."""

import os
import re
import shutil
import subprocess
import sys
from collections import Counter

import duckdb
import pytest

from tagforge.operators.taxonomy import Taxonomy
from tagforge.plans.registry import OVER_VIEWS, QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    order = [names.index(c) for c in got.columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=key)


def test_without_the_training_data_folder(tmp_path):
    for x in ("tagforge", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "tagforge/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'metric_all' in q and not any(n.startswith('op1') for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_apostrophes_of_whole_texts(spark, tmp_path):
    head = "x" * 250
    spark.createDataFrame([(1, head + "l’e\u0301cole `a"), (2, None), (3, "d’")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.plain for r in QUERIES["apostrophes_whole"](spark, str(tmp_path)).collect()}
    assert got == {1: head + "l'école 'a", 2: None, 3: "d'"}


def test_whole_documents(spark, tmp_path):
    """Every sentence and mention against plain Python, with more than three mentions a sentence and repeated ones."""
    words = "Bologna Venezia museum Bologna garden Torino station Venezia library".split()
    texts = {3: " ".join(f"Here {' or '.join(words[k:])} and {words[k]}s end it." for k in range(7)) + " Too short.", 1: "One " + " ".join(words) + " was all", 7: None, 8: "None of it is so long at all."}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[f"{name}_whole"](spark, str(tmp_path)).collect()
    split = [(d, n, s) for d in sorted(texts) for n, s in enumerate(x for x in re.split(r"(?<=[.!?])\s+(?=[A-Z])", texts[d] or "") if len(x) > 20)]
    assert sorted((r.number, r.doc_id, r.n, r.sentence) for r in run("sentences")) == [(i, *x) for i, x in enumerate(split)]
    leaves = sorted({x for xs in Taxonomy.of().third.values() for x in xs})
    ment = [(i, p, e, leaves[(i * i + 31 * p) % 155]) for i, (_, _, s) in enumerate(split) for p, e in enumerate(re.findall(r"[^\W\d_]{6,}", s))]
    assert max(p for _, p, _, _ in ment) > 3 and len({i for i, *_ in ment}) > 7
    answers = run("stage2_answers")
    assert len({r.row_id for r in answers}) == len(answers) == 3 * len(ment)
    assert [r.answer for r in sorted(answers, key=lambda r: r.row_id) if r.level == 3] == [m[3] for m in ment]
    marked, at = [], {}
    for i, _, e, _ in ment:
        s = split[i][2]
        p = s.find(e, at.get(i, 0))
        marked.append(s if p < 0 else f"{s[:p]}##{e}##{s[p + len(e) :]}")
        at[i] = at.get(i, 0) if p < 0 else p + len(e)
    prompts = [r.prompt for r in sorted(run("stage2_prompts"), key=lambda r: r.row_id)]
    assert [x.split('in the sentence: "')[1].split('" belongs')[0] for x in prompts[::3]] == marked
    freq = {r.answer: r.n for r in run("category_freq")}
    assert sum(freq.values()) == 3 * len(ment) and all(freq[k] >= v for k, v in Counter(m[3] for m in ment).items())
    assert {(r.doc_id, r.pos) for r in run("mark_first")} == {m[:2] for m in ment}
    assert {r.idx: r.n_truth for r in run("count_compare_by_index")} == {i: len({e for j, _, e, _ in ment if j == i}) for i in {m[0] for m in ment}}
    assert sorted((r.row_id, r.listed) for r in run("answer_in_options")) == sorted((r.row_id, r.row_id // 3 >> 32 != 0) for r in answers)
    assert all(f"{name}_whole" in QUERIES for name in OVER_VIEWS)
