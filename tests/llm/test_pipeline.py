"""Every stage of the pipeline against a plain version of its decisions, on the smallest tables."""

from __future__ import annotations

import os
from collections import Counter, defaultdict

import pytest
from llm.helpers import AWKWARD, collected, documents
from llm.test_minhash import brute
from llm.test_mixing import brute_targets, words
from llm.test_packing import check as check_packing

import corpus_pipeline as pipeline
from quillspark.llm import pii, toxicity
from quillspark.llm.common import table
from quillspark.session import materialize

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def stages(spark):
    docs = [table(spark, SF_DIR, "documents").select(*pipeline.COLUMNS)]
    for _, stage in pipeline.STAGES:
        docs.append(materialize(stage(spark, docs[-1], SF_DIR)))
    return docs


def by_id(df):
    return {r["doc_id"]: r for r in collected(df)}


def test_order_and_columns(stages):
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    assert all(df.columns == pipeline.COLUMNS for df in stages[:-1])


def test_rejected_documents_go(spark, stages):
    scores = collected(toxicity.score(stages[0], table(spark, SF_DIR, "labels")))
    assert {r["doc_id"] for r in scores if not r["predicted"]} == set(by_id(stages[1]))


def test_one_of_each_group_stays(stages):
    before = [(i, r["text"]) for i, r in by_id(stages[1]).items()]
    assert {i for i, _, _, kept in brute(before, pipeline.WORDS) if kept} == {str(i) for i in by_id(stages[2])}


def test_personal_data_is_replaced(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert {i: pii.redacted(r["text"]) for i, r in before.items()} == {i: r["text"] for i, r in after.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in after.values())


def test_sources_reach_their_targets(stages):
    before, rows = by_id(stages[3]), collected(stages[4])
    sizes, taken, of_doc = defaultdict(int), Counter(), Counter()
    for r in before.values():
        sizes[r["source"]] += words(r["text"])
    for r in rows:
        taken[r["source"]] += words(r["text"])
        of_doc[r["doc_id"]] += words(r["text"])
    assert {s: int(t) for s, t in brute_targets(dict(sizes)).items()} == dict(taken)
    assert all(n <= 3 * words(before[i]["text"]) for i, n in of_doc.items())
    whole = [r for r in rows if r["text"] == before[r["doc_id"]]["text"]]
    assert len(rows) - len(whole) <= 2 * len(sizes)


def test_the_mix_is_packed(stages):
    check_packing(stages[5], [(r["doc_id"], r["text"]) for r in collected(stages[4])], 2048)


def test_awkward_rows(spark):
    rows = AWKWARD + [(None, "two words"), (12, "mail a@b.co")]
    docs = documents(spark, rows, ["a", None, "b", "a", "b", "b", "a", "b", "a", None, "a", "b", "b"])
    for _, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF_DIR))
    assert docs.count() > 0
    nothing = documents(spark, [])
    for _, stage in pipeline.STAGES:
        nothing = materialize(stage(spark, nothing, SF_DIR))
    assert nothing.count() == 0


def test_near_duplicates_leave_only_the_ids_they_keep(spark, stages):
    """What the search for near duplicates writes on the way is gone when the stage is defined."""
    from pathlib import Path

    from quillspark.session import scratch_dir

    held = lambda: set(Path(scratch_dir(spark).removeprefix("file://")).glob("quillspark/**/*.parquet"))
    before = held()
    rest = pipeline.drop_near_duplicates(spark, stages[1], SF_DIR)
    assert len({p.parent for p in held() - before}) == 1
    assert rest.count() == stages[2].count()
