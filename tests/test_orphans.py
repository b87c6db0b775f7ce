import random

import pytest

from strataloom.operators import orphans as op

JOBS = "id string, parent string, created_at long, table_name string, key string"


def found(jobs):
    refs = op.references(jobs, "jobs", "parent")
    return {r.record_id for r in op.orphan_references(refs, op.parents(jobs, ("jobs", "parent"), "id")).collect()}


def test_cases(spark):
    month = 31 * 86_400_000
    rows = [
        ("a", None, 5, "x", "y"), ("b", "", 5, "x", "y"), ("c", "a", 5, "x", "y"), ("d", "a", 4, "x", "y"), ("e", "none", 5, "x", "y"), ("e", "none", 5, "x", "y"),
        ("f", "late", 5, "x", "y"), ("late", "f", month * 3, "x", "y"), ("late", "f", 2, "x", "y"), ("g", "later", None, "x", "y"), ("later", None, month * 9, "x", "y"), ("h", "nulltime", 1, None, None), ("nulltime", None, None, None, None), ("i", "i", 7, None, None), ("j", "gone", None, None, None),
    ]
    assert found(spark.createDataFrame(rows, JOBS)) == {"d", "e", "j", "late"}


def test_empty(spark):
    assert found(spark.createDataFrame([], JOBS)) == set()


def test_scope_and_report(spark):
    files = spark.createDataFrame([("1", "p", "a/b", "c", 1), ("2", "p", "c", "", 1), ("3", "q", "d", "c", 1), ("4", None, "e", "f", None), ("5", None, "f", None, None)], "id string, project_id string, path string, dup string, began long")
    refs = op.references(files, "files", "dup", scope=["project_id"], created=None, report="began")
    targets = op.parents(files, ("files", "dup"), "path", scope=["project_id"], created=None)
    out = op.orphan_references(refs, targets)
    assert [r.record_id for r in out.collect()] == ["3"]
    report = {(r.month, r.n_references, r.n_orphans) for r in op.orphan_report(refs, out).collect()}
    assert report == {("1970-01", 2, 1), (None, 1, 0)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    keys = [f"k{i}" for i in range(60)]
    rows = [(r.choice(keys), r.choice([*keys, "hot", "hot", "hot", "", None]), r.choice([None, *range(0, 10**11, 10**9)])) for _ in range(600)]
    jobs = spark.createDataFrame([(a, b, c, "t", "k") for a, b, c in rows], JOBS)
    times = {}
    for a, _, c in rows:
        times.setdefault(a, []).append(c)
    expected = set()
    for a, b, c in rows:
        if b and (b not in times or c is not None and all(t is not None and t > c for t in times[b])):
            expected.add(a)
    assert found(jobs) == expected
