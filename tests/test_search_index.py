"""The persistent search table: appended batches against a fresh build, and the plan of a search."""

import pytest
from pyspark.sql import functions as F
from test_similarity import brute, found, frame, make_rows

from shotweave.operators import similarity
from shotweave.operators.search_index import BandIndex

SETTINGS = {"bands": 12, "rows": 3, "buckets": 4}


@pytest.fixture(scope="module")
def rows():
    return [(k, "t", b) for k, _, b in make_rows()]


def test_appended_equals_fresh(spark, rows):
    queries = [(k, "t", b) for k, _, b in make_rows(30, 5)]
    ask = frame(spark, queries)
    whole, parts = BandIndex.open(spark, **SETTINGS), BandIndex.open(spark, **SETTINGS)
    table = frame(spark, rows)
    whole.append(table)
    for lo, hi in ((0, 50), (50, 55), (55, 160)):
        parts.append(frame(spark, rows[lo:hi]))
        assert parts.table("prints").count() == sum(1 for r in rows[:hi] if r[2])
    assert found(parts.search(ask, 5)) == found(whole.search(ask, 5))
    # Nothing but copies is certain here, so every other query is searched exactly.
    assert found(parts.search(ask, 5, certainty=1 - 1e-15)) == brute(queries, rows, 5, False, False)
    assert similarity.recall(parts.search(ask, 5), similarity.nearest(ask, table, 5)).head()["recall"] >= 0.95


def test_another_session_finds_the_files(spark, rows, tmp_path):
    made = BandIndex.open(spark, f"file://{tmp_path}/index", **SETTINGS)
    made.append(frame(spark, rows))
    want = found(made.search(frame(spark, rows[:20]), 3))
    made.close()
    again = BandIndex.open(spark, f"file://{tmp_path}/index", **SETTINGS)
    assert found(again.search(frame(spark, rows[:20]), 3)) == want
    late = frame(spark, [(5000, "t", rows[0][2])])
    again.append(late)
    assert 5000 in {r["key"] for r in again.search(late, 64).collect()}


def test_missing(spark, rows):
    index = BandIndex.open(spark, **SETTINGS)
    index.append(frame(spark, rows[:40]))
    left = {r["key"] for r in index.missing(frame(spark, rows), "key").collect()}
    assert left == {k for k, _, b in rows[40:]} | {k for k, _, b in rows[:40] if not b}


def test_empty_index(spark, rows):
    index = BandIndex.open(spark, **SETTINGS)
    assert index.search(frame(spark, rows[:5]), 3).count() == 0
    index.append(frame(spark, rows).limit(0))
    assert index.search(frame(spark, rows[:5]), 3).count() == 0
    with pytest.raises(ValueError):
        index.search(frame(spark, rows[:5]), index.most + 1)


def test_search_does_not_shuffle_the_index(spark, rows, capsys):
    index = BandIndex.open(spark, **SETTINGS)
    index.append(frame(spark, rows))
    asked = similarity._distinct(similarity._encoded(frame(spark, rows[:20]), []), [similarity.GROUP], 1)
    index.found(asked.drop("members"), 3).explain()
    lines = capsys.readouterr().out.splitlines()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    above, depth = [], len(lines[at])
    for line in reversed(lines[:at + 1]):
        start = len(line) - len(line.lstrip(" :+-"))
        if start < depth:
            above.append(line)
            depth = start
    join = next(i for i, line in enumerate(above) if "SortMergeJoin [posting" in line)
    assert not any("Exchange" in line for line in above[:join])


def test_postings_hold_copies_once(spark):
    same = [(i, "t", [1, 2, 3]) for i in range(300)]
    index = BandIndex.open(spark, **SETTINGS, most=5)
    index.append(frame(spark, same))
    assert index.table("postings").count() == 12
    assert index.table("postings").select(F.max(F.size("members"))).head()[0] == 5
    assert found(index.search(frame(spark, same[:1]), 5)) == {(0, i + 1, i, 0.0) for i in range(5)}
