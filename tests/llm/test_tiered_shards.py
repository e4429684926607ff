import random
from collections import Counter

import pytest

from ctxcost.llm import tiered_shards as ts
from ctxcost.llm._store import fresh_dir

from .conftest import prose


def keys(df):
    return Counter(map(tuple, df.collect()))


@pytest.fixture
def shards(spark):
    return ts.ShardTable(spark, fresh_dir(spark, "test-shards"))


def rows(rng, n, start=0):
    return [(start + i, prose(rng, 6)) for i in range(n)]


def test_rows_survive_appends_and_compaction(make, shards):
    rng = random.Random(61)
    want = Counter()
    for k in range(9):
        part = make(rows(rng, 60, 100 * k)).repartition(3)
        want += keys(part)
        shards.append(part, arrival_bytes=20_000)
    before = shards.manifest()
    assert keys(shards.read()) == want and len(before.shards) >= 27
    after = shards.compact(target=60_000, min_runs=4, small=10_000)
    assert after.version > before.version and len(after.shards) < len(before.shards) / 2
    assert keys(shards.read()) == want and sum(s.rows for s in after.shards) == sum(want.values())
    assert all(s.bytes <= 1.3 * 60_000 for s in after.shards)
    assert keys(shards.read(before.version)) == want  # an older version still reads
    assert shards.vacuum() > 0
    assert keys(shards.read()) == want and shards.manifest(before.version) is None
    assert shards.vacuum() == 0


def test_large_runs_are_left_alone(make, shards):
    rng = random.Random(62)
    shards.append(make(rows(rng, 400)).coalesce(1), arrival_bytes=1 << 20)
    (large,) = shards.manifest().shards
    for k in range(4):
        shards.append(make(rows(rng, 5, 1000 * (k + 1))).coalesce(1))
    after = shards.compact(target=large.bytes, min_runs=4, small=1000)
    assert large in after.shards and len(after.shards) == 2


def test_tiers_by_size():
    runs = tuple(ts.Shard(f"s{i:03d}", 1, b) for i, b in enumerate([1, 1, 1, 1, 100, 110, 120, 90, 1000, 5000]))
    assert [[s.bytes for s in g] for g in ts.merges(runs, 8000, 4, 32, 0)] == [[1, 1, 1, 1], [90, 100, 110, 120]]
    assert ts.merges(runs[:3], 8000, 4, 32, 0) == []
    assert all(sum(s.bytes for s in g) <= 250 for g in ts.merges(runs, 250, 4, 32, 0))


def test_a_commit_is_atomic(make, shards):
    """Two writers that build on one version: one of them gets it, the other has to read anew."""
    shards.append(make([(1, "a")]))
    old = shards.manifest()
    mine = ts.Manifest(old.version + 1, old.schema, old.shards)
    assert shards.commit(mine) and not shards.commit(mine)
    shards.append(make([(2, "b")]))
    assert shards.manifest().version == old.version + 2 and {r.doc_id for r in shards.read().collect()} == {1, 2}
    assert shards.versions() == [1, 2, 3]


def test_rows_of_lost_tasks_are_in_no_version(make, shards, spark):
    shards.append(make([(1, "a")]))
    stray = make([(9, "stray")]).coalesce(1)
    stray.write.parquet(f"{shards.root}/shards/shard-stray.parquet")
    assert [r.doc_id for r in shards.read().collect()] == [1]
    assert shards.vacuum() == 1


def test_odd_rows_and_empty(make, odd_rows, shards):
    source = make(odd_rows, extra=True)
    shards.append(source)
    shards.append(source.limit(0))
    assert keys(shards.read()) == keys(source) and shards.read().columns == source.columns
    assert shards.versions() == [1, 2]
    shards.compact()
    assert keys(shards.read()) == keys(source)
    with pytest.raises(ValueError):
        shards.append(make([(1, "a")]))
    with pytest.raises(ValueError):
        shards.read(77)


def test_an_empty_table(make, shards):
    with pytest.raises(ValueError):
        shards.read()
    assert shards.compact() is None
    shards.append(make([]))
    assert shards.read().collect() == [] and shards.compact().shards == ()


def test_what_is_settled(make, shards):
    rng = random.Random(66)
    assert shards.settled()
    for k in range(6):
        shards.append(make(rows(rng, 40, 100 * k)).repartition(2))
    assert not shards.settled()
    shards.compact()
    assert shards.settled()
    m = shards.manifest()
    wrong = ts.Shard(m.shards[0].name, m.shards[0].rows, m.shards[0].bytes + 1)
    assert shards.commit(ts.Manifest(m.version + 1, m.schema, (wrong, *m.shards[1:]))) and not shards.settled()
