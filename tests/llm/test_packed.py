"""The near-copy tables are written in files that follow their rows, not the tasks that make them."""

from collections import Counter
from pathlib import Path

import pytest

from docgraph.llm import near_copies, simhash
from docgraph.llm.common import packed, shared_dir

WIDE = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def many_tasks(spark):
    before = {k: spark.conf.get(k) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def folder(spark):
    return Path(shared_dir(spark).removeprefix("file:"))


def test_files_of_near_copies(many_tasks, sf_dir):
    docs = many_tasks.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(folder(many_tasks).iterdir())
    kept = simhash.deduplicate(docs)
    made = [d for d in folder(many_tasks).iterdir() if d not in before]
    names = Counter(d.name.rpartition("-")[0] for d in made)
    assert {"buckets", "candidates", "shingle-sets", "near-copies", "open-buckets", "links", "labels"} <= set(names)
    many = {d.name: n for d in made if not d.name.startswith("sketches-") and (n := len(list(d.glob("part-*")))) > 1}
    assert not many
    assert 0 < kept.count() < docs.count()


@pytest.mark.parametrize("n, files", [(0, 1), (1, 1), (10, 1), (11, 2), (95, 10)])
def test_rows_and_files(many_tasks, n, files):
    df = many_tasks.range(n).selectExpr("id", "if(id % 7 = 0, null, cast(id as string)) AS text", "cast(cast(id as string) as binary) AS raw").repartition(16, "id")
    got = packed(df, "made", 10)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))
    assert len(list(Path(got.stored_path.removeprefix("file:")).glob("part-*"))) <= files
    assert not df.storageLevel.useDisk


def test_components_over_many_files(many_tasks, monkeypatch):
    """Sets and links in files of three rows give what one file gives."""
    text = lambda k, at: " ".join(f"w{k}x{i}" if i != at else "changed" for i in range(90))
    table = many_tasks.createDataFrame([(i, str(i), text(i // 5, i)) for i in range(60)], "doc_id bigint, row_key string, text string")
    want = None
    for rows in (near_copies.FILE_SETS, 3):
        monkeypatch.setattr(near_copies, "FILE_SETS", rows)
        monkeypatch.setattr(packed, "__defaults__", (rows,))
        marked, roots = near_copies.components(table, 5, 0.8)
        got = sorted(map(tuple, marked.join(roots, "node", "left").selectExpr("doc_id", "coalesce(root, node)").collect()))
        assert len({r for _, r in got}) == 12
        assert want in (None, got)
        want = got
