import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigclass.llm import exact_dedup as X
from sigclass.session import fresh_path


def brute(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    out = []
    for i, t, *_ in rows:
        g = groups[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows_against_brute_force(spark, docs_of, odd_rows):
    got = X.decisions(docs_of(odd_rows), X.new_index(spark)).collect()
    assert sorted(map(tuple, got), key=str) == brute(odd_rows)


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert X.decisions(docs_of([]), X.new_index(spark)).collect() == []
    d = docs_of([(1, "a"), (2, "a")]).withColumns({"digest": F.lit(1), "keep_id": F.lit(2), "kept": F.lit(3)})
    assert {(r.doc_id, r.kept) for r in X.decisions(d, X.new_index(spark)).collect()} == {(1, False), (2, True)}
    kept = X.keep_first_of_equal(d, X.new_index(spark))
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_pipeline_form_keeps_exactly_one_row_of_each_text(spark, docs_of, odd_rows):
    kept = X.keep_first_of_equal(docs_of(odd_rows), X.new_index(spark)).collect()
    texts = [r.text or "" for r in kept]
    assert len(texts) == len(set(texts)) == len({t or "" for _, t, *_ in odd_rows})


def test_index_persists_and_later_batches_meet_it(spark, docs_of):
    path = fresh_path(spark, "index-test")
    first = X.DigestIndex(spark, path, buckets=4)
    X.decisions(docs_of([(1, "a"), (2, "b"), (3, "a")]), first).collect()
    again = X.DigestIndex(spark, path, buckets=4)  # as another session would open it
    got = {r.doc_id: (r.keep_id, r.kept) for r in X.decisions(docs_of([(10, "a"), (11, "c"), (12, "c")]), again).collect()}
    assert got == {10: (3, False), 11: (12, False), 12: (12, True)}
    rows = again.rows().count()
    X.decisions(docs_of([(10, "a"), (11, "c"), (12, "c")]), again).collect()  # the batch again: nothing new
    assert rows == again.rows().count() == 3


def test_anti_join_does_not_move_the_index(spark, docs_of):
    index = X.DigestIndex(spark, fresh_path(spark, "index-plan"), buckets=4)
    groups = docs_of([(1, "a")]).select(X.digest().alias("digest"))
    plan = groups.repartition(4, "digest").join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange") == 1


def test_an_index_keeps_its_number_of_buckets(spark, docs_of):
    path = fresh_path(spark, "index-reopened")
    batch = lambda base: docs_of([(base + i, f"text {i}") for i in range(300)])
    X.decisions(batch(0), X.DigestIndex(spark, path, buckets=8)).collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    try:
        again = X.DigestIndex(spark, path)
        got = X.decisions(batch(1000), again).collect()
        assert again.buckets == 8 and not any(r.kept for r in got) and again.rows().count() == 300
        with pytest.raises(ValueError):
            X.DigestIndex(spark, path, buckets=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    again.close()
    assert not spark.catalog.tableExists(again.name)
    assert X.DigestIndex(spark, path).rows().select("digest").distinct().count() == 300


def test_a_compacted_index_is_neither_moved_nor_sorted(spark, docs_of):
    index = X.DigestIndex(spark, fresh_path(spark, "index-many"), buckets=3)
    for k in range(3):
        X.deduplicate(docs_of([(i, f"{i}") for i in range(10 * k, 10 * k + 15)]), index)
    small = index.compact(fresh_path(spark, "index-compact"))
    assert sorted(map(str, small.rows().collect())) == sorted(map(str, index.rows().collect()))
    with X._ordered_buckets(spark):
        plan = small.new_in(docs_of([(1, "a")]).select(X.digest().alias("digest")))._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin"):].split("Scan parquet")[1:]  # the index is the second child
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and side
    got = X.decisions(docs_of([(100 + i, f"{i}") for i in range(40)]), small).collect()
    assert sum(r.kept for r in got) == 5


def test_private_names_as_extra_columns(spark, docs_of):
    names = ["digest", "keep_id", "kept", "row", "id", "rows", "group_size", "keep_rows", "_digest", "_keep_id", "_keep_rows", "first_rows"]
    d = docs_of([(1, "a"), (2, "a"), (2, "a"), (3, None)]).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    got = X.keep_first_of_equal(d, X.new_index(spark))
    assert got.columns == d.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, d.where("doc_id > 1").distinct().collect()))
