"""Pages behind a cursor hold what pages by offset hold, and read as few files far down as at the top."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lintlake.operators import memory as M
from lintlake.sources.pages import PagedTable
from lintlake.sources.store import Store


def test_pages_read_few_files(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("proposal_id"), F.timestamp_seconds(F.pmod(F.xxhash64("id"), F.lit(500))).alias("created_at"))
    paged = PagedTable(Store(spark, str(tmp_path / "s")), "p", "created_at", "proposal_id")
    paged.write(rows, 200)
    want = [r.proposal_id for r in rows.orderBy(F.desc("created_at"), F.desc("proposal_id")).collect()]
    cursor, files = None, []
    for k in range(0, 4000, 400):
        page, cursor = paged.page(50, cursor)
        assert [r.proposal_id for r in page.collect()] == want[k : k + 50]
        files.append(len(page.inputFiles()))
        # a cursor is a place in the order: go on behind a row further down
        at = rows.filter(F.col("proposal_id") == want[min(k + 399, 3999)]).select(F.unix_micros("created_at")).first()[0]
        cursor = [at, want[min(k + 399, 3999)]]
    assert max(files) <= 3
    assert paged.page(50, cursor)[0].count() == 0 and paged.page(50, cursor)[1] is None


def test_pages_with_nulls_ties_and_filters(spark, tmp_path):
    rng = random.Random(3)
    data = [(k, None if k % 9 == 0 else dt.date(2024, 1, 1 + rng.randrange(5)), "F" if rng.random() < 0.3 else "O", f"Fix {k % 4}") for k in range(300)]
    rows = spark.createDataFrame([*data, (None, None, "F", None)], "proposal_id long, created_at date, status string, title string")
    rows = rows.withColumns({"description": F.lit(""), "file_path": F.lit(None).cast("string")})
    paged = PagedTable(Store(spark, str(tmp_path / "s")), "p", "created_at", "proposal_id")
    paged.write(rows, 20)
    for text, eq in ((None, {}), (None, {"status": "F"}), ("fix 2", {"status": "F"}), ("none", {})):
        want = [r.proposal_id for r in M.search(rows, text, 1000, 0, **eq).collect()]
        got, cursor = [], None
        while True:
            page, cursor = M.search_after(paged, text, 30, cursor, **eq)
            if cursor is None:
                break
            got += [r.proposal_id for r in page.collect()]
        assert got == want


def test_rows_of_one_place_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame([("b", "x"), ("b", "x"), ("b", "x"), ("a", "y")], "time string, id string")
    paged = PagedTable(Store(spark, str(tmp_path / "s")), "p", "time", "id")
    paged.write(rows, 2)
    page, cursor = paged.page(2)
    assert page.count() == 3 and cursor == ["b", "x"]
    page, cursor = paged.page(2, cursor)
    assert [tuple(r) for r in page.collect()] == [("a", "y")]
    paged.write(rows.limit(0))
    page, cursor = paged.page(2)
    assert page.count() == 0 and cursor is None and page.columns == ["time", "id"]
