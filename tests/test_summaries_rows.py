import pyarrow as pa

from corpuslens.operators import summaries as Z


def test_slices_are_bounded_and_whole():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(a, b))}) for a, b in ((0, 200), (200, 200), (200, 201))]
    parts = list(Z._slices(iter(batches)))
    assert max(p.num_rows for p in parts) == Z.SLICE
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(201))


def test_no_more_than_a_slice_is_python_objects(spark):
    """Every batch that a ranking makes comes back before the next slice is read."""
    text = "One two three. Four five six. Seven two one. Eight five. Nine ten."
    docs = spark.createDataFrame([(i, text) for i in range(3 * Z.SLICE + 5)], "doc_id long, text string").coalesce(1)
    for method in Z.METHODS:
        sizes = Z.ranked(docs, method)
        assert sizes.count() == 3 * Z.SLICE + 5
        assert sizes.select("summary", "picks").distinct().count() == 1
