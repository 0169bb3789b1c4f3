"""Pieces leave a worker some documents at a time, with the line each begins at."""

from tracewright.operators import chunking


def test_batches_are_bounded_and_lines_right(spark, monkeypatch):
    seen = []
    frame = spark.createDataFrame([(i, "v", "a.md", "# a\n\nsome words here.\n" * (i % 7)) for i in range(300)], "id int, version string, path string, content string")
    kind = type(frame)
    original = kind.mapInArrow

    def spied(self, run, schema, *a, **b):
        import pyarrow as pa

        rows = self.toArrow().combine_chunks().to_batches()
        seen.append([r.num_rows for batch in rows for r in run(iter([pa.RecordBatch.from_struct_array(batch.to_struct_array())]))])
        return original(self, run, schema, *a, **b)

    monkeypatch.setattr(kind, "mapInArrow", spied)
    out = chunking.split(frame, 40).collect()
    assert len(seen[0]) >= 300 // chunking.PIECES and sum(seen[0]) == len(out)
    texts = {str(r["id"]): r["content"] for r in frame.collect()}
    assert all(r["line"] == texts[r["document_id"]].count("\n", 0, r["start"]) + 1 and r["content"] == texts[r["document_id"]][r["start"] : r["end"]] for r in out)
