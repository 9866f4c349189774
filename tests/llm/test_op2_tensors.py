"""op2_media_columns stores its tensors."""

import glob
import json

from graphmill.llm import media, queries
from graphmill.scratch import scratch


def test_tensors_are_stored_for_all_documents(spark):
    kept = lambda: set(glob.glob(scratch(spark).removeprefix("file:") + "/media-features-*"))
    old = kept()
    out = queries.op2_media_columns(spark, "/root/testdata/sf0.001")
    (path,) = kept() - old
    stored = spark.read.parquet(path)
    assert json.loads(stored.schema["tensors"].metadata["ARROW:extension:metadata"])["shape"] == list(media.TENSOR_SHAPE)
    rows = stored.select("doc_id", "n_frames", "tensors", "spans", "feature").collect()
    assert len(rows) == out.count()
    for r in rows:
        assert len(r["tensors"]) == len(r["spans"]) == -(-r["n_frames"] // media.TENSOR_FRAMES)
        assert all(len(t) == media.TENSOR_FRAMES * media.MELS for t in r["tensors"])
