"""What a Python worker holds at a time."""

import pyarrow as pa

from tessella.llm import common, tokens


def test_batches_are_bounded_in_bytes(spark):
    """Long rows come in batches of a few MB, whatever Spark's limit of rows; all of them come."""
    docs = spark.range(24, numPartitions=1).selectExpr("id AS doc_id", "repeat('x', 1000000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "size": [b.nbytes]})

    got = common.in_arrow(docs, sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 24 and max(r.size for r in got) <= common.BATCH_BYTES + 2_000_000


def test_another_operators_task_frees_the_encoder(spark):
    """An encoder lasts from task to task of the operators that use one, and goes when another's task begins."""
    path = tokens.tokenizer_path("word_bpe_49k.json")
    held = tokens.encoder(path)
    common.release(tokens.KEPT)
    assert tokens.encoder(path) is held
    common.release()
    assert not any(common._KEPT.values()) and tokens.encoder(path) is not held

    def keeps(batches):
        for b in batches:
            tokens.encoder(tokens.tokenizer_path("word_bpe_49k.json")).encode(["a word"])
            yield pa.RecordBatch.from_pydict({"n": [len(common._KEPT.get(tokens.KEPT, {}))]})

    def other(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(map(len, common._KEPT.values()))]})

    rows = spark.range(4, numPartitions=4)
    assert {r.n for r in common.in_arrow(rows, keeps, "n long", tokens.KEPT).collect()} == {1}
    assert {r.n for r in common.in_arrow(rows, other, "n long").collect()} == {0}
