"""What Python workers hold: batches of texts are bounded by bytes, and one operator's caches go when another's task begins."""

import pyarrow as pa
import pyspark.sql.functions as F
import public_tokenizers

from lexgrove.llm import packing, tokens
from lexgrove.llm.common import BATCH_BYTES, bounded, lean

PATH = public_tokenizers.path("word_bpe_49k.json")
SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_of_texts_are_bounded_by_bytes(spark):
    texts = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.rpad(F.col("id").cast("string"), 5000, "x").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "bytes"])

    before = spark.conf.get(SETTING, None)
    try:
        spark.conf.unset(SETTING)
        packing.token_pieces(texts)
        got = texts.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 3000 and len(got) >= 7
        assert max(r.bytes for r in got) < 1.1 * BATCH_BYTES
        spark.conf.set(SETTING, "123456789")
        bounded(texts)
        assert spark.conf.get(SETTING) == "123456789"
    finally:
        spark.conf.unset(SETTING) if before is None else spark.conf.set(SETTING, before)


def test_another_operators_task_forgets_the_vocabulary():
    def run(batches):
        yield from batches

    mine = tokens.word_ids(PATH)
    assert list(lean(uses=(tokens._tokenizer, tokens.word_ids))(run)(iter([1]))) == [1]
    assert tokens.word_ids(PATH) is mine
    assert list(lean(run)(iter([1]))) == [1]
    assert tokens.word_ids.cache_info().currsize == tokens._tokenizer.cache_info().currsize == 0


def test_a_worker_that_has_packed_keeps_no_chunks_for_the_next_stage(spark):
    docs = spark.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"))
    packing.token_pieces(docs).count()

    @lean
    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([tokens.word_ids.cache_info().currsize + tokens._tokenizer.cache_info().currsize])], ["n"])

    assert {r.n for r in docs.mapInArrow(held, "n long").collect()} == {0}
