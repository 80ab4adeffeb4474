import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terraloom.llm import token_files
from terraloom.llm.tokens import Coder, tokenizer_path
from terraloom.sources.files import scratch


@pytest.mark.parametrize("name, joined", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_as_the_whole_text(name, joined):
    draw, alphabet = random.Random(5), "ab Z'sßéΣİ\n\t  .,;  é中  \x1c\x85́ <|endoftext|> 's 12 |"
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "a", " ", "b.", "\n", "é"]
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randrange(30))) for _ in range(3000)] + ["<|endoftext|>", "a <|endoftext|> b", "x <|startoftext|> y", "", " ", "a  b", "x\n y", None]
    texts += ["".join(draw.choice(marks) for _ in range(draw.randrange(8))) for _ in range(1000)]
    coder, plain = Coder(tokenizer_path(name), joined, 2), Tokenizer.from_file(tokenizer_path(name))
    for text, ids in zip(texts, coder.encode(pa.array(texts))):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids + [2], text


def test_index_matches_the_documents_in_order(spark, odd_docs):
    coder = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = token_files.encode_and_index(odd_docs).collect()
    texts = {r.doc_id: r.text for r in odd_docs.collect() if r.doc_id is not None}
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            ids = np.array(coder.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == [None, None, 1, 1, 2, 3, 4, 5, 6, 7]
    assert token_files.encode_and_index(odd_docs.where("false")).count() == 0


def test_selective_reads_reach_the_scan_and_encodings_are_set(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    folder = scratch(spark, "tokens-test")
    token_files.write_tokens(df, folder)
    found = token_files.read_tokens(spark, folder, F.col("doc_id") == 1234, ["doc_id", "n_tokens"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(doc_id,1234)" in plan and "tokens:array" not in plan and found.count() == 1
    path = next(p for p in (f.replace("file:", "") for f in spark.read.parquet(folder).inputFiles()) if pq.ParquetFile(p).metadata.num_rows)
    group = pq.ParquetFile(path).metadata.row_group(0)
    kinds = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in kinds["doc_id"].encodings and kinds["doc_id"].has_offset_index and kinds["doc_id"].has_column_index
    assert any("DICTIONARY" in e for e in kinds["tokens.list.element"].encodings)


def test_a_batch_of_ids_stands_for_a_few_megabytes_of_text():
    texts = [f"word{i % 97} and some more text " * 4000 for i in range(120)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(120), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = list(token_files.token_batches(iter([batch]), tokenizer_path("byte_bpe_50k.json"), 2))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(120))
    assert max(sum(len(texts[i]) for i in b.column(0).to_pylist()) for b in out) <= 5_000_000
