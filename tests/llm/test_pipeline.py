"""The pipeline against plain versions of its stages."""

import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import public_tokenizers as vocabularies
import pyarrow as pa
from lamina.llm import byte_bpe, near_texts, source_mix
from lamina.session import materialize
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402
import test_near_texts as near  # noqa: E402


def test_workers_keep_nothing_of_other_stages(spark, sf_dir):
    """A worker that has coded texts and scored words holds neither table while it makes fingerprints."""

    def held(batches):
        from lamina.llm import byte_bpe, language_id

        path = vocabularies.path("byte_bpe_50k.tiktoken")
        for some in batches:
            byte_bpe._encoder(path, vocabularies.PATTERN)
            language_id._pieces(vocabularies.path("piece_bpe_32k.model"))
            list(near_texts._met(4)(iter([])))
            yield some.slice(0, 1).set_column(0, "id", pa.array([byte_bpe._encoder.cache_info().currsize + language_id._pieces.cache_info().currsize], pa.int64()))

    assert spark.range(1, numPartitions=1).mapInArrow(held, "id bigint").collect() == [(0,)]


def test_slices_give_memory_back(spark, monkeypatch):
    backs = []
    monkeypatch.setattr(byte_bpe, "give_back", lambda: backs.append(1))
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 4)
    code = byte_bpe.coder(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, ("n_tokens",))
    assert [len(x) for x in code.func(iter([pa.array(["one", "two", "three"])]))] == [3]
    assert len(backs) == 3


def test_what_is_coded_is_held_once(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_BYTES", 1 << 16)
    code = byte_bpe.coder(vocabularies.path("byte_bpe_50k.tiktoken"), vocabularies.PATTERN, ("ids",))
    text = " ".join(["one two three"] * 5_000)
    list(code.func(iter([pa.array([text])])))  # the worker's own tables
    before, made = pa.total_allocated_bytes(), code.func(iter([pa.array([text] * 100)]))
    out = next(made)
    assert out.nbytes > 4_000_000 and pa.total_allocated_bytes() - before < 1.5 * out.nbytes + 100 * len(text)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = docs.columns, [docs.toPandas()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        held.append(docs.toPandas())
    start, language, lines, texts, mixed, tokens = held
    assert all(list(frame.columns) == columns for frame in held[:-1])
    # texts with a letter stay, as they are
    lettered = {i for i, t in zip(start["doc_id"], start["text"]) if t and any(c.isalpha() for c in t)}
    assert set(language["doc_id"]) == lettered
    wanted = {i: (dropped, digest) for i, _, dropped, digest in brute.lines(list(zip(language["doc_id"], language["text"])))}
    assert {i: brute.sha(t) for i, t in zip(lines["doc_id"], lines["text"])} == {i: d for i, (_, d) in wanted.items()}
    assert all(len(t) == n for i, t, n in zip(lines["doc_id"], lines["text"], lines["n_chars"]) if wanted[i][0])
    rows = list(zip(lines["doc_id"], lines["text"]))
    first = near.firsts(rows, near.colliding(rows, near.similar(rows)))
    assert set(texts["doc_id"]) == first and len(texts) == len(first)
    counts = Counter(mixed["doc_id"])
    again = source_mix.mix_sources(spark.createDataFrame(texts)).toPandas()
    assert counts == Counter(again["doc_id"])
    assert sorted(zip(tokens["doc_id"], tokens["decoded_sha256"])) == sorted((i, brute.sha(t)) for i, t in zip(mixed["doc_id"], mixed["text"]))


def odd(spark, sf_dir):
    """Documents with nulls, empty and long texts, repeated rows, ties and columns whose names the stages use."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    some = docs.limit(1).collect()[0]
    rows = [(None, "A text without an id that is long enough to be kept by all.", None, None, None), (90_001, None, "en", "src0", 0), (90_002, "", None, "src1", 0)]
    rows += [(90_003, "word " * 30_000, "en", None, 150_000), (90_004, "x" * 200_000, "de", "src2", 200_000), (some["doc_id"], some["text"], some["lang"], some["source"], 1)] * 2
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    names = ["a.b", "ids", "n_tokens", "row", "doc", "key", "rate", "copy", "kept_id", "kept_text", "judged", "group", "Decoded_sha256"]
    return docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def test_stages_take_odd_rows_and_columns(spark, sf_dir):
    docs = odd(spark, sf_dir)
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() > 0
        if name != "byte_bpe":
            assert docs.columns == before, name
    assert {"n_tokens", "ids", "decoded_sha256", "a.b", "rate", "doc_id"} <= set(docs.columns) and "text" not in docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd(spark, sf_dir).limit(0), sf_dir).count() == 0, name


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0 and "n_tokens" in found.columns
