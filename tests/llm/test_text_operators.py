import math
import random
import sys
from pathlib import Path

import public_tokenizers as vocabularies
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from lamina.llm import byte_bpe, language_id, line_dedup, queries, simhash, substring_dedup
from lamina.llm.cuckoo import CuckooFilter

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, docs):
    return spark.createDataFrame([(i, t, None, None, 0) for i, t in docs], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return [(r["doc_id"], r["text"]) for r in rows]


def awkward(seed):
    """Texts that share, repeat and overlap passages, with odd ones among them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éa", "naïve", "x"]
    passages = [[rng.choice(words) for _ in range(rng.randrange(40, 130))] for _ in range(6)]
    docs = [(90, None), (91, ""), (92, " \n\t "), (93, "word"), (94, "same " * 300), (95, "same " * 170), (96, "a b " * 90)]
    for doc in range(40):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randrange(0, len(p) // 2)
                parts += p[a : a + rng.randrange(20, 130)]
            else:
                parts += [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        docs.append((doc, rng.choice([" ", "\n", "\x0b "]).join(parts)))
    docs += [(200, docs[8][1]), (201, docs[8][1]), (202, docs[9][1] + " "), (10, docs[7][1])]
    return docs


# Substring dedup ----------------------------------------------------------------------------------------------


def found_passages(spark, docs):
    made = substring_dedup.passage_dedup(table(spark, docs))
    kept = F.coalesce(F.sha2("kept_text", 256), "words_sha256")
    return sorted(map(tuple, made.select("doc_id", "n_words", "n_removed", kept).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_equal_brute_force(spark, seed):
    docs = awkward(seed)
    assert found_passages(spark, docs) == brute.passages(docs)


def test_passages_of_real_texts(spark, real):
    assert found_passages(spark, real) == brute.passages(real)


def test_small_shards_and_chunks(spark, monkeypatch):
    for name, value in (("SHARD_WORDS", 200), ("CHUNK_WORDS", 300), ("PASSAGE_WORDS", 60)):
        monkeypatch.setattr(substring_dedup, name, value)
    docs = awkward(3)
    assert found_passages(spark, docs) == brute.passages(docs)


def test_an_owner_of_many_passages_and_a_common_one(spark, monkeypatch):
    """A long owner whose passages fill several automata, a licence that nearly all hold, and many whole copies."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 400)
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", 900)
    monkeypatch.setattr(substring_dedup, "PASSAGE_WORDS", 120)
    rng = random.Random(2)
    long = [f"w{rng.randrange(3000)}" for _ in range(2_500)]
    licence = " ".join(f"l{i}" for i in range(70))
    docs = [(0, " ".join(long))] + [(i, " ".join(long[i * 30 : i * 30 + 90]) + f" own{i}") for i in range(1, 60)]
    docs += [(100 + i, f"start{i} {licence} end{i}") for i in range(80)] + [(300 + i, licence + " copy") for i in range(60)] + [(400 + i, None) for i in range(40)]
    assert found_passages(spark, docs) == brute.passages(docs)


def test_no_passages(spark):
    assert found_passages(spark, []) == []
    assert substring_dedup.passage_dedup(table(spark, [(None, "a b"), (1, "c")])).filter("doc_id is null").count() == 1


# Line dedup ---------------------------------------------------------------------------------------------------


def found_lines(df):
    return sorted(map(tuple, df.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()))


LINES = [
    (1, "A shared line of text\nmine\nA shared line of text"),
    (2, " a SHARED line of text\t\nother"),
    (3, None),
    (4, ""),
    (5, "short\nshort"),
    (6, "short"),
    (7, "äußerst Éa \n0123456789"),
    (8, "0123456789\r\näußerst Éa"),
    (9, "\n\n\n"),
    (10, "a shared line of text"),
    (10, "a shared line of text\nmore"),
]


def test_lines_equal_brute_force(spark, real):
    assert found_lines(line_dedup.dedup_lines(table(spark, LINES))) == brute.lines(LINES)
    assert found_lines(line_dedup.dedup_lines(table(spark, real))) == brute.lines(real)
    assert found_lines(line_dedup.dedup_lines(table(spark, []))) == []


def test_lines_of_many_shards(spark, monkeypatch, real):
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 7)
    monkeypatch.setattr(line_dedup, "ROWS_PER_CHUNK", 50)
    assert found_lines(line_dedup.dedup_lines(table(spark, real))) == brute.lines(real)


def test_deletion_undoes_what_a_document_caused(spark):
    docs = [d for d in LINES if d[0] != 10]
    held, more = table(spark, docs), table(spark, [(0, "a shared line of text\n0123456789")])
    index = line_dedup.LineIndex.build(held)
    before = found_lines(index.dedup(held))
    grown = index.insert(more)
    everything = [(0, "a shared line of text\n0123456789"), *docs]
    assert found_lines(grown.dedup(held.unionByName(more))) == brute.lines(everything)
    assert found_lines(grown.delete(more).dedup(held)) == before
    without = [d for d in docs if d[0] != 1]
    assert found_lines(grown.delete(more).delete(table(spark, [(1, None)])).dedup(table(spark, without))) == brute.lines(without)


def test_many_changes_touch_only_their_keys(spark, monkeypatch):
    """Rounds of insertions and deletions against an index that is built at once, with filters of several shards."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 9)
    rng = random.Random(4)
    lines = [f"a line of text number {i}" for i in range(40)]
    docs = {i: "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 6))) for i in range(30)}
    first = dict(list(docs.items())[:20])
    index = line_dedup.LineIndex.build(table(spark, first.items()))
    held = dict(first)
    for gone, come in (([3, 7], [20, 21]), ([0, 20, 99], [22, 3]), ([5], [23, 24, 25])):
        index = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
        held = {i: t for i, t in held.items() if i not in gone}
        index = index.insert(table(spark, [(i, docs[i]) for i in come]))
        held |= {i: docs[i] for i in come}
        whole = line_dedup.LineIndex.build(table(spark, held.items()))
        for ours, theirs in ((index.references, whole.references), (index.shared, whole.shared)):
            columns = theirs.columns
            assert sorted(map(str, ours.select(columns).collect())) == sorted(map(str, theirs.collect()))
        assert found_lines(index.dedup(table(spark, held.items()))) == brute.lines(list(held.items()))
    assert found_lines(index.compact().dedup(table(spark, held.items()))) == brute.lines(list(held.items()))
    with pytest.raises(ValueError):
        index.insert(table(spark, [(next(i for i in held if held[i]), "a line of text number 1\n" + "\n".join(lines))]))


def test_long_and_common_lines(spark):
    """One line in nearly every document, null ids, and a text of very many and very long lines."""
    docs = [(i, f"the licence line that all hold\nown line number {i}") for i in range(300)]
    docs += [(400, "\n".join(f"line {i % 700} of a long text" for i in range(20_000))), (401, "z" * 300_000), (402, "z" * 300_000)]
    assert found_lines(line_dedup.dedup_lines(table(spark, docs))) == brute.lines(docs)
    without = [(None, "the same line\nthe same line"), (None, "the same line"), (1, "the same line")]
    kept = line_dedup.dedup_lines(table(spark, without)).collect()
    assert sorted((r["row"]["doc_id"] or 0, r["n_dropped"]) for r in kept) == [(0, 1), (0, 2), (1, 0)]


def test_extra_columns_survive(spark):
    odd = table(spark, LINES[:2]).withColumn("a.b", F.lit(1)).withColumn("line_doc", F.lit(2)).withColumn("LINE_DROPS", F.lit(3)).withColumn("made", F.lit(4))
    assert line_dedup.dedup_lines(odd).select(F.col("row")["a.b"], "row.line_doc", "row.LINE_DROPS", "row.made").distinct().collect() == [(1, 2, 3, 4)]
    df = table(spark, LINES[:2]).withColumn("doc", F.lit(1)).withColumn("drops", F.lit("x")).withColumn("digest", F.lit(2))
    assert line_dedup.dedup_lines(df).select("row.doc", "row.drops", "row.digest").distinct().collect() == [(1, "x", 2)]


def test_cuckoo_filter_remembers_and_forgets():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(20_000)]
    made = CuckooFilter.sized(len(keys))
    made.insert(keys)
    again = CuckooFilter.from_bytes(made.to_bytes())
    assert again.contains(keys).all()
    others = [rng.getrandbits(64) - 2**63 for _ in range(20_000)]
    assert again.contains(others).mean() < 0.01
    again.delete(keys[:10_000])
    assert again.contains(keys[10_000:]).all() and again.contains(keys[:10_000]).mean() < 0.01


def test_full_filter_keeps_a_stash():
    made = CuckooFilter(1)
    made.insert(list(range(1, 20)))
    assert made.stash and CuckooFilter.from_bytes(made.to_bytes()).contains(list(range(1, 20))).all()
    made.delete(list(range(1, 20)))
    assert not made.stash and not made.table.any()


# SimHash ------------------------------------------------------------------------------------------------------


def found_simhash(df):
    rows = df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id").collect()
    return sorted(map(tuple, rows))


@pytest.mark.parametrize("pairs", [128, 2])
def test_near_duplicates_equal_brute_force(spark, pairs, real):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all of the other animals in the wood tonight".split()
    near = [(500 + k, " ".join([*base * 6, str(k)])) for k in range(12)]
    docs = [d for d in awkward(4) if d[0] != 10] + near + [(600, "a"), (601, "A"), (602, "B c"), (603, None)]
    found = simhash.near_duplicates(table(spark, docs), bucket_pairs=pairs)
    assert found_simhash(found) == brute.simhash(docs)
    assert found_simhash(simhash.near_duplicates(table(spark, real), bucket_pairs=pairs)) == brute.simhash(real)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_links_of_large_buckets_at_every_radius(spark, radius):
    """One bucket of fingerprints that differ in a few bits: midpoints give the components that pairs give."""
    rng = random.Random(radius)
    prints = {sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(60)}
    prints = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    links = [tuple(r) for r in simhash.near_links(nodes, radius, 2).collect()]
    near = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius]
    assert set(links) <= set(near) and brute.groups(links, prints) == brute.groups(near, prints)


def test_near_duplicates_of_odd_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = table(spark, [(2, text), (1, text), (3, "x" * 50_000), (4, None)]).withColumn("kept_id", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("fp", F.lit(3))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 4]


def test_masks_cover_every_pair_in_reach():
    masks = simhash.covering_masks(4)
    rng = random.Random(2)
    for _ in range(20_000):
        differ = sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5)))
        assert any(not differ & m for m in masks)


def test_one_of_each_group_stays(spark):
    docs = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "other words here now"), (None, "a b c d e f"), (7, None), (8, "")]
    kept = simhash.keep_one(table(spark, docs))
    assert kept.columns == table(spark, []).columns
    assert sorted(kept.select("doc_id").collect(), key=str) == sorted([(1,), (2,), (7,), (None,)], key=str)
    assert simhash.keep_one(table(spark, [])).count() == 0


# BPE ----------------------------------------------------------------------------------------------------------


def texts():
    rng = random.Random(3)
    odd = [None, "", " ", "  ", " a", "a ", "a  b", "I'll don't", "a" * 3000, " " * 500, "x\x1c y", "\x85 z", "½ ² 12", "日本語 🙂", "<|endoftext|>", "a \n \n b"]
    return odd + ["".join(rng.choice(" ab\n\té1 \x1c.'sS") for _ in range(rng.randrange(1, 40))) for _ in range(500)]


def test_bpe_equals_the_library(spark, real):
    path = vocabularies.path(queries.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    docs = list(enumerate(texts())) + [(10_000 + i, t) for i, t in real]
    found = {r["row"]["doc_id"]: r for r in byte_bpe.encode_documents(table(spark, docs), path, vocabularies.PATTERN).collect()}
    for doc, text in docs:
        wanted = library.encode_ordinary(text or "")
        assert found[doc]["ids"] == wanted and found[doc]["n_tokens"] == len(wanted)
        assert bytes(found[doc]["decoded"]) == (text or "").encode()
    digests = {r["doc_id"]: r for r in byte_bpe.encode_digests(table(spark, docs), path, vocabularies.PATTERN).collect()}
    for doc, text in docs:
        assert digests[doc]["ids_sha256"] == brute.sha(" ".join(map(str, found[doc]["ids"]))) and digests[doc]["decoded_sha256"] == brute.sha(text or "")
    assert byte_bpe.encode_digests(table(spark, []), path, vocabularies.PATTERN).count() == 0


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", 600)
    encoder = byte_bpe.Encoder(byte_bpe.Codec(byte_bpe._vocabulary(vocabularies.path(queries.VOCABULARY))), vocabularies.PATTERN)
    for text in ("one two three four", "five six", "one seven"):
        _, _, decoded = encoder.encode(pa.array([text]))
        assert decoded.to_pylist() == [text.encode()]


def test_a_full_table_keeps_the_pieces_of_most_slices(monkeypatch):
    """Words of every slice are encoded once, although rare ones fill the table again and again."""
    encoder = byte_bpe.Encoder(byte_bpe.Codec(byte_bpe._vocabulary(vocabularies.path(queries.VOCABULARY))), vocabularies.PATTERN)
    asked, tokens = [], encoder.codec.tokens
    monkeypatch.setattr(encoder.codec, "tokens", lambda pieces: (asked.extend(pieces.to_pylist()), tokens(pieces))[1])
    encoder.encode(pa.array([" ".join(f"x{chr(97 + i % 26)}q{chr(97 + i // 26)}z" for i in range(500))]))
    assert encoder.kept.nbytes / len(encoder.kept) < 80
    monkeypatch.setattr(byte_bpe, "KEPT_BYTES", encoder.kept.nbytes)
    for i in range(12):
        text = " oftenseen " + " ".join(f"r{chr(97 + i)}q{chr(97 + j % 26)}w{chr(97 + j // 26)}" for j in range(200))
        _, _, decoded = encoder.encode(pa.array([text]))
        assert decoded.to_pylist() == [text.encode()] and encoder.kept.nbytes <= byte_bpe.KEPT_BYTES
    assert asked.count(b" oftenseen") == 1 and len(asked) > len(encoder.kept)


def test_long_texts_are_cut_bit_by_bit(monkeypatch):
    path = vocabularies.path(queries.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    monkeypatch.setattr(byte_bpe, "CUT_CHARS", 9)
    monkeypatch.setattr(byte_bpe, "CUT_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "QUERY_BYTES", 8)
    encoder = byte_bpe.Encoder(byte_bpe.Codec(byte_bpe._vocabulary(path)), vocabularies.PATTERN)
    for some in (texts(), [], [None], texts()[:20]):
        ids, n, decoded = encoder.encode(pa.array(some, pa.string()))
        wanted = [library.encode_ordinary(t or "") for t in some]
        assert ids.to_pylist() == wanted and n.to_pylist() == list(map(len, wanted))
        assert encoder.written(ids).to_pylist() == [" ".join(map(str, w)) for w in wanted]
        assert decoded.to_pylist() == [(t or "").encode() for t in some]


def test_pieces_on_both_sides_of_long(monkeypatch):
    """Contracting a rank at a time gives what contracting a pair at a time gives."""
    vocabulary = byte_bpe._vocabulary(vocabularies.path(queries.VOCABULARY))
    library = tiktoken.Encoding("own", pat_str=vocabularies.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(8)
    pieces = ["".join(rng.choice("abcehinorst") for _ in range(n)) for n in (250, 255, 256, 257, 258, 300, 700)]
    pieces += ["".join(rng.choice(["ha", "a", "zz", "the"]) for _ in range(n)) for n in (90, 128, 260, 900)] + ["a" * n for n in (255, 256, 257, 4_001)]
    wanted = [library.encode_ordinary(p) for p in pieces]
    codec = byte_bpe.Codec(vocabulary)
    assert codec.encode([p.encode() for p in pieces]) == wanted
    monkeypatch.setattr(byte_bpe, "LONG_PIECE", 1)
    assert codec.encode([p.encode() for p in pieces]) == wanted
    assert codec.decode(wanted) == [p.encode() for p in pieces]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_ranks_are_ordered(name):
    ranks = byte_bpe.read_ranks(vocabularies.path(name))
    assert byte_bpe.is_ordered(ranks)
    singles = {bytes([b]): b for b in range(256)}
    assert not byte_bpe.is_ordered(singles | {b"abc": 256, b"bc": 257, b"ab": 258})


def test_odd_columns_pass_encoding(spark):
    docs = table(spark, [(1, "one two"), (1, "one two"), (None, None)]).withColumn("a.b", F.lit(1)).withColumn("ids", F.lit(2)).withColumn("coded", F.lit(3))
    found = byte_bpe.encode_documents(docs, vocabularies.path(queries.VOCABULARY), vocabularies.PATTERN).collect()
    assert sorted((r["row"]["doc_id"] or 0, len(r["ids"]), r["row"]["a.b"], r["row"]["ids"]) for r in found) == [(0, 0, 1, 2), (1, 2, 1, 2), (1, 2, 1, 2)]
    only = byte_bpe.encode_documents(docs.select("text"), vocabularies.path(queries.VOCABULARY), vocabularies.PATTERN, outputs=("n_tokens",))
    assert sorted(r["n_tokens"] for r in only.collect()) == [0, 2, 2]


# Language -----------------------------------------------------------------------------------------------------


def test_languages_of_held_out_texts(spark, sf_dir):
    found = queries.op4_language_id(spark, sf_dir)
    true = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    score = found.filter("held_out").join(true, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert score > 0.95 and found.count() == true.count()
    assert found.filter("score < 0 or score > 1").count() == 0


def test_odd_texts_and_no_model(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = vocabularies.path(queries.PIECES)
    model = language_id.fit(docs, path, train_docs=20)
    odd = [(1, None), (2, ""), (3, "123 ... !"), (4, "é"), (5, "word" * 5000), (6, "日本"), (6, "日本")]
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(table(spark, odd), model).collect()}
    assert [found[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert all(found[i][0] in model.languages and 0 < found[i][1] <= 1 for i in (4, 5, 6))
    assert language_id.accepted(table(spark, odd), model, 0.0).count() == 4
    none = language_id.fit(table(spark, odd), path)
    assert none.languages == [] and language_id.identify(table(spark, odd), none).filter("lang_pred = 'und'").count() == 7
    assert language_id.identify(table(spark, []), model).count() == 0


def _by_hand(pieces, word, probability, k):
    """log of the summed probability, one place after the other, in numbers without a least one."""
    from fractions import Fraction

    lattice = pieces.lattice([word])
    sums = [Fraction(1)] + [Fraction(0)] * len(word)
    for s, e, p in sorted(zip(lattice.start.tolist(), lattice.end.tolist(), lattice.which.tolist()), key=lambda x: x[1]):
        sums[e] += sums[s] * Fraction(probability[p, k])
    top, bottom = sums[-1].numerator, sums[-1].denominator
    cut = max(0, bottom.bit_length() - 900)
    return math.log(top >> cut) - math.log(bottom >> cut) if top >> cut else math.log(top) - math.log(bottom)


WORDS = ["hello", "the", "日本☃x", "ändern", "a" * 39, "a" * 40, "ab" * 40, "Donaudampfschifffahrtsgesellschaft" * 4, "日本語の文章" * 20]


@pytest.mark.parametrize("batch_chars", [1 << 16, 64, 20])
def test_forward_sums_all_segmentations(monkeypatch, batch_chars):
    """Words of all lengths are whole, also those that are taken part by part."""
    import numpy as np

    monkeypatch.setattr(language_id, "BATCH_CHARS", batch_chars)
    pieces = language_id._pieces(vocabularies.path(queries.PIECES))
    probability = np.random.default_rng(0).random((pieces.count, 2)) * 1e-2
    words = [language_id.MARK + w for w in WORDS]
    found = language_id.forward(pieces, words, probability)
    for word, row in zip(words, found):
        assert row == pytest.approx([_by_hand(pieces, word, probability, k) for k in range(2)])


def test_expected_counts_equal_all_segmentations():
    import numpy as np

    pieces = language_id._pieces(vocabularies.path(queries.PIECES))
    probability = np.random.default_rng(1).random((pieces.count, 1)) * 1e-2
    words, weights = [language_id.MARK + w for w in ("the", "one", "änd")], np.array([2.0, 1.0, 3.0])
    wanted = np.zeros(pieces.count)
    for word, weight in zip(words, weights):
        lattice = pieces.lattice([word])
        edges = list(zip(lattice.start.tolist(), lattice.end.tolist(), lattice.which.tolist()))

        def ways(at):
            return [[]] if at == len(word) else [[p, *rest] for s, e, p in edges if s == at for rest in ways(e)]

        every = [(way, np.prod(probability[way, 0])) for way in ways(0)]
        for way, chance in every:
            np.add.at(wanted, way, weight * chance / sum(c for _, c in every))
    assert language_id.expected(pieces, words, weights, probability) == pytest.approx(wanted)


def test_expected_counts_of_long_words_are_finite():
    import numpy as np

    pieces = language_id._pieces(vocabularies.path(queries.PIECES))
    flat = np.full((pieces.count, 1), 1.0 / pieces.count)
    found = language_id.expected(pieces, ["x" * 3000, "日本" * 900], np.array([1.0, 2.0]), flat)
    assert np.isfinite(found).all() and 1_000 < found.sum() < 3_000 + 2 * 1_800


def test_language_model_scores_whole_texts(spark, sf_dir):
    """Whole predictions against sums that are made word by word."""
    import numpy as np

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, vocabularies.path(queries.PIECES), train_docs=30)
    assert model.probability.sum(axis=0) == pytest.approx(1.0)
    rows = docs.orderBy("doc_id").limit(25).collect()
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spark.createDataFrame(rows), model).collect()}
    pieces = language_id._pieces(model.path)
    for r in rows:
        words = (r["text"] or "").split()
        if words and any(c.isalpha() for c in r["text"]):
            logs = np.sum([[_by_hand(pieces, language_id.MARK + w, model.probability, k) for k in range(len(model.languages))] for w in words[:400]], axis=0)
            if len(words) <= 400:
                assert found[r["doc_id"]][0] == model.languages[int(np.argmax(logs))]
                assert found[r["doc_id"]][1] == pytest.approx(1 / np.exp(logs - logs.max()).sum())


def test_odd_columns_pass_language_identification(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, vocabularies.path(queries.PIECES), train_docs=20)
    odd = docs.withColumn("a.b", F.lit(1)).withColumn("judged", F.lit(2)).withColumn("row", F.lit(3)).withColumn("lang_pred", F.lit(4))
    kept = language_id.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == language_id.accepted(docs, model).count() > 0
    assert language_id.accepted(odd.limit(0), model).count() == 0
