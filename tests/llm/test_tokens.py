"""Encoders, token counts, packing and token files against the tokenizers library itself."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import awkward, prose, rows, table

P = pytest.importorskip("public_tokenizers")

from twinscan.llm.encoding import ByteEncoder, WordEncoder, load  # noqa: E402
from twinscan.llm.packing import _gathered, assemble, best_fit, pack, pack_documents, token_pieces  # noqa: E402
from twinscan.llm.token_counts import count_tokens, encode_long  # noqa: E402
from twinscan.llm.token_files import EliasFano, read_token_files, write_token_files  # noqa: E402

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def odd_texts(n, seed=3):
    rnd = random.Random(seed)
    signs = " \n\t\x1c\x1f ́aéZ9'sll<|>#\U0001f600\x00~²İΣ"
    special = ["<|endoftext|>", "<|startoftext|>"]
    return ["".join(rnd.choice(signs) if rnd.random() < 0.9 else rnd.choice(special) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("kind,path", [(WordEncoder, WORD), (ByteEncoder, BYTE)])
@pytest.mark.parametrize("remembered", [50, 100_000])
def test_encoders_equal_the_library(kind, path, remembered):
    encoder = kind(path, remembered)
    tokenizer = load(path)
    for seed in range(3):
        texts = [*odd_texts(400, seed), *[x for x in awkward()]]
        ids, counts = encoder.encode(pa.array(texts, pa.string()))
        for text, part in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == plain(tokenizer, text), text
        assert encoder.count(pa.array(texts, pa.string())).tolist() == counts.tolist()


@pytest.mark.parametrize("chunk,overlap,guard", [(200, 60, 20), (90, 50, 17), (400, 41, 20)])
def test_long_texts_are_spliced_exactly(chunk, overlap, guard):
    tokenizer = load(WORD)
    texts = [prose(1, 300), "a" * 1500, "ab " * 500, "é́" * 400 + " x " + "9" * 300, "".join(odd_texts(60)), prose(2, 20) + "z" * 700 + prose(3, 90), " " * 900]
    for text in texts:
        assert encode_long(tokenizer, text, chunk, overlap, guard).tolist() == plain(tokenizer, text)


@pytest.mark.parametrize("breaks", [True, False])
def test_long_texts_of_any_script_are_encoded_about_once(monkeypatch, breaks):
    from twinscan.llm import token_counts

    rnd = random.Random(4)
    text = "".join(chr(rnd.randrange(0x4E00, 0x9000)) + ("\n" if breaks and rnd.random() < 0.02 else "") for _ in range(60_000))
    tokenizer = load(WORD)
    expected = tokenizer.encode(text, add_special_tokens=False).ids
    read = []
    plain = token_counts._Chunk.__init__
    monkeypatch.setattr(token_counts._Chunk, "__init__", lambda self, t, x, a, b: (read.append(b - a), plain(self, t, x, a, b))[1])
    assert token_counts.encode_long(tokenizer, text, 4096, 256, 64).tolist() == expected
    assert sum(read) <= (2 if breaks else 5) * len(text)


def test_counts(spark):
    texts = awkward()
    tokenizer = load(WORD)
    found = rows(count_tokens(table(spark, texts), WORD, chunk=3000, overlap=200), "doc_id", "n_bytes", "n_tokens")
    assert sorted(found) == [(i, len((t or "").encode()), len(plain(tokenizer, t))) for i, t in enumerate(texts)]
    assert count_tokens(table(spark, []), WORD).count() == 0
    assert rows(count_tokens(table(spark, ["a", "a"], [None, None]), WORD), "doc_id", "n_tokens") == [(None, 1)] * 2


def test_best_fit_is_whole_and_tight():
    rnd = np.random.default_rng(1)
    sizes = rnd.integers(1, 101, 3000)
    bins = best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    assert max(sizes[b].sum() for b in bins) <= 100
    assert len(bins) <= sizes.sum() / 100 * 1.02 + 1


@pytest.mark.parametrize("fan_in,carried", [(2, 3), (16, 4096)])
def test_packing(spark, fan_in, carried):
    texts = awkward() * 4
    tokenizer = load(BYTE)
    ids = {i: [*plain(tokenizer, t), 2] for i, t in enumerate(texts)}
    pieces = token_pieces(table(spark, texts).repartition(5), BYTE, 64, 2)
    found = pack(pieces, 64, fan_in=fan_in, carried=carried).toPandas()
    for r in found.itertuples():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for doc, g in found.groupby("doc_id"):
        g = g.sort_values("piece")
        assert g["piece"].tolist() == list(range(len(g))) and g["length"].sum() == len(ids[doc])
        assert g["start"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and (g["length"][1:] == 64).all()
    for _, g in found.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 64 and g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert found["sequence_id"].nunique() <= found["length"].sum() / 64 * 1.1 + 2
    assert pack(token_pieces(table(spark, []), BYTE, 64, 2), 64).count() == 0


def test_packing_of_lengths_clustered_by_partition(spark):
    """Long pieces in some partitions and the short ones that fit them in others meet, however many there are."""
    lengths = [600] * 6000 + [400] * 6000
    schema = "doc_id long, piece int, start long, length int, ids_crc32 long"
    pieces = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], schema).coalesce(2)
    for carried in (4096, 100):
        found = pack(pieces, 1000, carried=carried).toPandas()
        assert sorted(found["doc_id"]) == list(range(len(lengths)))
        assert found.groupby("sequence_id")["length"].sum().max() <= 1000
        assert found["sequence_id"].nunique() <= 6000 * 1.02


def test_documents_are_cut_and_packed_in_one_python_pass(spark, monkeypatch):
    """A second pass would take a second worker for each core, kept for all later stages."""
    docs = table(spark, awkward() * 4).repartition(5)
    pieces = token_pieces(docs, BYTE, 64, 2)
    passes = []
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: (passes.append(schema), own(self, run, schema))[1])
    found = pack_documents(docs, BYTE, 64, 2)
    assert len(passes) == 1
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert sorted(rows(found, *names)) == sorted(rows(pieces, *names))
    for _, g in found.toPandas().groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 64 and g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
    assert found.select("sequence_id").distinct().count() == pack(pieces, 64).select("sequence_id").distinct().count()
    assert pack_documents(table(spark, []), BYTE, 64, 2).count() == 0


def test_small_batches_are_packed_together():
    batches = [pa.RecordBatch.from_pydict({"x": list(range(i, i + 3))}) for i in range(0, 12, 3)]
    assert [[r["x"] for r in held] for held in _gathered(batches, 5)] == [[0, 1, 2, 3, 4, 5], [6, 7, 8, 9, 10, 11]]
    assert [len(held) for held in _gathered(batches, 8)] == [9, 3] and list(_gathered([], 5)) == []


def test_assembled_sequences(spark):
    texts = [prose(i, 8) for i in range(9)]
    tokenizer = load(BYTE)
    pieces = token_pieces(table(spark, texts), BYTE, 64, 2, with_ids=True)
    packed = pack(pieces.drop("ids"), 64)
    made = b"".join(r["ids"] for r in assemble(pieces, packed).collect())
    assert sorted(np.frombuffer(made, "<u4")) == sorted(x for t in texts for x in [*plain(tokenizer, t), 2])


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [1, 2, 3, 1000], [7] * 70, list(range(0, 100_000, 97))])
def test_elias_fano(values):
    code = EliasFano.encode(np.array(values, np.int64))
    again = EliasFano(code.n, code.low_bits, code.low.tobytes(), code.high.tobytes())
    assert again.select(np.arange(len(values))).tolist() == values
    if len(values) > 200:
        assert 8 * (again.low.nbytes + again.high.nbytes) < len(values) * (3 + np.log2(values[-1] / len(values))) + 128
        assert again.select(np.array([len(values) // 2])).tolist() == [values[len(values) // 2]]


def test_token_files(spark, tmp_path):
    texts = awkward()
    keys = [None, *range(len(texts) - 1, 0, -1)]
    tokenizer = load(WORD)
    folder = str(tmp_path / "ids")
    write_token_files(table(spark, texts, keys), folder, WORD, 1, block_ids=500)
    found = read_token_files(spark, folder, with_ids=True).toPandas().sort_values("start")
    assert len(found) == len(texts)
    at = 0
    for r, (key, text) in zip(found.itertuples(), sorted(zip(keys, texts), key=lambda x: -1 if x[0] is None else x[0])):
        ids = np.array([*plain(tokenizer, text), 1], "<u4")
        assert (None if np.isnan(r.doc_id) else int(r.doc_id)) == key
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())) and r.ids == ids.tobytes()
        at += len(ids)
    write_token_files(table(spark, []), folder, WORD, 1)
    assert read_token_files(spark, folder).count() == 0
