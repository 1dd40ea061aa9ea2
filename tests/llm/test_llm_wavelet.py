"""The wavelet matrix against plain lists, and files against the tokenizers library."""

import random
import zlib

import corpus
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from wirelens.llm import queries, wavelet
from wirelens.llm.common import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_access_rank_select():
    rng = np.random.default_rng(3)
    for n, top, bits in ((0, 1, 4), (1, 1, 1), (1700, 6, 3), (5000, 50_000, 16)):
        ids = rng.integers(0, top, n).astype(np.uint16)
        m = wavelet.WaveletMatrix.build(ids, bits)
        m = wavelet.WaveletMatrix(m.n, m.bits, m.zeros, m.planes.tobytes(), m.ranks.tobytes())
        assert (m.all() == ids).all()
        for value in {0, top, *ids[:5].tolist()}:
            places = np.flatnonzero(ids == value)
            if value < 1 << bits:
                assert m.count(value) == len(places)
                assert [m.select(value, k) for k in range(min(9, len(places)))] == places[:9].tolist()
                assert m.select(value, len(places)) == -1
                assert all(m.rank(value, i) == (ids[:i] == value).sum() for i in range(0, n, max(1, n // 7)))
        assert all(m.access(i) == ids[i] for i in range(0, n, max(1, n // 50)))


def expected(rows, end):
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    out, start = [], 0
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_equal_the_library(spark):
    rng = random.Random(8)
    rows = [*corpus.edges(), *[(100 + i, corpus.sentence(rng, rng.randint(0, 90)).title() + rng.choice(["", " ", "  ", "\n"])) for i in range(120)],
            (400, "<|endoftext|> is text"), (401, "\x00 \x00a"), (402, "y" * 3000)]
    out = Scratch(spark).path("wavelet-test")
    wavelet.write(corpus.frame(spark, rows), out, PATH, 2, shard_tokens=1500)
    files = wavelet.open_files(spark, out)
    assert files.count() > 3
    got = wavelet.crc32s(files).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(expected(rows, 2), key=repr)
    ends = sorted(p for r in wavelet.occurrences(files, 2).collect() for p in r["positions"])
    assert set(r["start"] + r["n_tokens"] - 1 for r in got) <= set(ends)


def test_query_equals_the_unmodified_library(spark):
    rows = [(1, "end <|endoftext|> next"), (2, "plain words here"), (3, "a<|endoftext|>b  <|endoftext|>"), (4, "<|endoftext| > no"), (5, "plain next"), (6, None)]
    folder = Scratch(spark).path("wavelet-docs")
    corpus.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    library, want, start = Tokenizer.from_file(PATH), [], 0
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert 50256 in library.encode(rows[0][1], add_special_tokens=False).ids
    assert sorted(map(tuple, queries.QUERIES["op9_wavelet_tokens"](spark, folder).collect())) == want


def test_added_token_with_a_space_inside(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    library.add_tokens(["two words"])
    library.save(str(tmp_path / "t.json"))
    encoder, library = wavelet.Encoder(str(tmp_path / "t.json"), added=True), Tokenizer.from_file(str(tmp_path / "t.json"))
    texts = ["one two three", "some words", "it is two words long", "words two", "two", "words"]
    for _ in range(2):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.batch(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_empty_table(spark):
    out = Scratch(spark).path("wavelet-empty")
    wavelet.write(corpus.frame(spark, []), out, PATH, 2)
    assert wavelet.crc32s(wavelet.open_files(spark, out)).count() == 0


def test_known_words_are_not_asked_again():
    encoder, library, asked = wavelet.Encoder(PATH), Tokenizer.from_file(PATH), []
    encoder.batch(["x alpha beta"])
    spaced = encoder._spaced
    encoder._spaced = lambda pieces: asked.extend(pieces) or spaced(pieces)
    text = "x alpha, beta.\nalpha beta*** alpha's"
    assert np.frombuffer(encoder.batch([text])[0], encoder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids
    assert not asked


def test_borders_inside_pieces():
    rng, encoder, library = random.Random(2), wavelet.Encoder(PATH), Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    signs = ["a", "s", "Re", "'", "'s", "'ll", " ", "\n", ",", ".", "é", "×", "ǅ", "9", "  ", "\n\n", "\t", "字", "_", "́", "<", "İ", "ɏ", "ɐ", "\r", "\x1c", "\x85", "t", "\n'", "²"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 14))) for _ in range(6000)]
    for at in range(0, len(texts), 1500):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.batch(texts[at : at + 1500])]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts[at : at + 1500]]


def test_a_full_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(wavelet, "MEMORY", 5)
    encoder, library = wavelet.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["one two, three.\nFour five", "six, two seven.\nOne eight! nine", "one,\nTwo.\nThree,\nFour", "ten"]
    for _ in range(2):
        got = [np.frombuffer(x, encoder.dtype).tolist() for x in encoder.batch(texts)]
        assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
