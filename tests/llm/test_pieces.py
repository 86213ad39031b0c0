import random
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest
import sentencepiece

from codestrata.llm import models
from codestrata.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    return Path(models.MODEL).read_bytes()


def samples():
    rng = random.Random(1)
    odd = [None, "", " ", "  a  b ", "\n\n x", "a" * 300, "ab" * 100 + " " * 40 + "x", "日本語 テスト", "<0x41> <s> </s> <unk>", "\tif x == 1:\r\n\t\treturn  foo(bar)", "émigré “q” … 😀😁", "internationalization " * 9]
    odd += ["".join(rng.choice("aeiou nrst\né") for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    odd += ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(60, 400))) for _ in range(30)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x3000, 0x4000), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(40)]
    return odd


def test_ids_equal_the_public_library_and_decode_exactly(model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = samples()
    ids = P.Encoder(model)(pa.array(texts, pa.string())).to_pylist()
    assert ids == [None if t is None else library.encode(t) for t in texts]
    assert P.Decoder(model)(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == texts


def test_memory_bound_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(P.W, "VOCABULARY", 5)
    encoder, texts = P.Encoder(model), samples()
    whole = P.Encoder(model)(pa.array(texts, pa.string())).to_pylist()
    assert [encoder(pa.array([t], pa.string())).to_pylist()[0] for t in texts] == whole


def test_frames(odd_docs, odd_rows, no_docs):
    back = P.decode(P.encode(odd_docs.withColumnRenamed("text", "given"), "given"))
    assert {"given", "ids", "text", "id", "row"} <= set(back.columns)
    rows = back.collect()
    assert len(rows) == len(odd_rows) and all(r.text == r.given for r in rows)
    assert P.encode(no_docs).count() == 0
    assert P.encode(odd_docs, ids="n").columns.count("n") == 1


def test_runs_inside_one_text_change_nothing(model, monkeypatch):
    monkeypatch.setattr(P, "RUN", 7)
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = samples()
    assert P.Encoder(model)(pa.array(texts, pa.string())).to_pylist() == [None if t is None else library.encode(t) for t in texts]


def test_a_long_text_of_fresh_words_takes_little_memory(model):
    code = """
import random, resource, sys
import pyarrow as pa
from pathlib import Path
from codestrata.llm import models, pieces as P
rng = random.Random(2)
text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(660_000))
encoder = P.Encoder(Path(models.MODEL).read_bytes())
encoder(pa.array(["a"]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert len(encoder(pa.array([text]))[0]) > 660_000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    grown = subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, text=True, cwd=Path(__file__).parents[2]).stdout
    assert int(grown) < 400, grown


def test_bytes_that_are_no_text_decode_row_by_row(model):
    decoder, library = P.Decoder(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    byte = {int(library.id_to_piece(i)[1:-1], 16): i for i in range(library.vocab_size()) if library.is_byte(i)}
    snow = "☃".encode()
    rows = [[], None, library.encode("é ☃ x"), [byte[snow[0]]], [byte[b] for b in snow[1:]], [byte[0x20]], library.encode(" two"), [byte[0xFF], *library.encode("a")]]
    want = [None if r is None else b"".join(decoder_bytes(library, i) for i in r).decode("utf-8", "replace").removeprefix(" ") for r in rows]
    for some in (rows, rows[:3], rows[5:7], rows[3:5], []):
        got = decoder(pa.array(some, pa.list_(pa.int32())))
        got.validate(full=True)
        assert got.to_pylist() == [w for r, w in zip(rows, want) if any(r is s for s in some)]


def decoder_bytes(library, i):
    name = library.id_to_piece(i)
    return bytes([int(name[1:-1], 16)]) if library.is_byte(i) else name.replace("▁", " ").encode()


def test_units_are_indexed_by_what_is_new(model, monkeypatch):
    """Texts of three runs' length with few different words are one index, and ids are joined by row groups."""
    sizes, learn = [], P.Encoder._learn
    monkeypatch.setattr(P.Encoder, "_learn", lambda self, new: sizes.append(len(new)) or learn(self, new))
    encoder = P.Encoder(model)
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=100)) for _ in range(2500)]
    ids = encoder(pa.array(texts))
    assert sum(map(len, texts)) > 2 * P.RUN and len(sizes) == 1, sizes
    assert P.Decoder(model)(ids).to_pylist() == texts
