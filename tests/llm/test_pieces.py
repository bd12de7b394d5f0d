"""SentencePiece codec against the library, its pieces against their definition."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.llm import pieces, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "aa", " ", "  ", "▁", "\n", "\t", "<s>", "<0x0A>", "é", "é", "中", "文", "\U0001f600", "\x00", "the", "ing", ".", ",", "-", "=", "====", "0", "12", "　"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.model(PATH)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(alphabet=st.characters(exclude_categories=["Cs"])), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_any_text(text):
    own, library = pieces.model(PATH), pieces.model(PATH).library
    assert own.encode(text) == library.encode(text)


def test_without_cuts(model, library):
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 80)))
        ids = [i for p in model.pieces(library.normalize(text)) for i in ([model.ids[p]] if p in model.ids else [model.bytes[b] for b in p.encode()])]
        assert ids == library.encode(text)


def test_takes_pieces_back(model):
    """On some words the longest piece leads nowhere, so backtracking is needed and tested."""
    greedy = 0
    for word in ("▁rewritingsly", "▁unbelievablest", "▁theyreabouts", "▁anothersings", "▁ofanattily", "▁thhaatering"):
        found, at, longest = model.pieces(word), 0, []
        while at < len(word):
            longest.append(next(word[at:e] for e in range(len(word), at, -1) if word[at:e] in model.cost or e == at + 1))
            at += len(longest[-1])
        greedy += found != longest
        assert found == model.remerge(word)
    assert greedy


def test_full_memory_changes_nothing(model, library, monkeypatch):
    monkeypatch.setattr(pieces, "SEGMENTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 2)
    own = pieces.PieceModel(PATH)
    text = "one two three four five six seven eight one two three unfathomable rewritings"
    assert own.encode(text) == library.encode(text)
    assert len(own.segments) <= 3 and len(own.pairs) <= 2


@pytest.mark.parametrize("text", ["a" * 200_000, "=-" * 100_000, "ab" * 100_000, "中文" * 50_000, " " * 100_000, "x " * 50_000])
def test_very_long(model, library, text):
    assert model.encode(text) == library.encode(text)


def test_other_models_are_refused(tmp_path):
    (tmp_path / "m").write_bytes(b"")
    with pytest.raises((ValueError, RuntimeError)):
        pieces.PieceModel(str(tmp_path / "m"))


def test_defined_cases(spark, library):
    rows = [(1, None, "x"), (2, "", "y"), (3, "same text", None), (3, "same text", "z"), (None, " two  spaces ", "w"), (4, "word " * 30_000, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, pieces.encode_documents(docs, PATH).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for key, text, _ in rows:
        ids = library.encode(text or "")
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=repr)
    assert not pieces.encode_documents(docs.where("false"), PATH).count()
    back = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((key or 0, library.decode(library.encode(text or ""))) for key, text, _ in rows)


def test_query_against_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").toPandas()
    ids = {d: library.encode(t or "") for d, t in zip(docs.doc_id, docs.text, strict=True)}
    got = queries.QUERIES["op11_sentencepiece_codec"](spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        own = ids[r.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(library.decode(own).encode()).hexdigest())
