"""Sentence pieces against the library: ids, spans, normalisation through compiled maps, decoding, and the query's digests."""

import hashlib
import random

import pytest
import sentencepiece

from fixturelake.llm import pieces
from fixturelake.llm.tokens import vocabulary_path

SCHEMA = "doc_id long, text string, ids string, begins int, lang string, n long"
ALPHABET = [*"abcdefgh the  \n\t.,;:1239ABCéüß漢字日本語العربية▁▁😀‍̀\x00⁇ﬁＡ　½①™", "<s>", "</s>", "<unk>", "<0x0A>", *"        "]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(pieces.MODEL))


def texts(n, seed=1, longest=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def with_normaliser(**spec):
    """The model with another normaliser, as the library compiles it."""
    with open(vocabulary_path(pieces.MODEL), "rb") as f:
        model = f.read()
    rules = sentencepiece.SentencePieceNormalizer(**spec).serialized_model_proto()
    own = b"".join(tagged(k, v) for k, v in pieces._fields(model) if k != 3)
    return own + b"".join(tagged(k, v) for k, v in pieces._fields(rules) if k == 3)


def tagged(field, value):
    size, out = len(value), b""
    while size > 127:
        out += bytes([size & 127 | 128])
        size >>= 7
    return bytes([field << 3 | 2]) + out + bytes([size]) + value


def spans(library, text):
    """Pieces' first bytes and ends by the library, which gives them in characters."""
    at = [len(text[:k].encode()) for k in range(len(text) + 1)]
    return [(at[a], at[b]) for a, b in library.encode_as_offset_mapping(text)["offsets"]]


def check(model, library, text):
    ids, begins, ends = model.encode(text)
    want = library.encode(text)
    assert list(ids) == want, text
    assert [(int(a), int(b)) for a, b in zip(begins, ends, strict=True)] == spans(library, text), text
    assert model.decode(ids) == library.decode(want), text
    assert model.digest(text)[:3] == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(library.decode(want).encode()).hexdigest()), text


def test_ids_spans_and_texts(library):
    model = pieces.model(vocabulary_path(pieces.MODEL))
    for text in [*texts(1500), " ", "  ", "▁", "\n", "a", " a", "x" * 3000, "ab" * 2500, " " * 500, "漢字" * 700, "".join(texts(200))]:
        check(model, library, text)
        assert model.digest(text)[3] == len(text.encode())


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_compiled_maps(rule, squeeze, prefix):
    blob = with_normaliser(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    model, library = pieces.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for text in [*texts(400, seed=3), "", " ", " \t　 ", "　Ａ　　ﬁ ½  ", "▁ ▁a", "é 한글 ㍿ ｶﾞ", "a  ​ b"]:
        assert model.normalised(text)[0].replace(" ", "▁") == library.normalize(text), text
        check(model, library, text)


def test_decoding_of_any_ids(library):
    model, rng = pieces.model(vocabulary_path(pieces.MODEL)), random.Random(4)
    for _ in range(1500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), 28705, rng.choice([0, 1, 2])]) for _ in range(rng.randint(0, 9))]
        assert model.decode(ids) == library.decode(ids), ids


def test_other_models_are_refused():
    with pytest.raises(ValueError, match="merged"):
        pieces.Model(sentencepiece.SentencePieceNormalizer(rule_name="nfkc").serialized_model_proto())


def test_digests_and_round_trip(spark, library):
    rows = [(k, t) for k, t in enumerate(texts(80, seed=5, longest=300))] + [(None, "no id"), (107, "twice"), (107, "twice"), (108, None), (109, ""), (110, "long text é漢 " * 60_000)]
    docs = spark.createDataFrame([(i, t, "x", 1, "en", 2) for i, t in rows], SCHEMA).repartition(3)
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert sorted(map(tuple, pieces.piece_digests(docs).collect()), key=str) == sorted(want, key=str)
    coded = pieces.encoded(docs.where("doc_id < 110"))
    back = {r.doc_id: r.text for r in pieces.decoded(coded).collect()}
    assert back == {i: (t or "").replace("▁", " ") for i, t in rows if i is not None and i < 110}
    assert pieces.piece_digests(docs.limit(0)).collect() == [] and pieces.encoded(docs.limit(0)).collect() == []
