import math
import random
import struct

import public_tokenizers
import pytest
import sentencepiece

from packetlog.llm import sentencepiece_fst as fst

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def ours():
    return fst.Transducer(fst.load_model(PATH))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_as_the_library(ours, library):
    rng = random.Random(6)
    pool = [" ", "  ", "   ", "\n", "\t", "a", "the", "▁", "é", "漢", "😀", "123", "!!", "\x00", "ab", "aa", "aaaa", "==", "====", "ing", "tion",
            "Weltanschauung", " leur", "ción", "ß", "​", "½", "ﬁ", "Å", "x" * 100]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        ids = ours.encode(text)
        assert ids == library.encode(text), repr(text)
        assert ours.decode(ids) == library.decode(ids), repr(text)


def test_broken_bytes_decode_to_replacement_characters(ours):
    assert ours.decode([ours.byte[0xE2], ours.byte[0x82]]) == "�"


def test_unigram_weights_take_the_cheapest_path():
    pieces = [("<unk>", 0.0, 2), ("▁", -1.0, 1), ("▁a", -1.5, 1), ("b", -2.0, 1), ("ab", -2.2, 1), ("▁ab", -5.0, 1), ("a", -9.0, 1)]
    t = fst.Transducer({"pieces": pieces, "bpe": False, "prefix": True})
    assert [t.text[k] for k in t.encode("ab")] == ["▁", "ab"]
    assert t.encode("ab?") == [1, 4, 0]


def test_operator_and_round_trip(spark, docs, empty):
    texts = ["", None, "Hello  world\n", "naïve 漢字 😀", " lead and trail ", "Hello  world\n", "word " * 3000]
    found = fst.encode(docs([*enumerate(texts), (None, "x")]), PATH)
    rows = {r.doc_id: r for r in found.collect()}
    assert all(r.round_trip for r in rows.values()) and rows[0].n_tokens == rows[1].n_tokens == 0 and rows[2].ids == rows[5].ids
    back = {r.doc_id: r.text for r in fst.decode(found, PATH).collect()}
    assert back == {**{k: t or "" for k, t in enumerate(texts)}, None: "x"}
    assert fst.encode(empty, PATH).count() == 0 == fst.decode(found.where("false"), PATH).count()


PROBES = ["  Ａｂｃ  ﬁne Ⅳ ½   x　y  ", "ＨＥＬＬＯ Straße İstanbul", "\t\n tabs", "カﾞ ｶﾞ", "áé ẛ̣", "", "   ", "▁x ▁", "a", " ", "don't  stop\u00a0now", "漢字😀", "é" * 50]


def _field(number, payload):
    size, head = len(payload), bytes([number << 3 | 2])
    while size > 127:
        head, size = head + bytes([size & 127 | 128]), size >> 7
    return head + bytes([size]) + payload


def _same(path, texts):
    ours, library = fst.Transducer(fst.load_model(str(path))), sentencepiece.SentencePieceProcessor(model_file=str(path))
    for text in texts:
        assert ours.encode(text) == library.encode(text), repr(text[:80])
    return ours


def _sentences(n):
    import duckdb
    return [t for (t,) in duckdb.sql(f"select left(text, 600) from '/root/testdata/sf0.01/documents.parquet' where text is not null order by doc_id limit {n}").fetchall()]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nmt_nfkc_cf", "identity"])
def test_model_with_a_normaliser(tmp_path, rule):
    more = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    with open(PATH, "rb") as fh:
        (tmp_path / "m").write_bytes(fh.read() + more.serialized_model_proto())
    assert bool(_same(tmp_path / "m", PROBES + _sentences(100)).normal.hits) == (rule != "identity")


@pytest.mark.parametrize("bytes_too", [True, False])
def test_unigram_model_as_the_library(tmp_path, bytes_too):
    """Pieces of the model at hand under scores of a unigram model."""
    rng, raw = random.Random(1), b""
    for k, (piece, _, kind) in enumerate(fst.load_model(PATH)["pieces"]):
        if kind == fst.BYTE and not bytes_too:
            continue
        raw += _field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -math.log(k + 2) - rng.random()) + bytes([0x18, kind]))
    raw += _field(2, bytes([0x18, 1]) + (b"\x98\x02\x01" if bytes_too else b""))
    with open(PATH, "rb") as fh:
        normaliser = [v for n, v in fst._fields(fh.read()) if n == fst.NORMALIZER]
    (tmp_path / "m").write_bytes(raw + b"".join(_field(3, bytes(v)) for v in normaliser))
    ours, library = fst.Transducer(fst.load_model(str(tmp_path / "m"))), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    for text in PROBES + _sentences(200):
        mine, its = ours.encode(text), library.encode(text)
        if mine != its:  # equal sums: the library adds in single precision
            weigh = lambda ids: sum(library.get_score(k) for k in ids)
            assert math.isclose(weigh(mine), weigh(its), abs_tol=1e-3) and library.decode(mine) == library.decode(its), repr(text[:80])


def test_one_path_has_a_finite_weight(ours):
    """The minimum over all paths of a BPE composition, by trying all of them."""
    def paths(word, at, before):
        if at == len(word):
            yield []
            return
        for piece in ours.arcs(word, at):
            if ours.compatible(before, piece):
                for rest in paths(word, at + len(piece), piece):
                    yield [piece, *rest]

    rng = random.Random(2)
    for text in ["aaaa", "====", "ation", "the", "▁▁▁", "漢a😀", "ouedout"] + ["".join(rng.choice("aeintosr▁é漢") for _ in range(rng.randint(1, 9))) for _ in range(300)]:
        assert list(paths(text, 0, "")) == [ours.merged_path(text)], text


def test_very_long_words(ours, library, monkeypatch):
    rng = random.Random(3)
    for text in ("a" * 20_001, "".join(rng.choice("abcdefgh") for _ in range(20_000))):
        assert ours.encode(text) == library.encode(text)
    monkeypatch.setattr(fst, "MEMO", 5)  # generations of the memo
    for text in _sentences(30):
        assert ours.encode(text) == library.encode(text)
