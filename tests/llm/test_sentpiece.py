import hashlib
import random

import pytest
import sentencepiece

from waveloom.llm.sentpiece import Normaliser, SpanEncoder, decode_ids, encode_spans
from waveloom.llm.tokens import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_digests_against_library(edge_docs, docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (edge_docs, docs, edge_docs.union(edge_docs)):
        want = []
        for r in df.select("doc_id", "text").collect():
            ids = sp.encode(r.text or "")
            want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))))
        got = encode_spans(df, digests=True).collect()
        assert sorted(tuple(r)[:4] for r in got) == sorted(want)


def test_spans_cover_texts_and_decode(edge_docs, docs):
    df = edge_docs.select("doc_id", "text").union(docs.select("doc_id", "text"))
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, []).append(r.text or "")
    encoded = encode_spans(df)
    for r in encoded.collect():
        fits = []
        for text in texts[r.doc_id]:
            data = text.encode()
            fits.append(bool(data) == bool(r.ids) and (not data or (r.starts[0] == 0 and r.ends[-1] == len(data))) and all(a == b for a, b in zip(r.ends, r.starts[1:])) and b"".join(data[a:b] for a, b in zip(r.starts, r.ends)) == data)
        assert any(fits), r.doc_id
    decoded = sorted((r.doc_id, r.text) for r in decode_ids(encoded).collect())
    assert decoded == sorted((i, t) for i, held in texts.items() for t in held)


def test_empty(no_docs):
    assert encode_spans(no_docs).collect() == [] and encode_spans(no_docs, digests=True).collect() == []


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "identity"])
@pytest.mark.parametrize("prefix,squeeze,escape", [(True, True, True), (False, True, True), (True, False, True), (False, False, False)])
def test_character_map_against_library(rule, prefix, squeeze, escape):
    """The library's own normaliser, built from its compiled rules."""
    from sentencepiece import sentencepiece_model_pb2

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=escape)
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(library.serialized_model_proto())
    ours = Normaliser(model.normalizer_spec)
    draw = random.Random(5)
    alphabet = "ab Z  é́ﬁ①㍿ｶﾞ한글　 \t\nΩǅ½™漢🙂"
    for text in ["", " ", "  a  b  ", "ﬁne ①②", "ｶﾞｷﾞ", *("".join(draw.choices(alphabet, k=draw.randrange(1, 30))) for _ in range(200))]:
        normal, offsets = library.normalize(text, with_offsets=True)
        mine, align = ours(text.encode())
        assert mine.decode() == normal, (text, normal, mine.decode())
        # the library tells code point offsets; ours are bytes of the text
        at = 0
        for c, offset in zip(normal, offsets):
            assert len(text.encode()[: align[at]].decode()) == offset, (text, normal, offsets)
            at += len(c.encode())


def test_byte_pieces_share_a_character():
    e = SpanEncoder(MODEL)
    text = "a 𓀀"
    ids = e.ids([text])[0]
    starts, ends = e.spans(text, ids)
    assert ends[-1] == len(text.encode()) and list(starts[1:]) == list(ends[:-1])
