import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revaudit.llm import bpe

from .fixtures import empty, frame, rows

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def peer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(peer, text):
    v = bpe.vocabulary(PATH, P.PATTERN)
    assert v.encode([text]) == [peer.encode_ordinary(text)]
    assert v.decode(v.encode([text])[0]) == text.encode()


def test_low_pattern_splits_alike():
    v = bpe.vocabulary(PATH, P.PATTERN)
    text = "".join(chr(i) for i in range(1, 0x250)) + " 's 'LL  x\n\n  y²³¼ ªº\x1c\x85\xa0z"
    assert v.find_low(text) == v.find_any(text)


def test_table(spark, peer):
    out = bpe.encode(frame(spark), PATH, P.PATTERN).collect()
    want = sorted((str(r[0]), peer.encode_ordinary(r[1] or "")) for r in rows())
    assert sorted((str(r.doc_id), r.ids) for r in out) == want and all(r.round_trip for r in out)
    back = bpe.decode(bpe.encode(frame(spark), PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows())
    assert bpe.encode(empty(spark), PATH, P.PATTERN).count() == 0


def test_workers_keep_no_pieces(monkeypatch):
    """A full cache keeps the pieces of the block at hand, never more than its bound, and none when a task has ended."""
    P = pytest.importorskip("public_tokenizers")
    path = P.path("byte_bpe_50k.tiktoken")
    monkeypatch.setattr(bpe, "CACHE_PIECES", 40)
    v = bpe.Vocabulary(path, P.PATTERN)
    blocks = [["the end of " + " ".join(f"w{k}x{i}" for i in range(6))] for k in range(8)]
    for block in blocks:
        got = v.encode(block)
        assert v.decode(got[0]).decode() == block[0] and len(v.known) <= 40 and " of" in v.known
    known = dict(v.known)
    v.forget()
    assert not v.known and v.encode(blocks[-1]) == got and v.known.items() <= known.items()
    ended = []
    monkeypatch.setattr(bpe, "map_rows", lambda *a, done, **b: ended.append(done))
    frame = type("Frame", (), {"schema": {"doc_id": type("Field", (), {"dataType": type("Kind", (), {"simpleString": staticmethod(lambda: "bigint")})})}})
    monkeypatch.setattr(bpe.F, "col", lambda c: c)
    bpe.encode(frame, path, P.PATTERN)
    bpe.vocabulary(path, P.PATTERN).encode(["a few words"])
    ended[0]()
    assert not bpe.vocabulary(path, P.PATTERN).known
