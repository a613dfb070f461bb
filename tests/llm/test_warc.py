import random
from collections import defaultdict

import pytest

from revaudit.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, first long"


def pages():
    rng = random.Random(3)
    text = ["<p>é</p>" * 50, None, "", "x" * 700_000, "\r\n\r\nWARC/1.1\r\n"] + [f"<a>{rng.random()}</a>" for _ in range(20)]
    out = [(i, f"http://e.x/{i}" if i % 3 else None, text[i % len(text)] if i < 40 else rng.choice(text), "z", 1) for i in range(60)]
    return out + [out[7], (None, "u", text[0], None, None), (None, None, "alone", None, None)]


@pytest.mark.parametrize("groups,share", [(100_000, 50_000), (0, 50_000), (0, 16)])  # all payloads broadcast, in either way; those of three rows and less joined
def test_round_trip(spark, monkeypatch, groups, share):
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(warc, "SHARE", share)
    df = spark.createDataFrame(pages(), SCHEMA).repartition(3)
    out = warc.round_trip(df, payloads=True).collect()
    assert len(out) == len(pages())
    least = defaultdict(list)
    for p in pages():
        if p[0] is not None:
            least[p[2] or ""].append(p[0])
    want = []
    for p in pages():
        body = (p[2] or "").encode()
        first = min(least[p[2] or ""], default=None)
        again = first is not None and p[0] != first
        want.append((str(p[0]), len(body), warc.sha1_base32(body), "revisit" if again else "response", first if again else None))
    assert sorted(map(str, want)) == sorted(str((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_reader_in_small_pieces():
    data = b"".join(warc.record(i, "u", bytes([65 + i]) * i * 1000, level=1) for i in range(6))
    for size in (1, 7, 100_000):
        found = [warc.parse(*x) for x in warc.read_records(data[k : k + size] for k in range(0, len(data), size))]
        assert [(f[0], f[2]) for f in found] == [(i, i * 1000) for i in range(6)]


@pytest.mark.parametrize("spoil", ["cut", "digest", "length"])
def test_damage(spoil):
    import zlib

    one = warc.record(1, "u", b"hello")
    if spoil == "cut":
        one = one[:-3]
    else:
        plain = zlib.decompress(one, 31).replace(b"hello", b"hullo" if spoil == "digest" else b"helloo")
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        one = z.compress(plain) + z.flush()
    with pytest.raises(ValueError):
        [warc.parse(*x) for x in warc.read_records([one])]
