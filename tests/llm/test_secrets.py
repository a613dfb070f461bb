import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from revaudit.llm import secrets

from .fixtures import empty, frame, rows

PIECES = ["password", "PASSWD", "secret", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "AKIA", "ABCD12", "0123456789abcdef", "é", "ghp_", "a" * 36, "eyJ", ".", "-----BEGIN RSA PRIVATE KEY-----", "sk_live_", "xoxb-", "\n", "f00d", "😀"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16))
def test_spans_equal_brute_force(parts):
    scanner, text = secrets.compile_rules(secrets.RULES), "".join(parts)
    data = text.encode()
    found = [(secrets.RULES[k].kind, a, b) for a, k, b in secrets.to_code_points(data, secrets.spans(scanner, data))]
    assert found == secrets.brute_force(text)


def test_table(spark):
    out = secrets.digest(secrets.scan_secrets(frame(spark))).collect()
    assert len(out) == len(rows())
    want = sorted((str(r[0]), secrets.sha([x for x in secrets.brute_force(r[1]) if x[0] in ("assign", "access", "hex")]), ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.brute_force(r[1]))) for r in rows())
    assert sorted((str(r.doc_id), r.base_sha256, r.spans) for r in out) == want
    assert sum(r.n_assign for r in out) == 2 and sum(r.n_access for r in out) == 1
    assert secrets.digest(secrets.scan_secrets(empty(spark))).count() == 0


def test_bad_rules():
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("nested", "abcd|bc"),))
    with pytest.raises(ValueError):
        secrets.compile_rules((secrets.Rule("empty", "a*"),))


def test_minimal_automaton():
    a = secrets.determinise([secrets._positions("(ab|ac|ad)x", False)], True)
    assert len(a.steps) // a.width == 5  # start, dead, after a, before x, end
