import collections
import hashlib
import random
import re

from tidemark.llm import secrets
from tidemark.llm.queries import QUERIES

BASE = {
    "assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def plain(text):
    spans = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            if (len(m[2]) >= 6) if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                spans.append((m.start(), order, kind, m.end()))
    counts = collections.Counter(k for _, _, k, _ in spans)
    return tuple(counts[k] for k in BASE), ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def compare(found, rows):
    got = collections.Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found)
    want = collections.Counter((d, *plain(t)[0], hashlib.sha256(plain(t)[1].encode()).hexdigest()) for d, t in rows)
    assert got == want


def test_query_against_plain_python(spark, folder, texts):
    compare(QUERIES["op3_linked_secrets"](spark, folder).collect(), texts)


def test_random_texts_nulls_and_repeated_rows(frame):
    rng = random.Random(3)
    bits = ["password", "=", ": ", '"', " ", "token", "abcdef", "AKIA", "ABCD0123456789EFGH", "0123456789abcdef01234567", "\n\n", "é", "日", "user=bob", "https://h.x/y", "aZ3" * 9, "api_key", ".", "ſecret", "\n", "x"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))) for i in range(800)]
    rows += [(None, "password=abcdefg"), (5, None), (5, None), (7, "token=xxxxxxx"), (7, "token=xxxxxxx"), (9, "")]
    compare(secrets.digest(secrets.spans(frame(rows))).collect(), rows)


def found_spans(frame, text):
    return secrets.digest(secrets.spans(frame([(1, text)]))).collect()[0]["spans"]


def test_weak_candidates_need_a_complement_in_their_paragraph(frame):
    token = "aZ3bY4cX5dW6eV7fU8gT9"
    assert found_spans(frame, f"a {token} b") == ""
    assert found_spans(frame, f"user=bob then {token}") == "identifier:0:8,token:14:35"
    assert found_spans(frame, f"user=bob\n\nthen {token}") == ""
    assert found_spans(frame, f"user=bob {'x ' * 200}{token}") == ""
    assert found_spans(frame, "see https://h.x/y") == ""
    assert found_spans(frame, "https://h.x/y user=bob password=hunter22") == "endpoint:0:13,identifier:14:22,assign:23:40"


def test_redaction(frame):
    rows = [(1, "é password=abcdefg. end"), (2, "clean"), (3, None), (None, "token=xxxxxxx"), (4, "token=xxxxxxx"), (4, "token=xxxxxxx")]
    masked = secrets.redact(frame(rows))
    assert masked.columns == frame(rows).columns
    assert sorted(map(str, [(r["doc_id"], r["text"]) for r in masked.collect()])) == sorted(
        map(str, [(1, "é [secret] end"), (2, "clean"), (3, None), (None, "[secret]"), (4, "[secret]"), (4, "[secret]")])
    )


def test_no_python_on_the_main_path(spark, folder):
    plan = QUERIES["op3_linked_secrets"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_table(frame):
    assert secrets.digest(secrets.spans(frame([]))).collect() == []
