"""Fill-in-middle against a plain loop over units."""

import hashlib
import random
import re

from siltstone.llm import fill_middle
from siltstone.llm.fill_middle import fill_in_middle, restored


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def corpus():
    rng = random.Random(8)
    odd = ["", " ", "a", "<P>", "x<S>y", "<", "<P", "P>", "\n\n\r\n", "ß é 😀x😀", "a" * 5000, "." * 640, "<S" * 70, "\0", "ﬁ", "ab" * 64 + "."]
    rows = [(k, t) for k, t in enumerate(odd)] + [(100 + k, t) for k in range(20) for t in odd[5:8]]
    for k in range(200):
        n = rng.choice([1, 3, 63, 64, 65, 127, 128, 129, 900])
        rows.append((1000 + k, "".join(rng.choice(["word", "Two", " ", ",", "é", "😀", "<", "\n"]) for _ in range(n))))
    rows += [(1, "other text of one id"), (1, "a"), (1, "a"), (None, "no id"), (None, None), (7, None), (None, "no id")]
    return [*rows, (9999, "long " * 200_000)]


def test_units_and_forms(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'k' AS key", "2 AS h1", "'f' AS form")
    want = sorted((plain(*r) for r in rows), key=repr)
    for most in (fill_middle.BROADCAST_TEXTS, 0):
        monkeypatch.setattr(fill_middle, "BROADCAST_TEXTS", most)
        made = fill_in_middle(docs)
        got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored(made.output, made.form).alias("back"), "text").collect()
        assert sorted((tuple(r)[:6] for r in got), key=repr) == want
        assert all(r.back == r.text for r in got)
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_no_rows(spark):
    assert fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).collect() == []
