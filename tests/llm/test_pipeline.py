"""The pipeline's stages against plain versions on a small corpus, and its driver on written tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from siltstone.llm.line_dedup import line_dedup
from siltstone.llm.mixing import leaf_budgets, mix_sources
from siltstone.llm.quality import RULES, STOP_WORDS, quality_rules
from tests.llm.test_ngram_join import plain_sets
from tests.llm.test_tokens import WORD as VOCABULARY
from tests.llm.test_tokens import check_packing

WORD = r"[^\x20\x09-\x0D]+"
SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=11):
    rng = random.Random(seed)
    stop = ["the", "of", "and", "to", "in", "is"]
    vocabulary = [f"word{i}" for i in range(900)]

    def line(n):
        return " ".join(rng.choice(stop) if rng.random() < 0.3 else rng.choice(vocabulary) for _ in range(n))

    passages = ["\n".join(line(rng.randint(8, 25)) for _ in range(3)) for _ in range(3)]
    rows = []
    for i in range(160):
        lines = [line(rng.randint(3, 40)) for _ in range(rng.randint(3, 9))]
        if i % 3 == 0:
            lines.insert(rng.randrange(len(lines)), rng.choice(passages))
        if i % 7 == 0:
            lines = ["$$$ " + x.replace(" ", " %% ") for x in lines]
        text = "\n".join(lines)
        if i % 5 == 4 and i > 20:
            words = rows[i - 15][1].split(" ")  # a near copy, in other lines
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words).replace("\n", " ")
        if i % 11 == 10:
            text = rows[i - 10][1]
        rows.append((i * 2, text, rng.choice(["en", "en", "de", None]), f"src{rng.choice([0, 0, 1, 2, 3])}", len(text)))
    rows += [(1000, None, "en", "src0", None), (1001, "", "en", None, 0), (1002, "too short", "en", "src1", 9), rows[3], (None, rows[4][1], "en", "src2", 1)]
    return rows


# --- plain versions


def plain_quality(text):
    w = re.findall(WORD, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            covered |= {i, i + 1, i + 2}
    n, k = len(w), max(1, len(lines))
    found = {
        "n_words": n,
        "word_chars": sum(map(len, w)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }
    ratios = {
        "n_words": n,
        "mean_word_length": found["word_chars"] / max(1, n),
        "symbol_ratio": found["n_symbols"] / max(1, n),
        "stop_ratio": sum(x.lower().rstrip(".,;:") in STOP_WORDS for x in w) / max(1, n),
        "dup_line_ratio": found["n_dup_lines"] / k,
        "bullet_line_ratio": sum(x.strip(" \t\n\x0b\x0c\r")[0] in "-*•" for x in lines) / k,
        "ellipsis_line_ratio": sum(x.rstrip(" \t\n\x0b\x0c\r").endswith(("...", "…")) for x in lines) / k,
    }
    failed = n < 50 or 100 * len(covered) > 50 * n
    broken = [r.name for r in RULES if (r.low is not None and ratios[r.metric] < r.low) or (r.high is not None and ratios[r.metric] > r.high)]
    return found, failed, not failed and not broken


def line_hashes(spark, lines):
    df = spark.createDataFrame([(x,) for x in sorted(set(lines))] or [("",)], "x string")
    return {r.x: r.h for r in df.select("x", F.xxhash64("x").alias("h")).collect()}


def gram_hashes(spark, grams):
    df = spark.createDataFrame([(list(g),) for g in sorted(set(grams))] or [([0],)], "g array<long>")
    return {tuple(r.g): r.h for r in df.select("g", F.xxhash64("g").alias("h")).collect()}


def plain_line_dedup(spark, docs, least=30, sure=50):
    """Texts after the same rule, from plain loops; hashes only break ties between windows' grams."""
    ends = " \t\n\x0b\x0c\r"
    units = {}
    for doc, text in docs:
        units[doc] = [(k, x.strip(ends), len(re.findall(WORD, x))) for k, x in enumerate((text or "").split("\n")) if re.search(WORD, x)]
    hashes = line_hashes(spark, [x for u in units.values() for _, x, _ in u])

    def reach(u, i, words):
        n = total = 0
        while i + n < len(u) and total < words:
            total += u[i + n][2]
            n += 1
        return n, total

    grams = {}
    for doc, u in units.items():
        for i in range(len(u)):
            n, total = reach(u, i, least)
            if total >= least:
                grams[doc, i] = tuple(hashes[x] for _, x, _ in u[i : i + n])
    of_gram = gram_hashes(spark, grams.values())
    prints = set()
    for doc, u in units.items():
        for i in range(len(u)):
            n, _ = reach(u, i, sure - least)
            some = [(of_gram[grams[doc, j]], -j) for j in range(i, i + n) if (doc, j) in grams]
            if some:
                h, j = min(some)
                prints.add((h, doc, -j))
    first = {}
    for h, doc, i in sorted(prints, key=lambda p: (p[1], p[2])):
        first.setdefault(h, (doc, i))
    out = {}
    for doc, text in docs:
        u, gone = units[doc], set()
        for h, where, i in prints:
            if where != doc or first[h] == (doc, i):
                continue
            other, j = first[h]
            v, d = units[other], i - j
            same = [0 <= k - d < len(v) and u[k][1] == v[k - d][1] for k in range(len(u))]
            k = 0
            while k < len(u):
                e = k
                while e < len(u) and same[e]:
                    e += 1
                if sum(x[2] for x in u[k:e]) >= least:
                    gone |= set(range(u[k][0], u[e - 1][0] + 1))
                k = max(e, k + 1)
        out[doc] = "\n".join(x for k, x in enumerate((text or "").split("\n")) if k not in gone)
    return out


# --- tests


def test_quality_matches_the_plain_version(spark):
    rows = corpus()
    extra = [(5000 + i, t, "en", "s", 0) for i, t in enumerate(["a b a b a b a b", "x\nx\n\nx \n", "Ä, É; !", "…\n- a...\n* b", "  em", "w " * 9000])]
    docs = spark.createDataFrame(rows + extra, SHAPE).selectExpr("*", "'z' AS kept", "1 AS n_words")
    got = quality_rules(docs).collect()
    assert len(got) == len(rows) + len(extra)
    for r in got:
        if r.text and len(r.text) > 17_000:
            assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept) == (9000, 9000, True, False)
            continue
        found, failed, kept = plain_quality(r.text)
        assert {k: r[k] for k in found} == found, r.text
        assert (r.base_failed, r.kept) == (failed, kept)
    assert quality_rules(docs.limit(0)).count() == 0


def test_quality_keeps_a_clean_text_of_over_a_million_words(spark):
    n = 1_000_100
    text = "\n".join(" ".join("the" if k % 8 == 0 else f"w{k}" for k in range(i, i + 20)) for i in range(0, n, 20))
    got = quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).drop("text").first()
    assert got.n_words >= n
    assert (got.base_failed, got.failed_rules, got.kept) == (False, [], True)


def test_line_dedup_matches_the_plain_version(spark):
    rows = [(i, t) for i, t, *_ in corpus() if i is not None]
    rows = list(dict.fromkeys(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _doc", "2 AS runs", "3 AS row", "4 AS cut", "'x' AS removed")
    got = {r.doc_id: r for r in line_dedup(docs).collect()}
    want = plain_line_dedup(spark, rows)
    assert {i: r.text or "" for i, r in got.items()} == want
    assert {(r._doc, r.runs, r.row, r.cut) for r in got.values()} == {(1, 2, 3, 4)}
    assert sum(r.n_removed_lines for r in got.values()) > 50
    before = dict(rows)
    for i, r in got.items():
        words = lambda t: len(re.findall(WORD, t or ""))
        assert words(before[i]) - words(r.text) == r.n_removed_words
    assert line_dedup(docs.limit(0)).count() == 0


def test_line_dedup_cuts_every_long_repeat_and_nothing_short(spark):
    rng = random.Random(9)
    new = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    long_line, parts, short = new(51), [new(9) for _ in range(8)], new(12)
    rows = []
    for i in range(40):
        middle = [long_line] if i % 2 else parts
        rows.append((i, "\n".join([new(7), *middle, new(5), short, new(30)])))
    got = {r.doc_id: r.text for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(long_line in t for t in got.values()) == 1
    assert sum(any(p in t for p in parts) for t in got.values()) == 1
    assert all(short in t for t in got.values())


def test_line_dedup_finds_long_repeats_behind_a_frequent_line(spark):
    rng = random.Random(21)
    new = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    x, y, z = new(35), new(20), new(26)
    rows = [(0, "\n".join([x, new(40)])), (1, "\n".join([new(12), x])), (2, "\n".join([z, x]))]
    rows += [(i, "\n".join([x, y, new(60)])) for i in range(10, 14)] + [(i, "\n".join([new(60), z, x])) for i in range(20, 23)]
    stock = [new(n) for n in (35, 31, 20, 20, 12, 9, 25, 52, 4)]
    rows += [(100 + i, "\n".join(rng.choice(stock) if rng.random() < 0.9 else new(8) for _ in range(rng.randint(2, 7)))) for i in range(60)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [i for i in got if y in got[i].text] == [10]
    assert [i for i in got if z in got[i].text] == [2]
    lines = {i: t.split("\n") for i, t in rows}

    def repeated(least):
        seen, found = set(), {i: set() for i in lines}
        for i in sorted(lines):
            for a in range(len(lines[i])):
                for b in range(a + 1, len(lines[i]) + 1):
                    run = tuple(lines[i][a:b])
                    if len(" ".join(run).split()) >= least:
                        if run in seen:
                            found[i] |= set(range(a, b))
                        seen.add(run)
        return found

    gone = {i: {k for a, b in (r.removed or []) for k in range(a, b + 1)} for i, r in got.items()}
    long, any_length = repeated(50), repeated(30)
    assert all(long[i] <= gone[i] <= any_length[i] for i in lines)


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 100), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000), ("c", "x", 500)], "d string, l string, tokens long"
    )
    got = {(r.d, r.l): r.budget for r in leaf_budgets(leaves, ["d", "l"], {("a",): 2, ("b",): 1, ("c",): 0}, 1200).collect()}
    # a's 800: x can give 100 of its 400, so y gives 700; b is not asked for more
    assert got == {("a", "x"): 100, ("a", "y"): 700, ("b", "x"): 200, ("b", "y"): 200, ("c", "x"): 0}
    more = {(r.d, r.l): r.budget for r in leaf_budgets(leaves, ["d", "l"], {("a",): 2, ("b",): 1, ("c",): 0}, 2400).collect()}
    # a gives all of its 1,100, and only then b more than its 800
    assert more == {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 650, ("b", "y"): 650, ("c", "x"): 0}
    with pytest.raises(ValueError):
        leaf_budgets(leaves, ["d", "l"], {("a",): 10_001}, 10)


def test_mix_takes_seeded_prefixes_and_whole_epochs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SHAPE).selectExpr("*", "1 AS rest", "2 AS whole", "3 AS epoch", "4 AS _key", "5 AS row")
    levels = {"leaf": F.col("source")}
    got = mix_sources(docs, levels, {("src1",): 5, ("src2",): 0}, percent=120, max_epochs=3, seed=4).collect()
    count = lambda t: len(re.findall(WORD, t or ""))
    leaves = {}
    for i, t, _, s, _ in rows:
        leaves.setdefault(s or "", []).append((i, count(t)))
    table = spark.createDataFrame([(k, sum(n for _, n in v)) for k, v in leaves.items()], "leaf string, tokens long")
    total = sum(n for v in leaves.values() for _, n in v)
    budgets = {r.leaf: r.budget for r in leaf_budgets(table, ["leaf"], {("src1",): 5, ("src2",): 0}, total * 120 // 100, 3).collect()}
    want = []
    for leaf, members in leaves.items():
        tokens = sum(n for _, n in members)
        whole, rest = divmod(budgets[leaf], tokens) if tokens else (0, 0)
        for e in range(whole):
            want += [(str(i), e) for i, _ in members]
        key = lambda i, e=whole: hashlib.md5(f"4:{e}:{'' if i is None else i}".encode()).hexdigest()
        for i, _ in members:
            if rest and sum(n for j, n in members if key(j) <= key(i)) <= rest:
                want.append((str(i), whole))
    assert sorted((str(r.doc_id), r.epoch) for r in got) == sorted(want)
    assert max(r.epoch for r in got) >= 1 and not any(r.leaf == "src2" for r in got)
    assert {(r.rest, r.whole, r._key, r.row) for r in got} == {(1, 2, 4, 5)}
    assert mix_sources(docs.limit(0), levels, {}).count() == 0
    with pytest.raises(ValueError, match="budget"):
        mix_sources(docs, {"budget": F.col("source")}, {})


def test_run_matches_the_plain_pipeline(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    docs = [r for r in rows if plain_quality(r[1])[2]]
    named = list(dict.fromkeys((i if i is not None else -(2**63), t) for i, t, *_ in docs))
    cut = plain_line_dedup(spark, named)
    docs = [(i, cut[i if i is not None else -(2**63)], a, b) for i, t, a, b, _ in docs]
    before = dict(named)
    docs = [r for r in docs if re.search(WORD, r[1]) or r[1] == before[r[0] if r[0] is not None else -(2**63)]]
    root = {r[0]: r[0] for r in docs if r[0] is not None}

    def find(x):
        return x if root[x] == x else find(root[x])

    sets = {i: plain_sets(t, 5) for i, t, *_ in docs if i is not None}
    for i in sets:
        for j in sets:
            if j < i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    heads = {r[0]: r for r in docs if r[0] is not None and find(r[0]) == r[0]}
    docs = [*heads.values(), *(r for r in docs if r[0] is None)]
    df = spark.createDataFrame([(*r, len(r[1])) for r in docs], SHAPE)
    kept = mix_sources(df, cp.mix_levels(), cp.WEIGHTS, **cp.MIX).select("doc_id", "text").collect()
    check_packing([(r.doc_id, r.text) for r in kept], got, 2048)
    assert 20 < len(kept) < len(docs) <= 160
    assert all(zlib.crc32(r.ids) == zlib.crc32(np.frombuffer(r.ids, "<u4").tobytes()) for r in got)
    assert VOCABULARY


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SHAPE).write.parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
