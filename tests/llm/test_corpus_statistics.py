"""Phrase collocations, line dedup and whitening against plain versions."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from scorelab.llm import collocations, lines, queries, whitening

DOCS = "doc_id long, text string, lang string, n long, part string, h1 long, _text string"


def phrases(seed=3, n=150):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(30)] + ["\x01", "a-b", "日本", "\x85x"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocab[: 6 if rng.random() < 0.5 else 34]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.4:
            at = rng.randint(0, len(words))
            words[at:at] = ["New", "YORK", "City"]
        if rng.random() < 0.3:
            words += ["hot"] * rng.randint(1, 9)
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " ; "]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, " .,\n ", "en"), (None, "hot hot hot", "en"), rows[4], rows[4]]
    return rows + [(n + 3, "every word counts here " * 4000, "fr"), (n + 4, "İstanbul ÉCOLE " * 12, "tr")]


def documents(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], DOCS).repartition(5)


def plain_collocations(rows, least=10, top=2000):
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts[lang or "und", tuple(words[i : i + size])] += 1
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    best = {}
    for (lang, words), a in found.items():
        if any(g == lang and words in (longer[:2], longer[1:]) and 100 * b >= 50 * a for (g, longer), b in found.items() if len(longer) > len(words)):
            continue
        cuts = [(1000000 * a * a // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        row = (-score, -a, " ".join(words).encode(), counts[lang, words[:k]], counts[lang, words[k:]])
        best.setdefault(lang, []).append(row)
    out = []
    for lang, own in best.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(own)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def test_collocations(spark):
    rows = phrases()
    found = collocations.collocations(documents(spark, rows))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(rows)
    assert sorted(map(tuple, found.collect())) == want and len(want) > 30


def test_collocations_with_small_limits(many_partitions):
    """Containers burst, tries spill, vocabularies start anew and texts are cut in the middle of phrases."""
    rows = phrases(8, 60)
    found = collocations.collocations(documents(many_partitions, rows), least=3, top=40, burst=4, entries=50, words=20, step=17)
    assert sorted(map(tuple, found.collect())) == plain_collocations(rows, 3, 40)


def test_merge_sums_while_runs_wait():
    words = [b"", b"\n", b"b", b"a"]
    keys = np.array([2 << 42, 2 << 42 | 3 << 21, 3 << 42 | 2 << 21 | 2])
    merged = collocations.Merge(waiting=4)
    for _ in range(5):
        for _, run in collocations.sorted_runs(words, keys, np.array([7, 2, 1]), "en", 1):
            merged.add(run)
    assert sorted(merged.frequent(5)) == [("", 0, 35), ("a b b", 3, 5), ("b", 1, 35), ("b a", 2, 10)]


def test_no_collocations(spark):
    assert collocations.collocations(documents(spark, [])).collect() == []
    assert collocations.collocations(documents(spark, [(1, None, None), (2, "", "en")])).collect() == []


# --- lines ---------------------------------------------------------------------


def texts_of_lines(seed=5, n=90):
    rng = random.Random(seed)
    common = [f"This Licence line number {i} is ÉVERYWHERE" for i in range(6)] + ["short line", "x" * 19, "y" * 20, "é" * 19, "É" * 20]
    rows = []
    for i in range(n):
        own = [f"line {rng.randint(0, 10**6)} of document {i} only" for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(common)
            own.insert(rng.randint(0, len(own)), rng.choice(["", " ", "\t", "\x0c"]) + rng.choice([line, line.upper() if line.isascii() else line, line.lower() if line.isascii() else line]) + rng.choice(["", "\r", "  \x0b"]))
        rows.append((i * 3 % 101, "\n".join(own), "en"))
    rows += [(500, None, "en"), (501, "", "en"), (502, "\n\n", "en"), (503, "   \n\t", None)]
    rows += [(None, f"{common[0]}\nlost", "en"), (None, f"{common[0]}\nother", "en"), (None, f"{common[0]}\nother", "en")]
    rows += [(600, "said twice in the last document\n" * 3 + "tail", "en"), rows[7], rows[7]]
    rows += [(601 + i, "alone with the null ones, thirty chars\n", "en") for i in range(2)] + [(None, "Alone with the null ones, thirty chars", "en")]
    rows += [(650, "\n".join(x for i in range(20_000) for x in (common[1], f"long own line number {i}")), "en"), (700, common[1], "en"), (690, "said twice in the last document", "en"), (691, "SAID twice in the last document", "en")]
    return rows


def plain_lines(rows, chars=20, docs=3):
    def key(line):
        return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for at, (doc, text, _) in enumerate(rows):
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= chars:
                holders.setdefault(k, []).append(doc)
    gone = {k: max((d for d in own if d is not None), default=None) for k, own in holders.items() if len(own) >= docs}
    out = []
    for doc, text, _ in rows:
        own = (text or "").split("\n")
        left = [x for x in own if key(x) not in gone or gone[key(x)] == doc]
        out.append((doc, len(own), len(own) - len(left), "\n".join(left)))
    return out


def test_lines(spark):
    rows = texts_of_lines()
    df = documents(spark, rows).selectExpr("*", "map('a', 1) as m", "'z' as n_lines")
    left = lines.without_common_lines(df)
    assert left.columns == [*df.columns, "n_dropped"]
    found = left.selectExpr("doc_id", "n_lines", "n_dropped", "coalesce(text, '')").collect()
    want = plain_lines(rows)
    assert Counter(map(tuple, found)) == Counter(want) and sum(r[2] for r in want) > 20_000
    others = left.select("lang", "n", "part", "h1", "_text").distinct().collect()
    assert {tuple(r)[1:5] for r in others} == {(1, "x", 2, "y")}
    assert left.where("text is null").count() == 1


def test_lines_in_many_partitions(many_partitions):
    rows = texts_of_lines(6, 40)
    found = lines.without_common_lines(documents(many_partitions, rows), least_chars=10, least_docs=2)
    assert Counter(tuple(r) for r in found.selectExpr("doc_id", "n_lines", "n_dropped", "coalesce(text, '')").collect()) == Counter(plain_lines(rows, 10, 2))


def test_no_lines(spark):
    assert lines.without_common_lines(documents(spark, [])).collect() == []


def test_line_dedup_stays_in_the_jvm(spark, tmp_path):
    rows = texts_of_lines(7, 20)
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_line_dedup(spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    want = Counter((d, n, k, hashlib.sha256(t.encode()).hexdigest()) for d, n, k, t in plain_lines(rows))
    assert Counter(map(tuple, found.collect())) == want


# --- whitening -----------------------------------------------------------------


def vectors(seed=2, n=400, d=7):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) @ rng.standard_normal((d, d)) + 3
    rows = [(int(i) if i % 50 else None, [float(v) for v in r], 1) for i, r in enumerate(x)]
    rows += [rows[3], rows[3], (9000, list(rows[5][1]), 0), (9001, None, 1), (9002, [], 1), (9003, [float("nan")] + [0.0] * (d - 1), 1)]
    return rows + [(9004, [None] + [0.0] * (d - 1), 1), (9005, [float("inf")] * d, 1), (9006, [1.0, 2.0], 1), (9007, [-0.0] * d, None)]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, x int").repartition(3)


def plain_whitening(rows, k=4):
    d = max(Counter(len(v) for _, v, _ in rows if v).items(), key=lambda c: (c[1], c[0]))[0]
    kept = [(i, [int(np.floor(256 * c)) for c in v]) for i, v, _ in rows if v and len(v) == d and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    c = (a := np.array(fit) - np.array(sums) / n).T @ a / n
    e, v = (y[..., ::-1] for y in np.linalg.eigh(c))
    out = {}
    for i, x in kept:
        off = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        out.setdefault((i, tuple(x)), []).append((off, (np.array(x) - np.array(sums) / n) @ v[:, :k] / np.sqrt(e[:k])))
    return n, out, e[:k] / e.sum()


def check(spark, rows, k=4):
    n, want, explained = plain_whitening(rows, k)
    found = whitening.whitened(embeddings(spark, rows), k).collect()
    assert Counter((r["vec_id"], r["component"]) for r in found) == Counter((i, c) for (i, _), own in want.items() for _ in own for c in range(1, k + 1))
    assert {r["n"] for r in found} == {n} and all(r["identity_error"] < 1e-9 for r in found)
    assert all(abs(r["explained"] - explained[r["component"] - 1]) < 1e-12 for r in found)
    for c in range(1, k + 1):
        mine = sorted((str(r["vec_id"]), int(r["deviation"]), r["whitened"]) for r in found if r["component"] == c)
        theirs = sorted((str(i), off, w[c - 1]) for (i, _), own in want.items() for off, w in own)
        assert [m[:2] for m in mine] == [t[:2] for t in theirs]
        a, b = np.array([m[2] for m in mine]), np.array([t[2] for t in theirs])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9


def test_whitening(spark):
    check(spark, vectors())


def test_whitening_in_many_partitions(many_partitions):
    check(many_partitions, vectors(4, 150, 3), 3)


def test_numbers_past_64_bits(spark):
    rows = [(i, [float(2**40 + 2**30 * i), float(i * i)], 1) for i in range(50)]
    found = whitening.whitened(embeddings(spark, rows)).collect()
    x = [[int(256 * c) for c in v] for _, v, _ in rows]
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((50 * a - s) ** 2 for a, s in zip(r, sums)) for i, r in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in found} == want and max(want.values()) > 2**63


def test_no_variance(spark):
    none = [[], [(1, None, 1)], [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]]
    assert all(whitening.whitened(embeddings(spark, rows)).collect() == [] for rows in none)
    line = [(i, [float(i), 2.0 * i], 1) for i in range(9)]
    assert {r["component"] for r in whitening.whitened(embeddings(spark, line)).collect()} == {1}


@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_spectral_division(d):
    rng = np.random.default_rng(d)
    for c in (rng.standard_normal((d, 2 * d)), np.eye(d), rng.standard_normal((d, 1)), np.diag(10.0 ** -np.arange(d))):
        c = c @ c.T
        values, vectors = whitening.leading(c, 4)
        k = min(4, d)
        assert np.allclose(values, np.linalg.eigvalsh(c)[::-1][:k], atol=1e-13 * np.linalg.norm(c), rtol=1e-12)
        assert np.allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)
        assert np.linalg.norm(c @ vectors - vectors * values) <= 1e-13 * np.linalg.norm(c)


def test_polar_factor():
    rng = np.random.default_rng(1)
    for scale in (1e-12, 1e-3, 1.0, 1e9):
        q = np.linalg.qr(rng.standard_normal((9, 9)))[0]
        signs = np.array([1, -1, 1, 1, -1, -1, 1, -1, 1])
        a = (q * (signs * np.linspace(scale, 1, 9))) @ q.T
        assert np.allclose(whitening.polar((a + a.T) / 2), (q * signs) @ q.T, atol=1e-9 / min(scale, 1) * 1e-6 + 1e-12)
