"""Archives and vector search against plain versions."""

import hashlib
import random

import numpy as np
import pytest
import zstandard

from scorelab.llm import ann, topk, vectors, warc

PAGES = "page_id long, url string, html string"


def pages(n=60):
    rng = random.Random(5)
    rows = [(i, f"http://h{i % 7}/p {i}\r\n", "<p>" + "".join(rng.choice("abc é") for _ in range(rng.randint(0, 3000)))) for i in range(n)]
    big = "same " * 300
    rows += [(n + i, None, big) for i in range(25)] + [(n + 90, "u", "short"), (n + 91, "u", "short"), (n + 92, "", None), (n + 93, "ü", "")]
    return rows + [(n + 24, None, big), (None, "u", big), (None, "u", "x" * 1200), (n + 94, "u", "y" * 300_000), rows[3], rows[3]]


def plain_roles(rows):
    groups = {}
    for p, _, h in rows:
        raw = (h or "").encode()
        if len(raw) >= 1000:
            groups.setdefault(raw, []).append(p)
    out = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = groups.get(raw, [])
        kept = max((x for x in same if x is not None), default=None)
        visit = len(same) > 1 and kept is not None and p != kept
        out.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if visit else "response", kept if visit else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' as payload", "1 as kept").repartition(3)
    read = warc.round_trip(df).collect()
    assert sorted((tuple(r)[0:1] + tuple(r)[2:6] for r in read), key=str) == plain_roles(rows)
    texts = {}
    for p, _, h in rows:
        texts.setdefault(p, set()).add((h or "").encode())
    assert all(bytes(r["payload"]) in texts[r["page_id"]] for r in read if r["record_type"] == "response")
    assert all(bytes(r["payload"]) == b"" for r in read if r["record_type"] == "revisit")


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).collect() == []


def archive(trained=b"", records=None):
    press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained) if trained else None)
    made = records or [warc.record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest(), "response", None)]
    return warc.opening(trained) + b"".join(press.compress(r) for r in made), made


def test_dictionary_frame_plain_and_compressed():
    trained = zstandard.train_dictionary(2048, [f"<p>page number {i} with words {i * i}</p>".encode() * 3 for i in range(500)]).as_bytes()
    raw, made = archive(trained)
    assert list(warc.frames(raw)) == made
    squeezed = zstandard.ZstdCompressor().compress(trained)
    body = raw[len(warc.opening(trained)) :]
    assert list(warc.frames(warc.opening(squeezed) + body)) == made
    assert list(warc.frames(archive()[0])) == made


@pytest.mark.parametrize("spoil", [
    lambda r: r.replace(b"WARC/1.1", b"WARX/1.1"), lambda r: r.replace(b"Content-Length: 5\r\n\r\nhello", b"Content-Length: 6\r\n\r\nhello"),
    lambda r: r.replace(b"WARC-Date: ", b"X-Date: "), lambda r: r.replace(b"hello", b"jello"), lambda r: r[:-1],
    lambda r: r.replace(b"WARC-Type: response", b"WARC-Type response"),
])
def test_malformed_records_are_errors(spoil):
    good = archive()[1][0]
    assert warc.parse(good)[0] == 1
    with pytest.raises(ValueError):
        warc.parse(spoil(good))


def test_cut_archives_are_errors():
    raw, _ = archive(records=[b"x" * 5000, b"y" * 100])
    for broken in (raw[:-3], raw + b"\0\0\0\0\0\0\0\0\0", warc.opening(b"1234567890" * 5)[:-4]):
        with pytest.raises(ValueError):
            list(warc.frames(broken))


# --- vectors -------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(1500, 16)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    data[200:600] = data[0]  # a very common vector
    data[700:710] = data[700]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    odd = [(5000, None), (5050, [float("nan")] * 16), (5100, [float("inf")] + [0.0] * 15), (5150, [None] + [0.1] * 15), (5200, []), (None, rows[1][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as part", "3 as ids")
    return df.repartition(4), data


def want(score, ids, k):
    out = set()
    for i in np.flatnonzero(ids % 50 == 0):
        s = score[i].copy()
        s[ids == ids[i]] = -np.inf
        for rank, j in enumerate(np.lexsort((ids, -s))[:k], 1):
            out.add((int(ids[i]), rank, int(ids[j]), s[j]))
    return out


def test_exact_top_k(table, monkeypatch):
    df, data = table
    monkeypatch.setattr(topk, "CHUNK", 100)
    monkeypatch.setattr(topk, "SLICE", 7)
    monkeypatch.setattr(topk, "LANE", 2)
    rows = topk.quantised(df)
    found = topk.top_k(rows, rows.where("vec_id % 50 = 0"))
    v = np.floor(256 * data.astype(float))
    assert {tuple(r) for r in found.collect()} == want(v @ v.T, np.arange(1500), 5)


def test_elimination_leaves_most_rows_of_clustered_data():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, size=(20, 16)).astype(float)
    rows = centres[rng.integers(0, 20, 4000)] + rng.integers(-5, 6, size=(4000, 16))
    queries, names = rows[:20], np.arange(4000)
    pivots = rows[topk.choose_pivots(rows[:1000], 24)]
    to_query, to_row = topk.distances(queries, pivots), topk.distances(rows, pivots)
    score, found, products = topk.search(queries, names[:20], to_query, rows, names, to_row, np.full(20, -np.inf), 5)
    exact = queries @ rows.T
    exact[np.arange(20), np.arange(20)] = -np.inf
    assert np.array_equal(score, -np.sort(-exact, axis=1)[:, :5]) and products < 0.7 * exact.size


def test_far_chunks_never_meet_a_slice():
    """Bounds of chunks and slices: no pair is dropped that holds one of the best, most of clustered data's are."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    centres *= 3000 / np.linalg.norm(centres, axis=1, keepdims=True)
    rows = np.floor(np.repeat(centres, 50, axis=0) + rng.integers(-20, 21, size=(600, 16)))
    pivots, ids = rows[::50], np.arange(0, 600, 50)
    gaps = topk.distances(rows, pivots)

    def bounds(part):
        kth = topk._first_kth(rows[part], part, pivots, ids, 5).min()
        return np.concatenate([gaps[part].min(axis=0), gaps[part].max(axis=0), [(rows[part] ** 2).sum(axis=1).max(), kth]])

    parts = np.arange(600).reshape(12, 50)
    edges = np.array([bounds(p) for p in parts])
    exact = rows @ rows.T
    np.fill_diagonal(exact, -np.inf)
    best = np.argsort(-exact, axis=1)[:, :5]
    met = np.array([topk.may_meet(bounds(p), edges, 12) for p in parts])  # chunk x slice
    for s, p in enumerate(parts):
        assert all(met[c // 50, s] for c in best[p].ravel())
    assert met.sum() < 100


@pytest.mark.parametrize("parts", [16, 64, 256])
def test_visits_are_chosen_for_rows_the_router_never_saw(parts):
    """Recall of new queries among new rows, for few and many partitions."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 24))
    rows = ann.unit(centres[rng.integers(0, 60, 6000)] + 0.4 * rng.normal(size=(6000, 24)))
    router, visits = ann.fit(rows[:3000], parts, 5)
    fresh = rows[3000:]
    logits = router.logits(fresh)
    home, order = logits.argmax(axis=1), np.argsort(-logits[:300], axis=1)[:, :visits]
    near = ann.graph(fresh, 5)[:300]
    hit = (order[:, None, :] == home[near][:, :, None]).any(axis=2).mean()
    assert hit >= 0.9 and (visits < parts or parts == 16)


def test_odd_lengths_take_no_part(spark):
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(60)] + [(100, [1.0]), (150, [1.0, 2.0]), (200, [0.0, 0.0, 5.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    v, use = topk.quantised(df), ann.usable(df)
    assert {r["query_id"] for r in topk.top_k(v, v.where("vec_id % 50 = 0")).collect()} == {0, 50}
    assert {r["query_id"] for r in ann.nearest(use, use.where("vec_id % 50 = 0")).collect()} == {0, 50}


def test_few_or_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    rows = topk.quantised(few)
    assert {tuple(r)[:3] for r in topk.top_k(rows, rows.where("vec_id % 50 = 0")).collect()} == {(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)}
    use = ann.usable(few)
    assert {tuple(r)[:3] for r in ann.nearest(use, use.where("vec_id % 50 = 0")).collect()} == {(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)}
    none = few.limit(0)
    assert topk.top_k(topk.quantised(none), topk.quantised(none)).collect() == []
    assert ann.nearest(ann.usable(none), ann.usable(none)).collect() == []


def test_neighbours_of_learned_partitions(table, monkeypatch):
    df, data = table
    monkeypatch.setattr(ann, "CHUNK", 120)
    monkeypatch.setattr(ann, "LANE", 16)
    rows = ann.usable(df)
    found = {tuple(r) for r in ann.nearest(rows, rows.where("vec_id % 50 = 0")).collect()}
    v = data.astype(float)
    norm = np.sqrt((v * v).sum(axis=1))
    exact = want((v @ v.T) / (norm[:, None] * norm[None, :]), np.arange(1500), 5)
    near = {(q, n) for q, _, n, _ in found}
    queries = {q for q, *_ in exact}
    assert len(found) == 5 * len(queries)
    hit = 0
    for q in queries:  # equal scores may stand for each other
        fifth = min(s for a, _, _, s in exact if a == q)
        hit += sum(s >= fifth - 1e-12 for a, _, _, s in found if a == q)
    assert hit >= 0.9 * len(exact)
    for q, rank, n, s in found:
        assert s == (v[q] * v[n]).sum() / (norm[q] * norm[n])
    # the very common vector: all copies score alike, so the smallest ids win
    assert {(0, r, 199 + r) for r in range(1, 6)} <= {(q, r, n) for q, r, n, _ in found} and near


def test_balanced_parts_are_balanced():
    rng = np.random.default_rng(2)
    rows = ann.unit(rng.normal(size=(600, 8)))
    label = ann.balanced(rows, ann.graph(rows, 8), 8)
    assert np.bincount(label, minlength=8).max() <= 1.05 * 600 / 8 + 1


def test_best_breaks_ties_by_name():
    score = np.array([[1.0, 3.0, 3.0, 3.0, -np.inf]])
    names = np.array([[9, 7, 5, 6, 1]])
    s, n = vectors.best(score, names, 2)
    assert s.tolist() == [[3.0, 3.0]] and n.tolist() == [[5, 6]]
