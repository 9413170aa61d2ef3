"""The pipeline against plain versions of its stages, stage by stage and as a whole."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from scorelab.llm import toxicity
from tests.llm.test_text_operators import SCHEMA, WORDS, plain_added, plain_base, plain_components, plain_mix, plain_print, texts


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    rows = texts(21, 150)
    bad = ["zorblimu", "zorblika", "zorblito", "zorblera"]
    labels = []
    for i in range(150):
        if i % 5 == 0:
            rows[i] = (i, f"{bad[i % 4]} {rows[i][1]} and {bad[(i + 1) % 4]} again", *rows[i][2:])
        labels.append((i, 1, int(i % 5 == 0)))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """What each stage was given and what it returned."""
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((before, docs.columns, [tuple(r) for r in docs.collect()]))
    return out


def same(a, b):
    return Counter(a) == Counter(b)


def test_columns_stay_until_the_last_stage(stages):
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    assert all(columns == names for _, columns, _ in stages[:-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, stages):
    before, _, after = stages[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.learned(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    grammar = toxicity.Grammar(dict(model.lexicon))
    keep = [r for r in before if model.scores(np.array([grammar.features(r[1])]))[0] < toxicity.THRESHOLD]
    assert same(after, keep)
    gone = {r[0] for r in before} - {r[0] for r in after}
    toxic = {i for i in range(150) if i % 5 == 0}
    assert gone <= toxic | {154, 155} and len(gone & toxic) >= 28


def test_one_of_each_group_stays(stages):
    before, _, after = stages[1]
    groups = {c for _, _, c in plain_components([(r[0], plain_print(r[1])) for r in before])}
    assert set(after) <= set(before)
    assert sorted(map(str, (r[0] for r in after))) == sorted(map(str, groups))


def test_secrets_are_replaced(stages):
    before, _, after = stages[2]

    def clean(text):
        if text is None:
            return None
        base, spans, out, at = plain_base(text), [], "", 0
        for a, _, b, _ in sorted(base + plain_added(text, base)):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        for a, b in spans:
            out, at = out + text[at:a] + "[secret]", b
        return out + text[at:]

    want = [(r[0], t := clean(r[1]), r[2], r[3], r[4] if t == r[1] else len(t)) for r in before]
    assert same(after, want) and not same(after, before)


def test_sources_come_near_their_targets(stages):
    before, _, after = stages[3]
    assert set(after) <= set(before)
    _, target, taken = plain_mix(before)

    def size(r):
        return len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))

    # words taken per document, rounded to whole documents pass by pass
    want = Counter()
    for source, total in {r[3]: sum(size(x) for x in before if x[3] == r[3]) for r in before}.items():
        own = sorted((r for r in before if r[3] == source), key=lambda r: (hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or -1, size(r)))
        for k in range(3):
            at = 0
            for r in own:
                served = max(0, min(int(target[source] + 1e-9) - k * total - at, size(r)))
                if (2 * served >= size(r)) if size(r) else k == 0:
                    want[r] += 1
                at += size(r)
    assert Counter(after) == want


def test_pieces_hold_the_mix(stages):
    from tokenizers import Tokenizer

    before, columns, after = stages[4]
    library = Tokenizer.from_file(WORDS)
    sizes = Counter((r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in before)
    rows = [dict(zip(columns, r, strict=True)) for r in after]
    found = Counter((r["doc_id"], r["doc_tokens"]) for r in rows if r["start"] == 0)
    assert found == sizes and sum(r["length"] for r in rows) == sum(n * c for (_, n), c in sizes.items())
    inside = {}
    for r in rows:
        inside.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in inside.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_gives_the_last_stage(spark, folder, stages):
    found = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    columns = stages[4][1]
    drop = {columns.index("sequence_id"), columns.index("offset")}
    assert same([tuple(v for i, v in enumerate(r) if i not in drop) for r in found],
                [tuple(v for i, v in enumerate(r) if i not in drop) for r in stages[4][2]])
