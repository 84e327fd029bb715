"""Each stage against brute force on small fixtures, and the whole pipeline on one."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from kgloom.llm import bpe, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA)


def corpus(seed=3):
    """(rows, labels): good, toxic and low documents, near copies, shared lines, blanks, nulls and repeated ids."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for k in range(90):
        kind = ("good", "toxic", "low")[k % 3]
        marks = {"good": ["fine"], "toxic": ["hateful", "vile"], "low": ["$$%1", "%%$2"]}[kind]
        body = "\n".join(" ".join([word() for _ in range(12)] + [r.choice(marks)]) for _ in range(5))
        rows.append((k, body, "ab"[k % 2]))
        if k < 80:
            labels.append((k, int(kind != "low"), int(kind == "toxic")))
    for k in range(0, 60, 6):  # near copies of good documents: one word of 65 differs
        words = rows[k][1].split(" ")
        words[30] = "changed"
        rows.append((200 + k, " ".join(words), "a"))
    rows = [(d, t + "\nRead more in our archive of texts" if d % 2 == 0 else t, s) for d, t, s in rows]
    rows += [(500, rows[0][1], "b"), (501, None, None), (502, "", "a"), (None, rows[3][1], "b"), (7, "another text with the id of one before it fine", "a")]
    return rows, labels


def jaccard_groups(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    name = list(range(len(texts)))

    def root(k):
        while name[k] != k:
            k = name[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or (both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((root(a), root(b)))
                name[y] = x
    return [root(k) for k in range(len(texts))]


def test_quality_stage(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows)
    got = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = Counter(r.doc_id for r in got.collect())
    assert all(kept[k] for k in range(0, 90, 3)) and not any(kept[k] for k in range(90) if k % 3 and k != 7)
    assert corpus_pipeline.quality_stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_line_stage_keeps_what_stands_nowhere_else(spark):
    orders = [(k, f"Order {4711 + 7 * k} shipped from bay {k}") for k in range(6)]
    tables = [(10 + k, f"{k} {k * 31} {k * 77}\n{k + 1} 5 6") for k in range(5)]
    copies = [(20 + k, "All rights reserved by us") for k in range(4)]
    bodies = ("quick brown foxes jump", "some other words here", "nothing like the rest", "a body by itself", "last of five bodies")
    mixed = [(30 + k, f"Read on in our archive\n{body}") for k, body in enumerate(bodies)]
    docs = frame(spark, [(d, t, "s") for d, t in [*orders, *tables, *copies, *mixed, (40, ""), (41, None)]])
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    want = dict(orders) | dict(tables) | dict(copies[:1]) | dict(mixed) | {40: "", 41: None}
    want |= {k: t.split("\n")[1] for k, t in mixed[1:]}
    assert got == want
    assert corpus_pipeline.line_stage(spark, docs.limit(0), "").count() == 0


def test_near_stage(spark):
    rows, _ = corpus()
    docs = frame(spark, rows)
    got = corpus_pipeline.near_stage(spark, docs, "")
    assert got.columns == docs.columns
    groups = {}
    for (doc, text, _), group in zip(rows, jaccard_groups([t for _, t, _ in rows]), strict=True):
        groups.setdefault(group, []).append((doc is None, doc or 0, text))
    want = sorted(str(min(g, key=lambda x: x[:2])[1]) for g in groups.values())
    assert sorted(str(r.doc_id) for r in got.collect()) == want and len(want) < len(rows) - 8


def test_mix_stage(spark):
    rows, _ = corpus()
    docs = frame(spark, rows)
    got = corpus_pipeline.mix_stage(spark, docs, "")
    assert got.columns == docs.columns
    plan = mixing.plan(mixing.sized(docs).select("doc_id", "source", "size")).collect()
    want = Counter()
    for r in plan:
        want[r.doc_id, r.source] += r.copies
    assert Counter((r.doc_id, r.source) for r in got.collect()) == +want
    for source in ("a", "b"):
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 3 * max(r.size for r in own)


def test_bpe_stage(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    rows, _ = corpus()
    got = corpus_pipeline.bpe_stage(spark, frame(spark, rows), "").collect()
    want = sorted((str(d), whole.encode(t or "", add_special_tokens=False).ids) for d, t, _ in rows)
    assert sorted((str(r.doc_id), r.ids) for r in got) == want and all(r.n_tokens == len(r.ids) for r in got)


def test_run_applies_every_stage(spark, tmp_path):
    rows, labels = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)))
    found = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((str(r.doc_id), r.ids) for r in df.collect())
    assert key(found) == key(docs)
    ids = {r.doc_id for r in found.collect()}
    assert ids & set(range(0, 90, 3)) and not ids & {k for k in range(90) if k % 3 and k != 7} and not ids & set(range(200, 300))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "mixing", "bpe"]
