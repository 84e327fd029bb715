"""Small cases of each training-data operator against brute force: nulls, empty and repeated rows, ties, empty tables."""

import base64
import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from kgloom.llm import archives, bpe, exact_dedup, licenses, line_dedup, mixing, quality, simhash, suffix_dedup, topk
from kgloom.llm.components import components

SCHEMA = "doc_id long, text string, source string, ids string, extra int"
WORDS = "the of and licensed under patience alignment anchors quick brown fox jumps over lazy dogs 12 a1".split()


def some_docs(spark, n=60, seed=3):
    r = random.Random(seed)
    passage = " ".join(r.choice(WORDS) for _ in range(40))
    rows = []
    for k in range(n):
        text = "\n".join(" ".join(r.choice(WORDS) for _ in range(r.randrange(12))) for _ in range(r.randrange(6)))
        rows.append((k, text + (passage if k % 5 == 0 else ""), r.choice(["a", "b", None]), "x", k))
    rows += [(n, None, None, None, None), (n + 1, "", "é", None, 1), (n + 2, rows[0][1], "a", None, 1), (n + 3, rows[0][1][:-3], "a", None, 2), (7, rows[7][1], rows[7][2], "x", 7), (n + 4, passage * 60, "b", None, 1)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_cuckoo_index():
    index, digests = exact_dedup.CuckooIndex(16), [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k, d in enumerate(digests):
        index.insert(d, [k, 1])
    assert index.resizes and all(index.find(d) == [k, 1] for k, d in enumerate(digests))
    for d in digests[::2]:
        assert index.delete(d) and not index.delete(d)
    assert len(index) == 1500 and all((index.find(d) is None) == (k % 2 == 0) for k, d in enumerate(digests))


def test_cuckoo_hits_are_verified_in_their_bucket():
    index = exact_dedup.CuckooIndex(16)
    twin = lambda k: b"\x07\x00" + bytes(8) + bytes([k]) * 22  # noqa: E731  the same tag and buckets
    for k in range(5):
        index.insert(twin(k), [k, 0, 1])
        index.insert(twin(k), [k, 0, 2])  # a live digest takes no second tag
    assert len(index) == 5 and sum(map(len, index.tags)) == 5
    assert index.maybe(twin(9)) and index.find(twin(9)) is None and index.find(twin(3)) == [3, 0, 2]
    before = index.compared
    assert index.find(hashlib.sha256(b"x").digest()) is None and index.compared == before  # no hit, nothing is read
    for k in range(5):
        assert index.delete(twin(k))
    assert not index.maybe(twin(0)) and not index.content


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    rows = [(1, "a b", "x"), (1, "a  b", "y"), (None, "c", "x"), (None, "c", "y"), (5, "c", "z"), (None, "d", "x"), (None, "d", "y"), (7, None, "x"), (6, "", "y"), (8, "e", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    got = exact_dedup.dedup(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), (r.text or "").split()) for r in got.collect()) == [("1", ["a", "b"]), ("5", ["c"]), ("6", []), ("8", ["e"]), ("None", ["d"])]


def test_index_changes(spark):
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    keys = lambda rows: spark.createDataFrame([(d, k, digest(t)) for k, (d, t) in enumerate(rows)], "doc_id long, row long, digest binary")
    live = exact_dedup.groups(keys([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (None, "d")]))
    gone = spark.createDataFrame([(1, digest("a")), (3, digest("b")), (9, digest("z")), (1, None)], "doc_id long, digest binary")
    found = exact_dedup.apply_changes(live, keys([(0, "c"), (6, "e"), (6, "e")]), gone, part_rows=2)
    got = {bytes(r.digest): (r.keep_id, r.group_size) for r in found.collect()}
    assert got == {digest("a"): (None, 1), digest("c"): (0, 2), digest("d"): (None, 1), digest("e"): (6, 2)}
    nothing = spark.createDataFrame([], "doc_id long, row long, digest binary")
    assert exact_dedup.apply_changes(live.limit(0), nothing, gone.limit(0)).count() == 0


def test_exact_dedup(spark):
    rows, docs = some_docs(spark)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(docs).collect())
    norm = lambda t: " ".join(("x" + (t or "") + "x").split())
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(norm(t), []).append(d)
    assert got == sorted((d, min(g), len(g), k == 0) for g in groups.values() for k, d in enumerate(sorted(g)))
    assert exact_dedup.classes(none(spark)).count() == 0 == exact_dedup.dedup(none(spark)).count()


def test_simhash(spark):
    rows, docs = some_docs(spark)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_groups(docs).collect()}
    fps = {d: simhash.fingerprint((t or "").encode()) for d, t, *_ in rows}
    label = {d: d for d in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    label[a] = label[b] = min(label[a], label[b])
    assert got == {d: (fps[d], label[d]) for d in fps}
    assert simhash.near_groups(none(spark)).count() == 0


def test_fingerprints_by_the_definition():
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text in ("", " \t", "One", "one TWO", "a b c", "the cat The CAT the cat sat É é", "x " * 500, "\x85a b\x0bc\x0cd\u2003e f"):
        words, word = [], ""
        for c in text.translate(lower) + " ":
            if c in " \t\n\x0b\x0c\r":
                words, word = words + [word] * bool(word), ""
            else:
                word += c
        shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text.encode()) == want


def test_rows_without_an_id_link_others(spark, monkeypatch):
    rows = [(1, 0b0), (None, 0b111), (2, 0b111111), (3, 0b111 << 40), (None, 0b111111 << 50), (None, 0b1111111 << 50)]
    schema = "doc_id long, fp long"
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs)
    got = [(r.doc_id, r.component_id) for r in simhash.near_groups(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (None, 1), (2, 1), (3, 1), (None, None), (None, None)], key=str)


def test_any_number_of_slabs_gives_the_same_groups(spark):
    r = random.Random(4)
    base = [r.getrandbits(63) for _ in range(6)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(63), r.randrange(5))) for b in base for _ in range(20)})
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, node long")
    groups = [sorted((x.node, x.component) for x in components(simhash.links(nodes, slabs=slabs, block=block)).collect()) for slabs, block in ((6, 4096), (8, 4096), (6, 7))]
    assert groups[0] == groups[1] == groups[2]
    assert [simhash.slabs_for(n, 3) for n in (0, 10**6, 10**10, 10**13)] == sorted(simhash.slabs_for(n, 3) for n in (0, 10**6, 10**10, 10**13))


def test_simhash_keeps_one_row_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(3, text, 1), (3, text, 2), (None, text, 3), (None, "alone here", 4), (None, "alone here", 5), (2, None, 6), (2, "something else", 7), (9, "", 8)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "2", "3", "None"]


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(k, k + 1) for k in range(5000, 5040)] + [(7, 7), (9000, 9001), (9001, 9000)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == dict.fromkeys(range(3000), 0) | dict.fromkeys(range(5000, 5041), 5000) | dict.fromkeys((9000, 9001), 9000)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

def test_links_in_blocks(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), r.randrange(4))) for b in base for _ in range(12)})
    rows = [(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)]
    found = components(simhash.links(spark.createDataFrame(rows, "fp long, node long"), block=16))
    got = {x.node: x.component for x in found.collect()}
    label = list(range(len(fps)))
    for _ in range(20):
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    assert all(got.get(k, k) == label[k] for k in range(len(fps)))


def test_suffix_dedup(spark):
    rows, docs = some_docs(spark)
    first = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    want = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want.append((d, len(b), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    got = sorted((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == sorted(want)
    assert suffix_dedup.remove_repeats(none(spark)).count() == 0


def test_suffix_dedup_of_overlapping_passages(spark):
    r = random.Random(21)
    base = ["".join(r.choice("abc d") for _ in range(r.randrange(40, 130))) for _ in range(12)]
    rows = []
    for k in range(150):
        text = ""
        for _ in range(r.randrange(5)):
            passage = r.choice(base)
            a = r.randrange(len(passage) // 2)
            text += passage[a : a + r.randrange(30, 120)] + "".join(r.choice("xyé ") for _ in range(r.randrange(12)))
        rows.append((r.choice((k, k // 2, None)), text))
    last, first, want = 1 << 62, {}, []
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(last if d is None else d, first.get(b[i : i + 50], last))
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < (last if d is None else d):
                gone[i : i + 50] = b"\1" * 50
        want.append((str(d), len(b), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for parts in (3, 40):
        got = sorted((str(x.doc_id), x.n_bytes, bytes(x.kept)) for x in suffix_dedup.remove_repeats(docs, parts=parts).collect())
        assert got == sorted(want)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("kgloom_chunks")]


def test_refine_orders_suffixes():
    r = random.Random(2)
    data = bytes(r.choice(b"ab") for _ in range(400)) + bytes(50)
    starts = np.arange(400)
    ids = suffix_dedup.refine(data, starts)
    keys = [data[k : k + 50] for k in starts]
    assert [ids[k] for k in sorted(starts, key=lambda k: keys[k])] == sorted(ids.tolist())
    assert len(set(ids.tolist())) == len(set(keys))


def test_mixing(spark):
    rows, docs = some_docs(spark)
    plan = mixing.plan(mixing.sized(docs).select("doc_id", "source", "size")).collect()
    assert len(plan) == len(rows) and all(0 <= r.copies <= 2 for r in plan)
    total = sum(r.size for r in plan)
    goals = {r.source: r.target for r in plan}
    assert sum(goals.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(docs).count() == sum(r.copies for r in plan)
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(none(spark)).count() == 0


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    rows, docs = some_docs(spark)
    got = bpe.decode(bpe.encode(docs, bpe.default_tokenizer()), bpe.default_tokenizer()).collect()
    for r in got:
        assert r.ids == whole.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert len(got) == len(rows) and bpe.encode(none(spark), bpe.default_tokenizer()).count() == 0


def test_bpe_in_parts(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    r = random.Random(1)
    marks = ["a", "b", "é", "😀", " ", "  ", "\n", "\t", "1", "٣", "'s", "'ll", ".", "!!", "<|endoftext|>", "漢", " ", "the", " and", "ǿ"]
    texts = [None, "", " " * 3000, "x" * 3000, *["".join(r.choice(marks) for _ in range(r.choice([3, 30, 300, 5000]))) for _ in range(200)]]
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "_PIECE", 400)
    monkeypatch.setattr(bpe, "_MEMO_BYTES", 20_000)
    encoder, got = bpe.Encoder(bpe.Vocabulary(bpe.default_tokenizer())), [[] for _ in texts]
    for first, stop, ids, bounds, _ in encoder.encode_rows(pa.array(texts)):
        for k in range(stop - first):
            got[first + k] += ids[bounds[k] : bounds[k + 1]].tolist()
    assert got == want
    monkeypatch.undo()
    docs = spark.createDataFrame([(k, t, "x", "x") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for x in bpe.round_trip(docs, bpe.default_tokenizer()).collect():
        ids = want[x.doc_id]
        assert tuple(x)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(whole.decode(ids, skip_special_tokens=False)))
    assert bpe.round_trip(docs.limit(0), bpe.default_tokenizer()).count() == 0


def test_digests_join_parts_of_a_text():
    vocabulary = bpe.Vocabulary(bpe.default_tokenizer())
    ids = bpe.Encoder(vocabulary).encode(["né 😀 of it"])[0]
    both = bpe._Digests(bpe.Packed(vocabulary.pieces), bpe.Packed([b",%d" % k for k in range(len(vocabulary.pieces))]))
    for k, x in enumerate(ids):
        both.add(np.array([x]), k == len(ids) - 1)
    assert both.ids.hexdigest() == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert both.text.hexdigest() == hashlib.sha256("né 😀 of it".encode()).hexdigest()


def test_other_tokenizer_files_are_refused():
    with open(bpe.default_tokenizer(), encoding="utf-8") as file:
        whole = json.load(file)
    bpe._refuse_unknown(whole)
    for change in ({"normalizer": {"type": "NFC"}}, {"model": whole["model"] | {"ignore_merges": True}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [whole["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="not supported"):
            bpe._refuse_unknown(whole | change)


def test_lexicon_shares_suffixes():
    words = {w: np.array([k, k + 1]) for k, w in enumerate([b"nation", b"station", b"ration", b"rat", b"at"])}
    lexicon = bpe.Lexicon.mapped(bpe.Lexicon.compile(words))
    found = lexicon.find([*words, b"tion", b"", b"nations"])
    assert [x.tolist() for x in found[:5]] == [x.tolist() for x in words.values()] and found[5:] == [None] * 3
    assert len(lexicon.final) < sum(map(len, words))


def test_topk(spark):
    r = random.Random(5)
    rows = [(k, [r.uniform(-1, 1) for _ in range(6)]) for k in range(300)] + [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [0.5] * 6), (304, [0.5] * 6)]
    vectors = topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    v = {x.vec_id: np.array(x.v) for x in vectors.collect()}
    assert set(v) == {k for k, _ in rows} - {300, 301, 302}
    got = {}
    for x in topk.search(vectors, vectors.where("vec_id % 100 = 0"), block=64).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    for q, found in got.items():
        want = sorted(((-int(v[q] @ v[c]), c) for c in v if c != q))[:10]
        assert sorted(found) == [(k + 1, c, -s) for k, (s, c) in enumerate(want)]
    assert set(got) == {0, 100, 200}


def test_topk_against_brute_force_in_many_shapes(spark):
    r = random.Random(8)
    for width, spread, block, k in ((1, 2.0, 16, 3), (5, 1.0, 32, 10), (3, 0.01, 64, 10), (4, 60_000.0, 32, 4)):
        rows = [(r.choice((n, n // 2)), [r.uniform(-spread, spread) for _ in range(r.choice((width, max(1, width - 1))))]) for n in range(420)]
        vectors = topk.written(topk.whole_numbers(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
        v = [(x.vec_id, np.array([*x.v] + [0] * (width - len(x.v)), object)) for x in vectors.collect()]
        asked = spark.createDataFrame([(7, [1] * width), (8, [-3] * width), (10**6, [0] * width)], "vec_id long, v array<long>")
        got = {}
        for x in topk.search(vectors, asked, k=k, block=block, portion=2).collect():
            got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
        for q, weight in ((7, 1), (8, -3), (10**6, 0)):
            want = sorted((-int(sum(x * weight for x in c)), i) for i, c in v if i != q)[:k]
            assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    big = spark.createDataFrame([(1, [1e17])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="scaled component"):
        topk.whole_numbers(big).collect()


def test_line_dedup(spark):
    rows = [(1, "page 1 of 9\nown a"), (2, "page 2 of 9\nown b"), (3, "page  3 of 8\n\nown c"), (4, "page 4 of 7"), (5, None), (6, "")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "page 1 of 9\nown a", 2: "own b", 3: "\nown c", 4: "", 5: None, 6: ""}


def test_licenses():
    mit = licenses.TEMPLATES["MIT"]
    found = licenses.Scanner().scan("word " * 50 + mit.replace("hereby", "now") + " filler " * 9 + mit)
    assert [(x[0], x[4]) for x in found] == [("MIT", 2)] and found[0][1] > 0.99
    assert licenses.Scanner().scan(None) == [] == licenses.Scanner().scan("of the software")


def test_license_scan_of_frames(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, mit, "x"), (1, mit, "x"), (None, "x " + mit, "x"), (2, None, "x"), (3, "", "x"), (4, "All rights reserved. " + mit, "x")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, license string"))
    assert got.columns == ["doc_id", "license", "coverage", "first_word", "last_word", "places"]
    assert sorted((str(r.doc_id), r.license) for r in got.collect()) == [("1", "MIT"), ("1", "MIT"), ("4", "MIT"), ("4", "all-rights-reserved"), ("None", "MIT")]
    assert licenses.scan(none(spark)).count() == 0


def test_quality_refits_agree(spark):
    rows = [(k % 40, f"w{k % 7} fine text " + ("awful " if k % 3 == 0 else "")) for k in range(120)]
    labels = spark.createDataFrame([(k, int(k % 3 != 1), int(k % 3 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = quality.train(docs, labels), quality.train(docs.repartition(7), labels)
    assert (one.weights == two.weights).all() and (one.cuts == two.cuts).all()
    few = quality.train(docs, labels, max_values=60)
    assert (few.cuts != one.cuts).any()
    assert quality.score(docs.limit(0), quality.train(docs, labels, max_values=0)).count() == 0


def test_quality(spark):
    rows = [(k, f"w{k % 7} fine text " + ("awful " if k % 3 == 0 else "") + ("zz$$$ yy%%% " if k % 3 == 1 else "")) for k in range(150)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 1), int(k % 3 == 0)) for k in range(120)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert all((r.tail_probability >= 0.5) == (r.doc_id % 3 == 2) for r in quality.score(docs, model).where("doc_id < 900").collect())
    assert quality.score(docs, quality.train(docs, labels.limit(0))).where("tail_probability < 0.5").count() == 0


def test_archives(spark):
    arc = archives.write_arc([("http://x/a b", "20010203040506", "text/html", archives.http_document(5, b"hi"))], 2)
    info, page = archives.convert(arc)
    assert info.kind == "warcinfo" and page.kind == "response" and page.headers["WARC-Date"] == "2001-02-03T04:05:06Z"
    (again,) = archives.read_warc(page.bytes())
    assert again.block == page.block and again.headers["WARC-Payload-Digest"] == "sha1:" + archives.digest(b"hi")
    rows = [(1, "u", "x"), (2, None, "x"), (3, "u", None), (0, "u", ""), (None, "z", "x")]
    folder = archives.new_folder(spark, "test")
    names = archives.written(archives.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder))
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in archives.read_back(spark, names, folder).collect()}
    assert got == {1: ("response", None, 1), 2: ("revisit", 1, 1), 3: ("revisit", 0, 0), 0: ("response", None, 0), None: ("revisit", 1, 1)}


def _records(names, folder):
    return [x for r in names.collect() for x in archives.read_warc(archives._fetch(folder, r.name))]


@pytest.mark.parametrize("version", [1, 2])
def test_archives_against_brute_force(spark, version):
    r = random.Random(version)
    urls = ["http://x/a%20b", "http://x/a b", "http://x/é?q=%41", None, "", "http://x/" + "y" * 3000]
    rows = [(r.choice((k, k // 3, None)), r.choice(urls), r.choice(("", None, "é" * 40, "HTTP/1.0 not a header", f"own {k}", "x\r\n\r\ny")), "x", "x") for k in range(120)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, sha string, lead string")
    folder = archives.new_folder(spark, "test")
    names = archives.written(archives.write_pages(docs, folder, version=version))
    got = sorted(map(str, (tuple(x) for x in archives.read_back(spark, names, folder).collect())))
    groups = {}
    for page, _, html, *_ in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    want = []
    for payload, pages in groups.items():
        pages.sort(key=lambda x: (x is None, x))
        sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want += [(p, len(payload), sha, "revisit" if k else "response", pages[0] if k else None) for k, p in enumerate(pages)]
    assert got == sorted(map(str, want))
    records = _records(names, folder)
    ids = [x.headers["WARC-Record-ID"] for x in records]
    assert len(set(ids)) == len(ids)
    by_id = {x.headers["WARC-Record-ID"]: x for x in records}
    assert all(by_id[x.headers["WARC-Refers-To"]].headers["WARC-Payload-Digest"] == x.headers["WARC-Payload-Digest"] for x in records if x.kind == "revisit")
    safe = {"http://x/a%20b", "http://x/%C3%A9?q=%41", "urn:page", "-", "http://x/" + "y" * 3000}
    assert {x.headers["WARC-Target-URI"] for x in records if x.kind != "warcinfo"} == safe


def test_archives_refuse_broken_input():
    arc = archives.write_arc([("u", "20010203", "text/html", b"hello")])
    for broken in (arc[:-4], b"x" * 30, arc.replace(b"1 0 kgloom", b"7 0 kgloom"), b"u 0.0.0.0 2001 text/html 3\nabc\n"):
        with pytest.raises(ValueError):
            list(archives.read_arc(broken))
    (record,) = list(archives.convert(arc))[1:]
    assert record.kind == "resource" and record.headers["WARC-Date"] == "2001-02-03T00:00:00Z"
    data = record.bytes()
    (again,) = archives.read_warc(data.replace(b"WARC-IP-Address: 0.0.0.0", b"WARC-IP-Address:0.0.0.0\r\n  and more"))
    assert again.headers["WARC-IP-Address"] == "0.0.0.0 and more" and again.block == b"hello"
    for broken in (data[:-9], data.replace(b"WARC-Date: ", b"WARC-Date "[:-1]), b"HTTP/1.0 x\r\n\r\n", data[:20]):
        with pytest.raises(ValueError):
            list(archives.read_warc(broken.replace(b"WARC-Date2001-02-03T00:00:00Z", b"nothing here")))


def test_archives_keep_equal_segments(spark):
    rows = [(None, None, "x" * (9 << 20))] * 3 + [(7, "u", "y" * (9 << 20))] * 3 + [(8, "u", "z")]
    folder = archives.new_folder(spark, "test")
    names = archives.written(archives.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), folder))
    got = sorted((str(r.page_id), r.record_type, r.refers_to) for r in archives.read_back(spark, names, folder).collect())
    tied = [("7", "response", None), ("7", "revisit", 7), ("7", "revisit", 7)]
    assert got == [*tied, ("8", "response", None), *[("None", kind, None) for kind in ("response", "revisit", "revisit")]]
    wrong = names.withColumn("records", names.records + 1)
    with pytest.raises(Exception, match="records read"):
        archives.read_back(spark, wrong, folder).collect()
    with pytest.raises(Exception, match="gone"):
        archives.read_back(spark, names.unionByName(spark.createDataFrame([("gone", 1)], "name string, records long")), folder)


def test_licenses_against_all_windows():
    r = random.Random(9)
    for name in ("MIT", "BSD-3-Clause", "GPL-3.0-header"):
        template = licenses.words(licenses.TEMPLATES[name])
        scanner = licenses.Scanner({name: licenses.TEMPLATES[name]})
        for missing in (0.1, 0.15, 0.18, 0.24):
            # The words that the copy lacks occur once elsewhere, its own words often.
            lacks = set(r.sample(range(len(template)), int(missing * len(template))))
            copy = [w for k, w in enumerate(template) if k not in lacks]
            body = [w for w in set(copy) for _ in range(4)] + [f"w{r.randrange(300)}" for _ in range(2500)]
            r.shuffle(body)
            rare = [template[k] for k in lacks]
            text = [*rare, *body[:1200], *copy, *body[1200:]]
            size = len(template) + 20
            most = max(len(licenses.align(template, text[k : k + size])) for k in range(0, len(text), 3))
            found = scanner.scan(" ".join(text))
            assert bool(found) == (most >= 0.8 * len(template)) == (missing < 0.2)
            assert not found or found[0][1] * len(template) >= most - 1 and found[0][4] == 1
    mit = licenses.TEMPLATES["MIT"]
    apart = lambda n: " ".join([*mit.split()[:80], *["foreign"] * n, *mit.split()[80:]])
    for text, places in ((apart(400), 1), (apart(5000) + " filler" * 900 + " " + apart(700), 2)):
        assert [(x[0], x[4]) for x in licenses.Scanner().scan(text)] == [("MIT", places)]
    rare = " ".join(f"{w} x" for w in ("hereby", "charge", "sublicense", "noninfringement"))
    moved = mit.replace("hereby", "now").replace("sublicense", "sell").replace("NONINFRINGEMENT", "MORE")
    assert [x[0] for x in licenses.Scanner().scan(rare + " filler" * 3000 + " " + moved)] == ["MIT"]
    assert licenses.Scanner().scan("licensed " + "so " * 300 + "under cc " + "so " * 300 + "by 4 0") == []
    edited = mit.replace("hereby", "now").replace("charge", "cost").replace("obtaining", "getting")
    assert [(x[0], x[4]) for x in licenses.Scanner().scan(mit + " filler" * 300 + " " + edited + " " + mit)] == [("MIT", 3)]


def test_line_dedup_finds_fields_by_what_varies(spark):
    rows = [(k, f"user {n} logged in from home\nown {'abcd'[k]}") for k, n in enumerate(("alice", "bob", "carol", "dave"))]
    rows += [(10 + k, f"Posted by {n} in News") for k, n in enumerate(("alice", "bob", "carol"))]
    rows += [(20 + k, f"a b c d e f {n} g h i j k {m} l") for k, (n, m) in enumerate((("x", "y"), ("z", "w"), ("u", "v")))]
    rows += [(33 + k, f"the house of {n}") for k, n in enumerate("XYZ")] + [(None, "user eve logged in from home")]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # Three constant tokens are too few for a template with <*>; two fields may stand in different runs.
    want = dict(rows) | {1: "own b", 2: "own c", 3: "own d", 11: "", 12: "", 21: "", 22: "", None: ""}
    assert got == want


def _line_brute(rows):
    """The texts that stay, by the definition: templates over words, no hashes."""
    split = lambda line: ["<*>" if any(c in "0123456789@" for c in t) or "://" in t else t for t in "".join(" " if c in "\t\v\f\r" else c for c in line).split(" ") if t]
    of, lines = {}, {}
    for at, (doc, text) in enumerate(rows):
        for w in {tuple(split(line)) for line in (text or "").split("\n")} - {()}:
            lines.setdefault(w, []).append((at, doc))

    def fits(w):
        rest = max(len(w) - 2, 0)
        cut = [w[:1], w[1:2], *[w[2 + rest * k // 4 : 2 + rest * (k + 1) // 4] for k in range(4)]]
        for mask in line_dedup._MASKS:
            left = sum(t != "<*>" for k, p in enumerate(cut) if k not in mask for t in p)
            if not mask or (left >= 4 and 2 * left >= len(w)):
                yield left, -len(mask), -sum(1 << k for k in mask), (len(w), mask, tuple(None if k in mask else p for k, p in enumerate(cut)))

    docs = {}
    for w, held in lines.items():
        for *_, t in fits(w):
            docs[t] = docs.get(t, 0) + len(held)
    taken = {}
    for w, held in lines.items():
        of[w] = max((docs[t], a, b, c, t) for a, b, c, t in fits(w))[-1]
        taken.setdefault(of[w], []).extend(held)
    out = []
    for doc, text in rows:
        stay = []
        for line in (text or "").split("\n"):
            held = taken.get(of.get(tuple(split(line))), [])
            ids = [d for _, d in held if d is not None]
            often = len(held) >= 3 and ids and len({d for _, d in held}) > 1
            if not often or doc == min(ids):
                stay.append(line)
        out.append((str(doc), None if text is None else "\n".join(stay)))
    return sorted(out, key=str)


def test_line_dedup_against_brute_force(spark):
    r = random.Random(12)
    words = "one two three four five six seven 8 nine@x <*> x://y".split()
    frames = [[r.choice(words) for _ in range(r.choice((1, 2, 4, 6, 9, 13)))] for _ in range(25)]
    rows = []
    for k in range(90):
        text = []
        for _ in range(r.randrange(7)):
            line = list(r.choice(frames))
            for _ in range(r.randrange(3)):
                line[r.randrange(len(line))] = r.choice(words)
            text.append(r.choice((" ", "  ", "\t")).join(line))
        rows.append((r.choice((k, k // 2, None)), r.choice(("\n", "\n\n")).join(text) if k % 11 else None))
    got = sorted(((str(x.doc_id), x.text) for x in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == _line_brute(rows)
