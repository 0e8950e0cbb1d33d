"""Cases in which an operator once did less than the whole job."""

import random
from collections import Counter

from keyloom.llm import decontamination, html, toxicity

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def test_menu_cuts_no_text_off():
    page = "<div><h1>T</h1><p>short intro</p><ul class=menu><li>a<li>b<li>c</ul><p>" + "long " * 80 + "</p><div class=ads><p>x<p>y<p>z</div><p>end</p></div>"
    assert html.main_text(page) == "T\nshort intro\n" + ("long " * 80).strip() + "\nend"


def test_short_items_leak_inside_long_documents(spark):
    items = [(1, "one"), (2, "Two words"), (3, "now three words"), (4, "these are four words"), (5, "five words are in here"), (6, "one"), (7, None), (8, "")]
    texts = ["a b c d e f one g", "one", "two WORDS", "x two words y z q r s", "now three", "a now three words", "these are four words", "p q these are four words r s", "these are four", "so five words are in here now", None, "", "one one b c d e f one"]
    want = {}
    for d, t in enumerate(texts):
        w = (t or "").lower().split()
        for i, x in items:
            v = (x or "").lower().split()
            windows = [w[k : k + len(v)] for k in range(max(1, len(w) - len(v) + 1))] if v and w else []
            for k, own in enumerate(windows):
                a, b = (Counter(tuple(y[j : j + 5]) for j in range(max(1, len(y) - 4))) for y in (own, v))
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                    want.setdefault((d, i), k)
    out = decontamination.leaks(spark.createDataFrame(list(enumerate(texts)), DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id): r.start for r in out} == want and (0, 1) in want and all(r.similarity == 1 for r in out) and len(out) == len(want)


def test_documents_without_id_are_judged(spark):
    item = " ".join(f"q{i}" for i in range(20))
    items = spark.createDataFrame([(1, item), (2, "two words")], ITEMS)
    clean = [(None, "nothing to see here at all"), (3, "a b c d e f")]
    for leak in (f"x y z {item} x y", "some two words in a row here"):
        docs = spark.createDataFrame([*clean, (None, leak), (4, leak)], DOCS)
        assert {r.doc_id for r in decontamination.leaks(docs, items).collect()} == {None, 4}
        assert [r.doc_id for r in decontamination.drop_leaks(docs, items).collect()] == [3]
    docs = spark.createDataFrame([*clean, (4, f"x y z {item} x y")], DOCS)
    assert {r.doc_id for r in decontamination.drop_leaks(docs, items).collect()} == {None, 3}


def test_fit_reads_whole_texts_and_all_windows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda sample, share: seen.extend(sample) or share)
    text = "word " * 9000 + "end"
    toxicity.learn(spark.createDataFrame([(1, text), (2, "x")], DOCS), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert sorted(seen) == [(text, 1), ("x", 0)]
    trained = []
    monkeypatch.setattr(toxicity.zstd, "train_dictionary", lambda size, samples, **how: trained.append(samples) or toxicity.zstd.ZstdCompressionDict(b"x" * 64))
    toxicity.train_dictionaries([[b"a"] * 8] * 250_000 + [[b"last"] * 8], [[b"b"] * 8])
    assert len(trained[0]) == 2 * 250_001 and b"last" in trained[0][-1]


#: Names that the operators use inside, and columns that clash with results.
CLASHES = ["__w", "__lines", "__kept", "__base_failed", "__body", "__found", "__key", "__mark", "__null", "__bad", "__text", "row", "fence", "spans", "clean", "fp", "root", "sig", "h", "at"]


def test_stages_keep_odd_rows_and_columns(spark, tmp_path):
    import corpus_pipeline

    rng, text = random.Random(4), " ".join(f"w{i}" for i in range(70))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (None, text + " tail", "en", None, 3), (3, "", "de", "b", 0), (None, None, None, None, None), (4, "mail a@b.co " + " ".join(f"w{rng.randrange(70)}" for _ in range(9000)), "en", "a", 1)]
    docs = spark.createDataFrame([(*r, *[f"{i}{c}" for c in CLASHES]) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    spark.createDataFrame([(1, "some item of the benchmark here"), (2, None)], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {"quality_rules": [None, 1, 1, 4], "near_duplicates": [1, 2, 4], "decontamination": [None, None, 1, 1, 2, 3, 4], "personal_data": [None, None, 1, 1, 2, 3, 4]}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and sorted((r.doc_id for r in got), key=str) == sorted(want[name], key=str), name
        assert all(r[c][0] == r["__w"][0] and r[c][1:] == c for r in got for c in CLASHES)
        if name == "personal_data":
            assert [r.text[:12] for r in got if r.doc_id == 4] == ["mail <email>"] and [r.n_chars for r in got if r.doc_id == 2] == [None]
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.columns == docs.columns and none.count() == 0
    assert corpus_pipeline.packing(spark, docs, "").select("doc_id").distinct().count() == 5 and corpus_pipeline.packing(spark, docs.limit(0), "").count() == 0


def test_radius_recall(spark):
    rng, near, apart, total, shared = random.Random(5), 0, 0, 0, 0
    edges = [64 * i // (decontamination.RADIUS + 1) for i in range(decontamination.RADIUS + 2)]
    bits = lambda shingles: sum((sum(x >> b & 1 for x in shingles) * 2 > len(shingles)) << b for b in range(64))
    for _ in range(1500):
        n = rng.choice((12, 20, 35, 55))
        a = [rng.getrandbits(64) for _ in range(n)]
        lost = int(n * 0.2 / 1.8)  # the most that leaves 0.8
        b = a[lost:] + [rng.getrandbits(64) for _ in range(lost)]
        total += 1
        near += bin(bits(a) ^ bits(b)).count("1") <= decontamination.RADIUS
        c = bits([rng.getrandbits(64) for _ in range(n)]) ^ bits(a)
        apart += bin(c).count("1") > decontamination.RADIUS
        shared += all(c >> lo & (1 << hi - lo) - 1 for lo, hi in zip(edges, edges[1:]))
    assert near >= 0.999 * total and apart > 0.9 * total
    print("recall", near / total, "unlike pairs beyond the radius", apart / total, "removed by blocks", shared / total)
