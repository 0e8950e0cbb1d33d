"""The corpus operators against brute force, on small tables with nulls, blanks, ties, repeats, long texts and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import chat, decontamination, html, packing, pii, quality, simhash, substrings, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(7)
VOCAB = ["the", "of", "Été", "scum", "ab", "x" * 30, "y", "lorem", "IPSUM", "dolor", "sit", "amet"]


def prose(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


LONG = prose(4000)
TEXTS = [prose(n) for n in (0, 1, 3, 4, 5, 60, 200, 200, 30)] + [None, "", "  \n\t ", LONG, LONG, LONG[:9000] + "zz" + LONG[9000:], "-" * 700, "ab" * 300, "a@b.co 4111 1111 1111 1111\nline\nline\n"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, fp long, class int"


def corpus(spark, texts=TEXTS):
    rows = [(i, t, None if i % 4 == 0 else "en", f"s{i % 2}", len(t or ""), 1, 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_fixity_finds_each_damaged_record(spark):
    pages = spark.createDataFrame([(i, f"u{i}", f"<p>{i}</p>") for i in range(3000)] + [(5, "u5", "<p>5</p>"), (5, None, None), (None, "u", "x")], "page_id long, url string, html string")
    bad = pages.withColumn("html", F.when(F.col("page_id").isin(17, 2049), F.concat(F.lit("<q"), F.substr("html", F.lit(3)))).otherwise(F.col("html")))
    one = warc.manifest(pages).cache()
    found = warc.audit(one, warc.manifest(bad)).groupBy("status").agg(F.collect_set("page_id").alias("ids"), F.count("*").alias("n")).collect()
    assert {r.status: (sorted(r.ids) if r.status == "corrupt" else r.n) for r in found} == {"corrupt": [17, 2049], "sound": 3001}
    height = warc.heights(one)
    looked = warc.compare(warc.tree(one, "a", height), warc.tree(one, "b", height))[1]
    assert sum(looked) == 1
    assert warc.audit(one.limit(0), one.limit(0)).count() == 0


def test_fixity_tells_moved_missing_and_extra(spark):
    rows = [(i, f"u{i}", f"<p>{i}</p>") for i in range(60)]
    other = [r for r in rows if r[0] != 20] + [(60 + i, "new", "page") for i in range(20_000, 20_002)] + [(30, "u30", "<p>30</p>")]
    other[10] = (10, "u10", "<p>longer than before</p>")
    schema = "page_id long, url string, html string"
    primary, replica = (warc.manifest(spark.createDataFrame(x, schema)) for x in (rows, other))
    got = {(r.page_id, r.status) for r in warc.audit(primary, replica).collect()}
    assert (20, "missing") in got and (10, "corrupt") in got and {(20_060, "extra"), (20_061, "extra"), (30, "extra")} <= got
    assert {i for i, s in got if s == "moved"} == set(range(11, 60)) - {20} and {i for i, s in got if s == "sound"} == set(range(10))
    assert {r.status for r in warc.audit(primary, primary.limit(0)).collect()} == {"missing"} and {r.status for r in warc.audit(primary.limit(0), primary).collect()} == {"extra"}


def brute_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(rows):
        b = (t or "").encode()
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                hit[i] += 1
                hit[min(len(b), i + 100)] -= 1
            else:
                seen.add(b[i : i + 100])
        c = np.cumsum(hit)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~c].tobytes()
        out[d] = (len(b), int(c.sum()), int((np.diff(np.concatenate(([0], c.astype(int), [0]))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [500, 0])
def test_repeated_strings(spark, docs, none, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    out = substrings.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    assert {r[0]: tuple(r)[1:] for r in out.collect()} == brute_repeats(list(enumerate(TEXTS)))
    assert substrings.remove_repeats(none).count() == 0


def test_suffix_order():
    for _ in range(20):
        t = bytes(RNG.choice(b"aabc\x00\xff") for _ in range(RNG.randint(0, 300)))
        order = substrings.suffix_order(np.frombuffer(t, np.uint8)).tolist()
        cut = [t[i : i + 100] for i in order]
        assert sorted(order) == list(range(len(t))) and all(a <= b or a.rstrip(b"\0") == b.rstrip(b"\0") for a, b in zip(cut, cut[1:]))


def test_toxicity_learns_and_defines_empty(spark, none):
    bad = ["you utter moronish clown", "such pathetic trashy scumbag"]
    texts = [(prose(60), 0) for _ in range(150)] + [(prose(20) + " " + RNG.choice(bad) + " " + RNG.choice(bad) + " " + prose(20), 1) for _ in range(60)] + [(None, 0), ("", 0)]
    docs = corpus(spark, [t for t, _ in texts])
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)] + [(None, 1), (0, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    fresh = corpus(spark, [prose(80), prose(30) + " " + bad[0] + " " + bad[1] + " " + prose(30), None, ""])
    s = {r.doc_id: r.score for r in toxicity.score(fresh, model, ["doc_id"]).collect()}
    assert s[1] > 0.5 > max(s[0], s[2]) and s[2] == s[3]
    assert toxicity.learn(none, labels.limit(0)) == 0.0 and toxicity.score(none, 0.0, ["doc_id"]).count() == 0


def test_quality_counts_and_fences(spark, docs, none):
    out = {r.doc_id: r for r in quality.with_measures(docs).collect()}
    for i, t in enumerate(TEXTS):
        w = WORD.findall(t or "")
        tri = Counter(zip(w, w[1:], w[2:]))
        cover = {k for j in range(len(w) - 2) if tri[tuple(w[j : j + 3])] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = out[i]
        assert (r["__n_words"], r["__word_chars"], r["__n_dup_lines"], r["__n_repeat_words"]) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
    many = corpus(spark, [" ".join(f"w{RNG.randrange(10**6)}" for _ in range(60)) for _ in range(120)] + [" ".join(f"w{RNG.randrange(10**6)}***" for _ in range(60)), None])
    kept = quality.filter_quality(many)
    assert kept.columns == many.columns and {r.doc_id for r in kept.collect()} == set(range(120))
    assert quality.filter_quality(none).count() == 0
    assert [r[0] for r in spark.createDataFrame([(0,), (255,), (256,), (1001,)], "v long").select(quality.bucket(F.col("v"))).collect()] == [0, 255, 256, 1000]


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 if x > 4 else 2 * x for i, x in enumerate(map(int, d[::-1]))) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def test_personal_data(spark, none):
    alphabet = ["a", "b.", "@", "é", "1", "4111", " ", "-", "+", "1.2.3.4", "255", ".", "(", ")", "+1 555 123 4567", "a.b@c.de", "4111 1111 1111 1111", "_", "%"]
    texts = ["".join(RNG.choice(alphabet) for _ in range(40)) for _ in range(150)] + ["1 2 " * 3000, "9" * 4000 + "." + "a" * 30000, None, "", "call (555) 123-4567 or Dr. Jane Doe"]
    for r in pii.with_candidates(corpus(spark, texts)).select("doc_id", "__found").collect():
        t = texts[r.doc_id] or ""
        want = sorted((m.start(), i, m.end()) for i, k in enumerate(PII) for m in re.finditer(PII[k], t) if valid(k, m[0]))
        assert sorted((f.start, f.order, f.stop) for f in r["__found"] if f.base) == want
    clean = pii.redact(corpus(spark, ["mail a@b.co now", None, "", "plain"]))
    assert [r.text for r in clean.orderBy("doc_id").collect()] == ["mail <email> now", None, "", "plain"] and clean.columns == corpus(spark).columns
    assert pii.redact(none).count() == 0 and set(pii.train([])) == {0.0}


def test_labelers_reliabilities_are_recovered():
    rng = np.random.default_rng(3)
    right, silent, share, n = (0.95, 0.85, 0.9, 0.6), (0.1, 0.3, 0.5, 0.0), 0.4, 40_000
    truth = rng.random(n) < share
    votes = [np.where(rng.random(n) < quiet, 0, np.where(rng.random(n) < p, 1, -1) * np.where(truth, 1, -1)) for p, quiet in zip(right, silent)]
    tables, post = pii.reliabilities([("secret", *v, m) for v, m in Counter(zip(*(v.tolist() for v in votes))).items()])
    assert abs(tables["secret", "prior"][1] - share) < 0.03
    for name, p, quiet in zip(pii.LABELERS, right, silent):
        assert abs(tables["secret", name, 1][1] - p * (1 - quiet)) < 0.04 and abs(tables["secret", name, 0][-1] - p * (1 - quiet)) < 0.04
    weights = pii.train([("secret", *v, m) for v, m in Counter(zip(*(v.tolist() for v in votes))).items()])
    score = lambda v: sum(a * b for a, b in zip(weights, pii._features("secret", v)))
    assert np.mean([(score(v) > 0) == y for v, y in zip(zip(*votes), truth)]) > np.mean([(sum(v) > 0) == y for v, y in zip(zip(*votes), truth)]) > 0.8


def test_classifier_takes_and_rejects_loose_spans(spark):
    token = "".join("0123456789abcdef"[RNG.randrange(16)] for _ in range(40))
    texts = [f'id {i} token = "{i % 10}{token}" end' for i in range(20)] + [f"order {n} shipped" for n in range(9000000000000001, 9000000000000099) if not valid("card", str(n))][:20] + ["version 1.2.3.400 out", "a" * 50, "x" * 40 + "-" + "y" * 9]
    clean = [r.text for r in pii.redact(corpus(spark, texts)).orderBy("doc_id").collect()]
    assert clean[:20] == [f'id {i} token = "<secret>" end' for i in range(20)] and clean[20:] == texts[20:]


def test_many_spans_keep_their_places(spark):
    texts = ["é a@b.co 4111 1111 1111 1111 " * 150, " ".join(["1.2.3.4"] * 200) + "@x.de"]
    clean = [r.text for r in pii.redact(corpus(spark, texts)).orderBy("doc_id").collect()]
    assert clean[0] == "é <email> <card> " * 150 and clean[1] == " ".join(["<ip>"] * 199) + " <email>"


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", r"<\/s> [\\INST] <|image|> <\|audio|>", "", None, "é🙂<s>"]
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", None, "assistant", "as<s>sistant"], odd))] + [(9, 0, "assistant", "a"), (9, 0, "assistant", "a"), (None, None, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    assert [(t.role, t.text) for t in got[0].turns] == [(r or "", x or "") for r, x in zip(["user", "assistant", None, "assistant", "as<s>sistant"], odd)]
    assert got[0].loss_text == odd[1] and got[9].loss_text == "aa" and got[None].n_turns == 1
    parts = [(1, 0, "user", [("text", "a", None, None, None, None, None), ("image", None, "x.png", 100, 60, None, None), ("audio", None, "y.wav", None, None, 2.0, None), (None, None, "d.pdf", None, None, None, 3)]), (1, 1, "assistant", None)]
    r = chat.format_conversations(spark.createDataFrame(parts, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "x.png", 12), ("audio", "y.wav", 25), ("document", "d.pdf", 1536)] and "a<|image|><|audio|><|document|>" in r.formatted
    assert chat.format_conversations(df.limit(0).withColumn("parts", chat.text_parts(F.col("text")))).count() == 0


def test_leaks_match_all_windows(spark, docs, none):
    items = [(i, " ".join(f"q{i}w{j}" for j in range(n))) for i, n in enumerate((40, 12, 5, 3, 1))] + [(90, None), (91, "")]
    base = [dict(items)[i].upper() for i in (0, 1, 2, 3)]
    edited = base[0].split()
    edited[20] = "changed"
    texts = [prose(30) + " " + base[0] + " " + prose(30), prose(5) + " " + " ".join(edited), base[1] + " " + base[2], base[3], "q4w0", None, prose(100), " ".join(base[0].split()[:10]), " ".join(base[0].split()[20:] + base[0].split()[:20])]
    shingles = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    want = set()
    for d, t in enumerate(texts):
        s = shingles((t or "").lower().split())
        for i, x in items:
            b = shingles((x or "").lower().split())
            m = min(len(b), len(s))
            if m and any((o := sum((Counter(s[k : k + m]) & Counter(b)).values())) / (m + len(b) - o) >= 0.8 for k in range(len(s) - m + 1)):
                want.add((d, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(corpus(spark, texts), bench).collect()} == want and (0, 0) in want
    assert decontamination.leaks(none, bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_simhash_components(spark, docs, none):
    base = [prose(300) for _ in range(6)]
    texts = TEXTS + [b + " tail" for b in base] + base + [" ".join(b.split()[:-1]) for b in base]
    fps = [simhash.fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in root:
        for i in range(len(texts)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 4:
                    root[i] = root[j] = min(root[i], root[j])
    out = {r.doc_id: r.component_id for r in simhash.near_duplicate_components(corpus(spark, texts)).collect()}
    assert out == dict(enumerate(root)) and fps[TEXTS.index(None)] == 0
    kept = simhash.drop_near_duplicates(corpus(spark, texts))
    assert {r.doc_id for r in kept.collect()} == set(root) and kept.columns == docs.columns
    assert simhash.near_duplicate_components(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0
    assert len(simhash.masks(100)) == 15 and len(simhash.masks(10**9)) == 35


def test_html_main_text():
    page = """<html><body><header><h1>Site</h1></header><nav>Menu</nav><div class="cookie-notice">We use cookies</div><div id="content"><h1>T&eacute;st &amp</h1><p>A  b<br>c <i>d</i>e.<p>Second<ul><li>x<li>y</ul>
    <form>F <input></form></div><div class="comments"><p>Nice!</p></div><aside>side</aside><footer>foot</footer></body>"""
    assert html.main_text(page) == "Tést &\nA b c de.\nSecond\nx\ny"
    assert html.main_text("<article><header><h1>A</h1></header>1 < 2 <b>x</b><!-- c") == "A\n1 < 2 x"
    assert html.main_text("<div>ad</div><article><h1>T</h1><p>Ti.</p></article><footer>f</footer>") == "T\nTi."
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>var t='</p>'") == ""
    assert html.stretches(np.array([0, 0, 5, 9, 0, 0, 0, 0, 7, 0])) == [(2, 4), (8, 9)] and html.stretches(np.zeros(3, int)) == []
    assert html.stretches(np.array([1, 0, 0, 0, 50, 60, 0, 0, 0, 1])) == [(4, 6)]


def test_html_curve_chooses_the_place(spark, none):
    side = "<nav><ul><li><a href=x>Home</a></ul></nav>"
    ad, tail = "<div class=ad><p>buy<p>now<p>here</div>", "<footer>foot</footer>"
    body = [" ".join(["word"] * 60) + ".", " ".join(["rest"] * 20) + "."]
    inner = f"<h1>Title</h1><p>{body[0]}</p>{ad}<p>{body[1]}</p><p>End."
    want = "\n".join(["Title", *body, "End."])
    talk = "<div class=comments>" + f"<p>{body[0]}" * 9 + "</div>"
    shells = ["<article>{}</article>", '<div class="content has-sidebar">{}</div><div class=sidebar><p>side</div>', '<section class="alert-story share">{}</section>', "<main><div>{}</div></main>", "<article>{}" + talk + "</article>", "<div>{}</div>" + talk]
    pages = [f"<html><body>{side}{s.format(inner)}{tail}</body></html>" for s in shells]
    pages += [f"<body><div id=a><p>short teaser</div><div id=b>{inner}</div></body>", "<body>" + "<p>" + "<a href=x>all links</a></body>", None, "", "<script>x</script>", pages[0]]
    rows = [(i, f"u{i}", p, 7, 8) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text long, __html long")
    got = [r.text for r in html.extract(df.drop("text"), ["page_id", "__html"]).orderBy("page_id").collect()]
    assert got[:6] == [want] * 6 and got[6] == want and got[7:] == ["all links", "", "", "", want]
    assert html.extract(df.drop("text").limit(0), ["page_id"]).count() == 0
    assert [html.main_lines(p)[1] for p in pages[:4]] == [False, True, True, False]


def test_packing_places_every_id_once(spark, docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.vocabulary_path())
    texts = TEXTS + ["<|endoftext|> hi", "日本語 Σας ΟΔΟΣ", "It's a TEST, they'll we're I'd", "é café ŉ İ ſ"]
    pieces = packing.pack(corpus(spark, texts)).toPandas()
    for d, t in enumerate(texts):
        ids, at = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4"), 0
        for p in pieces[pieces.doc_id == d].sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate(([0], np.cumsum(g.length)[:-1]))).all() and g.length.sum() <= packing.WINDOW
    assert packing.pack(none).count() == 0
    a = np.random.default_rng(1).random((20, 60))
    x = packing.nnls(a, a @ np.maximum(0, np.random.default_rng(2).normal(size=60)))
    assert (x >= 0).all() and np.abs(a @ x - a @ np.maximum(0, np.random.default_rng(2).normal(size=60))).max() < 1e-6


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "personal_data", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "sequence_id", "ids_crc32"} <= set(out.columns) and out.count() > 100
