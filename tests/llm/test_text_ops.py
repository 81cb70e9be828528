"""Chat formatting, HTML, licences, decontamination, language, quality: edge cases and brute force."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from odweave.llm import chat_format, decontaminate, html_extract, language_id, license_scan, quality_pu


def test_escape_round_trip(spark):
    rnd = random.Random(1)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[IMG]", "\\", "~", "\\~", "<", "[", "a", "\n", "INST]", "é", "[[INST]INST]", "/s>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", chat_format.escape(F.col("t")).alias("e")).select("t", "e", chat_format.unescape(F.col("e")).alias("u"))
    for r in df.collect():
        assert r.u == r.t and not re.search(r"</?s>|\[/?(INST|IMG|AUD|DOC)\]", r.e)


def test_chat_edges(spark):
    rows = [(1, 1, "assistant", "two[/INST]"), (1, 0, "user", None), (2, 0, None, ""), (None, 0, "user", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("clash"))
    got = chat_format.format_conversations(df.select("*", chat_format.text_part(F.col("text")).alias("parts")))
    got = got.select("*", chat_format.read_turns(F.col("formatted")).alias("t"), chat_format.loss_text(F.col("formatted"), F.col("loss_mask")).alias("l"))
    by = {r.conv_id: r for r in got.collect()}
    assert by[1].l == "two[/INST]" and [t.role for t in by[1].t] == ["user", "assistant"] and by[1].n_turns == 2
    assert by[2].t[0].role == "" and by[None].n_turns == 1 and by[3].n_turns == 2
    assert all(sum(m.n_chars for m in r.loss_mask) == len(r.formatted) for r in by.values())
    assert chat_format.format_conversations(df.limit(0).select("*", chat_format.text_part(F.col("text")).alias("parts"))).count() == 0


def test_typed_parts(spark):
    part = lambda **k: tuple(k.get(n) for n in ("kind", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part(kind="text", text="see [IMG]0.0[/IMG] "), part(kind="image", ref="a.png", width=28, height=15), part(kind="text", text=" and "), part(kind="audio", ref="b.wav", seconds=2.0), part(kind="document", ref="c.pdf", pages=2), part(kind="odd", text="?")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn int, role string, parts {chat_format.PARTS}")
    r = chat_format.format_conversations(df).select("*", F.transform(chat_format.read_turns(F.col("formatted")), lambda t: chat_format.read_parts(t["body"])).alias("p")).first()
    mask, at, trained = r.loss_mask, 0, ""
    for m in mask:
        trained += r.formatted[at : at + m.n_chars] if m.in_loss else ""
        at += m.n_chars
    assert at == len(r.formatted) and trained == ""
    said = spark.createDataFrame([(1, 0, "assistant", parts)], f"conv_id long, turn int, role string, parts {chat_format.PARTS}")
    assert chat_format.format_conversations(said).select(chat_format.loss_text(F.col("formatted"), F.col("loss_mask")).alias("l")).first().l == "see [IMG]0.0[/IMG]  and ?"
    assert r.p[0] == ["see [IMG]0.0[/IMG] ", "[IMG]0.1[/IMG]", " and ", "[AUD]0.3[/AUD]", "[DOC]0.4[/DOC]", "?"] and r.p[1] == []
    assert [(a.turn, a.part, a.ref, a.n_tokens) for a in r.attachments] == [(0, 1, "a.png", 6), (0, 3, "b.wav", 50), (0, 4, "c.pdf", 2048)] and r.expanded_tokens == 2104


PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p><article>no";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies<div class="ad">Buy<p>more</div>
<article><header><h1>Title&nbsp;&lt;x&gt;</h1></header><p>One <b>bold</b>ly<br>two<p>Three &copy &am 4 < 5<aside>side</aside><form><label>Mail</label></form>
<!-- no --><table><tr><td>c1<td>c2</table><section id="comments"><p>nice!</p></section></article><div class="sidebar">side</div><footer>foot</footer></body></html>"""


def test_long_conversation(spark):
    """Thousands of turns of null ids, with characters of one to four bytes and empty texts, come back whole and in time."""
    said = lambda i: ["", "é</s>", "日本 \\~", "\U0001f600" * 3, "plain " * 15][i % 5]
    rows = [(None, i, "assistant" if i % 3 else "user", said(i)) for i in range(9_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat_format.format_conversations(df.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts")))
    start = time.time()
    got = out.select("n_turns", chat_format.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()
    assert len(got) == 1 and got[0].n_turns == 9_000 and got[0].loss == "".join(said(i) for i in range(9_000) if i % 3) and time.time() - start < 15
    none = spark.range(1).select(F.lit("abc").alias("f"), F.array().cast("array<struct<n_chars:int,in_loss:boolean>>").alias("m"))
    assert none.select(chat_format.loss_text(F.col("f"), F.col("m")).alias("s")).first().s == ""


def test_html():
    assert html_extract.extract_text(PAGE) == "Title <x> One boldly two Three © &am 4 < 5 c1 c2"
    for empty in (None, "", "<html></html>", "<!-- only", "<nav>menu</nav>"):
        assert html_extract.extract_text(empty) == ""
    assert html_extract.extract_text("plain words only") == "plain words only"
    long = "word " * 60
    plain = f"<body><div><a href=1>Home</a></div><div><a href=2>About</a></div><p>x</p><div></div><div>a</div><p>{long}</p><p>{long}</p><div><a>next</a></div></body>"
    assert long.strip() in html_extract.extract_text(plain) and "Home" not in html_extract.extract_text(plain)
    assert html_extract.extract_text("<article>" + "<p>" * 3000 + "deep" + "<div title='a>b'>x") == "deep x"
    assert html_extract.extract_text("<article><p>a <unclosed 'b") == "a"


def test_line_blocks_by_definition():
    rnd = random.Random(4)
    for _ in range(3000):
        n, w, limit = rnd.randrange(0, 14), rnd.choice([1, 2, 3, 4]), rnd.choice([0, 5, 30])
        weights = [rnd.choice([0, 0, 0, 1, 4, 9, 40]) for _ in range(n)]
        sums = [sum(weights[max(0, i - w + 1) : i + 1]) for i in range(n)]
        top = max(sums, default=0)
        least = limit if top > limit else top // 2
        want, i = [], 0
        while i < n:
            if not sums[i]:
                i += 1
                continue
            j = i
            while j < n and sums[j]:
                j += 1
            if max(sums[i:j]) > least:
                want.append((i, max(k for k in range(i, j) if weights[k]) + 1))
            i = j
        assert html_extract.stretches(weights, w, limit) == want


def test_pages_without_an_article():
    """Text lengths alone tell text from short lines where markup names nothing."""
    rnd = random.Random(6)
    for _ in range(40):
        text = [" ".join(rnd.choice(["river", "stone", "over", "the", "of"]) for _ in range(rnd.randrange(25, 60))) for _ in range(rnd.randrange(1, 6))]
        short = lambda n: "".join(f"<div>{rnd.choice(['Home', 'About', 'More'])}</div>" + "<div><a href=x>link to another page of this site</a></div>" * 3 for _ in range(n))
        page = f"<body>{short(3)}" + "".join(f"<div>{t}</div>" for t in text) + f"<div><a>next</a></div>{short(3)}</body>"
        got = html_extract.extract_text(page)
        assert got.startswith(text[0][:60]) and all(t in got for t in text) and len(got) <= sum(map(len, text)) + 40
    inside = "<article><p>" + "long words " * 20 + "</p><div class=ad><p>x</p><p>y</p><p>z</p></div><p>The end.</p></article><p>" + "outside " * 40
    assert html_extract.extract_text(inside) == ("long words " * 20).strip() + " The end."


def test_deep_pages_take_linear_time():
    import time

    for piece in ("<div>x", "<nav><article>y", "<!-- a -->z<p>", "<table><tr><td><p>q", "<a><b>"):
        html_extract.extract_text(piece * 500)
        began = time.process_time()
        html_extract.extract_text(piece * 60_000)
        assert time.process_time() - began < 20


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "<article>a</article>", "old"), (2, None, None)], "page_id long, html string, text string")
    assert [tuple(r) for r in html_extract.extract_pages(df).orderBy("page_id").select("page_id", "text").collect()] == [(1, "a"), (2, "")]
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT"]
    near = mit.replace("copies of the Software", "copies of the Programme", 1)
    rnd = random.Random(2)
    fill = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    docs = [(1, fill(300) + " " + mit + " " + fill(40)), (2, near), (3, fill(3000)), (4, None), (5, ""), (6, "Released under the MIT license!"), (7, mit[: len(mit) // 2]), (8, "license"), (9, "LICENSED under the apache license version 2 0"), (9, "Licensed under the Apache License, Version 2.0.")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("_key", F.lit(1)).withColumn("license", F.lit("x"))
    got = {(r.doc_id, r.license): r for r in license_scan.scan_licenses(df).collect()}
    assert set(got) == {(1, "MIT"), (2, "MIT"), (6, "MIT-notice"), (9, "Apache-2.0-notice")}
    assert got[1, "MIT"].containment == 1.0 and got[2, "MIT"].containment < 1 and 44 < got[1, "MIT"].first_word <= 300
    assert license_scan.scan_licenses(df.limit(0)).count() == 0 and license_scan.scan_licenses(df, {}).count() == 0
    assert license_scan.bands_for(0.5, 1e-4) == 14


def test_decontamination_brute(spark):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([3, 12, 30, 31])))) for i in range(12)] + [(50, None), (51, " "), (52, "")]
    docs = []
    for d in range(60):
        w = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 120))]
        if d % 3 == 0:
            piece = items[rnd.randrange(12)][1].split()
            if d % 2:
                piece[rnd.randrange(len(piece))] = "Changed"
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rnd.choice(["", ",", "."]) for x in piece]
        docs.append((d, " ".join(w)))
    docs += [(100, None), (101, "..."), (102, docs[0][1]), (102, docs[0][1])]
    want = []
    for d, t in docs:
        w = decontaminate.words_of(t)
        for i, x in items:
            b = decontaminate.words_of(x)
            n, bag = len(b), decontaminate.shingles_of(b)
            sims = [(decontaminate.weighted_jaccard(decontaminate.shingles_of(w[a : a + n]), bag), -a) for a in range(len(w) - n + 1)] if n else []
            if sims and max(sims)[0] >= 0.8:
                want.append((d, i, max(sims)[0], -max(sims)[1], n))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.find_contamination(df, bench).collect())
    assert got == sorted(want) and any(0.8 <= m[2] < 1 for m in want)
    assert sorted(tuple(r) for r in decontaminate.find_contamination(df, bench, pass_words=40).collect()) == got
    kept = {r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {m[0] for m in want}
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0 and decontaminate.find_contamination(df, bench.limit(0)).count() == 0


def test_recall_of_windows_by_similarity():
    """Items with changed words, from the limit upwards: the fingerprints of all that verify are within the radius."""
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(4000)]
    seen = 0
    for n in (12, 30, 60, 200, 600):
        words = [rnd.choice(vocab) for _ in range(n)]
        index = decontaminate.BenchmarkIndex([(1, " ".join(words))])
        for _ in range(120):
            own, k = list(words), rnd.randrange(0, max(2, n // 40))
            for i in ([rnd.randrange(n) for _ in range(k)] if rnd.random() < 0.5 else range(k)):  # scattered, or together at the start
                own[i] = rnd.choice(vocab)
            text = [rnd.choice(vocab) for _ in range(20)] + own + [rnd.choice(vocab) for _ in range(20)]
            sims = [decontaminate.weighted_jaccard(decontaminate.shingles_of(text[a : a + n]), index.bags[0]) for a in range(41)]
            got = index.matches(" ".join(text))
            assert bool(got) == (max(sims) >= 0.8)
            if got:
                seen += 1
                assert got[0][1] == max(sims) and got[0][2] == sims.index(max(sims))
    assert seen > 200


def test_long_items_and_text_ids(spark, monkeypatch):
    rnd = random.Random(9)
    item = " ".join(f"v{rnd.randrange(900)}" for _ in range(3000))
    monkeypatch.setattr(decontaminate, "WORDS", 101)
    monkeypatch.setattr(decontaminate, "WINDOWS", 7)
    index = decontaminate.BenchmarkIndex([(7, item), (8, "\n".join(item.split()[:40]))])
    assert index.matches("x y " + item + " z") == [(7, 1.0, 2, 3000), (8, 1.0, 2, 40)]
    df = spark.createDataFrame([("a", item), (None, item)], "doc_id string, text string")
    got = decontaminate.find_contamination(df, spark.createDataFrame([(8, item[:200])], "item_id long, text string")).collect()
    assert [r.doc_id for r in got] == ["a", None]


def test_multi_index_finds_all():
    import numpy as np

    items = [(i, " ".join(f"v{(i * 7 + j * j) % 90}" for j in range(20))) for i in range(40)]
    index = decontaminate.BenchmarkIndex(items)
    rng = np.random.default_rng(3)
    prints = index.prints[rng.integers(0, 40, 200)] ^ np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False)) for _ in range(200)], np.uint64)
    w, i = index.candidates(prints, 20)
    close = {(a, b) for a in range(200) for b in range(40) if bin(int(prints[a] ^ index.prints[b])).count("1") <= index.radius}
    assert set(zip(w.tolist(), i.tolist(), strict=True)) == close


def test_index_travels_without_the_package():
    import pickle

    index = decontaminate.BenchmarkIndex([(1, "one two three four five six seven"), (2, "a b")])
    sent = pickle.dumps(index.state())
    assert b"odweave" not in sent
    text = "zero one two three four five six seven eight a b"
    assert decontaminate.BenchmarkIndex.of(pickle.loads(sent)).matches(text) == index.matches(text) != []


def test_language(spark):
    words = {"aa": ["the", "and", "this", "wheel", "house"], "bb": ["und", "der", "schön", "straße", "über"]}
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(rnd.randrange(4, 60))), x) for i in range(200) for x in ("aa", "bb")]
    rows += [(900, None, "aa"), (901, "123 456 !?", None), (902, "", "bb"), (903, "你好世界你好世界你好世界你好世界", None), (904, "the und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("p", F.lit(0))
    model = language_id.train(df)
    got = {(r.doc_id, r.lang): r.q for r in df.withColumn("q", language_id.predict(F.col("text"), model)).collect()}
    assert all(got[i, x].lang == x and not got[i, x].rejected for i, _, x in rows[:400])
    assert got[900, "aa"].lang == got[901, None].lang == got[902, "bb"].lang == "und" and got[901, None].rejected and got[903, None].rejected
    assert all(0 <= q.score <= 1 for q in got.values())
    # The nearest centroid, by plain sums.
    letters = language_id.letter_table()
    for text in (rows[0][1], rows[7][1], "the und straße über"):
        counts, n = language_id.ngram_counts(text, letters)
        best = {}
        x = [math.log1p(c) * float(w) for c, w in zip(counts, model.idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in x))
        for c, who in zip(model.centroids, model.owner, strict=True):
            cos = sum(v * float(w) for v, w in zip(x, c, strict=True)) / norm
            best[who] = max(best.get(who, -1), cos)
        who, cos = model.nearest(counts[None, :])
        assert model.languages[who[0]] == model.languages[max(best, key=best.get)] and cos[0] == pytest.approx(max(best.values()), abs=1e-4)
    many = spark.createDataFrame([(None, f"{chr(97 + i % 26) * 3} {chr(97 + i // 26) * 4} text", f"l{i}") for i in range(450)], "doc_id long, text string, lang string")
    assert len(language_id.train(many).languages) == 450
    assert language_id.train(df.limit(0)) is None
    assert df.limit(3).select(language_id.predict(F.col("text"), None).alias("q")).first().q.lang == "und"


def test_long_text_in_chunks(monkeypatch):
    letters = language_id.letter_table()
    text = "Ab c, déf! " * 50
    whole = language_id.ngram_counts(text, letters)
    for size in (1, 2, 3, 97):
        monkeypatch.setattr(language_id, "_CHUNK", size)
        parts = language_id.ngram_counts(text, letters)
        assert whole[1] == parts[1] and (whole[0] == parts[0]).all()


def test_quality(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["the", "river", "runs", "over", "stones", "and", "sand"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rnd.choice(["BUY", "$$$", "now!!", "###"]) for _ in range(60))
    rows = [(i, good() if i % 4 else bad()) for i in range(800)] + [(9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 800, 2)] + [(5000, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = quality_pu.train(docs, labels)
    s = {r.doc_id: r.s for r in docs.select("doc_id", quality_pu.score(F.col("text"), model).alias("s")).collect()}
    assert sum((s[i] >= quality_pu.CUT) == (i % 4 > 0) for i in range(800)) >= 790 and 0 <= s[9000] <= 1 and s[9000] == s[9001]
    flat = quality_pu.train(docs, labels.limit(0))
    assert docs.limit(5).select(quality_pu.score(F.col("text"), flat).alias("s")).first().s == pytest.approx(0.5)


def test_repeated_ids_beyond_the_sample(spark, caplog):
    """An id picked as positive whose rows exceed the bound: the rows of larger ids are still learned from, and the cut is logged."""
    good, bad = "A clear sentence about rivers and their towns. " * 6, "$$ !! 00 ## " * 20
    rows = [(1, f"{good}{i}") for i in range(1500)] + [(i, (good if i % 2 else bad) + str(i)) for i in range(2, 202)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 202, 2)], "doc_id long, quality int")
    caplog.set_level("WARNING")
    model = quality_pu.train(docs, labels, labelled=200, unlabelled=200)
    assert "more than 800 rows" in caplog.text
    s = {r.doc_id: r.s for r in docs.filter("doc_id > 1").select("doc_id", quality_pu.score(F.col("text"), model).alias("s")).collect()}
    assert min(v for k, v in s.items() if k % 2) > max(v for k, v in s.items() if k % 2 == 0)


def test_risk_and_prior_of_known_densities():
    """Two normal densities: the learned score is near the true posterior, its risk near the least, and the prior near the true one."""
    import numpy as np

    rng = np.random.default_rng(1)
    for prior in (0.3, 0.6, 0.85):
        y = rng.random(6000) < prior
        unlabelled = np.where(y, 1.5, -1.5)[:, None] + rng.standard_normal((6000, 1))
        positive = 1.5 + rng.standard_normal((6000, 1))
        assert abs(quality_pu.estimate_prior(positive, unlabelled) - prior) < 0.06
        model = quality_pu.fit(positive, unlabelled, prior)
        x = np.linspace(-4, 4, 81)[:, None]
        log_odds = 3 * x[:, 0] + np.log(prior / (1 - prior))
        true = 1 / (1 + np.exp(-log_odds))
        weight = prior * np.exp(-((x[:, 0] - 1.5) ** 2) / 2) + (1 - prior) * np.exp(-((x[:, 0] + 1.5) ** 2) / 2)
        assert (np.abs(model.score(x) - true) * weight).sum() / weight.sum() < 0.06
        best = min(quality_pu.risk(a * positive[:, 0] + b, a * unlabelled[:, 0] + b, prior) for a in np.linspace(0, 6, 25) for b in np.linspace(-4, 4, 33))
        assert quality_pu.risk(model.margin(positive), model.margin(unlabelled), prior) < best + 0.04
    gp, gu = np.array([0.3, -1.0]), np.array([2.0, -0.5, 0.1])
    plain = 0.4 * np.mean(np.log(1 + np.exp(-gp))) + np.mean(np.log(1 + np.exp(gu))) - 0.4 * np.mean(np.log(1 + np.exp(gp)))
    assert quality_pu.risk(gp, gu, 0.4) == pytest.approx(plain)
    assert quality_pu.risk(np.array([9.0]), np.array([-9.0]), 0.5) == pytest.approx(0.5 * np.log1p(np.exp(-9)))


def test_negative_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9 + 1)) for i in range(200)] + [(None, None)], "doc_id long, text string")
    labels = [(i, 1) for i in range(0, 100, 2)]
    some, more = (spark.createDataFrame(labels + extra, "doc_id long, quality int") for extra in ([], [(i, 0) for i in range(101, 200, 2)]))
    a, b = quality_pu.train(docs, some), quality_pu.train(docs, more)
    assert (a.w1 == b.w1).all() and a.prior == b.prior


def test_digest_columns():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
