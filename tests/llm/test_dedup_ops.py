"""SimHash, embeddings, mixing, WARC and the pipeline: edge cases and brute force."""

import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from odweave.llm import embedding_dedup, mixing, simhash_dedup, warc


def components(n, linked):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        par[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("small,large", [(256, 100_000), (2, 100_000), (4, 8)])
def test_simhash_links(spark, small, large):
    rng = np.random.default_rng(small)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fps = base[rng.integers(0, 12, 250)]
    for _ in range(4):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 250).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, rng.integers(0, 1 << 63, 60, dtype=np.uint64), [np.uint64(0), ~np.uint64(0), np.uint64(1 << 63)]]))
    near = [(i, j) for i in range(len(fps)) for j in range(i) if bin(int(fps[i] ^ fps[j])).count("1") <= 3]
    want = components(len(fps), near)
    signed = fps.view(np.int64).tolist()
    got = {r.fp: r.root for r in simhash_dedup.fingerprint_components(spark.createDataFrame([(x,) for x in signed], "fp long"), small=small, large=large).collect()}
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(got[x], set()).add(want[i])
    assert len(groups) == len(set(want)) and all(len(g) == 1 for g in groups.values())


def test_fingerprint_by_definition(spark):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in [*rows, "Ünï ÀB\x0bCd\u00a0e f", "one", "a b", "", None, "\t \n"]:
        words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash_dedup.fingerprint(text) % (1 << 64) == want


def test_gray_index_finds_the_links_of_real_fingerprints(spark, monkeypatch):
    """Every tree of more than one fingerprint is searched, and the links are those of brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select(simhash_dedup.fingerprints(F.col("text")).alias("fp")).distinct()
    fps = np.array([r.fp for r in docs.collect()], np.int64).view(np.uint64)
    searched, search = [], simhash_dedup.GrayIndex.search
    monkeypatch.setattr(simhash_dedup.GrayIndex, "search", lambda self, a, b, labels=None: (searched.append(b - a), search(self, a, b, labels))[1])
    pairs, trees = set(), 0
    for a, b in simhash_dedup._blocks(3):
        group = (fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1)
        rank = fps.copy()
        for s in (1, 2, 4, 8, 16, 32):
            rank ^= rank >> np.uint64(s)
        order = np.lexsort((rank, group))
        labels = simhash_dedup.link_groups(group[order].astype(np.int64), fps[order])
        _, n = np.unique(group, return_counts=True)
        trees += int(n[n > 1].sum())
        moved = np.flatnonzero(labels != np.arange(len(fps)))
        pairs |= {(int(fps[order][i]), int(fps[order][labels[i]])) for i in moved}
    assert sum(searched) == trees > 0
    at = {int(f): i for i, f in enumerate(fps)}
    near = []
    for i in range(len(fps)):
        near += [(i, int(j)) for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1]
    assert components(len(fps), [(at[a], at[b]) for a, b in pairs]) == components(len(fps), near) and near


def test_near_duplicates_go_by_row(spark):
    other = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    base = other(3)
    rows = [(None, other(1)), (None, other(2)), (5, base), (5, other(4)), (6, base.upper()), (5, base), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_fp0", F.lit("clash")).withColumn("m", F.lit(1))
    out = simhash_dedup.drop_near_duplicates(df)
    got = [(r.doc_id, r.text) for r in out.collect()]
    assert out.columns == df.columns and len(got) == 5
    assert set(got) - {(None, None), (None, " ")} == {(None, other(1)), (None, other(2)), (5, base), (5, other(4))}


def test_simhash_edges(spark):
    rows = [(5, "a b c d"), (3, "A  b\tc d"), (9, None), (8, "  "), (7, ""), (1, "x"), (None, "x"), (4, "é" * 20), (4, "é" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("_kept", F.lit(1)).withColumn("component_id", F.lit(0))
    got = simhash_dedup.near_duplicates(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and by[5].component_id == by[3].component_id == 3 and by[7].fingerprint == "0" * 16 and by[9].component_id == 7 and by[None].component_id == 1
    kept = simhash_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 7]
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0
    long = " ".join(f"w{i % 997}" for i in range(70_000))
    assert simhash_dedup.fingerprint(long) == simhash_dedup.fingerprint(long.upper())


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((40, 16))
    x = [(i, v.tolist()) for i, v in enumerate(base)]
    n = 40
    for _ in range(150):  # copies, near copies, and vectors around the threshold
        v = base[rng.integers(0, 6)]
        e = rng.standard_normal(16) * rng.choice([0, 0.05, 0.25, 0.35, 0.5])
        x.append((n, (v * rng.choice([1, 1, 3]) + e).tolist()))
        n += 1
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [None] + [1.0] * 15), (1004, []), (1005, [float("inf")] + [0.0] * 15), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (None, x[0][1])]
    df = spark.createDataFrame(x + odd, "vec_id long, embedding array<double>").withColumn("bid", F.lit(1)).withColumn("unit", F.lit("clash"))
    u = np.array([v for _, v in x])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    near = [(i, j) for i in range(n) for j in range(i) if s[i, j] >= 0.9]
    comp, deg = components(n, near), (s >= 0.9).sum(1) - 1
    out = embedding_dedup.near_duplicates(df)
    got = {r.vec_id: r for r in out.collect()}
    twin = [i for i in range(n) if s[i, 0] >= 0.9]
    for i in range(n):
        assert got[i].n_links == deg[i] + (i in twin), i
        assert got[i].component_id == comp[i] and got[i].kept == (comp[i] == i)
    for i in (1000, 1001, 1002, 1003, 1004, 1005):
        assert got[i].n_links == 0 and got[i].kept and got[i].component_id == i
    assert got[1007].component_id == 1006 and got[1007].n_links == 1 and got[None].component_id == comp[0]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0 and all(known >= 0.995 * links > 0 for links, known in out.audit[-2:])
    # An audit that is never content ends with all leaders compared with all.
    exact = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, recall=2.0, tries=1).collect()}
    assert all(exact[i].n_links == got[i].n_links and exact[i].component_id == got[i].component_id for i in range(n))


def test_recall_is_measured_without_links(spark, monkeypatch):
    """A table without one link: planted links measure recall, are no part of the result, and where they are lost or can't be planted the exact way runs."""
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((3_000, 48)))], "vec_id long, embedding array<double>")
    exact, run = [], embedding_dedup._against_all
    monkeypatch.setattr(embedding_dedup, "EXACT", 1_000)
    monkeypatch.setattr(embedding_dedup, "_against_all", lambda b, p, link: exact.append(1) or run(b, p, link))
    out = embedding_dedup.near_duplicates(df, audited=64, planted=500)
    assert out.audit[0] == (0, 0) and out.audit[1][0] == 500 and out.audit[-1][1] >= 0.995 * 500 and len(exact) == len(out.audit) // 2
    assert [(r.n_links, r.kept) for r in out.collect()] == [(0, True)] * 3_000
    # Links are forgotten by the lists: the planted ones show it, though the table has none, and all are compared with all.
    exact.clear()
    real = embedding_dedup._lists
    monkeypatch.setattr(embedding_dedup, "_lists", lambda edges, size: real(edges.filter("sim < lim OR v + n > 0"), size))
    lost = embedding_dedup.near_duplicates(df, audited=64, planted=500, tries=1)
    assert lost.audit[1][1] < 0.995 * 500 and len(exact) >= 3
    monkeypatch.setattr(embedding_dedup, "_lists", real)
    flat = embedding_dedup.near_duplicates(spark.createDataFrame([(1, [1.0]), (2, [3.0]), (3, [-1.0])], "vec_id long, embedding array<double>"))
    assert flat.audit[-1] == (0, 0) and [(r.vec_id, r.n_links, r.component_id) for r in flat.orderBy("vec_id").collect()] == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]


def test_links_of_large_balls_stay_in_lists(spark):
    """A link that is less similar than neighbours that are none, as its ball is larger, is kept."""
    rows = [(0, n, 0.85 - n / 1000, 0.89) for n in range(1, 30)] + [(0, 99, 0.7, 0.6)]
    near = embedding_dedup._lists(spark.createDataFrame(rows, "v long, n long, sim float, lim float"), 10).first().near
    assert len(near) == 10 and near[0].n == 99 and near[1].n == 1


def test_sparse_links_among_many(spark, tmp_path):
    """Pairs just above the threshold among 20,000 random vectors, and groups of near copies, by the SQL of the query."""
    import duckdb
    import pandas as pd

    from odweave.llm import queries

    rng = np.random.default_rng(5)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((200, 64))
    y -= (y * x[:200]).sum(1, keepdims=True) * x[:200]
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    pairs = 0.903 * x[:200] + np.sqrt(1 - 0.903**2) * y
    groups = np.concatenate([x[[500 + g]] + rng.standard_normal((m, 64)) * e for g, m, e in ((0, 150, 0.01), (1, 60, 0.03), (2, 5, 0.05))])
    every = np.concatenate([x, pairs, groups])
    order = rng.permutation(len(every))
    pd.DataFrame({"vec_id": np.arange(len(every)), "embedding": list(every[order])}).to_parquet(tmp_path / "embeddings.parquet")
    out = embedding_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "embeddings.parquet")))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect())
    s = every[order] / np.linalg.norm(every[order], axis=1, keepdims=True)
    near = []
    for a in range(0, len(s), 2048):
        i, j = np.nonzero(s[a : a + 2048] @ s.T >= 0.9)
        near += [(int(p) + a, int(q)) for p, q in zip(i, j, strict=True) if p + a < q]
    deg, comp = np.bincount(np.array(near).ravel(), minlength=len(s)), components(len(s), near)
    lost = sum(got[i][1] != deg[i] for i in range(len(s)))
    assert lost <= 4 and all(known >= 0.99 * links for links, known in out.audit[-2:]) and sum(links for links, _ in out.audit) > 100
    if not lost:
        assert [g[2] for g in got] == comp
    # The query's SQL, on a part that all groups and some pairs are in.
    keep = np.flatnonzero(np.isin(order, np.concatenate([np.arange(600), np.arange(20_000, len(every))])))
    small = tmp_path / "small"
    small.mkdir()
    pd.DataFrame({"vec_id": keep, "embedding": list(every[order][keep])}).to_parquet(small / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = sorted(con.execute(queries.ORACLES["op4_embedding_near_dedup"]).fetchall())
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in queries.op4_embedding_near_dedup(spark, str(small)).collect()) == want and sum(w[1] for w in want) > 1000


def test_mixing_rules(spark):
    rnd = random.Random(7)
    rows = [(i, f"s{i % 5}" if i % 11 else None, " ".join(["w"] * rnd.choice([0, 1, 5, 40, 400]))) for i in range(300)] + [(900, "tiny", "a b"), (901, "none", None), (901, "none", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash")).withColumn("_mix_hash", F.lit("clash"))
    plan, out = mixing.mix(df)
    got = out.collect()
    assert len(got) == len(rows) and all(r.size == len((t or "").split()) for r in got for t in [next(x[2] for x in rows if x[0] == r.doc_id)])
    total = sum(r.size for r in got)
    per = {}
    for r in got:
        a = per.setdefault(r.source, [0, r.source_size, r.target])
        a[0] += r.taken
        assert r.taken <= 3 * r.size
    assert abs(sum(p[2] for p in per.values()) - total) < 1e-6 * total
    assert per["tiny"][2] == 6 and per["none"][2] == 0
    open_ = {s: p[2] / (sorted(per, key=lambda x: (x is None, x)).index(s) % 3 + 1) for s, p in per.items() if p[2] < 3 * p[1] - 1e-6}
    assert max(open_.values()) - min(open_.values()) < 1e-6
    for took, _, target in per.values():
        assert abs(took - target) <= max(6, 0.02 * target)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(df)[1].collect()) == sorted((r.doc_id, r.taken) for r in got)
    by = {}
    for r in plan.collect():
        by[r.doc_id] = by.get(r.doc_id, 0) + r.n_words
    assert by == {r.doc_id: r.taken for r in got if r.taken}
    mixed = mixing.mix_documents(df)
    assert mixed.columns == [*[c for c in df.columns if c != "size"], "size", "source_size", "target", "taken"] and {r.doc_id for r in mixed.collect()} == set(by)
    for empty in (df.limit(0), df.filter("text IS NULL")):
        p, o = mixing.mix(empty)
        assert p.count() == 0 and o.count() == empty.count() and o.filter("taken <> 0 OR target <> 0").isEmpty()


def _archive(payloads, packed):
    import hashlib

    out, starts = b"", []
    for i, p in enumerate(payloads):
        rec = warc.record_bytes("response", f"urn:page:{i}", "http://x/", p, len(p), hashlib.sha256(p).hexdigest(), None)
        starts.append(len(out))
        out += warc._member(rec) + warc._member(b"\r\n\r\n") if packed else rec + b"\r\n\r\n"
    return out, starts


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    rng = random.Random(1)
    payloads = [bytes(rng.randrange(32, 127) for _ in range(300 + i)) for i in range(8)] + [b"WARC/1.0\r\nWARC-Type: response\r\n\r\n"]
    data, starts = _archive(payloads, packed)
    assert [r.payload for r in warc.read_archive(data)] == payloads and not any(r.problem for r in warc.read_archive(data))
    hurt = bytearray(data)
    for k in (2, 5):
        at = starts[k] + (starts[k + 1] - starts[k]) // 2
        hurt[at : at + 6] = b"\x00\xff\x00\xff\x00\xff"
    found = list(warc.read_archive(bytes(hurt)))
    assert [r.payload for r in found if not r.problem] == [p for i, p in enumerate(payloads) if i not in (2, 5)]
    gaps = [(r.start, r.size) for r in found if r.problem]
    assert [g[0] for g in gaps] == [starts[2], starts[5]] and all(g[0] + g[1] <= starts[k + 1] for g, k in zip(gaps, (2, 5), strict=True))
    cut = list(warc.read_archive(data[: starts[4] + 50]))
    assert [r.payload for r in cut if not r.problem] == payloads[:4] and cut[-1].problem
    junk = list(warc.read_archive(b"junk" + data))
    assert junk[0].problem and junk[0].size == 4 and [r.payload for r in junk[1:]] == payloads
    assert list(warc.read_archive(b"")) == []


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 40
    rows = [(3, "http://a/\r\nX: y", big), (1, "u", big), (2, None, big), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", "z" * 200), (7, "u", "z" * 200), (1, "u", big), (8, "u", "WARC/1.0\r\n\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("clash"))
    path, records = warc.archive_pages(df)
    got = records.collect()
    assert len(got) == 10 and not any(r.problem for r in got)
    kinds = sorted((r.record_id, r.kind, r.refers_to or "", r.payload_bytes) for r in got)
    n = len(big.encode())
    assert kinds.count(("urn:page:1", "response", "", n)) == 2 and ("urn:page:3", "revisit", "urn:page:1", n) in kinds and ("urn:page:2", "revisit", "urn:page:1", n) in kinds
    assert ("urn:page:4", "response", "", 5) in kinds and ("urn:page:5", "response", "", 5) in kinds and ("urn:page:6", "response", "", 0) in kinds and ("urn:page:null", "revisit", "urn:page:7", 200) in kinds
    payload = {r.record_id: r.payload for r in warc.read_warc(spark, path).collect() if r.kind == "response"}
    assert bytes(payload["urn:page:1"]).decode() == big and bytes(payload["urn:page:8"]).decode() == "WARC/1.0\r\n\r\n" * 20
    assert warc.archive_pages(df.limit(0))[1].count() == 0


def test_damaged_archive_on_disk(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>page {i}</p>" * (i + 5) * (2000 if i == 3 else 1)) for i in range(40)]
    where, _ = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    files = sorted(f for f in (tmp_path / "w").rglob("part-*") if f.suffix != ".crc")
    assert {f.parent.name for f in files} == {"up-to-16384", "up-to-262144"}
    hurt = max((f for f in files if f.parent.name == "up-to-16384"), key=lambda f: f.stat().st_size)
    data = bytearray(hurt.read_bytes())
    at = len(data) // 2
    data[at : at + 40] = b"\x00" * 40
    hurt.write_bytes(bytes(data))
    (hurt.parent / f".{hurt.name}.crc").unlink(missing_ok=True)
    records, gaps = warc.split_gaps(warc.read_warc(spark, where))
    lost = gaps.collect()
    kept = {warc_id.rsplit(":")[-1]: bytes(p).decode() for warc_id, p in ((r.record_id, r.payload) for r in records.collect())}
    assert lost and all(g.problem and g.start <= at + 40 for g in lost) and 40 - len(lost) - 1 <= len(kept) < 40
    assert all(kept[k] == rows[int(k)][2] for k in kept)


def test_pipeline_small(spark):
    import corpus_pipeline
    from odweave.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in out]
    assert 0 < len(ids) == len(set(ids)) <= docs.count() and len(corpus_pipeline.STAGES) == 5
    leaks = {r.doc_id for r in queries.op8_decontamination(spark, sf).collect()}
    comp = {r.doc_id: r.component_id for r in queries.op6_simhash_near_dedup(spark, sf).collect()}
    assert not leaks & set(ids) and len({comp[i] for i in ids}) == len(ids)


def test_held_out_accuracy(spark):
    from odweave.llm import queries

    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [r for r in queries.op9_language_id(spark, sf).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in got) and sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.97 * len(got)
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    q = [r for r in queries.op10_quality(spark, sf).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in q) >= 0.93 * len(q)
