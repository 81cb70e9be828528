"""Alignment of tokenizers, packing and the audit of filters: by definition, with edge cases."""

import collections
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from odweave.llm import align, filter_audit, packing, subwords

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, source string, text string, n long, ids string, window int"


@pytest.mark.parametrize("plain", [False, True])
def test_word_wise_ids(plain):
    rnd, whole, ids = random.Random(3), Tokenizer.from_file(BYTES), subwords.encoder(BYTES, plain)
    whole.encode_special_tokens = plain
    bits = ["a", "bc", " ", "  ", "\n", " \n", "'s", "é", "12", "!!", "<|endoftext|>", " ", "日本", "　", "x'll ", "\x1c", "\u0085"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(3000)]
    for text, found in zip(texts, whole.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.asarray(found.ids, "<u4").tobytes() == ids(text), repr(text)


@pytest.mark.parametrize("plain", [False, True])
def test_batch_wise_ids(plain, monkeypatch):
    """Ids of a batch are those of its texts, and its different words are encoded in one call, however often they come."""
    rnd, whole, slow = random.Random(4), Tokenizer.from_file(BYTES), []
    whole.encode_special_tokens = plain
    bits = ["a", "bc", " ", "  ", " \n", "'s", "é", "<|endoftext|>", "日本", "\u3000", "\x1c", "words of ", "mid\nline "]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(14))) for _ in range(800)]
    monkeypatch.setattr(subwords, "SLICE", 50)
    ids, bounds = subwords.batch_encoder(BYTES, plain)(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)] == [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    raw = subwords.raw_encoder(BYTES)
    monkeypatch.setattr(subwords, "raw_encoder", lambda path: lambda text: (slow.append(text), raw(text))[1])
    many = pa.array([" ".join(rnd.choice(["house", "ofs", "thé", "x'll"]) for _ in range(50)) for _ in range(20)])
    ids, bounds = subwords.batch_encoder(BYTES, plain)(many)
    assert len(slow) == 1 + len(many) and len(bounds) == 21 and bounds[-1] == len(ids)  # and the texts' first words


def _aligned(rows):
    """By definition, on whole texts: per row n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    whole, (sp, piece) = Tokenizer.from_file(BYTES), align.piece_bytes(PIECES)
    whole.encode_special_tokens = True
    known, found = subwords.token_bytes(BYTES), []
    for _, text in rows:
        a, b = (whole.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        x, y = [known[i] for i in a], [piece[i] for i in b]
        if not b"".join(x) == b"".join(y) == (" " + text).encode() if text else True:
            found.append([])
            continue
        ends = lambda parts: list(itertools.accumulate(len(p) for p in parts))
        ea, eb, groups, at = ends(x), ends(y), [], (0, 0)
        for e in sorted(set(ea) & set(eb)):
            to = (ea.index(e) + 1, eb.index(e) + 1)
            groups.append((a[at[0] : to[0]], b[at[1] : to[1]]))
            at = to
        found.append(groups)
    links = [collections.Counter((i, j) for g in groups for i, j in itertools.product(*g)) for groups in found]
    count = collections.Counter(p for held in links for p in held)
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    out = []
    for (doc, _), groups, held in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((doc, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), held.total(), sum(n for p, n in held.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in held.items()), text))
    return out


@pytest.mark.parametrize("chunk", [1 << 24, 300])
def test_alignment_by_definition(spark, chunk):
    rnd = random.Random(5)
    bits = ["the ", "house", " ", "  ", "\n", " \n", "'s", "é", "12", "!! ", "<|endoftext|>", "<s>", "\u2581", "日本 ", "\u3000", "x'll ", "\x1c", "\U0001f600", "\x00", "\u0301", "\ufb01", "\u00a0", "\t", "<0x41>"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(16))) for _ in range(150)] + [r[2] for r in _corpus(60)] + ["the house of the house", " ", "  ", "a", "same", "same"]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "same id"), (-1, None)]
    got = align.align(spark.createDataFrame([(d, "s", t, 1, "clash", 2) for d, t in rows], DOCS).repartition(3), BYTES, PIECES, chunk).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[7], r[1:7])
    assert sorted(map(tuple, got), key=key) == sorted(_aligned(rows), key=key)


def test_alignment_deals_no_words(spark):
    """Chunks are made where their documents lie; what is shuffled after that are pairs of ids, a row for each of a chunk's, however many words hold it."""
    rows = [(i, "s", " ".join(f"house{i % 7}{k % 5}" for k in range(400)), 1, "clash", 2) for i in range(40)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    made = align.chunk_rows(docs, BYTES, PIECES)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    pairs = {p for *_, text in _aligned([(r[0], r[2]) for r in rows]) for g in text.split(";") for p in itertools.product(*(x.split(",") for x in g.split("|")))}
    got = made.collect()
    assert sum(r.pair is not None for r in got) == len(pairs) and sum(r.row is not None for r in got) == 40 and sum(r.entry is not None for r in got) == 1


def test_alignment_joins_ends():
    ends, a, b = align.align_tokens(np.array([2, 3, 7, 9, 12]), np.array([3, 5, 9, 12]))
    assert (ends.tolist(), a.tolist(), b.tolist()) == ([3, 9, 12], [2, 4, 5], [1, 3, 4])


def test_pairs_counted_in_slices(monkeypatch):
    import pyarrow as pa

    rnd = np.random.default_rng(4)
    sizes = rnd.integers(0, 9, 40)
    places = rnd.integers(0, 12, sizes.sum()).astype("<i4")
    row = pa.table({"chunk": [1], "ids": [list(range(40))], "sizes": [sizes.tolist()], "places": [places.tobytes()]})
    pairs = [rnd.integers(0, 15, rnd.integers(1, 5)).tolist() for _ in range(11)]
    entries = pa.table({"place": pa.array(range(11), pa.int64()), "pairs": pa.array(pairs, pa.list_(pa.int64()))})  # the twelfth word has no tokens
    want, at = collections.Counter(), 0
    for n in sizes:
        own = places[at : at + n].tolist()
        at += n
        want.update(set() if 11 in own else {p for w in own for p in pairs[w]})
    for size in (3, 1 << 20):
        monkeypatch.setattr(align, "SLICE", size)
        values, n = align._counted(align._Chunk(row, entries), entries)
        assert dict(zip(values.tolist(), n.tolist(), strict=True)) == want


def test_alignment_edges(spark):
    empty = spark.createDataFrame([], DOCS)
    assert align.align(empty, BYTES, PIECES).count() == 0
    none = align.align(spark.createDataFrame([(1, None, None, 0, "", 0), (2, None, "\u2581", 0, "", 0)], DOCS), BYTES, PIECES).collect()
    assert sorted(map(tuple, none)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def _corpus(n, seed=1):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeèñß") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    rows = [(i, "big" if i % 3 else f"s{i % 7}", text(rnd.choice([1, 5, 40, 300]))) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", ""), (None, "big", "no id"), (None, None, "<|endoftext|> mid\n\n"), (3, "big", "same"), (3, "big", "same"), (n + 2, "one", text(9000)), (n + 3, "tiny", "x")]
    return [(*r, 1, "clash", 2) for r in rows]


@pytest.mark.parametrize("length", [1024, 64])
def test_packing_whole(spark, length):
    rows = _corpus(150)
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(5), BYTES, length).collect()
    whole = Tokenizer.from_file(BYTES)
    want = sorted((r[0] is None, r[0] or 0, tuple(whole.encode(r[2] or "", add_special_tokens=False).ids) + (0,)) for r in rows)
    ids = {id(p): np.frombuffer(p.ids, "<u4") for p in got}
    assert all(len(ids[id(p)]) == p.length and zlib.crc32(p.ids) == p.ids_crc32 for p in got)
    by_doc = collections.defaultdict(list)
    for p in got:
        by_doc[p.doc_id, p.doc_tokens].append(p)
    back = []
    for (doc, n), pieces in by_doc.items():
        same = sum(p.length for p in pieces) // n  # repeated rows
        pieces.sort(key=lambda p: (p.start, p.sequence_id, p.offset))
        if same == 1:
            assert [p.start for p in pieces] == list(itertools.accumulate([0, *(p.length for p in pieces)]))[:-1]
            back.append((doc is None, doc or 0, tuple(int(x) for p in pieces for x in ids[id(p)])))
        else:
            assert n == 2
            back += [(doc is None, doc or 0, tuple(want_ids[2])) for want_ids in want if want_ids[1] == (doc or 0) and len(want_ids[2]) == n and want_ids[0] == (doc is None)]
    assert sorted(back) == want
    sequences = collections.defaultdict(list)
    for p in got:
        sequences[p.sequence_id].append(p)
    total = sum(len(w[2]) for w in want)
    for s, pieces in sequences.items():
        pieces.sort(key=lambda p: p.offset)
        assert [p.offset for p in pieces] == list(itertools.accumulate([0, *(p.length for p in pieces)]))[:-1]
        size = sum(p.length for p in pieces)
        assert size == length if s < total // length else size & (size - 1) == 0 and size < length
    assert sorted(sequences) == list(range(len(sequences))) and sum(p.length for p in got) == total
    # Every window (so every sequence, to within the tokens that a window is short) holds the sources' shares.
    share = collections.Counter()
    for p in got:
        share[p.source] += p.length
    for s in range(total // length):
        held = collections.Counter()
        for p in sequences[s]:
            held[p.source] += p.length
        assert all(abs(held[c] - n * length / total) <= 2 * len(share) for c, n in share.items())


def test_packing_edges(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), BYTES).count() == 0
    one = packing.pack(spark.createDataFrame([(1, None, None, 0, "", 0)], DOCS), BYTES).collect()
    assert [(p.doc_id, p.start, p.length, p.doc_tokens, p.sequence_id, p.offset, bytes(p.ids)) for p in one] == [(1, 0, 1, 1, 0, 0, bytes(4))]


def _failing(rows):
    """Letters of the filters that each row fails, by definition."""
    seen, out = collections.defaultdict(list), []
    for doc, _, text in rows:
        seen[text or ""].append(doc)
    for doc, part, text in rows:
        text = text or ""
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text) if w]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        ids = seen[text]
        later = any(d is not None and (doc is None or d < doc) for d in ids)
        out.append((doc, part or "", fails + "E" * later))
    return out


def test_audit_by_definition(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "ROWS_PER_SALT", 7)
    rnd = random.Random(2)
    long = " ".join(f"w{i}" for i in range(3000))
    pool = ["", "Some Words", "a # b", "x " * 300, " ".join(f"w{i}" for i in range(250)), long, long + "!", long[:-1] + "?", "\U0001f600" * 300 + "a", "\U0001f600" * 300 + "b", "ONE \x0b TWO", "é" * 257]
    rows = [(i, rnd.choice(["p", "q", None, "''"]), rnd.choice(pool)) for i in range(120)] + [(None, "p", "Some Words"), (None, "q", "lonely"), (5, "p", None), (7, "q", "twice"), (7, "q", "twice"), (8, "q", "twice")]
    rows += [(1000 + i, "p", "hot text") for i in range(60)]
    labels = [(i, i % 2, int(i % 5 == 0), "c") for i in range(100)] + [(1000, None, 1, "c"), (1, 1, 1, "c"), (1, 0, None, "c"), (None, 1, 1, "c")]
    docs = spark.createDataFrame([(d, s, t, 1, "clash", 2) for d, s, t in rows], DOCS)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")).collect()}
    good, toxic = {x[0] for x in labels if x[1] == 1 and x[0] is not None}, {x[0] for x in labels if x[2] == 1 and x[0] is not None}
    told, want, shapley = _failing(rows), {}, collections.Counter()
    for part in {p for _, p, _ in told}:
        mine = [(d, f) for d, p, f in told if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                met = lambda f: any(x in f for x in order[: step - 1])  # noqa: E731, B023
                gone = [d for d, f in mine if c in f and not met(f)]
                want[part, order, step] = (sum(c not in f and not met(f) for _, f in mine), len(gone), sum(c in f and met(f) for _, f in mine), sum(f == c for _, f in mine), sum(d in good for d in gone), sum(d in toxic for d in gone))
                shapley[part, c] += len(gone)
    assert got == {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")).count() == 0


def test_audit_collisions(spark, monkeypatch):
    """Texts that agree in length and in all hashes are told apart by the texts themselves."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit, "_block_hashes", lambda text: [F.lit(1).cast("long")])
    rows = [(0, 5, "aa"), (1, 2, "bb"), (2, 1, "aa"), (3, 9, "bb"), (4, None, "cc"), (5, 7, "cc"), (6, 7, "cc"), (7, 1, "dd")]
    got = filter_audit.later_copies(spark.createDataFrame(rows, "_uid long, _id long, _text string")).collect()
    assert sorted(r[0] for r in got) == [0, 3, 4]
