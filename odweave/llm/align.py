"""Cross-tokenizer alignment: which tokens of one tokenizer cover the same bytes as which of another.

The alignment is relational: each side's tokens are a table of places and running sums of bytes, an equi-join of
the sums finds the cuts where tokens of both end, tokens between two cuts are a group, and the tokens of a group
are linked pair by pair. It is made for each different word of a chunk of documents, since neither tokenizer ever
joins a lone space between two other characters to what stands before it: a cut is certain there, and ids do not
depend on what lies beyond. Spark deals documents in chunks, and words stay in the task of their chunk: the tables
that are joined are Arrow's, no word is shuffled, and documents are put together from their words there. What is shuffled are the pairs of ids of each chunk with the
number of its documents that hold them: Spark sums these over chunks and finds each a id's highest.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import parallelism, scratch_path
from . import subwords

#: Bytes of text in one chunk (or one text).
CHUNK = 8 << 20
#: Words of documents whose pairs are gone through at a time.
SLICE = 1 << 18
#: Words that the piece model encodes at a time.
ROWS = 20_000
#: A lone space between characters that are no white space.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: The piece model writes spaces so; a text that holds the mark itself can't come back from its pieces.
_MARK = "▁"


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """Texts in words that both tokenizers treat alone; a text is its words with a space before each, less the first space.

    Each word's place in the list of different words, the number of words of each text, that list, and how many of
    its words, from the first on, are not loose. Texts that have no tokens have no words.
    """
    texts = pc.if_else(pc.match_substring(texts, _MARK), "", texts)
    places, bounds, words = subwords.split_words(texts)
    loose = np.fromiter(map(subwords.is_loose, words), bool, len(words))
    tight, more = [w for w, bad in zip(words, loose, strict=True) if not bad], {}
    own = np.split((np.cumsum(~loose) - 1)[places], bounds[1:-1])
    for i in np.flatnonzero(np.logical_or.reduceat(loose[places], bounds[:-1])):
        text = texts[i].as_py()
        own[i] = np.array([len(tight) + more.setdefault(w, len(more)) for w in (_CUT.split(text) if text else ())], np.int64)
    return np.concatenate(own), np.array([len(o) for o in own]), tight + list(more), len(tight)


@functools.lru_cache(maxsize=2)
def piece_bytes(model: str) -> tuple[object, list[bytes]]:
    """The piece model, and the bytes of each of its ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(names)]


@functools.lru_cache(maxsize=4)
def _spelling(vocabulary: str, model: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids of the byte-level file, or else of the piece model, one after another, and their bounds."""
    known = subwords.token_bytes(vocabulary)
    names = piece_bytes(model)[1] if model else [known.get(i, b"") for i in range(max(known) + 1)]
    return np.frombuffer(b"".join(names), np.uint8), subwords.bounds_of([len(x) for x in names])


def _spelled(ids: np.ndarray, bounds: np.ndarray, spelling: tuple[np.ndarray, np.ndarray], whole: np.ndarray, whole_bounds: np.ndarray) -> np.ndarray:
    """For each word whether its ids' bytes are its own."""
    letters, at = spelling
    upto, count, size = subwords.bounds_of(np.diff(at)[ids]), np.diff(bounds), np.diff(whole_bounds)
    same = upto[bounds[1:]] - upto[bounds[:-1]] == size
    differ = subwords.gather(letters, at, ids[np.repeat(same, count)]) != whole[np.repeat(same, size)]
    differ = subwords.bounds_of(differ)[subwords.bounds_of(size[same])]
    same[same] = differ[1:] == differ[:-1]
    return same


def encode_words(words: list[str], tight: int, vocabulary: str, model: str) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The ids of a space and each word, one word after another, and their bounds, by both tokenizers; the words from `tight` on are loose."""
    sp, raw = piece_bytes(model)[0], subwords.raw_encoder(vocabulary)
    ids, bounds = subwords.encode_words(vocabulary, words[:tight])
    more = [raw(" " + w) for w in words[tight:]]
    a = np.concatenate([ids, *more]), np.concatenate([bounds, bounds[-1] + np.cumsum([len(m) for m in more], dtype=np.int64)])
    found = [(np.fromiter(itertools.chain.from_iterable(x), np.int32), [len(i) for i in x]) for x in (sp.encode(words[at : at + ROWS], num_threads=1) for at in range(0, len(words), ROWS))]
    return a, (np.concatenate([np.zeros(0, np.int32), *[x for x, _ in found]]), subwords.bounds_of([k for _, sizes in found for k in sizes]))


def align_tokens(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends that both sides have, and how many of a's and b's tokens lie up to each: a join of two tables of tokens."""
    a, b = (pa.table({"end": e, n: np.arange(1, len(e) + 1)}) for e, n in ((a_ends, "a"), (b_ends, "b")))
    met = a.join(b, "end", join_type="inner", use_threads=False).sort_by("end")
    return tuple(met.column(c).to_numpy() for c in ("end", "a", "b"))


def _keep(df: DataFrame, label: str) -> DataFrame:
    """As materialize(), compressed harder: this table is large beside the texts."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of lists, one after another, and the lists' bounds."""
    held = lists.combine_chunks()
    bounds = np.asarray(held.offsets) if len(held) else np.zeros(1, np.int32)
    return np.asarray(held.values)[bounds[0] : bounds[-1]], (bounds - bounds[0]).astype(np.int64)


def entries_of(words: list[str], tight: int, vocabulary: str, model: str) -> pa.Table:
    """What each word adds to a document: numbers of tokens, groups and links, the groups' ids as text, and the linked pairs, each as a's id times 2^32 plus b's id. Words whose bytes differ are left out."""
    whole = np.frombuffer("".join(" " + w for w in words).encode(), np.uint8)
    upto = subwords.bounds_of(pc.binary_length(pa.array(words, pa.large_string())).to_numpy() + 1)
    spellings, sides = (_spelling(vocabulary, None), _spelling(vocabulary, model)), encode_words(words, tight, vocabulary, model)
    same = np.logical_and.reduce([_spelled(*side, spelling, whole, upto) for side, spelling in zip(sides, spellings, strict=True)])
    (a, a_at), (b, b_at) = ((ids[np.repeat(same, np.diff(at))], subwords.bounds_of(np.diff(at)[same])) for ids, at in sides)
    ends, a_upto, b_upto = align_tokens(*(np.cumsum(np.diff(at)[ids]) for ids, (_, at) in zip((a, b), spellings, strict=True)))
    cut = np.concatenate([[0], np.searchsorted(ends, np.cumsum(np.diff(upto)[same])) + 1])  # each word ends with a group
    a_upto, b_upto, groups = np.concatenate([[0], a_upto]), np.concatenate([[0], b_upto]), np.diff(cut)
    wide, links = np.diff(b_upto), np.diff(a_upto) * np.diff(b_upto)
    upto = subwords.bounds_of(links)
    g = np.repeat(np.arange(len(links)), links)
    i, j = np.divmod(np.arange(len(g)) - upto[g], wide[g])
    pairs = a[a_upto[g] + i].astype(np.int64) << 32 | b[b_upto[g] + j]
    listed = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    told = pc.binary_join_element_wise(*[pc.binary_join(listed(to, pc.cast(pa.array(ids), pa.string())), ",") for to, ids in ((a_upto, a), (b_upto, b))], "|")
    return pa.table(
        {
            "place": np.flatnonzero(same), "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": groups, "n_links": np.diff(upto[cut]),
            "groups": pc.binary_join(listed(cut, told), ";"), "pairs": pa.LargeListArray.from_arrays(pa.array(upto[cut], pa.int64()), pa.array(pairs, pa.int64())),
        }
    )


class _Chunk:
    """A chunk and the entries of its words, as numbers: `entry` has the row of `entries` for each place of a word (-1: the word has no tokens)."""

    def __init__(self, row: pa.Table, entries: pa.Table) -> None:
        self.chunk, self.ids = row.column("chunk")[0].as_py(), row.column("ids")[0].as_py()
        places = np.frombuffer(row.column("places")[0].as_py(), "<i4")
        at = np.full(int(places.max()) + 1 if len(places) else 0, -1, np.int64)
        own = entries.column("place").to_numpy()
        at[own[own < len(at)]] = np.flatnonzero(own < len(at))
        self.place(np.asarray(row.column("sizes")[0].as_py(), np.int64), at[places])

    def place(self, sizes: np.ndarray, entry: np.ndarray) -> None:
        self.sizes, self.entry, self.end = sizes, entry, np.cumsum(sizes)
        bad = subwords.bounds_of(entry < 0)
        self.good = bad[self.end] == bad[self.end - sizes]

    def sums(self, values: np.ndarray) -> pa.Array:
        """Per document, the sum of its words' values; 0 for documents without tokens."""
        total = subwords.bounds_of(values[self.entry] if len(self.entry) and len(values) else np.zeros(len(self.entry), np.int64))
        return pa.array(np.where(self.good, total[self.end] - total[self.end - self.sizes], 0), pa.int64())


_FIRST = ("n_a", "n_b", "n_groups", "n_links")
#: Documents (row is not null), pairs (pair is not null; k numbers those of a chunk) and chunks (entry is not null).
_FIRST_SCHEMA = f"chunk long, row long, doc_id long, {', '.join(f'{c} long' for c in _FIRST)}, groups string, pair long, k long, n long, sizes binary, entry binary, starts binary, codes binary"


def _packed(values: np.ndarray) -> bytes:
    """Numbers below 2^31, with bytes of like weight together, compressed; the first eight bytes tell how many."""
    return len(values).to_bytes(8, "little") + pa.compress(values.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], 4 * n, codec="zstd"), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel().astype(np.int64)


def _first(row: pa.Table, entries: pa.Table, digest: bool) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, its pairs with how many of the documents hold each, and the chunk itself: documents' entries, and the numbers of entries' pairs."""
    c = _Chunk(row, entries)
    texts = entries.column("groups").to_pylist()
    told = (lambda g: hashlib.sha256(g.encode()).hexdigest() if g else "") if digest else str
    groups = [told(";".join(map(texts.__getitem__, c.entry[e - n : e].tolist())) if g else "") for e, n, g in zip(c.end, c.sizes, c.good, strict=True)]
    del texts
    values, n = _counted(c, entries)
    pairs, starts = _flat(entries.column("pairs"))
    code = np.searchsorted(values, pairs)
    code = np.where(values[np.minimum(code, len(values) - 1)] == pairs, code, -1) if len(values) else np.full(len(pairs), -1)
    docs = {"row": np.arange(len(c.ids)), "doc_id": pa.array(c.ids, pa.int64()), **{x: c.sums(entries.column(x).to_numpy()) for x in _FIRST}, "groups": pa.array(groups, pa.string())}
    own = {"sizes": [_packed(c.sizes)], "entry": [_packed(c.entry)], "starts": [_packed(starts)], "codes": [_packed(code)]}
    for size, made in ((len(c.ids), docs), (len(values), {"pair": values, "k": np.arange(len(values)), "n": n}), (1, own)):
        made["chunk"] = np.full(size, c.chunk)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        columns = [(x, kinds[kind]) for x, kind in map(str.split, _FIRST_SCHEMA.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(made[x], t) if x in made else pa.nulls(size, t) for x, t in columns], names=[x for x, _ in columns])


def _counted(c: _Chunk, entries: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a chunk's documents, and how many of these hold each."""
    lists = entries.column("pairs").combine_chunks()
    start = np.asarray(lists.offsets)
    values, code = np.unique(np.asarray(lists.values)[start[0] : start[-1]] if len(start) > 1 else np.zeros(0, np.int64), return_inverse=True)
    start, count, width = start - (start[0] if len(start) else 0), np.zeros(len(values), np.int64), max(1, len(values))
    doc, good, n = np.repeat(np.arange(len(c.ids)), c.sizes), np.repeat(c.good, c.sizes), max(1, entries.num_rows)
    bound = np.searchsorted(c.end, np.arange(SLICE, c.end[-1] + SLICE if len(c.end) else 0, SLICE), side="right")  # whole documents of about SLICE words
    cut = np.unique(np.concatenate([[0], c.end[np.minimum(bound, len(c.end) - 1)]])) if len(c.end) else np.zeros(1, int)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        own = good[a:b]
        seen = np.unique(doc[a:b][own] * n + c.entry[a:b][own])
        d, e = seen // n, seen % n
        size = start[e + 1] - start[e]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        held = np.unique(np.repeat(d, size) * width + code[np.repeat(start[e], size) + inner])
        count += np.bincount(held % width, minlength=len(values))
    return values[count > 0], count[count > 0]


def chunk_rows(docs: DataFrame, vocabulary: str, model: str, size: int = CHUNK, digest: bool = False) -> DataFrame:
    """The documents, pairs and chunks of docs(doc_id, text), each chunk made in one task: nothing is shuffled before."""

    def chunk(n: int, held: list[tuple[pa.Array, pa.Array]]) -> Iterator[pa.RecordBatch]:
        ids, texts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
        places, sizes, words, tight = words_of(texts)
        row = pa.table({"chunk": [n], "ids": [ids.to_pylist()], "sizes": [sizes], "places": [places.astype("<i4").tobytes()]})
        return _first(row, entries_of(words, tight, vocabulary, model), digest)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, held, own = TaskContext.get().partitionId() << 32, 0, []
        for batch in batches:
            ids, texts = batch.columns
            start = 0
            for i, k in enumerate(pc.binary_length(texts).to_pylist(), 1):
                held += k
                if held >= size:
                    yield from chunk(n, [*own, (ids[start:i], texts[start:i])])
                    n, held, own, start = n + 1, 0, [], i
            if start < len(texts):
                own.append((ids[start:], texts[start:]))
        if own:
            yield from chunk(n, own)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(chunks, _FIRST_SCHEMA)


def _second(chunk: pa.Table, figures: pa.Table) -> pa.Table:
    """The sums over the documents of a chunk that need the counts of all."""
    sizes, entry, starts, codes = (_unpacked(chunk.column(x)[0].as_py()) for x in ("sizes", "entry", "starts", "codes"))
    c = _Chunk.__new__(_Chunk)
    c.place(sizes, entry)
    k, out = figures.column("k").to_numpy(), [pa.array(np.full(len(sizes), chunk.column("chunk")[0].as_py()), pa.int64()), pa.array(np.arange(len(sizes)), pa.int64())]
    for name in ("best", "n"):
        of_pair = np.zeros(len(k) + 1, np.int64)  # the last is for pairs that no document holds
        of_pair[k] = figures.column(name).to_numpy()
        out.append(c.sums(np.diff(subwords.bounds_of(of_pair[codes])[starts])))
    return pa.table(out, names=["chunk", "row", "n_best", "count_sum"])


def align(docs: DataFrame, vocabulary: str, model: str, chunk: int = CHUNK, digest: bool = False) -> DataFrame:
    """docs(doc_id, text) aligned: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups, one row for each row.

    Tokens are those of a space and the text, by a byte-level file (a) and a piece model (b); strings of special
    tokens are plain text. `groups` is `a1,a2|b1;a3|b2,b3`: ids of each group in order, or with `digest` the SHA-256
    of that. n_best counts the links whose pair is held by as many documents as any pair of their a id, count_sum
    sums these numbers over links. Texts that are null, empty, or don't come back from the pieces byte by byte have
    no tokens: zeros and "". Repeated rows count as documents of their own.
    """
    if subwords.ranks(vocabulary) is None or any(_MARK.encode() in name or b" " in name.lstrip(b" ") for name in piece_bytes(model)[1]):
        raise ValueError("words can't be told apart with these tokenizers")
    first = _keep(chunk_rows(docs, vocabulary, model, chunk, digest), "align-first")
    pairs = first.filter("pair IS NOT NULL").select("chunk", "k", "pair", "n", F.shiftright("pair", 32).alias("_a"))
    dealt = pairs.repartition(parallelism(docs.sparkSession), "_a")  # an a id's pairs of all chunks: both windows are made where they lie
    counts = dealt.withColumn("n", F.sum("n").over(Window.partitionBy("_a", "pair")))
    figures = counts.select("chunk", "k", "n", (F.col("n") == F.max("n").over(Window.partitionBy("_a"))).cast("long").alias("best"))
    chunks = first.filter("entry IS NOT NULL").select("chunk", "sizes", "entry", "starts", "codes")
    second = chunks.groupBy("chunk").cogroup(figures.groupBy("chunk")).applyInArrow(_second, "chunk long, row long, n_best long, count_sum long")
    docs_of = first.filter("row IS NOT NULL").select("chunk", "row", "doc_id", *_FIRST, "groups")
    return docs_of.hint("merge").join(second, ["chunk", "row"]).select("doc_id", *_FIRST, "n_best", "count_sum", "groups")
