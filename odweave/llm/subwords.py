"""Token ids of whole texts by a byte-level BPE file of the tokenizers library, word by word where that is safe.

Splitting such a text before a lone space that stands between two characters other than white space never
changes its ids: the file's pattern starts a new piece there, and merges stay within pieces. So each different
word of a batch of texts is encoded once, all of them in one call, and the texts' ids are gathered from there.
Texts with other white space at the ends of words, or with special tokens, go through the tokenizers library as
they are, and so does everything where the file's merges are not in the order of their ids.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words whose ids are gathered at a time.
SLICE = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 characters stand for themselves, the other bytes follow each other from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(path: str) -> dict[int, bytes]:
    """Id -> bytes of the vocabulary's entries."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    table = byte_alphabet()
    return {i: bytes(table[c] for c in entry) for entry, i in vocab.items() if all(c in table for c in entry)}


def is_loose(word: str) -> bool:
    """Whether a word must not be cut off from what is around it."""
    return not word or word[0].isspace() or word[-1].isspace()


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts at their spaces: each word's place in the list of different words, the bounds of the texts' words, and that list."""
    lists = pc.split_pattern(texts, " ")
    found = lists.flatten().dictionary_encode()
    return found.indices.to_numpy(), lists.offsets.to_numpy(), found.dictionary.to_pylist()


def gather(values: np.ndarray, bounds: np.ndarray, units: np.ndarray) -> np.ndarray:
    """The runs values[bounds[u]:bounds[u + 1]] for each u of units, one after another."""
    out = [values[:0]]
    for at in range(0, len(units), SLICE):
        own = units[at : at + SLICE]
        start, size = bounds[own], bounds[own + 1] - bounds[own]
        out.append(values[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)])
    return np.concatenate(out)


def bounds_of(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


@functools.lru_cache(maxsize=4)
def _whole(path: str, plain_special: bool) -> object:
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = plain_special
    return whole


def _direct(path: str, plain_special: bool) -> Callable[[str], np.ndarray]:
    """Through the tokenizers library, which is loaded when a text needs it."""
    return lambda text: np.asarray(_whole(path, plain_special).encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level vocabulary whose merges are in the order of their ids and which texts reach unchanged; None for other files."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, known = spec["model"], token_bytes(path)
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    own = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    ordered = [model["vocab"].get(a + b) for a, b in pairs] == list(range(256, 256 + len(pairs))) and all(len(known[i]) == 1 for i in range(256))
    if spec["normalizer"] or {k: spec["pre_tokenizer"].get(k) for k in own} != own or not ordered:
        return None
    return {known[i]: i for i in range(256 + len(pairs))}


@functools.lru_cache(maxsize=4)
def raw_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text -> its ids; strings of special tokens are ordinary text."""
    import tiktoken

    found = ranks(path)
    if found is None:
        return _direct(path, True)
    #: The pattern of byte-level BPE files.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=found, special_tokens={}).encode_to_numpy


@functools.lru_cache(maxsize=4)
def token_sizes(path: str) -> np.ndarray:
    """Id -> number of bytes; 0 for entries that are not byte-level."""
    known = token_bytes(path)
    return np.array([len(known.get(i, b"")) for i in range(max(known) + 1)], np.int64)


def encode_words(path: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a space and each word, one after another, and their bounds. ranks() must know the file, and no word be loose."""
    if not words:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64)
    ids = raw_encoder(path)(" " + " ".join(words))
    ends = np.cumsum(pc.binary_length(pa.array(words, pa.large_string())).to_numpy().astype(np.int64) + 1)
    return ids, np.concatenate([[0], np.searchsorted(np.cumsum(token_sizes(path)[ids]), ends) + 1])


@functools.lru_cache(maxsize=4)
def batch_encoder(path: str, plain_special: bool = False) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts (none null) -> their ids one after another, and the texts' bounds. plain_special: strings of special tokens are ordinary text."""
    direct = _direct(path, plain_special)
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    by_words = ranks(path) is not None and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
    special = [] if plain_special else [t["content"] for t in added]

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not by_words or not len(texts):
            found = [direct(t.as_py()) for t in texts]
            return np.concatenate([np.zeros(0, np.uint32), *found]), bounds_of([len(f) for f in found])
        places, bounds, words = split_words(texts)
        loose = np.fromiter(map(is_loose, words), bool, len(words))
        whole = np.logical_or.reduceat(loose[places], bounds[:-1])
        for s in special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        # Units: the different words, then for each text its first word, which no space precedes, or the whole text.
        ids, at = encode_words(path, [w for w, bad in zip(words, loose, strict=True) if not bad])
        raw, first = raw_encoder(path), bounds[:-1]
        heads = [direct(texts[i].as_py()) if alone else raw(words[p]) for i, (p, alone) in enumerate(zip(places[first], whole, strict=True))]
        units = (np.cumsum(~loose) - 1)[places]
        units[first] = len(at) - 1 + np.arange(len(texts))
        kept = np.repeat(~whole, np.diff(bounds))
        kept[first] = True
        at = np.concatenate([at, at[-1] + np.cumsum([len(h) for h in heads])])
        size, ends = np.diff(at), bounds_of(kept)[bounds]
        units = units[kept]
        return gather(np.concatenate([ids, *heads]), at, units), bounds_of(size[units])[ends]

    return run


def encoder(path: str, plain_special: bool = False) -> Callable[[str], bytes]:
    """Text -> its ids as little-endian unsigned 32-bit numbers, as batch_encoder()."""
    return lambda text: batch_encoder(path, plain_special)(pa.array([text], pa.string()))[0].astype("<u4").tobytes()
