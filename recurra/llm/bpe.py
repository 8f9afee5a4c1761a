"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the characters cuts every text into chunks that depend on content only, so copies and shared passages
give the same chunks wherever they stand. A chunk is encoded once and kept (a store of bounded size for each task); the
joins between chunks are then repaired: the end of one chunk and the start of the next are encoded together, between two
places that no token crosses, and the pieces cut off must agree exactly with the chunks' own tokens. Where they
don't, the window grows to both whole chunks, then to their neighbours, until all joins agree. Nothing is shuffled, so a
lost executor costs only its own tasks.
"""

from __future__ import annotations

import json
import os
import re
from collections import OrderedDict
from itertools import chain, repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_blocks, spread, table, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
#: A chunk ends where the low MASK_BITS bits of the hash of the last SPAN characters are 0: 1,024 characters on average.
SPAN, MASK_BITS, LEAST, MOST = 16, 10, 256, 16_384
STORE_TOKENS = 2_000_000
#: Bound of the table of words.
WORDS = 250_000
BATCH_CHARS = 200_000
#: One ASCII space or line feed between ASCII letters or digits: no token crosses it, and no normalisation does.
_SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \n](?=[A-Za-z0-9])")
FIELDS = "n_tokens bigint, token_ids binary, decoded string"


def cuts(text: str) -> list[int]:
    """Ends of the chunks of ``text``."""
    n = len(text)
    if n <= LEAST:
        return [n]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        c = (c * np.uint32(0x9E3779B1)) ^ (c >> 7)
        h = c.copy()
        k = 1
        while k < SPAN:  # h[i] covers k characters up to i; doubling covers SPAN of them
            h[k:] = h[k:] + h[:-k] * np.uint32(pow(0x85EBCA6B, k, 1 << 32))
            k *= 2
        h ^= h >> 15
        h *= np.uint32(0x2C1B3C6D)
    found = np.flatnonzero((h >> (32 - MASK_BITS)) == 0) + 1
    out, last = [], 0
    for e in found.tolist() + [n]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e - last >= LEAST or e == n and e > last:
            out.append(e)
            last = e
    return out


class WordTable:
    """Ids of the words between ASCII white space, for tokenizers that drop white space before they merge.

    There no token, normalisation or special token crosses white space, so a text's ids are those of its words in turn.
    At ``most`` words the table starts anew, which bounds memory and changes no result.
    """

    def __init__(self, tok, most: int = WORDS):
        self.tok, self.most = tok, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.start, self.length, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _add(self, words: list[bytes]) -> None:
        for i in range(0, len(words), 4096):
            some = words[i : i + 4096]
            ids = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)]
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            n, total = len(self.place), int(length.sum())
            while n + len(some) > len(self.start):
                self.start, self.length = np.resize(self.start, 2 * len(self.start)), np.resize(self.length, 2 * len(self.length))
            while self.used + total > len(self.ids):
                self.ids = np.resize(self.ids, 2 * len(self.ids))
            self.start[n : n + len(some)] = self.used + np.cumsum(length) - length
            self.length[n : n + len(some)] = length
            self.ids[self.used : self.used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
            self.used += total
            self.place.update(zip(some, range(n, n + len(some))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.encode().split() for t in texts]
        each = np.fromiter(map(len, words), np.int64, len(words))
        flat = list(chain.from_iterable(words))
        at = np.fromiter(map(self.place.get, flat, repeat(-1)), np.int64, len(flat))
        if len(missing := np.flatnonzero(at < 0)):
            fresh = [flat[i] for i in missing.tolist()]
            new = list(dict.fromkeys(fresh))
            if self.place and len(self.place) + len(new) > self.most:
                self.clear()
                return self.encode(texts)
            self._add(new)
            at[missing] = np.fromiter(map(self.place.__getitem__, fresh), np.int64, len(fresh))
        length = self.length[at]
        ends = np.cumsum(length)
        ids = self.ids[np.repeat(self.start[at] - (ends - length), length) + np.arange(int(length.sum()))]
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(each)))].tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


class Codec:
    """Encodes and decodes texts with a store of chunks; ``made`` and ``used`` count chunks encoded and asked for, ``repairs`` texts with a bad join."""

    def __init__(self, name: str = TOKENIZER, store_tokens: int = STORE_TOKENS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path(name))
        self.tok.no_truncation()
        self.tok.no_padding()
        #: Without a decoder, decoding is joining tokens by spaces.
        self.tokens = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())] if self.tok.decoder is None else None
        split = (json.loads(self.tok.to_str())["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        drops_space = split.get("behavior") == "Removed" and split.get("invert") and "[^\\s" in split["pattern"].get("Regex", "")
        self.words = WordTable(self.tok) if drops_space else None
        self.store: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.joints: dict[str, np.ndarray] = {}
        self.store_tokens, self.held, self.made, self.used, self.repairs = store_tokens, 0, 0, 0, 0

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH_CHARS):
                size += len(texts[j])
                j += 1
            out += self.words.encode(texts[i:j]) if self.words else [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts[i:j], add_special_tokens=False)]
            i = j
        return out

    def chunk_ids(self, chunks: list[str]) -> list[np.ndarray]:
        keys = [xxhash.xxh3_128_digest(c.encode("utf-8", "surrogatepass")) for c in chunks]
        self.used += len(keys)
        got: dict[bytes, np.ndarray] = {}
        new: dict[bytes, str] = {}
        for k, c in zip(keys, chunks):
            if k in got or k in new:
                continue
            if k in self.store:
                self.store.move_to_end(k)
                got[k] = self.store[k]
            else:
                new[k] = c
        self.made += len(new)
        for k, ids in zip(new, self.plain(list(new.values()))):
            got[k] = self.store[k] = ids
            self.held += len(ids) + 16
        while self.held > self.store_tokens and self.store:
            self.held -= len(self.store.popitem(last=False)[1]) + 16
        return [got[k] for k in keys]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as of encoding it whole."""
        ends = [cuts(t) for t in texts]
        chunks = [t[a:b] for t, e in zip(texts, ends) for a, b in zip([0, *e], e)]
        ids = self.chunk_ids(chunks)
        # the pieces at every join: from the last safe place of the left chunk, to the first one of the right chunk
        joins: list[tuple[int, str, str]] = []
        k = 0
        for e in ends:
            for j in range(k, k + len(e) - 1):
                joins.append((j, chunks[j][_last_safe(chunks[j]) :], chunks[j + 1][: _first_safe(chunks[j + 1])]))
            k += len(e)
        if len(self.joints) > 20_000:
            self.joints.clear()
        fresh = list(dict.fromkeys(s for _, a, b in joins for s in (a, b, a + b) if s not in self.joints))
        self.joints.update(zip(fresh, self.plain(fresh)))
        at = {j: (a, b) for j, a, b in joins}
        out, k = [], 0
        for t, e in zip(texts, ends):
            out.append(self._joined(t, [k + i for i in range(len(e))], chunks, ids, at))
            k += len(e)
        return out

    def _joined(self, text: str, mine: list[int], chunks: list[str], ids: list[np.ndarray], at: dict) -> np.ndarray:
        if len(mine) == 1:
            return ids[mine[0]]
        parts: list[np.ndarray] = []
        skip = 0  # tokens of the chunk's start that the join before it has replaced
        for j in mine:
            own = ids[j]
            if j == mine[-1]:
                parts.append(own[skip:])
                break
            a, b = at[j]
            tail, head = self.joints[a], self.joints[b]
            if len(a) == len(chunks[j]) or len(b) == len(chunks[j + 1]) or skip + len(tail) > len(own) or not (_ends(own, tail) and _starts(ids[j + 1], head)):
                return self._repaired(text, [chunks[k] for k in mine])
            parts += [own[skip : len(own) - len(tail)], self.joints[a + b]]
            skip = len(head)
        return np.concatenate(parts)

    def _repaired(self, text: str, chunks: list[str]) -> np.ndarray:
        """Joins of which one has no safe place in a whole chunk, or no agreement: windows grow over whole chunks.

        Chunks at a bad join are one window, encoded anew, and its outer joins are tested again; after a few rounds the window
        is the text.
        """
        self.repairs += 1
        for _ in range(3):
            cut = [(_last_safe(a), _first_safe(b)) for a, b in zip(chunks, chunks[1:])]
            open_ = [a == 0 or b == len(c) for (a, b), c in zip(cut, chunks[1:])]
            if not any(open_):
                ids = self.plain(chunks)
                pieces = [(c[a:], d[:b]) for (a, b), c, d in zip(cut, chunks, chunks[1:])]
                got = self.plain([s for a, b in pieces for s in (a, b, a + b)])
                parts, skip = [], 0
                for j, own in enumerate(ids[:-1]):
                    tail, head, both = got[3 * j : 3 * j + 3]
                    open_[j] = skip + len(tail) > len(own) or not (_ends(own, tail) and _starts(ids[j + 1], head))
                    parts += [own[skip : len(own) - len(tail)], both]
                    skip = len(head)
                if not any(open_):
                    return np.concatenate([*parts, ids[-1][skip:]])
            wider = chunks[:1]
            for c, bad in zip(chunks[1:], open_):
                if bad:
                    wider[-1] += c
                else:
                    wider.append(c)
            chunks = wider
        return self.plain([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        if self.tokens is not None:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.tok.decode(ids.tolist(), skip_special_tokens=False)


def _last_safe(chunk: str) -> int:
    last = 0
    for m in _SAFE.finditer(chunk, max(0, len(chunk) - 200)):
        last = m.start()
    if not last:
        for m in _SAFE.finditer(chunk):
            last = m.start()
    return last


def _first_safe(chunk: str) -> int:
    m = _SAFE.search(chunk)
    return m.start() if m else len(chunk)


def _ends(ids: np.ndarray, tail: np.ndarray) -> bool:
    return len(tail) <= len(ids) and np.array_equal(ids[len(ids) - len(tail) :], tail)


def _starts(ids: np.ndarray, head: np.ndarray) -> bool:
    return len(head) <= len(ids) and np.array_equal(ids[: len(head)], head)


_codecs: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    if name not in _codecs:
        _codecs[name] = Codec(name)
    return _codecs[name]


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with n_tokens, token_ids (little-endian unsigned 32-bit integers) and decoded text.

    Null text is encoded as empty text: no tokens, decoded empty. Null or repeated doc_ids: each row is encoded alone.
    Texts of any length, in chunks. Empty tables give no rows. Other columns stay, same-named ones are replaced.
    """

    def work(texts, batch):
        c = codec(tokenizer)
        ids = c.encode([t or "" for t in texts])
        return [[len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], [c.decode(x) for x in ids]]

    return map_blocks(docs, FIELDS, work, block_bytes=2 << 20)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256; edge cases as in ``encode_documents``."""
    out = encode_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
