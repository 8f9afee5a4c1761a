"""Token counts by offset-mapped attribution.

A whole document is encoded once. Byte-level tokens cover its bytes without gaps, so their spans follow from their lengths;
the spans are interval-joined, by binary search in sorted bounds, to fields and to the sections (lines) in them. The rule
for a token that crosses a boundary: it counts for the section that holds its first byte.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_blocks, spread, table, tokenizer_path

TOKENIZER = "byte_bpe_50k.tiktoken"
FIELDS = "n_tokens bigint, n_crossing bigint, sections array<struct<field:string,section:int,start:bigint,end:bigint,tokens:bigint>>"

_encoders: dict = {}


class Encoder:
    def __init__(self, name: str = TOKENIZER, pattern: str | None = None):
        import tiktoken

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        with open(tokenizer_path(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)

    def starts(self, text: str) -> np.ndarray:
        """The first byte of each token, and at the end the number of bytes."""
        ids = self.encoding.encode_ordinary(text)
        return np.concatenate(([0], np.cumsum(self.length[ids]))) if ids else np.zeros(1, np.int64)


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def count_sections(values: list[str | None], names: list[str], e: Encoder):
    """Tokens, tokens that cross a boundary, and counts by section, for the fields of one document joined by line feeds.

    A section is a line with the line feed that ends it; a null field has none.
    """
    known = [(n, v) for n, v in zip(names, values) if v is not None]
    text = "\n".join(v for _, v in known)
    starts = e.starts(text)
    owner, sizes, spans = [], [], []
    for k, (name, value) in enumerate(known):
        lines = value.split("\n")
        at = 0
        for i, line in enumerate(lines):
            last = i == len(lines) - 1
            sizes.append(len(line.encode("utf-8", "surrogatepass")) + (not last or k < len(known) - 1))
            owner.append((name, i))
            spans.append((at, at + len(line) + (not last)))
            at += len(line) + 1
    bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    first = np.searchsorted(bounds, starts[:-1], side="right") - 1
    final = np.searchsorted(bounds, starts[1:] - 1, side="right") - 1
    count = np.bincount(first, minlength=len(owner)) if len(owner) else []
    sections = [{"field": n, "section": i, "start": s, "end": t, "tokens": int(c)} for (n, i), (s, t), c in zip(owner, spans, count)]
    return len(starts) - 1, int((first != final).sum()), sections


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), tokenizer: str = TOKENIZER) -> DataFrame:
    """``docs`` with n_tokens, n_crossing and sections: for each line of each field its span in code points and its tokens.

    A null field has no section; a document of null fields has no tokens. An empty text is one section of no tokens. Counts
    of a document's sections add up to n_tokens. Null or repeated doc_ids: each row is counted alone. Texts of any
    length. Empty tables give no rows. Other columns stay, same-named ones are replaced.
    """

    def work(texts, batch):
        e = encoder(tokenizer)
        columns = [batch.column(f).to_pylist() if f != "text" else texts for f in fields]
        found = [count_sections(list(row), list(fields), e) for row in zip(*columns)]
        return [[f[0] for f in found], [f[1] for f in found], [f[2] for f in found]]

    return map_blocks(docs, FIELDS, work, block_bytes=4 << 20)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: doc_id, n_tokens, n_crossing, n_sections, section_tokens; edge cases as in ``token_counts``."""
    out = token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return out.select("doc_id", "n_tokens", "n_crossing", F.size("sections").cast("long").alias("n_sections"), F.transform("sections", lambda s: s["tokens"]).alias("section_tokens"))
