"""Operator 12, token counts by a map-side lookup in two tiers. No pre-token is shuffled.

`frequent` makes the first tier: a compact table of the commonest pre-tokens and how many tokens each has, from a bounded sample of the
documents. It is broadcast with the tokenizer's own definition (a few MB each; the table has at most `most` short entries). `count` looks
every pre-token of every text up there. What is missing is encoded once per worker process and kept in its cache, the second tier, which
starts again when it is full; both tiers only save work, every count is the tokenizer's.

A pre-token is what the tokenizer's own pre-tokenizer makes. Where it drops blanks and never looks over them (tested on the tokenizer), a worker also remembers
whole words between ASCII blanks, so that a known word is one lookup; otherwise texts are cut by the library as a whole. Special strings
inside a text count as the library's default has it: the word or text that holds one is encoded by the library.

A null text is empty and has 0 tokens, as a text of blanks has. Very long texts are cut and counted whole; very long words are encoded and not kept. Rows are
independent, so null, equal and repeated keys and ties of any kind change nothing; an empty table gives no rows. Other columns are only returned when named in `carry`;
one that is named like a result is not returned.
"""

from __future__ import annotations

import collections
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
#: Entries a worker's cache holds, and the longest entry it keeps (bytes).
CACHE, LONGEST = 400_000, 64
RESULTS = ("n_bytes", "n_tokens", "over_limit")


@dataclass
class Table:
    """Pre-tokens, one per line, and their token counts: about 10 bytes an entry."""

    text: bytes = b""
    lengths: np.ndarray = None

    def entries(self) -> dict:
        return dict(zip(self.text.decode().split("\n"), self.lengths.tolist())) if self.text else {}


class Lengths(dict):
    """Token counts by key; a missing one is made by `encode` and kept. A full cache starts again from `first`."""

    def __init__(self, first: dict, encode, most: int):
        super().__init__(first)
        self.first, self.encode, self.most = first, encode, most + len(first)

    def __missing__(self, key):
        n = self.encode(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
                self.update(self.first)
            self[key] = n
        return n


class Encoder:
    """What a worker process keeps of one tokenizer and one table."""

    def __init__(self, definition: str, table: Table, cache: int = CACHE):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.normalized = [t.content for t in added if t.normalized]
        self.model = self.library.model
        self.words_apart = not any(c in t for t in self.added for c in BLANKS) and all(
            self.cut(f"a{b}b,{b}{b}'s{b}") == [*self.cut("a"), *self.cut("b,"), *self.cut("'s")] for b in BLANKS)
        self.pieces = Lengths(table.entries(), lambda p: len(self.model.tokenize(p)), cache)
        self.words = Lengths({}, self.word, cache)

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings, as the model reads them."""
        norm, pre = self.library.normalizer, self.library.pre_tokenizer
        text = norm.normalize_str(text) if norm else text
        return [p for p, _ in pre.pre_tokenize_str(text)] if pre else [text]

    def special(self, text: str) -> bool:
        if any(t in text for t in self.added):
            return True
        return any(t in self.library.normalizer.normalize_str(text) for t in self.normalized) if self.normalized and self.library.normalizer else False

    def word(self, data: bytes) -> int:
        text = data.decode()
        if self.special(text):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        return sum(map(self.pieces.__getitem__, self.cut(text)))

    def count(self, data: bytes) -> int:
        return sum(map(self.words.__getitem__, data.split())) if self.words_apart else self.word(data) if data else 0


_KEPT: dict = {}


def _encoder(name: str, shared) -> Encoder:
    """The encoder of one call of `count`, made once per worker process; the next call's takes its place."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Encoder(*shared.value)
    return _KEPT[name]


def _texts(batch: pa.RecordBatch, at: int = 0, rows: int = 256):
    """The texts of a batch as bytes, in slices."""
    column = batch.column(at).fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    for i in range(0, len(column), rows):
        yield column.slice(i, rows)


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def frequent(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", most: int = 50_000, sample: int = 20_000) -> Table:
    """The `most` commonest pre-tokens of about `sample` documents, chosen by the hash of their key, with their token counts."""
    shared = docs.sparkSession.sparkContext.broadcast((read_definition(path), Table()))
    every = max(1, docs.count() // sample)

    def run(batches):
        encoder, found = Encoder(*shared.value), collections.Counter()
        for batch in batches:
            for texts in _texts(batch):
                for data in texts.to_pylist():
                    for word, n in collections.Counter(data.split() if encoder.words_apart else [data]).items():
                        word = word.decode()
                        if not encoder.special(word):
                            for piece in encoder.cut(word):
                                found[piece] += n
        rows = [(p, n, encoder.pieces[p]) for p, n in found.items() if len(p) <= LONGEST and "\n" not in p]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32()))], ["piece", "n", "tokens"])

    chosen = docs.where(F.pmod(F.xxhash64(F.col(f"`{key}`")), every) == 0).select(F.col(f"`{text}`"))
    rows = (chosen.mapInArrow(run, "piece string, n long, tokens int").groupBy("piece").agg(F.sum("n").alias("n"), F.first("tokens").alias("tokens"))
            .orderBy(F.desc("n"), "piece").limit(most).select("piece", "tokens").collect())
    return Table("\n".join(r.piece for r in rows).encode(), np.array([r.tokens for r in rows], np.int32))


def count(docs: DataFrame, path: str, table: Table | None = None, text: str = "text", key: str = "doc_id", limit: int = 2048, carry=()) -> DataFrame:
    """`key`, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; `path` names a tokenizer file of the library `tokenizers`."""
    shared = docs.sparkSession.sparkContext.broadcast((read_definition(path), table or Table()))
    name = uuid.uuid4().hex
    kept = [key, *[c for c in carry if c != key and c.lower() not in RESULTS]]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        encoder = _encoder(name, shared)
        for batch in batches:
            sizes, tokens = [], []
            for texts in _texts(batch):
                sizes.append(pc.binary_length(texts).cast(pa.int64()))
                tokens += map(encoder.count, texts.to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.concat_arrays(sizes) if sizes else pa.array([], pa.int64()), pa.array(tokens, pa.int64())],
                                             [*[f"k{i}" for i in range(len(kept))], "n_bytes", "n_tokens"])

    rows = docs.select(F.col(f"`{text}`").alias("t"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)])
    schema = ", ".join([*[f"k{i} {kinds[c]}" for i, c in enumerate(kept)], "n_bytes long", "n_tokens long"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
