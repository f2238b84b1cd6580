"""BPE encoding and decoding by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged, so a text may be cut there for certain: the
pieces encode independently and the ids are put together again. The pairs are read from the vocabulary. Cuts are made

* at ASCII white space, which no token holds at all, giving fragments;
* inside a fragment of plain Latin characters where letters, digits and other signs meet and the pair occurs in no
  token. The pre-tokenizer breaks at these places too, so the left piece keeps its end-of-word mark. Fragments with
  other characters, or with the opening of a special string, go whole to the tokenizers library.

Every worker keeps what it has encoded (fragments and pieces) in dictionaries of bounded size; a full one is emptied.
The tokenizer file is a parameter and is opened by each worker.

Defined results: null and empty text have no tokens; special strings inside a text become their special ids, as the
library does by default; texts of any length are encoded whole; repeated rows are encoded alike, each with its row;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import read, slices, text_or_empty

TOKENIZER = "word_bpe_49k.json"
CACHED = 300_000  # entries of each dictionary of a worker

ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # str.split() is not the library's idea of these
FRAGMENT = re.compile(r"[^\x20\x09-\x0D]+")
LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e"  # letters that neither NFC nor lower-casing splits
PLAIN = re.compile(f"[\x21-\x7e{LATIN}]+")
PIECE = re.compile(f"[a-z{LATIN}]+|[0-9]|[^a-z0-9{LATIN}]+")
LETTERS = re.compile(f"[a-z{LATIN}]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pairs_in_vocabulary(vocab: Iterable[str], suffix: str) -> np.ndarray:
    """256 x 256: does the byte pair occur inside some token?"""
    table, alphabet = np.zeros((256, 256), dtype=bool), byte_of()
    for token in vocab:
        raw = [alphabet[c] for c in token.removesuffix(suffix) if c in alphabet]
        for a, b in zip(raw, raw[1:]):
            table[a, b] = True
    return table


class Encoder:
    """Encodes fragments through the caches; one per worker and tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        suffix = model.get("end_of_word_suffix") or ""
        self.joined = pairs_in_vocabulary(model["vocab"], suffix)
        spaces = [9, 10, 11, 12, 13, 32]
        if not suffix or self.joined[spaces].any() or self.joined[:, spaces].any():
            raise ValueError("white space is not a certain cut of this vocabulary")
        size = self.library.get_vocab_size()
        self.token = np.array([self.library.id_to_token(i) or "" for i in range(size)], dtype=object)
        self.ends = np.array([str(t).endswith(suffix) for t in self.token])
        self.fragments: dict[str, bytes] = {}  # ids as little-endian 32-bit integers
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def split(text: str) -> list[str]:
        """Fragments between ASCII white space."""
        return FRAGMENT.findall(text) if ODD_SPACE.search(text) else text.split()

    def cut(self, fragment: str) -> list[str]:
        """Pieces of a fragment at certain cuts; the whole fragment where none is certain."""
        if "<|" in fragment or not PLAIN.fullmatch(fragment):
            return [fragment]
        pieces, out = PIECE.findall(fragment.lower()), []
        for piece in pieces:
            if out and self.joined[out[-1].encode()[-1], piece.encode()[0]]:
                out[-1] += piece
            else:
                out.append(piece)
        return out

    def encode_pieces(self, pieces: list[str]) -> None:
        """Fill the cache of pieces. Runs of letters are one pre-token each: they are encoded many at a time."""
        words = [p for p in pieces if LETTERS.fullmatch(p)]
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            ids = np.array(self.library.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                raise ValueError("a run of letters was not one pre-token")
            self.pieces.update((p, x.tobytes()) for p, x in zip(some, np.split(ids, stops[:-1])))
        rest = [p for p in pieces if not LETTERS.fullmatch(p)]
        for p, e in zip(rest, self.library.encode_batch(rest, add_special_tokens=False)):
            self.pieces[p] = np.array(e.ids, dtype="<u4").tobytes()

    def learn(self, fragments: set[str]) -> None:
        """Encode fragments that the cache lacks."""
        cuts = {f: self.cut(f) for f in fragments}
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        self.encode_pieces([p for p in {p for c in cuts.values() for p in c} if p not in self.pieces])
        for f, pieces in cuts.items():
            self.fragments[f] = b"".join([self.pieces[p] for p in pieces])

    def lookup(self, fragments: list[str]) -> list[bytes]:
        """The ids of each fragment."""
        try:
            return list(map(self.fragments.__getitem__, fragments))
        except KeyError:
            if len(self.fragments) > CACHED:
                self.fragments.clear()
            self.learn({f for f in fragments if f not in self.fragments})
            return list(map(self.fragments.__getitem__, fragments))

    def lengths(self, fragments: list[str]) -> list[int]:
        """Number of ids of each fragment, past the cache of fragments."""
        cuts = [self.cut(f) for f in fragments]
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        self.encode_pieces([p for p in {p for c in cuts for p in c} if p not in self.pieces])
        return [sum(len(self.pieces[p]) for p in c) // 4 for c in cuts]

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids, decoded text) of a whole text. The library's decode joins the tokens by spaces, as it has no decoder."""
        ids = b"".join(self.lookup(self.split(text)))
        return ids, " ".join(self.token[np.frombuffer(ids, "<u4")].tolist())


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def bpe(docs: DataFrame, path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs(doc_id, text).

    With keep_ids also the ids themselves (array<int>) and the decoded text."""
    path = path or tokenizer_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, 1):
            n, a, b, kept, texts = [], [], [], [], []
            for text in batch.column(1):
                ids, decoded = enc.encode(text.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                if keep_ids:
                    kept.append(np.frombuffer(ids, dtype="<i4"))
                    texts.append(decoded)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(kept, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(read(spark, sf_dir, "documents"))
