"""Token counts: batches balanced by bytes go through Arrow functions that return lengths only."""

from __future__ import annotations

import re

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from cartolake.llm.bpe import CACHE_CHARS, KEPT_CHARS, texts_of
from cartolake.llm.shared import mapped, text_or_empty

MARK = "▁"
#: Between a character and a single space before a character, where neither is a space or stands for one.
_CUT = re.compile(f"(?<=[^ {MARK}]) (?=[^ {MARK}])")
_ODD = re.compile(f"^ |  |{MARK}| $")


class PieceCounter:
    """Counts of a SentencePiece model.

    With an identity normaliser, a dummy prefix and no piece that holds a space mark after another character, a single
    space between two other characters is a safe boundary: the right part gets its mark back as the dummy prefix. Whole
    texts are split there. Each distinct short part is encoded once in a worker, as long as they fit in CACHE_CHARS; long
    parts are not kept. Other models get whole texts.
    """

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = self.model.encode("ﬁ  a", out_type=str)
        self.safe = not any(MARK in p.lstrip(MARK) for p in pieces) and "".join(probe) == f"{MARK}ﬁ{MARK}{MARK}a"
        self.known: dict[str, int] = {"": 0}
        self.held = 0

    def counts(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        if self.held > CACHE_CHARS:
            self.known, self.held = {"": 0}, 0
        parts = [_CUT.split(t) if _ODD.search(t) else t.split(" ") for t in texts]
        need: set[str] = set()
        for p in parts:
            need.update(p)
        new = [k for k in need if k not in self.known]
        found = dict(zip(new, map(len, self.model.encode(new, num_threads=1)), strict=True))
        long = {k: found.pop(k) for k in new if len(k) > KEPT_CHARS}
        self.known.update(found)
        self.held += sum(map(len, found))
        look = self.known.__getitem__ if not long else lambda k: self.known[k] if k in self.known else long[k]
        return [sum(map(look, p)) for p in parts]


class LibraryCounter:
    """Counts of a tokenizers file, without truncation, padding or added special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_workers: dict[str, PieceCounter | LibraryCounter] = {}


def counter(path: str) -> PieceCounter | LibraryCounter:
    if path not in _workers:
        _workers[path] = (PieceCounter if path.endswith(".model") else LibraryCounter)(path)
    return _workers[path]


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Null text counts as empty: no bytes, no tokens. Repeated rows each get a row; no rows give none; other columns are
    ignored.
    """

    def make(part: pa.RecordBatch) -> list:
        texts = texts_of(part)
        n = counter(path).counts(texts)
        sizes = [len(t.encode()) for t in texts]
        return [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]

    names = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    return mapped(docs.select("doc_id", text_or_empty().alias("text")), "text", "doc_id long, n_bytes long, n_tokens long, over_limit boolean", names, make)
