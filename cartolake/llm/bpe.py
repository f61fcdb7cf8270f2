"""Byte-level BPE encoding and decoding by tree concatenation.

A long text is not split beforehand: it is halved, wherever that falls, until its parts are short. The parts are encoded in
parallel, and at each join of two halves growing windows around it are encoded again, until the outermost pieces of the
window are those that both sides have there, with the same ids; then nothing beyond the window can differ.

Inside a part, and inside a window, pieces begin where a single space follows a character that is no white space: no
pre-token of this family of tokenizers reaches over such a place, so an agreement there is exact. A piece without any such
place that is still long goes through the same tree on its bytes, with windows of tokens. Short pieces repeat, so each
distinct one is encoded once in a worker; caches are bounded by bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models

from cartolake.llm.shared import mapped, text_or_empty

LEAF_CHARS = 4096
#: Fixed value: how byte-level tokenizers of this family split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S)(?= )")
_ODD_SPACE = re.compile(r"^ |\s ")
_ODD_ASCII = [c + " " for c in " \t\n\v\f\r\x1c\x1d\x1e\x1f"]


def _odd(text: str) -> bool:
    """Whether some space starts the text or follows white space."""
    if text.isascii():
        return text.startswith(" ") or any(x in text for x in _ODD_ASCII)
    return _ODD_SPACE.search(text) is not None


#: Characters of a piece that is remembered, and of all pieces that a worker remembers.
KEPT_CHARS = 64
CACHE_CHARS = 4 << 20


class _Pieces(dict):
    """Ids of pieces with their leading text, encoded when first asked for. Short ones are kept while they fit in CACHE_CHARS."""

    def __init__(self, bpe: ByteBpe, lead: str):
        self.bpe, self.lead, self.held = bpe, lead, 0

    def __missing__(self, key: str) -> bytes:
        ids = self.bpe._piece(self.lead + key)
        if len(key) <= KEPT_CHARS:
            if self.held > CACHE_CHARS:
                self.clear()
                self.held = 0
            self[key] = ids
            self.held += len(key)
        return ids


class TreeEncoder:
    """Encodes one unsplit string (in the byte alphabet) with the merges alone."""

    def __init__(self, config: dict, leaf: int = LEAF_CHARS):
        model = config["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bare = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0))
        self.text_of = {i: t for t, i in model["vocab"].items()}
        self.leaf = leaf

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.bare.encode_batch(texts, add_special_tokens=False)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Ids of the joined text from the ids of its parts.

        A sequence is the encoding if every two neighbours are the encoding of their joined text. That holds inside both
        parts and inside the window, and at the window's ends if its outer tokens are the ones the parts have there.
        """
        if not left or not right:
            return left or right
        reach = 8
        while True:
            i, j = max(0, len(left) - reach), min(len(right), reach)
            window = self._ids(["".join(self.text_of[t] for t in [*left[i:], *right[:j]])])[0]
            if (i == 0 or window[0] == left[i]) and (j == len(right) or window[-1] == right[j - 1]):
                return [*left[:i], *window, *right[j:]]
            reach *= 2

    def encode(self, text: str) -> list[int]:
        """Halve down to leaves, encode all leaves as one parallel batch, join neighbours upwards."""
        parts = [text]
        while len(parts[0]) > self.leaf:
            parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
        found = self._ids(parts)
        while len(found) > 1:
            found = [self.join(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
        return found[0]


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids as the library does with ``add_special_tokens=False``."""

    def __init__(self, path: str, leaf: int = LEAF_CHARS):
        config = json.load(open(path, encoding="utf-8"))
        if config.get("normalizer") or (config.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError("a byte-level tokenizer without a normalizer is expected")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = config.get("added_tokens") or []
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("an added token takes white space")
        self.added = {t["content"]: t["id"] for t in added}
        self._added_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        self.tree = TreeEncoder(config, leaf)
        self.leaf = leaf
        self.spaced, self.first = _Pieces(self, " "), _Pieces(self, "")
        #: Joins made so far, and encoded windows; a join has one window or more.
        self.joins = self.windows = 0
        letters = _byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in config["model"]["vocab"].items()}
        self.quick = self._quick(config["model"])
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}

    def _quick(self, model: dict) -> tiktoken.Encoding | None:
        """The same merges in a faster encoder, for vocabularies whose ids rise in the order of their merges."""
        ranked = {b: i for i, b in self.bytes_of.items() if self.added.get(b.decode("utf-8", "replace")) != i}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or len(made) + 256 != len(ranked) or max(ranked.values()) >= len(ranked):
            return None
        return tiktoken.Encoding("merges", pat_str=SPLIT, mergeable_ranks=ranked, special_tokens={})

    def _long(self, text: str) -> bytes:
        """A piece that holds long unsplit text."""
        ids: list[int] = []
        for part in self._added_cut.split(text) if self._added_cut else [text]:
            if part in self.added:
                ids.append(self.added[part])
                continue
            for token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part):
                ids += self.tree.encode(token)
        return np.array(ids, "<u4").tobytes()

    def _piece(self, text: str) -> bytes:
        """Ids of one piece."""
        if len(text) > self.leaf:
            return self._long(text)
        if self.quick and not any(a in text for a in self.added):
            return array("I", self.quick.encode_ordinary(text)).tobytes()
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _encoded(self, text: str) -> tuple[list[str], list[bytes]]:
        """The text's pieces with their ids: its head, then what begins at a safe space, without that space."""
        if _odd(text):
            head, *rest = _CUT.split(text)
            pieces = [p[1:] for p in rest]
        else:
            head, *pieces = text.split(" ")
        ids = [self.first[head], *map(self.spaced.__getitem__, pieces)]
        return [head, *pieces], ids

    def join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """Pieces and ids of the joined text from those of its halves; ``left`` is changed into it."""
        self.joins += 1
        (left_pieces, left_ids), (right_pieces, right_ids) = left, right
        reach = 1
        while True:
            i, j = max(0, len(left_pieces) - reach), min(len(right_pieces), reach)
            # Every piece but the head of the left half begins with its space.
            window = (" " if i else "") + " ".join(left_pieces[i:]) + " ".join(right_pieces[:j])
            pieces, ids = self._encoded(window)
            if i:
                pieces[0] = pieces[0][1:]
            self.windows += 1
            left_agrees = i == 0 or (pieces[0] == left_pieces[i] and ids[0] == left_ids[i])
            right_agrees = j == len(right_pieces) or (len(pieces) > 1 and pieces[-1] == right_pieces[j - 1] and ids[-1] == right_ids[j - 1])
            if left_agrees and right_agrees:
                left_pieces[i:], left_ids[i:] = pieces + right_pieces[j:], ids + right_ids[j:]
                return left
            reach *= 2

    def _leaves(self, text: str) -> list[str]:
        parts = [text]
        while len(parts[0]) > self.leaf:
            parts = [h for p in parts for h in (p[: (len(p) + 1) // 2], p[(len(p) + 1) // 2 :]) if h]
        return parts

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; the leaves of all texts are encoded before any are joined."""
        out, leaves = [], [[self._encoded(leaf) for leaf in self._leaves(text)] for text in texts]
        for parts in leaves:
            while len(parts) > 1:
                parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            out.append(b"".join(parts[0][1]))
        return out

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``: bytes of the tokens, read as UTF-8."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _byte_letters() -> dict[str, int]:
    """The byte alphabet: printable Latin-1 characters stand for themselves, others for characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


_workers: dict[tuple, ByteBpe] = {}


def encoder(path: str) -> ByteBpe:
    """One encoder for each file in a worker."""
    if (path,) not in _workers:
        _workers[path,] = ByteBpe(path)
    return _workers[path,]


def texts_of(part: pa.RecordBatch, column: str = "text") -> list[str]:
    return [t or "" for t in part.column(column).to_pylist()]


def bpe_round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids (array<int>), decoded. See ``bpe_digests`` for digests alone.

    Null text counts as empty: no ids, empty decoded text. Special strings in texts become their tokens, as is the
    library's default. Repeated rows each get a row; no rows give none; other columns are ignored.
    """

    def make(part: pa.RecordBatch) -> list:
        bpe = encoder(path)
        ids = [np.frombuffer(raw, "<u4") for raw in bpe.encode(texts_of(part))]
        decoded = [bpe.decode(x.tolist()) for x in ids]
        return [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]

    names = ["doc_id", "n_tokens", "ids", "decoded"]
    return mapped(docs.select("doc_id", text_or_empty().alias("text")), "text", "doc_id long, n_tokens long, ids array<int>, decoded string", names, make)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256.

    The ids and decoded texts are those of ``bpe_round_trip``; only their digests leave the worker.
    """

    def make(part: pa.RecordBatch) -> list:
        bpe = encoder(path)
        counts, id_sums, text_sums = [], [], []
        for raw in bpe.encode(texts_of(part)):
            ids = np.frombuffer(raw, "<u4").tolist()
            counts.append(len(ids))
            id_sums.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
            text_sums.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
        return [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(id_sums, pa.string()), pa.array(text_sums, pa.string())]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return mapped(docs.select("doc_id", text_or_empty().alias("text")), "text", "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", names, make)
