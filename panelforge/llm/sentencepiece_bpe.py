"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model.

Merging pair by pair is replaced by a left-to-right search: take the longest piece that starts
here (Aho-Corasick over the pieces), check that it can stand beside the piece before it (re-merge
the two pieces' joint text and see whether the same two come out), and else fall back to the next
shorter piece, or remove the piece before. Positions from which no way led on are kept in a
bitfield, so none is tried twice. A sequence whose neighbours are all compatible is what merging
gives, so the result is exact. Spark deals out the texts; each task keeps one encoder.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from .tables import text_of

SPACE = "▁"  # stands for a space within pieces


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (field number, value) pairs of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            n = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + n]
            at += n


def _normalizer(model: bytes) -> dict:
    """What the model's normalizer does: field 3 of the model; 2, 3, 4, 5 of that message."""
    spec = {"rules": b"", "dummy_prefix": True, "remove_extra_spaces": True, "escape_spaces": True}
    names = {2: "rules", 3: "dummy_prefix", 4: "remove_extra_spaces", 5: "escape_spaces"}
    for field, value in _fields(model):
        if field == 3:
            spec |= {names[k]: v for k, v in _fields(value) if k in names}
    return spec


class Encoder:
    """One model's tables. Only models without normalization rules are taken (a ValueError else)."""

    def __init__(self, path: str, memo: int = 300_000):
        with open(path, "rb") as file:
            spec = _normalizer(file.read())
        if spec["rules"] or spec["remove_extra_spaces"] or not spec["escape_spaces"]:
            raise ValueError("the model normalizes its text beyond escaping spaces")
        sp = SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if spec["dummy_prefix"] else ""
        self.unknown = sp.unk_id()
        self.id_of: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                value = int(piece[3:5], 16)
                self.byte_id[value] = k
                self.bytes_of.append(bytes([value]))
            elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                self.bytes_of.append(b" \xe2\x81\x87 " if sp.is_unknown(k) else b"")
            else:
                self.id_of[piece], self.rank[piece] = k, -sp.get_score(k)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        if len(self.byte_id) < 256:
            self.byte_id = {}
        # pieces that merging can't make out of their own text can never come out of a text
        self.reachable = {x for x in self.id_of if len(x) == 1 or self._merge(x) == [x]}
        self.alphabet = {x for x in self.reachable if len(x) == 1}
        self.shorter = {x: next((x[:k] for k in range(len(x) - 1, 0, -1) if x[:k] in self.reachable), None) for x in self.reachable}
        self.automaton = ahocorasick.Automaton()
        for x in self.reachable:
            self.automaton.add_word(x[::-1], x)  # over the reversed text, where ends are starts
        self.automaton.make_automaton()
        self.fits: dict[str, bool] = {}
        # no piece goes on with a space after something else, nor over a break that is no piece: such places part the text
        inner = any(SPACE in x.lstrip(SPACE) for x in self.id_of)
        breaks = "" if "\n" in self.alphabet else r"\n"
        self.part = re.compile(r"(?s:.+)" if inner else rf"{SPACE}*[^{SPACE}{breaks}]+|{SPACE}+" + (r"|\n" if breaks else ""))
        # parts seen lately, in two generations: when the newer one is full it becomes the older one,
        # so what recurs stays and the size is bounded
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.memo_size = memo

    def _merge(self, text: str) -> list[str]:
        """The pieces by plain merging: the best-ranked adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                r = self.rank.get(parts[k] + parts[k + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, left: str, right: str) -> bool:
        """Whether the two pieces can stand side by side: re-merging their joint text gives them back."""
        if len(self.fits) >= 1_000_000:
            self.fits.clear()
        fit = self.fits[left + " " + right] = self._merge(left + right) == [left, right]
        return fit

    def _search(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all in the alphabet."""
        n = len(text)
        # of the pieces that end at one place of the reversed text, the shortest comes last
        longest = dict([(n - 1 - end, piece) for end, piece in reversed(list(self.automaton.iter(text[::-1])))])
        failed: bytearray | None = None  # the bitfield of positions from which the rest can't be reached, once there is one
        out: list[str] = []
        at, piece, left = 0, longest[0], None
        fits, shorter = self.fits, self.shorter
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    if left is None:
                        break
                    fit = fits.get(left + " " + piece)  # no piece has a plain space
                    if fit or fit is None and self._fit(left, piece):
                        break
                piece = shorter[piece]
            if piece is None:  # no way on from here: the piece before must be another
                if failed is None:
                    failed = bytearray((n >> 3) + 1)
                failed[at >> 3] |= 1 << (at & 7)
                back = out.pop()
                at -= len(back)
                piece, left = shorter[back], out[-1] if out else None
            else:
                out.append(piece)
                at, left = end, piece
                piece = longest.get(at)
        return out

    def _part(self, text: str) -> list[int]:
        """Ids of a part; characters outside the alphabet become their bytes, or the unknown id."""
        if self.alphabet.issuperset(text):
            return [self.id_of[p] for p in self._search(text)]
        ids: list[int] = []
        start = 0
        for k, x in enumerate(text):
            if x not in self.alphabet:
                if k > start:
                    ids += [self.id_of[p] for p in self._search(text[start:k])]
                ids += [self.byte_id[b] for b in x.encode("utf-8", "surrogatepass")] if self.byte_id else [self.unknown]
                start = k + 1
        if start < len(text):
            ids += [self.id_of[p] for p in self._search(text[start:])]
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        memo, older, ids = self.memo, self.older, []
        for part in self.part.findall(self.prefix + text.replace(" ", SPACE)):
            got = memo.get(part)
            if got is None:
                got = older.get(part)
                if got is None:
                    got = tuple(self._part(part))
                if len(part) <= 64:
                    if len(memo) >= self.memo_size:
                        older = self.older = memo
                        memo = self.memo = {}
                    memo[part] = got
            ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; the space that encoding put before it goes, bad bytes become U+FFFD."""
        if not ids:
            return ""
        table = self.bytes_of
        if self.prefix and table[ids[0]][:1] == b" " and ids[0] != self.unknown and ids[0] not in self.byte_id.values():
            return (table[ids[0]][1:] + b"".join([table[k] for k in ids[1:]])).decode("utf-8", "replace")
        return b"".join([table[k] for k in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and model."""
    return Encoder(path)


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per document: id, ids (array of int), n_tokens, decoded, and both SHA-256 sums.

    `ids_sha256` is of the decimal ids joined by commas, `decoded_sha256` of the decoded text in
    UTF-8. No begin or end ids. A null text counts as empty: no ids. Repeated rows stay repeated,
    an empty table gives none, other columns are not looked at. `model_path` is read on every
    worker. Texts of any length are taken whole; a worker keeps one text's ids at a time and a
    bounded memo of parts. With `with_text` false, ids and decoded are left out.
    """
    source = docs.select(docs[id_col].alias("_id"), text_of(text_col).alias("_text"))
    kind = docs.schema[id_col].dataType.simpleString()
    extra = "ids array<int>, decoded string, " if with_text else ""
    schema = f"`{id_col}` {kind}, {extra}n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        names = list(map(str, range(len(own.bytes_of))))
        for batch in (b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)):
            found: dict[str, list] = {k: [] for k in ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")}
            for text in batch.column("_text"):
                ids = own.encode(text.as_py())
                decoded = own.decode(ids)
                found["n_tokens"].append(len(ids))
                found["ids_sha256"].append(hashlib.sha256(",".join([names[k] for k in ids]).encode()).hexdigest())
                found["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_text:
                    found["ids"].append(ids)
                    found["decoded"].append(decoded)
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            order = ["ids", "decoded"] * with_text + ["n_tokens", "ids_sha256", "decoded_sha256"]
            arrays = [batch.column("_id"), *[pa.array(found[k], kinds.get(k, pa.string())) for k in order]]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, *order])

    return source.mapInArrow(run, schema)
