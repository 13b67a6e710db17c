"""Pre-tokens of whole texts, and ids by the sentencepiece library with a memo of repeated units.

A text may be cut between two bytes where no piece of the vocabulary holds these two bytes side by
side: byte-pair merging can never join across such a place, so what lies on either side is encoded
as if the other were not there. Cuts are made at white space only, which keeps pre-tokens few.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trialforge.llm import tokens
from trialforge.llm.common import quiet_env
from trialforge.llm.tokens import UnitTokenizer, byte_letters

SPACE = "▁"
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of code points that may be white space outside ASCII.
_WHITE_LEADS = [0xC2, 0xE1, 0xE2, 0xE3]


def spaced(texts: pa.Array) -> pa.Array:
    """Each text (null: empty) after one space, which is what sentencepiece reads; an empty one stays empty."""
    filled = texts.fill_null("")
    return pc.if_else(pc.equal(pc.binary_length(filled), 0), filled, pc.binary_join_element_wise(pa.scalar(" ", filled.type), filled, pa.scalar("", filled.type)))


def load_pieces(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    # a ligature, two spaces, a wide letter and a combining accent, which normalisers rewrite
    probe, meaning = "\ufb01  \uff21e\u0301", piece_bytes(model)
    if b"".join(meaning[i] for i in model.encode(probe)) != f" {probe}".encode():
        raise ValueError(f"{path} changes texts before it cuts them into pieces")
    return model


def piece_bytes(model) -> list[bytes]:
    """What each piece stands for in a text."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(SPACE, " ").encode())
    return out


class PieceCounter:
    """Pre-tokens and their number of pieces for a sentencepiece model whose normaliser changes nothing."""

    def __init__(self, path: str):
        self.model = load_pieces(path)
        joined, plain = np.zeros(1 << 16, bool), set(range(1, 32))
        for i, raw in enumerate(piece_bytes(self.model)):
            if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)):
                b = np.frombuffer(raw, np.uint8).astype(np.int64)
                joined[b[:-1] << 8 | b[1:]] = True
                plain -= set(raw)
        self.joined = joined
        #: A character that stands in no piece, so that nothing merges with it.
        self.wall = chr(min(plain))

    def prepared(self, texts: pa.Array) -> pa.Array:
        # the library reads U+2581 and a space alike
        return spaced(pc.replace_substring(texts.fill_null(""), SPACE, " "))

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places inside the bytes where a pre-token may begin."""
        left, right = data[:-1], data[1:]
        apart = ~self.joined[left.astype(np.uint16) << 8 | right] & (_WHITE[left] | _WHITE[right])
        return np.flatnonzero(apart & ((right & 0xC0) != 0x80)) + 1

    def count(self, pre_tokens: Sequence[bytes]) -> list[int]:
        """Pieces of each pre-token. The library adds a space, which a pre-token without one keeps behind a wall."""
        given = [t.decode() for t in pre_tokens]
        asked = [t[1:] if t.startswith(" ") else self.wall + t for t in given]
        found = self.model.encode(asked, num_threads=1) if asked else []
        # a lone space has nothing left to ask for: it is one piece, or its bytes
        return [self.lone() if t == " " else len(ids) - 2 * (t[:1] != " ") for t, ids in zip(given, found)]

    def lone(self) -> int:
        return len(self.model.encode(self.wall)) - 1


class ByteLevelCounter:
    """The same for a file of the tokenizers library. Byte-level pre-tokens begin at an ASCII space before what is
    no white space; with any other kind of file each whole text is one pre-token."""

    def __init__(self, path: str):
        import json

        quiet_env()
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        kind = spec.get("pre_tokenizer") or {}
        self.cutting = not spec.get("normalizer") and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))

    def prepared(self, texts: pa.Array) -> pa.Array:
        return texts.fill_null("")

    def cuts(self, data: np.ndarray) -> np.ndarray:
        if not self.cutting:
            return np.zeros(0, np.int64)
        start = (data[:-1] == 0x20) & ~_WHITE[data[1:]] & (data[1:] > 0x20) & ~np.isin(data[1:], _WHITE_LEADS)
        start[1:] &= data[: len(start) - 1] != 0x20
        at = np.flatnonzero(start)
        return at[at > 0]

    def count(self, pre_tokens: Sequence[bytes]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast([t.decode() for t in pre_tokens], add_special_tokens=False)]


_COUNTERS: dict[str, PieceCounter | ByteLevelCounter] = {}


def counter(path: str) -> PieceCounter | ByteLevelCounter:
    """One per worker process and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = (PieceCounter if path.endswith(".model") else ByteLevelCounter)(path)
    return _COUNTERS[path]


class PieceTokenizer(UnitTokenizer):
    """Ids of texts given with the space in front (`spaced`), in units that begin at a space before a word."""

    def __init__(self, path: str, limit: int = 1_000_000):
        self.library = load_pieces(path)
        self.limit = limit
        self.mask = np.uint64((1 << (2 * limit).bit_length()) - 1)
        self.narrow = self.library.get_piece_size() <= 1 << 16
        self.clear()

    def bytes_of_ids(self) -> list[bytes]:
        return piece_bytes(self.library)

    def _library_ids(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode([t[1:] for t in texts], num_threads=1) if texts else []

    def _unit_ids(self, units: list[str]) -> list[list[int]]:
        return self._library_ids(units)

    def _certain(self, part: str, later: bool) -> bool:
        # a unit follows a space and holds none: only spaces could merge with the next unit's space
        return later and SPACE not in part


class PlainTokenizer(UnitTokenizer):
    """The tokenizers library with the strings of special tokens taken as plain text."""

    def __init__(self, path: str, limit: int = 1_000_000):
        super().__init__(path, limit)
        self.library.encode_special_tokens = True

    def bytes_of_ids(self) -> list[bytes]:
        back = {c: b for b, c in enumerate(byte_letters())}
        tokens_ = (self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size()))
        return [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in tokens_]


def exact_tokenizer(path: str) -> PieceTokenizer | PlainTokenizer:
    """One per worker process and file; its memo goes with those of `tokens.forget`."""
    name = f"{path} as plain text"
    if name not in tokens._LOADED:
        tokens._LOADED[name] = (PieceTokenizer if path.endswith(".model") else PlainTokenizer)(path)
    return tokens._LOADED[name]
