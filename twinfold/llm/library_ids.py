"""Ids by the tokenizers library, through the piece cache."""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .bpe import byte_letters
from .pieces import Pieces, may_be_cut

#: Letters that stay as they are under NFC and have a lower-case form of one letter, which is one of them, too.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įĴ-ňŊ-ſ"
#: What is one pre-token, byte-level with the space before it, word-level without.
_BYTE_WORD, _LOWER_WORD = re.compile(f"[ ]?(?:[{_LETTERS}]+|[0-9]+)"), re.compile(f"[{_LETTERS}]+")
_SPLIT = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def direct(settings: dict) -> str:
    """How a plain word reaches the model: as its bytes, with the space before it; or lower-cased and without. Else empty:
    of other tokenizers it isn't known where texts may be cut."""
    normal, before = settings.get("normalizer"), settings.get("pre_tokenizer") or {}
    if not may_be_cut(x["content"] for x in settings.get("added_tokens", [])):
        return ""
    if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in settings.get("added_tokens", [])):
        return ""
    if normal is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "bytes"
    inner, steps = (normal or {}).get("normalizers", []), before.get("pretokenizers", [])
    if [x["type"] for x in inner] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex", "").endswith(_SPLIT) and steps[0]["behavior"] == "Removed" and not steps[1]["use_regex"]:
        return "lower"
    return ""


def _folded(pieces: pa.Array) -> pa.Array:
    """Plain words lower-cased and without the one space before them; all else as it is."""
    texts = pieces.cast(pa.large_string())
    plain = pc.match_substring_regex(texts, f"^ ?[{_LETTERS}]+$")
    return pc.if_else(plain, pc.utf8_lower(pc.utf8_ltrim(texts, characters=" ")), texts).cast(pieces.type)


@functools.lru_cache(4)
def ids_of(data: bytes) -> Pieces:
    """The ids of each piece as bytes of 16-bit numbers (32-bit where the vocabulary is larger). Plain words go to the
    library's model at once, all else through its whole chain; so do whole texts of tokenizers that aren't known."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library, code = Tokenizer.from_buffer(data), id_type(data).char
    how = direct(json.loads(data))
    model, plain = library.model.tokenize, (_LOWER_WORD if how == "lower" else _BYTE_WORD).fullmatch
    spelled = {ord(c): "".join(map(_letters().__getitem__, c.encode())) for c in map(chr, range(0x180))}

    def encode(pieces: list[str]) -> pa.Array:
        out, rest = [], []
        for i, x in enumerate(pieces):
            if how and plain(x):
                out.append(array(code, [t.id for t in model(x if x[0] != " " and x.isascii() else x.translate(spelled))]).tobytes())
            else:
                out.append(b"")
                rest.append(i)
        for i, x in zip(rest, library.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array(code, x.ids).tobytes()
        return pa.array(out, pa.large_binary())

    return Pieces(encode, bool(how), _folded if how == "lower" else None)


@functools.cache
def _letters() -> dict[int, str]:
    return {b: c for c, b in byte_letters().items()}


@functools.lru_cache(4)
def id_type(data: bytes) -> np.dtype:
    d = json.loads(data)
    top = max([0, *d["model"]["vocab"].values(), *(x["id"] for x in d.get("added_tokens", []))])
    return np.dtype("<u2") if top < 1 << 16 else np.dtype("<u4")
