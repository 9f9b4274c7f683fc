"""Byte-level BPE ids of public vocabularies, one encoder a Python worker."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: Texts of these characters only are encoded by the faster of two libraries with the same vocabulary; all others by tokenizers.
PLAIN = re.compile("[^\x00-ɏ‐-‧€]")
#: Above this run of characters without a space, too.
LONG_RUN = re.compile(r"\S{2000}")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def slow_encoder(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True  # their strings in a text are ordinary text
    return out


@functools.cache
def fast_encoder(path: str):
    """The same merges as ranks: the vocabulary file's own order of ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, special = spec["model"]["vocab"], {t["content"] for t in spec.get("added_tokens", [])}
    back = _byte_of_letter()
    ranks = {bytes(back[c] for c in piece): i for piece, i in vocab.items() if piece not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_of_letter() -> dict[str, int]:
    """The usual printable stand-ins of byte-level BPE: printable bytes stand for themselves, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.cache
def id_type(path: str) -> type[np.unsignedinteger]:
    """The smallest type that holds all ids of a vocabulary."""
    return np.uint16 if slow_encoder(path).get_vocab_size() <= 1 << 16 else np.uint32


def encode(text: str, path: str) -> list[int]:
    """Ids without special tokens, as tokenizers gives them."""
    if PLAIN.search(text) or LONG_RUN.search(text):
        return slow_encoder(path).encode(text, add_special_tokens=False).ids
    return fast_encoder(path).encode_ordinary(text)

