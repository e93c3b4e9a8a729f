"""Byte-level BPE ids from a public tokenizer file, given by its path."""

from __future__ import annotations

import functools
import json

import numpy as np

END = 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes: printable bytes as themselves, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """encode(text) gives the ids of Tokenizer.encode(text, add_special_tokens=False).

    The ranks are read from the file and run by tiktoken, whose ids are the same and come several times
    faster. A text that its pattern engine refuses, or that holds the string of one of the file's added
    tokens (one id there, and a place where the tokenizer parts a text), goes to the tokenizers library itself.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        added = spec.get("added_tokens") or []
        special = {x["id"] for x in added}
        self._added = tuple(x["content"] for x in added)
        ranks = {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items() if i not in special}
        self._fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._slow = Tokenizer.from_file(path)

    def encode(self, text: str) -> list[int]:
        if any(x in text for x in self._added):
            return self._slow.encode(text, add_special_tokens=False).ids
        try:
            return self._fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit, MemoryError):
            raise
        except BaseException:  # noqa: BLE001  the pattern engine's stack or panic errors
            return self._slow.encode(text, add_special_tokens=False).ids

    def with_end(self, text: str) -> np.ndarray:
        ids = self.encode(text)
        ids.append(END)
        return np.array(ids, dtype="<u4")


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
