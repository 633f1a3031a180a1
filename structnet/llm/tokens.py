"""Token ids of a public byte-level vocabulary."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

SPECIAL = "<|endoftext|>"


def vocabulary() -> tuple[str, str]:
    """Paths of the vocabulary, as merges and as ranks; both name the same ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Ids:
    """Ids of texts. Ranks are several times faster than merges; merges take the texts that ranks do not cover."""

    def __init__(self, merges: str, ranks: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self._merges_path = merges
        self._merges = None

    def __call__(self, text: str) -> np.ndarray:
        if SPECIAL not in text:
            try:
                return self._ranks.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
            except BaseException as e:  # its regular expressions give up on some very long runs
                if type(e).__name__ not in ("PanicException", "ValueError"):
                    raise
        if self._merges is None:
            from tokenizers import Tokenizer

            self._merges = Tokenizer.from_file(self._merges_path)
        return np.array(self._merges.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def ids_of(merges: str, ranks: str) -> Ids:
    """One per Python worker."""
    return Ids(merges, ranks)
