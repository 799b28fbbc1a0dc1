"""Byte-level BPE ids of whole texts.

The vocabulary is a file of a public tokenizer (never copied, never trained).
``ranks_path`` names the same vocabulary as ranks; from it ids come several times
faster, and tests hold them equal to those of the ``tokenizers`` library. A text
that the fast encoder refuses goes to the ``tokenizers`` library.
"""

from __future__ import annotations

import base64
import functools

import numpy as np


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, model_path: str, ranks_path: str | None, pattern: str | None):
        self.model_path, self.slow, self.fast = model_path, None, None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                self.lengths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        """Ids as uint32, without special tokens; strings of special tokens are ordinary text."""
        if self.fast is not None:
            try:
                return np.asarray(self.fast.encode_ordinary(text), np.uint32)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # its pattern engine gives up on very long white space, by a panic that is no Exception
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.model_path)
            self.slow.encode_special_tokens = True
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=2)
def encoder(model: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken") -> Encoder:
    """One encoder a worker process; names are of files of the public tokenizers."""
    import public_tokenizers

    return Encoder(public_path(model), ranks and public_path(ranks), public_tokenizers.PATTERN)
