"""Token ids with the byte-level BPE vocabulary of the ``tokenizers`` library, for packing and token output.

The ids are those of ``Tokenizer.from_file(byte_bpe_50k.json).encode(text, add_special_tokens=False)``;
tests compare the two. They are computed from the same vocabulary's rank file by tiktoken, which
takes a tenth of the time. The special token's string in a text gives its id, as it does there.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np

#: Ends every document.
END = 0


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


def encode(text: str | None, path: str) -> np.ndarray:
    """Ids of the whole text, then END; null counts as empty."""
    ids = _encoding(path).encode_to_numpy(text or "", allowed_special="all") if text else np.empty(0, np.uint32)
    return np.append(ids, np.uint32(END)).astype("<u4")
